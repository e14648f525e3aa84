"""Property graph over region, nation, customer and supplier: bounded walks, path scores, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.plans.registry import query

EDGES_SQL = """edges AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'LOCATED_IN' AS kind, 0.9 AS conf FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN', CASE WHEN c_acctbal < 0 THEN 0.8 ELSE 0.6 END FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'TRADES_IN', 0.7 FROM supplier),
twoway AS (SELECT source, target, kind, conf FROM edges UNION ALL SELECT target, source, kind, conf FROM edges)"""


def edges(t):
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, a, b, kind, conf: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), conf.cast("double").alias("conf"))
    return (
        row(t.nation, node("n", "n_nationkey"), node("r", "n_regionkey"), "LOCATED_IN", F.lit(0.9))
        .unionByName(row(t.customer, node("c", "c_custkey"), node("n", "c_nationkey"), "LIVES_IN", F.when(F.col("c_acctbal") < 0, 0.8).otherwise(0.6)))
        .unionByName(row(t.supplier, node("s", "s_suppkey"), node("n", "s_nationkey"), "TRADES_IN", F.lit(0.7)))
    )


def symmetrised(e):
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", "conf"))


def walk(e, seeds, hops=2, kinds=None, excluded=(), least=0.0, limit=200):
    """Acyclic paths from seeds along edges in either direction, up to so many hops: the first `limit` by depth, then confidence, then nodes.

    Edges are filtered before the walk: by kind, by source (an unknown one stays), by quality (a missing one is 1). A missing confidence is 0.8."""
    have = lambda name, kind: F.col(name) if name in e.columns else F.lit(None).cast(kind)
    origin, quality = have("origin", "string"), have("quality", "double")
    e = e.withColumns({"origin": origin, "quality": quality, "conf": F.coalesce("conf", F.lit(0.8))})
    e = e.filter((F.col("kind").isin(kinds) if kinds else F.lit(True)) & (F.col("origin").isNull() | ~F.col("origin").isin(list(excluded))) & (F.coalesce("quality", F.lit(1.0)) >= least))
    columns = ["kind", "conf", F.coalesce("origin", F.lit("unknown")).alias("origin")]
    step = e.select(F.col("source").alias("at"), "target", *columns).unionByName(e.select(F.col("target").alias("at"), F.col("source").alias("target"), *columns)).filter("target is not null")
    paths = seeds.select(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<double>").alias("confs"), F.array().cast("array<string>").alias("origins"), F.col("node").alias("at"))
    out = None
    for _ in range(hops):
        grown = paths.join(step, "at").filter(~F.array_contains("nodes", F.col("target")))
        paths = grown.select(*[F.array_append(a, F.col(c)).alias(a) for a, c in (("nodes", "target"), ("kinds", "kind"), ("confs", "conf"), ("origins", "origin"))], F.col("target").alias("at"))
        out = paths if out is None else out.unionByName(paths)
    found = out.drop("at").withColumn("depth", F.size("kinds")).withColumn("total", F.aggregate("confs", F.lit(1.0), lambda a, x: a * F.greatest(x, F.lit(0.01))))
    return found.orderBy("depth", F.desc(F.round("total", 9)), F.array_join("nodes", ">")).limit(limit)


def scored(paths, boost=None, decay=0.7, derived=(), penalty=0.7):
    """Confidence × decay^(hops-1) × the geometric mean of the kinds' boosts × penalty for each edge of a derived source."""
    factor = lambda k: F.coalesce(*[F.when(k == n, F.lit(float(b))) for n, b in (boost or {}).items()], F.lit(1.0))
    mean = F.pow(F.aggregate(F.transform("kinds", factor), F.lit(1.0), lambda a, x: a * x), 1 / F.col("depth"))
    from_derived = F.size(F.filter("origins", lambda o: o.isin(list(derived)))) if derived else F.lit(0)
    return paths.withColumn("score", F.round(F.col("total") * F.pow(F.lit(decay), F.col("depth") - 1) * mean * F.pow(F.lit(penalty), from_derived), 6))


@query(f"WITH {EDGES_SQL} SELECT kind, count(*) AS n FROM edges GROUP BY 1")
def edges_by_kind(t):
    return edges(t).groupBy("kind").agg(F.count("*").alias("n"))


SOURCED = EDGES_SQL.replace("0.9 AS conf", "0.9 AS conf, 'kg' AS origin").replace("0.8 ELSE 0.6 END", "NULL ELSE 0.6 END, CASE WHEN c_custkey % 2 = 0 THEN 'vn' END").replace("'TRADES_IN', 0.7", "'TRADES_IN', 0.7, 'register'").replace("kind, conf FROM edges", "kind, coalesce(conf, 0.8) AS conf, coalesce(origin, 'unknown') AS origin FROM edges").replace("target, source, kind, coalesce(conf", "target, source, kind, coalesce(conf")


def sourced_edges(t):
    """edges with their origin; customers in debt have no confidence."""
    conf = F.when(~((F.col("kind") == "LIVES_IN") & (F.col("conf") == 0.8)), F.col("conf"))
    number = F.substring("source", 2, 18).try_cast("long")
    origin = F.when(F.col("kind") == "LOCATED_IN", "kg").when(F.col("kind") == "TRADES_IN", "register").when(number % 2 == 0, "vn")
    return edges(t).withColumns({"origin": origin, "conf": conf})


@query(f"""WITH {SOURCED}, seeds AS (SELECT 's' || s_suppkey AS s FROM supplier ORDER BY s_suppkey LIMIT 5), one AS (SELECT s, b.target AS a, b.conf, b.kind, b.origin FROM seeds JOIN twoway b ON b.source = s),
two AS (SELECT s, a, b.target AS z, one.conf AS c1, b.conf AS c2, one.kind AS k1, b.kind AS k2, one.origin AS o1, b.origin AS o2 FROM one JOIN twoway b ON b.source = a WHERE b.target <> s),
p AS (SELECT s || '>' || a AS path, 1 AS depth, conf AS total, CASE WHEN kind = 'LOCATED_IN' THEN 1.5 ELSE 1.0 END AS boost, CASE WHEN origin = 'vn' THEN 0.7 ELSE 1.0 END AS vn FROM one
UNION ALL SELECT s || '>' || a || '>' || z, 2, c1 * c2, sqrt(CASE WHEN k1 = 'LOCATED_IN' THEN 1.5 ELSE 1.0 END * CASE WHEN k2 = 'LOCATED_IN' THEN 1.5 ELSE 1.0 END), CASE WHEN o1 = 'vn' THEN 0.7 ELSE 1.0 END * CASE WHEN o2 = 'vn' THEN 0.7 ELSE 1.0 END FROM two),
l AS (SELECT * FROM p ORDER BY depth, round(total, 9) DESC, path LIMIT 200) SELECT path, depth, round(total * CASE WHEN depth = 2 THEN 0.7 ELSE 1 END * boost * vn, 6) AS score FROM l""")
def scored_walks(t):
    """The first 200 paths from five seeds, with scores that favour LOCATED_IN and distrust derived edges."""
    seeds = t.supplier.orderBy("s_suppkey").limit(5).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))  # a question's entities
    return scored(walk(sourced_edges(t), seeds), {"LOCATED_IN": 1.5}, derived=["vn"]).select(F.array_join("nodes", ">").alias("path"), "depth", "score")


@query(f"""WITH {EDGES_SQL} SELECT 'c' || c_custkey AS node, count(DISTINCT 's' || s_suppkey) AS hits, round(count(DISTINCT s_suppkey) * 1.0 / (SELECT count(*) FROM supplier), 6) AS score FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1""")
def hydrated_hits(t):
    """Customers that share a nation with suppliers: seeds reached, as a share of all seeds. Seeds are counted for each nation before the join."""
    total = t.supplier.count()
    n = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count_distinct("s_suppkey").alias("hits"))
    return t.customer.join(n, "c_nationkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), "hits", F.round(F.col("hits") / F.lit(total), 6).alias("score"))


@query("SELECT 'p' || c_custkey AS source, 'party:' || c_mktsegment AS target, 'LID_VAN' AS kind, 1.0 AS conf FROM customer WHERE c_acctbal >= 0")
def membership_edges(t):
    """Person to party, but for the edges that are there already."""
    new = t.customer.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("party:"), F.col("c_mktsegment")).alias("target"), F.lit("LID_VAN").alias("kind"), F.lit(1.0).alias("conf"))
    there = t.customer.filter("c_acctbal < 0").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("source"), F.lit("LID_VAN").alias("kind"))
    return new.join(there, ["source", "kind"], "left_anti").select("source", "target", "kind", "conf")


@query("""WITH v AS (SELECT o_orderkey AS m, unnest(['VVD', 'D66']) AS party, 'STEMT_VOOR' AS kind FROM orders UNION ALL SELECT o_orderkey, unnest(['SP', 'Volt']), 'STEMT_TEGEN' FROM orders WHERE o_orderstatus <> 'P')
SELECT 'party:' || party AS source, 'm' || m AS target, kind, 0.8 AS conf FROM v""")
def vote_edges(t):
    """Party to motion, for and against, out of the text of the vote; parties by their aliases."""
    from plenum.functions.text import party

    made = F.concat(F.lit("De fracties van vvd en D66 stemmen voor"), F.when(F.col("o_orderstatus") != "P", ". De fracties van sp, volt stemmen tegen").otherwise(""))
    side = lambda word: F.regexp_extract(made, rf"(?i)fracties van ([^.]*?) stemmen {word}", 1)
    of = lambda word, kind: t.orders.select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("target"), F.explode(F.split(side(word), r",\s*|\s+en\s+")).alias("raw"), F.lit(kind).alias("kind"))
    both = of("voor", "STEMT_VOOR").unionByName(of("tegen", "STEMT_TEGEN")).withColumn("party", party(F.col("raw"))).filter("party is not null")
    return both.select(F.concat(F.lit("party:"), F.col("party")).alias("source"), "target", "kind", F.lit(0.8).alias("conf")).distinct()


@query("""SELECT DISTINCT 'm' || l_partkey AS source, 'v' || l_orderkey AS target, CASE l_returnflag WHEN 'A' THEN 'AANGENOMEN' WHEN 'R' THEN 'VERWORPEN' END AS kind, 0.95 AS conf FROM lineitem WHERE l_returnflag <> 'N'""")
def outcome_edges(t):
    """Motion to meeting by outcome, each pair once."""
    kind = F.when(F.col("l_returnflag") == "A", "AANGENOMEN").when(F.col("l_returnflag") == "R", "VERWORPEN")
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return t.lineitem.select(node("m", "l_partkey").alias("source"), node("v", "l_orderkey").alias("target"), kind.alias("kind"), F.lit(0.95).alias("conf")).filter("kind is not null").distinct()


@query("""WITH x AS (SELECT o_orderkey, unnest(['naam' || (o_custkey % 50), 'naam' || (o_custkey % 7)]) AS person FROM orders) SELECT DISTINCT person AS source, 'm' || o_orderkey AS target, 'DIENT_IN' AS kind FROM x""")
def submitter_edges(t):
    """Person to motion, out of its list of submitters, each once."""
    from plenum.functions.text import surname_key

    person = lambda n: F.concat(F.lit("dhr. A. Naam"), (F.col("o_custkey") % n).cast("string"))
    made = F.concat(F.lit("Indieners: "), person(50), F.lit(", "), person(7), F.lit(" (VVD)"))
    names = F.split(F.regexp_extract(made, r"Indieners: (.*)", 1), r",\s*")
    rows = t.orders.select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("target"), F.explode(names).alias("raw"))
    return rows.select(surname_key(F.regexp_replace("raw", r"\s*\([^)]*\)$", "")).alias("source"), "target", F.lit("DIENT_IN").alias("kind")).distinct()


@query("""WITH p AS (SELECT c_custkey, unnest(['wonen', 'haven ' || (c_custkey % 5)]) AS area FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT 'p' || c_custkey AS source, 'area:' || area AS target FROM p""")
def portfolio_edges(t):
    """Person to policy areas, out of notes that list a portfolio."""
    note = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("Portefeuille: wonen en haven "), (F.col("c_custkey") % 5).cast("string"))).otherwise("geen")
    areas = F.split(F.regexp_extract(note, r"Portefeuille: (.*)", 1), r",\s*|\s+en\s+")
    rows = t.customer.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("source"), F.explode(areas).alias("area")).filter("area != ''")
    return rows.select("source", F.concat(F.lit("area:"), F.col("area")).alias("target"))


@query("""SELECT l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS entities, count(*) AS mentions FROM lineitem GROUP BY 1""")
def entity_ids(t):
    """Sorted distinct entities of each chunk, and its mentions."""
    return t.lineitem.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("entities"), F.count("*").alias("mentions"))


@query("""WITH m AS (SELECT 'naam' || (l_suppkey % 40) AS name, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 10) SELECT c_custkey, string_agg(DISTINCT a, ',' ORDER BY a) AS aliases FROM (SELECT c_custkey, unnest(['naam' || (c_custkey % 60), 'J. naam' || (c_custkey % 60)]) AS a FROM customer UNION ALL SELECT c_custkey, 'de heer ' || name FROM customer JOIN m ON name = 'naam' || (c_custkey % 60)) GROUP BY 1""")
def alias_seeding(t):
    """Variants of every name, and those that ten mentions or more use of it."""
    name = F.concat(F.lit("naam"), (F.col("c_custkey") % 60).cast("string"))
    own = t.customer.select("c_custkey", name.alias("name"), F.array(name, F.concat(F.lit("J. "), name)).alias("aliases"))
    m = t.lineitem.groupBy(F.concat(F.lit("naam"), (F.col("l_suppkey") % 40).cast("string")).alias("name")).count().filter("count >= 10").select("name", F.concat(F.lit("de heer "), F.col("name")).alias("more"))
    both = own.join(m, "name", "left").withColumn("aliases", F.array_union("aliases", F.array_compact(F.array("more"))))
    return both.select("c_custkey", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query("""WITH e AS (SELECT l_suppkey AS c, p_brand AS b, p_type AS k, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3) SELECT c, b, k, n FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, b, k) rn FROM e) WHERE rn <= 20""")
def community_relations(t):
    """The twenty strongest relations within each community."""
    from plenum.operators.relops import top_n

    e = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("c"), F.col("p_brand").alias("b"), F.col("p_type").alias("k")).agg(F.count("*").alias("n"))
    return top_n(e, ["c"], [F.desc("n"), F.col("b"), F.col("k")], 20).select("c", "b", "k", "n")


@query("""WITH RECURSIVE up AS (SELECT 'c' || c_custkey AS leaf, 'n' || c_nationkey AS node, 1 AS depth FROM customer UNION ALL SELECT leaf, 'r' || n_regionkey, 2 FROM up JOIN nation ON node = 'n' || n_nationkey)
SELECT node, depth, count(*) AS n FROM up GROUP BY ALL""")
def location_hierarchy(t):
    """How many customers lie under each nation and region."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string")).alias("node")
    one = t.customer.select(name("n", "c_nationkey"), F.lit(1).alias("depth"))
    return one.unionByName(c.select(name("r", "n_regionkey"), F.lit(2).alias("depth"))).groupBy("node", "depth").agg(F.count("*").alias("n"))
