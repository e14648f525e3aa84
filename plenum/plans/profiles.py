"""Profiles of parties and policy areas, answers and their measures, audits of listings: aggregates with rules on top."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators.relops import distinct_on, islands
from plenum.plans.registry import query

#: Lines by part type (a policy area) and ship mode of two parties: a positive, the other negative.
POSITIONS = "p AS (SELECT p_type AS area, l_returnflag AS source, l_linestatus AS kind, l_discount * 10 AS conf, l_shipdate AS d, l_orderkey AS motion FROM lineitem JOIN part ON p_partkey = l_partkey)"


def positions(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_type").alias("area"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("kind"), (F.col("l_discount") * 10).alias("conf"), F.col("l_shipdate").alias("d"), F.col("l_orderkey").alias("motion"))


@query(f"WITH {POSITIONS} SELECT source, area, count(*) AS n, count(*) FILTER (WHERE kind = 'F') AS motions, count(*) FILTER (WHERE kind <> 'F') AS other, round(avg(conf), 6) AS confidence FROM p GROUP BY 1, 2")
def frequency_profile(t):
    return positions(t).groupBy("source", "area").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "F").alias("motions"), F.count_if(F.col("kind") != "F").alias("other"), F.round(F.avg("conf"), 6).alias("confidence"))


@query(f"WITH {POSITIONS} SELECT source, area, count(DISTINCT strftime(d, '%Y-%m')) AS months, CASE WHEN count(DISTINCT strftime(d, '%Y-%m')) > 1 THEN 'SUSTAINED' ELSE 'SITUATIONAL' END AS pattern FROM p GROUP BY 1, 2")
def sustained_areas(t):
    """Areas named in more than one month."""
    months = F.count_distinct(F.date_format("d", "yyyy-MM"))
    return positions(t).groupBy("source", "area").agg(months.alias("months")).withColumn("pattern", F.when(F.col("months") > 1, "SUSTAINED").otherwise("SITUATIONAL"))


ALIGNED = f"""{POSITIONS}, c AS (SELECT area, count(*) FILTER (WHERE source = 'A') AS a1, count(*) FILTER (WHERE source = 'R') AS b1, count(DISTINCT motion) FILTER (WHERE source = 'A') AS a2, count(DISTINCT motion) FILTER (WHERE source = 'R') AS b2,
count(*) FILTER (WHERE source = 'A' AND kind = 'F') AS a3, count(*) FILTER (WHERE source = 'R' AND kind = 'F') AS b3, least(avg(conf) FILTER (WHERE source = 'A'), avg(conf) FILTER (WHERE source = 'R')) / 10 AS conf FROM p GROUP BY 1),
s AS (SELECT area, round(coalesce((0.3 * coalesce(least(a1, b1) * 1.0 / nullif(greatest(a1, b1), 0), 0) + 0.4 * coalesce(least(a2, b2) * 1.0 / nullif(greatest(a2, b2), 0), 0) + 0.3 * coalesce(least(a3, b3) * 1.0 / nullif(greatest(a3, b3), 0), 0)) * conf, 0), 6) AS score FROM c)"""


def layer_ratio(a, b):
    """The smaller count as a share of the larger one; 0 if both are."""
    return F.coalesce(F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0)), F.lit(0.0))


def alignments(t):
    """area, score: 0.3, 0.4 and 0.3 of three layers' ratios between two parties, times the smaller confidence."""
    of = lambda s: F.col("source") == s
    c = positions(t).groupBy("area").agg(
        *[F.count_if(of(s)).alias(f"{n}1") for n, s in (("a", "A"), ("b", "R"))],
        *[F.count_distinct(F.when(of(s), F.col("motion"))).alias(f"{n}2") for n, s in (("a", "A"), ("b", "R"))],
        *[F.count_if(of(s) & (F.col("kind") == "F")).alias(f"{n}3") for n, s in (("a", "A"), ("b", "R"))],
        *[F.avg(F.when(of(s), F.col("conf"))).alias(f"{n}c") for n, s in (("a", "A"), ("b", "R"))],
    )
    score = (0.3 * layer_ratio(F.col("a1"), F.col("b1")) + 0.4 * layer_ratio(F.col("a2"), F.col("b2")) + 0.3 * layer_ratio(F.col("a3"), F.col("b3"))) * F.least("ac", "bc") / 10
    return c.select("area", F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))


@query(f"WITH {ALIGNED} SELECT * FROM s")
def weighted_alignment(t):
    return alignments(t)


@query(f"WITH {ALIGNED} SELECT area, score, CASE WHEN score < 0.5 THEN 'uiteenlopend' ELSE 'vergelijkbaar' END AS note FROM s ORDER BY score, area LIMIT 5")
def least_aligned(t):
    """The five areas of the least alignment."""
    return alignments(t).orderBy("score", "area").limit(5).withColumn("note", F.when(F.col("score") < 0.5, "uiteenlopend").otherwise("vergelijkbaar"))


@query(f"WITH {ALIGNED} SELECT count(*) AS areas, round(avg(score), 6) AS mean, count(*) FILTER (WHERE score > 0.7) AS high, count(*) FILTER (WHERE score < 0.3) AS low FROM s")
def alignment_summary(t):
    return alignments(t).agg(F.count("*").alias("areas"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("score") > 0.7).alias("high"), F.count_if(F.col("score") < 0.3).alias("low"))


@query(f"WITH {ALIGNED} SELECT round(avg(score), 6) AS mean, coalesce(string_agg(area, ',' ORDER BY area) FILTER (WHERE score > 0.45), '') AS strong, coalesce(string_agg(area, ',' ORDER BY area) FILTER (WHERE score < 0.4), '') AS weak, (SELECT count(*) FROM p) AS activity FROM s")
def lens_summary(t):
    """Mean, strong and weak areas, and activity."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("area")))), ",")
    activity = positions(t).count()
    return alignments(t).agg(F.round(F.avg("score"), 6).alias("mean"), listed(F.col("score") > 0.45).alias("strong"), listed(F.col("score") < 0.4).alias("weak"), F.lit(activity).alias("activity"))


@query(f"""WITH {POSITIONS}, a AS (SELECT area, count(*) AS n FROM p WHERE source = 'A' AND conf > 5 GROUP BY 1), b AS (SELECT area, count(*) AS n FROM p WHERE source = 'R' AND conf < 5 GROUP BY 1), m AS (SELECT coalesce(a.area, b.area) AS area, a.n AS programme, b.n AS minutes FROM a FULL JOIN b ON a.area = b.area)
SELECT area, coalesce(programme, 0) AS programme, coalesce(minutes, 0) AS minutes, CASE WHEN programme IS NOT NULL AND minutes IS NOT NULL THEN 'consistent' WHEN programme IS NOT NULL THEN 'not_expressed' ELSE 'new_position' END AS label FROM m""")
def position_merge(t):
    """Programme and minutes by area, whichever has it, with a label of consistency."""
    p = positions(t)
    a = p.filter("source = 'A' and conf > 5").groupBy("area").agg(F.count("*").alias("programme"))
    b = p.filter("source = 'R' and conf < 5").groupBy("area").agg(F.count("*").alias("minutes"))
    both = F.col("programme").isNotNull() & F.col("minutes").isNotNull()
    return a.join(b, "area", "full_outer").select("area", F.coalesce("programme", F.lit(0)).alias("programme"), F.coalesce("minutes", F.lit(0)).alias("minutes"), F.when(both, "consistent").when(F.col("programme").isNotNull(), "not_expressed").otherwise("new_position").alias("label"))


@query("""WITH s AS (SELECT c_mktsegment AS party, count(*) FILTER (WHERE o_orderstatus = 'F') * 1.0 / count(*) AS share, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS motions, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS questions, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS amendments FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT party, round(share, 6) AS share, CASE WHEN share > 0.75 THEN 'high' WHEN share > 0.5 THEN 'medium' ELSE 'low' END AS consistency, motions, questions, amendments FROM s""")
def party_consistency(t):
    """Share of consistent positions in three bands, and what each party put forward."""
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("party"))
    is_ = lambda p: F.count_if(F.col("o_orderpriority") == p)
    s = rows.agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share"), is_("1-URGENT").alias("motions"), is_("2-HIGH").alias("questions"), is_("3-MEDIUM").alias("amendments"))
    return s.select("party", F.round("share", 6).alias("share"), F.when(F.col("share") > 0.75, "high").when(F.col("share") > 0.5, "medium").otherwise("low").alias("consistency"), "motions", "questions", "amendments")


@query("""SELECT p_type AS topic, count(*) FILTER (WHERE l_returnflag = 'A') AS support, count(*) FILTER (WHERE l_returnflag = 'R') AS oppose FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0""")
def contradictions(t):
    """Topics that are both supported and opposed."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("topic"))
    return rows.agg(F.count_if(F.col("l_returnflag") == "A").alias("support"), F.count_if(F.col("l_returnflag") == "R").alias("oppose")).filter("support > 0 and oppose > 0")


def balance(text, good, bad):
    """0.5 and 0.3 times the balance of hits, smoothed by one."""
    hits = lambda ws: F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.lower(text).contains(w)))
    g, b = hits(good), hits(bad)
    return F.round(0.5 + 0.3 * (g - b) / (g + b + 1), 6)


@query("""WITH h AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'eau') THEN 1 ELSE 0 END) AS g, (CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'los') THEN 1 ELSE 0 END) AS b FROM documents)
SELECT doc_id, round(0.5 + 0.3 * (g - b) / (g + b + 1), 6) AS balance, greatest(0, least(1, round(0.5 + CASE WHEN g > 0 THEN 0.2 ELSE 0 END - CASE WHEN b > 0 THEN 0.2 ELSE 0 END, 6))) AS alignment, CASE WHEN g = 2 THEN 'wonen' WHEN b > 0 THEN 'zorg' ELSE 'overig' END AS category, CASE WHEN g = 2 THEN 0.8 WHEN g = 1 THEN 0.6 ELSE 0.3 END AS found FROM h""")
def keyword_scores(t):
    """Scores by keywords: balance, alignment within bounds, the first category with a hit, and found words of a vision."""
    low = F.lower("text")
    g, b = (lambda ws: F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: low.contains(w))))(["the", "eau"]), (lambda ws: F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: low.contains(w))))(["der", "los"])
    alignment = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(0.5 + F.when(g > 0, 0.2).otherwise(0.0) - F.when(b > 0, 0.2).otherwise(0.0), 6)))
    return t.documents.select("doc_id", balance(F.col("text"), ["the", "eau"], ["der", "los"]).alias("balance"), alignment.alias("alignment"), F.when(g == 2, "wonen").when(b > 0, "zorg").otherwise("overig").alias("category"), F.when(g == 2, 0.8).when(g == 1, 0.6).otherwise(0.3).alias("found"))


# answers and their measures: an event is a retrieved chunk, its user the question, its value the score

RANKED = "r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS after FROM events)"


def ranked(t):
    by = Window.partitionBy("user_id")
    return t.events.select("user_id", "event_id", "event_type", "value", F.row_number().over(by.orderBy("ts", "event_id")).alias("before"), F.row_number().over(by.orderBy(F.desc("value"), "event_id")).alias("after"))


@query("SELECT user_id, count(*) AS chunks, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS precision_ FROM events GROUP BY 1")
def context_precision(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("chunks"), F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 6).alias("precision_"))


@query(f"WITH {RANKED} SELECT user_id, round(avg(abs(before - after)), 6) AS moved, count(*) FILTER (WHERE before - after >= 5) AS promoted, count(*) FILTER (WHERE after - before >= 5) AS demoted FROM r GROUP BY 1")
def reranker_impact(t):
    """How far reranking moves the chunks of each question."""
    return ranked(t).groupBy("user_id").agg(F.round(F.avg(F.abs(F.col("before") - F.col("after"))), 6).alias("moved"), F.count_if(F.col("before") - F.col("after") >= 5).alias("promoted"), F.count_if(F.col("after") - F.col("before") >= 5).alias("demoted"))


@query(f"""WITH {RANKED}, f AS (SELECT user_id, event_id, before <= 10 AS v, event_type IN ('click', 'view') AS k FROM r WHERE after <= 10)
SELECT user_id, round(avg(CASE WHEN v AND NOT k THEN 1.0 ELSE 0.0 END), 6) AS vector_only, round(avg(CASE WHEN k AND NOT v THEN 1.0 ELSE 0.0 END), 6) AS keyword_only, round(avg(CASE WHEN v AND k THEN 1.0 ELSE 0.0 END), 6) AS both_, count(*) FILTER (WHERE NOT v AND NOT k) AS gained FROM f GROUP BY 1""")
def source_contribution(t):
    """Shares of the final ten that either list had alone or both had, and what only fusion brought."""
    f = ranked(t).filter("after <= 10").select("user_id", (F.col("before") <= 10).alias("v"), F.col("event_type").isin("click", "view").alias("k"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return f.groupBy("user_id").agg(share(F.col("v") & ~F.col("k")).alias("vector_only"), share(F.col("k") & ~F.col("v")).alias("keyword_only"), share(F.col("v") & F.col("k")).alias("both_"), F.count_if(~F.col("v") & ~F.col("k")).alias("gained"))


@query("""WITH a AS (SELECT user_id, avg(value) AS s FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS s FROM events WHERE event_type = 'click' GROUP BY 1), d AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.s, 0) - coalesce(a.s, 0) AS delta FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT user_id, round(delta, 6) AS delta, delta < -1 AS regression, delta > 1 AS improvement FROM d""")
def run_comparison(t):
    """Two runs by question, whichever has it; a missing score is 0."""
    of = lambda kind, name: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias(name))
    d = of("view", "a").join(of("click", "b"), "user_id", "full_outer").select("user_id", (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))
    return d.select("user_id", F.round("delta", 6).alias("delta"), (F.col("delta") < -1).alias("regression"), (F.col("delta") > 1).alias("improvement"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, count(DISTINCT user_id) AS users, round(100.0 * count(*) FILTER (WHERE value < 10) / count(*), 6) AS error_pct, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, arg_max(event_id, ts) AS sample FROM events GROUP BY 1""")
def error_groups(t):
    """Errors by class with the latest sample."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(100.0 * F.count_if(F.col("value") < 10) / F.count("*"), 6).alias("error_pct"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.max_by("event_id", "ts").alias("sample"))


@query("""SELECT coalesce(CAST(nullif(user_id, 3) AS VARCHAR), 'anonymous') AS who, count(*) AS calls, count(DISTINCT event_type) AS tools, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_pct FROM events GROUP BY 1 ORDER BY calls DESC, who LIMIT 10""")
def top_users(t):
    who = F.coalesce(F.nullif(F.col("user_id"), F.lit(3)).cast("string"), F.lit("anonymous"))
    return t.events.groupBy(who.alias("who")).agg(F.count("*").alias("calls"), F.count_distinct("event_type").alias("tools"), F.round(100.0 * F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_pct")).orderBy(F.desc("calls"), "who").limit(10)


# listings and their audits

@query("""SELECT l_suppkey AS entity, l_returnflag AS scope, count(*) AS lines, min(year(l_shipdate)) AS first, max(year(l_shipdate)) AS last FROM lineitem GROUP BY 1, 2""")
def entity_scope_counts(t):
    y = F.year("l_shipdate").cast("long")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("scope")).agg(F.count("*").alias("lines"), F.min(y).alias("first"), F.max(y).alias("last"))


@query("""WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS years, CAST(sum(n) AS BIGINT) AS lines, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS listed, count(*) FILTER (WHERE r = 0) AS without FROM y GROUP BY 1""")
def coverage_rollup(t):
    """Documents, lines and years of each body, and years without lines of a kind."""
    y = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return y.groupBy("l_suppkey").agg(F.count("*").alias("years"), F.sum("n").alias("lines"), F.array_join(F.array_sort(F.collect_set("y")).cast("array<string>"), ",").alias("listed"), F.count_if(F.col("r") == 0).alias("without"))


@query("""WITH y AS (SELECT DISTINCT s_suppkey, y FROM supplier, (SELECT DISTINCT year(o_orderdate) AS y FROM orders)), l AS (SELECT DISTINCT l_suppkey, year(l_shipdate) AS y FROM lineitem WHERE l_quantity > 49) SELECT s_suppkey, y FROM y WHERE NOT EXISTS (SELECT 1 FROM l WHERE l_suppkey = s_suppkey AND l.y = y.y)""")
def coverage_gaps(t):
    """Years of the corpus in which a body has no large line."""
    years = sorted(r.y for r in t.orders.select(F.year("o_orderdate").alias("y")).distinct().collect())  # the corpus' years
    every = t.supplier.select("s_suppkey", F.explode(F.array(*[F.lit(y) for y in years])).alias("y"))
    there = t.lineitem.filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("y")).distinct()
    return every.join(there, ["s_suppkey", "y"], "left_anti").select("s_suppkey", F.col("y").cast("long").alias("y"))


@query("""WITH y AS (SELECT DISTINCT l_suppkey, year(l_shipdate) AS y FROM lineitem WHERE l_quantity > 45), i AS (SELECT l_suppkey, y, y - row_number() OVER (PARTITION BY l_suppkey ORDER BY y) AS g FROM y), r AS (SELECT l_suppkey, min(y) AS a, max(y) AS b FROM i GROUP BY l_suppkey, g)
SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS years FROM r GROUP BY 1""")
def year_range_texts(t):
    """Years as ranges: 2018-2020, 2022."""
    runs = islands(t.lineitem.filter("l_quantity > 45").select("l_suppkey", F.year("l_shipdate").alias("y")), ["l_suppkey"], "y")
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    return runs.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("x")))), lambda r: r["x"]), ", ").alias("years"))


@query("""SELECT l_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands, string_agg(l_partkey || ':' || CAST(l_quantity AS INT), ',' ORDER BY l_quantity DESC, l_partkey DESC) AS sized FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def array_aggregates(t):
    """Distinct names of each group, and ids beside their sizes, largest first."""
    pair = F.struct(F.col("l_quantity"), F.col("l_partkey"))
    shown = lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_quantity"].cast("int").cast("string"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.array_join(F.transform(F.sort_array(F.collect_list(pair), asc=False), shown), ",").alias("sized"))


@query("""SELECT round((SELECT count(DISTINCT l_orderkey) FROM lineitem) * 1.0 / (SELECT count(*) FROM orders), 6) AS ratio, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing, (SELECT count(*) FROM lineitem) AS lines""")
def subquery_ratio(t):
    """Distinct mentions over all rows, in one row."""
    n = t.orders.agg(F.count("*").alias("orders"))
    m = t.lineitem.agg(F.count_distinct("l_orderkey").alias("held"), F.count("*").alias("lines"))
    missing = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("missing"))
    one = n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").join(missing.withColumn("k", F.lit(1)), "k")
    return one.select(F.round(F.col("held") / F.col("orders"), 6).alias("ratio"), "missing", "lines")


@query("""SELECT 'documents' AS check_, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 1000 THEN 'small' WHEN length(text) < 10000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY 2
UNION ALL SELECT 'orders', CAST(year(o_orderdate) AS VARCHAR), count(*), min(o_orderkey), max(o_orderkey) FROM orders GROUP BY 2
UNION ALL SELECT 'items', CAST(n AS VARCHAR), count(*), min(n), max(n) FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 2""")
def validation_suite(t):
    """Sizes, dates and items per meeting, in one table."""
    n = F.length("text")
    sizes = t.documents.groupBy(F.when(n == 0, "empty").when(n < 1000, "small").when(n < 10000, "medium").otherwise("large").alias("bucket")).agg(F.count("*").alias("n"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"))
    dates = t.orders.groupBy(F.year("o_orderdate").cast("string").alias("bucket")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))
    items = t.lineitem.groupBy("l_orderkey").count().groupBy(F.col("count").cast("string").alias("bucket")).agg(F.count("*").alias("n"), F.min("count").alias("least"), F.max("count").alias("most"))
    named = lambda df, name: df.select(F.lit(name).alias("check_"), "bucket", "n", "least", "most")
    return named(sizes, "documents").unionByName(named(dates, "orders")).unionByName(named(items, "items"))


@query("""WITH m AS (SELECT avg(CASE WHEN length(text) >= 50 THEN 1.0 ELSE 0.0 END) AS long, avg(CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END) AS named, avg(length(text)) AS size FROM conversations)
SELECT round(long, 6) AS long, round(named, 6) AS named, round(size, 6) AS size, CASE WHEN long >= 0.9 AND named >= 0.4 THEN 'APPROVE' WHEN long < 0.5 THEN 'REJECT' ELSE 'PENDING' END AS verdict, ['green', 'yellow', 'red'][greatest(CASE WHEN long >= 0.9 THEN 1 WHEN long >= 0.5 THEN 2 ELSE 3 END, CASE WHEN named IS NULL THEN 2 WHEN named >= 0.5 THEN 1 ELSE 3 END)] AS status FROM m""")
def verdict_rollup(t):
    """A verdict by thresholds, and the worst status of the checks."""
    m = t.conversations.agg(F.avg(F.when(F.length("text") >= 50, 1.0).otherwise(0.0)).alias("long"), F.avg(F.when(F.col("role") == "assistant", 1.0).otherwise(0.0)).alias("named"), F.avg(F.length("text")).alias("size"))
    long, named = F.col("long"), F.col("named")
    worst = F.greatest(F.when(long >= 0.9, 0).when(long >= 0.5, 1).otherwise(2), F.when(named.isNull(), 1).when(named >= 0.5, 0).otherwise(2))
    verdict = F.when((long >= 0.9) & (named >= 0.4), "APPROVE").when(long < 0.5, "REJECT").otherwise("PENDING")
    return m.select(F.round(long, 6).alias("long"), F.round(named, 6).alias("named"), F.round("size", 6).alias("size"), verdict.alias("verdict"), F.get(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), worst).alias("status"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS person, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS role, CAST(o_orderdate AS DATE) AS van, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 50 = 1 THEN -5 ELSE 60 END END AS tot FROM orders),
x AS (SELECT id, person, role, van, coalesce(tot, DATE '2002-01-01') AS tot FROM r), days AS (SELECT DISTINCT person, role, id, unnest(generate_series(van, tot - 1, INTERVAL 1 DAY))::DATE AS day FROM x WHERE tot > van),
busy AS (SELECT person, day, count(*) AS n, count(DISTINCT role) AS roles FROM days GROUP BY 1, 2 HAVING count(*) > 1), runs AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY person ORDER BY day) AS INTEGER) AS run FROM busy)
SELECT person, 'overlap' AS kind, NULL AS role, CAST(min(day) AS VARCHAR) AS van, CAST(max(day) AS VARCHAR) AS tot, CAST(max(n) AS BIGINT) AS n, bool_or(roles > 1) AS mixed FROM runs GROUP BY person, run HAVING count(*) > 1
UNION ALL SELECT person, 'invalid_dates', role, CAST(van AS VARCHAR), CAST(tot AS VARCHAR), 1, false FROM r WHERE van > tot
UNION ALL SELECT person, 'duplicate', role, CAST(van AS VARCHAR), NULL, count(*), false FROM r GROUP BY person, role, van HAVING count(*) > 1""")
def role_overlaps(t):
    """What is inconsistent in the register: stretches of more than a day in which a person holds several roles (how many at once, and whether of several
    kinds), roles that end before they begin, roles that stand there twice. An open end is a given day. A sweep over begins and ends: roles don't meet in pairs."""
    van = F.to_date("o_orderdate")
    role = F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus"))
    length = F.when(F.col("o_orderkey") % 50 == 1, -5).otherwise(60)
    r = t.orders.select(F.col("o_custkey").alias("person"), role.alias("role"), van.alias("van"), F.when(F.col("o_orderstatus") != "P", F.date_add(van, length)).alias("tot"))
    x = r.withColumn("tot", F.coalesce("tot", F.lit("2002-01-01").cast("date"))).filter("tot > van")
    steps = x.select("person", "role", F.col("van").alias("day"), F.lit(1).alias("step")).unionByName(x.select("person", "role", F.col("tot").alias("day"), F.lit(-1).alias("step")))
    own, person = Window.partitionBy("person", "role").orderBy("day"), Window.partitionBy("person").orderBy("day")
    each = steps.groupBy("person", "role", "day").agg(F.sum("step").alias("step")).withColumn("held", F.sum("step").over(own))
    kinds = each.withColumn("was", F.coalesce(F.lag("held").over(own), F.lit(0))).withColumn("more", (F.col("held") > 0).cast("int") - (F.col("was") > 0).cast("int"))
    state = kinds.groupBy("person", "day").agg(F.sum("step").alias("step"), F.sum("more").alias("more"))
    state = state.select("person", "day", F.sum("step").over(person).alias("n"), F.sum("more").over(person).alias("roles"), F.lead("day").over(person).alias("next")).filter("n > 1 and next > day")
    fresh = F.when(F.lag("next").over(person) == F.col("day"), 0).otherwise(1)
    runs = state.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(person))
    last = F.date_sub(F.max("next"), 1)
    busy = runs.groupBy("person", "run").agg(F.min("day").alias("van"), last.alias("tot"), F.max("n").alias("n"), F.bool_or(F.col("roles") > 1).alias("mixed")).filter("tot > van")
    text, none = (lambda c: F.col(c).cast("string").alias(c)), F.lit(None).cast("string")
    row = lambda df, kind, role, tot, n, mixed: df.select("person", F.lit(kind).alias("kind"), role.alias("role"), text("van"), tot.alias("tot"), n.cast("long").alias("n"), mixed.alias("mixed"))
    wrong = row(r.filter("van > tot"), "invalid_dates", F.col("role"), text("tot"), F.lit(1), F.lit(False))
    twice = row(r.groupBy("person", "role", "van").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate", F.col("role"), none, F.col("n"), F.lit(False))
    return row(busy, "overlap", none, text("tot"), F.col("n"), F.col("mixed")).unionByName(wrong).unionByName(twice)


@query("""WITH s AS (SELECT l_orderkey, count(*) AS stored FROM lineitem GROUP BY 1), v AS (SELECT l_orderkey, count(*) AS indexed FROM lineitem WHERE l_quantity > 3 GROUP BY 1), c AS (SELECT o_orderkey, coalesce(stored, 0) AS stored, coalesce(indexed, 0) AS indexed FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN v ON v.l_orderkey = o_orderkey)
SELECT o_orderkey, stored, indexed, round(coalesce((stored - indexed) * 1.0 / nullif(stored, 0), 0), 6) AS gap, coalesce((stored - indexed) * 1.0 / nullif(stored, 0), 0) > 0.05 AS flagged FROM c""")
def count_reconciliation(t):
    """Stored against indexed chunks of each meeting; a gap over 5 % is flagged."""
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("stored"), F.count_if(F.col("l_quantity") > 3).alias("indexed"))
    rows = t.orders.select("o_orderkey").join(c, "o_orderkey", "left").fillna(0, ["stored", "indexed"])
    gap = F.coalesce((F.col("stored") - F.col("indexed")) / F.nullif(F.col("stored"), F.lit(0)), F.lit(0.0))
    return rows.select("o_orderkey", "stored", "indexed", F.round(gap, 6).alias("gap"), (gap > 0.05).alias("flagged"))


@query("""WITH staged AS (SELECT conv_id AS id, max(turn) AS turns, arg_max(role, turn) AS last_role, md5(string_agg(text, chr(10) ORDER BY turn)) AS hash FROM conversations GROUP BY 1), published AS (SELECT doc_id AS id, n_chars % 8 AS turns, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'de' THEN 'user' ELSE 'assistant' END AS last_role, md5(text) AS hash FROM documents)
SELECT coalesce(s.id, p.id) AS id, CASE WHEN p.id IS NULL THEN 'unpublished' WHEN s.id IS NULL THEN 'unstaged' WHEN s.turns = p.turns AND s.last_role IS NOT DISTINCT FROM p.last_role THEN 'same' ELSE 'differs' END AS state,
s.turns IS NOT DISTINCT FROM p.turns AS turns_same, s.last_role IS NOT DISTINCT FROM p.last_role AS role_same, s.hash IS NOT DISTINCT FROM p.hash AS text_same FROM staged s FULL JOIN published p ON s.id = p.id""")
def metadata_consistency(t):
    """Fields of staged rows (conversations) against published ones (documents) of the same number, nulls being equal; either may lack the other."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))  # the turns of one conversation
    staged = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.md5(F.array_join(F.transform(turns, lambda x: x["text"]), "\n")).alias("hash"), F.lit(1).alias("there"))
    role = F.when(F.col("lang") == "de", "user").when(F.coalesce(F.col("lang") != "en", F.lit(True)), "assistant")
    published = t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 8).alias("turns"), role.alias("last_role"), F.md5("text").alias("hash"), F.lit(1).alias("there"))
    s, p = staged.alias("s"), published.alias("p")
    same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}"))
    state = F.when(F.col("p.there").isNull(), "unpublished").when(F.col("s.there").isNull(), "unstaged").when(same("turns") & same("last_role"), "same").otherwise("differs")
    both = s.join(p, F.col("s.id") == F.col("p.id"), "full_outer")
    return both.select(F.coalesce("s.id", "p.id").alias("id"), state.alias("state"), same("turns").alias("turns_same"), same("last_role").alias("role_same"), same("hash").alias("text_same"))


@query("""SELECT o_custkey % 97 AS meeting, count(*) AS points, round(avg(CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_name, round(avg(CASE WHEN o_totalprice < 100000 THEN 1.0 ELSE 0.0 END), 6) AS small FROM orders GROUP BY 1""")
def index_quality(t):
    """How complete the payload of each meeting's points is."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return t.orders.groupBy((F.col("o_custkey") % 97).alias("meeting")).agg(F.count("*").alias("points"), rate(F.col("o_orderpriority") == "5-LOW").alias("no_name"), rate(F.col("o_totalprice") < 100000).alias("small"))


@query("""WITH f AS (SELECT l_orderkey, l_linestatus, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2, 3) SELECT l_linestatus AS kind, l_returnflag AS item, CAST(sum(n) AS BIGINT) AS failures, count(DISTINCT l_orderkey) AS documents FROM f GROUP BY 1, 2""")
def failure_summary(t):
    return t.lineitem.filter("l_quantity < 10").groupBy(F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("item")).agg(F.count("*").alias("failures"), F.count_distinct("l_orderkey").alias("documents"))


@query("""SELECT doc_id, CASE WHEN length(text) < 2000 THEN 1 WHEN length(text) < 10000 THEN 2 ELSE 3 END AS priority FROM documents d WHERE length(text) >= 50 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def work_queue(t):
    """Documents that aren't processed yet, short ones first."""
    n = F.length("text")
    return t.documents.filter(n >= 50).join(t.labels, "doc_id", "left_anti").select("doc_id", F.when(n < 2000, 1).when(n < 10000, 2).otherwise(3).alias("priority"))


@query("SELECT DISTINCT source FROM documents WHERE length(text) > 10000")
def oversized_sources(t):
    return t.documents.filter(F.length("text") > 10000).select("source").distinct()


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey) AS m, row_number() OVER (PARTITION BY l_partkey, nullif(l_returnflag, 'N') ORDER BY l_orderkey, l_linenumber, l_quantity, l_suppkey) rn FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE rn = 1""")
def assignment_dedup(t):
    """The first assignment of each document and item; missing items are equal."""
    return distinct_on(t.lineitem.withColumn("f", F.nullif(F.col("l_returnflag"), F.lit("N"))), ["l_partkey", "f"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, p_name, p_size FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY CASE WHEN p_name = lower(p_name) AND p_type = 'ECONOMY' THEN 0 WHEN p_type = 'PROMO' THEN 1 ELSE 2 END, p_partkey) rn FROM part) WHERE rn = 1""")
def survivor_selection(t):
    """Of entities of one name, the one of canonical form and type first."""
    rank = F.when((F.col("p_name") == F.lower("p_name")) & (F.col("p_type") == "ECONOMY"), 0).when(F.col("p_type") == "PROMO", 1).otherwise(2)
    return distinct_on(t.part.withColumn("k", F.lower("p_name")), ["k"], [rank, F.col("p_partkey")]).select("p_partkey", "p_name", "p_size")


@query("""WITH c AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) + CASE WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 0 END AS score FROM orders), g AS (SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_custkey, date_trunc('quarter', d) ORDER BY score DESC, o_orderkey) AS survivor FROM c)
SELECT o_orderkey, survivor, score FROM g""")
def meeting_dedup(t):
    """Meetings of one group with the one that stays: most items, with a bonus for a committee. The items follow it."""
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    score = F.coalesce("n", F.lit(0)) + F.when(F.col("o_orderpriority") == "1-URGENT", 5).otherwise(0)
    rows = t.orders.join(items, "o_orderkey", "left").withColumn("score", score).withColumn("quarter", F.date_trunc("quarter", "o_orderdate"))
    group = Window.partitionBy("o_custkey", "quarter").orderBy(F.desc("score"), "o_orderkey")
    return rows.select("o_orderkey", F.first("o_orderkey").over(group).alias("survivor"), "score")


@query("""SELECT e.user_id, count(*) AS n, string_agg(e.event_type, ',' ORDER BY e.event_type) AS kinds FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2 HAVING count(*) >= 5) e GROUP BY 1""")
def gazetteer_build(t):
    """Names with five mentions or more, by kind."""
    e = t.events.groupBy("user_id", "event_type").count().filter("count >= 5")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("kinds"))


@query("""WITH m AS (SELECT c_custkey, lower(c_mktsegment) AS t1, c_nationkey FROM customer), k AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS ws FROM documents)
SELECT doc_id, len(list_intersect(ws, ['the', 'of'])) AS hits, CASE WHEN len(list_intersect(ws, ['the', 'of'])) = 2 THEN 'verified' WHEN len(list_intersect(ws, ['the', 'of', 'and', 'la'])) >= 2 THEN 'partial' ELSE 'unverified' END AS claim FROM k""")
def claim_verification(t):
    """Whether a claim's terms stand in a document: all of them, else two of the wider list."""
    from plenum.functions.text import word_set

    hits = lambda ws: F.size(F.array_intersect(word_set(F.col("text")), F.array(*[F.lit(w) for w in ws])))
    return t.documents.select("doc_id", hits(["the", "of"]).alias("hits"), F.when(hits(["the", "of"]) == 2, "verified").when(hits(["the", "of", "and", "la"]) >= 2, "partial").otherwise("unverified").alias("claim"))


@query("""WITH r AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type <> 'view') = 0 THEN NULL ELSE count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*) FILTER (WHERE event_type <> 'view') END AS rate FROM events GROUP BY 1)
SELECT user_id, round(rate, 6) AS rate, coalesce(rate <= 0.1, true) AS safe FROM r""")
def hallucination_summary(t):
    """Answers are safe up to a rate of 0.1; one that couldn't be judged counts as safe."""
    rate = F.count_if(F.col("event_type") == "error") / F.nullif(F.count_if(F.col("event_type") != "view"), F.lit(0))
    r = t.events.groupBy("user_id").agg(rate.alias("rate"))
    return r.select("user_id", F.round("rate", 6).alias("rate"), F.coalesce(F.col("rate") <= 0.1, F.lit(True)).alias("safe"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE length(text) > 100) SELECT source, doc_id FROM c WHERE i % greatest(n // 10, 1) = 0 AND i // greatest(n // 10, 1) < 10""")
def representative_sample(t):
    """Ten evenly spaced documents of each source: a sampling operator."""
    by = Window.partitionBy("source")
    rows = t.documents.filter(F.length("text") > 100).select("source", "doc_id")
    c = rows.withColumn("i", F.row_number().over(by.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(by)).withColumn("step", F.greatest(F.floor(F.col("n") / 10), F.lit(1)))
    return c.filter("i % step = 0 and floor(i / step) < 10").select("source", "doc_id")


@query("SELECT max(CAST(l_shipdate AS DATE))::VARCHAR AS newest, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS of_ FROM lineitem")
def last_watermark(t):
    """How far ingestion has come, by its latest run."""
    return t.lineitem.agg(F.max(F.to_date("l_shipdate")).cast("string").alias("newest"), F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("of_"))


@query("SELECT DISTINCT regexp_replace(o_orderpriority, '^[0-9]-', '') AS committee FROM orders WHERE trim(o_orderpriority) <> ''")
def distinct_committees(t):
    return t.orders.filter(F.trim("o_orderpriority") != "").select(F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("committee")).distinct()


@query("""SELECT l.l_orderkey, l.l_linenumber, coalesce(CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE l.l_suppkey END, b.m) AS meeting, CASE WHEN l.l_linestatus = 'O' AND b.m IS NOT NULL THEN 'bijlage' ELSE l.l_linestatus END AS class FROM lineitem l LEFT JOIN (SELECT o_orderkey, min(o_custkey) AS m FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1) b ON b.o_orderkey = l.l_orderkey""")
def filled_links(t):
    """Missing links filled through a bridge, and a default class where the bridge has a row of given years."""
    b = t.orders.filter(F.year("o_orderdate").between(1996, 1999)).groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.min("o_custkey").alias("m"))
    own = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))
    return t.lineitem.join(b, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce(own, "m").alias("meeting"), F.when((F.col("l_linestatus") == "O") & F.col("m").isNotNull(), "bijlage").otherwise(F.col("l_linestatus")).alias("class"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def cascaded_delete(t):
    """What is left of the dependents once finished meetings and those of oversized lines are deleted."""
    gone = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey").union(t.lineitem.filter("l_quantity > 49").select("l_orderkey"))
    return t.orders.select("o_orderkey").join(gone, "o_orderkey", "left_anti")
