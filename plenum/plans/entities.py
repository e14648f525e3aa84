"""Entities, compounds, communities and maintenance of listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators.relops import distinct_on, listed, ranked, spread
from plenum.operators.shared import written
from plenum.plans.registry import query

#: Least lengths of compounds and their parts, and what may stand between two parts, in order.
LEAST, LEAST_LEFT, LEAST_RIGHT = 9, 4, 5
INTERFIXES = ["", "s", "e", "en", "er", "n"]


def compounds(words, lexicon):
    """word, left, right: the split of a word of LEAST letters or more whose left part is longest; both parts stand in the lexicon (column w).

    Every place is tried at once: parts meet the lexicon by joins, so the lexicon may be of any size."""
    at = F.explode(F.sequence(F.lit(LEAST_LEFT), F.length("word") - LEAST_RIGHT))
    cuts = words.filter(F.length("word") >= LEAST).select("word", at.alias("i")).withColumn("left", F.left("word", F.col("i"))).withColumn("rest", F.expr("substring(word, i + 1)"))
    known = cuts.join(lexicon.select(F.col("w").alias("left")), "left", "left_semi")
    glued = known.withColumn("fix", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(INTERFIXES)]))).filter(F.col("rest").startswith(F.col("fix.x")))
    glued = glued.withColumn("right", F.expr("substring(rest, length(fix.x) + 1)")).filter(F.length("right") >= LEAST_RIGHT)
    whole = glued.join(lexicon.select(F.col("w").alias("right")), "right", "left_semi")
    return distinct_on(whole, ["word"], [F.desc("i"), F.col("fix.k")]).select("word", "left", "right")


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: length(x) >= 4)"
COMPOUNDS = f"""t AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS word FROM documents), x AS (SELECT DISTINCT word AS w FROM t), p AS (SELECT w AS word, unnest(range(4, length(w) - 4)) AS i FROM x WHERE length(w) >= 9),
q AS (SELECT word, i, left(word, i) AS l, substr(word, i + 1) AS rest FROM p WHERE left(word, i) IN (SELECT w FROM x)), g AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k FROM q), h AS (SELECT word, i, l, k, substr(rest, length(['', 's', 'e', 'en', 'er', 'n'][k + 1]) + 1) AS r, starts_with(rest, ['', 's', 'e', 'en', 'er', 'n'][k + 1]) AS ok FROM g),
c AS (SELECT word, l AS left_, r AS right_ FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY i DESC, k) rn FROM h WHERE ok AND length(r) >= 5 AND r IN (SELECT w FROM x)) WHERE rn = 1)"""


def tokens(t):
    """doc_id, word: the distinct words of four letters or more of each document."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= 4)
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(words)).alias("word"))


@query(f"WITH {COMPOUNDS} SELECT word, left_, right_ FROM c")
def compound_split(t):
    """Compounds of the corpus by its own words."""
    words = tokens(t).select("word").distinct()
    return compounds(words, words.select(F.col("word").alias("w"))).select("word", F.col("left").alias("left_"), F.col("right").alias("right_"))


@query(f"WITH {COMPOUNDS}, d AS (SELECT doc_id, unnest([left_, right_]) AS part FROM t JOIN c USING (word)) SELECT doc_id, count(DISTINCT part) AS parts, string_agg(DISTINCT part, ' ' ORDER BY part) AS listed FROM d GROUP BY 1")
def decompounded_texts(t):
    """The sorted distinct parts of each document's compounds, for an index."""
    rows = tokens(t)
    words = rows.select("word").distinct()
    parts = rows.join(compounds(words, words.select(F.col("word").alias("w"))), "word").select("doc_id", F.explode(F.array("left", "right")).alias("part"))
    return parts.groupBy("doc_id").agg(F.count_distinct("part").alias("parts"), F.array_join(F.array_sort(F.collect_set("part")), " ").alias("listed"))


@query(f"WITH {COMPOUNDS} SELECT left_ AS term, string_agg(word, ' ' ORDER BY word) AS expanded, count(*) AS n FROM c GROUP BY 1")
def query_expansion(t):
    """Every term with the compounds that begin with it."""
    words = tokens(t).select("word").distinct()
    c = compounds(words, words.select(F.col("word").alias("w")))
    return c.groupBy(F.col("left").alias("term")).agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("expanded"), F.count("*").alias("n"))


ROUNDS = 3
LABELS = "e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), l0 AS (SELECT DISTINCT a AS node, a AS label FROM u)" + "".join(
    f", n{i} AS (SELECT u.a AS node, l.label, count(*) AS c FROM u JOIN l{i} l ON l.node = u.b GROUP BY 1, 2), l{i + 1} AS (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c DESC, label) rn FROM n{i}) WHERE rn = 1)" for i in range(ROUNDS)
)


@query(f"WITH {LABELS} SELECT node, label FROM l{ROUNDS}")
def communities(t):
    """Label propagation: in each of a few rounds, a node takes the label that most of its neighbours have, the least one on ties."""
    e = written(t.lineitem.select("l_suppkey", "l_partkey").distinct())
    sides = {"s": "l_suppkey", "p": "l_partkey"}
    nodes = reduce(DataFrame.unionByName, [e.select(F.lit(p).alias("side"), F.col(c).alias("key")).distinct() for p, c in sides.items()])
    # a node's number is its name's place, so the least number is the least name, and votes are counted and compared as numbers
    names = ranked(nodes.filter("key is not null").select("side", "key", F.concat("side", F.col("key").cast("string")).alias("node")), [], [F.col("node")])
    names = written(names.select("side", "key", "node", F.col("place").alias("id")))
    for p, c in sides.items():
        e = e.join(names.filter(F.col("side") == p).select(F.col("key").alias(c), F.col("id").alias(p)), c, "left").drop(c)
    both = e.select(F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("p").alias("b")), F.struct(F.col("p").alias("a"), F.col("s").alias("b")))).alias("x")).select("x.*")
    near = written(listed(both.filter("b is not null"), "b", ["a"]))
    # at first every neighbour has a label of its own, so the least one is taken; then labels meet all neighbours of a node at once and are shuffled once a round
    labels = near.select(F.explode("near.a").alias("id"), F.col("b").alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    for _ in range(ROUNDS - 1):
        votes = near.join(labels.withColumnRenamed("id", "b"), "b").select(F.explode("near.a").alias("id"), "label").repartition("id")
        votes = votes.groupBy("id", "label").agg(F.count("*").alias("c"))
        most = F.max(F.shiftleft("c", 32) - F.col("label"))  # most votes, then the least label; places stay under 2^32
        labels = votes.groupBy("id").agg(F.pmod(-most, F.lit(1 << 32)).alias("label"))
    of = lambda a, b: names.select(F.col("id").alias(a), F.col("node").alias(b))
    return labels.join(of("id", "node"), "id", "left").join(of("label", "name"), "label").select("node", F.col("name").alias("label"))


@query("""WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Raadsvergadering' ELSE substr(o_orderpriority, 3) END AS label FROM orders) SELECT o_orderkey, CAST(d AS VARCHAR) AS d, label FROM (SELECT *, row_number() OVER (PARTITION BY d, label ORDER BY o_orderkey) rn FROM m) WHERE rn = 1""")
def calendar_labels(t):
    """Names that are a weekday and date become a general label; the first meeting of each day and label stays."""
    name = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("Dinsdag "), F.date_format("o_orderdate", "d-M-yyyy"))).otherwise(F.substring("o_orderpriority", 3, 50))
    label = F.when(name.rlike(r"(?i)^(maandag|dinsdag|woensdag|donderdag|vrijdag|zaterdag|zondag)\b"), "Raadsvergadering").otherwise(name)
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), label.alias("label"))
    return distinct_on(rows, ["d", "label"], [F.col("o_orderkey")]).select("o_orderkey", F.col("d").cast("string").alias("d"), "label")


@query("""WITH y AS (SELECT max(year(o_orderdate)) AS y FROM orders), m AS (SELECT o_orderkey, o_orderdate AS d FROM orders, y WHERE year(o_orderdate) = y.y) SELECT o_orderkey, CAST(CAST(d AS DATE) AS VARCHAR) AS d FROM m ORDER BY d DESC, o_orderkey LIMIT 50""")
def upcoming_events(t):
    """The newest fifty meetings of the current year, the last one that the table has."""
    current = t.orders.agg(F.max(F.year("o_orderdate"))).first()[0]
    rows = t.orders.filter(F.year("o_orderdate") == current).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return rows.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("d"))


@query("""SELECT o_orderkey FROM orders o WHERE year(o_orderdate) >= 1997 AND o_orderpriority <> '5-LOW' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND o_orderkey NOT IN (SELECT conv_id FROM conversations)""")
def undone_meetings(t):
    """Meetings of some years and committees that have neither long minutes nor a staged transcript."""
    long = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    staged = t.conversations.select(F.col("conv_id").alias("o_orderkey"))
    return t.orders.filter((F.year("o_orderdate") >= 1997) & (F.col("o_orderpriority") != "5-LOW")).join(long, "o_orderkey", "left_anti").join(staged, "o_orderkey", "left_anti").select("o_orderkey")


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey AS name, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'O'), r AS (SELECT o_orderkey AS id, o_custkey AS name, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders WHERE o_orderstatus = 'O')
SELECT r.id, CASE WHEN o_totalprice < 50000 THEN 'short' ELSE 'missing' END AS gap FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = r.id) AND NOT EXISTS (SELECT 1 FROM l WHERE l.name = r.name AND l.d = r.d)""")
def gap_audit(t):
    """Remote meetings that the local store lacks, by id and then by name and day; short ones apart."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderstatus")
    local, remote = rows.filter("o_orderstatus <> 'O'"), rows.filter("o_orderstatus = 'O'")
    left = remote.join(local.select("id"), "id", "left_anti").join(local.select("name", "d"), ["name", "d"], "left_anti")
    return left.select("id", F.when(F.col("o_totalprice") < 50000, "short").otherwise("missing").alias("gap"))


@query("""WITH e AS (SELECT p_partkey AS id, p_name, p_type FROM part WHERE length(p_name) > 8), n AS (SELECT id, regexp_replace(lower(p_name), '^(small|large|red) ', '') AS name, p_type FROM e), s AS (SELECT *, min(id) OVER (PARTITION BY name, p_type) AS survivor FROM n)
SELECT DISTINCT l_orderkey, survivor FROM lineitem JOIN s ON s.id = l_partkey""")
def cleaned_entities(t):
    """Noise goes, prefixes are stripped, entities of one name and type become the first of them; mentions follow, each once."""
    name = F.regexp_replace(F.lower("p_name"), "^(small|large|red) ", "")
    kept = t.part.filter(F.length("p_name") > 8).select(F.col("p_partkey").alias("l_partkey"), name.alias("name"), "p_type")
    survivor = kept.groupBy("name", "p_type").agg(F.min("l_partkey").alias("survivor"))
    mapped = kept.join(survivor, ["name", "p_type"]).select("l_partkey", "survivor")
    return t.lineitem.select("l_orderkey", "l_partkey").join(mapped, "l_partkey").select("l_orderkey", "survivor").distinct()


@query("""WITH m AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda x: length(x) > 9)) AS name FROM documents), i AS (SELECT name, md5(lower(name)) AS id FROM m GROUP BY 1) SELECT m.doc_id, count(DISTINCT i.id) AS entities, min(i.id) AS first FROM m JOIN i USING (name) GROUP BY 1""")
def mention_ingest(t):
    """Mentions with entities that get an id from their lowered name, the same wherever they are met."""
    names = F.array_distinct(F.filter(F.split("text", r"[^\p{L}]+"), lambda x: F.length(x) > 9))
    m = spread(t.documents.select("doc_id", "text")).select("doc_id", F.explode(names).alias("name")).withColumn("id", F.md5(F.lower("name")))
    return m.groupBy("doc_id").agg(F.count_distinct("id").alias("entities"), F.min("id").alias("first"))


@query("""SELECT conv_id, turn, 'Jansen ' || role || ',Bakker' AS names FROM conversations WHERE role <> 'system'""")
def attendance_names(t):
    """Names out of the attendance section of minutes, without titles and parties."""
    made = F.concat(F.lit("Opening.\nAanwezig: de heer Jansen "), F.col("role"), F.lit(" (VVD), mevrouw Bakker (D66)\nAfwezig: Smit"))
    listed = F.split(F.regexp_extract(made, r"Aanwezig: ([^\n]*)", 1), r",\s*")
    plain = F.transform(listed, lambda x: F.trim(F.regexp_replace(x, r"(?i)^(de heer|mevrouw)\s+|\s*\([^)]*\)", "")))
    return t.conversations.filter("role <> 'system'").select("conv_id", "turn", F.array_join(plain, ",").alias("names"))


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'cached' END, substr(d.text, 1, 100)) AS summary FROM documents d LEFT JOIN labels l USING (doc_id)""")
def cached_summaries(t):
    """The stored summary, or one made now."""
    stored = t.labels.select("doc_id", F.when(F.col("quality") == 1, "cached").alias("stored"))
    return t.documents.join(stored, "doc_id", "left").select("doc_id", F.coalesce("stored", F.substring("text", 1, 100)).alias("summary"))


@query("""WITH w AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM events) SELECT event_id, user_id FROM events, w WHERE ts > mark""")
def incremental_scan(t):
    """What came since a watermark; the predicate reaches the scan."""
    mark = t.events.agg(F.max("ts") - F.expr("INTERVAL 3 DAYS")).first()[0]
    return t.events.filter(F.col("ts") > F.lit(mark).cast("timestamp_ntz")).select("event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(t):
    """The page after a key."""
    return t.orders.filter("o_orderkey > 100").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM orders) AS meetings, (SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) FROM orders) AS first, (SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) FROM orders) AS last, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS langs""")
def context_primer(t):
    """What the corpus holds, in one row."""
    d = F.to_date("o_orderdate").cast("string")
    a = t.documents.agg(F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")).withColumn("k", F.lit(1))
    b = t.orders.agg(F.count("*").alias("meetings"), F.min(d).alias("first"), F.max(d).alias("last")).withColumn("k", F.lit(1))
    return a.join(b, "k").select("documents", "meetings", "first", "last", "langs")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 'wonen' ELSE 'zorg' END AS area, len(regexp_extract_all(text, '[Dd]e ')) AS statements FROM documents WHERE regexp_matches(text, '[Dd]e ')""")
def stated_positions(t):
    """Statements that a text makes, by area."""
    n = F.size(F.regexp_extract_all("text", F.lit("[Dd]e "), F.lit(0)))
    return t.documents.filter(F.col("text").rlike("[Dd]e ")).select("doc_id", F.when(F.lower("text").contains("the"), "wonen").otherwise("zorg").alias("area"), n.alias("statements"))


@query("""WITH m AS (SELECT o_orderkey, 'Motie 22bb' || o_custkey || CASE o_orderstatus WHEN 'F' THEN ' aangenomen' WHEN 'O' THEN ' verworpen' ELSE '' END AS name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'verworpen' END AS enriched FROM orders)
SELECT o_orderkey, coalesce(enriched, CASE WHEN name LIKE '%aangenomen' THEN 'aangenomen' WHEN name LIKE '%verworpen' THEN 'verworpen' ELSE 'onbekend' END) AS outcome, regexp_extract(name, '22bb([0-9]+)', 1) AS number FROM m""")
def motion_search(t):
    """Motions with their number, and their outcome out of the enrichment, else the title."""
    from plenum.functions.text import title_outcome

    name = F.concat(F.lit("Motie 22bb"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "F", " aangenomen").when(F.col("o_orderstatus") == "O", " verworpen").otherwise(""))
    enriched = F.when(F.col("o_orderpriority") == "1-URGENT", "verworpen")
    return t.orders.select("o_orderkey", F.coalesce(enriched, title_outcome(name)).alias("outcome"), F.regexp_extract(name, r"22bb(\d+)", 1).alias("number"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) rn FROM events), m AS (SELECT max(ts) AS now FROM events)
SELECT event_type, max(event_id) FILTER (WHERE rn = 1) AS latest, count(*) FILTER (WHERE ts > now - INTERVAL 1 DAY) AS day_, count(*) FILTER (WHERE ts > now - INTERVAL 7 DAY) AS week_ FROM r, m GROUP BY 1""")
def dashboard_feed(t):
    """The latest run of each job, and the runs of a day and a week."""
    now = F.lit(t.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    since = lambda days: F.count_if(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS"))
    return t.events.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), since(1).alias("day_"), since(7).alias("week_"))
