"""Meetings, agenda and assignments over orders, lineitem and part: an order is a meeting, a line an assignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators.intervals import as_of
from plenum.operators.relops import distinct_on, either_join, insert_missing, islands, merge_longest, nearest, not_in, quantiles
from plenum.plans.registry import query

money = lambda c: F.col(c).cast("decimal(18,2)")


@query("""
WITH agg AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS n_a,
  count(DISTINCT CASE WHEN l_returnflag IS NULL OR l_returnflag NOT IN ('A','R') THEN l_partkey END) AS n_other FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 0),
pre AS (SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY rn) AS preview FROM (SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) rn FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE rn <= 5 GROUP BY 1),
j AS (SELECT o_orderkey, o_custkey, o_orderdate, n_parts, n_a, n_other, preview FROM orders JOIN agg ON l_orderkey = o_orderkey LEFT JOIN pre ON pre.l_orderkey = o_orderkey)
SELECT o_orderkey, o_custkey, o_orderdate, n_parts, n_a, n_other, preview FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY n_parts DESC, o_orderkey) rk FROM j) WHERE rk = 1""")
def meeting_listing(t):
    """Meetings with filtered distinct counts, those with documents only, a preview of five items, richest of equal ones."""
    flag = F.col("l_returnflag")
    different = lambda test: F.size(F.collect_set(F.when(test, F.col("l_partkey")))).cast("bigint")
    first = F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), 1, 5)
    whole = t.lineitem.groupBy("l_orderkey").agg(
        different(F.lit(True)).alias("n_parts"), different(flag == "A").alias("n_a"), different(flag.isNull() | ~flag.isin("A", "R")).alias("n_other"), first.alias("five"),
    ).filter("n_parts > 0")
    named = whole.select("l_orderkey", "n_parts", "n_a", "n_other", F.posexplode_outer("five").alias("i", "x")).join(t.part.select("p_partkey", "p_name"), F.col("x.l_partkey") == F.col("p_partkey"), "left")
    shown = F.array_sort(F.collect_list(F.when(F.col("p_name").isNotNull(), F.struct("i", "p_name"))))
    counts = named.groupBy("l_orderkey", "n_parts", "n_a", "n_other").agg(F.nullif(F.array_join(F.transform(shown, lambda x: x["p_name"]), "; "), F.lit("")).alias("preview"))
    found = t.orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"))
    best = distinct_on(found, ["o_custkey", "o_orderdate"], [F.desc("n_parts"), F.col("o_orderkey")])
    return best.select("o_orderkey", "o_custkey", "o_orderdate", "n_parts", "n_a", "n_other", "preview")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1997 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10")
def meetings_page(t):
    """Newest meetings of a year, paged."""
    return t.orders.filter((F.col("o_orderdate") >= "1997-01-01") & (F.col("o_orderdate") < "1998-01-01")).orderBy(F.desc_nulls_first("o_orderdate"), "o_orderkey").offset(10).limit(50).select("o_orderkey", "o_orderdate")


@query("SELECT DISTINCT year(o_orderdate) AS y FROM orders")
def distinct_years(t):
    return t.orders.select(F.year("o_orderdate").alias("y")).distinct()


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def zero_inclusive_count(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_with_returns(t):
    return t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def not_in_null_aware(t):
    """NOT IN keeps its null semantics: a null in the list leaves nothing."""
    return not_in(t.part.select("p_partkey"), "p_partkey", t.lineitem.filter("l_quantity > 45"), "l_partkey")


@query("SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey OR c_custkey = s_suppkey")
def disjunctive_join(t):
    """Customers and suppliers that match by nation or by number: a union of two equi joins."""
    right = t.supplier.select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("s_key"))
    left = t.customer.withColumn("c_key", F.col("c_custkey"))
    return either_join(left, right, [("c_nationkey", "s_nationkey"), ("c_key", "s_key")], "c_custkey").select("c_custkey", "s_suppkey")


@query("""SELECT o_orderkey, l_linenumber AS first_line, l_partkey FROM orders LEFT JOIN LATERAL (SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber, l_partkey LIMIT 1) ON true""")
def lateral_first_line(t):
    first = distinct_on(t.lineitem, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])
    return t.orders.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.col("l_linenumber").alias("first_line"), "l_partkey")


@query("SELECT a.l_orderkey, count(*) AS n_pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' GROUP BY 1")
def self_join_pairs(t):
    """Pairs of two kinds that share a meeting: counts per side multiply, so the pairs themselves are never made."""
    kinds = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return kinds.select("l_orderkey", (F.col("a") * F.col("r")).alias("n_pairs")).filter("n_pairs > 0")


@query("""SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND (abs(date_diff('day', o.o_orderdate, l.l_shipdate)) <= 30 OR l.l_shipdate IS NULL) GROUP BY 1""")
def temporal_band_join(t):
    near = F.abs(F.datediff("l_shipdate", "o_orderdate")) <= 30
    return t.orders.join(t.lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & (near | F.col("l_shipdate").isNull())).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_id, ts AS van, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tot FROM events WHERE event_type = 'view'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view'),
c AS (SELECT e.event_id, s.event_id AS speaker FROM e JOIN s ON s.user_id = e.user_id AND s.van <= e.ts AND (s.tot IS NULL OR e.ts < s.tot)) SELECT e.event_id, c.speaker FROM e LEFT JOIN c USING (event_id)""")
def interval_containment_join(t):
    """Each event with the view of its user whose interval, up to the next view, holds its time; null before the first."""
    views = t.events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("speaker"), F.col("ts").alias("van"))
    e = t.events.filter("event_type <> 'view'").select("event_id", "user_id", "ts")
    return as_of(e, views, ["user_id"], "ts", "van", ["speaker"]).select("event_id", "speaker")


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT event_id AS pid, user_id, ts AS pts FROM events WHERE event_type = 'purchase'),
c AS (SELECT e.event_id, pid, abs(epoch(e.ts) - epoch(pts)) AS gap FROM e JOIN p USING (user_id) WHERE abs(epoch(e.ts) - epoch(pts)) <= 86400)
SELECT event_id, pid, round(gap, 3) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, pid) rn FROM c) WHERE rn = 1""")
def nearest_purchase(t):
    """As-of join: the purchase of the same user that is nearest to each error, within a day."""
    e = t.events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    p = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", F.col("ts").alias("pts"))
    return nearest(e, p, ["user_id"], "ts", "pts", 86400, "pid").select("event_id", "pid", F.round("gap", 3).alias("gap"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY ALL")
def group_by_count(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("total"))


@query("SELECT o_orderpriority, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS f_total, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1")
def filtered_sums(t):
    return t.orders.groupBy("o_orderpriority").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", money("o_totalprice"))), F.lit(0)).cast("double").alias("f_total"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(t):
    return t.orders.groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS p50, round(quantile_cont(o_totalprice, 0.9), 2) AS p90 FROM orders GROUP BY 1")
def percentiles(t):
    found = quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p90": 0.9})
    return found.select("o_orderpriority", F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"))


@query("""WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), g AS (SELECT o_custkey, y, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS k FROM y),
i AS (SELECT o_custkey, min(y) AS a, max(y) AS b FROM g GROUP BY o_custkey, k)
SELECT o_custkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS years FROM i GROUP BY 1""")
def year_ranges(t):
    """Gaps and islands: 2018-2020, 2022."""
    runs = islands(t.orders.select("o_custkey", F.year("o_orderdate").alias("y")), ["o_custkey"], "y")
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = F.array_sort(F.collect_list(F.struct("first", text.alias("text"))))
    return runs.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("years"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders_list, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3")
def ordered_string_agg(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders_list"), F.count("*").alias("n")).filter("n >= 3")


@query("SELECT o_orderpriority, round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 1) AS pct FROM orders GROUP BY 1")
def coverage_ratio(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 1).alias("pct"))


@query("""SELECT count(*) AS n_lines, count(*) FILTER (WHERE o_orderkey IS NULL) AS orphans, count(*) FILTER (WHERE l_shipdate IS NULL) AS undated,
CASE WHEN count(*) FILTER (WHERE o_orderkey IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def integrity_totals(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orphans = F.count_if(F.col("o_orderkey").isNull())
    return j.agg(F.count("*").alias("n_lines"), orphans.alias("orphans"), F.count_if(F.col("l_shipdate").isNull()).alias("undated"), F.when(orphans == 0, "PASS").otherwise("FAIL").alias("status"))


@query("SELECT l_orderkey, l_linenumber, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)")
def neighbours(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.lag("l_partkey").over(w).alias("before"), F.lead("l_partkey").over(w).alias("after"))


@query("SELECT doc_id, md5(text) AS hash, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents")
def duplicate_count_over(t):
    return t.documents.select("doc_id", F.md5("text").alias("hash")).withColumn("copies", F.count("*").over(Window.partitionBy("hash")))


@query("SELECT doc_id, source, n FROM (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id DESC) rn FROM documents) WHERE rn = 1")
def longest_document_wins(t):
    """Document dedup: the longest text of a (source, language) survives, the larger id on ties."""
    docs = t.documents.select("doc_id", "source", "lang", F.length("text").alias("n"))
    return distinct_on(docs, ["source", "lang"], [F.desc("n"), F.desc("doc_id")]).select("doc_id", "source", "n")


@query("""WITH b AS (SELECT conv_id AS doc_id, arg_max(text, (length(text), turn)) AS text, arg_max(role, (length(text), turn)) AS lang FROM conversations GROUP BY 1)
SELECT doc_id, length(CASE WHEN length(coalesce(b.text, '')) > length(coalesce(a.text, '')) THEN b.text ELSE a.text END) AS n, coalesce(b.lang, a.lang) AS lang FROM documents a FULL JOIN b USING (doc_id)""")
def upsert_longest(t):
    """Upsert sink semantics: longest text wins, other columns take the new value where there is one. New are each conversation's longest turns."""
    new = distinct_on(t.conversations.withColumnsRenamed({"conv_id": "doc_id", "role": "lang"}), ["doc_id"], [F.desc(F.length("text")), F.desc("turn")])
    return merge_longest(t.documents.select("doc_id", "text", "lang"), new.select("doc_id", "text", "lang"), "doc_id", "text").select("doc_id", F.length("text").alias("n"), "lang")


@query("""WITH b AS (SELECT page_id AS doc_id, html AS text, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS source FROM pages)
SELECT doc_id, md5(CASE WHEN length(coalesce(b.text, '')) > length(coalesce(a.text, '')) THEN b.text ELSE a.text END) AS hash, coalesce(b.source, a.source) AS source FROM documents a FULL JOIN b USING (doc_id)""")
def upsert_pages(t):
    """upsert_longest over whole tables: all pages, as fetched anew, into all documents, whole texts against each other."""
    host = F.nullif(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    new = t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), host.alias("source"))
    return merge_longest(t.documents.select("doc_id", "text", "source"), new, "doc_id", "text").select("doc_id", F.md5("text").alias("hash"), "source")


@query("""WITH n AS (SELECT DISTINCT user_id AS k, event_type AS p FROM events), o AS (SELECT o_custkey AS k, o_orderpriority AS p FROM orders UNION ALL SELECT o_custkey, 'click' FROM orders WHERE o_orderstatus = 'P')
SELECT k, p FROM o UNION ALL SELECT k, p FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.p = n.p)""")
def insert_ignore(t):
    """All kinds of events of users into their orders' priorities and clicks; what is there already stays as it is."""
    there = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p")).unionByName(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit("click").alias("p")))
    return insert_missing(there, t.events.select(F.col("user_id").alias("k"), F.col("event_type").alias("p")), ["k", "p"])


@query("""WITH o AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem), n AS (SELECT DISTINCT o_orderkey AS k, p_partkey AS p FROM orders JOIN part ON p_partkey = o_custkey)
SELECT k, p FROM o UNION ALL SELECT k, p FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.p = n.p)""")
def insert_ignore_orders(t):
    """insert_ignore over whole tables: every order's own part into all lines."""
    new = t.orders.join(t.part, F.col("p_partkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("k"), F.col("p_partkey").alias("p"))
    return insert_missing(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")), new, ["k", "p"])


@query("SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def intersect_nations(t):
    return t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey FROM nation EXCEPT SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def except_nations(t):
    gone = t.nation.join(t.region.filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.nation.select("n_nationkey").subtract(gone.select("n_nationkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, ntile(4) OVER w AS quarter, dense_rank() OVER w AS place, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def frames_and_ranks(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(w).alias("place"), F.sum(money("o_totalprice")).over(w.rowsBetween(-2, 0)).cast("double").alias("last3"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT user_id, count(*) AS m FROM events GROUP BY 1)
SELECT coalesce(o_custkey, user_id) AS who, coalesce(n, 0) AS n, coalesce(m, 0) AS m, round(abs(coalesce(n, 0) * 1.0 / (SELECT sum(n) FROM c) - coalesce(m, 0) * 1.0 / (SELECT sum(m) FROM s)), 6) AS divergence FROM c FULL JOIN s ON o_custkey = user_id""")
def divergence(t):
    """Difference of two actors' shares over the union of their keys."""
    c, s = t.orders.groupBy(F.col("o_custkey").alias("who")).agg(F.count("*").alias("n")), t.events.groupBy(F.col("user_id").alias("who")).agg(F.count("*").alias("m"))
    nn, mm = t.orders.count(), t.events.count()
    j = c.join(s, "who", "full_outer").select("who", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    return j.withColumn("divergence", F.round(F.abs(F.col("n") / F.lit(nn) - F.col("m") / F.lit(mm)), 6))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'green' WHEN o_totalprice < 200000 THEN 'yellow' ELSE 'red' END AS light FROM orders")
def traffic_light(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p < 50000, "green").when(p < 200000, "yellow").otherwise("red").alias("light"))


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END) AS o, sum(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY 1")
def status_pivot(t):
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))
