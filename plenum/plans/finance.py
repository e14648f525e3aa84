"""Budget lines: a line is an order line, its label the return flag, its year that of the order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.plans.registry import query

LINES = "lines AS (SELECT l_returnflag AS label, year(o_orderdate) AS jaar, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def lines(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("l_returnflag").alias("label"), F.year("o_orderdate").alias("jaar"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), "l_partkey", "l_suppkey")


@query(f"WITH {LINES} SELECT label, jaar, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM lines GROUP BY 1, 2")
def series_by_label(t):
    return lines(t).groupBy("label", "jaar").agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("n"))


@query(f"""WITH {LINES}, s AS (SELECT label, jaar, CAST(sum(amount) AS DOUBLE) AS total FROM lines WHERE jaar <> 1998 GROUP BY 1, 2), g AS (SELECT label, y AS jaar FROM (SELECT DISTINCT label FROM lines), (SELECT unnest(range(min(jaar), max(jaar) + 1)) AS y FROM lines)),
j AS (SELECT g.label, g.jaar, total, lag(total) OVER (PARTITION BY g.label ORDER BY g.jaar) AS before FROM g LEFT JOIN s ON s.label = g.label AND s.jaar = g.jaar)
SELECT label, jaar, total, round(total - before, 2) AS delta, CASE WHEN before <> 0 THEN round(100 * (total - before) / before, 2) END AS pct FROM j""")
def year_over_year(t):
    """Deltas against the year before, for all years from the first to the last; a missing year (1998 here) resets it."""
    sums = lines(t).filter("jaar != 1998").groupBy("label", "jaar").agg(F.sum("amount").cast("double").alias("total"))
    years = lines(t).groupBy("label", "jaar").count().groupBy("label").agg(F.min("jaar").alias("own_first"), F.max("jaar").alias("own_last"))
    ends = years.agg(F.min("own_first").alias("first"), F.max("own_last").alias("last"))  # one row
    spine = years.select("label").join(F.broadcast(ends)).select("label", F.explode(F.sequence("first", "last")).alias("jaar"))
    j = spine.join(sums, ["label", "jaar"], "left").withColumn("before", F.lag("total").over(Window.partitionBy("label").orderBy("jaar")))
    return j.select("label", "jaar", "total", F.round(F.col("total") - F.col("before"), 2).alias("delta"), F.when(F.col("before") != 0, F.round(100 * (F.col("total") - F.col("before")) / F.col("before"), 2)).alias("pct"))


@query(f"""WITH {LINES}, p AS (SELECT p_brand AS programma, jaar, count(*) AS n, round(avg(CAST(amount AS DOUBLE)), 4) AS mean FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT programma, count(DISTINCT jaar) AS years, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1 ORDER BY n DESC, programma LIMIT 20""")
def top_programmas(t):
    j = lines(t).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy(F.col("p_brand").alias("programma")).agg(F.count_distinct("jaar").alias("years"), F.count("*").alias("n")).orderBy(F.desc("n"), "programma").limit(20)


@query(f"""WITH {LINES}, x AS (SELECT jaar, 0 AS stage, label, amount FROM lines WHERE label = 'A' AND jaar < 1998 UNION ALL SELECT jaar, 1, label, amount FROM lines WHERE lower(label) LIKE '%n%'),
m AS (SELECT *, min(stage) OVER (PARTITION BY jaar) AS best FROM x) SELECT jaar, label, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM m WHERE stage = best GROUP BY 1, 2""")
def exact_then_fuzzy(t):
    """Lines that match exactly; for years without any, those that match loosely."""
    rows = lines(t)
    both = rows.filter("label = 'A' and jaar < 1998").withColumn("stage", F.lit(0)).unionByName(rows.filter(F.lower("label").contains("n")).withColumn("stage", F.lit(1)))
    best = both.groupBy("jaar").agg(F.min("stage").alias("stage"))
    return both.join(best, ["jaar", "stage"]).groupBy("jaar", "label").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(f"""WITH {LINES}, s AS (SELECT l_suppkey, sum(amount) AS own FROM lines GROUP BY 1) SELECT s_nationkey, l_suppkey, CAST(own AS DOUBLE) AS own, round(CAST(own AS DOUBLE) / sum(CAST(own AS DOUBLE)) OVER (PARTITION BY s_nationkey), 6) AS share FROM s JOIN supplier ON s_suppkey = l_suppkey""")
def derived_shares(t):
    """Each member's share in its joint arrangement."""
    own = lines(t).groupBy("l_suppkey").agg(F.sum("amount").alias("own")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    total = F.sum(F.col("own").cast("double")).over(Window.partitionBy("s_nationkey"))
    return own.select("s_nationkey", "l_suppkey", F.col("own").cast("double").alias("own"), F.round(F.col("own").cast("double") / total, 6).alias("share"))
