"""Registers against evidence: offices and letters of appointment, gaps, submitters of motions, the likest titles of a day.

An order is an office of its customer: it begins on the order's day and lasts as many days as its price says; orders in progress are letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators.intervals import audited_offices, coalesced, difference
from plenum.operators.likeness import likest
from plenum.operators.relops import spread
from plenum.plans.registry import query
from plenum.sources.submitters import submitters

REGISTER = """register AS (SELECT o_custkey AS name, CAST(o_orderdate AS DATE) AS begin, CASE WHEN o_orderkey % 40 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice) % 120 AS INTEGER) END AS until FROM orders WHERE o_orderstatus <> 'P'),
letters AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS name, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 5 <> 0)"""


def register(t):
    day = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 40 != 0, F.date_add(day, (F.floor("o_totalprice") % 120).cast("int")))
    return t.orders.filter("o_orderstatus != 'P'").select(F.col("o_custkey").alias("name"), day.alias("begin"), end.alias("end"))


def letters(t):
    name = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey"))
    return t.orders.filter("o_orderstatus = 'P' and o_custkey % 5 != 0").select(name.alias("name"), F.col("o_orderdate").cast("date").alias("day"))


@query(f"""WITH {REGISTER}, far AS (SELECT name, begin, coalesce(until, DATE '9999-12-31') AS until FROM register), w AS (SELECT *, max(until) OVER (PARTITION BY name ORDER BY begin, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM far),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR begin - before > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY begin, until ROWS UNBOUNDED PRECEDING) AS run FROM w),
spans AS (SELECT name, min(begin) AS begin, nullif(max(until), DATE '9999-12-31') AS until FROM runs GROUP BY name, run),
near AS (SELECT l.name, l.day, min(abs(l.day - r.begin)) AS days FROM letters l JOIN register r ON r.name = l.name GROUP BY l.name, l.day)
SELECT l.name, 'appointment_without_record' AS finding, CAST(day AS VARCHAR) AS day, NULL AS until, NULL AS days FROM letters l WHERE NOT EXISTS (SELECT 1 FROM register r WHERE r.name = l.name)
UNION ALL SELECT l.name, 'date_mismatch', CAST(l.day AS VARCHAR), NULL, days FROM letters l JOIN near USING (name, day) WHERE days > 30
UNION ALL SELECT name, 'record_without_appointment', CAST(begin AS VARCHAR), CAST(until AS VARCHAR), NULL FROM spans WHERE name NOT IN (SELECT name FROM letters)
UNION ALL SELECT name, 'overlap', CAST(begin AS VARCHAR), CAST(nullif(max(least(until, before)), DATE '9999-12-31') AS VARCHAR), count(*) FROM w WHERE begin <= before GROUP BY name, begin""")
def office_audit(t):
    """Letters without an office, offices without a letter, begins that are too far from it, offices of one person at the same time."""
    found = audited_offices(register(t), letters(t))
    return found.select("name", "finding", F.col("day").cast("string").alias("day"), F.col("until").cast("string").alias("until"), F.col("days").cast("long").alias("days"))


@query(f"""WITH {REGISTER}, own AS (SELECT DISTINCT name, unnest(generate_series(begin, until, INTERVAL 1 DAY))::DATE AS day FROM register WHERE until IS NOT NULL),
others AS (SELECT DISTINCT name, unnest(generate_series(day - 20, day + 20, INTERVAL 1 DAY))::DATE AS day FROM letters), left_ AS (SELECT * FROM own EXCEPT SELECT * FROM others),
runs AS (SELECT name, day, day - CAST(row_number() OVER (PARTITION BY name ORDER BY day) AS INTEGER) AS run FROM left_) SELECT name, CAST(min(day) AS VARCHAR) AS begin, CAST(max(day) AS VARCHAR) AS until FROM runs GROUP BY name, run""")
def unattested_periods(t):
    """The days of a person's offices that are more than twenty days from every letter, as intervals."""
    around = letters(t).select("name", F.date_sub("day", 20).alias("begin"), F.date_add("day", 20).alias("end"))
    found = difference(register(t).filter("end is not null"), around, ["name"])
    return found.select("name", F.col("begin").cast("string").alias("begin"), F.col("end").cast("string").alias("until"))


@query(f"""WITH {REGISTER}, own AS (SELECT DISTINCT name, unnest(generate_series(begin, until, INTERVAL 1 DAY))::DATE AS day FROM register WHERE until IS NOT NULL),
runs AS (SELECT name, day, day - CAST(row_number() OVER (PARTITION BY name ORDER BY day) AS INTEGER) AS run FROM own) SELECT name, CAST(min(day) AS VARCHAR) AS begin, CAST(max(day) AS VARCHAR) AS until FROM runs GROUP BY name, run""")
def office_terms(t):
    """A person's offices that overlap or follow each other, as one term."""
    found = coalesced(register(t).filter("end is not null"), ["name"])
    return found.select("name", F.col("begin").cast("string").alias("begin"), F.col("end").cast("string").alias("until"))


@query()
def likest_titles(t):
    """Meetings of one store to the likest title of the other on their day, by matching blocks."""
    name = F.concat("o_orderpriority", F.lit(" - zaal "), (F.col("o_custkey") % 50).cast("string"), F.lit(" (besloten)"))
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), name.alias("name"), F.col("o_orderpriority").alias("committee"), "o_orderstatus")
    a, b = rows.filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "a"), rows.filter("o_orderstatus != 'F'").withColumnRenamed("o_orderkey", "b")
    return likest(a, b, "day", "a", "b", ["name", "committee"], "name")


@query("""WITH n AS (SELECT o_orderkey AS k, 'Naam' || chr(CAST(97 + o_custkey % 26 AS INTEGER)) AS a, 'Klaas van Dorp' || chr(CAST(97 + o_orderkey % 26 AS INTEGER)) AS b, o_orderkey % 4 AS v FROM orders), u AS (SELECT k, 1 AS p, CASE WHEN right(a, 1) < 'n' THEN 'V. ' || a ELSE a END AS name, v, a, b FROM n WHERE v <> 3
UNION ALL SELECT k, 2, b, v, a, b FROM n WHERE v <> 3) SELECT k AS o_orderkey, CASE WHEN v = 1 THEN 3 - p ELSE p END AS place, name FROM u""")
def motion_submitters(t):
    """Who hands in each motion, by phrases and by signatures; half of the names are known to a register."""
    a = F.concat(F.lit("Naam"), F.chr((97 + F.col("o_custkey") % 26).cast("int")))
    b = F.concat(F.lit("Klaas van Dorp"), F.chr((97 + F.col("o_orderkey") % 26).cast("int")))
    v = F.col("o_orderkey") % 4
    told = F.concat(F.lit("Overwegende dat het kan, ingediend door: de heer "), a, F.lit(" (VVD), "), b, F.lit(" en wethouder "), a, F.lit(". besluit dat"))
    block = F.concat(F.lit("besluit dat dit zo is.\n\n"), a, F.lit(" (VVD)\n"), b, F.lit("\n"))
    both = F.concat(F.lit("mede ondertekend door "), a, F.lit("\nbesluit\n"), b, F.lit(" (SP)\nMevrouw "), a)
    text = F.when(v == 0, told).when(v == 1, block).when(v == 2, both).otherwise("besluit\nhet college op te dragen dat\nzo te doen")
    letter = F.explode(F.transform(F.sequence(F.lit(97), F.lit(109)), lambda c: F.concat(F.lit("Naam"), F.chr(c))))
    known = t.region.limit(1).select(letter.alias("term")).withColumn("name", F.concat(F.lit("V. "), "term"))
    return submitters(spread(t.orders.select("o_orderkey", text.alias("text"))), "o_orderkey", "text", known)
