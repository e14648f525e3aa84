"""Budget tables: JSON tables made of every order's lines, read back as numbers and fact lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators.relops import distinct_on
from plenum.plans.registry import query
from plenum.plans.values import dutch
from plenum.sources import tables as source

#: The lines of an order in order; every fourth one heads a group, and the last kind is a total.
ROWS = "r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_linenumber AS ln, p_name AS name, l_extendedprice AS price, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey)"


def rows(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("k"), (F.row_number().over(order) - 1).alias("i"), F.col("l_linenumber").alias("ln"), F.col("p_name").alias("name"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("q"))


def as_json(r, headers, cells):
    """A table of each order: its headers, and a row of cells for each line."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("i", F.array(*cells).alias("cells")))), lambda x: x["cells"])
    return r.groupBy("k").agg(F.to_json(F.struct(F.array(*[F.lit(h) for h in headers]).alias("headers"), held.alias("rows"))).alias("table_json"))


@query(f"""WITH {ROWS}, f AS (SELECT k, i, ln, price, q, last_value(CASE WHEN ln % 4 <> 0 AND ln % 4 <> 2 THEN name END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i) AS programma, CASE WHEN ln % 4 = 0 THEN 'totaal' END AS sub FROM r WHERE true)
SELECT k, i AS row_idx, c.col AS col_idx, programma, sub AS sub_programma, c.jaar, c.label, CAST(round(c.amount, 2) AS DECIMAL(18,2)) AS amount FROM f, LATERAL (SELECT 1 AS col, 2023 AS jaar, 'Lasten' AS label, price * 1000 AS amount UNION ALL SELECT 2, 2023, 'Baten', CASE WHEN q > 25 THEN -q * 1000 END UNION ALL SELECT 3, 2024, 'Saldo', CASE WHEN q > 40 THEN 0 ELSE q * 1000 END) c
WHERE ln % 4 <> 1 AND (programma IS NOT NULL OR ln % 4 = 0) AND c.amount IS NOT NULL""")
def table_fact_lines(t):
    """Fact lines with their programme: own, carried from above, or headed by a group; totals; zeros only as balances."""
    q = F.col("q").cast("int").cast("string")
    group = F.col("ln") % 4 == 1
    name = F.when(F.col("ln") % 4 == 0, F.concat(F.lit("Totaal "), F.col("name"))).when(F.col("ln") % 4 == 2, "").otherwise(F.col("name"))
    cells = [name, F.when(group, "").otherwise(dutch(F.format_number("price", 2))), F.when(group | (F.col("q") <= 25), "").otherwise(F.concat(F.lit("("), q, F.lit(")"))), F.when(group, "-").when(F.col("q") > 40, "0").otherwise(q)]
    made = as_json(rows(t), ["Programma", "2023 lasten (x € 1.000)", "2023 baten", "2024 Saldo"], cells)
    found = source.fact_lines(source.parsed(made), "k")
    return found.select("k", "row_idx", "col_idx", "programma", "sub_programma", "jaar", "label", "amount")


@query(f"""WITH {ROWS} SELECT k, i AS row_idx, name AS label, c.year, c.value FROM r, LATERAL (SELECT '2023' AS year, price AS value UNION ALL SELECT '2024', q * 1000000 UNION ALL SELECT NULL, q) c""")
def table_numbers(t):
    """Labelled numbers of year columns and others."""
    q = F.col("q").cast("int").cast("string")
    made = as_json(rows(t), ["Omschrijving", "2023 werkelijk", "2024", "aantal", "leeg"], [F.col("name"), dutch(F.format_number("price", 2)), F.concat(q, F.lit(" mln")), q, F.lit("-")])
    return source.table_numbers(source.parsed(made), "k")


@query(f"""WITH {ROWS}, n AS (SELECT k, count(*) AS rows_, max(CASE WHEN ln = 1 THEN 1 ELSE 0 END) AS head FROM r GROUP BY 1)
SELECT k, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS consumed, CAST(CASE WHEN k % 2 = 0 THEN 1000 ELSE 1 END AS BIGINT) AS factor, CASE WHEN k % 3 = 0 THEN '1:2023:Lasten,2:2024:Baten' WHEN k % 3 = 1 THEN '1:2023:Lasten,2:2024:Baten' ELSE '1:2025:Lasten,2:2025:Baten' END AS columns FROM n""")
def header_layouts(t):
    """Headers with year and label, with labels in the first row, and with one year for all."""
    kinds = F.get(F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in (["Programma", "2023", "2024"], ["Domein", "2023 lasten", "baten 2024"], ["Programma", "lasten 2025", "baten"])]), (F.col("k") % 3).cast("int"))
    unit = F.when(F.col("k") % 2 == 0, " x 1.000").otherwise("")
    heads = F.transform(kinds, lambda h, i: F.when(i == 1, F.concat(h, unit)).otherwise(h))
    body = F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: F.array(x["name"], F.lit("1"), F.lit("2")))
    below = F.when(F.col("k") % 3 == 0, F.array(F.array(F.lit(""), F.lit("Lasten"), F.lit("Baten")))).otherwise(F.array().cast("array<array<string>>"))
    tables = rows(t).groupBy("k").agg(body.alias("body")).select("k", heads.alias("headers"), F.concat(below, "body").alias("rows"))
    shown = F.transform("columns", lambda c: F.concat_ws(":", c["i"].cast("string"), c["jaar"].cast("string"), c["label"]))
    return source.layouts(tables, "k").select("k", "consumed", F.col("factor").cast("long").alias("factor"), F.array_join(shown, ",").alias("columns"))


@query(f"""WITH {ROWS} SELECT k, count(*) AS kept, CAST(sum(CASE WHEN ln % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS blanked FROM r WHERE ln % 5 <> 3 GROUP BY 1""")
def header_row_dedup(t):
    """Rows that repeat the headers go, and so do cells that repeat their own header."""
    row = F.when(F.col("ln") % 5 == 3, F.array(F.lit("NAAM"), F.lit(""), F.lit("Bedrag"))).otherwise(F.array("name", F.when(F.col("ln") % 2 == 0, " bedrag ").otherwise("7"), F.lit("x")))
    tables = rows(t).groupBy("k").agg(F.collect_list(row).alias("rows")).withColumn("headers", F.array(F.lit("Naam"), F.lit("Bedrag"), F.lit("Noot")))
    clean = tables.select("k", F.explode(source.without_header_rows(F.col("headers"), F.col("rows"))).alias("row"))
    return clean.groupBy("k").agg(F.count("*").alias("kept"), F.count_if(F.get("row", F.lit(1)) == "").alias("blanked"))


@query("""WITH l AS (SELECT DISTINCT p_name FROM part), a AS (SELECT p_name, min(p_brand) AS code FROM part WHERE p_type = 'ECONOMY' GROUP BY 1), b AS (SELECT p_name, CASE WHEN p_name LIKE '%ring%' THEN 'K1' WHEN p_name LIKE 'red%' THEN 'K2' END AS code FROM l)
SELECT l.p_name, coalesce(a.code, b.code, 'geen') AS code, CASE WHEN a.code IS NOT NULL THEN 1.00 WHEN b.code IS NOT NULL THEN 0.90 ELSE 0 END AS confidence FROM l LEFT JOIN a USING (p_name) LEFT JOIN b USING (p_name)""")
def alias_tiers(t):
    """Labels mapped by tables, those left by the first keyword rule that fits; the rest stay without."""
    labels = t.part.select("p_name").distinct()
    a = t.part.filter("p_type = 'ECONOMY'").groupBy("p_name").agg(F.min("p_brand").alias("code")).withColumn("confidence", F.lit(1.0))
    rule = F.when(F.col("p_name").contains("ring"), "K1").when(F.col("p_name").startswith("red"), "K2")
    left = labels.join(a, "p_name", "left_anti")
    b = left.withColumn("code", rule).filter("code is not null").withColumn("confidence", F.lit(0.9))
    rest = left.join(b, "p_name", "left_anti").select("p_name", F.lit("geen").alias("code"), F.lit(0.0).alias("confidence"))
    return a.unionByName(b).unionByName(rest)


@query(f"""WITH {ROWS}, c AS (SELECT k, i, CASE WHEN ln % 3 = 1 THEN name END AS p, ln FROM r), f AS (SELECT k, last_value(p IGNORE NULLS) OVER (PARTITION BY k ORDER BY i) AS programma, '0.' || ln AS code FROM c) SELECT DISTINCT programma, code FROM f WHERE programma IS NOT NULL""")
def cross_table(t):
    """Programme and code pairs of cross tables: the programme is carried over the rows below it, the code found by its form."""
    r = rows(t)
    by = Window.partitionBy("k").orderBy("i")
    carried = F.last(F.when(F.col("ln") % 3 == 1, F.col("name")), ignorenulls=True).over(by)
    code = F.regexp_extract(F.concat(F.lit("Taakveld 0."), F.col("ln").cast("string"), F.lit(" bestuur")), r"(\d+\.\d+)", 1)
    return r.select(carried.alias("programma"), code.alias("code")).filter("programma is not null").distinct()


@query(f"""WITH {ROWS}, s AS (SELECT k % 20 AS label, 2020 + ln AS jaar, sum(CAST(price AS DECIMAL(18,2))) AS v FROM r GROUP BY 1, 2), d AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY jaar) AS p FROM s)
SELECT label, jaar, CAST(v AS DOUBLE) AS value, CAST(v - p AS DOUBLE) AS delta, round(100.0 * CAST(v - p AS DOUBLE) / abs(CAST(p AS DOUBLE)), 4) AS pct FROM d WHERE p IS NOT NULL AND p <> 0""")
def table_year_delta(t):
    """Each year against the last one that the table has, as a share of its size."""
    s = rows(t).groupBy((F.col("k") % 20).alias("label"), (2020 + F.col("ln")).alias("jaar")).agg(F.sum(F.col("price").cast("decimal(18,2)")).alias("v"))
    d = s.withColumn("p", F.lag("v").over(Window.partitionBy("label").orderBy("jaar"))).filter("p is not null and p != 0")
    delta = (F.col("v") - F.col("p")).cast("double")
    return d.select("label", "jaar", F.col("v").cast("double").alias("value"), delta.alias("delta"), F.round(100.0 * delta / F.abs(F.col("p").cast("double")), 4).alias("pct"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'gemeenschappelijke_regeling' ELSE c_mktsegment END AS scope FROM customer""")
def reclassified(t):
    """Entities that are joint arrangements get that scope, others keep theirs."""
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "gemeenschappelijke_regeling").otherwise(F.col("c_mktsegment")).alias("scope"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY l_shipdate DESC, l_extendedprice DESC, l_orderkey, l_linenumber) rn FROM lineitem) WHERE rn = 1""")
def primary_documents(t):
    """Of lines for one programme and year, that of the newest document."""
    rows_ = t.lineitem.withColumn("y", F.year("l_shipdate"))
    return distinct_on(rows_, ["l_partkey", "y"], [F.desc("l_shipdate"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))


@query("SELECT CAST(sum(CASE WHEN l_linenumber % 4 = 3 THEN 0 ELSE l_quantity * 1000 END) AS DOUBLE) AS total, count(*) FILTER (WHERE l_linenumber % 4 <> 3) AS known FROM lineitem")
def budget_total(t):
    """The sum of budgets in texts; what is no number doesn't count."""
    from plenum.functions.numbers import dutch_number

    raw = F.when(F.col("l_linenumber") % 4 == 3, "nader te bepalen").otherwise(F.concat(F.lit("€ "), F.col("l_quantity").cast("int").cast("string"), F.lit(".000")))
    return t.lineitem.select(dutch_number(raw).alias("x")).agg(F.sum("x").alias("total"), F.count("x").alias("known"))
