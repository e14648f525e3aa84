"""Tables of budgets as JSON {"headers": [...], "rows": [[...], ...]}: numbers and fact lines out of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.numbers import dutch_number, euro_amount, has_number, multiplier
from plenum.functions.text import clean_label
from plenum.operators.shared import written

SCHEMA = "headers array<string>, rows array<array<string>>"
#: What headers and rows are known by.
PROGRAMME, SUB_PROGRAMME = r"(?i)^(programma|prog\.?)$", r"(?i)^(deelprogramma|sub[_\-\s]?programma|product|taakveld)$"
AMOUNT = r"(?i)(lasten|baten|saldo|begroting|realisatie|werkelijk|bijgesteld|primitief|actueel)"
YEAR, TOTAL = r"\b(20[12]\d)\b", r"(?i)^(totaal|subtotaal|totalen|total|sub\s*totaal)\b"


def once(value: Column) -> Column:
    """value as a generated column: it is computed once, and not again in each filter or column that reads it."""
    return F.explode(F.array(value))


def parsed(tables: DataFrame, json_col: str = "table_json") -> DataFrame:
    """tables with headers and rows; what is no such JSON has neither."""
    told = tables.select(*[c for c in tables.columns if c != json_col], once(F.from_json(json_col, SCHEMA)).alias("_j"))
    return told.withColumns({"headers": F.col("_j.headers"), "rows": F.col("_j.rows")}).drop("_j")


def without_header_rows(headers: Column, rows: Column) -> Column:
    """rows without those whose filled cells are all headers, and without cells that repeat the header above them."""
    heads = F.transform(headers, lambda h: F.lower(F.trim(h)))
    told = F.filter(heads, lambda h: h != "")
    cells = lambda row: F.transform(row, lambda c: F.coalesce(F.trim(c), F.lit("")))
    repeats = lambda row: F.exists(row, lambda c: c != "") & F.forall(row, lambda c: (c == "") | F.array_contains(told, F.lower(c)))
    kept = F.filter(F.transform(rows, cells), lambda row: ~repeats(row))
    return F.transform(kept, lambda row: F.transform(row, lambda c, i: F.when(F.lower(c) == F.get(heads, i), "").otherwise(c)))


def table_numbers(tables: DataFrame, key: str) -> DataFrame:
    """key, row_idx, label, year (null off year columns), value of every number but zero beside a label; totals of all go."""
    rows = tables.select(key, "headers", F.posexplode("rows").alias("row_idx", "row")).filter("size(row) >= 2")
    label = F.trim(F.get("row", F.lit(0)))
    cells = rows.withColumn("label", label).filter((F.col("label") != "") & (F.lower("label") != "totaal generaal"))
    cells = cells.select(key, "headers", "row_idx", "label", F.posexplode("row").alias("i", "raw")).withColumn("head", F.trim(F.get("headers", F.col("i"))))
    year = F.nullif(F.regexp_extract("head", r"^((?:19|20)\d{2})", 1), F.lit(""))
    found = cells.withColumn("year", year).filter("i > 0 or year is not null").select(key, "row_idx", "label", "year", once(dutch_number(F.col("raw"))).alias("value")).filter("value != 0")
    return found.select(key, "row_idx", "label", "year", "value")


def layouts(tables: DataFrame, key: str) -> DataFrame:
    """key, programma, sub (columns; null without), consumed (header rows), factor, columns array<(i, jaar, label)> of tables with value columns.

    A header has a year and what is counted, or the first row says what; where one year stands in all headers, those without one are of that year."""
    first = F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>"))
    heads = tables.select(key, F.posexplode("headers").alias("i", "head"), first.alias("first")).withColumn("head", F.trim("head"))
    said = lambda c: F.nullif(F.initcap(F.regexp_extract(c, AMOUNT, 1)), F.lit(""))
    role = F.when(F.col("head").rlike(PROGRAMME), "programma").when(F.col("head").rlike(SUB_PROGRAMME), "sub")
    heads = heads.withColumns({"role": role, "jaar": F.nullif(F.regexp_extract("head", YEAR, 1), F.lit("")).cast("int"), "label": said(F.col("head")), "below": said(F.trim(F.get("first", F.col("i"))))})
    free, whole = F.col("role").isNull(), F.col("jaar").isNotNull() & F.col("label").isNotNull()
    each = heads.groupBy(key).agg(
        F.max(F.when(F.col("role") == "programma", F.col("i"))).alias("programma"), F.max(F.when(F.col("role") == "sub", F.col("i"))).alias("sub"),
        F.collect_set(F.when(free, F.col("jaar"))).alias("years"), F.bool_or(free & whole).alias("resolved"),
        F.array_sort(F.collect_list(F.struct("i", "jaar", "label", "below", free.alias("free")))).alias("cols"),
        F.max(multiplier(F.col("head"))).alias("factor"), F.max(F.array_max(F.transform("first", multiplier))).alias("first_factor"),
    )
    one = F.when(F.size("years") == 1, F.get("years", F.lit(0)))
    picked = F.transform(F.filter("cols", lambda c: c["free"]), lambda c: F.struct(
        c["i"].alias("i"),
        F.coalesce(c["jaar"], F.when(c["label"].isNotNull(), one)).alias("jaar"),
        F.when(c["label"].isNotNull(), c["label"]).when(c["jaar"].isNotNull(), c["below"]).alias("label"),
        (c["label"].isNull() & c["jaar"].isNotNull() & c["below"].isNotNull()).alias("two"),
    ))
    each = each.withColumn("columns", F.filter(picked, lambda c: c["jaar"].isNotNull() & c["label"].isNotNull())).filter("size(columns) > 0")
    others = F.filter(F.transform("cols", lambda c: c["i"]), lambda i: ~F.array_contains(F.transform("columns", lambda c: c["i"]), i))
    consumed = F.when(F.exists("columns", lambda c: c["two"]), 2).otherwise(1)
    factor = F.when(F.col("factor") != 1, F.col("factor")).otherwise(F.coalesce("first_factor", F.lit(1)))
    return each.select(key, F.coalesce("programma", F.get(others, F.lit(0))).alias("programma"), "sub", consumed.alias("consumed"), factor.alias("factor"), F.transform("columns", lambda c: F.struct(c["i"].alias("i"), c["jaar"].alias("jaar"), c["label"].alias("label"))).alias("columns"))


def fact_lines(tables: DataFrame, key: str) -> DataFrame:
    """key, row_idx, col_idx, programma, sub_programma, jaar, label, amount, sha256 of every amount cell.

    A row with a programme and no numbers heads those below it; a row without a programme takes the last one; totals are told apart by
    their first word, belong to the last programme, and have the sub programme 'totaal'. Zeros count only as a balance."""
    tables = written(tables)  # read twice: its layout, and its cells
    rows = tables.join(layouts(tables, key), key).select(key, "programma", "sub", "consumed", "factor", "columns", F.posexplode("rows").alias("at", "row")).filter("at >= consumed - 1")
    cell = lambda i: F.coalesce(F.trim(F.get("row", i)), F.lit(""))
    rows = rows.withColumns({"row_idx": F.col("at") - F.col("consumed") + 1, "p": cell(F.col("programma")), "s": F.when(F.col("sub").isNotNull(), cell(F.col("sub"))).otherwise("")})
    total = F.col("p").rlike(TOTAL) | F.col("s").rlike(TOTAL)
    empty = F.forall("columns", lambda c: ~has_number(F.get("row", c["i"])))
    rows = rows.withColumns({"total": total, "own": F.when((F.col("p") != "") & ~total, clean_label(F.col("p"))), "heads": (F.col("p") != "") & ~total & empty})
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy(key).orderBy("at"))
    rows = rows.withColumn("name", carried).filter(~F.col("heads") & (F.col("name").isNotNull() | F.col("total")))
    cells = rows.select(key, "row_idx", "name", F.when(F.col("total"), "totaal").otherwise(clean_label(F.col("s"))).alias("sub_programma"), "factor", "row", F.explode("columns").alias("c"))
    cells = cells.withColumn("raw", F.coalesce(F.trim(F.get("row", F.col("c.i"))), F.lit(""))).filter("raw != ''").select("*", once(euro_amount(F.col("raw"), F.col("factor"))).alias("amount"))
    kept = cells.filter(F.col("amount").isNotNull() & ((F.col("amount") != 0) | (F.col("c.label") == "Saldo")))
    return kept.select(key, "row_idx", F.col("c.i").alias("col_idx"), F.col("name").alias("programma"), "sub_programma", F.col("c.jaar").alias("jaar"), F.col("c.label").alias("label"), "amount", F.sha2("raw", 256).alias("sha256"))
