"""Filters and classifications of listings, chunks and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import rules
from plenum.functions.text import word_set
from plenum.plans.registry import query
from plenum.plans.values import chosen, sql_list


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_name ILIKE '%ring%')""")
def search_or_exists(t):
    """Orders whose own name matches, or one of whose items does."""
    hit = t.lineitem.join(t.part.filter(F.col("p_name").ilike("%ring%")), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return t.orders.join(hit, "o_orderkey", "left").filter(F.col("o_orderpriority").ilike("%urgent%") | F.col("hit")).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)^(small|RED) .*')")
def regex_exclusion(t):
    return t.part.filter(~F.col("p_name").rlike("(?i)^(small|RED) .*")).select("p_partkey", "p_name")


ITEMS = ["Opening", "Ingekomen stukken", "Voorstel wonen", "Vaststellen van de agenda", "Strategie haven"]
NUMBERS = [None, "1.0", "1.5", "2", "a.1"]


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, {sql_list(NUMBERS)}[1 + l_linenumber % 5] AS number, {sql_list(ITEMS)}[1 + CAST(l_quantity AS INT) % 5] AS name, l_orderkey % 3 = 0 AS cor FROM lineitem)
SELECT l_orderkey, l_linenumber, name, number FROM i WHERE name NOT IN ('Ingekomen stukken', 'Vaststellen van de agenda') AND NOT (number IS NOT NULL AND number LIKE '1.%' AND NOT cor AND name NOT IN ('Voorstel wonen', 'Strategie haven'))""")
def substantive_items(t):
    """Agenda items that are more than procedure."""
    item = t.lineitem.withColumn("q", F.col("l_quantity").cast("int"))
    item = item.select("l_orderkey", "l_linenumber", chosen("l_linenumber", [F.lit(n).cast("string") for n in NUMBERS]).alias("number"), chosen("q", ITEMS).alias("name"))
    meeting = F.when(F.col("l_orderkey") % 3 == 0, "Vergadering COR maart").otherwise("Raad corrigeert")
    return item.filter(rules.substantive(F.col("number"), F.col("name"), meeting)).select("l_orderkey", "l_linenumber", "name", "number")


@query("SELECT conv_id, turn, length(trim(text)) AS n FROM conversations WHERE length(trim(text)) >= 80")
def min_content(t):
    n = F.length(F.trim("text"))
    return t.conversations.filter(n >= 80).select("conv_id", "turn", n.alias("n"))


@query("""SELECT event_id FROM events WHERE (CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END IS NULL OR event_type NOT IN ('click', 'view')) AND coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END, 100.0) >= 20""")
def provenance_filter(t):
    """Sources that aren't excluded, unknown ones kept; a missing quality counts as the best."""
    source, quality = F.when(F.col("event_id") % 5 != 0, F.col("event_type")), F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return t.events.filter((source.isNull() | ~source.isin("click", "view")) & (F.coalesce(quality, F.lit(100.0)) >= 20)).select("event_id")


@query("""WITH y AS (SELECT l_orderkey, list_sort(list_distinct(list(year(l_shipdate)))) AS years, list_distinct(list(l_returnflag)) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(years, ',') AS years, len(years) AS n FROM y WHERE list_contains(years, 1998) AND list_has_any(flags, ['A', 'R'])""")
def array_filters(t):
    """Orders with a year in their array of years, and with any of two flags."""
    y = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.year("l_shipdate"))).alias("years"), F.collect_set("l_returnflag").alias("flags"))
    kept = y.filter(F.array_contains("years", 1998) & F.arrays_overlap("flags", F.array(F.lit("A"), F.lit("R"))))
    return kept.select("l_orderkey", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.size("years").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_returnflag, 'N') IS DISTINCT FROM nullif(l_linestatus, 'O')")
def null_safe_inequality(t):
    a, b = F.nullif(F.col("l_returnflag"), F.lit("N")), F.nullif(F.col("l_linestatus"), F.lit("O"))
    return t.lineitem.filter(~a.eqNullSafe(b)).select("l_orderkey", "l_linenumber")


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN replace(text, 'fi', chr(64257)) WHEN 2 THEN replace(text, 'e', chr(955)) ELSE text END AS text FROM documents),
c AS (SELECT doc_id, lower(text) AS low, text, length(regexp_replace(text, '[^\x20-\x7E\x{C0}-\x{FF}\n]', '', 'g')) * 1.0 / greatest(length(text), 1) AS clean FROM d)
SELECT doc_id, CASE WHEN clean < 0.95 THEN 'low_clean_ratio' WHEN low LIKE '%eau%' AND NOT regexp_matches(low, '(^|[^\pL\pN])eau([^\pL\pN]|$)') THEN 'bm25_miss' WHEN text LIKE '%' || chr(64257) || '%' OR text LIKE '%' || chr(64258) || '%' THEN 'ligature'
WHEN regexp_matches(text, '[a-zà-ÿ]{3,}[A-ZÀ-Ý][a-zà-ÿ]{2,}[A-ZÀ-Ý]') AND regexp_matches(text, '[^\s]{40,}') THEN 'garbled_spacing' ELSE 'unknown' END AS damage FROM c""")
def damage_classes(t):
    """The first fault of each document; a quarter has ligatures, a quarter foreign letters."""
    text = F.when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit("fi"), F.lit("ﬁ"))).when(F.col("doc_id") % 4 == 2, F.replace("text", F.lit("e"), F.lit("λ"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", rules.damage(text, "eau").alias("damage"))


def garbled_sql(text: str) -> str:
    """SQL of a table doc_id, garbled out of FROM (doc_id, text); addresses, file names, paths and codes go first."""
    prose = text
    for rx, new in ((r"(?i)https?://\S+", " "), (r"(?i)\S+\.(?:pdf|docx?|xlsx?|txt|xml|json|csv|png|jpg)\b", " "), (r"(^|\W)/[\w/.\-]{15,}", r"\1 "), (r"\b(?:[A-Z]{2,}[\-_]){2,}[A-Z0-9]+\b|\b[A-Z0-9]{20,}\b", " ")):
        prose = f"regexp_replace({prose}, '{rx}', '{new}', 'g')"
    trimmed = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"""(SELECT doc_id, coalesce(n >= 50 AND m >= 20 AND ((s < 0.06 AND g > 0.05) OR g > 0.20 OR (s < 0.10 AND g > 0.10)), false) AS garbled FROM
(SELECT doc_id, n, length(x) AS m, (length(x) - length(replace(x, ' ', ''))) / length(x) AS s, coalesce(length(array_to_string(regexp_extract_all(x, '[^\\s]{{35,}}'), '')), 0) / length(x) AS g
FROM (SELECT doc_id, length({trimmed("text")}) AS n, {trimmed(prose)} AS x FROM d)))"""


HARD = """CASE doc_id % 6 WHEN 0 THEN replace(text, ' ', '') WHEN 1 THEN replace(text, ' ', ' http://a.nl/b?' || doc_id || ' ') WHEN 2 THEN 'ABC-DEF-' || replace(substr(text, 1, 4000), ' ', ' XY-ZW-9 ') || substr(text, 4001) WHEN 3 THEN '/home/a.b/c-d/e_f/g/h ' || replace(text, '. ', '.pdf ') ELSE text END"""


def hard_text():
    """Texts without blanks, among addresses, among codes, with paths and file names, and as they are."""
    text, k = F.col("text"), F.col("doc_id") % 6
    among = F.concat(F.lit(" http://a.nl/b?"), F.col("doc_id").cast("string"), F.lit(" "))
    codes = F.concat(F.lit("ABC-DEF-"), F.replace(F.substring("text", 1, 4000), F.lit(" "), F.lit(" XY-ZW-9 ")), F.expr("substring(text, 4001)"))
    paths = F.concat(F.lit("/home/a.b/c-d/e_f/g/h "), F.replace("text", F.lit(". "), F.lit(".pdf ")))
    return F.when(k == 0, F.replace("text", F.lit(" "), F.lit(""))).when(k == 1, F.replace("text", F.lit(" "), among)).when(k == 2, codes).when(k == 3, paths).otherwise(text)


@query(f"WITH d AS (SELECT doc_id, {HARD} AS text FROM documents) SELECT * FROM {garbled_sql('text')}")
def garbled_texts(t):
    """Texts whose words have run together, hard ones among them."""
    return t.documents.select("doc_id", rules.garbled(hard_text()).alias("garbled"))


TITLES = ["Motie groen", "Amendement op raadsvoorstel", "Raadsvoorstel haven", "Notulen raad", "Verslag hoorzitting", "Besluitenlijst", "Begroting 2024", "Brief van college", "Annotatie", "Transcript", "Promotiefilm", "Adviezenlijst B", "Rapportage milieueffect"]
TYPES = ["motie", "amendement", "raadsvoorstel", "notulen", "verslag", "besluitenlijst", "financieel", "brief", "annotatie", "virtual_notulen", "motie", "overig", "overig"]  # 'promotie' has the pattern; only the class excludes it
KINDS = ["motie", "amendement", None, "notulen", "verslag", "besluitenlijst", None, None, "annotatie", None, None, "adviezenlijst", None]



@query(f"""SELECT o_orderkey, {sql_list(TYPES)}[1 + o_orderkey % 13] AS doc_type, {sql_list(KINDS)}[1 + o_orderkey % 13] AS doc_class, ['rotterdam', 'grjr', 'dcmr', 'vrr', 'mrdh'][1 + o_orderkey % 5] AS entity FROM orders""")
def named_types(t):
    """Type and class by a title's patterns, and the body that title, address or text names."""
    name = chosen("o_orderkey", TITLES)
    title = chosen("o_orderkey", ["Begroting", "Begroting GRJR 2024", "Jaarstukken", "Veiligheidsregio en stad Rotterdam", "Nota"])
    url, content = chosen("o_orderkey", ["http://a/b", "http://a/dcmr", "http://a/dcmr", "http://a/mrdh", "http://a"]), chosen("o_orderkey", ["x", "x", "x", "x", "Over de Metropoolregio"])
    return t.orders.select("o_orderkey", rules.doc_type(name).alias("doc_type"), rules.doc_class(name).alias("doc_class"), rules.entity(title, url, content).alias("entity"))


@query(r"""WITH d AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Begroting: Saldo 5, reserves. Saldo 6' WHEN 1 THEN ' saldo' ELSE '' END AS text, doc_id % 3 AS v FROM documents)
SELECT doc_id, CASE WHEN length(text) < 200 THEN 0 WHEN v = 0 THEN 4 WHEN v = 1 THEN 1 ELSE 0 END AS hits, CASE WHEN length(text) < 200 THEN '' WHEN v = 0 THEN 'begroting,reserves,saldo' WHEN v = 1 THEN 'saldo' ELSE '' END AS terms, length(text) >= 200 AND v = 0 AS financial FROM d""")
def financial_signals(t):
    """How many words of budgets a document has, which, and whether there are three or more."""
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Begroting: Saldo 5, reserves. Saldo 6").when(F.col("doc_id") % 3 == 1, " saldo").otherwise(""))
    rows = t.documents.select("doc_id", rules.financial_hits(text).alias("h"))
    return rows.select("doc_id", F.size("h").alias("hits"), F.array_join(F.array_sort(F.array_distinct("h")), ",").alias("terms"), (F.size("h") >= 3).alias("financial"))


@query(f"""WITH d AS (SELECT doc_id, substr({HARD}, 1, 5000) AS text FROM documents), g AS (SELECT * FROM {garbled_sql('text')}),
n AS (SELECT doc_id, garbled, doc_id % 3 = 0 AS money, length({HARD}) > 100000 AND (doc_id % 3 = 1 OR doc_id % 6 = 0) AS tables FROM documents JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'transcript' WHEN money AND tables THEN 'financial_table_rich' WHEN money THEN 'financial' WHEN garbled AND tables THEN 'garbled_table_rich' WHEN garbled THEN 'garbled_ocr' WHEN tables THEN 'table_rich' ELSE 'regular' END AS layout FROM n""")
def document_layouts(t):
    """Which way each document is read, hard ones among them."""
    doc = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("transcript_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    name = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "Begroting met toelichting").otherwise("Begroting")).when(F.col("doc_id") % 3 == 1, "Deelrapport").otherwise("Brief")
    return t.documents.select("doc_id", rules.layout(doc, name, hard_text()).alias("layout"))


@query("""SELECT c_custkey, left(c_name, 8) || '… [afgekapt]' AS c_name, CASE WHEN length(c_mktsegment) > 8 THEN left(c_mktsegment, 8) || '… [afgekapt]' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def safe_fields(t):
    """Customers without personal and internal fields, long texts cut: fields go by their names."""
    rows = t.customer.select("*", F.lit("a@b").alias("email"), F.lit(1).alias("_internal_rank"), F.lit("06").alias("phone"))
    return cut_long(safe(rows), 8).select("c_custkey", "c_name", "c_mktsegment")


#: Fields of persons.
PERSONAL = {"email", "phone", "address", "bsn", "geboortedatum"}


def safe(df):
    """df without fields of persons and without internal ones; nested ones go as well."""
    from pyspark.sql.types import StructType

    gone = lambda name: name.lower() in PERSONAL or name.startswith("_internal_")
    out = []
    for f in df.schema:
        if not gone(f.name):
            inner = [g.name for g in f.dataType if gone(g.name)] if isinstance(f.dataType, StructType) else []
            out.append(F.col(f"`{f.name}`").dropFields(*inner).alias(f.name) if inner else F.col(f"`{f.name}`"))
    return df.select(out)


def cut_long(df, most=50_000):
    """df with its long texts cut and marked."""
    short = lambda c: F.when(F.length(c) > most, F.concat(F.left(F.col(c), F.lit(most)), F.lit("… [afgekapt]"))).otherwise(F.col(c)).alias(c)
    return df.select([short(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


@query("""WITH r AS (SELECT l_orderkey, '| ' || l_linenumber || ' | ' || p_name || ' |' AS line, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, '| nr | naam |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, line) AS shown FROM r GROUP BY 1""")
def markdown_tables(t):
    """Each order's table as JSON, shown as Markdown."""
    row = F.struct("l_linenumber", "l_partkey", F.array(F.col("l_linenumber").cast("string"), F.col("p_name")).alias("cells"))
    tables = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.to_json(F.struct(F.array(F.lit("nr"), F.lit("naam")).alias("headers"), F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))).alias("table_json"))
    parsed = tables.select("l_orderkey", F.from_json("table_json", "headers array<string>, rows array<array<string>>").alias("j"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("j.headers")))
    return parsed.select("l_orderkey", F.concat_ws("\n", line(F.col("j.headers")), rule, F.array_join(F.transform("j.rows", line), "\n")).alias("shown"))


@query("""SELECT doc_id, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), ['the', 'la', 'der'])) > 0 AS hit FROM documents""")
def gazetteer_match(t):
    """Whether a document names any term of a list, by whole words."""
    return t.documents.select("doc_id", F.arrays_overlap(word_set(F.col("text")), F.array(F.lit("the"), F.lit("la"), F.lit("der"))).alias("hit"))
