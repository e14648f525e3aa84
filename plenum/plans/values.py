"""Functions over numbers, names, periods and votes: texts are made of every row's columns, the SQL knows what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import numbers, text
from plenum.plans.registry import query


def chosen(key, values):
    """The value whose place from 0 the key has, modulo their number."""
    n = F.col(key) % len(values)
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(n == i, v if not isinstance(v, str) else F.lit(v)).otherwise(out)
    return out


def dutch(column):
    """1,234.50 to 1.234,50."""
    return F.translate(column, ",.", ".,")


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 8 WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN floor(l_extendedprice) WHEN 2 THEN (l_quantity + 0.5) * 1000000 WHEN 3 THEN l_quantity * 1000000000
WHEN 4 THEN l_quantity WHEN 5 THEN l_quantity + 0.5 WHEN 6 THEN l_quantity * 1000000 END AS value FROM lineitem""")
def dutch_numbers(t):
    """Grouped, decimal, scaled and currency texts to numbers."""
    q = F.col("l_quantity").cast("int").cast("string")
    price, whole = F.format_number("l_extendedprice", 2), F.format_number(F.floor("l_extendedprice"), 0)
    raw = chosen("l_linenumber", [dutch(price), F.concat(F.lit("€ "), dutch(whole)), F.concat(q, F.lit(",5mln")), F.concat(q, F.lit(" miljard euro")), F.concat(F.lit("$ "), q, F.lit("%")), F.concat(q, F.lit(".5")), F.concat(q, F.lit(" mlj")), "geen getal"])
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.dutch_number(raw).alias("value"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 1000 ELSE 1 END AS m, CASE l_linenumber % 5 WHEN 0 THEN -l_extendedprice WHEN 1 THEN -l_extendedprice WHEN 2 THEN -l_quantity WHEN 3 THEN l_quantity + 0.14 END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, m AS factor, CAST(round(v * m, 2) AS DECIMAL(18,2)) AS amount, l_linenumber % 5 <> 4 AS has_number FROM x""")
def euro_amounts(t):
    """Parentheses, a minus on either side and a header's multiplier to decimals."""
    q, price = F.col("l_quantity").cast("int").cast("string"), dutch(F.format_number("l_extendedprice", 2))
    raw = chosen("l_linenumber", [F.concat(F.lit("("), price, F.lit(")")), F.concat(price, F.lit("-")), F.concat(F.lit("-\u00a0"), q), F.concat(q, F.lit(".14")), "p.m."])
    header = F.when(F.col("l_linestatus") == "F", "bedragen x € 1.000").otherwise("bedragen in euro")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", numbers.multiplier(header).cast("int").alias("factor"), raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", "factor", numbers.euro_amount(F.col("raw"), F.col("factor")).alias("amount"), numbers.has_number(F.col("raw")).alias("has_number"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '€ ' || printf('%d.0 mrd', CAST(l_quantity AS INT)) WHEN 1 THEN '€ ' || printf('%d.0 mln', CAST(l_quantity AS INT)) ELSE '€ ' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) END AS shown FROM lineitem""")
def shown_amounts(t):
    n = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") * 1e9).when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity") * 1e6).otherwise(F.floor("l_extendedprice").cast("double"))
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.short_money(n).alias("shown"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(c_mktsegment) || ' raad ' || c_custkey END AS label, c_name AS speaker, 'berg' || c_custkey AS surname FROM customer""")
def names(t):
    """Cleaned names and labels, speakers without roles, surname keys."""
    name = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("zzz "), F.col("c_name")))
    label = F.when(F.col("c_custkey") % 4 == 0, "  \n ").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" \t RAAD\n"), F.col("c_custkey").cast("string")))
    return t.customer.select(
        "c_custkey",
        text.clean_name(name).alias("name"),
        text.clean_label(text.normalised(label)).alias("label"),
        text.without_role(F.concat(chosen("c_custkey", ["Wethouder ", "de heer ", "Mevrouw ", ""]), F.col("c_name"), chosen("c_custkey", [" (Raadslid)", " (commissievoorzitter)", ""]))).alias("speaker"),
        text.surname_key(F.concat(chosen("c_custkey", ["dhr. J. van der Berg", "mevr. A.B. Berg", "wethouder de Berg"]), F.col("c_custkey").cast("string"), chosen("c_custkey", ["-Smit", ""]))).alias("surname"),
    )


ALIASES = sorted(text.PARTIES)


@query(f"""WITH a AS (SELECT o_orderkey, {sql_list([text.PARTIES[a] for a in ALIASES])}[1 + o_orderkey % {len(ALIASES)}] AS party FROM orders)
SELECT o_orderkey, party, party AS asked, 'COR en iBabs ' || o_orderkey AS corrected FROM a""")
def parties(t):
    """Aliases, the party a question names, and corrected terms."""
    alias = chosen("o_orderkey", ALIASES)
    key = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", text.party(F.concat(F.lit(" "), F.upper(alias), F.lit(" "))).alias("party"), text.party_in_query(F.concat(F.lit("Aandachtspunten: wat vindt "), alias, F.lit(", en waarom?"))).alias("asked"), text.corrected(F.concat(F.lit("koor en IBAB "), key)).alias("corrected"))


@query("""SELECT conv_id, turn, role, 'Bakker' || conv_id || ':VVD, ' || role || turn || ':-, Ng:D66' AS speakers, 'VVD,D66' AS parties FROM conversations""")
def speakers_in_text(t):
    """Speakers with their parties, roles left out, each speaker once."""
    made = F.concat(F.lit("De heer Bakker"), F.col("conv_id").cast("string"), F.lit(" (VVD) en mevrouw "), F.col("role"), F.col("turn").cast("string"), F.lit(" (onbekend). De heer Smit (wethouder). de heer bakker"), F.col("conv_id").cast("string"), F.lit(" (CDA) [Ng (d66)]: goed. [Ng (SP)]: ja"))
    listed = F.transform(text.speakers(made), lambda s: F.concat(s["speaker"], F.lit(":"), F.coalesce(s["party"], F.lit("-"))))
    once = F.replace(F.replace(made, F.lit("(CDA)"), F.lit("(wethouder)")), F.lit("(SP)"), F.lit("(d66)"))
    return t.conversations.select("conv_id", "turn", "role", F.array_join(listed, ", ").alias("speakers"), F.array_join(text.parties_in_text(once), ",").alias("parties"))


@query("""SELECT o_orderkey, ['aangenomen', 'aangenomen', 'verworpen', NULL, 'ingetrokken', 'aangehouden'][1 + o_orderkey % 6] AS outcome, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 46 WHEN 2 THEN 45 WHEN 4 THEN o_orderkey % 46 END AS INT) AS voor,
CAST(CASE o_orderkey % 6 WHEN 0 THEN 45 - o_orderkey % 46 WHEN 2 THEN 0 WHEN 4 THEN 45 - o_orderkey % 46 END AS INT) AS tegen, CASE WHEN o_orderkey % 6 = 5 THEN 'M2023-' || (100 + o_orderkey % 900) END AS number,
['aangenomen', 'aangenomen', 'verworpen', 'verworpen', 'ingetrokken', 'aangehouden'][1 + o_orderkey % 6] AS titled FROM orders""")
def votes(t):
    """Outcome near a motion, counts of one phrase, and the motion's number."""
    a, b = (F.col("o_orderkey") % 46).cast("string"), (45 - F.col("o_orderkey") % 46).cast("string")
    made = chosen("o_orderkey", [
        F.concat(F.lit("De motie is met "), a, F.lit(" stemmen voor en "), b, F.lit(" tegen AANGENOMEN")), "aangenomen: motie over groen", "het amendement is met algemene stemmen verworpen, unaniem",
        F.concat(F.lit("verworpen "), F.repeat(F.lit("x"), 300), F.lit(" motie")), F.concat(F.lit("Het voorstel kreeg "), a, F.lit(" stemmen voor,\nlater "), b, F.lit(" stemmen tegen; ingetrokken")),
        F.concat(F.lit("Motie nr. M2023-"), (100 + F.col("o_orderkey") % 900).cast("string"), F.lit(" wordt aangehouden"))])
    rows = t.orders.select("o_orderkey", made.alias("x"))
    return rows.select("o_orderkey", text.vote_outcome(F.col("x")).alias("outcome"), text.vote_counts(F.col("x"))["voor"].alias("voor"), text.vote_counts(F.col("x"))["tegen"].alias("tegen"), text.motion_number(F.col("x")).alias("number"), text.title_outcome(F.col("x")).alias("titled"))


PERIODS = ["besluiten sinds {y}", "besluiten na {y}", "from {y} on", "voor {y}", "tot {y}", "wat gebeurde in {y}?", "vorig jaar", "last year", "dit jaar", "afgelopen maanden", "tussen {y} en 2030", "wat is groen?"]
FROM, TO = ["{y}-01-01"] * 3 + [None, None, "{y}-01-01", "{p}-01-01", "{p}-01-01", "{t}-01-01", "90", "{y}-01-01", None], [None] * 3 + ["{y}-12-31", "{y}-12-31", "{y}-12-31", "{p}-12-31", "{p}-12-31", "{t}-12-31", "0", "2030-12-31", None]
DAYS = "CASE WHEN {x} IN ('0', '90') THEN CAST(CAST(today - CAST({x} AS INT) AS DATE) AS VARCHAR) ELSE replace(replace(replace({x}, '{{y}}', y), '{{t}}', CAST(year(today) AS VARCHAR)), '{{p}}', CAST(year(today) - 1 AS VARCHAR)) END"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS today, CAST(2010 + o_orderkey % 15 AS VARCHAR) AS y, {sql_list(FROM)}[1 + o_orderkey % 12] AS a, {sql_list(TO)}[1 + o_orderkey % 12] AS b FROM orders)
SELECT o_orderkey, {DAYS.format(x='a')} AS van, {DAYS.format(x='b')} AS tot FROM o""")
def periods(t):
    """Periods that questions name, each asked on the day of its order."""
    y = (2010 + F.col("o_orderkey") % 15).cast("string")
    rows = t.orders.select("o_orderkey", text.year_range(F.replace(chosen("o_orderkey", PERIODS), F.lit("{y}"), y), F.to_date("o_orderdate")).alias("p"))
    return rows.select("o_orderkey", F.col("p.van").cast("string").alias("van"), F.col("p.tot").cast("string").alias("tot"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS today, 1 + o_orderkey % 10 AS n, o_orderkey % 6 AS v FROM orders)
SELECT o_orderkey, CAST(CASE v WHEN 0 THEN today - CAST(365 * n AS INT) WHEN 1 THEN today - CAST(30 * n AS INT) WHEN 2 THEN DATE '2014-01-01' WHEN 3 THEN DATE '2015-01-01' WHEN 4 THEN DATE '2016-01-01' END AS DATE)::VARCHAR AS van,
CAST(CASE v WHEN 0 THEN today WHEN 1 THEN today WHEN 2 THEN today WHEN 3 THEN DATE '2015-12-31' WHEN 4 THEN DATE '2018-12-31' END AS DATE)::VARCHAR AS tot, v IN (0, 1, 2, 3) AS names_a_time FROM o""")
def spoken_periods(t):
    """The last N years or months, N in words or digits."""
    n = 1 + F.col("o_orderkey") % 10
    words = F.get(F.array(*[F.lit(w) for w in text.NUMBER_WORDS]), (n - 1).cast("int"))
    q = chosen("o_orderkey", [F.concat(F.lit("de afgelopen "), words, F.lit(" jaar")), F.concat(F.lit("de laatste "), n.cast("string"), F.lit(" maanden")), "besluiten sinds 2014", "besluiten in 2015", "van 2016 tot 2018", "groen"])
    rows = t.orders.select("o_orderkey", text.spoken_period(q, F.to_date("o_orderdate")).alias("p"), text.names_a_time(q).alias("names_a_time"))
    return rows.select("o_orderkey", F.col("p.van").cast("string").alias("van"), F.col("p.tot").cast("string").alias("tot"), "names_a_time")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(d AS VARCHAR) END AS parsed, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(d AS VARCHAR) END AS coerced, CAST(day(d) AS VARCHAR) || ' ' || ['januari', 'februari', 'maart', 'april', 'mei', 'juni', 'juli', 'augustus', 'september', 'oktober', 'november', 'december'][month(d)] || ' ' || year(d) AS written FROM o""")
def dutch_dates(t):
    """Written dates to dates and back, and dates out of longer texts."""
    d = F.to_date("o_orderdate")
    rows = t.orders.select("o_orderkey", d.alias("d"), text.dutch_date_text(d).alias("written"))
    spoken = F.when(F.col("o_orderkey") % 5 == 0, "5 brumaire 2024").otherwise(F.concat(F.lit("Vergadering van "), F.col("written"), F.lit(", 20:00")))
    raw = F.when(F.col("o_orderkey") % 4 == 3, "n.v.t.").otherwise(F.concat(F.col("d").cast("string"), F.lit("T19:30:00Z")))
    return rows.select("o_orderkey", text.dutch_date(spoken).cast("string").alias("parsed"), text.coerced_date(raw).cast("string").alias("coerced"), "written")


@query("""SELECT event_id, strftime(ts + to_hours(CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN 2 ELSE 1 END), '%Y-%m-%d %H:%M') AS local, round(3600.0 * hour(ts) + 60 * minute(ts) + floor(second(ts)), 3) AS seconds,
printf('%d:%02d:%02d', hour(ts), minute(ts), CAST(floor(second(ts)) AS INT)) AS clock, greatest(1, length(props) // 4) AS tokens FROM events""")
def local_times(t):
    """UTC to local time, clock texts to seconds and back, token estimates."""
    clock = F.date_format("ts", "H:mm:ss")
    s = text.seconds(F.concat(clock, F.lit(".000")))
    return t.events.select("event_id", F.date_format(F.from_utc_timestamp("ts", "Europe/Amsterdam"), "yyyy-MM-dd HH:mm").alias("local"), F.round(s, 3).alias("seconds"), text.clock(s).alias("clock"), text.token_estimate(F.col("props")).alias("tokens"))


@query("""SELECT l_orderkey, l_linenumber, CAST(('0x' || substr(md5(l_orderkey || '_' || l_linenumber), 1, 15)) AS BIGINT) AS point, sha256(CAST(l_orderkey AS VARCHAR)) AS cell,
CASE l_linenumber % 3 WHEN 0 THEN '2018,2019,2020' WHEN 1 THEN '2001' ELSE CAST(2010 + l_linenumber AS VARCHAR) END AS years FROM lineitem""")
def hashed_ids(t):
    """Point ids, cell hashes and the years of budget titles."""
    title = F.when(F.col("l_linenumber") % 3 == 0, "begroting 2018-2020").when(F.col("l_linenumber") % 3 == 1, "raming 2001-2030").otherwise(F.concat(F.lit("jaarrekening "), (2010 + F.col("l_linenumber")).cast("string")))
    return t.lineitem.select("l_orderkey", "l_linenumber", text.point_id(F.col("l_orderkey"), F.col("l_linenumber")).alias("point"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("cell"), F.array_join(F.transform(text.budget_years(title), lambda y: y.cast("string")), ",").alias("years"))


@query("""SELECT o_orderkey, 'Commissie ' || o_orderpriority || ': een twee drie vier vijf zes zeven acht negen tien' AS topic, 'order ' || o_orderkey AS bare FROM orders""")
def section_topics(t):
    title = F.lit("een twee  drie vier vijf zes zeven acht negen tien elf twaalf")
    return t.orders.select("o_orderkey", text.section_topic(title, F.concat(F.lit("Commissie "), F.col("o_orderpriority"), F.lit(" - "), F.col("o_orderdate").cast("string"))).alias("topic"), text.section_topic(F.concat(F.lit("order  "), F.col("o_orderkey").cast("string")), F.lit(None).cast("string")).alias("bare"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS INT) WHEN 1 THEN CAST(event_id % 7 AS INT) END AS score, CASE WHEN event_id % 4 = 0 THEN 'goed' END AS reason, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 2 = 0 AS merged FROM events""")
def repaired_json(t):
    """JSON of a model's answer out of fences and talk, and keys merged over a stored object, the new ones winning."""
    n = F.col("event_id")
    answer = F.when(n % 4 == 0, F.concat(F.lit('```json\n{"score": '), (n % 100).cast("string"), F.lit(', "reason": "goed"}\n```'))).when(n % 4 == 1, F.concat(F.lit('Antwoord: {"score": '), (n % 7).cast("string"), F.lit("} klaar"))).otherwise("geen {json")
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    stored = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("seen"), (n % 2 == 0).cast("string"))
    both = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return t.events.select("event_id", F.get_json_object(body, "$.score").cast("int").alias("score"), F.get_json_object(body, "$.reason").alias("reason"), both["k"].cast("long").alias("k"), (both["seen"] == "true").alias("merged"))


@query("""SELECT l_orderkey, round(exp(sum(ln(1 - l_discount))), 9) AS product, round(max(log2(l_quantity)), 6) AS bits, round(greatest(min(l_tax), 0.01), 6) AS floor_tax FROM lineitem GROUP BY 1""")
def products(t):
    """Products, logarithms and floors."""
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.product(1 - F.col("l_discount")), 9).alias("product"), F.round(F.max(F.log2("l_quantity")), 6).alias("bits"), F.round(F.greatest(F.min("l_tax"), F.lit(0.01)), 6).alias("floor_tax"))
