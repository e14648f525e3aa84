"""Whole dossiers out of joins: what parties did in minutes, chunks enriched by all extractors, motions traced, meetings in full, budgets searched."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions.positions import AREAS, EVIDENCE, IMPLIED, OTHERWISE, PARTY, SPANS, STANCES, VOTES, implied, positions
from plenum.functions.text import motion_number, section_topic, title_outcome, vote_counts, vote_outcome
from plenum.operators.entities import dictionary_hits, names_in_order
from plenum.operators.relops import spread, top_n
from plenum.operators.shared import written
from plenum.plans.registry import query
from plenum.plans.values import sql_list

WORDS = sorted({w for ws in AREAS.values() for w in ws})
#: Minutes: what was really said, by parties, about a word of an area; a sixth says nothing of them.
MINUTES = f"""minutes AS (SELECT conv_id * 1000 + turn AS k, replace(replace(text, '(', ' '), ';', ',') AS t, {sql_list(WORDS)}[(conv_id + turn) % {len(WORDS)} + 1] AS word, turn % 6 AS v FROM conversations),
m AS (SELECT k, CASE v WHEN 0 THEN 'Mevrouw A (GroenLinks-fractie): over ' || word || ' ' || t || chr(10) || 'De heer B (PvdA): ' || t WHEN 1 THEN 'Er is een motie over ' || word || ' van de PvdA ' || t || '. Einde' WHEN 2 THEN 'Dan een vraag van GroenLinks over ' || word || ' ' || t
WHEN 3 THEN 'Voor: VVD, GroenLinks over ' || word || ' ' || t || '; tegen: D66; onthouden: pvda' || chr(10) || 'Tegen: PvdA ' || t WHEN 4 THEN 'GL-fractie, bij monde van C: ' || word || ' ' || t ELSE t END AS text FROM minutes)"""


def minutes(t):
    """k, text of the minutes that MINUTES makes."""
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), ((F.col("conv_id") + F.col("turn")) % len(WORDS)).cast("int"))
    said, v = F.replace(F.replace("text", F.lit("("), F.lit(" ")), F.lit(";"), F.lit(",")), F.col("turn") % 6
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    made = (
        F.when(v == 0, text("Mevrouw A (GroenLinks-fractie): over ", word, " ", said, "\nDe heer B (PvdA): ", said))
        .when(v == 1, text("Er is een motie over ", word, " van de PvdA ", said, ". Einde"))
        .when(v == 2, text("Dan een vraag van GroenLinks over ", word, " ", said))
        .when(v == 3, text("Voor: VVD, GroenLinks over ", word, " ", said, "; tegen: D66; onthouden: pvda\nTegen: PvdA ", said))
        .when(v == 4, text("GL-fractie, bij monde van C: ", word, " ", said))
        .otherwise(said)
    )
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), made.alias("text"))


def _all(rx: str, group: int = 1) -> str:
    return f"regexp_extract_all(text, '{rx}', {group})"


AREA = "CASE " + " ".join(f"WHEN regexp_matches(lower(said), '{'|'.join(ws)}') THEN '{a.capitalize()}'" for a, ws in AREAS.items()) + " ELSE 'Overig' END"
SAID = " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, NULL AS direction, list_transform({' || '.join(_all(rx) for rx in rxs)}, lambda x: left(x, {n})) AS said FROM m" for kind, (rxs, n) in SPANS.items())


@query(f"""WITH {MINUTES}, s AS ({SAID}), u AS (SELECT k, kind, unnest(range(1, len(said) + 1)) AS place, NULL AS direction, unnest(said) AS said FROM s
UNION ALL SELECT k, 'stemming', unnest(range(1, len({_all(VOTES)}) + 1)), upper(unnest({_all(VOTES)})), left(unnest({_all(VOTES, 2)}), 100) FROM m)
SELECT k, kind, place, direction, said, {AREA} AS area FROM u""")
def party_positions(t):
    """Statements, motions, questions and votes of parties in minutes, each with its policy area."""
    return positions(spread(minutes(t)), "k", "text")


@query(f"""WITH {MINUTES}, d AS (SELECT k, text, CASE WHEN contains(lower(text), 'motie') THEN 'initiatiefvoorstel' ELSE 'raadsvoorstel' END AS soort, text AS said FROM m WHERE k % 5 <> 0), p AS (SELECT k, soort, {AREA} AS area FROM d),
own AS (SELECT area, count(*) AS n FROM p WHERE soort = 'initiatiefvoorstel' GROUP BY 1), theirs AS (SELECT area, count(*) AS n FROM p WHERE soort = 'raadsvoorstel' GROUP BY 1)
SELECT p.k, p.soort, p.area, CASE p.soort WHEN 'raadsvoorstel' THEN 'College B&W' ELSE 'Raadslid/fractie' END AS submitter, CAST(coalesce(CASE p.soort WHEN 'raadsvoorstel' THEN own.n ELSE theirs.n END, 0) AS BIGINT) AS same_area, CASE WHEN coalesce(CASE p.soort WHEN 'raadsvoorstel' THEN own.n ELSE theirs.n END, 0) > 0 THEN 0.5 ELSE 0.0 END AS alignment FROM p LEFT JOIN own USING (area) LEFT JOIN theirs USING (area)""")
def proposals_by_area(t):
    """Proposals of the executive and of the council with their areas, and how many of the other side have the same: pairs are counted, not made."""
    from plenum.functions.positions import area

    text = F.col("text")
    kind = F.when(F.lower(text).contains("motie"), "initiatiefvoorstel").otherwise("raadsvoorstel")
    p = minutes(t).filter("k % 5 != 0").select("k", kind.alias("soort"), area(text).alias("area"))
    n = p.groupBy("area").agg(F.count_if(F.col("soort") == "initiatiefvoorstel").alias("own"), F.count_if(F.col("soort") == "raadsvoorstel").alias("theirs"))
    same = F.when(F.col("soort") == "raadsvoorstel", F.col("own")).otherwise(F.col("theirs"))
    who = F.when(F.col("soort") == "raadsvoorstel", "College B&W").otherwise("Raadslid/fractie")
    return p.join(n, "area").select("k", "soort", "area", who.alias("submitter"), same.alias("same_area"), F.when(same > 0, 0.5).otherwise(0.0).alias("alignment"))


FIRST = lambda table, other: "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{rx}') THEN '{name}'" for name, rx in table) + f" ELSE '{other}' END"


@query(f"""WITH {MINUTES}, a AS (SELECT unnest({sql_list(IMPLIED)}) AS area), f AS (SELECT k, text, area, regexp_extract(text, '(?is)(.{{0,50}}?\\b' || area || '\\w{{0,50}}.{{0,150}})', 1) AS c FROM m, a WHERE contains(lower(text), area) AND regexp_matches(text, '{PARTY}')),
s AS (SELECT *, CASE WHEN length(c) > 20 THEN c ELSE left(text, 200) END AS snippet FROM f)
SELECT k, upper(left(area, 1)) || substr(area, 2) AS area, {FIRST(EVIDENCE, 'uitspraak')} AS evidence, {FIRST(STANCES, OTHERWISE)} || area AS position, left(snippet, 150) AS context, CASE WHEN length(snippet) > 200 THEN 'STERK' WHEN length(snippet) > 100 THEN 'MATIG' ELSE 'ZWAK' END AS strength FROM s""")
def implied_positions(t):
    """Positions of the executive that minutes imply, for each area that they name together with the parties."""
    return implied(spread(minutes(t)), "k", "text")


#: A chunk is an order; its document's name and text say what the order's columns do.
CHUNKS = """c AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Motie over ' || p_type || ' ' || p_brand WHEN 1 THEN 'Notulen raad ' || p_type ELSE 'Brief ' || p_brand END AS name, o_orderkey % 3 AS v, o_orderstatus AS s, o_custkey AS a, p_size AS b, p_type, p_brand, o_orderkey % 4 AS w
FROM orders LEFT JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""


@query(f"""WITH {CHUNKS} SELECT k, 'Commissie ' || a % 9 || ': ' || name AS topic, CASE v WHEN 0 THEN p_type || ' ' || p_brand || ',' || p_brand WHEN 1 THEN CASE WHEN p_type = 'PROMO' THEN 'Promotie' ELSE '' END ELSE p_brand END AS entities,
CASE WHEN v = 1 THEN CASE s WHEN 'F' THEN 'aangenomen' WHEN 'O' THEN 'verworpen' END END AS outcome, CASE WHEN v = 1 AND s IN ('F', 'O') THEN a % 30 END AS voor, CASE WHEN v = 1 AND s IN ('F', 'O') THEN b END AS tegen, CASE WHEN w = 2 THEN 'M2023-' || (100 + a % 800) END AS number FROM c""")
def enriched_chunks(t):
    """One row for each chunk with all that rules find in it: topic, key entities of its name, outcome and votes (minutes only), the motion's number."""
    n = t.part.agg(F.count("*").alias("parts"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    c = t.orders.join(F.broadcast(n)).join(t.part, F.col("o_orderkey") % F.col("parts") == F.col("p_partkey"), "left")
    v, number = F.col("o_orderkey") % 3, F.when(F.col("o_orderkey") % 4 == 2, text(" Motie nr. M2023-", (100 + F.col("o_custkey") % 800).cast("string"))).otherwise("")
    name = F.when(v == 0, text("Motie over ", F.col("p_type"), " ", F.col("p_brand"))).when(v == 1, text("Notulen raad ", F.col("p_type"))).otherwise(text("Brief ", F.col("p_brand")))
    done = F.when(F.col("o_orderstatus") == "F", "aangenomen").when(F.col("o_orderstatus") == "O", "verworpen").otherwise("besproken")
    said = text("De motie is met ", (F.col("o_custkey") % 30).cast("string"), " stemmen voor en ", F.col("p_size").cast("string"), " stemmen tegen ", done, ".", number)
    rows = written(c.select(F.col("o_orderkey").alias("k"), name.alias("name"), text("Commissie ", (F.col("o_custkey") % 9).cast("string"), " - 3 mei").alias("meeting"), said.alias("text")))
    known = t.part.select(F.concat_ws(" ", "p_type", "p_brand").alias("term")).union(t.part.select("p_brand")).distinct().withColumn("name", F.col("term"))
    known = known.unionByName(t.part.filter("p_type = 'PROMO'").limit(1).select(F.lit("raad promo").alias("term"), F.lit("Promotie").alias("name")))
    named = names_in_order(dictionary_hits(rows, "k", "name", known), "k").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("entities"))
    outcome = F.when(F.lower("name").contains("notulen"), vote_outcome(F.col("text")))
    votes = F.when(outcome.isNotNull(), vote_counts(F.col("text")))
    found = rows.select("k", section_topic(F.col("name"), F.col("meeting")).alias("topic"), outcome.alias("outcome"), votes.alias("votes"), motion_number(F.col("text")).alias("number"))
    return found.join(named, "k", "left").select("k", "topic", F.coalesce("entities", F.lit("")).alias("entities"), "outcome", F.col("votes.voor").alias("voor"), F.col("votes.tegen").alias("tegen"), "number")


@query("""WITH m AS (SELECT o_orderkey AS motion, o_custkey AS meeting, 'Motie ' || o_orderpriority || CASE o_orderstatus WHEN 'F' THEN ' aangenomen' WHEN 'O' THEN ' verworpen' ELSE '' END AS name, CAST(o_orderdate AS DATE) AS d FROM orders),
i AS (SELECT DISTINCT l_orderkey AS motion, s_name, CASE WHEN s_acctbal >= 0 THEN n_name END AS party FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey),
who AS (SELECT motion, string_agg(s_name || coalesce(' (' || party || ')', ''), ', ' ORDER BY s_name) AS submitters, count(*) AS n FROM i GROUP BY 1),
paths AS (SELECT motion, count(*) AS paths FROM (SELECT DISTINCT motion, party FROM i WHERE party IS NOT NULL) GROUP BY 1),
sib AS (SELECT a.motion, b.motion AS other, row_number() OVER (PARTITION BY a.motion ORDER BY b.name, b.motion) AS rn FROM m a JOIN m b ON a.meeting = b.meeting AND a.motion <> b.motion),
sibs AS (SELECT motion, string_agg(CAST(other AS VARCHAR), ',' ORDER BY rn) AS related FROM sib WHERE rn <= 12 GROUP BY 1)
SELECT m.motion, name, CAST(d AS VARCHAR) AS day, CASE WHEN name LIKE '%aangenomen' THEN 'aangenomen' WHEN name LIKE '%verworpen' THEN 'verworpen' ELSE 'onbekend' END AS outcome, coalesce(submitters, '') AS submitters, coalesce(n, 0) AS n_submitters, coalesce(paths, 0) AS parties, coalesce(related, '') AS related
FROM m LEFT JOIN who USING (motion) LEFT JOIN paths USING (motion) LEFT JOIN sibs USING (motion)""")
def motion_trace(t):
    """Every motion as one row: header, outcome out of its title, submitters with the party that a register gives them, how many parties that leads to, and up to twelve
    documents of its meeting. Of a meeting the first thirteen are enough for that, so its documents don't meet in pairs."""
    status = F.when(F.col("o_orderstatus") == "F", " aangenomen").when(F.col("o_orderstatus") == "O", " verworpen").otherwise("")
    m = t.orders.select(F.col("o_orderkey").alias("motion"), F.col("o_custkey").alias("meeting"), F.concat(F.lit("Motie "), "o_orderpriority", status).alias("name"), F.to_date("o_orderdate").alias("d"))
    register = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") >= 0, F.col("n_name")).alias("party"))
    i = t.lineitem.select(F.col("l_orderkey").alias("motion"), "l_suppkey").distinct().join(register, F.col("l_suppkey") == F.col("s_suppkey")).select("motion", "s_name", "party").distinct()
    shown = F.concat("s_name", F.coalesce(F.concat(F.lit(" ("), "party", F.lit(")")), F.lit("")))
    who = i.groupBy("motion").agg(F.array_sort(F.collect_list(F.struct("s_name", shown.alias("x")))).alias("xs"), F.count("*").alias("n_submitters"), F.count_distinct("party").alias("parties"))
    ranked_ = top_n(m.select("meeting", F.col("motion").alias("other"), "name"), ["meeting"], [F.col("name"), F.col("other")], 13)
    first = ranked_.groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("first"))
    found = m.join(who, "motion", "left").join(first, "meeting")
    related = F.slice(F.transform(F.filter("first", lambda x: x["other"] != F.col("motion")), lambda x: x["other"].cast("string")), 1, 12)
    submitters = F.coalesce(F.array_join(F.transform("xs", lambda x: x["x"]), ", "), F.lit(""))
    zero = F.lit(0).cast("long")
    return found.select("motion", "name", F.col("d").cast("string").alias("day"), title_outcome(F.col("name")).alias("outcome"), submitters.alias("submitters"), F.coalesce("n_submitters", zero).alias("n_submitters"), F.coalesce("parties", zero).alias("parties"), F.array_join(related, ",").alias("related"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, p_name, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT l_orderkey, string_agg(l_linenumber || '. ' || p_name || CASE l_returnflag WHEN 'A' THEN ' [besluit]' ELSE '' END, '; ' ORDER BY rn) AS agenda, count(*) AS items, count(*) FILTER (WHERE l_returnflag = 'A') AS decisions FROM l GROUP BY 1)
SELECT o_orderkey, c_name AS committee, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, coalesce(agenda, '') AS agenda, coalesce(items, 0) AS items, coalesce(decisions, 0) AS decisions,
CAST(lag(o_orderkey) OVER w AS BIGINT) AS previous, CAST(lead(o_orderkey) OVER w AS BIGINT) AS next FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN b ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def meeting_dossier(t):
    """Every meeting in full: its committee and day, its agenda with decisions, and the committee's meetings before and after it."""
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    item = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), "p_name", F.when(F.col("l_returnflag") == "A", " [besluit]").otherwise(""))
    items = named.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("x")))).alias("xs"), F.count("*").alias("items"), F.count_if(F.col("l_returnflag") == "A").alias("decisions"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    m = t.orders.withColumns({"previous": F.lag("o_orderkey").over(w), "next": F.lead("o_orderkey").over(w)}).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    found = m.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = F.lit(0).cast("long")
    agenda = F.coalesce(F.array_join(F.transform("xs", lambda x: x["x"]), "; "), F.lit(""))
    return found.select("o_orderkey", F.col("c_name").alias("committee"), F.to_date("o_orderdate").cast("string").alias("day"), agenda.alias("agenda"), F.coalesce("items", zero).alias("items"), F.coalesce("decisions", zero).alias("decisions"), "previous", "next")


#: A question for each brand and year, and one that asks why; lines of a brand are its budget lines, documents have the years of their orders.
FINANCIAL = """y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), b AS (SELECT DISTINCT p_brand FROM part), asked AS (SELECT p_brand || ' begroting ' || (y + 20) AS text, p_brand, y, false AS why FROM b, y UNION ALL SELECT 'waarom ' || p_brand || ' in ' || (y + 20), p_brand, y, true FROM b, y),
lines AS (SELECT p_brand, year(o_orderdate) AS y, l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
docs AS (SELECT doc_id, year(o_orderdate) AS y, length(text) / 40000.0 AS score, source FROM documents JOIN orders ON o_orderkey = doc_id)"""


@query(f"""WITH {FINANCIAL}, exact AS (SELECT text, 0 AS stage, l_orderkey AS id, l_linenumber AS part, CAST(amount AS DOUBLE) AS score, row_number() OVER (PARTITION BY text ORDER BY amount DESC, l_orderkey, l_linenumber) AS rn FROM asked a JOIN lines l ON a.p_brand = l.p_brand AND a.y = l.y WHERE NOT why),
found AS (SELECT text, CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 2 END AS stage, doc_id AS id, 0 AS part, round(score, 6) AS score, row_number() OVER (PARTITION BY text, source IN ('src1', 'src2') ORDER BY score DESC, doc_id) AS rn FROM asked JOIN docs USING (y) WHERE score >= 0.05 OR source NOT IN ('src1', 'src2')),
u AS (SELECT * FROM exact WHERE rn <= 10 UNION ALL SELECT * FROM found WHERE rn <= 10) SELECT text, id, part, stage, score, row_number() OVER (PARTITION BY text ORDER BY stage, score DESC, id, part) AS place FROM u QUALIFY place <= 12""")
def financial_search(t):
    """Budget questions: the lines of the programme and year that a question names come first (unless it asks for reasons), then tables above a floor, then texts; all
    of documents of that budget year. Twelve rows a question."""
    year = lambda c: F.year(c).alias("y")
    brands, years = t.part.select("p_brand").distinct(), t.orders.select(year("o_orderdate")).distinct()
    pairs = brands.join(years)  # names of programmes by years: the questions
    text = F.explode(F.array(F.concat("p_brand", F.lit(" begroting "), (F.col("y") + 20).cast("string")), F.concat(F.lit("waarom "), "p_brand", F.lit(" in "), (F.col("y") + 20).cast("string"))))
    asked = pairs.select(text.alias("text"))
    jaar = F.regexp_extract("text", r"\b(20[12]\d)\b", 1).cast("int")
    programme = F.trim(F.regexp_replace(F.regexp_replace("text", r"(?i)\b(20[12]\d|begroting|budget|lasten|baten|saldo|kosten|subsidie|bezuiniging)\b", ""), r"\s+", " "))
    why = F.col("text").rlike(r"(?i)\b(waarom|toelichting|reden|uitleg|achtergrond|motivatie|context|verklaring)\b")
    asked = asked.select("text", (jaar - 20).alias("y"), F.when(~why & (F.length(programme) >= 3), programme).alias("programme"))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select("p_brand", year("o_orderdate"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), F.col("l_extendedprice").cast("decimal(18,2)").alias("score"))
    # of lines and documents only the best of each programme or year can be shown, so questions meet those
    best_lines = top_n(lines, ["p_brand", "y"], [F.desc("score"), F.col("id"), F.col("part")], 10)
    exact = asked.join(best_lines, (F.col("programme") == F.col("p_brand")) & (asked["y"] == best_lines["y"])).select("text", F.lit(0).alias("stage"), "id", "part", F.col("score").cast("double").alias("score"))
    table = F.col("source").isin("src1", "src2")
    docs = t.documents.join(t.orders, F.col("doc_id") == F.col("o_orderkey")).select("doc_id", year("o_orderdate"), (F.length("text") / 40000.0).alias("score"), F.when(table, 1).otherwise(2).alias("stage"))
    best_docs = top_n(docs.filter((F.col("stage") == 2) | (F.col("score") >= 0.05)), ["y", "stage"], [F.desc("score"), F.col("doc_id")], 10)
    found = asked.join(best_docs, "y").select("text", "stage", F.col("doc_id").alias("id"), F.lit(0).alias("part"), F.round("score", 6).alias("score"))
    return top_n(exact.unionByName(found), ["text"], [F.col("stage"), F.desc("score"), F.col("id"), F.col("part")], 12, "place").select("text", "id", "part", "stage", "score", "place")
