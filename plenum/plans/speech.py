"""Transcripts with times: a turn is a segment, a role its speaker, its length how long it lasts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions import speech
from plenum.functions.text import FUNCTION_WORDS, MONTHS, word_set
from plenum.operators.intervals import aligned
from plenum.operators.relops import distinct_on
from plenum.plans.registry import query
from plenum.plans.values import sql_list

#: Segments follow each other; a user's turn comes after 40 seconds of silence.
SEGMENTS = """t AS (SELECT conv_id, turn, role, text, length(text) / 15.0 AS lasts, CASE WHEN role = 'user' THEN 40 ELSE 1 END AS gap FROM conversations),
s AS (SELECT conv_id, turn, role, text, round(sum(gap + lasts) OVER (PARTITION BY conv_id ORDER BY turn) - lasts, 3) AS start, round(sum(gap + lasts) OVER (PARTITION BY conv_id ORDER BY turn), 3) AS stop FROM t)"""


def segments(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    lasts, gap = F.length("text") / 15.0, F.when(F.col("role") == "user", 40).otherwise(1)
    rows = t.conversations.withColumn("lasts", lasts).withColumn("end_", F.sum(gap + lasts).over(w))
    return rows.select("conv_id", "turn", "role", "text", F.round(F.col("end_") - F.col("lasts"), 3).alias("start"), F.round("end_", 3).alias("stop"))


def merged(rows, gap=2.0):
    """conv_id, first, speaker, n, start, stop: neighbours of one speaker less than gap seconds apart are one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = (F.col("role") == F.lag("role").over(w)) & (F.col("start") - F.lag("stop").over(w) < gap)
    runs = rows.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("k", F.sum("fresh").over(w))
    return runs.groupBy("conv_id", "k").agg(F.min("turn").alias("first"), F.min_by("role", "turn").alias("speaker"), F.count("*").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop")).drop("k")


@query(f"""WITH {SEGMENTS}, x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'assistant' END AS role, start, stop FROM s), f AS (SELECT *, CASE WHEN role = lag(role) OVER w AND start - lag(stop) OVER w < 2 THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM f) SELECT conv_id, min(turn) AS first, arg_min(role, turn) AS speaker, count(*) AS n, min(start) AS start, max(stop) AS stop FROM k GROUP BY conv_id, k""")
def merged_segments(t):
    """Consecutive segments of one speaker under two seconds apart."""
    rows = segments(t).withColumn("role", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("assistant"))
    return merged(rows)


@query(f"""WITH {SEGMENTS}, a AS (SELECT conv_id, turn // 3 AS item, min(start) AS start FROM s GROUP BY 1, 2), e AS (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, item) AS stop FROM a)
SELECT s.conv_id, s.turn, e.item, e.stop FROM s JOIN e ON e.conv_id = s.conv_id AND e.start <= s.start AND (e.stop IS NULL OR s.start < e.stop)""")
def split_by_agenda(t):
    """Items begin with their first segment and end with the next one's begin; each segment lies in one."""
    rows = segments(t)
    items = rows.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("item")).agg(F.min("start").alias("begin"))
    items = items.withColumn("stop", F.lead("begin").over(Window.partitionBy("conv_id").orderBy("begin", "item")))
    inside = (F.col("begin") <= F.col("start")) & (F.col("e.stop").isNull() | (F.col("start") < F.col("e.stop")))
    return rows.select("conv_id", "turn", "start").join(items.alias("e"), "conv_id").filter(inside).select("conv_id", "turn", "item", "stop")


@query(f"""WITH {SEGMENTS} SELECT conv_id, round(avg(CASE WHEN role NOT IN ('', 'system') THEN 1.0 ELSE 0.0 END), 6) AS attributed, round(avg(CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END), 6) AS with_party,
CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(CASE WHEN length(text) > 0 THEN length(text) END), 6) AS mean_chars, round(avg(CASE WHEN len(string_split(trim(text), ' ')) < 10 THEN 1.0 ELSE 0.0 END), 6) AS short_ FROM s GROUP BY 1""")
def segment_quality(t):
    """Attribution and party rates, lengths, and the share of segments under ten words."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    n = F.length("text")
    return t.conversations.groupBy("conv_id").agg(share(~F.col("role").isin("", "system")).alias("attributed"), share(F.col("role") == "assistant").alias("with_party"), F.sum(n).alias("chars"), F.round(F.avg(F.when(n > 0, n)), 6).alias("mean_chars"), share(F.size(F.split(F.trim("text"), " ")) < 10).alias("short_"))


@query("""WITH w AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4)) AS w FROM conversations), d AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4)) AS w FROM benchmark),
c AS (SELECT conv_id, count(*) FILTER (WHERE d.w IS NOT NULL) AS known, count(*) FILTER (WHERE d.w IS NULL) AS other FROM w LEFT JOIN d USING (w) GROUP BY 1) SELECT conv_id, known, other, round(other * 1.0 / nullif(known + other, 0), 6) AS error_rate FROM c""")
def entity_error_rate(t):
    """Tokens of four characters or more that a dictionary lacks, as a share of all."""
    split = lambda df, *keep: df.select(*keep, F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 4)).alias("w"))
    known = split(t.benchmark).distinct().withColumn("there", F.lit(1))
    c = split(t.conversations, "conv_id").join(known, "w", "left").groupBy("conv_id").agg(F.count("there").alias("known"), F.count_if(F.col("there").isNull()).alias("other"))
    return c.select("conv_id", "known", "other", F.round(F.col("other") / F.nullif(F.col("known") + F.col("other"), F.lit(0)), 6).alias("error_rate"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Dat is goed' WHEN 1 THEN '' WHEN 2 THEN 'hum ja' WHEN 3 THEN 'de ' || role || ' zegt ja' ELSE 'de begroting' END AS clean FROM conversations""")
def precleaned_segments(t):
    made = F.when(F.col("turn") % 5 == 0, "*** *** *** ... Dat is, uhm, goed...").when(F.col("turn") % 5 == 1, "ED ED ED .").when(F.col("turn") % 5 == 2, "hum hum hum ja").when(F.col("turn") % 5 == 3, F.concat(F.lit("de "), F.col("role"), F.lit(" ... zegt eh ja"))).otherwise("zeg maar, de begroting")
    return t.conversations.select("conv_id", "turn", speech.precleaned(made).alias("clean"))


@query(f"""WITH {SEGMENTS}, c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'Piet' || chr(97 + CAST(conv_id % 26 AS INT)) WHEN turn % 4 = 3 THEN 'Jansen' END AS called, turn % 4 = 3 AS chair FROM s)
SELECT conv_id, turn, CASE WHEN chair THEN 'Voorzitter' ELSE last_value(called IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS speaker FROM c""")
def inferred_speakers(t):
    """Who speaks, by cues in the text: inline ones hold from the next segment on, others at once; the chair calls, and thanks."""
    name = F.concat(F.lit("Piet"), F.chr((97 + F.col("conv_id") % 26).cast("int")))
    made = F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit(". En dan wethouder "), name, F.lit("."))).when(F.col("turn") % 4 == 3, "Ik geef het woord aan mevrouw Jansen, gaat uw gang").otherwise(F.lower(F.regexp_replace("text", r"[.,]", "")))
    rows = t.conversations.select("conv_id", "turn", made.alias("x"))
    return inferred(rows, "conv_id", "turn", "x").select("conv_id", "turn", "speaker")


def inferred(rows, group, order, text):
    """rows with speaker: the last one called before a segment, unless the segment introduces or is the chair's."""
    w = Window.partitionBy(group).orderBy(order)
    c = speech.cue(F.col(text))
    rows = rows.withColumn("kind", c["kind"]).withColumn("called", c["name"])
    before = F.last("called", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    speaker = F.when(F.col("kind") == "intro", F.col("called")).when(F.col("kind").isin("handover", "standalone", "chair"), "Voorzitter").otherwise(before)
    return rows.withColumn("speaker", speaker).drop("kind", "called")


LEAST_SEGMENTS, SILENCE = 5, 30


def boundaries(rows, least=LEAST_SEGMENTS, silence=SILENCE):
    """conv_id, i, reason of segments where an agenda item begins: a phrase, or a silence before another known speaker; at
    least so many segments after the last one. Sequential within a meeting, so each meeting's few candidates are walked as an array."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    other = (F.col("role") != F.lag("role").over(w)) & ~F.col("role").isin(speech.UNKNOWN)
    reason = F.when(F.col("i") == 0, "start").when(speech.is_transition(F.col("text")), "phrase").when((F.col("start") - F.lag("stop").over(w) >= silence) & other, "silence")
    found = rows.withColumn("reason", reason).filter((F.col("n") >= 2 * least) & F.col("reason").isNotNull())
    each = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "reason"))).alias("c"))
    begin = F.array().cast("array<struct<i:int,reason:string>>")
    far = lambda acc, x: (F.size(acc) == 0) | (x["i"] - F.try_element_at(acc, F.lit(-1))["i"] >= least)
    kept = F.aggregate("c", begin, lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return each.select("conv_id", F.explode(kept).alias("b")).select("conv_id", F.col("b.i").alias("i"), F.col("b.reason").alias("reason"))


@query(f"""WITH RECURSIVE {SEGMENTS}, x AS (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 'Dan komen we bij ' || text ELSE text END AS said FROM s),
d AS (SELECT conv_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, role, said, lag(role) OVER w AS p, start - lag(stop) OVER w AS silent FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, i, CASE WHEN i = 0 THEN 'start' WHEN regexp_matches(said, '(?i){speech.TRANSITION}') THEN 'phrase' WHEN silent >= 30 AND role <> p THEN 'silence' END AS reason FROM d WHERE n >= 4), q AS (SELECT * FROM c WHERE reason IS NOT NULL),
b AS (SELECT conv_id, i, reason FROM q WHERE i = 0 UNION ALL SELECT conv_id, i, reason FROM (SELECT q.conv_id, q.i, q.reason, row_number() OVER (PARTITION BY q.conv_id ORDER BY q.i) AS rn FROM b JOIN q ON q.conv_id = b.conv_id AND q.i >= b.i + 2) WHERE rn = 1)
SELECT conv_id, i, reason FROM b""")
def agenda_boundaries(t):
    """Where agenda items of two segments or more begin in each conversation; a fifth of the turns say so."""
    said = F.when(F.length("text") % 5 == 0, F.concat(F.lit("Dan komen we bij "), F.col("text"))).otherwise(F.col("text"))
    found = boundaries(segments(t).withColumn("text", said), least=2)
    return found.select("conv_id", F.col("i").cast("long").alias("i"), "reason")


def time_chunks(rows, minutes=12, overlap=2):
    """conv_id, chunk, turn: chunks of so many minutes from their first segment on, which take the last ones of the chunk before along."""

    def chunked(key, frame):
        frame = frame.sort_values("turn")
        out, now, begin, k = [], [], None, 0
        for turn, start in zip(frame["turn"], frame["start"], strict=True):
            begin = start if begin is None else begin
            if start - begin >= minutes * 60 and now:
                out += [(key[0], k, x) for x, _ in now]
                now = [(x, s) for x, s in now if s >= start - overlap * 60]
                begin, k = (now[0][1] if now else start), k + 1
            now.append((turn, start))
        out += [(key[0], k, x) for x, _ in now]
        import pandas as pd

        return pd.DataFrame(out, columns=["conv_id", "chunk", "turn"])

    return rows.select("conv_id", "turn", "start").groupBy("conv_id").applyInPandas(chunked, "conv_id long, chunk long, turn long")


@query()
def time_chunked(t):
    """One-minute chunks with 20 seconds of overlap; a chunk's begin depends on those before it, so each conversation is walked."""
    return time_chunks(segments(t), 1, 1 / 3)


@query(f"""WITH {SEGMENTS}, m AS (SELECT conv_id, count(*) AS n, avg(CASE WHEN role <> 'system' THEN 1.0 ELSE 0.0 END) AS named, avg(length(text)) AS chars, count(DISTINCT turn // 3) AS items, avg(CASE WHEN regexp_matches(trim(text), '^.{{20,}}[^.!?:;)"\\s]$') THEN 1.0 ELSE 0.0 END) AS cut FROM s GROUP BY 1),
q AS (SELECT conv_id, round(0.10 * least(n / 50.0, 1) + 0.30 * named + 0.20 * least(chars / 200.0, 1) + 0.15 + 0.15 * least(items / 3.0, 1) + 0.10 * (1 - cut), 3) AS score FROM m)
SELECT conv_id, score, CASE WHEN score >= 0.7 THEN 'auto_approved' WHEN score < 0.4 THEN 'auto_rejected' ELSE 'pending' END AS status FROM q""")
def transcript_quality(t):
    """A weighted score of size, attribution, density, items and completeness, and the review it asks for."""
    cut = F.trim("text").rlike(r'^.{20,}[^.!?:;)"\s]$')
    m = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("role") != "system", 1.0).otherwise(0.0)).alias("named"), F.avg(F.length("text")).alias("chars"), F.count_distinct(F.floor(F.col("turn") / 3)).alias("items"), F.avg(F.when(cut, 1.0).otherwise(0.0)).alias("cut"))
    most = lambda x: F.least(x, F.lit(1.0))
    score = F.round(0.10 * most(F.col("n") / 50) + 0.30 * F.col("named") + 0.20 * most(F.col("chars") / 200) + 0.15 + 0.15 * most(F.col("items") / 3) + 0.10 * (1 - F.col("cut")), 3)
    return m.select("conv_id", score.alias("score")).withColumn("status", F.when(F.col("score") >= 0.7, "auto_approved").when(F.col("score") < 0.4, "auto_rejected").otherwise("pending"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'known' WHEN role = 'assistant' THEN 'role' ELSE 'unknown' END AS presence FROM conversations""")
def speaker_presence(t):
    """Whether a speaker is in the register, has a role's name, or is unknown."""
    name = F.when(F.col("role") == "user", "A. van Jansen").when(F.col("role") == "assistant", "de voorzitter").otherwise("Stem")
    parts = word_set(name)
    return t.conversations.select("conv_id", "turn", F.when(F.array_contains(parts, "jansen"), "known").when(name.rlike("(?i)voorzitter|wethouder|griffier"), "role").otherwise("unknown").alias("presence"))


# summaries against their sources

KEEP, FLOOR, GROUNDED, SHORT, STRIP = 0.4, 0.15, 0.80, 12, 0.30


def verified(sentences, chunks):
    """doc_id, pos, class of each sentence by its best likeness to a chunk of its document: verified from KEEP on; from FLOOR on, a paraphrase
    if it has no facts or GROUNDED of them stand in the chunks; else a hallucination. Under SHORT characters it is too short to tell."""
    from plenum.functions.text import facts

    words = chunks.select("doc_id", "chunk", F.explode(word_set(F.col("content"))).alias("w"))
    own = sentences.withColumn("ws", word_set(F.col("sentence")))
    hits = own.select("doc_id", "pos", F.size("ws").alias("n"), F.explode("ws").alias("w")).join(words, ["doc_id", "w"]).groupBy("doc_id", "pos", "chunk").agg((F.count("*") / F.max("n")).alias("score"))
    best = hits.groupBy("doc_id", "pos").agg(F.max("score").alias("score"))
    told = own.select("doc_id", "pos", "sentence", F.explode_outer(facts(F.col("sentence"))).alias("fact")).join(chunks.select("doc_id", F.lower("content").alias("low")), "doc_id", "left")
    per_fact = told.groupBy("doc_id", "pos", "fact").agg(F.bool_or(F.col("low").contains(F.lower("fact"))).alias("there"))
    share = per_fact.groupBy("doc_id", "pos").agg(F.avg(F.when(F.col("fact").isNotNull(), F.when(F.col("there"), 1.0).otherwise(0.0))).alias("grounded"))
    rows = sentences.join(best, ["doc_id", "pos"], "left").join(share, ["doc_id", "pos"], "left")
    score = F.coalesce("score", F.lit(0.0))
    kind = F.when(F.length("sentence") < SHORT, "too_short").when(score >= KEEP, "verified").when((score >= FLOOR) & (F.coalesce("grounded", F.lit(1.0)) >= GROUNDED), "paraphrase").otherwise("hallucination")
    return rows.select("doc_id", "pos", kind.alias("kind"), F.round(score, 6).alias("score"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


#: Facts as SQL: numbers, dates and names that don't begin a sentence, lowered.
FACTS = f"""list_distinct(list_concat(regexp_extract_all(lower(sentence), '\\d[\\d.,]*\\d|\\d+'), list_concat(regexp_extract_all(lower(sentence), '\\d{{1,2}}\\s+(?:{'|'.join(MONTHS)})\\s+\\d{{4}}'),
list_transform(list_filter(list_transform(regexp_split_to_array(trim(sentence), '\\s+')[2:], lambda w: regexp_replace(w, '[^\\pL\\pN_-]', '', 'g')), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains({sql_list(FUNCTION_WORDS)}, lower(w))), lambda w: lower(w)))))"""


@query(f"""WITH c AS (SELECT conv_id AS doc_id, turn AS chunk, text AS content, {WORDS.format(x='text')} AS ws FROM conversations), k AS (SELECT conv_id AS doc_id, string_agg(lower(text), chr(10)) AS low FROM conversations GROUP BY 1),
q AS (SELECT conv_id AS doc_id, turn AS pos, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN 'Kort.' WHEN 2 THEN 'zzz qqq www vvv uuu Xenonia 9999' WHEN 3 THEN text || ' aa1 bb1 cc1 dd1 ee1 ff1 gg1'
WHEN 4 THEN 'Al met al zo besloten dan maar ' || left(text, 40) ELSE 'Volgens Xenonia op 5 maart 2024 al met al zo besloten ' || left(text, 60) END AS sentence FROM conversations),
w AS (SELECT doc_id, pos, sentence, {WORDS.format(x='sentence')} AS ws, {FACTS} AS facts FROM q), b AS (SELECT w.doc_id, pos, any_value(sentence) AS sentence, any_value(facts) AS facts, max(len(list_intersect(w.ws, c.ws)) * 1.0 / len(w.ws)) AS score FROM w JOIN c USING (doc_id) GROUP BY 1, 2),
g AS (SELECT b.*, CASE WHEN len(facts) = 0 THEN 1 ELSE len(list_filter(facts, lambda f: contains(low, f))) * 1.0 / len(facts) END AS grounded FROM b JOIN k USING (doc_id))
SELECT doc_id, pos, CASE WHEN length(sentence) < 12 THEN 'too_short' WHEN score >= 0.4 THEN 'verified' WHEN score >= 0.15 AND grounded >= 0.8 THEN 'paraphrase' ELSE 'hallucination' END AS kind, round(score, 6) AS score FROM g""")
def verified_sentences(t):
    """Sentences against the chunks of their document: as they stand there, in other words with and without facts of the source, and made up."""
    n = F.col("turn") % 6
    said = F.when(n == 0, F.col("text")).when(n == 1, "Kort.").when(n == 2, "zzz qqq www vvv uuu Xenonia 9999").when(n == 3, F.concat("text", F.lit(" aa1 bb1 cc1 dd1 ee1 ff1 gg1")))
    said = said.when(n == 4, F.concat(F.lit("Al met al zo besloten dan maar "), F.left("text", F.lit(40)))).otherwise(F.concat(F.lit("Volgens Xenonia op 5 maart 2024 al met al zo besloten "), F.left("text", F.lit(60))))
    own = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), said.alias("sentence"))
    chunks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.col("text").alias("content"))
    return verified(own, chunks)


# chunks and tiers

@query("""SELECT doc_id, CASE WHEN length(text) < 1000 THEN 'full_text' WHEN length(text) <= 2500 THEN 'quote' WHEN length(text) <= 50000 THEN 'recursive' ELSE 'sections' END AS tier FROM documents""")
def chunk_tiers(t):
    n = F.length("text")
    return t.documents.select("doc_id", F.when(n < 1000, "full_text").when(n <= 2500, "quote").when(n <= 50000, "recursive").otherwise("sections").alias("tier"))


@query()
def first_sentences(t):
    """The first three sentences of every document."""
    from plenum.functions.text import sentences

    return t.documents.select("doc_id", F.array_join(F.slice(sentences(F.col("text")), 1, 3), " ").alias("excerpt"))


def split_by_separators(text: str, size: int, overlap: int, marks=("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most size characters, split at the first mark that a text has and joined up again, each beginning with the end of the one before."""
    mark = next(m for m in marks if m == "" or m in text)
    parts = list(text) if mark == "" else text.split(mark)
    finer = marks[marks.index(mark) + 1 :]
    pieces: list[str] = []
    for p in parts:
        pieces += [p] if len(p) <= size or not finer else split_by_separators(p, size, 0, finer)
    out: list[str] = []
    now: list[str] = []
    for p in pieces:
        if now and len(mark.join([*now, p])) > size:
            out.append(mark.join(now))
            while now and (len(mark.join(now)) > overlap or len(mark.join([*now, p])) > size):
                now.pop(0)
        now.append(p)
    if now:
        out.append(mark.join(now))
    return [x for x in out if x.strip()]


@query()
def separator_chunks(t):
    """Pieces of at most 7,500 characters with up to 600 of the one before."""

    def split(batches):
        for b in batches:
            rows = [(i, k, len(x)) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text for k, x in enumerate(split_by_separators(text, 7500, 600))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["doc_id", "piece", "size"])

    return t.documents.select("doc_id", "text").mapInArrow(split, "doc_id long, piece long, size long")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (SELECT doc_id, i, line, sum(CASE WHEN i = 1 OR i % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, section, min(i) AS first, arg_min(line, i) AS title, CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM h GROUP BY 1, 2""")
def section_split(t):
    """Sections that begin with a headline (every tenth line here), titled by their first line."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    head = F.when((F.col("i") == 1) | (F.col("i") % 10 == 0), 1).otherwise(0)
    rows = lines.withColumn("section", F.sum(head).over(Window.partitionBy("doc_id").orderBy("i")))
    return rows.groupBy("doc_id", "section").agg(F.min("i").cast("long").alias("first"), F.min_by("line", "i").alias("title"), F.sum(F.length("line") + 1).alias("chars"))


@query("""SELECT doc_id, n FROM (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn <= 3""")
def fragments_per_source(t):
    """The three longest documents of each source."""
    from plenum.operators.relops import top_n

    return top_n(t.documents.select("source", "doc_id", F.length("text").alias("n")), ["source"], [F.desc("n"), F.col("doc_id")], 3).select("doc_id", "n")


@query("""SELECT conv_id, arg_min(text, turn) AS opening, count(*) AS n FROM conversations GROUP BY 1""")
def first_turns(t):
    first = distinct_on(t.conversations, ["conv_id"], [F.col("turn")]).select("conv_id", F.col("text").alias("opening"))
    return first.join(t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")


@query(f"""WITH {SEGMENTS}, spoken AS (SELECT conv_id, role || turn AS speaker, start + 2.5 AS start, stop - CASE WHEN turn % 2 = 0 THEN 6 ELSE 0 END AS stop FROM s WHERE turn % 3 <> 2),
met AS (SELECT s.conv_id, s.turn, p.speaker, p.start, p.start <= s.start AND s.start < p.stop AS holds, least(s.stop, p.stop) - greatest(s.start, p.start) AS overlap FROM s JOIN spoken p ON p.conv_id = s.conv_id),
best AS (SELECT conv_id, turn, arg_min(speaker, (CASE WHEN holds THEN 0 ELSE 1 END, CASE WHEN holds THEN 0 ELSE -overlap END, start, speaker)) AS speaker FROM met WHERE holds OR overlap >= 1 GROUP BY 1, 2)
SELECT s.conv_id, s.turn, b.speaker FROM s LEFT JOIN best b ON b.conv_id = s.conv_id AND b.turn = s.turn""")
def aligned_speakers(t):
    """Captions against speakers that a portal has, which begin later and end earlier: who holds a caption's begin, else who overlaps most."""
    s = segments(t).select("conv_id", "turn", "role", "start", "stop")
    spoken = s.filter("turn % 3 != 2").select("conv_id", F.concat("role", F.col("turn").cast("string")).alias("speaker"), (F.col("start") + 2.5).alias("start"), (F.col("stop") - F.when(F.col("turn") % 2 == 0, 6).otherwise(0)).alias("stop"))
    return aligned(s, spoken, ["conv_id"], "speaker").select("conv_id", "turn", "speaker")
