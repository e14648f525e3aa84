"""Quality rules by distribution divergence (operator 3, DataFrame functions only).

Every text gets a histogram over character classes and one over the common words of each language. The
references are the sums of these histograms over all rows of a language in the corpus. The languages of
COMMON_WORDS have fixed word lists; for every other one, the LEARNED_WORDS most frequent words of all its
rows are its list. A document is judged by its Jensen-Shannon distance (base 2, 0 to 1) to the nearest of the
fixed languages' references and, if it has another language, that one's; for characters and for common
words; each is judged only from a least length on.

Defined cases: null and empty texts have no words and fail the base rule; rows of a null language add to no
reference and are not rejected by distance, as their own language has no reference; if there are no references,
nothing is rejected by distance; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import cut, let

#: Common words of these languages; those of others are learned.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "en": "the of and to in a is that for it as was with be by on not he his at are this but have from or had an they which".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur ne se ce il plus avec son sont ou aux l".split(),
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn".split(),
}
ALL_WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: Character classes in the order of a histogram; the rest of the text is a class of its own.
CLASSES = ("lower", "upper", "digit", "space")

#: Common words that are learned for each other language.
LEARNED_WORDS = 30

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Distances are judged from so many characters and words on.
GUARD_CHARS, GUARD_WORDS = 300, 60
#: Distances over these reject.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.3


def _window_keys(words: str) -> Column:
    """For each 3-word window the low half of its hash, and its place: one long each, without nulls, so that arrays of them sort as primitives."""
    at = lambda i: F.get(F.col(words), i)
    # the last two, of fewer than 3 words, equal no other window
    return F.transform(words, lambda x, i: F.shiftleft(F.xxhash64(x, at(i + 1), at(i + 2)), 32).bitwiseOR(i.cast("bigint")))


def _repeated_words(words: str, ordered: str) -> Column:
    """Words in 3-word windows that occur twice or more. The ordered window keys find the few windows that can be repeated, the words themselves decide."""
    w, keys = F.col(words), F.col(ordered)

    def twins(entries: Column, key) -> Column:
        """The entries of a sorted array whose key stands in it twice."""
        return F.filter(entries, lambda e, j: (key(F.get(entries, j - 1)) == key(e)) | (key(F.get(entries, j + 1)) == key(e)))

    def exact(found: Column) -> Column:
        at = F.transform(found, lambda e: e.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
        texts = F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("key"), i.alias("at")))
        inside = lambda e: F.array(e["at"], e["at"] + 1, e["at"] + 2)
        return F.size(F.array_distinct(F.flatten(F.transform(let(F.sort_array(texts), lambda t: twins(t, lambda e: e["key"])), inside))))

    return let(twins(keys, lambda e: F.shiftright(e, 32)), lambda found: F.when(F.size(found) > 0, exact(found)).otherwise(0)).cast("bigint")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _common_counts(words: Column, listed: Column | None = None) -> Column:
    """How often each of ALL_WORDS (or of the sorted words listed) stands in words: sorted together with one of each, their runs are as long as the counts and one."""
    every = F.array(*[F.lit(x) for x in ALL_WORDS]) if listed is None else listed
    known = F.transform(F.filter(words, lambda x: F.lower(x).isin(ALL_WORDS) if listed is None else F.array_contains(listed, F.lower(x))), F.lower)

    def runs(row: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda i: (i == 0) | (F.get(row, i) != F.get(row, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda at, j: F.coalesce(F.get(s, j + 1), F.size(row)) - at - 1))

    return let(F.sort_array(F.concat(known, every)), runs).cast("array<bigint>")


def learned_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame | None:
    """lang, listed: the sorted LEARNED_WORDS most frequent words of each language without a fixed list; None if there is no such language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS)))
    if rows.select("lang").isEmpty():
        return None
    counts = rows.select("lang", F.explode(F.transform(_split(F.col("text")), F.lower)).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    return cut(counts.withColumn("rank", rank).filter(F.col("rank") <= LEARNED_WORDS).groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("listed")))


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learned: DataFrame | None = None) -> DataFrame:
    """id, lang, the base counts, n_chars, chars (histogram over CLASSES), common (over ALL_WORDS); with learned also own, over its words of the row's language."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    own = []
    if learned is not None:
        rows = rows.join(learned, "lang", "left")
        own = [F.when(F.col("listed").isNotNull(), _common_counts(F.col("words"), F.col("listed"))).alias("own")]
    rows = rows.withColumn("words", _split(F.col("text")))
    rows = rows.withColumn("joined", F.array_join("words", ""))
    rows = rows.withColumns({"ordered": F.sort_array(_window_keys("words")), "rest": F.regexp_replace("joined", r"\p{Ll}+", "")})  # rest: all but spaces and small letters
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda other: F.length(F.regexp_replace("rest", other, ""))
    size, word_chars = F.length("text"), F.length("joined")
    return rows.select(
        "id",
        "lang",
        F.size("words").cast("bigint").alias("n_words"),
        word_chars.cast("bigint").alias("word_chars"),
        left(r"[^#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeated_words("words", "ordered").alias("n_repeat_words"),
        size.cast("bigint").alias("n_chars"),
        F.array(word_chars - F.length("rest"), left(r"\P{Lu}+"), left(r"[^0-9]+"), size - word_chars).cast("array<bigint>").alias("chars"),
        _common_counts(F.col("words")).alias("common"),
        *own,
    )


def _shares(values: list[int], total: int) -> list[float]:
    """values and the rest of total as shares of it."""
    return [v / total for v in [*values, max(0, total - sum(values))]]


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """language -> (character shares, common-word shares), from all rows of the corpus; at most one row for each word list."""
    sums = rows.filter(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(
        F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"),
        *[F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(len(ALL_WORDS))],
    )
    out = {}
    for r in sums.collect():
        if r.n_words and r.n_chars:
            own = [r[f"w{ALL_WORDS.index(w)}"] for w in COMMON_WORDS[r.lang]]
            out[r.lang] = _shares([r[f"c{i}"] for i in range(len(CLASSES))], r.n_chars), _shares(own, r.n_words)
    return out


def learned_references(rows: DataFrame) -> DataFrame:
    """lang, own_chars and own_words: the shares of each language with a learned list, from all its rows."""
    sums = rows.filter("own is not null").groupBy("lang").agg(
        F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"), F.max(F.size("own")).alias("size"),
        F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(len(CLASSES))]).alias("chars"),
        F.array(*[F.coalesce(F.sum(F.get("own", F.lit(i))), F.lit(0)) for i in range(LEARNED_WORDS)]).alias("own"),
    )

    def shares(counts: Column, total: Column) -> Column:
        rest = F.greatest(total - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))
        return F.transform(F.concat(counts, F.array(rest)), lambda x: x / total)

    return sums.select("lang", shares(F.col("chars"), F.col("n_chars")).alias("own_chars"), shares(F.slice("own", F.lit(1), F.col("size")), F.col("n_words")).alias("own_words"))


def js_distance(counts: Column, total: Column, reference: list[float] | Column) -> Column:
    """Square root of the Jensen-Shannon divergence between counts (with the rest of total) and reference."""
    ref = reference if isinstance(reference, Column) else F.array(*[F.lit(float(q)) for q in reference])
    rest = F.greatest(total - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))
    p = F.transform(F.concat(counts, F.array(rest)), lambda x: x / total)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, ref, lambda x, q: term(x, (x + q) / 2) + term(q, (x + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """For each row: id, base counts, base_failed, kept, char_distance and word_distance to the nearest reference (null without one)."""
    learned = learned_words(docs, text_col, lang_col)
    rows = cut(features(docs, id_col, text_col, lang_col, learned))
    refs = references(rows)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    nothing = F.lit(None).cast("double")
    by_char = [js_distance(F.slice("chars", 1, len(CLASSES)), F.col("n_chars"), c) for c, _ in refs.values()]
    by_word = [js_distance(F.array(*[F.get("common", F.lit(ALL_WORDS.index(w))) for w in COMMON_WORDS[lang]]), F.col("n_words"), q) for lang, (_, q) in refs.items()]
    referred = F.col("lang").isin(list(refs)) if refs else F.lit(False)
    if learned is not None:
        rows = rows.join(cut(learned_references(rows)), "lang", "left")
        # null, and passed over by least, where the row's language isn't a learned one
        own = F.col("own").isNotNull()
        by_char.append(F.when(own, js_distance(F.slice("chars", 1, len(CLASSES)), F.col("n_chars"), F.col("own_chars"))))
        by_word.append(F.when(own, js_distance(F.col("own"), F.col("n_words"), F.col("own_words"))))
        referred = referred | own
    near = lambda xs, long: F.when(long, F.least(*xs) if len(xs) > 1 else xs[0]) if xs else nothing
    rows = rows.withColumn("char_distance", near(by_char, F.col("n_chars") >= GUARD_CHARS)).withColumn("word_distance", near(by_word, F.col("n_words") >= GUARD_WORDS))
    far = F.coalesce(referred & (F.col("char_distance") > max_char_distance), F.lit(False)) | F.coalesce(referred & (F.col("word_distance") > max_word_distance), F.lit(False))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(F.col("id").alias(id_col), *counts, base_failed.alias("base_failed"), (~base_failed & ~far).alias("kept"), "char_distance", "word_distance")


def distance(p: list[float], q: list[float]) -> float:
    """js_distance of two share lists, on the driver: for tests and reports."""
    total = sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(p, q, strict=True) if x) + sum(y * math.log2(y / ((x + y) / 2)) for x, y in zip(p, q, strict=True) if y)
    return math.sqrt(max(0.0, total / 2))
