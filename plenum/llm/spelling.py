"""Spelling variants grouped by PartEnum signatures over letters (operator 13).

1. Words. Each task counts the runs of letters of its whole texts and adds up what it has counted before a shuffle does.
2. Signatures. A word is the multiset of its letters: a binary vector with a place for each letter's first, second ...
   occurrence. Words that are one edit apart differ in two places at most. The places are dealt into PARTS = 3 parts, so
   such words are equal in one part at least, and each part enumerated alone is a signature. A pair belongs to the band
   of its shorter word, so a word signs in the band of its length and in the next lower one. As short words
   have few letters in a part, a signature also holds what an edit leaves alone: it falls into one third of the
   word, and the other two are equal.
3. Equi-join of signatures, and the exact test. A pair is met at each signature that it shares, and taken at the
   first one only, so that no pair has to be made distinct.
4. Forms. A word's form is near and has FACTOR times its count at least, so forms make up trees of a depth of log2 of the
   largest count; roots are found by doubling the steps.

Defined cases: null and empty texts have no words; rows with equal ids are counted each; a null id is written as nothing;
runs and texts may be of any length; a word without a near word has n_near 0, and its root is itself; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, quoted

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: An occurrence whose crc32 this divides loses a code point.
DAMAGED = 97
LENGTH, COUNT, FACTOR, PARTS = 5, 3, 2, 3
#: Words that a task counts before it hands them on.
HELD = 400_000
ROWS = 50_000


def worn(doc_id: str, word: str) -> str:
    """The word as it counts in this document."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % DAMAGED:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    for batch in batches:
        for doc_id, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
            for word, n in Counter(RUN.findall((text.as_py() or "").translate(LOWER))).items():
                word = worn(doc_id or "", word)
                if len(word) >= LENGTH:
                    held[word] += n
            if len(held) >= HELD:
                yield handed()
                held.clear()
    yield handed()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words that are long and frequent enough."""
    rows = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= COUNT)


def parts(word: str) -> list[int]:
    """A 64-bit hash of each part of the word's letters."""
    seen: Counter[str] = Counter()
    places: list[list[str]] = [[] for _ in range(PARTS)]
    for letter in word:
        places[(ord(letter) + seen[letter]) % PARTS].append(f"{letter}{seen[letter]}")
        seen[letter] += 1
    return [xxhash.xxh64_intdigest(",".join(sorted(p)).encode()) for p in places]


def thirds(word: str, band: int) -> list[str]:
    """What is left of the word by an edit in the first, second and last third of a shorter word of band letters."""
    a, b = band // 3, 2 * band // 3
    from_end = lambda n: word[len(word) - n :]
    return [from_end(band - a), f"{word[:a]} {from_end(band - b)}", word[:b]]


def signatures(word: str, hashes: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(signature, band, part, third), in the band of the word's length and the one below. hashes: of its parts."""
    for band in (len(word), len(word) - 1):
        for third, rest in enumerate(thirds(word, band)):
            for part, h in enumerate(hashes):
                yield xxhash.xxh64_intdigest(f"{band} {part} {h} {third} {rest}".encode()) - 2**63, band, part, third


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["sig", "band", "part", "third", "word", "n", "first", "second"]

    def handed(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int8(), pa.int8(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list = []
    for batch in batches:
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
            hashes = parts(word)
            first, second, _ = (h - 2**63 for h in hashes)
            rows += [(*s, word, n, first, second) for s in signatures(word, hashes)]
            if len(rows) >= ROWS:
                yield handed(rows)
                rows = []
    if rows:
        yield handed(rows)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n for every two words that are one edit apart, both ways round."""
    signed = words.mapInArrow(_signed, "sig long, band int, part byte, third byte, word string, n long, first long, second long")
    a, b = signed.alias("a"), signed.select(*[F.col(c).alias(f"b_{c}") for c in signed.columns])
    short = F.least(F.length("word"), F.length("b_word"))
    x, y = F.floor(short / 3).cast("int"), F.floor(short * 2 / 3).cast("int")
    left = lambda n: F.left("word", n) == F.left("b_word", n)
    right = lambda n: F.right("word", n) == F.right("b_word", n)
    first_part = ((F.col("part") == 0) | (F.col("first") != F.col("b_first"))) & ((F.col("part") < 2) | (F.col("second") != F.col("b_second")))
    in_first, in_second = right(short - x), left(x) & right(short - y)
    first_third = (F.col("third") == 0) | (~in_first & ((F.col("third") == 1) | ~in_second))
    near = F.levenshtein("word", "b_word", 1) == 1
    met = (F.col("sig") == F.col("b_sig")) & (F.col("word") < F.col("b_word")) & (F.col("band") == short) & (F.col("part") == F.col("b_part")) & first_part & first_third & near
    # signatures are sized by the words' table, which they exceed by far: b would be broadcast where that is small
    pairs = a.join(b.hint("merge"), met).select("word", "n", F.col("b_word").alias("near"), F.col("b_n").alias("near_n"))
    each = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(each.alias("p")).select("p.*")


def roots(linked: DataFrame) -> DataFrame:
    """linked (word, form): word, root. The steps that a row has taken double with each round."""
    at = cut(linked.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each word: word, form, root, n, n_near, form_n."""
    words = cut(count_words(docs, id_col, text_col))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(near, "word", "left").withColumn("is_form", -F.col("best.less") >= FACTOR * F.col("n"))
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")))
    found = told.join(roots(told.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
