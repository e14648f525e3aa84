"""Language identification by compression (operator 9).

For each language a raw-content zstandard dictionary is made of texts that aren't held out, those with the
least hashes of their ids: at most DOCS of them, the beginning of each, and DICT_BYTES bytes. Every language
value has one. A text is encoded with every dictionary, piece by piece to its end; the language of the
smallest total wins. Dictionaries are made and loaded in groups of GROUP languages, which lie in the shared
folder, so that neither the driver nor a task holds more than a group. Where the margin to the next
one is narrow, the answer is rejected (accepted = false), while lang_pred still names the best.

Defined cases: null texts and texts without a letter are `und` with score 0 and not accepted; if no language
can be learned, all texts are `und`; ties go to the first language in order; null languages teach nothing;
repeated rows are answered alike, and teach once, by the least of their texts; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import cut, held_out, new_folder

DOCS, DICT_BYTES, PIECE, LEVEL, GROUP = 96, 112_640, 8_192, 3, 64
#: Bytes that halve (by e) the odds of a language, and the least share of saved bytes for an accepted answer.
SCALE, MARGIN = 4.0, 0.02
LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Iterator[dict[str, bytes]]:
    """language -> content of its dictionary, for groups of languages in order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("lang is not null and text is not null and text != ''").filter(~held_out(F.col("id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("lang", "id").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= DOCS)
    share = DICT_BYTES // DOCS * 4
    begun = rows.select("id", "lang", F.left("text", F.lit(share)).alias("text")).join(cut(chosen), ["id", "lang"])
    picked = cut(begun.groupBy("lang", "rank").agg(F.min("text").alias("text")))  # of rows that repeat an id, one text
    langs = sorted(r.lang for r in picked.select("lang").distinct().collect())
    for i in range(0, len(langs), GROUP):
        out: dict[str, bytes] = {}
        for r in picked.filter(F.col("lang").isin(langs[i : i + GROUP])).orderBy("lang", "rank").collect():
            out[r.lang] = (out.get(r.lang, b"") + r.text.encode())[:DICT_BYTES]
        yield out


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = sorted(contents)
        self.encoders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.encode()
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(len(e.compress(p)) for p in pieces) for e in self.encoders]

    def measure(self, text: str) -> tuple[str, int, float, float]:
        """The best language, its size, the next one's (infinite for a single language) and the languages' odds as a sum, the best one's being 1."""
        sizes = self.sizes(text)
        best = min(sizes)
        odds = sum(math.exp(max(-50.0, (best - s) / SCALE)) for s in sizes)
        return self.langs[sizes.index(best)], best, sorted(sizes)[1] if len(sizes) > 1 else math.inf, odds


def merged(a: tuple | None, b: tuple) -> tuple:
    """The measure over the languages of both; a's come first in order."""
    if a is None:
        return b
    first, other = (a, b) if a[1] <= b[1] else (b, a)
    return first[0], first[1], min(first[2], other[1]), first[3] + other[3] * math.exp(max(-50.0, (first[1] - other[1]) / SCALE))


def judged(found: tuple | None) -> tuple[str, float, bool]:
    if found is None:
        return "und", 0.0, False
    lang, best, rest, odds = found
    rest = 2 * best if rest == math.inf else rest
    return lang, 1 / odds, rest - best >= MARGIN * rest


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _save(path: str, group: dict[str, bytes]) -> None:
    files, at = _place(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(at) as f:
        f.write(pickle.dumps(group))


def _load(path: str) -> dict[str, bytes]:
    files, at = _place(path)
    with files.open_input_stream(at) as f:
        return pickle.loads(f.read())


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For each row: id, held_out, lang_pred, score, accepted."""
    where = new_folder(docs.sparkSession, "dictionaries")
    names = []
    for group in learn(docs, id_col, text_col, lang_col):
        names.append(f"{where}/{len(names):06d}")
        _save(names[-1], group)

    def answered(batches):
        held = None  # a single group is loaded once
        for b in batches:
            texts = b.column("text").to_pylist()
            found: list[tuple | None] = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
            for name in names:
                own = held or Classifier(_load(name))
                held = own if len(names) == 1 else None
                for i in asked:
                    found[i] = merged(found[i], own.measure(texts[i]))
            rows = [judged(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["id", "lang_pred", "score", "accepted"])

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(answered, f"id {ids}, lang_pred string, score double, accepted boolean")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "accepted")
