"""Sequence packing as a cutting-stock problem solved by column generation (operator 10).

A document's ids and a closing id 0 are cut into pieces of 1024, each a sequence of its own, and a last piece.
The histogram of the last pieces (at most 1023 numbers) is the demand of a cutting-stock problem, whose linear
program is solved by column generation: dual prices from the basis, the best new pattern by a knapsack dynamic
program. Patterns are rounded down, what is left over is packed greedily into more patterns, and the pieces,
ranked within their length, are assigned to the patterns' places by rank.

Defined cases: null texts are empty and give the closing id alone; repeated rows are packed each for itself;
an empty table gives no pieces; sequences are numbered without order; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from plenum.llm.common import cut

LENGTH, CLOSING = 1024, 0
#: In the linear program, lengths are rounded up to the least power of two that leaves so many sizes.
MAX_SIZES = 64
#: Columns after which the basis is inverted anew, against rounding errors.
ANEW = 100
#: Ranks within a length are counted over so many salts at least, as one length may hold a third of all rows.
SALTS = 64
SPECIAL = "<|endoftext|>"
#: The ranks' encoder fails on runs of blanks ten times as long as this.
LONG_BLANKS = 100_000
BLANKS = re.compile(r"\s+")


@lru_cache(2)
def _encoders(vocabulary: str, ranks: str):
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer.from_file(vocabulary), tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(text: str | None, vocabulary: str, ranks: str) -> np.ndarray:
    """The vocabulary's ids and the closing one. The same vocabulary as ranks gives the same ids faster; texts
    that hold the special token's string or very long runs of blanks go through the tokenizer itself."""
    slow, fast = _encoders(vocabulary, ranks)
    ids = slow.encode(text, add_special_tokens=False).ids if text and _needs_tokenizer(text) else fast.encode_ordinary(text or "")
    return np.array([*ids, CLOSING], "<u4")


def _needs_tokenizer(text: str) -> bool:
    if SPECIAL in text:
        return True
    return len(text) >= LONG_BLANKS and any(m.end() - m.start() >= LONG_BLANKS for m in BLANKS.finditer(text))


def _cut_texts(batches, vocabulary, ranks):
    """Pieces of each text; full ones have their sequence_id, unlike any other task's and any pattern's (these stay below 2^40)."""
    number = (TaskContext.get().partitionId() + 1) << 40
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = token_ids(t, vocabulary, ranks)
            for start in range(0, len(ids), LENGTH):
                piece = ids[start : start + LENGTH]
                full = len(piece) == LENGTH
                number += full
                for col, v in zip(cols, (i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), number if full else None), strict=True):
                    col.append(v)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column("id").type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """Counts of each size whose total is at most room and whose prices sum highest: an unbounded knapsack."""
    value, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        value[c], take[c] = value[c - 1], -1
        if fits.any():
            got = np.where(fits, value[np.maximum(c - sizes, 0)] + prices, -1.0)
            k = int(got.argmax())
            if got[k] > value[c] + 1e-12:
                value[c], take[c] = got[k], k
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= sizes[take[c]]
    return out


def column_generation(demand: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each: fewest patterns that meet the demand.

    It ends at the optimum, where no pattern is priced above one. The demand is raised by tiny, different amounts
    meanwhile, so that no step is of length zero and none can come round again."""
    basis = np.diag((room // sizes).astype(float))
    raised = demand * (1 + 1e-9) + 1e-6 * np.sqrt(np.arange(2, len(sizes) + 2))
    inverse = np.diag(1 / np.diag(basis))
    used, n = inverse @ raised, 0
    while True:
        prices = inverse.sum(axis=0)
        column = best_pattern(np.maximum(prices, 0), sizes, room).astype(float)
        if prices @ column <= 1 + 1e-7:
            return basis, np.maximum(inverse @ demand, 0)
        step = inverse @ column
        at = np.flatnonzero(step > 1e-9)
        out = at[np.argmin(used[at] / step[at])]
        rate = used[out] / step[out]
        used = np.maximum(used - rate * step, 0)
        used[out] = rate
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = column
        n += 1
        if n % ANEW == 0:
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ raised, 0)


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(copies, {piece length: count}) of every pattern; together they hold each piece of the histogram once."""
    left = {k: v for k, v in histogram.items() if v}
    if not left:
        return []
    lengths = np.array(sorted(left))
    unit = next(u for u in (2**i for i in range(30)) if len(np.unique(-(-lengths // u))) <= MAX_SIZES)
    units = -(-lengths // unit)
    sizes = np.unique(units)
    room = length // unit
    demand = np.array([sum(left[x] for x in lengths[units == s].tolist()) for s in sizes], float)
    basis, used = column_generation(demand, sizes, room)
    out: list[tuple[int, dict[int, int]]] = []
    by_size = {int(s): [int(x) for x in lengths[units == s][::-1]] for s in sizes}

    def give(counts: dict[int, int], copies: int) -> None:
        """Fill copies of a pattern of unit sizes with real lengths of these sizes, runs of equal fillings at once."""
        while copies:
            fill: dict[int, int] = {}
            for s, c in counts.items():
                for x in by_size[s]:
                    n = min(c, left.get(x, 0))
                    if n:
                        fill[x] = fill.get(x, 0) + n
                        c -= n
            if not fill:
                return
            t = min(copies, *(left[x] // n for x, n in fill.items()))
            for x, n in fill.items():
                left[x] -= n * t
            out.append((t, fill))
            copies -= t

    for j in np.argsort(-used):
        copies = int(used[j] + 1e-6)
        if copies:
            give({int(s): int(c) for s, c in zip(sizes, basis[:, j], strict=True) if c}, copies)
    rest = sorted((x for x, n in left.items() if n), reverse=True)
    while rest:  # greedy: the largest that still fits, over and over
        fill, gap = {}, length
        for x in rest:
            n = min(left[x], gap // x)
            if n:
                fill[x], gap = n, gap - n * x
        t = min(left[x] // n for x, n in fill.items())
        for x, n in fill.items():
            left[x] -= n * t
        out.append((t, fill))
        rest = [x for x in rest if left[x]]
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset in it): where the ranks of a length go."""
    out, upto, sequence = [], {}, 0
    for copies, fill in patterns:
        offset = 0
        for x, n in fill.items():
            begin = upto.get(x, 0)
            upto[x] = begin + copies * n
            out.append((x, begin, upto[x], n, sequence, offset))
            offset += n * x
        sequence += copies
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = docs.schema[id_col].dataType.simpleString()
    schema = f"id {ids}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    pieces = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda bs: _cut_texts(bs, vocabulary, ranks), schema))
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = pieces.filter("sequence_id is null").withColumn("salt", F.pmod(F.xxhash64("id", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut(last.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()}  # 1023 rows at most
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    by_length: dict[int, list] = {}
    for length, lo, _, each, sequence, place in places(plan(histogram)):
        by_length.setdefault(length, []).append((lo, each, sequence, place))
    # a row for each length, with its places in order of their first ranks
    where_df = spark.createDataFrame([(k, sorted(v)) for k, v in by_length.items()], "length long, places array<struct<lo:long,each:long,sequence:long,place:long>>")
    order = Window.partitionBy("length", "salt").orderBy("id", "ids_crc32", "start")
    ranked = last.join(before, ["length", "salt"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("before"))
    found = F.element_at(F.filter("places", lambda p: p["lo"] <= F.col("rank")), -1)
    put = ranked.join(F.broadcast(where_df), "length").withColumn("p", found).withColumn("at", F.col("rank") - F.col("p.lo"))
    put = put.withColumn("sequence_id", F.col("p.sequence") + F.floor(F.col("at") / F.col("p.each"))).withColumn("offset", F.col("p.place") + F.pmod("at", "p.each") * F.col("length"))
    columns = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset")]
    full = pieces.filter("sequence_id is not null").withColumn("offset", F.lit(0))
    return full.select(*columns).unionByName(put.select(*columns))
