"""Token counts under a unigram model by dynamic programming over a trie (operator 8).

The pieces are a public byte vocabulary; a piece's log-probability follows Zipf's law on its rank. A text is
split into pre-tokens; its count is the number of pieces in the best segmentation of each pre-token. A task
inserts its distinct pre-tokens in a trie, a node for each distinct prefix: the best score of a prefix is
computed once, however many pre-tokens share it, and a pre-token's count is stored at its terminal node. The
trie begins anew when it has MAX_NODES nodes, and a pre-token has nodes for its first LONG bytes only, beyond
which its own last scores are enough; so a task's memory is bounded whatever the texts are.

Defined cases: null and empty texts have no tokens; ties go to fewer pieces; repeated rows are counted alike;
other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES, LONG = 1_500_000, 512


@lru_cache(2)
def pieces(ranks: str) -> tuple[dict[bytes, float], int]:
    """piece -> log-probability, and the longest piece. Every byte is a piece, so every text has a segmentation."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 1) for r in table.values()))
    return {p: -math.log(r + 1) - total for p, r in table.items()}, max(map(len, table))


@lru_cache(2)
def lengths(ranks: str) -> dict[bytes, tuple[int, ...]]:
    """The lengths of the pieces that end with two bytes, 1 among them: no others need a try where these end."""
    found: dict[bytes, set[int]] = {}
    for p in pieces(ranks)[0]:
        if len(p) > 1:
            found.setdefault(p[-2:], {1}).add(len(p))
    return {end: tuple(sorted(ns)) for end, ns in found.items()}


class Trie:
    """Nodes are numbers; a node keeps the best score of its prefix and the pieces in it."""

    def __init__(self, ranks: str):
        self.pieces, self.longest = pieces(ranks)
        self.lengths = lengths(ranks)
        self.child: dict[tuple[int, int], int] = {}
        self.terminal: dict[str, int] = {}
        self.score, self.count = [0.0], [0]

    def clear(self) -> None:
        self.child.clear()
        self.terminal.clear()
        self.score, self.count = [0.0], [0]

    def _best(self, raw: bytes, d: int, score: list, count: list, at) -> tuple[float, int]:
        """Score and pieces of the best segmentation of raw's first d bytes; at: where the ones of shorter prefixes stand."""
        best, n, get = -math.inf, 0, self.pieces.get
        for size in self.lengths.get(raw[d - 2 : d] if d > 1 else b"", (1,)):
            if size > d:
                break
            p = get(raw[d - size : d])
            if p is not None:
                j = at(d - size)
                s = score[j] + p
                if s > best or s == best and count[j] < n:
                    best, n = s, count[j] + 1
        return best, n

    def insert(self, token: str) -> int:
        """Number of pieces of the token's best segmentation."""
        if len(self.score) > MAX_NODES:
            self.clear()
        raw = token.encode("utf-8", "surrogatepass")
        score, count, child = self.score, self.count, self.child
        path, node = [0], 0
        for d, byte in enumerate(raw[:LONG], 1):
            step = (node, byte)
            node = child.get(step)
            if node is None:
                best, n = self._best(raw, d, score, count, path.__getitem__)
                node = child[step] = len(score)
                score.append(best)
                count.append(n)
            path.append(node)
        if len(raw) > LONG:
            return self._beyond(raw, [score[i] for i in path], [count[i] for i in path])
        self.terminal[token] = count[node]
        return count[node]

    def _beyond(self, raw: bytes, score: list, count: list) -> int:
        """The count of a long token, of whose prefixes only the last ones are kept."""
        gone = 0
        for d in range(LONG + 1, len(raw) + 1):
            if len(score) > 64 * self.longest:
                drop = len(score) - self.longest
                del score[:drop], count[:drop]
                gone += drop
            best, n = self._best(raw, d, score, count, lambda j: j - gone)  # noqa: B023
            score.append(best)
            count.append(n)
        return count[-1]


def _counted(batches, ranks):
    trie, split = Trie(ranks), regex.compile(public_tokenizers.PATTERN)
    known, insert = trie.terminal, trie.insert
    for b in batches:
        out = []
        for t in b.column("text").to_pylist():
            n = m = 0
            for x in split.findall(t or ""):
                c = known.get(x)
                n += insert(x) if c is None else c
                m += 1
            out.append((m, n))
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))], ["id", "n_pretokens", "n_tokens"])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """For each row: id, n_pretokens, n_tokens."""
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda bs: _counted(bs, ranks), f"id {ids}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
