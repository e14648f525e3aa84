"""Masked pseudo-likelihood of documents (operator 7).

A network sees SIDE characters on either side of a masked one and predicts it; the document's score is the
sum of the log-probabilities of all its characters. The alphabet are the ALPHABET most frequent characters of
the corpus; others share one symbol, and the edges of a text have one of their own. A character outside the
alphabet has the symbol's probability times its own share of the symbol's occurrences in the whole corpus, so
that every character is scored as itself; as context, those characters are alike.

Training covers the whole corpus: every text's windows are counted, the counts are summed over all tasks, and
the network is trained on the distinct windows, weighted by their counts. In each round, every task improves
the round's weights on its own windows by minibatch steps, and the tasks' weights are averaged by the counts
they saw. Steps draw windows by their counts; a round takes as many draws as PASSES passes over the distinct ones
would. Shards hold SHARD_ROWS windows at most, so memory is that of one shard and the network.

Defined cases: null and empty texts have no tokens, score 0 and a null mean; an empty corpus gives the uniform
network; repeated rows are scored alike and count each in training; characters that the corpus of a given model
lacks share one count more; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut

ALPHABET, SIDE, WIDTH, HIDDEN = 93, 2, 8, 32
ROUNDS, PASSES, LEAST_STEPS, BATCH, RATE = 3, 2, 80, 4_096, 0.01
#: Distinct windows that a counting task holds before it hands them on, characters worked on at once, and shards of the training windows.
HELD, CHUNK, SHARDS, SHARD_ROWS = 1_000_000, 1_000_000, 12, 1_000_000
EDGE, OTHER, FIRST = 0, 1, 2
SPAN = 2 * SIDE + 1
UNICODE = 0x110000


def _counted_chars(batches):
    total: dict[int, int] = {}
    for b in batches:
        text = "".join(x for x in b.column("text").to_pylist() if x)
        points, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        for p, c in zip(points.tolist(), counts.tolist(), strict=True):
            total[p] = total.get(p, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["point", "count"])


def char_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the corpus in order and how often they occur; Unicode bounds them."""
    chars = docs.select("text").mapInArrow(_counted_chars, "point long, count long").groupBy("point").agg(F.sum("count").alias("count")).toArrow()
    points, counts = (chars.column(c).to_numpy() for c in ("point", "count"))
    order = np.argsort(points)
    return points[order], counts[order]


def alphabet(points: np.ndarray, counts: np.ndarray, size: int = ALPHABET) -> np.ndarray:
    return np.sort(points[np.argsort(-counts, kind="stable")[:size]])


def shares(points: np.ndarray, counts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The characters outside known, the logarithms of their shares, and that of any character which the corpus lacks."""
    rest = ~np.isin(points, known)
    total = counts[rest].sum() + 1
    return points[rest], np.log(counts[rest] / total), -float(np.log(total) + np.log(UNICODE - len(points)))


def own_share(raw: np.ndarray, others: tuple) -> np.ndarray:
    points, logs, lacking = others
    if not len(points):
        return np.full(len(raw), lacking)
    at = np.minimum(np.searchsorted(points, raw), len(points) - 1)
    return np.where(points[at] == raw, logs[at], lacking)


def windows(texts: list[str | None], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of every character's window, text after text, and the texts' lengths. A key holds the SPAN symbols in base 128."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    raw = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.minimum(np.searchsorted(points, raw), max(0, len(points) - 1)) if len(points) else np.zeros(len(raw), np.int64)
    symbol = np.where(points[at] == raw, at + FIRST, OTHER) if len(points) else np.full(len(raw), OTHER)
    place = np.arange(len(raw)) + SIDE * (1 + np.repeat(np.arange(len(texts)), lengths))  # SIDE edges between neighbours
    line = np.full(len(raw) + SIDE * (len(texts) + 1), EDGE, np.int64)
    line[place] = symbol
    key = np.zeros(len(raw), np.int64)
    for d in range(-SIDE, SIDE + 1):
        key = key * 128 + line[place + d]
    return key, lengths


def _parts(texts: list, most: int):
    """Runs of texts of about most characters; a longer text is a run by itself."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t or "")
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


def _counted_windows(batches, points):
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "count"])

    for b in batches:
        for run in _parts(b.column("text").to_pylist(), CHUNK):
            k, c = np.unique(windows(run, points)[0], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, c]), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield out()
                keys, counts = keys[:0], counts[:0]
    yield out()


def symbols(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context symbols (n, 2 * SIDE) and the masked one of each key."""
    each = np.stack([(keys >> (7 * (SPAN - 1 - i))) & 127 for i in range(SPAN)], 1)
    return np.delete(each, SIDE, 1), each[:, SIDE]


def start(n: int) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    return [rng.normal(0, 0.3, (n, WIDTH)), rng.normal(0, 0.2, (2 * SIDE * WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, n)), np.zeros(n)]


def forward(w: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = w[0][context].reshape(len(context), -1)
    h = np.tanh(x @ w[1] + w[2])
    z = h @ w[3] + w[4]
    z -= z.max(axis=1, keepdims=True)
    return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_probability(w: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys))
    for i in range(0, len(keys), 8_192):
        context, masked = symbols(keys[i : i + 8_192])
        out[i : i + 8_192] = forward(w, context)[2][np.arange(len(masked)), masked]
    return out


def improve(w: list[np.ndarray], keys: np.ndarray, counts: np.ndarray, seed: int) -> list[np.ndarray]:
    """PASSES passes of Adam minibatches (LEAST_STEPS at least), each drawn by the windows' counts."""
    w = [x.copy() for x in w]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    rng = np.random.default_rng(seed)
    upto = np.cumsum(counts) / counts.sum()
    for step in range(1, max(LEAST_STEPS, PASSES * len(keys) // BATCH) + 1):
        at = np.searchsorted(upto, rng.random(BATCH)).clip(0, len(keys) - 1)
        context, masked = symbols(keys[at])
        x, h, lp = forward(w, context)
        dz = np.exp(lp)
        dz[np.arange(BATCH), masked] -= 1
        dz /= BATCH
        dh = (dz @ w[3].T) * (1 - h * h)
        de = np.zeros_like(w[0])
        np.add.at(de, context.ravel(), (dh @ w[1].T).reshape(-1, WIDTH))
        for i, g in enumerate((de, x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def _improved(batches, w, seed):
    parts = [(b.column("key").to_numpy(), b.column("count").to_numpy()) for b in batches]
    parts = [p for p in parts if len(p[0])]
    if parts:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        new = improve(w, keys[order], counts[order], seed)
        flat = np.append(np.concatenate([x.ravel() for x in new]), 1.0) * float(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])


def train(docs: DataFrame, points: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The alphabet (points, if given) and the network. docs: text."""
    points = alphabet(*char_counts(docs)) if points is None else points
    counted = docs.select("text").mapInArrow(lambda bs: _counted_windows(bs, points), "key long, count long")
    kept = cut(counted.groupBy("key").agg(F.sum("count").alias("count")))
    shards = max(SHARDS, -(-kept.count() // SHARD_ROWS))
    w = start(len(points) + FIRST)
    shapes = [x.shape for x in w]
    for r in range(ROUNDS):
        now = w
        sums = kept.repartition(shards, "key").mapInArrow(lambda bs: _improved(bs, now, r), "place int, value double")
        rows = sums.groupBy("place").agg(F.sum("value").alias("value")).collect()  # a row for each weight; the last is the windows' count
        if not rows:
            break
        flat = np.array([x.value for x in sorted(rows)])
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        w = [p.reshape(s) for p, s in zip(np.split(flat[:-1] / flat[-1], cuts), shapes, strict=True)]
    return points, w


def learn(docs: DataFrame) -> tuple[np.ndarray, list[np.ndarray], tuple]:
    """The alphabet, the network and the shares of the other characters. docs: text."""
    found = char_counts(docs)
    points, w = train(docs, alphabet(*found))
    return points, w, shares(*found, points)


def _scored(batches, points, w, others=None):
    for b in batches:
        totals, lengths = [], []
        for run in _parts(b.column("text").to_pylist(), CHUNK):
            key, n = windows(run, points)
            distinct, at = np.unique(key, return_inverse=True)
            each = np.append(log_probability(w, distinct)[at], 0.0)
            other = np.flatnonzero((key >> (7 * SIDE)) & 127 == OTHER)
            if others and len(other):
                raw = np.frombuffer("".join(t or "" for t in run).encode("utf-32-le", "surrogatepass"), "<u4")
                each[other] += own_share(raw[other], others)
            starts = np.cumsum(n) - n
            sums = np.add.reduceat(each, starts) if len(n) else np.empty(0)
            totals.append(np.where(n > 0, sums, 0.0))
            lengths.append(n)
        n, s = (np.concatenate(x) if x else np.empty(0) for x in (lengths, totals))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["id", "n_tokens", "log_likelihood"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """For each row: id, n_tokens, log_likelihood, mean_log_likelihood. model: what learn gives; of train's alone, the others' symbol is scored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = model or learn(rows)
    ids = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(lambda bs: _scored(bs, *known), f"id {ids}, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
