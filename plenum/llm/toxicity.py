"""Counterfactual-regularised toxicity classifier (operator 2).

A logistic regression over the presence of words and word beginnings. Training swaps identity terms of
labelled texts for others of their kind and penalises the change of the score, so that naming a group is
neutral. It reads at most MAX_TRAIN labelled texts, those with the least hashes of their ids, one for each id:
the only bounded sample; scores cover every whole text. On the driver a text is the numbers of its kept features,
of which there are MAX_FEATURES and the identity terms at most.

Defined cases: null and empty texts have no words and get the score of the bias; labels that are null or of
unknown ids teach nothing, of repeated label rows the larger counts; with one class or no labels at all,
every score is the share of toxic labels (0 without labels); repeated rows score alike, and of rows that repeat
an id the least text teaches; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, held_out, small

#: Bounds of the training sample and of the features that are kept.
MAX_TRAIN, MAX_FEATURES = 20_000, 4_096
THRESHOLD, STEPS, RATE, RIDGE, SWAP_WEIGHT = 0.3, 200, 0.1, 1e-4, 1.0
BEGINNINGS = (3, 4, 5, 6)
#: Features with a smaller chi-squared statistic are left out.
LEAST_CHI = 15.0
#: Words whose features a task remembers, and features that it counts before it hands them on.
CACHE, HELD = 50_000, 100_000
#: Identity terms by kind; a swap takes the next term of the kind.
IDENTITY = [
    "women men girls boys frauen männer mujeres hombres femmes hommes".split(),
    "woman man girl boy frau mann mujer hombre femme homme".split(),
    "muslims christians jews hindus buddhists atheists muslime christen juden musulmanes cristianos judíos musulmans chrétiens juifs".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "black white asian latino arab african european".split(),
    "gay lesbian straight bisexual transgender queer schwul lesbisch".split(),
    "immigrants refugees foreigners citizens einwanderer flüchtlinge inmigrantes refugiados immigrés réfugiés".split(),
    "disabled deaf blind autistic elderly young".split(),
]
SWAP = {w: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, w in enumerate(kind)}
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_=+/\\`~^"


def distinct_words(text: str | None) -> set[str]:
    return {w for w in {x.strip(EDGES) for x in set((text or "").lower().split())} if w}


def word_features(w: str) -> list[str]:
    return ["=" + w, *(w[:k] for k in BEGINNINGS if len(w) >= k)]


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


def _counted(batches):
    """feature, toxic texts, other texts of a task's sample."""
    by = Counter(), Counter()

    def handed():
        names = list(by[0].keys() | by[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (by[1], by[0]))], ["feature", "pos", "neg"])
        for c in by:
            c.clear()
        return out

    for b in small(batches):
        for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = distinct_words(t)
            by[y].update(text_features(words | swapped(words)))
            if len(by[0]) + len(by[1]) > HELD:
                yield handed()
    yield handed()


def _indexed(batches, index):
    """The kept features of each text, and those of its counterfactual where it has identity terms."""
    at = lambda words: sorted(index[f] for f in text_features(words) if f in index)
    for b in small(batches, 128):
        words = [distinct_words(t) for t in b.column("text").to_pylist()]
        other = [swapped(w) for w in words]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([at(w) for w in words], kind), pa.array([at(o) if o != w else None for w, o in zip(words, other, strict=True)], kind)], ["toxic", "own", "other"])


def _flat(lists):
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)


def fit(own: list, other: list, y: np.ndarray, n: int, swap_weight: float = SWAP_WEIGHT) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over the log loss, a ridge, and swap_weight times the mean squared change of swapped texts."""
    row, col = _flat(own)
    pairs = [(a, b) for a, b in zip(own, other, strict=True) if b is not None]
    r1, c1 = _flat([a for a, _ in pairs])
    r2, c2 = _flat([b for _, b in pairs])
    w, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], len(y)) + w[n]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(col, e[row], n), e.sum()) + RIDGE * np.append(w[:n], 0)
        if pairs:
            d = (np.bincount(r2, w[c2], len(pairs)) - np.bincount(r1, w[c1], len(pairs))) * (2 * swap_weight / len(pairs))
            g[:n] += np.bincount(c2, d[r2], n) - np.bincount(c1, d[r1], n)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """feature -> weight, and the bias. Learns from rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_train)  # at most max_train rows of 12 bytes: their size is bounded
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = cut(labelled.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    total = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        share = pos / max(1, pos + neg)
        return {}, 30.0 if share == 1 else -30.0
    counts = sample.mapInArrow(_counted, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos"), F.col("neg")
    cross = (a * (neg - b) - b * (pos - a)).cast("double")
    chi = cross * cross * (pos + neg) / (1.0 * pos * neg * (a + b) * (pos + neg - a - b) + 1.0)
    best = counts.filter((a + b >= 3) & (chi >= LEAST_CHI)).orderBy(chi.desc(), "feature").limit(MAX_FEATURES).select("feature").collect()
    names = sorted({r.feature for r in best} | {"=" + w for w in SWAP})
    index = {f: i for i, f in enumerate(names)}
    rows = sample.mapInArrow(lambda bs: _indexed(bs, index), "toxic int, own array<int>, other array<int>").collect()  # max_train rows at most
    w, bias = fit([r.own for r in rows], [r.other for r in rows], np.array([r.toxic for r in rows], float), len(names))
    return {f: float(w[i]) for f, i in index.items() if w[i]}, bias


def score(text: str | None, weights: dict[str, float], bias: float, cache: dict) -> float:
    seen = {}
    for w in distinct_words(text):
        own = cache.get(w)
        if own is None:
            own = cache[w] = tuple((f, weights[f]) for f in word_features(w) if f in weights)
        seen.update(own)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + math.fsum(seen.values())))))


def _scores(column, weights, bias, cache):
    if len(cache) > CACHE:
        cache.clear()
    return pa.array([score(t, weights, bias, cache) for t in column.to_pylist()], pa.float64())


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, held_out, score, predicted."""
    weights, bias = train(docs, labels, id_col, text_col)

    def scored(batches):
        cache: dict = {}
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), _scores(b.column("text"), weights, bias, cache)], ["id", "score"])

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, f"id {ids}, score double")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, in one pass and without a shuffle."""
    weights, bias = train(docs, labels, id_col, text_col)

    def kept(batches):
        cache: dict = {}
        for b in small(batches):
            yield b.filter(pa.compute.less(_scores(b.column(text_col), weights, bias, cache), THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
