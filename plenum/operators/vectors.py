"""Nearest vectors of many questions at once, and rank fusion by question."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.operators.relops import top_n
from plenum.operators.shared import written

#: Vectors and questions of a block: what one product of two matrices takes.
VECTORS, QUESTIONS = 4_096, 512


def _blocks(rows: DataFrame, key: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """About size rows in each row: ids and vectors, one after another."""
    n = max(1, -(-rows.count() // size))
    each = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias("x"))
    return each.select(F.transform("x", lambda e: e["k"]).alias(names[0]), F.flatten(F.transform("x", lambda e: e["v"])).alias(names[1]))


def nearest_batched(vectors: DataFrame, key: str, vector: str, questions: DataFrame, k: int, least: float = 0.15) -> DataFrame:
    """q, key, score, rank: the k vectors of each question (q, vector) with the largest dot product, least at least; ids break ties. Exact.

    Questions are a stated set that is held against all vectors, a block of each at a time; of a block only each question's k best go on. Vectors of a
    question's length only are compared; null ones aren't."""
    ids, own = vectors.schema[key].dataType.simpleString(), questions.schema["q"].dataType.simpleString()
    left = written(_blocks(vectors, key, vector, VECTORS, ("ids", "vectors")))
    right = written(_blocks(questions, "q", "vector", QUESTIONS, ("qs", "asked")))

    def best(batches):
        for b in batches:
            for i in range(b.num_rows):
                keys, qs = b["ids"][i].values, b["qs"][i].values
                x = np.asarray(b["vectors"][i].values, dtype=np.float64).reshape(len(keys), -1)
                y = np.asarray(b["asked"][i].values, dtype=np.float64).reshape(len(qs), -1)
                if x.shape[1] != y.shape[1]:
                    raise ValueError("vectors of different lengths")
                scores = np.round(y @ x.T, 5)
                kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(qs), -np.inf)
                row, col = np.nonzero((scores >= least) & (scores >= kth[:, None]))  # ties at the last place stay for now
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(row)), keys.take(pa.array(col)), pa.array(scores[row, col])], ["q", key, "score"])

    found = left.join(right).mapInArrow(best, f"q {own}, `{key}` {ids}, score double")
    return top_n(found, ["q"], [F.desc("score"), F.col(key)], k)


def fused(lists: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """q, key, score, rank of lists (q, key, rank from 1): reciprocal rank fusion for each question; the first list breaks ties, then its places."""
    rows = None
    for order, df in enumerate(lists):
        own = df.select("q", key, F.col("rank").alias("_rank"), F.lit(order).alias("_list"))
        rows = own if rows is None else rows.unionByName(own)
    each = rows.groupBy("q", key).agg(F.round(F.sum(1.0 / (constant - 1 + F.col("_rank"))), 8).alias("score"), F.min(F.struct("_list", "_rank")).alias("_first"))
    return top_n(each, ["q"], [F.desc("score"), F.col("_first"), F.col(key)], 1 << 30).drop("_first")
