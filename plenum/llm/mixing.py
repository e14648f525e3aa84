"""Mixing sources to target weights by systematic sampling (operator 12).

Sources share a part of all words by weight; a target above LIMIT times its source's words stops there, and what is
over goes to the others by weight. Within a source each document expects target / source_size copies. Documents stand in a row,
the longest first; their expected copies are summed from the first on, one offset of the source is added, and a document is
emitted once for each integer that its stretch of the sum crosses. As neighbours have about one length, a source's taken
words differ from the target by less than its longest document. Sums are kept as whole parts of 2 ** BITS, so that they
are exact for any number of rows.

Defined cases: null and empty texts have size 0 and take nothing; a null source is one source, last in order; a source without words
has target 0; rows that repeat are documents of their own; an empty table gives no rows; texts are counted whole, of any
length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, quoted, ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
SEED, BITS = "mix", 30


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """sources (source, source_size) with weight and target; null comes last. Each pass over the sources gives one row to the driver."""
    order = F.struct(F.col("source").isNull(), "source")
    rows = ranked(sources.withColumn("_all", F.lit(0)), "_all", order).drop("_all", "members")
    rows = cut(rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).drop("place"))
    cap, level = F.col("source_size") * limit, 0.0
    above = F.col("weight") * F.lit(level) > cap
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    while True:  # what the sources that stop leave over raises the level of the others
        rest = rows.agg(F.sum(F.when(above, cap).otherwise(0)).alias("stopped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights")).first()
        raised = max(level, (total * share - rest.stopped) / rest.weights) if rest.weights else level
        above = F.col("weight") * F.lit(raised) > cap
        if raised == level:
            break
        level = raised
    return rows.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * F.lit(level)).cast("double"))


def offset(source: Column, seed: str) -> Column:
    """A whole number below 2 ** BITS that the seed and the source give."""
    named = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit("")))
    return F.conv(F.left(F.md5(named.cast("binary")), F.lit(8)), 16, 10).cast("bigint") % 2**BITS


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """For each row: its id, size, source_size, target, copies and the words taken of it (copies * size)."""
    size = F.coalesce(F.regexp_count(F.col(quoted(text_col)), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = cut(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), size.alias("size")))
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    # copies that a document expects, and the offset, in parts of 2 ** BITS
    each = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * 2**BITS)).otherwise(0).cast("bigint")
    aims = cut(aims.select(F.col("source").alias("of"), "source_size", "target", each.alias("each"), offset(F.col("source"), seed).alias("offset")))
    placed = ranked(rows, "source", F.col("size").desc(), F.col("id").asc_nulls_first())
    found = placed.join(aims, F.col("source").eqNullSafe(F.col("of")))
    reached = (F.col("offset") + F.col("place") % 2**BITS * F.col("each")) % 2**BITS  # the part of the sum before this row beyond its last integer
    found = found.withColumn("copies", F.floor((reached + F.col("each")) / F.lit(2**BITS)).cast("bigint"))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
