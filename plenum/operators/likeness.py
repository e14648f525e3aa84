"""Likeness of names by matching blocks (Ratcliff and Obershelp), and a join of the likest names of a key."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plenum.functions.text import let
from plenum.operators.relops import spread
from plenum.operators.shared import written


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters of the matching blocks as a share of both: the longest common block, and so on left and right of it. 1 for two empty texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def most_alike(a: Column, b: Column) -> Column:
    """An upper bound of sequence_ratio by the letters that both have, without looking at their order."""
    letters = lambda s: F.array_sort(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)))
    counted = lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.lit(":"), (i + 1 - F.array_position(xs, x)).cast("string")))
    total = F.length(a) + F.length(b)
    common = let(letters(a), lambda x: let(letters(b), lambda y: F.size(F.array_intersect(counted(x), counted(y)))))
    by_length = 2 * F.least(F.length(a), F.length(b)) / total
    return F.when(total == 0, 1.0).otherwise(F.least(by_length, 2 * common / total))


def clean_title(title: Column) -> Column:
    """A title for comparison: lowered, dashes as blanks, without what follows a parenthesis."""
    plain = F.replace(F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit(" - "), F.lit(" ")), F.lit("—"), F.lit(" "))
    return F.trim(F.substring_index(plain, " (", 1))


def likest(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, names: list[str], name: str, least: float = 0.4) -> DataFrame:
    """left_id, right_id, score: of right's rows with left's key, the one whose name is likest to any of left's names; above least only.

    Two names are held against each other once, whatever number of keys and rows have them, and only where letters and lengths allow more than least. The
    least right_id has a name's place, and wins ties."""
    own = left.select(left_id, key, F.explode(F.array_distinct(F.array(*[clean_title(F.col(n)) for n in names]))).alias("_x")).filter("_x != ''")
    theirs = right.select(key, clean_title(F.col(name)).alias("_y"), right_id).groupBy(key, "_y").agg(F.min(right_id).alias(right_id))
    met = own.select(key, "_x").distinct().join(theirs, key)
    scored = spread(written(met.select("_x", "_y").distinct())).filter(most_alike(F.col("_x"), F.col("_y")) > least)
    scored = written(scored.withColumn("score", sequence_ratio("_x", "_y")).filter(F.col("score") > least))
    best = lambda df, keys: df.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), right_id)).alias("_best")).select(*keys, (-F.col("_best.s")).alias("score"), f"_best.{right_id}")
    named = best(met.join(scored, ["_x", "_y"]), [key, "_x"])
    return best(own.join(named, [key, "_x"]), [left_id]).select(left_id, right_id, "score")
