"""Relational helpers that Spark has no single operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.shared import written


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the cluster has cores, where its scan has fewer: for heavy work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of keys by order; null keys are equal."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def listed(df: DataFrame, key: str, columns: list[str], most: int = 4096) -> DataFrame:
    """key, near: the rows of a key as arrays of columns, unordered; a key with many more than most rows has several of them."""
    many = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    part = F.coalesce(F.pmod(F.xxhash64(*columns), F.ceil(F.col("_n") / most)), F.lit(0))
    return df.join(many, key, "left").groupBy(key, part.alias("_part")).agg(F.collect_list(F.struct(*columns)).alias("near")).drop("_part")


def all_of(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """df under those conditions that are given."""
    return reduce(lambda d, c: d.filter(c), [c for c in conditions if c is not None], df)


def either_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], key: str, how: str = "inner") -> DataFrame:
    """(left key, right's columns) that match by any of the pairs: a union of equi joins instead of OR, each match once.
    how="left" keeps the left keys without a match.

    Both sides are made distinct before they meet, and a pair passes over what an earlier one has found, so matches are handed on as they are made."""
    right = right.distinct()
    own = left.groupBy(key).agg(*[F.collect_set(a).alias(f"_{i}") for i, (a, _) in enumerate(pairs)])
    found = []
    for i, (_, b) in enumerate(pairs):
        new = reduce(lambda x, y: x & y, [~F.coalesce(F.array_contains(f"_{j}", F.col(pairs[j][1])), F.lit(False)) for j in range(i)], F.lit(True))
        met = own.withColumn("_on", F.explode(f"_{i}")).join(right.withColumn("_on", F.col(b)), "_on").filter(new)
        found.append(met.select(key, *right.columns))
    matched = reduce(DataFrame.unionByName, found)
    return matched if how == "inner" else left.select(key).join(matched, key, how)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, within: float, order: str) -> DataFrame:
    """As-of join: of right's rows with equal keys within so many seconds, the nearest one (least order on ties).

    Times are dealt into buckets of that width; a row meets its own and both neighbouring buckets only."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    bucket = lambda c: F.floor(seconds(c) / within)
    l = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_b", F.explode(F.array(*[bucket(left_at) + d for d in (-1, 0, 1)])))  # noqa: E741
    r = right.withColumn("_b", bucket(right_at))
    both = l.join(r, [*keys, "_b"]).withColumn("_gap", F.abs(seconds(left_at) - seconds(right_at))).filter(F.col("_gap") <= within)
    return distinct_on(both, ["_id"], [F.col("_gap"), F.col(order)]).drop("_id", "_b").withColumnRenamed("_gap", "gap")


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, first, last of each run of consecutive integers."""
    run = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return df.select(*keys, value).distinct().withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_run")


def merge_longest(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Upsert: the longer text wins, other columns take the new value where there is one."""
    n = new.select(*[F.col(c).alias(f"_new_{c}") if c != key else F.col(c) for c in new.columns])
    both = old.join(n, key, "full_outer")
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    pick = lambda c: F.when(length(F.col(f"_new_{c}")) > length(F.col(c)), F.col(f"_new_{c}")).otherwise(F.coalesce(c, f"_new_{c}")) if c == text else F.coalesce(f"_new_{c}", c)
    return both.select(key, *[pick(c).alias(c) for c in old.columns if c != key])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those distinct rows of new whose keys it lacks; null keys are equal."""
    a, b = old.alias("a"), new.dropDuplicates(keys).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    return old.unionByName(b.join(a, same, "left_anti"))


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """left's rows whose key isn't among right's, as NOT IN means it: a null among them leaves nothing, a null key stays only where there are none.

    Keys are made distinct and meet by an anti join of any size; Spark's own null-aware anti join broadcasts all of them."""
    told = right.agg(F.count("*").alias("_all"), F.count_if(F.col(other).isNull()).alias("_nulls"))  # one row
    kept = left.join(right.select(F.col(other).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")
    return kept.join(F.broadcast(told)).filter((F.col("_nulls") == 0) & ((F.col("_all") == 0) | F.col(key).isNotNull())).select(left.columns)


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with place (from 0, by order) of each row in its group and members, the group's rows, however large a group is.

    Rows are dealt and sorted by ranges of keys and order and numbered within a partition; what earlier partitions hold of a group is added."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    runs = rows.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    each = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = runs.withColumn("_shift", before - F.col("_first")).withColumn("members", F.sum("_n").over(each)).alias("s")
    same = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ["_part", *keys]])
    placed = rows.alias("r").join(shifts, same).withColumn("place", F.col("_at") + F.col("_shift"))
    return placed.select(*[F.col(f"r.{c}") for c in df.columns], "place", "members")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: exact percentiles, by line between the two nearest values. Null values don't count."""
    rows = ranked(df.select(*keys, value).filter(F.col(value).isNotNull()), keys, [F.col(value)])
    at = {name: (F.col("members") - 1) * F.lit(p) for name, p in shares.items()}
    near = reduce(lambda x, y: x | y, [(F.col("place") == F.floor(x)) | (F.col("place") == F.ceil(x)) for x in at.values()])

    def between(x: Column) -> Column:
        low, high = F.max(F.when(F.col("place") == F.floor(x), F.col(value))), F.max(F.when(F.col("place") == F.ceil(x), F.col(value)))
        return low + (high - low) * F.max(x - F.floor(x))

    return rows.filter(near).groupBy(*keys).agg(*[between(x).alias(name) for name, x in at.items()])
