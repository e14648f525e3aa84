"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents whose crc32(doc_id as text) mod 4 has this value are held out of training.
HELD_OUT_REMAINDER = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where neither the session nor the context names one, a single-machine session (tests) gets a temporary
    one; on a cluster, whose executors couldn't see it, that is an error.
    """
    held = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not held and not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="plenum-checkpoint-")
    if not held:
        spark.sparkContext.setCheckpointDir(named)
    return named or held


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder. What is written there goes when the JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)  # deleteOnExit takes only what exists
    files.deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost
    executor costs a reread instead of a recomputation. The files go when the JVM ends."""
    path = new_folder(df.sparkSession, "table")
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(batches, rows: int = 512):
    """The same rows in smaller batches: what a task makes of one is in memory all at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; dealt over as many tasks as the cluster has cores where its scan has fewer, as the work on each row is heavy."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves the held-out remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(True))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Where no other character has case to lose, lower() is the same and faster."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike(r"[\p{IsUppercase}\p{IsTitlecase}&&[^A-Z]]"), F.translate(text, upper, lower)).otherwise(F.lower(text))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: within lambdas, expressions are computed at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, block: int = 256) -> Column:
    """For an array<bigint>, the array of sums of all elements before each one.

    Sums go within blocks and then over blocks, so that arrays of n elements cost n * block, not n * n.
    """
    zero = F.array(F.lit(0).cast("bigint"))

    def scan(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("t"), F.array().cast("array<bigint>").alias("a"))
        step = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["a"], F.array(acc["t"])).alias("a"))
        return F.aggregate(xs, start, step, lambda acc: acc["a"])

    def summed(xs: Column) -> Column:
        n_blocks = F.ceil(F.size(xs) / F.lit(block)).cast("int")
        cut_up = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
        totals = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda t, x: t + x))
        shifted = let(cut_up, lambda blocks: F.zip_with(blocks, scan(totals(blocks)), lambda b, t: F.transform(scan(b), lambda s: s + t)))
        return F.when(F.size(xs) > 0, F.flatten(shifted)).otherwise(F.slice(zero, 1, 0))

    return let(values, summed)


def ranked(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """df with place (bigint, from 0, by order) of each row in its group, and members, the group's rows; no group is gathered.

    Rows are dealt and sorted by ranges of group and order, numbered within a partition, and shifted by what earlier
    partitions hold of their group. The table is written once, so that every reader sees the same places.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    runs = rows.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    each = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(each).alias("members"))
    joined = rows.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_g", "_shift")
