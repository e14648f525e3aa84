"""Writers: appended, replaced, upserted and promoted tables, CSV and JSON lines.

A table is a folder of parts and of numbered versions. A part is a folder of Parquet files, written once and never changed; a version is a
small file that names the parts that hold, and for each stream the last batch that is in them. A write puts down its parts
first and its version last, so readers and a repeated write never see half of one. All writers of this module share that layout.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A whole small file under a new name."""
    draft, files = _files(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    at, _ = _files(spark, path)
    if files.exists(at) or not files.rename(draft, at):
        files.delete(draft, False)
        raise FileExistsError(f"{path} was written meanwhile")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions, in order."""
    at, files = _files(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n[1:-5]) for n in names if re.fullmatch(r"v\d+\.json", n))


def _state(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """What a version says, the newest one by default. parts: (folder, bucket); batches: stream -> number."""
    found = versions(spark, folder)
    if not found:
        return {"number": -1, "parts": [], "batches": {}, "buckets": None}
    number = found[-1] if number is None else number
    at, _ = _files(spark, f"{folder}/v{number}.json")
    return {"number": number} | json.loads(spark.read.text(at.toString(), wholetext=True).first().value)


def _commit(spark: SparkSession, folder: str, before: dict, **changed) -> int:
    number = before["number"] + 1
    said = {k: changed.get(k, before[k]) for k in ("parts", "batches", "buckets")}
    _put(spark, f"{folder}/v{number}.json", json.dumps(said))
    return number


def _parts(spark: SparkSession, folder: str, parts: list) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[f"{folder}/{name}" for name, _ in parts])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version."""
    state = _state(spark, folder)
    if not state["parts"]:
        raise FileNotFoundError(f"{folder} is not a table yet")
    return _parts(spark, folder, state["parts"])


def _new_part(df: DataFrame, folder: str) -> str:
    name = f"part-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    return name


def write(df: DataFrame, folder: str) -> int:
    """df as the next version, in place of all rows before; its number."""
    before = _state(df.sparkSession, folder)
    return _commit(df.sparkSession, folder, before, parts=[[_new_part(df, folder), None]], buckets=None)


def prune(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all versions but the newest `keep`, and the parts that only those had."""
    found = versions(spark, folder)
    kept = {name.split("/")[0] for n in found[-keep:] for name, _ in _state(spark, folder, n)["parts"]}
    gone = {name.split("/")[0] for n in found[:-keep] for name, _ in _state(spark, folder, n)["parts"]} - kept
    for name in [*sorted(gone), *[f"v{n}.json" for n in found[:-keep]]]:
        at, files = _files(spark, f"{folder}/{name}")
        files.delete(at, True)


def _is_done(state: dict, batch: tuple[str, int] | None) -> bool:
    return batch is not None and state["batches"].get(batch[0], -1) >= batch[1]


def _marked(state: dict, batch: tuple[str, int] | None) -> dict:
    return state["batches"] | ({batch[0]: batch[1]} if batch else {})


def append(df: DataFrame, folder: str, batch: tuple[str, int] | None = None) -> None:
    """Bulk insert: rows as they are. batch: (stream, number); one that the table has already changes nothing."""
    before = _state(df.sparkSession, folder)
    if not _is_done(before, batch):
        if before["buckets"]:
            raise ValueError(f"{folder} is kept in buckets: use upsert")
        _commit(df.sparkSession, folder, before, parts=[*before["parts"], [_new_part(df, folder), None]], batches=_marked(before, batch))


def upsert(df: DataFrame, folder: str, key: str, changed, merge, buckets: int = 64, batch: tuple[str, int] | None = None) -> list[int]:
    """Merge df, whose keys are distinct, into a table that is kept in buckets by its key; the buckets written anew.

    changed(old, new): the rows of new that say more than the table. merge(old, new): the rows of a bucket afterwards. Only buckets with changed rows
    are read for the merge and written; a batch that the table has already, or that says nothing new, writes no part. The number of
    buckets holds from the first write on."""
    spark = df.sparkSession
    before = _state(spark, folder)
    if _is_done(before, batch):
        return []
    if before["parts"] and not before["buckets"]:
        raise ValueError(f"{folder} is not kept in buckets")
    count = before["buckets"] or buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    own = before["parts"]
    news = (changed(_parts(spark, folder, own), df) if own else df).withColumn("_bucket", bucket).persist()
    try:
        touched = sorted(r._bucket for r in news.select("_bucket").distinct().collect())  # `buckets` rows at most
        if touched:
            there = [p for p in own if p[1] in touched]
            new = news.drop("_bucket")
            rows = merge(_parts(spark, folder, there), new) if there else new
            name = f"part-{uuid.uuid4().hex}"
            rows.withColumn("_bucket", bucket).repartition(min(len(touched), count), "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/{name}")
            own = [p for p in own if p[1] not in touched] + [[f"{name}/_bucket={b}", b] for b in touched]
        _commit(spark, folder, before, parts=own, buckets=count, batches=_marked(before, batch))
    finally:
        news.unpersist()
    return touched


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def replace_by_key(df: DataFrame, folder: str, keys: list[str]) -> int:
    """All rows of df's keys are replaced by df's; the new version's number."""
    found = versions(df.sparkSession, folder)
    return write(replaced(read(df.sparkSession, folder), df, keys) if found else df, folder)


def promoted(staging: DataFrame, production: DataFrame, key: str, approved) -> DataFrame:
    """production with the approved rows of staging that it lacks."""
    return production.unionByName(staging.filter(approved).join(production.select(key), key, "left_anti").select(production.columns))


def to_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; texts are quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def to_json_lines(df: DataFrame, folder: str) -> None:
    """A JSON object a line; nulls are left out."""
    df.write.mode("append").json(folder)


def audited(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """df with a key for each cell: sha256 of its keys and its raw text."""
    return df.withColumn("cell", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.coalesce(F.col(raw), F.lit(""))), 256))
