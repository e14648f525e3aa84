"""Event streams: windows, deduplication, an upsert sink and an admission limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from plenum import sinks
from plenum.operators.relops import distinct_on, merge_longest


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The tail of a folder of event files; ts as a timestamp, for watermarks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls and errors of each hour; rows later than `late` are dropped with their window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"))
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("window.start").alias("hour"), "n", "errors")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def admitted(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """event_id, admitted: an event passes if fewer than limit *admitted* ones of its user lie in the seconds before it.

    Whether one passes depends on those that passed before, so the times of admitted events (limit at most) are state; that of a user who is
    silent for longer than the seconds goes."""

    def judge(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for i, ts in zip(rows["event_id"], rows["ts"], strict=True):
            at = ts.timestamp()
            times = [x for x in times if x > at - seconds]
            out.append((i, len(times) < limit))
            times += [at] * out[-1][1]
        state.update((times,))
        state.setTimeoutDuration(max(seconds, 60) * 1000)
        yield pd.DataFrame(out, columns=["event_id", "admitted"])

    return events.groupBy("user_id").applyInPandasWithState(judge, "event_id long, admitted boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def cooled(alerts: DataFrame, seconds: int) -> DataFrame:
    """event_id, sent: an alert is sent unless one of its rule was sent in the seconds before it. alerts: event_id, ts, rule."""

    def judge(key, frames, state):
        last = state.get[0] if state.exists else float("-inf")
        out = []
        for i, ts in pd.concat(list(frames)).sort_values(["ts", "event_id"])[["event_id", "ts"]].itertuples(index=False):
            sent = ts.timestamp() - last >= seconds
            last = ts.timestamp() if sent else last
            out.append((i, sent))
        state.update((last,))
        state.setTimeoutDuration(seconds * 1000)  # a rule that is silent for longer needs no state
        yield pd.DataFrame(out, columns=["event_id", "sent"])

    def kept(key, frames, state):
        if state.hasTimedOut:
            state.remove()
        else:
            yield from judge(key, frames, state)

    return alerts.groupBy("rule").applyInPandasWithState(kept, "event_id long, sent boolean", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_sink(folder: str, key: str, text: str, buckets: int = 64, keep: int = 2):
    """A foreachBatch function that merges each batch into folder, the longest text of a key winning (the least of equally long ones).

    The table remembers the last batch of each query: one that is repeated after a failure changes nothing. A query with a new checkpoint is another
    one, whose batches begin at 0 again; rows that it reads once more say nothing new, and so write nothing. A batch rewrites only the
    buckets of keys whose rows it changes."""

    def changed(old: DataFrame, new: DataFrame) -> DataFrame:
        there = old.select(key, F.coalesce(F.length(text), F.lit(0)).alias("_length"), F.struct(*[c for c in new.columns if c not in (key, text)], F.lit(0)).alias("_rest"))
        rest = F.struct(*[F.coalesce(F.col(c), F.col("_rest").getField(c)).alias(c) for c in new.columns if c not in (key, text)], F.lit(0))
        longer = F.coalesce(F.length(text), F.lit(0)) > F.col("_length")
        return new.join(there, key, "left").filter(F.col("_length").isNull() | longer | ~rest.eqNullSafe(F.col("_rest"))).select(new.columns)

    def merge(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        newest = distinct_on(batch.filter(F.col(key).isNotNull()), [key], [F.desc(F.length(text)), F.col(text)])
        sinks.upsert(newest, folder, key, changed, lambda old, new: merge_longest(old, new, key, text), buckets, (query, number))
        sinks.prune(batch.sparkSession, folder, keep)

    return merge


def ingest(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, key: str, text: str, buckets: int = 64):
    """Incremental ingest: new JSON files of source are merged into the table of folder; files that the checkpoint knows aren't read again.

    The query runs until all files there are in the table, and may be started again at any time."""
    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(upsert_sink(folder, key, text, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_fetch(listed: DataFrame, table: DataFrame, key: str, text: str, url: str, least: int = 100) -> DataFrame:
    """Of the listed documents, those that the table lacks, and those with an address whose stored text is shorter than least."""
    there = table.select(key, F.coalesce(F.length(text), F.lit(0)).alias("_length"))
    found = listed.join(there, key, "left")
    return found.filter(F.col("_length").isNull() | (F.col(url).isNotNull() & (F.col(url) != "") & (F.col("_length") < least))).select(listed.columns)
