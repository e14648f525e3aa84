import json
from collections import defaultdict

from pyspark.sql import functions as F

from plenum import sinks
from plenum.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_hourly_equals_batch(spark, tmp_path):
    got = {r.hour: (r.n, r.errors) for r in run(jobs.hourly(jobs.event_stream(spark, SMALL)), "hourly", "complete", tmp_path).collect()}
    rows = spark.read.parquet(f"{SMALL}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e")).collect()
    assert got == {r.h: (r.n, r.e) for r in rows}


def test_admission_is_sequential(spark, tmp_path):
    got = {r.event_id: r.admitted for r in run(jobs.admitted(jobs.event_stream(spark, SMALL), 2, 36000), "admitted", "append", tmp_path).collect()}
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts", "event_id").collect():
        before = [x for x in by[r.user_id] if x > r.ts.timestamp() - 36000]
        ok = len(before) < 2
        assert got[r.event_id] == ok
        by[r.user_id] = before + [r.ts.timestamp()] * ok


def test_upsert_sink(spark, tmp_path):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    sink = jobs.upsert_sink(str(tmp_path / "docs"), "doc_id", "text")
    sink(d.filter("doc_id < 100").withColumn("text", F.substring("text", 1, 20)), 0)
    sink(d.filter("doc_id >= 50"), 1)
    sink(d.filter("doc_id < 100").withColumn("text", F.lit("a repeated batch")), 1)
    got = sinks.read(spark, str(tmp_path / "docs"))
    assert got.count() == d.count()
    assert got.filter("doc_id >= 50").join(d, ["doc_id", "text"]).count() == d.filter("doc_id >= 50").count()


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "t")
    sink = jobs.upsert_sink(folder, "k", "v", buckets=8)
    rows = lambda xs: spark.createDataFrame(xs, "k long, v string, name string")
    sink(rows([(i, "x" * 10, f"n{i}") for i in range(200)]), 0)
    first = {p for p, _ in sinks._state(spark, folder)["parts"]}
    sink(rows([(7, "y" * 20, None), (8, "y", "n8"), (None, "z", "z")]), 1)  # one longer text; a shorter one and one without a key say nothing
    second = {p for p, _ in sinks._state(spark, folder)["parts"]}
    assert len(first) == len(second) == 8 and len(second - first) == 1
    sink(rows([(9, "s", "other name")]), 2)
    got = {r.k: (r.v, r.name) for r in sinks.read(spark, folder).collect()}
    assert len(got) == 200 and got[7] == ("y" * 20, "n7") and got[8] == ("x" * 10, "n8") and got[9] == ("x" * 10, "other name")


def drop_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_incremental_ingest(spark, tmp_path):
    """Files come one after another; a restart, a new checkpoint and a batch that failed after its write change nothing."""
    source, folder = tmp_path / "files", str(tmp_path / "table")
    go = lambda checkpoint: jobs.ingest(spark, str(source), "id long, text string, url string", folder, str(tmp_path / checkpoint), "id", "text", 4).awaitTermination(120)
    rows = lambda: {r.id: (r.text, r.url) for r in sinks.read(spark, folder).collect()}
    drop_file(source, "a.json", [{"id": 1, "text": "short"}, {"id": 2, "text": None, "url": "http://2"}, {"id": 1, "text": "a longer one"}])
    go("c1")
    assert rows() == {1: ("a longer one", None), 2: (None, "http://2")}
    drop_file(source, "b.json", [{"id": 1, "text": "tiny", "url": "http://1"}, {"id": 2, "text": "fetched at last"}, {"id": 3, "text": ""}])
    go("c1")
    want = {1: ("a longer one", "http://1"), 2: ("fetched at last", "http://2"), 3: ("", None)}
    assert rows() == want
    parts = sinks._state(spark, folder)["parts"]
    go("c1")  # nothing is new
    go("c2")  # another query reads all files again, its batches count from 0
    assert rows() == want and sinks._state(spark, folder)["parts"] == parts
    drop_file(source, "c.json", [{"id": 4, "text": "new"}])
    go("c2")
    assert rows() == want | {4: ("new", None)}
    assert sorted(sinks._state(spark, folder)["batches"].values()) == [1, 1] and all(sinks._state(spark, folder)["batches"])
    commits = sorted((tmp_path / "c2" / "commits").glob("[0-9]*"))
    commits[-1].unlink()  # the query failed after the table was written: the batch is run again
    for crc in (tmp_path / "c2" / "commits").glob(".*crc"):
        crc.unlink()
    before = sinks.versions(spark, folder)
    go("c2")
    assert rows() == want | {4: ("new", None)} and sinks.versions(spark, folder) == before


def test_documents_to_fetch(spark):
    table = spark.createDataFrame([(1, "x" * 100), (2, "x" * 99), (3, None), (4, "")], "id long, text string")
    listed = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u"), (4, None), (5, None), (6, "u")], "id long, url string")
    assert sorted(r.id for r in jobs.to_fetch(listed, table, "id", "text", "url").collect()) == [2, 3, 5, 6]


def test_alerts_cool_down(spark, tmp_path):
    events = jobs.event_stream(spark, SMALL).withColumn("rule", F.col("event_type"))
    got = {r.event_id: r.sent for r in run(jobs.cooled(events, 7200), "cooled", "append", tmp_path).collect()}
    last = {}
    for r in spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts", "event_id").collect():
        sent = r.ts.timestamp() - last.get(r.event_type, float("-inf")) >= 7200
        assert got[r.event_id] == sent
        last[r.event_type] = r.ts.timestamp() if sent else last.get(r.event_type, float("-inf"))


def test_each_event_once(spark, tmp_path):
    twice = jobs.event_stream(spark, SMALL)
    got = run(jobs.once(twice.union(twice)), "once", "append", tmp_path)
    assert got.count() == got.select("event_id").distinct().count() == spark.read.parquet(f"{SMALL}/events.parquet").count()
