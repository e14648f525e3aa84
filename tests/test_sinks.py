"""Writers, against rows in memory."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from plenum import sinks


def test_replace_by_key_and_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda xs: spark.createDataFrame(xs, "k long, v string")
    assert sinks.replace_by_key(rows([(1, "a"), (1, "b"), (2, "c")]), folder, ["k"]) == 0
    assert sinks.replace_by_key(rows([(1, "z"), (3, "d")]), folder, ["k"]) == 1
    assert sorted(map(tuple, sinks.read(spark, folder).collect())) == [(1, "z"), (2, "c"), (3, "d")]
    sinks.replace_by_key(rows([(2, "y")]), folder, ["k"])
    sinks.prune(spark, folder)
    assert sinks.versions(spark, folder) == [1, 2] and sinks.versions(spark, str(tmp_path / "none")) == []
    assert len(glob.glob(f"{folder}/part-*")) == 2
    with pytest.raises(FileNotFoundError):
        sinks.read(spark, str(tmp_path / "none"))


def test_all_writers_share_one_layout(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda xs: spark.createDataFrame(xs, "k long, v string")
    got = lambda: sorted(map(tuple, sinks.read(spark, folder).collect()))
    sinks.append(rows([(1, "a")]), folder)
    sinks.append(rows([(1, "a"), (2, "b")]), folder)
    assert got() == [(1, "a"), (1, "a"), (2, "b")]
    sinks.replace_by_key(rows([(1, "z")]), folder, ["k"])
    sinks.append(rows([(3, "c")]), folder)
    assert got() == [(1, "z"), (2, "b"), (3, "c")]
    assert sinks.write(rows([(9, "q")]), folder) == 4 and got() == [(9, "q")]
    for _ in range(2):  # a batch that is repeated counts once, another stream's is another one
        sinks.append(rows([(5, "e")]), folder, ("s", 0))
    sinks.append(rows([(6, "f")]), folder, ("t", 0))
    assert got() == [(5, "e"), (6, "f"), (9, "q")]
    with pytest.raises(ValueError):
        sinks.upsert(rows([(1, "x")]), folder, "k", lambda old, new: new, lambda old, new: new)
    sinks._put(spark, f"{folder}/v99.json", "{}")
    with pytest.raises(FileExistsError):
        sinks._put(spark, f"{folder}/v99.json", "{}")


def test_append_and_promote(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True)], "id long, v string, ok boolean")
    for _ in range(2):
        sinks.append(d, str(tmp_path / "log"))
    assert sinks.read(spark, str(tmp_path / "log")).count() == 6
    got = sinks.promoted(d, d.filter("id = 3").drop("ok"), "id", F.col("ok"))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (3, "c")]


def test_csv_json_and_cells(spark, tmp_path):
    d = spark.createDataFrame([(1, 'say "hi",\nok'), (2, None)], "id long, v string")
    sinks.to_csv(d.coalesce(1), str(tmp_path / "c"))
    with open(glob.glob(str(tmp_path / "c/part-*"))[0], newline="") as f:
        assert list(csv.reader(f)) == [["id", "v"], ["1", 'say "hi",\nok'], ["2", ""]]
    sinks.to_json_lines(d.coalesce(1), str(tmp_path / "j"))
    lines = [json.loads(x) for f in glob.glob(str(tmp_path / "j/part-*")) for x in open(f)]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": 1, "v": 'say "hi",\nok'}, {"id": 2}]
    import hashlib

    cells = sinks.audited(d, ["id"], "v").orderBy("id").collect()
    assert cells[1].cell == hashlib.sha256(b"2|").hexdigest()
