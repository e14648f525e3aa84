"""Helpers that hold groups of any size, and plans that stay as they should be."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import relops
from plenum.plans import registry

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_not_in_keeps_its_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "x long")
    got = lambda xs: sorted((r.k for r in relops.not_in(left, "k", rows(xs), "x").collect()), key=str)
    assert got([1, 1, 5]) == [2] and got([1, None]) == [] and got([]) == [1, 2, None] and got([7]) == [1, 2]


def test_not_in_broadcasts_no_list(spark):
    assert "NullAware" not in plan(registry.queries()["not_in_null_aware"](spark, SMALL)) and "isNullAwareAntiJoin" not in plan(registry.queries()["not_in_null_aware"](spark, SMALL))


def test_places_and_quantiles_of_a_hot_group(spark):
    pick = random.Random(4)
    rows = [("hot", pick.randint(0, 40) / 4) for _ in range(900)] + [(None, 1.0), (None, 2.0), ("one", 5.0), ("none", None)] + [(f"g{i}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    placed = relops.ranked(df, ["k"], [F.col("v")]).collect()
    for k in {r[0] for r in rows}:
        own = sorted((r.place, r.v) for r in placed if r.k == k)
        assert [p for p, _ in own] == list(range(len(own))) and all(r.members == len(own) for r in placed if r.k == k)
        assert [v for _, v in own if v is not None] == sorted(v for kk, v in rows if kk == k and v is not None)
    got = {r.k: (r.a, r.b) for r in relops.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    want = {r.k: (r.a, r.b) for r in df.filter("v is not null").groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.9).alias("b")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["table_fact_lines", "euro_amounts", "document_layouts", "garbled_texts", "verified_sentences"])
def test_generated_code_compiles(spark, name):
    """Expressions that are written out too often make methods that don't compile; Spark would go on without them, and slowly."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        registry.queries()[name](spark, SMALL).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_one_shuffle_of_the_lines(spark):
    text = plan(registry.queries()["meeting_listing"](spark, SMALL))
    assert text.count("l_linenumber") and text.count("FileScan parquet") == 3
