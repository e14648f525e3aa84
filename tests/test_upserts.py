"""Upserts over whole tables and whole texts."""

from plenum.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_upserts_over_whole_tables(spark):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    got = registry.queries()["upsert_pages"](spark, SMALL)
    ids = read("documents").select("doc_id").union(read("pages").select("page_id")).distinct()
    assert got.count() == ids.count()
    long = read("documents").join(read("pages").withColumnRenamed("page_id", "doc_id"), "doc_id", "left").filter("length(text) > 500 and length(text) >= coalesce(length(html), 0)")
    assert long.selectExpr("doc_id", "md5(text) hash").subtract(got.select("doc_id", "hash")).isEmpty() and not long.isEmpty()
    assert registry.queries()["insert_ignore_orders"](spark, SMALL).count() > read("lineitem").count()
