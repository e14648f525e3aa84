"""Every chunk is audited against its whole document."""

from plenum.plans import registry
from plenum.plans.texts import audited

SMALL = "/root/testdata/sf0.001"


def test_every_chunk_is_audited(spark):
    got = registry.queries()["attribution_audit"](spark, SMALL)
    chunks = registry.queries()["document_chunks"](spark, SMALL)
    assert got.select("doc_id", "chunk_index").exceptAll(chunks.select("doc_id", "chunk_index")).isEmpty()
    assert got.count() == chunks.count() > chunks.select("doc_id").distinct().count()
    docs = spark.createDataFrame([(1, "x " * 400 + "the end of\na long text"), (2, None)], "doc_id long, text string")
    rows = [(1, 0, "end of\na long"), (1, 1, "end  of a long"), (1, 2, "long text of a end the more"), (1, 3, "another document altogether"), (2, 0, "a"), (3, 0, "a")]
    classes = {(r.doc_id, r.chunk_index): r.match for r in audited(spark.createDataFrame(rows, "doc_id long, chunk_index int, content string"), docs).collect()}
    assert classes == {(1, 0): "exact", (1, 1): "whitespace", (1, 2): "overlap", (1, 3): "mismatch", (2, 0): "missing", (3, 0): "missing"}
