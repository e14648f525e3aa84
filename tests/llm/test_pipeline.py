"""The pipeline's stages, each on its predecessor's output."""

import corpus_pipeline
from plenum.llm import secrets, toxicity
from tests.llm.test_native import brute_contamination
from tests.llm.test_partenum import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    steps = dict(corpus_pipeline.STAGES)
    assert 4 <= len(steps) <= 5
    one = steps["toxicity"](spark, docs, SMALL)
    scored = toxicity.score_documents(docs, labels)
    assert ids(one) == ids(scored.filter("predicted = 0")) and one.columns == docs.columns
    two = steps["near copies"](spark, one, SMALL)
    assert ids(two) == sorted({r[2] for r in brute([(r.doc_id, r.text) for r in one.collect()], corpus_pipeline.PERCENT, corpus_pipeline.WORDS)}) and two.columns == docs.columns
    three = steps["decontamination"](spark, two, SMALL)
    judged = brute_contamination([(r.doc_id, r.text) for r in two.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ids(three) == sorted(r[0] for r in judged if not r[5])
    four = steps["secrets"](spark, three, SMALL)
    assert ids(four) == ids(three) and four.columns == docs.columns
    assert secrets.scan_secrets(four).filter("spans != ''").count() == 0
    five = steps["packing"](spark, four, SMALL)
    assert ids(five.select("doc_id").distinct()) == ids(four)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0


def test_rows_that_share_an_id(spark):
    """No unique text is lost with an id that another text has; of copies, one row stays; names may clash or need quotes."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("item_id = 0").first().text
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(2, a), (5, a + " tail"), (5, b), (5, b), (None, a), (None, b + " tail"), (None, "alone here"), (6, item), (6, "clean text"), (None, item), (9, None), (9, None), (10, ""), (11, "secret = abcdefgh12 " * 30 + "é")]
    schema = "doc_id long, text string, `a.b` int, row int, key string, lang string, source string, component_id long, _row int"
    docs = spark.createDataFrame([(*r, 1, 2, "k", "en", None, 3, 4) for r in rows], schema)
    stay = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert stay.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in stay.collect()), key=str)
    assert texts == sorted([(2, a), (5, b), (None, "alone here"), (6, item), (6, "clean text"), (9, None), (9, None), (10, ""), (11, rows[-1][1])], key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SMALL)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([r for r in rows if r[1] != item], key=str)
    masked = corpus_pipeline.mask_secrets(spark, clean, SMALL)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    assert masked.filter("doc_id = 11").first().text == "[SECRET] " * 30 + "é"
    packed = corpus_pipeline.pack(spark, masked, SMALL)
    assert packed.filter("start = 0").count() == masked.count()
