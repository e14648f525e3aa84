"""Odd inputs and plans of queries that failed over larger tables."""

import random

import pytest
from pyspark.sql import functions as F

from plenum.llm import spelling
from plenum.operators import fulltext, louvain
from plenum.operators.shared import written
from plenum.plans import registry

#: Queries whose questions are asked by all of their terms.
ASKED_WHOLE = ["batched_search", "batched_hybrid", "broad_scan", "role_search"]


def test_texts_without_words_have_sentences(spark, tmp_path):
    """A text without words has sentences of no relevance; those of other texts are chosen as before."""
    rows = [(1, "Een zin. Nog een."), (2, ""), (3, "!!! ... ??"), (4, None), (5, "a. b.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["mmr_sentences"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 0, 1), (1, 1, 2), (2, 0, 1), (3, 0, 1), (3, 1, 2), (3, 2, 3), (5, 0, 1), (5, 1, 2)}


def test_signatures_are_not_broadcast(spark):
    """Signatures are many times what their words' table is sized at: they meet by a shuffle however small that table is."""
    words = spark.createDataFrame([("woning", 9), ("woningen", 5), ("woninge", 3)], "word string, n long")
    pairs = spelling.near_pairs(words)
    assert {(r.word, r.near) for r in pairs.collect()} == {("woning", "woninge"), ("woninge", "woning"), ("woningen", "woninge"), ("woninge", "woningen")}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("most", [1, 8, None])
def test_blocks_of_documents_are_bounded_by_postings(spark, monkeypatch, most):
    """Blocks of any number of documents and postings give what one block gives, whatever kind of keys there is; none holds many postings more than its bound."""
    pick, words = random.Random(11), [f"woord{i}" for i in range(40)]
    docs = [(f"d{i:03}", " ".join(pick.choices(words[: pick.choice([3, 40])], k=pick.randint(1, 60)))) for i in range(90)]
    d = spark.createDataFrame(docs + [(None, "woord1")], "id string, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(pick.sample(words, 6))) for i in range(30)], "q string, text string").withColumn("terms", fulltext.question_terms("text")).drop("text")
    asked = asked.unionByName(asked.withColumn("q", F.concat("q", F.lit("again"))))
    index = written(fulltext.inverted(d, "id", ["text"]))
    whole = fulltext.search(asked, index, d, "id", k=4, most=most).collect()
    packed, posted = [], fulltext._posted
    monkeypatch.setattr(fulltext, "_posted", lambda *x: packed.append(posted(*x)) or packed[-1])
    for name, value in (("POSTINGS", 100), ("DOCUMENTS", 25), ("QUESTIONS", 7), ("CELLS", 50)):
        monkeypatch.setattr(fulltext, name, value)
    assert set(fulltext.search(asked, index, d, "id", k=4, most=most).collect()) == set(whole) and len(whole) > 200
    sizes = [len(r.d_docs) // 4 for r in packed[0].collect()]
    assert sum(sizes) == index.filter("id is not null").count() and max(sizes) < 100 + 40 and len(sizes) > 5


def test_a_question_is_asked_by_all_of_its_terms(spark):
    """The ninth rarest term of a question finds a document that has no other, and counts where others are there."""
    words = [f"woord{i}" for i in range(9)]
    docs = [(i, " ".join(words[j] for j in range(9) if i > 18 - 2 * j)) for i in range(1, 21)]
    d = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words[1:] + ["woord0"]))], "q long, text string").withColumn("terms", fulltext.question_terms("text")).drop("text")
    docs_of = lambda most: {r.id: r.score for r in fulltext.search(asked.withColumn("terms", F.col("terms")), fulltext.inverted(d, "id", ["text"]), d, "id", k=30, most=most).collect()}
    every, eight = docs_of(None), docs_of(8)
    assert set(every) == {i for i, text in docs if text} and set(eight) < set(every) and all(every[i] >= s for i, s in eight.items())


@pytest.mark.parametrize("name", ASKED_WHOLE)
def test_whole_questions(spark, monkeypatch, name):
    asked, search = [], fulltext.search
    monkeypatch.setattr(fulltext, "search", lambda *x, **how: asked.append(how["most"]) or search(*x, **how))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == [None] and "rn <= 8" not in registry.oracle_sql()[name]


def test_nodes_with_names_are_numbers_in_a_sweep(spark, monkeypatch):
    """Names as numbers give the communities that the names themselves give."""
    pick = random.Random(12)
    rows = [(f"n{a}", f"n{b}") for a in range(80) for b in range(a) if pick.random() < (0.4 if a % 5 == b % 5 else 0.04)]
    edges = spark.createDataFrame(rows, "a string, b string")
    kinds, level = [], louvain._level
    monkeypatch.setattr(louvain, "_level", lambda e, *x: kinds.append(e.schema["a"].dataType.simpleString()) or level(e, *x))
    found = {tuple(r) for r in louvain.louvain(edges, local_edges=100).collect()}
    assert kinds and set(kinds) == {"bigint"} and {c for _, c in found} <= {n for n, _ in found} and len(found) == 80
    monkeypatch.setattr(louvain, "_numbered", lambda e: (e, None))
    assert {tuple(r) for r in louvain.louvain(edges, local_edges=100).collect()} == found
