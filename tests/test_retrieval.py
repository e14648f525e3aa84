"""Full-text search, entities, walks and communities against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plenum.functions import dutch
from plenum.operators import entities, fulltext
from plenum.operators.louvain import local, louvain, modularity, weighted
from plenum.plans import graph, registry, retrieval
from plenum.plans.registry import Tables

SMALL = "/root/testdata/sf0.001"
#: Words and the stems that the Snowball stemmer is known to give them.
STEMS = {
    "lichamelijk": "licham", "lichamelijkheden": "licham", "lichte": "licht", "lichten": "licht", "opgingen": "opging", "opglijdende": "opglijd", "opheffing": "opheff", "bomen": "bom", "boom": "bom",
    "mogelijkheden": "mogelijk", "bereikbare": "bereik", "yoghurt": "yoghurt", "woningen": "woning", "vergadering": "vergader", "katten": "kat", "bedden": "bed", "veiligheid": "veilig", "één": "een",
}


def test_stems():
    assert {w: dutch.stem(w) for w in STEMS} == STEMS
    assert dutch.terms("De Bomen, en de KATTEN 2024") == [(1, "bom"), (4, "kat"), (5, "2024")]
    assert dutch.terms(None) == [] and dutch.terms("de het een") == []


def brute_fragment(text, wanted, least=15, most=35):
    """Every window of words that begins and ends with a hit is tried."""
    words = (text or "").split()
    of = [{t for _, t in dutch.terms(w)} & set(wanted or ()) for w in words]
    spans = [(-len(set().union(*of[i : j + 1])), j - i, i, j) for i in range(len(words)) if of[i] for j in range(i, min(len(words), i + most)) if of[j]]
    i, j = min(spans)[2:] if spans else (0, -1)
    j = max(j, min(len(words) - 1, i + least - 1))
    i = min(i, max(0, j - least + 1))
    last = min(len(words), i + most) - 1
    while j < last and len(words[j]) <= 3 and not of[j]:
        j += 1
    return " ".join(f"<b>{w}</b>" if of[k] else w for k, w in enumerate(words[i : j + 1], i))


def test_fragments():
    pick = random.Random(7)
    for _ in range(400):
        words = [pick.choice(["boom", "kat", "woning", "en", "de", "vergadering,", "straat-kat", "x"]) for _ in range(pick.choice([0, 1, 5, 14, 15, 16, 40, 120]))]
        wanted = pick.sample(["bom", "kat", "woning", "niets"], pick.randint(0, 4))
        assert fulltext.fragment(" ".join(words), wanted) == brute_fragment(" ".join(words), wanted)
    assert fulltext.fragment(None, None) == "" and fulltext.fragment("a b", None) == "a b"
    long = "woord " * 100_000 + "boom kat " + "woord " * 100_000
    assert fulltext.fragment(long, ["bom", "kat"]).startswith("<b>boom</b> <b>kat</b> woord")


def test_index_and_search(spark):
    docs = [(1, "Bomen en bomen in de stad", "park", 5), (2, "de boom", None, 6), (3, None, "boom", 7), (4, "", "", 8), (5, "katten " * 50_000, "stad", 9)]
    d = spark.createDataFrame(docs, "id long, text string, name string, year int")
    rows = {(r.id, r.term): r for r in fulltext.inverted(d, "id", ["text"], ["name"], ["year"]).collect()}
    assert rows[1, "bom"].text_at == [0, 2] and rows[1, "stad"].text_at == [5] and rows[1, "park"].name_at == [6] and rows[1, "bom"].n == 4 and rows[1, "bom"].year == 5
    assert rows[3, "boom"].name_at == [0] and len(rows[5, "kat"].text_at) == 50_000 and {i for i, _ in rows} == {1, 2, 3, 5}
    asked = spark.createDataFrame([(1, "boom", 0), (2, "bomen katten", 6), (3, "de", 0), (4, "onbekend", 0)], "q long, text string, since int").withColumn("terms", fulltext.question_terms("text"))
    got = fulltext.search(asked.drop("text"), fulltext.inverted(d, "id", ["text"], ["name"], ["year"]), d, "id", k=2, condition=F.col("year") >= F.col("since")).orderBy("q", "rank").collect()
    assert [(r.q, r.id, r["rank"]) for r in got] == [(1, 1, 1), (1, 2, 2), (2, 5, 1), (2, 2, 2)]
    mean, n = (4 + 1 + 1 + 50_001) / 5, 5
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    assert got[0].score == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / mean)), abs=1e-4)


def test_an_index_in_buckets_is_not_moved(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    fulltext.write_index(fulltext.inverted(docs, "doc_id", ["text"]), "stems_of_documents", 4)
    try:
        index = spark.table("stems_of_documents")
        plan = index.groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert index.count() == fulltext.inverted(docs, "doc_id", ["text"]).count()
    finally:
        spark.sql("DROP TABLE stems_of_documents")


def test_entities_longest_first(spark):
    texts = spark.createDataFrame([(1, "De gemeente Rotterdam Zuid bouwt in Rotterdam"), (2, "zuid"), (3, None), (4, "Rotterdam zuid bouwt, gemeente!")], "id long, text string")
    names = spark.createDataFrame([("rotterdam", "R"), ("rotterdam zuid", "RZ"), ("gemeente rotterdam", "GR"), ("zuid bouwt in", "ZBI"), ("ZUID", "Z"), ("", "none")], "term string, name string")
    hits = entities.dictionary_hits(texts, "id", "text", names)
    order = defaultdict(list)
    for r in entities.names_in_order(hits, "id").orderBy("id", "place").collect():
        order[r.id].append(r.name)
    assert order == {1: ["ZBI", "GR", "RZ", "R", "Z"], 2: ["Z"], 4: ["RZ", "R", "Z"]}
    apart = {(r.id, r.at, r.name) for r in entities.apart(hits, "id").collect()}
    assert apart == {(1, 3, "ZBI"), (1, 1, "GR"), (1, 6, "R"), (2, 0, "Z"), (4, 0, "RZ")}


def test_entities_of_a_question(spark):
    asked = spark.createDataFrame([(1, "Wat zei Van Dijk (VVD) over de Haven?"), (2, "haven HAVEN van dijk en de"), (3, "")], "q long, text string")
    registry_, gaz = [("van dijk", "Jan van Dijk"), ("dijk", "Jan van Dijk"), ("de", "Te Kort")], [("haven", "Haven"), ("van dijk", "jan van dijk"), ("vvd", "VVD")]
    nodes = [(7, "Organisation", "jan van dijk"), (9, "Person", "Jan van Dijk"), (8, "Location", "haven")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = entities.query_entities(asked, "q", "text", frame(registry_, "term string, name string"), frame(gaz, "term string, name string"), frame(nodes, "node long, kind string, name string"))
    assert {tuple(r) for r in got.collect()} == {(q, "Jan van Dijk", 9, "Person", 1.0, "politician_registry") for q in (1, 2)} | {(q, "Haven", 8, "Location", 0.9, "gazetteer") for q in (1, 2)} | {(1, "VVD", None, "Unknown", 0.9, "gazetteer")}


def test_a_wide_beam_walks_as_the_full_walk(spark):
    t = Tables(spark, SMALL)
    seeds = t.supplier.orderBy("s_suppkey").limit(3).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    full = {tuple(r.nodes) for r in graph.walk(graph.edges(t), seeds, limit=10**6).collect()}
    wide = retrieval.beam_walk(graph.edges(t), seeds.withColumn("q", F.lit(1)), 2, 10**6)
    assert {tuple(r.nodes) for r in wide.collect()} == full
    narrow = retrieval.beam_walk(graph.edges(t), seeds.withColumn("q", F.lit(1)), 2, 3).collect()
    by = defaultdict(list)
    for r in wide.collect():
        by[r.seed, r.depth].append((-round(r.total, 9), ">".join(r.nodes)))
    # one hop: the three best; two hops: the three best that go on from those
    for (seed, depth), paths in by.items():
        firsts = {tuple(r.nodes) for r in narrow if r.seed == seed and r.depth == 1}
        want = sorted(p for p in paths if depth == 1 or tuple(p[1].split(">")[:2]) in firsts)[:3]
        assert sorted((-round(r.total, 9), ">".join(r.nodes)) for r in narrow if r.seed == seed and r.depth == depth) == want


def test_a_hub_hands_on_a_bounded_number(spark):
    star = spark.createDataFrame([("hub", f"n{i}", "K", i / 3000) for i in range(3000)], "source string, target string, kind string, conf double")
    seeds = spark.createDataFrame([(q, f"n{q}") for q in range(5)], "q long, node string")
    got = retrieval.beam_walk(star, seeds, 2, 4).filter("depth = 2").collect()
    assert all(Counter(r.q for r in got)[q] == 4 for q in range(5)) and {r.nodes[-1] for r in got} == {"n2999", "n2998", "n2997", "n2996"}


def plain_modularity(pairs, labels):
    total, inside, degree = 0.0, 0.0, defaultdict(float)
    for a, b, w in pairs:
        total += w
        degree[labels[a]] += w
        inside += w * (labels[a] == labels[b])
    return inside / total - sum(k * k for k in degree.values()) / total**2


def ring_of_cliques():
    edges = [(10 * c + i, 10 * c + j) for c in range(12) for i, j in itertools.combinations(range(10), 2)]
    return edges + [(10 * c, 10 * ((c + 1) % 12) + 1) for c in range(12)] + [(3, 3), (None, 4), (1, 0), (0, 1)]


@pytest.mark.parametrize("bound", [0, 300, 10**6])
def test_communities_of_a_ring_of_cliques(spark, bound):
    """On tables, on tables first and then in one task, and in one task alone."""
    edges = spark.createDataFrame(ring_of_cliques(), "a long, b long")
    labels = {r.node: r.community for r in louvain(edges, local_edges=bound).collect()}
    assert len(labels) == 120 and all(len({labels[10 * c + i] for i in range(10)}) == 1 for c in range(12)) and 6 <= len(set(labels.values())) <= 12


def test_communities_are_as_modular_as_one_by_one(spark):
    pick = random.Random(3)
    group = {n: n % 8 for n in range(240)}
    pairs = [(a, b) for a, b in itertools.combinations(range(240), 2) if pick.random() < (0.25 if group[a] == group[b] else 0.02)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    both = [tuple(r) for r in weighted(edges).collect()]
    one = plain_modularity(both, local(both))
    labels = louvain(edges, local_edges=0)
    mine = {r.node: r.community for r in labels.collect()}
    assert plain_modularity(both, mine) == pytest.approx(modularity(weighted(edges), labels))
    assert plain_modularity(both, mine) > one - 0.02 and one > 0.4
    assert louvain(edges.limit(0)).count() == 0


def test_summaries_of_communities(spark):
    t = Tables(spark, SMALL)
    labels = {r.node: r.community for r in registry.queries()["louvain_communities"](spark, SMALL).collect()}
    edges = {tuple(r) for r in retrieval.supply(t).distinct().collect()}
    inside = Counter(n for a, b in edges if labels[a] == labels[b] for n in (a, b))
    got = registry.queries()["community_summaries"](spark, SMALL).collect()
    sizes = Counter(labels.values())
    for r in got:
        assert r.relations == inside[r.node] and r.size == sizes[r.community] and labels[r.node] == r.community
    for c in {r.community for r in got}:
        want = sorted((n for n in labels if labels[n] == c and inside[n]), key=lambda n: (-inside[n], n))[:20]
        assert [r.node for r in sorted(got, key=lambda r: r["rank"]) if r.community == c] == want


@pytest.mark.parametrize("sizes", [(4096, 512), (7, 3)])
def test_nearest_of_many_questions(spark, monkeypatch, sizes):
    """Blocks of any size give what every pair gives; ties go by ids, floors and nulls hold."""
    from plenum.operators import vectors

    monkeypatch.setattr(vectors, "VECTORS", sizes[0])
    monkeypatch.setattr(vectors, "QUESTIONS", sizes[1])
    pick = random.Random(8)
    own = [(i, [pick.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)] + [(None, [1.0] * 4), (99, None)]
    asked = [(f"q{j}", [pick.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for j in range(20)] + [("none", None)]
    got = defaultdict(list)
    rows = vectors.nearest_batched(spark.createDataFrame(own, "id long, v array<float>"), "id", "v", spark.createDataFrame(asked, "q string, vector array<float>"), 5, 0.5)
    for r in rows.orderBy("q", "rank").collect():
        got[r.q].append((r.id, r.score))
    for q, y in asked:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, x in own if x and y and i is not None)
        assert got[q] == [(i, -s) for s, i in scores if -s >= 0.5][:5]


def test_fusion_by_question(spark):
    from plenum.operators.vectors import fused

    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "q long, id long, rank int")
    two = spark.createDataFrame([(1, 12, 1), (1, 11, 2), (2, 9, 1)], "q long, id long, rank int")
    got = [(r.q, r.id, r["rank"]) for r in fused([one, two], "id").orderBy("q", "rank").collect()]
    assert got == [(1, 11, 1), (1, 10, 2), (1, 12, 3), (2, 10, 1), (2, 9, 2)]
