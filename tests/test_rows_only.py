"""Queries and helpers without SQL, against plain Python."""

import re
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import functions as F

from plenum.functions import rules, speech
from plenum.functions.text import sentences
from plenum.plans import graph, linking, registry, speech as plans
from plenum.sources import tables
from plenum.sources.chunks import cut_points

SMALL = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SMALL)


def words(t):
    return {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}


def test_mmr_sentences(spark):
    got = defaultdict(dict)
    for r in run(spark, "mmr_sentences").collect():
        got[r.doc_id][r.chosen] = r.pos
    split = lambda t: [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 3000").limit(40).collect():
        parts = re.split(r"(?<=[.!?])\s+", r.text)
        total = len(set(split(r.text)))
        rows = [(i, set(split(p)), round(len(set(split(p))) / total, 8)) for i, p in enumerate(parts)]
        left, out = sorted(rows, key=lambda x: (-x[2], x[0]))[:50], []
        place = {x[0]: k for k, x in enumerate(left, 1)}
        like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        while left and len(out) < 5:
            best = max(left, key=lambda x: (0.6 * x[2] - 0.4 * max((like(x[1], o[1]) for o in out), default=0.0), -place[x[0]]))
            out.append(best)
            left.remove(best)
        assert [got[r.doc_id][k] for k in sorted(got[r.doc_id])] == [x[0] for x in out]


def test_document_chunks(spark):
    """Chunks cover the text in order, overlap as they should and keep to their lengths."""
    by = defaultdict(list)
    for r in run(spark, "document_chunks").collect():
        by[r.doc_id].append(r)
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        rows = sorted(by[d.doc_id], key=lambda r: r.chunk_index)
        assert [(r.start, r.stop) for r in rows] == cut_points(d.text)
        assert all(d.text[r.start : r.stop] == r.content and len(r.content) <= 2500 for r in rows)
        assert all(b.start == max(a.start + 1, a.stop - 250) for a, b in zip(rows, rows[1:], strict=False))
        assert not rows or d.text[rows[-1].stop :].strip() == "" or len(d.text[rows[-1].stop :].strip()) < 20


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.found.append(dict(attrs)["href"])


def test_page_outlinks(spark):
    df = run(spark, "page_outlinks")
    rows = df.collect()
    want = 0
    for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        parser = Links()
        parser.feed(p.html)
        want += len(set(parser.found)) > 0
    assert len({r[0] for r in rows}) == want and rows


def test_time_chunks(spark):
    rows = [(1, i, s) for i, s in enumerate([0, 100, 300, 600, 719, 720, 800, 1500, 1501])] + [(2, 0, 5.0)]
    got = defaultdict(list)
    for r in plans.time_chunks(spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "conv_id long, turn long, start double")).collect():
        got[(r.conv_id, r.chunk)].append(r.turn)
    assert {k: sorted(v) for k, v in got.items()} == {(1, 0): [0, 1, 2, 3, 4], (1, 1): [3, 4, 5, 6], (1, 2): [7, 8], (2, 0): [0]}


def test_separators_and_sentences(spark):
    text = "aa bb\n\ncc dd ee\nff " + "x" * 30
    pieces = plans.split_by_separators(text, 10, 3)
    assert all(len(p) <= 10 for p in pieces) and "".join(pieces).replace(" ", "").replace("\n", "").startswith("aabb")
    sizes = run(spark, "separator_chunks")
    assert sizes.filter("size > 7500").count() == 0 and sizes.select("doc_id").distinct().count() == spark.read.parquet(f"{SMALL}/documents.parquet").filter("trim(text) != ''").count()
    first = {r.doc_id: r.excerpt for r in run(spark, "first_sentences").collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", sentences(F.col("text")).alias("s")).collect():
        assert first[r.doc_id] == " ".join(r.s[:3])


def test_agenda_parents_of_the_rules(spark):
    """Overlap, one shared word too far away, ties to the nearest, and items before the first lead."""
    items = [(1, 1, None, "Begroting wonen"), (1, 2, "1", "Haven en wonen"), (1, 3, "2", "Begroting haven"), (1, 4, None, "Bijlage begroting haven"), (1, 5, None, "Iets anders"), (1, 6, None, "x"), (1, 7, None, "zorg"), (1, 8, None, "brief over wonen"), (2, 1, None, "los")]
    df = spark.createDataFrame(items, "g long, pos int, number string, name string")
    got = {(r.g, r.pos): (r.parent, r.how) for r in linking.parents(df, "g", "pos", F.col("number"), F.col("name")).collect()}
    assert got == {(1, 1): (2, "words"), (1, 4): (3, "words"), (1, 5): (3, "place"), (1, 6): (3, "place"), (1, 7): (3, "place"), (1, 8): (3, "place"), (2, 1): (None, "none")}


def test_rules_and_cues(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    long = "Degemeenteraadvanrotterdamheeftbesloten " * 6
    assert one(rules.garbled(F.lit(long))) and not one(rules.garbled(F.lit("Een gewone zin met https://voorbeeld.example/" + "a" * 60 + " erin, en verder niets bijzonders hoor.")))
    assert not one(rules.garbled(F.lit(None).cast("string"))) and not one(rules.garbled(F.lit("x" * 40)))
    assert not one(rules.substantive(F.lit("1.5"), F.lit("Vaststellen agenda"), F.lit("Raad")))
    assert one(rules.substantive(F.lit("1.0"), F.lit("Opening"), F.lit("commissie COR")))
    assert tuple(one(speech.cue(F.lit("Mijn naam is Jan de Vries bewoner van Zuid")))) == ("intro", "Jan de Vries bewoner")
    assert one(speech.cue(F.lit("Mijn naam is Jan de Vries en ik woon hier"))) is None  # a last word of two letters is no name
    assert tuple(one(speech.cue(F.lit("De heer Tak.")))) == ("standalone", "Tak")
    assert tuple(one(speech.cue(F.lit("Dank u wel voorzitter")))) == ("chair", None)
    assert one(speech.cue(F.lit("gewoon een zin"))) is None
    assert one(speech.precleaned(F.lit(None).cast("string"))) is None and one(speech.precleaned(F.lit("eh"))) == ""


def test_walk_of_the_rules(spark):
    e = spark.createDataFrame([("a", "b", "K", None, "kg", None), ("b", "c", "K", 0.5, "vn", 0.4), ("c", "a", "K", 0.9, None, None), ("b", None, "K", 0.9, "kg", None), ("b", "d", "L", 0.9, "kg", 0.9)], "source string, target string, kind string, conf double, origin string, quality double")
    seeds = spark.createDataFrame([("a",)], "node string")
    paths = lambda **k: {">".join(r.nodes): round(r.total, 6) for r in graph.walk(e, seeds, **k).collect()}
    assert paths() == {"a>b": 0.8, "a>c": 0.9, "a>b>c": 0.4, "a>b>d": 0.72, "a>c>b": 0.45}
    assert paths(excluded=["vn"]) == {"a>b": 0.8, "a>c": 0.9, "a>b>d": 0.72}
    assert paths(least=0.5) == {"a>b": 0.8, "a>c": 0.9, "a>b>d": 0.72}
    assert list(paths(limit=2)) == ["a>c", "a>b"] and paths(kinds=["L"]) == {}
    scores = {">".join(r.nodes): r.score for r in graph.scored(graph.walk(e, seeds), {"L": 4.0}, derived=["vn"]).collect()}
    assert scores["a>b>d"] == round(0.72 * 0.7 * 2, 6) and scores["a>b>c"] == round(0.4 * 0.7 * 0.7, 6)


def test_verified_between_the_bounds(spark):
    """Between the bounds, facts decide."""
    chunk = "De raad besloot in 2024 over Rotterdam"
    said = [(1, 0, "vier vijf zes zeven acht raad en Rotterdam 2024"), (1, 1, "vier vijf zes zeven acht raad en Amsterdam 2031"), (1, 2, "een twee drie vier vijf zes raad besloot")]
    rows = plans.verified(spark.createDataFrame(said, "doc_id long, pos int, sentence string"), spark.createDataFrame([(1, 0, chunk)], "doc_id long, chunk int, content string"))
    assert {r.pos: r.kind for r in rows.collect()} == {0: "paraphrase", 1: "hallucination", 2: "paraphrase"}


def test_tables_of_the_rules(spark):
    t = spark.createDataFrame([(1, '{"headers": ["Tekst", "x"], "rows": [["a", "b"]]}'), (2, "no json"), (3, '{"headers": ["Prog.", "Lasten 2023", "2023 saldo"], "rows": [["Wonen", "1.000", "0"], ["", "(5)", ""], ["Totaal", "2", "3"], ["Zorg", "-", ""], ["", "7", ""]]}')], "k long, table_json string")
    rows = sorted(tuple(r)[:8] for r in tables.fact_lines(tables.parsed(t), "k").collect())
    assert [(r[1], r[2], r[3], r[4], r[5], r[6], float(r[7])) for r in rows] == [(0, 1, "Wonen", None, 2023, "Lasten", 1000.0), (0, 2, "Wonen", None, 2023, "Saldo", 0.0), (1, 1, "Wonen", None, 2023, "Lasten", -5.0), (2, 1, "Wonen", "totaal", 2023, "Lasten", 2.0), (2, 2, "Wonen", "totaal", 2023, "Saldo", 3.0), (4, 1, "Zorg", None, 2023, "Lasten", 7.0)]
