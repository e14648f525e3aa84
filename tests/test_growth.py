"""Steps whose work must grow with their input: plans, and blocks held against plain Python."""

import datetime
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_scale import SMALL, plan

from plenum.functions import dutch, rules
from plenum.operators import fulltext, intervals, louvain, relops
from plenum.plans import linking, registry, retrieval
from plenum.plans.registry import Tables
from plenum.sources import chunks as sources


def of(spark, name):
    return plan(registry.queries()[name](spark, SMALL))


def test_calendar_pages_are_parsed_once(spark):
    text = of(spark, "calendar_meetings")
    assert "MapInArrow" not in text and "BroadcastHashJoin" not in text


@pytest.mark.parametrize("kept", [True, False])
def test_search_by_blocks(spark, monkeypatch, kept):
    """Blocks of a few rows give what every pair would; filters are held before the best are taken."""
    monkeypatch.setattr(fulltext, "QUESTIONS", 3)
    monkeypatch.setattr(fulltext, "DOCUMENTS", 4)
    pick, day = random.Random(3), lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n)
    words = "boom kat vis lamp raam deur".split()
    docs = [(i, " ".join(pick.choices(words, k=pick.randint(0, 5))), pick.choice(["a", "b", None]), pick.choice([None, day(pick.randint(0, 9))])) for i in range(40)]
    asked = [(i, " ".join(pick.choices(words, k=2)), pick.choice(["a", None]), pick.choice([None, day(3)]), pick.choice([None, day(6)])) for i in range(20)]
    d = spark.createDataFrame(docs, "id long, text string, source string, day date")
    a = spark.createDataFrame(asked, "q long, text string, party string, van date, tot date").withColumn("terms", fulltext.question_terms("text")).drop("text")
    index = fulltext.inverted(d, "id", ["text"], keep=["source", "day"])
    how = {"same": ("party", "source"), "within": ("day", "van", "tot")} if kept else {}
    got = {(r.q, r["rank"]): (r.id, r.score) for r in fulltext.search(a, index, d, "id", k=3, **how).collect()}
    every = {}
    for r in fulltext.search(a, index, d, "id", k=1000).collect():
        every.setdefault(r.q, []).append((-r.score, r.id))
    want = {}
    for q, _, party, van, tot in asked:
        ok = lambda i: (party is None or docs[i][2] == party) and (van is None or (docs[i][3] and docs[i][3] >= van)) and (tot is None or (docs[i][3] and docs[i][3] <= tot))  # noqa: E731, B023
        for place, (s, i) in enumerate([x for x in sorted(every.get(q, [])) if not kept or ok(x[1])][:3], 1):
            want[q, place] = (i, -s)
    assert got == want and len(got) > 20


def test_an_alias_has_one_person_before_it_is_asked_for(spark):
    assert "Window" not in of(spark, "alias_priority")


def test_names_are_held_against_each_other_once(spark):
    assert "ArrowEvalPython" not in of(spark, "likest_titles")


def test_sentences_without_a_frame_for_each_document(spark):
    assert "FlatMapGroupsInPandas" not in of(spark, "mmr_sentences")


def test_matches_by_either_key_are_not_made_distinct(spark):
    left = spark.createDataFrame([(1, 1, 9), (1, 7, 5), (2, 1, None), (2, 1, None), (3, None, 5), (4, 8, 8)], "k long, a long, b long")
    right = spark.createDataFrame([("x", 1, 5), ("x", 1, 5), ("y", None, 5), ("z", 7, None), ("w", 0, 0)], "n string, c long, d long")
    met = relops.either_join(left, right, [("a", "c"), ("b", "d")], "k")
    assert sorted((r.k, r.n) for r in met.collect()) == [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (3, "x"), (3, "y")]
    text = of(spark, "disjunctive_join")
    assert "HashAggregate" not in text[: text.index("Union")]


def test_numbers_are_read_once(spark):
    assert not any("mrd" in line for line in of(spark, "table_numbers").splitlines() if "Filter" in line)


def test_tables_are_made_once(spark):
    assert "l_linenumber" not in of(spark, "table_fact_lines")


def test_sections_are_normalised_before_they_meet(spark):
    text = of(spark, "parent_repair")
    assert "regexp_replace" not in text[: text.index("Join ")]


def test_words_without_blanks_cost_their_length(spark):
    """A file name is looked for once a word; what is found stays the same."""
    pick, old, new = random.Random(5), re.compile(r"(?i)\S+\.(?:pdf|docx?|txt)\b"), re.compile(r"(?i)(?<!\S)\S+\.(?:pdf|docx?|txt)\b")
    for _ in range(3000):
        text = "".join(pick.choices(["a", ".", ".pdf", ".doc", "x", " ", "_", "é", "-"], k=pick.randint(0, 14)))
        assert old.sub(" ", text) == new.sub(" ", text)
    began = time.perf_counter()
    rows = spark.createDataFrame([(1, "ab.c" * 100_000), (2, "een gewone zin " * 20)], "k long, text string")
    assert {r.k: r.g for r in rows.select("k", rules.garbled(F.col("text")).alias("g")).collect()} == {1: True, 2: False}
    assert time.perf_counter() - began < 20


def test_entries_apart_by_taken_words(spark):
    assert "aggregate(" not in of(spark, "entities_apart")


def test_a_sweep_is_judged_by_what_the_next_one_offers(spark, monkeypatch):
    """Modularity is asked for once a level at most, and arrays of a few neighbours give what long ones give."""
    pick, asked, whole = random.Random(4), [], louvain.modularity
    edges = spark.createDataFrame([(a, b) for a in range(60) for b in range(a) if pick.random() < (0.5 if a % 4 == b % 4 else 0.05)], "a long, b long")
    monkeypatch.setattr(louvain, "modularity", lambda *x: asked.append(1) or whole(*x))
    edges = louvain.weighted(edges)
    found, gained = louvain._level(edges, float(edges.count()), 6)
    assert gained and len(asked) <= 1 and whole(edges, found) > 0.3
    monkeypatch.setattr(louvain, "LISTED", 3)
    assert set(louvain._level(edges, float(edges.count()), 6)[0].collect()) == set(found.collect())


def test_postings_are_put_in_order_together(spark, monkeypatch):
    """Texts of any number at once give what each gives by itself; places are written without a function for each of them."""
    assert "transform" not in of(spark, "stemmed_index")
    pick, words = random.Random(6), "de huizen lopende Bomen vis-en 1e İstanbul ander nacht".split()
    texts = [(i, " ".join(pick.choices(words, k=pick.randint(0, 9))), pick.choice([None, "Bomen de", ""])) for i in range(30)]
    want = set()
    for i, text, name in texts:
        found, after = dutch.terms(text), sum(1 for _ in dutch.WORD.finditer(text))
        more = [(after + p, t) for p, t in dutch.terms(name, stems=False)]
        for term in {t for _, t in found + more}:
            want.add((i, term, tuple(p for p, t in found if t == term), tuple(p for p, t in more if t == term), len(found) + len(more)))
    for held in (1, 20, 50_000):
        monkeypatch.setattr(fulltext, "HELD", held)
        monkeypatch.setattr(fulltext, "NUMBERED", held)
        rows = fulltext.inverted(spark.createDataFrame(texts, "k long, text string, name string"), "k", ["text"], ["name"]).collect()
        assert len(rows) == len(want) and {(r.k, r.term, tuple(r.text_at), tuple(r.name_at), r.n) for r in rows} == want


def test_narrative_chunks_are_handed_on_as_they_are_made(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"doc {i}", "# Kop\n\n" + "\n\n".join(f"Alinea {j} van {i}. " * 20 for j in range(40))) for i in range(3)] + [(9, None, None)], "k long, name string, text string").coalesce(1)
    made, sizes = sources.narrative_chunks(docs, "k", "name", "text").collect(), []
    whole = pa.RecordBatch.from_arrays
    monkeypatch.setattr(sources, "HELD", 5000)
    monkeypatch.setattr(docs.__class__, "mapInArrow", lambda df, f, schema: sizes.extend(b.num_rows for b in f(iter([whole([pa.array([r[c] for r in docs.collect()]) for c in docs.columns], docs.columns)]))) or df)
    sources.narrative_chunks(docs, "k", "name", "text")
    assert sum(sizes) == len(made) > 20 and max(sizes) <= 4


def test_labels_are_numbers_and_rows_of_a_key_stand_in_arrays(spark):
    assert "SortAggregate" not in of(spark, "communities")
    df = spark.createDataFrame([(k, v) for k in range(4) for v in range(10 * k)] + [(None, 1)], "k long, v long")
    for most in (3, 100):
        rows = relops.listed(df, "k", ["v"], most).collect()
        assert sorted((str(r.k), x.v) for r in rows for x in r.near) == sorted((str(r.k), r.v) for r in df.collect())
        assert len(rows) == 4 or most == 3


def test_lines_are_numbered_once(spark):
    """Documents of an item come with its lines, a part's keywords are found before it meets them."""
    assert "l_orderkey" not in of(spark, "item_documents")


def test_keywords_are_found_once_a_part(spark, monkeypatch):
    names, whole = [], linking.keywords
    monkeypatch.setattr(linking, "keywords", lambda name: names.append(1) or whole(name))
    text = plan(linking.agenda(Tables(spark, SMALL)))
    assert names and "lambda" not in text[: text.index("Join ")]
    linking.parents(linking.agenda(Tables(spark, SMALL)), "g", "pos", F.col("number"), None, F.col("ws"))
    assert len(names) == 2


def test_offices_and_letters_stand_in_one_order(spark):
    """An audit costs one shuffle and one sort; its findings are those of plain Python, also without begins, ends and names, and with ends before begins."""
    text = of(spark, "office_audit")
    assert text.count("Exchange") == 1 and len(re.findall(r"\bSort\b", text)) == 1
    pick, day, far = random.Random(8), lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(n), datetime.date(9999, 12, 31)
    name = lambda: pick.choice([*"abcdefghijkl", None])
    begin = lambda: pick.randint(0, 400)
    register = [(name(), day(b := begin()), pick.choice([None, day(b + pick.randint(-5, 40)), day(b + 3)])) for _ in range(60)] + [("m", None, day(9)), ("n", day(5), day(9)), ("n", day(9), day(9)), ("n", day(10), None), *[("k", day(7), day(8))] * 2]
    letters = [(name(), day(begin())) for _ in range(25)] + [("m", day(3)), ("n", None), ("z", day(1)), ("z", day(1)), ("c", day(500))]
    letters = [x for x in letters if x[0] not in ("a", "b", "k")]
    want, known, named = [], {n for n, *_ in register if n}, {n for n, d in letters if n and d}
    for n, d in letters:
        begins = [b for m, b, _ in register if m == n and b] if n and d else []
        if d and n not in known:
            want.append((n, "appointment_without_record", d, None, None))
        elif begins and (gap := min(abs((d - b).days) for b in begins)) > 30:
            want.append((n, "date_mismatch", d, None, gap))
    for n in {x[0] for x in register}:
        top, runs, times = None, [], {}
        for b, e in sorted((b, e or far) for m, b, e in register if m == n and b):
            if top is None or (b - top).days > 1:
                runs.append([b, e])
            runs[-1][1] = max(runs[-1][1], e)
            if top is not None and b <= top:
                times.setdefault(b, []).append(min(e, top))
            top = e if top is None else max(top, e)
        want += [(n, "record_without_appointment", b, None if e == far else e, None) for b, e in runs if n not in named]
        want += [(n, "overlap", b, None if max(e) == far else max(e), len(e)) for b, e in times.items()]
    got = intervals.audited_offices(spark.createDataFrame(register, "name string, begin date, end date"), spark.createDataFrame(letters, "name string, day date"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len({x[1] for x in want}) == 4


def test_a_seed_is_walked_from_once(spark, monkeypatch):
    """Questions that share seeds get what each gets by itself in plain Python; what they hit is sorted, not held in a table of pairs."""
    assert not re.search(r"Aggregate\(keys=\[q#\d+L?, chunk", of(spark, "graph_retrieval"))
    monkeypatch.setattr(retrieval, "SEEDS", 7)
    monkeypatch.setattr(retrieval, "MENTIONED", 50)
    pick, walked, whole = random.Random(12), [], retrieval.beam_walk
    monkeypatch.setattr(retrieval, "beam_walk", lambda e, seeds, *more: walked.append(seeds.count()) or whole(e, seeds, *more))
    nodes = [f"n{i}" for i in range(25)]
    edges = [(*pick.sample(nodes, 2), "K", pick.choice([0.25, 0.5, 0.5, 1.0])) for _ in range(45)]
    asked = [(q, pick.choice([*nodes[:8], None])) for q in range(20) for _ in range(pick.randint(1, 4))]
    mentions = [(pick.choice(nodes), pick.choice([*range(30), None])) for _ in range(260)]
    near = {n: sorted({(b, c) for a, b, _, c in edges if a == n} | {(a, c) for a, b, _, c in edges if b == n}) for n in nodes}
    assert len({(min(a, b), max(a, b)) for a, b, *_ in edges}) > 30
    for k in (1, 2):
        want = set()
        for q in {q for q, _ in asked}:
            seeds, ends = {n for p, n in asked if p == q and n}, {}
            for seed in seeds:
                paths = [(1.0, (seed,))]
                for depth in (1, 2):
                    grown = [(total * c, (*path, b)) for total, path in paths for b, c in near[path[-1]] if b not in path]
                    paths = sorted(grown, key=lambda x: (-round(x[0], 9), ">".join(x[1])))[: 3 * k]
                    for total, path in paths:
                        place = (-round(total * 0.7 ** (depth - 1), 6), depth, ">".join(path))
                        ends[path[-1]] = min(place, ends.get(path[-1], (1, 0, "")))
            wanted = {n for _, n in sorted((p, n) for n, p in ends.items())[: 3 * k]} | seeds
            hits = Counter(chunk for n, chunk in set(mentions) if n in wanted)
            want |= {(q, c, n, i + 1) for i, (c, n) in enumerate(sorted(hits.items(), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:k])}
        frames = [spark.createDataFrame(rows, schema) for rows, schema in ((asked, "q long, node string"), (edges, "source string, target string, kind string, conf double"), (mentions, "node string, chunk long"))]
        got = [tuple(r) for r in retrieval.graph_retrieve(*frames, k=k).collect()]
        assert len(got) == len(want) > 15 and {(q, c, n, i) for q, c, n, i in got} == want
    assert walked == [len({n for _, n in asked if n})] * 2
