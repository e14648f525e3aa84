"""Likeness, intervals, submitters, calendars and narratives against plain Python."""

import datetime
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from plenum.operators import intervals, likeness
from plenum.plans import registry
from plenum.sources import chunks, html, submitters

SMALL = "/root/testdata/sf0.001"
DAY = datetime.date(2020, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_ratio_and_its_bound(spark):
    pick = random.Random(1)
    word = lambda: "".join(pick.choice("abcde é") for _ in range(pick.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(10_000)] + [("", ""), ("a", None)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", likeness.sequence_ratio("a", "b").alias("r"), likeness.most_alike(F.col("a"), F.col("b")).alias("m"))
    for r in rows.collect():
        if r.b is None:
            assert r.r is None
        else:
            assert r.r == SequenceMatcher(None, r.a, r.b).ratio() and r.m >= r.r - 1e-12


def test_likest_titles(spark):
    rows = spark.read.parquet(f"{SMALL}/orders.parquet").collect()
    name = lambda r: f"{r.o_orderpriority} - zaal {r.o_custkey % 50} (besloten)"
    plain = lambda x: x.lower().replace(" - ", " ").replace("—", " ").split(" (")[0].strip()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.o_orderkey):
        if r.o_orderstatus != "F":
            by[r.o_orderdate.date()].append(r)
    want = {}
    for r in rows:
        best = (0.4, None)
        for c in by[r.o_orderdate.date()] if r.o_orderstatus == "F" else []:
            s = max(SequenceMatcher(None, plain(x), plain(name(c))).ratio() for x in (name(r), r.o_orderpriority))
            best = (s, c.o_orderkey) if s > best[0] else best
        if best[1] is not None:
            want[r.o_orderkey] = (best[1], best[0])
    got = {r.a: (r.b, r.score) for r in registry.queries()["likest_titles"](spark, SMALL).collect()}
    assert got == want and len(got) > 50


def cases(pick, n):
    out = []
    for _ in range(n):
        begin = pick.randint(0, 60)
        out.append((pick.choice("abc"), day(begin), day(begin + pick.randint(0, 12))))
    return out


def days_of(rows):
    out = defaultdict(set)
    for k, a, b in rows:
        if a:
            out[k] |= {(a + datetime.timedelta(days=i)) for i in range(((b or day(400)) - a).days + 1)}
    return out


def as_intervals(days):
    out = set()
    for k, ds in days.items():
        for d in ds:
            if d - datetime.timedelta(days=1) not in ds:
                end = d
                while end + datetime.timedelta(days=1) in ds:
                    end += datetime.timedelta(days=1)
                out.add((k, d, end))
    return out


def test_intervals(spark):
    pick = random.Random(5)
    schema = "name string, begin date, end date"
    for _ in range(4):
        a, b = cases(pick, 25) + [("d", None, day(3)), ("a", day(5), day(5)), ("a", day(5), day(5))], cases(pick, 12)
        frames = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
        whole = {tuple(r) for r in intervals.coalesced(frames[0], ["name"]).select("name", "begin", "end").collect()}
        assert whole == as_intervals(days_of(a))
        left = {tuple(r) for r in intervals.difference(*frames, ["name"]).collect()}
        theirs = days_of(b)
        assert left == as_intervals({k: ds - theirs[k] for k, ds in days_of(a).items()})
    open_ = spark.createDataFrame([("a", day(1), None), ("a", day(5), day(9)), ("b", day(1), day(2)), ("b", day(3), None)], schema)
    assert {tuple(r)[:3] for r in intervals.coalesced(open_, ["name"]).select("name", "begin", "end").collect()} == {("a", day(1), None), ("b", day(1), None)}
    cut = intervals.difference(open_.filter("name = 'a'"), spark.createDataFrame([("a", day(3), day(4))], schema), ["name"])
    assert {tuple(r) for r in cut.collect()} == {("a", day(1), day(2)), ("a", day(5), None)}


def test_as_of(spark):
    pick = random.Random(9)
    rows = [(k, pick.choice("ab"), pick.randint(0, 30)) for k in range(80)]
    spans = [(n, at, f"{n}{at}") for n in "ab" for at in pick.sample(range(31), 6)]
    got = {r.id: r.role for r in intervals.as_of(spark.createDataFrame(rows, "id long, name string, at int"), spark.createDataFrame(spans, "name string, begin int, role string"), ["name"], "at", "begin", ["role"]).collect()}
    for k, n, at in rows:
        assert got[k] == max(((b, r) for m, b, r in spans if m == n and b <= at), default=(0, None))[1]


def test_the_first_span_that_holds_a_day(spark):
    pick = random.Random(21)
    spans = [(pick.choice("ab"), f"s{i:02}", day(b := pick.randint(0, 40)), None if pick.random() < 0.1 else day(b + pick.randint(-2, 15))) for i in range(40)] + [("a", "none", None, day(3))]
    rows = [(i, pick.choice("abc"), day(pick.randint(-3, 60))) for i in range(150)] + [(999, "a", None)]
    frame = spark.createDataFrame(spans, "k string, who string, begin date, end date")
    got = {r.id: r.who for r in intervals.holding(spark.createDataFrame(rows, "id long, k string, day date"), frame, ["k"], "day", "who").collect()}
    for i, k, d in rows:
        fits = sorted((b, w) for s, w, b, e in spans if d and s == k and b and b <= d and (e is None or d <= e))
        assert got[i] == (fits[0][1] if fits else None)


def test_submitters(spark):
    """Texts with and without phrases and blocks, names in every place."""
    pick = random.Random(2)
    names = ["Jan Jansen", "P. de Vries", "Els Bakker (VVD)", "Mevrouw Smit", "Wethouder Kuiper (D66)", "X"]
    texts = ["", None, "Alleen een zin.\nkleine letters", "a\n" * 400 + "Jan Jansen"]
    for _ in range(120):
        body = [pick.choice(["De raad besluit tot iets dat langer is dan een naam, en dat nog veel langer", "overwegende dat", "", "Kort"]) for _ in range(pick.randint(0, 4))]
        if pick.random() < 0.5:
            body.append(f"{pick.choice(['Ingediend door', 'mede ondertekend door:', 'ONDERTEKEND DOOR'])} {', '.join(pick.sample(names, 2))} en {pick.choice(names)}{pick.choice(['. Verder', '', '.'])}")
        body += pick.sample(names, pick.randint(0, 3))
        texts.append("\n".join(body))

    known = {"jansen": "Jan P. Jansen", "smit": "Sara Smit", "p. de vries": "Piet de Vries"}

    party = re.compile(r" *\([^)]*\)$")

    def named(part):
        plain = party.sub("", re.sub(r"(?i)^(de heer|mevrouw|wethouder|raadslid|burgemeester) +", "", part)).strip()
        words = plain.lower().split()
        return known.get(" ".join(words)) or (known.get(words[-1]) if len(words) > 1 else None) or plain or part

    def brute(text):
        lines = [x.strip() for x in (text or "")[-500:].splitlines() if x.strip()]
        short = [len(x) < 60 and x[0].isascii() and x[0].isupper() for x in lines]
        block = lines[len(lines) - next((i for i, ok in enumerate(short[::-1]) if not ok), len(lines)) :][::-1]
        raw = re.findall(r"(?i)(?:in|onder)(?:gediend|tekend) door[: ]+(.+?)(?:\. |\n|$)", text or "") + [party.sub("", x) for x in block]
        parts = [p.strip().rstrip(".") for x in raw for p in re.split(r",| en ", x)]
        found = [named(p) for p in parts if len(p) > 1]
        return [n for i, n in enumerate(found) if len(n) > 1 and n.lower() not in {m.lower() for m in found[:i]}]

    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    registry_ = spark.createDataFrame(list(known.items()), "term string, name string")
    got = defaultdict(list)
    for r in submitters.submitters(frame, "id", "text", registry_).orderBy("id", "place").collect():
        got[r.id].append(r.name)
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text


def test_outline_of_nested_pages(spark):
    page = "<html><body><ul><li>een<ul><li>twee <b>drie<br>vier</b></li></ul></li><li>vijf</ul><p>zes<script>if (a<b) {}</script></section><img src=x>zeven &amp; acht"
    rows = html.nodes(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "x" * 200_000)], "page_id long, html string")).orderBy("page_id", "at").collect()
    tag = {r.at: r.tag for r in rows if r.page_id == 1}
    path = lambda r: ">".join(tag[a] for a in r.within)
    texts = {r.text: path(r) for r in rows if r.page_id == 1 and r.tag == "#text"}
    assert texts == {
        "een": "html>body>ul>li", "twee": "html>body>ul>li>ul>li", "drie": "html>body>ul>li>ul>li>b", "vier": "html>body>ul>li>ul>li>b", "vijf": "html>body>ul>li", "zes": "html>body>p", "zeven & acht": "html>body>p",
    }
    assert [(r.page_id, len(r.text)) for r in rows if r.page_id != 1] == [(4, 200_000)]


def test_narratives():
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n\n"
    assert chunks.narrative("", "n") == [] and chunks.narrative(table, "n") == [] and chunks.narrative("kort\n" + table + "na", "n") == [("n", "n", "kort\nna")]
    parts = ["# Een", *[f"alinea {i} " + "woord " * 80 for i in range(8)], "## Twee", table + "tekst " * 300, "DRIE VIER", "einde. " * 400]
    found = chunks.narrative("\n\n".join(parts), "doc")
    assert [t for t, _, _ in found][0] == "Een" and found[-1][:2] == ("DRIE VIER", "doc > DRIE VIER") and any(p == "doc > Een > Twee" for _, p, _ in found)
    assert not any("|" in c for _, _, c in found)
    whole = "\n\n".join(c for _, _, c in found)
    assert all(p.strip() in whole for p in parts if "|" not in p)
    for (_, _, a), (_, _, b) in zip(found, found[1:], strict=False):
        assert any(b.startswith(a[-n:].strip()) for n in range(1, 352))
    assert all(len(c) <= chunks.NARRATIVE or "einde" in c or "tekst" in c for _, _, c in found)


def test_narratives_of_documents(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "# K\n\n" + "y " * 3000)], "id long, name string, text string")
    rows = chunks.narrative_chunks(docs, "id", "name", "text").orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.title) for r in rows][:2] == [(1, 0, "a"), (3, 0, "K")] and {r.id for r in rows} == {1, 3}
