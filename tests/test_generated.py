"""Functions over texts that are put together at random, so that what they should find is known: hits in any place and case, several, and none."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plenum.functions import positions, rules, speech, text

FILL = "hier wordt gesproken over de stad met alle bewoners samen daarna verder zonder haast".split()


def fill(pick, n):
    return " ".join(pick.choice(FILL) for _ in range(n))


def anycase(pick, s):
    return pick.choice([s, s.lower(), s.upper(), s.title()])


def run(spark, rows, **columns):
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    return {r.id: r for r in frame.select("id", *[f(F.col("t")).alias(k) for k, f in columns.items()]).collect()}


def test_cleaning_takes_out_what_was_put_in(spark):
    pick = random.Random(11)
    dirty, clean = [], []
    for _ in range(300):
        words = [pick.choice(FILL) for _ in range(pick.randint(3, 12))]
        words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
        out = []
        for w in words:
            noise = pick.random()
            if noise < 0.1:
                out.append("* * *" + "*" * pick.randint(0, 4))
            elif noise < 0.2:
                out.append(" ".join(["ED"] * pick.randint(3, 6)))
            elif noise < 0.3:
                out.append(pick.choice(["eh", "Uh", "uhm,", "hmm", "hm"]))
            elif noise < 0.4:
                out.append(pick.choice(["...", "…", ". . . .", "… …"]))
            out.append(" ".join([w] * pick.choice([1, 1, 1, 3, 5])))
        dirty.append(pick.choice(["", "... "]) + " ".join(out) + pick.choice(["", " …", "...."]))
        clean.append(" ".join(words))
    dirty += ["", "eh", "** ** **", "zeg maar, dit blijft", "eigenlijk. Groot", "ja ja", None]
    clean += ["", "", "", "dit blijft", "eigenlijk. Groot", "ja ja", None]
    got = run(spark, dirty, x=speech.precleaned)
    for i, want in enumerate(clean):
        assert got[i].x == want, dirty[i]


def test_cues(spark):
    pick = random.Random(12)
    names = ["Jansen", "Kasmi", "Étienne", "Bakker-Smit"]
    no_names = ["Goedemorgen", "Inderdaad", "Collega", "Natuurlijk"]
    rows, want = [], []
    for _ in range(200):
        n = pick.choice(names + no_names)
        known = n in names
        kind = pick.choice(["intro", "handover", "standalone", "inline", "chair", None])
        called = pick.choice(["de heer", "mevrouw", "Wethouder", "BURGEMEESTER"])
        if kind == "intro":
            rows.append(f"Hallo allen, {anycase(pick, 'mijn naam is')} Koen {n}")
        elif kind == "handover":
            rows.append(f"{pick.choice(['Dan geef ik het woord aan', 'Het woord is aan', 'als eerste woord aan', 'Als volgende'])} {pick.choice(['', called + ' '])}{n} {fill(pick, 12)}".replace("  ", " "))
        elif kind == "standalone":
            rows.append(f"{called} {n}{pick.choice(['', '.', ','])}")
        elif kind == "inline":
            rows.append(f"{fill(pick, 14)}. {called} {n}.")
        elif kind == "chair":
            rows.append(pick.choice(["Dank u wel.", "u kunt de microfoon uitzetten", "Dan gaan we stemmen", "Prima, dan verder", "Eventjes kijken hoor"]))
        else:
            rows.append(fill(pick, 14))
        want.append((kind, None) if kind == "chair" else (kind, f"Koen {n}" if kind == "intro" else n) if kind and known else None)
    got = run(spark, rows, c=speech.cue)
    for i, w in enumerate(want):
        if w and w[0] == "chair":
            assert got[i].c and got[i].c.kind in ("chair", "standalone", "handover"), rows[i]
        else:
            assert (tuple(got[i].c) if got[i].c else None) == w, rows[i]


def test_outcomes_and_votes(spark):
    pick = random.Random(13)
    rows, want = [], []
    for _ in range(300):
        before, after = "x" * pick.choice([0, 10, 150, 190, 230, 400]), "y" * pick.choice([0, 10, 150, 190, 230, 400])
        word, on = pick.choice(text.OUTCOMES), pick.choice(["motie", "amendement", "voorstel"])
        first = pick.random() < 0.5
        rows.append(f"{anycase(pick, on)} {before} {anycase(pick, word)}" if first else f"{anycase(pick, word)} {after} {anycase(pick, on)}")
        apart = len(before) + 2 + len(on) if first else len(after) + 2 + len(on)
        want.append(word if apart <= 200 else None)
    rows += ["", "verworpen", None]
    want += [None, None, None]
    got = run(spark, rows, x=text.vote_outcome)
    for i, w in enumerate(want):
        assert got[i].x == w, rows[i]

    rows, want = [], []
    for _ in range(200):
        a, b, c = pick.randint(0, 45), pick.randint(0, 45), pick.choice([0, 1, 2, 3])
        number = f"{pick.choice(['', 'M'])}20{pick.randint(10, 29)}{pick.choice('-/')}{pick.randint(10, 9999)}"
        vote = ["met algemene stemmen", f"met {a} stemmen voor en {b} tegen", f"{a} stemmen voor, dus, {b} stemmen tegen", "zonder stemming"][c]
        told = pick.random() < 0.5
        rows.append(f"{fill(pick, 3)} {anycase(pick, vote)} {fill(pick, 4)} {(anycase(pick, 'motie nr. ') + number) if told else number}")
        want.append(([(45, 0), (a, b), (a, b), None][c], number if told else None))
    got = run(spark, rows, v=text.vote_counts, n=text.motion_number)
    for i, (v, n) in enumerate(want):
        assert (tuple(got[i].v) if got[i].v else None) == v and got[i].n == n, rows[i]


def test_lengths_of_table_documents(spark):
    """Both sides of the length from which a report is rich in tables."""
    rows = spark.createDataFrame([(1, "x " * 25_001), (2, "x " * 50_000), (3, "x " * 50_001)], "id long, t string")
    got = {r.id: r.k for r in rows.select("id", rules.layout(F.lit("1"), F.lit("Deelrapport"), F.col("t")).alias("k")).collect()}
    assert got == {1: "regular", 2: "regular", 3: "table_rich"}


def test_areas_and_positions(spark):
    pick = random.Random(14)
    words = [(w, a) for a, ws in positions.AREAS.items() for w in ws]
    long = lambda: fill(pick, 12)
    rows, want = [], []
    for k in range(200):
        parts, expected = [], []
        for _ in range(pick.randint(0, 4)):
            w, _a = pick.choice(words)
            kind = pick.choice(["uitspraak", "motie", "vraag", "stemming"])
            party = anycase(pick, pick.choice(["GroenLinks", "PvdA"]))
            if kind == "uitspraak":
                said = f"{w} {long()}"
                parts.append(f"Spreker ({party}): {said}")
            elif kind == "stemming":
                said = f"{party} over {w}"
                way = pick.choice(["voor", "Tegen", "onthouden"])
                parts.append(f"{way}: {said}; D66: niet")
            else:
                said = f"{kind} van {party} over {w} {long()}."
                parts.append(said)
            expected.append((kind, way.upper() if kind == "stemming" else None, said[: 100 if kind == "stemming" else 150]))
        rows.append("\n".join(parts) or None)
        want.append(expected)
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    got = {i: [] for i in range(len(rows))}
    for r in positions.positions(frame, "id", "t").collect():
        got[r.id].append((r.kind, r.direction, r.said))
        low = r.said.lower()
        assert r.area == next((a.capitalize() for a, ws in positions.AREAS.items() if any(w in low for w in ws)), "Overig")
    for i, w in enumerate(want):
        assert sorted(got[i], key=str) == sorted(w, key=str), rows[i]


@pytest.mark.parametrize("phrase", ["we gaan door met", "agendapunt 7", "Dan schors ik", "de vergadering is heropend", "volgend agendapunt", "ik open het debat", "sluit dit onderwerp"])
def test_transitions(spark, phrase):
    pick = random.Random(phrase)
    rows = [f"{fill(pick, 5)} {anycase(pick, phrase)} {fill(pick, 5)}", fill(pick, 9), re.sub(" ", "_", phrase), None]
    got = run(spark, rows, x=speech.is_transition)
    assert [got[i].x for i in range(4)] == [True, False, False, False]
