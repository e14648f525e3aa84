"""Operator 4 against all pairs."""

import random
import re
from collections import Counter

import numpy as np

from plenum.llm import partenum

SMALL = "/root/testdata/sf0.001"


def shingles(t, size=4):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)] if ws else [])


def brute(rows, percent=85, size=4):
    sets = [(i, shingles(t, size)) for i, t in rows]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(sets):
        known = [x for x in (least.get(find(a)), i) if x is not None]
        least[find(a)] = min(known) if known else None
    return Counter((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(0, round(share * len(words)))):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def fixture():
    rng = random.Random(5)
    rows = []
    for n in (3, 4, 5, 8, 12, 20, 33, 60, 150, 400):
        for _ in range(3):
            words = [f"v{rng.randrange(3000)}" for _ in range(n)]
            rows += [edited(rng, words, x) for x in (0, 0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.1)]
            rows += [" ".join(words[: max(1, round(n * x))]) for x in (0.84, 0.86, 0.9, 0.95)]
    common = " ".join(f"c{i}" for i in range(40))
    rows += [common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    base = [f"b{rng.randrange(10**5)}" for _ in range(120)]
    rows += [edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.06])) for _ in range(300)]
    return [(i, t) for i, t in enumerate([*rows, None, "", " \t\n", "É x", "é x", "A b C", "a B c", "a b", "x"])]


def test_components_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(5)
    got = Counter(tuple(r) for r in partenum.jaccard_components(docs).collect())
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows)


def test_components_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in partenum.jaccard_components(docs).collect()) == brute(rows)
    assert partenum.jaccard_components(docs.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    own = partenum.bands(85)
    for n in (1, 2, 6, 7, 12, 25, 60, 140, 300, 900, 4000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone, new = rng.integers(0, int(0.09 * n) + 1, 2)
            b = np.union1d(a[gone:], rng.integers(0, 2**63, new).astype(np.uint64))
            if len(b) and partenum.similar(a, b, 85):
                sign = lambda s: {(i, x) for i in own.of(len(s)) for x in own.signatures(s, i).tolist()}
                assert sign(a) & sign(b)
                band = own.of(min(len(a), len(b)))[0]
                x, y = (np.frombuffer(own.sketch(s, band), np.uint8) for s in (a, b))
                assert (x != y).sum() <= own.most(len(a), len(b))


def test_repeated_and_null_ids(spark):
    """Each row is judged by its own text; rows without an id link others, and get the least id that they reach."""
    words = [f"v{i}" for i in range(120)]
    a, b, c = " ".join(words), " ".join(words[:112]), " ".join(words[:104])
    other, lone = " ".join(f"x{i}" for i in range(50)), " ".join(f"y{i}" for i in range(50))
    rows = [(1, a), (None, b), (3, c), (2, other), (5, other + " z"), (5, lone), (5, lone), (None, lone + " q"), (None, "only here"), (None, None), (7, None), (7, "x y z")]
    assert brute(rows)[(3, 101, 1)] == 1  # by the row without an id alone
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in partenum.jaccard_components(docs).collect()) == brute(rows)


def test_copies_are_signed_once_a_run():
    """Many copies, and many classes that share a signature, leave two rows of salt 0 for each signature of a run."""
    copies = [np.arange(5), np.arange(5)] * 500
    run = partenum._run(copies, [np.full(5, 7)] * 500 + [np.full(5, 9)] * 500, [np.zeros(5, np.int64)] * 1000).to_pydict()
    assert Counter(zip(run["sig"], run["key"], strict=True)) == Counter({(s, k): 1 for s in range(5) for k in (7, 9)})
    many = partenum._run([np.zeros(1, np.int64)] * 900, [np.array([i % 300]) for i in range(900)], [np.zeros(1, np.int64)] * 900).to_pydict()
    assert sorted(many["key"]) == list(range(300))
    assert {k for k, s in zip(many["key"], many["salt"], strict=True) if s == 0} == {0, 299}
    assert partenum._run([], [], []).num_rows == 0


def test_every_band_enumerates_subsets():
    for percent in (85, 80):
        own = partenum.bands(percent)
        for low, high, reach, (n1, n2, k2, slack) in zip(own.low[:40], own.high, own.reach, own.shape, strict=False):
            k = own.most(high, reach)
            assert (k2 >= 1 and n1 >= k // (k2 + 1) + 1 + slack) if k else (n1, n2, k2) == (1, 1, 0)
            assert low <= high
