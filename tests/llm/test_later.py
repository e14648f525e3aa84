"""Operators 11 to 13 against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from plenum.llm import merkle, mixing, queries, spelling

SMALL = "/root/testdata/sf0.001"
LETTERS = "[A-Za-zÀ-ÿ]+"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id string, leaf string, word string, size string, `group` int"


def rows_of(spark, rows):
    """Rows of five fields, and columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "x", "y", "z", "s", 7) for r in rows], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows):
    """A leaf's proof is gathered while the tree is built level by level; a row at a time is changed and folded."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(leaves):
        proofs, at = [[] for _ in leaves], list(range(len(leaves)))
        while len(leaves) > 1:
            runs = [leaves[i : i + 16] for i in range(0, len(leaves), 16)]
            for k, i in enumerate(at):
                run = runs[i // 16]
                proofs[k].append((run[: i % 16], run[i % 16 + 1 :]))
                at[k] = i // 16
            leaves = [sha("".join(run)) for run in runs]
        return (leaves[0] if leaves else None), proofs

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((-1 if r[0] is None else r[0], leaf(r), r))
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {s: tree([g[1] for g in sorted(groups[s], key=lambda g: g[:2])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, h, r), own in zip(sorted(groups[s], key=lambda g: g[:2]), trees[s][1], strict=True):
            tampered = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                tampered[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            now = leaf(tampered)
            for before, after in own + up:
                now = sha("".join(before) + now + "".join(after))
            proof = sha("".join(x for before, after in own + up for x in before + after))
            out.append((r[0], h, trees[s][0], root, proof, now, now == root))
    return Counter(out)


def cases():
    """Sources of 1 to 4,500 rows, ties, repeated rows, nulls anywhere and a very long text."""
    rows = [(k * 5000 + i, s, "de" if i % 3 else None, i if i % 5 else None, None if i % 7 == 3 else f"Text {i % 50} É ß") for k, (s, n) in enumerate([("a", 1), ("b", 16), ("é", 17), (None, 40), ("hot", 4500), ("z", 257), ("", 2)]) for i in range(n)]
    rows += [(3, "a", "de", 1, "Same"), (3, "a", "de", 1, "Same"), (3, "a", "de", 1, "Other"), (None, "a", None, None, None), (None, "b", "fr", 2, "No Id"), (8, "b", "en", 9, "Long " * 300_000)]
    return rows


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest(spark, height):
    got = Counter(tuple(r) for r in merkle.manifest(rows_of(spark, cases()), height=height).collect())
    assert got == brute_manifest(cases())
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(rows_of(spark, [])).count() == 0
    (one,) = merkle.manifest(rows_of(spark, [(7, None, None, None, "")])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:7---0:") and one.proof_sha256 == sha("") and one.verified


def test_manifest_by_other_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    renamed = docs.withColumnsRenamed({"doc_id": "key", "text": "body"})
    got = merkle.manifest(renamed, names={"doc_id": "key", "text": "body"})
    assert got.columns[0] == "key"
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, merkle.manifest(docs).collect()))


def test_rounds_of_the_butterfly_give_every_block_all_siblings(spark):
    """Trees of many blocks, the last run of which is short at each level; no block gets more than 16 roots a round."""
    leaves = {g: [sha(f"{g}{i}") for i in range(n)] for g, n in [("a", 1), ("b", 255), ("c", 257), ("d", 4097), ("e", 273)]}
    rows = spark.createDataFrame([(g, i, len(h), x) for g, h in leaves.items() for i, x in enumerate(h)], "`group` string, place long, members long, leaf string")
    found = merkle.climb(rows, height=1).collect()
    for r in found:
        nodes = merkle.levels(leaves[r.group], None)
        assert r.hash == nodes[-1][0]
        assert list(zip(r.before, r.after, strict=True)) == list(merkle.sides(nodes[1:], r.block))
    assert Counter(r.group for r in found) == {g: (len(h) + 15) // 16 for g, h in leaves.items()}


def mixed(rows, **more):
    return [r.asDict() for r in mixing.mix(rows, **more).collect()]


def water(sizes, weights, share=1.5, limit=2):
    """Targets by resharing step by step, as the contract tells it."""
    target, fixed = dict.fromkeys(sizes, 0.0), set()
    while True:
        left = share * sum(sizes.values()) - sum(limit * sizes[s] for s in fixed)
        for s in sizes:
            target[s] = limit * sizes[s] if s in fixed else left * weights[s] / sum(weights[x] for x in sizes if x not in fixed)
        new = {s for s in sizes if target[s] > limit * sizes[s] * (1 + 1e-12) and s not in fixed}
        if not new:
            return target
        fixed |= new


def test_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").drop("n_chars")
    hot = spark.createDataFrame([(10**6 + i, "a b c " * (i % 9), "xx", "src0") for i in range(500)] + [(None, "one two", None, None), (-1, None, None, None), (-1, None, None, None), (-2, " \t", None, "none"), (-3, "w " * 300_000, None, "long")], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(hot).selectExpr("*", "1 as size", "2 as id", "3 as place")
    texts = docs.select("doc_id", "source", "text").collect()
    own, sizes = defaultdict(list), defaultdict(int)
    for r in texts:
        n = len([w for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")])
        own[r.source].append((r.doc_id, n))
        sizes[r.source] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = water({s: sizes[s] for s in names}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    got = mixed(docs)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(x for g in own.values() for x in g)
    of = {(r.doc_id, r.source) for r in texts}
    by_id = {i: s for i, s in of if i is not None and i != -1}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = by_id.get(r["doc_id"])
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(aims[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in names:
        assert abs(taken[s] - aims[s]) <= longest[s] or sizes[s] == 0
    assert sum(aims.values()) == pytest.approx(1.5 * sum(sizes.values()))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixed(docs.repartition(5))))
    other = mixed(docs, seed="another")
    assert sorted(map(key, got)) != sorted(map(key, other))


def test_mixture_expects_its_copies(spark):
    """Over many offsets a document's mean copies come to target / source_size."""
    docs = spark.createDataFrame([(i, "w " * (i + 1), "a") for i in range(6)] + [(9, "w " * 60, "b")], "doc_id long, text string, source string")
    total = defaultdict(int)
    for k in range(40):
        for r in mixed(docs, weights=(1, 1), seed=str(k)):
            total[r["doc_id"]] += r["copies"]
            ratio = r["target"] / r["source_size"]
            assert int(ratio) <= r["copies"] <= int(ratio) + 1
            if r["doc_id"] != 9:
                expected = ratio
    assert expected == 2 and all(total[i] == 80 for i in range(6)) and 40 <= total[9] <= 80
    assert abs(total[9] / 40 - 79.5 / 60) < 0.2
    assert mixed(docs.limit(0)) == [] and {r["taken"] for r in mixed(docs.selectExpr("doc_id", "source", "'' as text"))} == {0}


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall(LETTERS, text):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    shorter = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), ws in shorter.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def test_variants(spark):
    """Real texts, with words of one letter, a chain of forms, ties, anagrams, other scripts, very long runs and empty rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    chain = " ".join("abcdefgh"[:8] + "xyzuvw"[:k] for k in range(6) for _ in range(3 * 2**k))
    more = [(-1, None), (-2, ""), (-3, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa"), (None, chain), (-4, "Größe größe gröse " * 4), (-4, "Größe größe gröse " * 4), (-5, "angel angel angle angle glean glean " * 2), (-6, ("q" * 40_000 + "z ") * 3 + ("q" * 40_000 + " ") * 3), (-7, "каждый день " * 9), (-8, "naïve naive naive " * 3)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "'w' as word", "0 as n", "'i' as id")
    got = [tuple(r) for r in spelling.group_variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    depth = {w: (f, r) for w, f, r, *_ in got}
    assert any(f and f != r for f, r in depth.values())
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_words_one_edit_apart_share_a_part_and_a_third():
    words = ["abcde", "abcdef", "aabbccdd", "zzzzz", "tteennhh", "größer", "abcabcabcabc"]
    for w in words:
        edits = {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in ("", "a", "q", "ß") for d in (0, 1)} - {w}
        for x in edits:
            if len(x) >= 3 and abs(len(x) - len(w)) <= 1 and x != w:
                own, theirs = ({s[0] for s in spelling.signatures(v, spelling.parts(v))} for v in (w, x))
                assert own & theirs, (w, x)


@pytest.mark.parametrize("name", ["op11_butterfly_manifest", "op12_systematic_mixture", "op13_spelling_variants"])
def test_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    flat = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert flat(df.collect()) == flat(want)
