"""Set-similarity join of word shingles with PartEnum signatures (operator 4).

Documents are sets of distinct word shingles; exact copies of a set are one class. Classes link when
100 * intersection >= percent * union. The join takes these steps:

1. Signatures. A band holds sets of about one size; a pair belongs to the band of its smaller set, so a set
   also signs in the bands below it that may hold partners. In a band, similar sets differ in k shingles at
   most. The shingle domain is hashed into n1 partitions, each into n2 parts, and every subset of n2 - k2 parts
   of a partition is a signature; a partition in which two sets differ in at most k2 parts shares one. With
   n1 = k // (k2 + 1) + 1 + slack, slack + 1 partitions are such. Each band takes the shape of SHAPES with the
   fewest signatures that hold enough shingles. Signatures of no shingle at all would be shared by strangers:
   they are left out unless a set has more than slack partitions with one, so at least one is always shared.
2. Groups. Classes with an equal signature form a group; groups of equal members are one. Signatures are first
   put together in runs of ROWS_OUT: of classes that share one within a run, only the least and the largest key
   meet those of other runs, so that neither copies nor a signature of very many classes fill a task.
3. Hubs. Each group's members are held against the one that stands in most groups: by sketches (one byte for each
   of many partitions; similar sets differ in k at most), and those that pass are verified exactly.
4. The rest. In groups that hubs have not joined into one component, the members of different components are
   compared in blocks, all groups of a hub together, by sketches, and pairs that pass are verified exactly. No
   pair within a component needs a test.

Shingles are 64-bit hashes of words; equal hashes count as equal shingles. Nothing is capped or sampled.

Defined cases: null and empty texts and texts without words have no shingles and are their own component;
fewer words than a shingle make one shingle; rows that repeat an id are documents of their own, each judged by
its own text; a null id links as any other but is never the least, so such a row gets the least id that its
links reach, or null if they reach none; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import cut, small

SHINGLE, PERCENT = 4, 85
#: Bands grow by this factor. Shapes are (n2, k2): parts of a partition, and how many of them may differ.
GROWTH, SHAPES = 1.2, ((2, 1), (3, 1), (3, 2), (4, 2))
#: Shingles that a signature of the smallest set should hold on average.
LEAST_HELD = 2.0
#: Classes of a block, members of a hub that are verified together at most, and signatures of a run.
BLOCK, TOGETHER, ROWS_OUT = 256, 4_096, 100_000
U = np.uint64
ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles. bytes.lower and bytes.split know ASCII only, as the definition of words does."""
    ws = (text or b"").lower().split()
    n = len(ws)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), U, n)
    k = min(size, n)
    out = np.zeros(n - k + 1, U)
    for j in range(k):
        out = out * ODD[0] + mix(h[j : n - k + 1 + j] + ODD[1])
    return np.unique(mix(out + U(k if n < size else 0)))


def set_key(s: np.ndarray) -> int:
    return int(mix(mix(s ^ ODD[2]).sum(dtype=U, keepdims=True) + U(len(s))).view(np.int64)[0]) if len(s) else 0


class Bands:
    """Sizes, differences and partitions of each band, for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.high, self.reach, self.shape = [], [], [], []
        low = 1
        while low < 1 << 40:
            high = max(low, int(low * GROWTH))
            reach = 100 * high // percent  # the largest partner
            self.low.append(low)
            self.high.append(high)
            self.reach.append(reach)
            self.shape.append(self._shape(low, self.most(high, reach)))
            low = high + 1

    def most(self, a: int, b: int) -> int:
        """Shingles in which similar sets of these sizes differ at most."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    @staticmethod
    def _partitions(low: int, k: int, n2: int, k2: int) -> tuple[int, int]:
        """n1 and slack: as many partitions more as make sets with more partitions that lack a shingle rare."""
        least, slack = k // (k2 + 1) + 1, 0
        while slack < 0.3 * least + 2:
            empty = (least + slack) * comb(n2, k2) * np.exp(-low * (n2 - k2) / n2 / (least + slack))
            if empty + 3 * np.sqrt(empty) <= slack:
                break
            slack += max(1, least // 200)
        return least + slack, slack

    def _shape(self, low: int, k: int) -> tuple[int, int, int, int]:
        """n1, n2, k2 and slack for sets of low shingles at least that differ in k at most: the fewest signatures, unless they hold too few shingles."""
        if not k:
            return 1, 1, 0, 0
        found = [(*self._partitions(low, k, *x), *x) for x in SHAPES]
        n1, slack, n2, k2 = min(found, key=lambda x: (max(0.0, LEAST_HELD - low * (x[2] - x[3]) / x[2] / x[0]), x[0] * comb(x[2], x[3])))
        return n1, n2, k2, slack

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n shingles signs."""
        i = int(np.searchsorted(self.low, n, "right")) - 1
        out = []
        while i >= 0 and self.reach[i] >= n:
            out.append(i)
            i -= 1
        return out

    def signatures(self, s: np.ndarray, band: int) -> np.ndarray:
        n1, n2, k2, slack = self.shape[band]
        h = mix(s + U(int(ODD[3]) * (band + 1) % 2**64))
        place = (h % U(n1 * n2)).astype(np.int64)
        total = np.zeros(n1 * n2, U)
        np.add.at(total, place, mix(h ^ ODD[4]))
        count = np.bincount(place, minlength=n1 * n2)
        first = np.arange(n1, dtype=np.int64) * n2
        sums, filled, names = [], [], []
        for c, parts in enumerate(combinations(range(n2), n2 - k2)):
            sums.append(sum((total[first + p] * ODD[p] for p in parts), np.zeros(n1, U)))
            filled.append(sum(count[first + p] for p in parts) > 0)
            names.append(np.arange(n1, dtype=np.int64) * 8 + c)
        filled = np.array(filled)
        some = filled if (~filled).any(axis=0).sum() <= slack else np.ones_like(filled)
        out = mix(np.array(sums) + mix(np.array(names).astype(U) * ODD[1] + U(band)))
        return out[some].view(np.int64)

    def sketch(self, s: np.ndarray, band: int) -> bytes:
        """A byte for each of three times as many partitions as similar sets of the band may differ in."""
        q = 3 * self.most(self.high[band], self.reach[band]) + 1
        h = mix(s + U(int(ODD[2]) * (band + 1) % 2**64))
        total = np.zeros(q, U)
        np.add.at(total, (h % U(q)).astype(np.int64), mix(h ^ ODD[0]))
        return (mix(total) >> U(56)).astype(np.uint8).tobytes()


@lru_cache(4)
def bands(percent: int) -> Bands:
    return Bands(percent)


def _bytes(column: pa.ChunkedArray | pa.Array):
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column.cast(pa.large_binary()))


def _keyed(batches, size):
    for b in small(batches):
        sets = [shingle_set(t, size) for t in _bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], ["id", "n", "key"])


def _run(sigs: list, keys: list, bands_: list) -> pa.RecordBatch:
    """sig, key, band, salt of a run of signatures, each (sig, key) once. A class that alone has a signature, and the
    least and the largest key of those that share one, have salt 0; the others, which are known to share it, don't."""
    sig, key, band = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sigs, keys, bands_))
    order = np.lexsort((key, sig))
    s, k = sig[order], key[order]
    first = np.append(True, s[1:] != s[:-1])[: len(s)]
    last = np.append(s[1:] != s[:-1], True)[: len(s)]
    fresh = first | np.append(True, k[1:] != k[:-1])[: len(s)]
    # of equal (sig, key) the first stays, so the largest key's first row stands for the last one
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    edge = first.copy()
    edge[start[last]] = True
    salt = np.where(edge, 0, 1 + (mix(k.view(U)) % U(1 << 20)).astype(np.int64)).astype(np.int32)
    kept, salts = np.zeros(len(s), bool), np.zeros(len(s), np.int32)
    kept[order], salts[order] = fresh, salt
    return pa.RecordBatch.from_arrays([pa.array(sig[kept]), pa.array(key[kept]), pa.array(band[kept].astype(np.int32)), pa.array(salts[kept])], ["sig", "key", "band", "salt"])


def _signed(batches, size, percent):
    own = bands(percent)
    sigs, keys, of, total = [], [], [], 0
    for b in small(batches):
        for t in _bytes(b.column("text")):
            s = shingle_set(t, size)
            key = set_key(s)
            for band in own.of(len(s)) if len(s) else []:
                sigs.append(own.signatures(s, band))
                keys.append(np.full(len(sigs[-1]), key))
                of.append(np.full(len(sigs[-1]), band))
                total += len(sigs[-1])
            if total > ROWS_OUT:
                yield _run(sigs, keys, of)
                sigs, keys, of, total = [], [], [], 0
    yield _run(sigs, keys, of)


def _described(batches, size, percent):
    """key, set and sketches of texts. Where a key is wanted, another text under the same id, which has another key, is passed over."""
    own = bands(percent)
    kind = pa.list_(pa.struct([("band", pa.int32()), ("sketch", pa.binary())]))
    for b in small(batches):
        rows = []
        for want, t in zip(b.column("key").to_pylist(), _bytes(b.column("text")), strict=True):
            s = shingle_set(t, size)
            key = set_key(s)
            if want == key or want is None and len(s):
                rows.append((key, len(s), s.tobytes(), [{"band": i, "sketch": own.sketch(s, i)} for i in own.of(len(s))]))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], kind)], ["key", "n", "shingles", "sketches"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _against_hub(batches, percent):
    """Rows sorted by (hub, salt, member): the hub's own row comes first, the others are verified against it."""
    at, hub_set = None, None
    for b in small(batches):
        links = []
        for hub, salt, member, key, raw in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "member", "key", "shingles")), strict=True):
            s = np.frombuffer(raw, U)
            if not member:
                at, hub_set = (hub, salt), s
            elif at == (hub, salt) and similar(hub_set, s, percent):
                links.append((hub, key))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _passed(batches, percent):
    """(hub, key) of the rows whose sizes and sketches allow them to be similar."""
    for b in small(batches):
        out = []
        for hub, key, n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("hub", "key", "n", "m", "sketch", "hub_sketch")), strict=True):
            if min(n, m) * 100 >= percent * max(n, m):
                if (np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)).sum() <= (100 - percent) * (n + m) // (100 + percent):
                    out.append((hub, key))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["hub", "key"])


def _compared(rows, percent, i, j):
    """Pairs of different components in two blocks of a group whose sketches differ in k parts at most."""
    n, comp, key, block = (np.array([r[x] for r in rows]) for x in range(4))
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left:
        y = right[(comp[right] != comp[x]) & (np.minimum(n[right], n[x]) * 100 >= percent * np.maximum(n[right], n[x]))]
        y = y[key[y] > key[x]] if i == j else y
        if len(y):
            y = y[(sketch[y] != sketch[x]).sum(axis=1) <= (100 - percent) * (n[y] + n[x]) // (100 + percent)]
            yield from ((key[x], k) for k in key[y])


def _within_blocks(batches, percent):
    """Rows sorted by (hub, band, i, j): each such run, two blocks of about BLOCK rows each, is compared in itself."""
    at, run = None, []
    for b in batches:
        out = []
        for hub, band, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("hub", "band", "i", "j", "n", "comp", "key", "block", "sketch")), strict=True):
            if (hub, band, i, j) != at:
                out += _compared(run, percent, *at[2:]) if len(run) > 1 else []
                at, run = (hub, band, i, j), []
            run.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
    out = list(_compared(run, percent, *at[2:])) if len(run) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """key, comp (least key that links reach) for the keys of links (a, b): least labels travel along links, and over labels."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "comp"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "key").select("key", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        step = cut(step)
        over = step.select(F.col("key").alias("comp"), F.col("comp").alias("next"))
        labels = cut(step.join(over, "comp").select("key", "was", F.least("comp", "next").alias("comp")))
        if labels.filter("was != comp").isEmpty():
            return labels.select("key", "comp")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (hub, key) that are similar. Members of a hub are dealt over salts, as many as their number asks for, each with a copy of the hub's set."""
    members = cut(pairs.distinct())
    salts = members.groupBy("hub").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    members = members.join(salts, "hub").select("hub", "key", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))
    hubs = members.select("hub", "salt").distinct().select("hub", F.col("hub").alias("key"), "salt", F.lit(False).alias("member"))
    rows = hubs.unionByName(members.select("hub", "key", "salt", F.lit(True).alias("member"))).join(sets.select("key", "shingles"), "key")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return cut(rows.mapInArrow(lambda bs: _against_hub(bs, percent), "a long, b long"))


def _groups(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """gid, band, key: the classes that share a signature, groups of equal members once."""
    signed = texts.select("text").mapInArrow(lambda bs: _signed(bs, size, percent), "sig long, key long, band int, salt int")
    met = Window.partitionBy("sig", "salt")  # two rows of each run at most have salt 0; others are spread by their keys
    some = signed.withColumns({"lo": F.min("key").over(met), "hi": F.max("key").over(met)}).filter("lo != hi or salt != 0")
    some = cut(some.select("sig", "band", "key").distinct())
    each = some.groupBy("sig").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"))
    named = each.select("sig", F.xxhash64("c", "x", "lo", "hi").alias("gid"))
    return cut(some.join(named, "sig").select(F.xxhash64("gid", "band").alias("gid"), "band", "key").distinct())


def _class_texts(texts: DataFrame, rows: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """key, n, shingles, sketches of the wanted classes, read from one text of each; classes that only rows without an id hold are read from these."""
    kind = "key long, n long, shingles binary, sketches array<struct<band:int,sketch:binary>>"
    one = rows.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id")).join(wanted, "key", "left_semi")
    asked = texts.join(one, "id").select("key", "text").unionByName(texts.filter("id is null").select(F.lit(None).cast("long").alias("key"), "text"))
    found = asked.mapInArrow(lambda bs: _described(bs, size, percent), kind)
    return cut(found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))


def links_of_classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, key) of every row and (key, comp) of the classes that link with another."""
    texts = docs.select("id", "text")
    rows = cut(texts.mapInArrow(lambda bs: _keyed(bs, size), "id long, n long, key long"))
    groups = _groups(texts, size, percent)
    wanted = cut(groups.groupBy("key").agg(F.count("*").alias("weight")))
    sets = _class_texts(texts, rows, wanted, size, percent)

    # each group's hub is the member of most groups
    hubs = groups.join(wanted, "key").groupBy("gid").agg(F.max(F.struct("weight", "key"))["key"].alias("hub"))
    groups = cut(groups.join(hubs, "gid"))
    sketch = sets.select("key", "n", F.explode("sketches").alias("s")).select("key", "n", "s.band", "s.sketch")
    hub_sketch = sketch.select(F.col("key").alias("hub"), F.col("n").alias("m"), "band", F.col("sketch").alias("hub_sketch"))
    pairs = groups.filter("key != hub").select("key", "hub", "band").distinct()
    both = pairs.join(sketch, ["key", "band"]).join(hub_sketch, ["hub", "band"])
    first = _verified(both.mapInArrow(lambda bs: _passed(bs, percent), "hub long, key long"), sets, percent)
    comps = components(first)

    member = cut(groups.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    open_ = member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo != hi and c > 2")
    # groups of one hub share most members: together, each pair is met once
    rest = cut(member.join(open_.select("gid"), "gid", "left_semi").select("hub", "band", "key", "comp").distinct())
    blocks = rest.groupBy("hub", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rest = rest.join(blocks, ["hub", "band"]).join(sketch, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", "band", "key", "n", "comp", "sketch", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rest = rest.repartition("hub", "band", "i", "j").sortWithinPartitions("hub", "band", "i", "j")
    near = rest.mapInArrow(lambda bs: _within_blocks(bs, percent), "a long, b long")
    more = _verified(near.select(F.col("a").alias("hub"), F.col("b").alias("key")), sets, percent)
    if more.isEmpty():
        return rows, comps
    return rows, components(first.union(more))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row: id, n_shingles, component_id (the least id that links reach, itself included)."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, comps = links_of_classes(named, size, percent)
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    joined = classes.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = joined.groupBy("comp").agg(F.min("least").alias("component"), F.sum("copies").alias("size"))
    named = cut(joined.join(least, "comp").select("key", "component", "size"))
    # a class in a component of its own needs no join; the rest is a part of the rows
    shared = named.filter("size > 1").select("key", "component")
    own = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return rows.join(shared, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
