"""Benchmark decontamination by a prefix-filtered set join (operator 5, DataFrame functions only).

A window is 13 consecutive words of an item (an item of fewer words is one window). Its elements are the
word shingles at its offsets, of SHINGLE words or of the whole window where that is shorter. A document
holds the window exactly when all its shingles stand at consecutive places, so the join asks for
containment 1: of each window, ordered by rarity in the corpus, only the rarest shingle is the necessary
prefix. The prefix joins the documents' shingle places; the place must leave room for the window before
and after it (positional and length bounds); then all other shingles are verified at their places, word
by word. Places whose shingle's bucket no benchmark shingle has are passed over while the documents are read.

Defined cases: null texts have no words; an item without words has no window; repeated document rows are
judged each for itself; repeated item ids count as one item; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import cut, lower_ascii

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 4
#: Shingles fall into so many buckets. Those of the benchmark are broadcast, as single numbers: this bounds their size.
BUCKETS = 1 << 22


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), BETWEEN_WORDS), "")


def _shingles(ws: str, sizes: list[int]) -> Column:
    """Every place's shingles of the sizes as (hash, pos, k, w0..w3); hash is a join key, the words decide."""

    def of(k: int) -> Column:
        def one(i: Column) -> Column:
            each = [F.get(F.col(ws), i + j) for j in range(k)]
            return F.struct(F.xxhash64(*each).alias("hash"), i.alias("pos"), F.lit(k).alias("k"), *[(each[j] if j < k else F.lit("")).alias(f"w{j}") for j in range(SHINGLE)])

        places = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k))
        return F.transform(places, one)

    return of(sizes[0]) if len(sizes) == 1 else F.flatten(F.array_compact(F.array(*[of(k) for k in sizes])))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item, win, len, off, hash, k, w0..w3: the shingles of every window, once for each (item, words)."""
    all_words = items.withColumn("n", F.size("ws")).filter("n > 0")
    each = all_words.select("item", "ws", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("at"))
    each = each.select("item", F.slice("ws", F.col("at") + 1, F.lit(window)).alias("ws")).distinct()
    each = each.withColumn("len", F.size("ws")).withColumn("win", F.sha2(F.concat_ws(" ", "ws"), 256))
    by_k = [each.filter(F.least("len", F.lit(SHINGLE)) == k).select("item", "win", "len", F.explode(_shingles("ws", [k])).alias("s")) for k in range(1, SHINGLE + 1)]
    out = by_k[0]
    for x in by_k[1:]:
        out = out.unionByName(x)
    return out.select("item", "win", "len", F.col("s.pos").alias("off"), *[F.col(f"s.{c}") for c in ("hash", "k", *WORDS)])


WORDS = [f"w{j}" for j in range(SHINGLE)]
SAME = ["hash", "k", *WORDS]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """For each row of docs: id, n_words, n_hit (words inside any window's occurrence), n_items, items_sha256,
    contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    items = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("ws"))
    wins = cut(_windows(items, window))
    sizes = sorted(r.k for r in wins.select("k").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    bucket = F.pmod(F.col("hash"), F.lit(BUCKETS))
    known = F.broadcast(wins.select(bucket.alias("bucket")).distinct().withColumn("known", F.lit(True)))  # BUCKETS rows of 9 bytes at most

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("ws"))
    rows = rows.select("id", "row", F.size("ws").alias("n"), F.explode_outer(_shingles("ws", sizes)).alias("s"))
    rows = rows.select("id", "row", "n", "s.pos", *[F.col(f"s.{c}") for c in SAME])
    # places of shingles that a window may have (all later joins compare the words); besides, one row of every document, for its number of words
    first = F.coalesce((F.col("pos") == 0) & (F.col("k") == sizes[0]), F.col("pos").isNull() | (F.col("n") < sizes[0]))
    places = cut(rows.withColumn("bucket", bucket).join(known, "bucket", "left").filter(F.col("known") | first).withColumn("first", first).drop("bucket"))
    hits = places.filter("known").select("row", "n", "pos", *SAME)

    rare = hits.groupBy(*SAME).agg(F.count("*").alias("often"))
    order = Window.partitionBy("item", "win").orderBy("often", "hash", "off")
    ranked = wins.join(rare, SAME, "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("rank", F.row_number().over(order))
    prefix = ranked.filter("rank = 1").select("win", "len", "off", *SAME).dropDuplicates(["win"])
    fits = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n"))
    starts = hits.join(prefix, SAME).filter(fits).select("row", "win", "len", (F.col("pos") - F.col("off")).alias("start"))
    parts = wins.select("win", "off", *SAME).dropDuplicates(["win", "off"])
    asked = starts.join(parts, "win").select("row", "win", "len", "start", (F.col("start") + F.col("off")).alias("pos"), *SAME)
    met = asked.join(hits.select("row", "pos", *SAME), ["row", "pos", *SAME], "left_semi").groupBy("row", "win", "len", "start").agg(F.count("*").alias("m"))
    found = cut(met.filter(F.col("m") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1).select("row", "win", "len", "start"))

    by_start = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    fresh = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(by_start), F.lit(0)))
    n_hit = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    of_items = found.select("row", "win").distinct().join(wins.select("item", "win").distinct(), "win").select("row", "item").distinct()
    named = of_items.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    told = n_hit.join(named, "row")

    every = places.filter("first").select("id", "row", F.col("n").cast("bigint").alias("n_words"))
    n = F.coalesce("n_hit", F.lit(0))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(told, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n > 0) & (n * share >= F.col("n_words"))).alias("contaminated"),
    )
