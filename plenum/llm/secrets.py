"""Secret scan with corpus-wide ownership frequency (operator 1, DataFrame functions only).

Each text is scanned once. Base kinds are always reported; *opaque* tokens (long, with capitals, small
letters and digits, apart from base spans) are only candidates. The hash of every candidate value is counted
over distinct repositories and owners of the whole corpus: a value that MIN_OWNERS owners or MIN_REPOS
repositories hold is a copied example, one that fewer hold looks live. Opaque candidates become spans when
they look live.

Defined cases: null and empty texts have no spans; a null owner counts as one owner of its own, and so does a
null repository; repeated rows are scanned each for itself, but count once as a repository; extra columns are
ignored, and kept by redaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import columns, cut, let, quoted, running_sums

#: Fixed patterns: kind -> (pattern, group that holds the value, least length of that value).
BASE_KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # the runs of 32 and more among the longest runs
}
OPAQUE = r"[A-Za-z0-9_-]{20,}"
KINDS = [*BASE_KINDS, "opaque"]
#: A value with so many owners, or in so many repositories, is a copied example.
MIN_OWNERS, MIN_REPOS = 3, 25
MASK = "[SECRET]"
#: Code points of a block of a text from which redaction reads.
PIECE = 2_048


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, start, end, value) of the pattern's leftmost non-overlapping matches, in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")
    length = lambda s: F.length(s).cast("bigint")

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["pieces"], 1, F.size(x["found"])), x["found"], lambda b, m: F.struct(length(b).alias("b"), length(m).alias("m")))
        return let(lengths, lambda ls: let(running_sums(F.transform(ls, lambda p: p["b"] + p["m"])), lambda reach: rows(x, ls, reach)))

    def rows(x: Column, ls: Column, reach: Column) -> Column:
        parts = F.arrays_zip(ls.alias("l"), reach.alias("r"), (x["values"] if group else x["found"]).alias("v"))
        kept = F.filter(parts, lambda p: F.length(p["v"]) >= least)
        start = lambda p: p["r"] + p["l"]["b"]
        return F.transform(kept, lambda p: F.struct(start(p).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start(p) + p["l"]["m"]).alias("end"), p["v"].alias("value")))

    found = let(F.struct(whole.alias("found"), values.alias("values"), F.split(text, pattern, -1).alias("pieces")), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)"))


def _opaque(text: Column) -> Column:
    mixed = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    return F.filter(_spans(text, "opaque", OPAQUE, 0, 20), lambda p: mixed(p["value"]))


def has_candidate(text: Column) -> Column:
    """Whether any pattern matches: a text without a match needs no further work."""
    return F.coalesce(text.rlike("|".join(p for p, _, _ in BASE_KINDS.values()) + "|" + OPAQUE), F.lit(False))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash -> number of distinct repositories and owners. candidates: hash, repo, owner.

    Rows are first reduced to one for each (hash, owner, repo), on the map side too; no group is gathered."""
    by_owner = candidates.distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def _judged(docs: DataFrame, text_col: str, repo_col: str, owner_col: str, min_owners: int, min_repos: int, keep: list[Column]) -> DataFrame:
    """keep's columns, base, spans (base ones and live opaque ones) as (start, kind, end, before), n_live, n_copied for each
    row of docs; before is the largest end of the spans before one."""
    text, opaque = F.coalesce(F.col(quoted(text_col)), F.lit("")), KINDS.index("opaque")
    known = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("\x00"))
    scan = docs.select(*keep, known(repo_col).alias("_repo"), known(owner_col).alias("_owner"), F.when(has_candidate(text), text).otherwise("").alias("_text"))
    found = [*[_spans(F.col("_text"), k, *v) for k, v in BASE_KINDS.items()], _opaque(F.col("_text"))]
    scan = cut(scan.withColumn("_spans", F.flatten(F.array(*found))).drop("_text").withColumn("_row", F.monotonically_increasing_id()))
    some = F.size("_spans") > 0

    # one row for each span; an opaque one goes if a base span that begins before its end reaches beyond its start
    each = scan.filter(some).select("_row", "_repo", "_owner", F.explode("_spans").alias("s")).select("_row", "_repo", "_owner", "s.start", "s.kind", "s.end", F.sha2("s.value", 256).alias("hash"))
    place = F.when(F.col("kind") == opaque, F.col("end")).otherwise(F.col("start"))
    until = Window.partitionBy("_row").orderBy(place, F.col("kind") != opaque).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("kind") != opaque, F.col("end"))).over(until)
    each = cut(each.withColumn("reach", F.coalesce(reach, F.lit(0))).filter((F.col("kind") != opaque) | (F.col("reach") <= F.col("start"))).drop("reach"))

    # only values that look live, of which no group is large, meet their rows again
    count = ownership(each.select("hash", F.col("_repo").alias("repo"), F.col("_owner").alias("owner")))
    live = count.filter((F.col("owners") < min_owners) & (F.col("repos") < min_repos)).select("hash", F.lit(True).alias("live"))
    told = each.join(live, "hash", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    shown = told.filter((F.col("kind") != opaque) | F.col("live"))
    before = F.max("end").over(Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
    shown = shown.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "before"))).alias("_all"))
    counted = told.groupBy("_row").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))

    names = [F.col(quoted(c)) for c in scan.columns if c not in ("_repo", "_owner", "_spans", "_row")]
    nothing = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,before:bigint>>)")
    zero = F.lit(0).cast("bigint")
    told = counted.join(shown, "_row", "left")
    with_any = scan.filter(some).join(told, "_row", "left").select(*names, F.coalesce("_all", nothing).alias("_all"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
    without = scan.filter(~some).select(*names, nothing.alias("_all"), zero.alias("n_live"), zero.alias("n_copied"))
    return with_any.unionByName(without)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """For each row: its id, counts of base kinds, sha256 over the base spans, all spans, and how many
    of its values look live or are copied by min_owners owners, or in min_repos repositories, or more."""
    found = _judged(docs, text_col, repo_col, owner_col, min_owners, min_repos, [F.col(quoted(id_col)).alias("id")])
    number = lambda k: F.size(F.filter("_all", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    base = F.filter("_all", lambda s: s["kind"] != KINDS.index("opaque"))
    return found.select(
        F.col("id").alias(id_col),
        *[number(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("_all")).alias("spans"),
        "n_live",
        "n_copied",
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """docs with every span of scan_secrets replaced by MASK, spans that overlap by one; texts without candidates aren't moved."""
    hit = F.coalesce(has_candidate(F.col(quoted(text_col))), F.lit(False))
    found = _judged(docs.filter(hit), text_col, repo_col, owner_col, min_owners, min_repos, [F.struct(*columns(docs)).alias("doc")])
    text = F.col("doc").getField(text_col)

    def masked(x: Column) -> Column:
        """The pieces between spans that no earlier one reaches into, read from blocks of the text, so that a piece costs its own length."""

        def piece(begin: Column, end: Column) -> Column:
            blocks = F.slice(x["blocks"], (F.floor(begin / PIECE) + 1).cast("int"), (F.floor((end - 1) / PIECE) - F.floor(begin / PIECE) + 1).cast("int"))
            return F.when(end > begin, F.substring(F.array_join(blocks, ""), (begin % PIECE + 1).cast("int"), (end - begin).cast("int"))).otherwise("")

        first = F.filter(x["spans"], lambda s: s["start"] >= s["before"])
        rest = piece(F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(first, lambda s: F.concat(piece(s["before"], s["start"]), F.lit(MASK))), ""), rest)

    parts = F.struct(F.col("_all").alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("blocks"))
    new = F.when(F.size("_all") > 0, let(parts, masked)).otherwise(text)
    changed = found.select(*[(new if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
    return docs.filter(~hit).unionByName(changed)
