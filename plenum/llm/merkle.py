"""Merkle dataset manifest by butterfly exchange (operator 11).

Every row is a leaf; a source's leaves in order of doc_id are the lowest nodes of a tree whose nodes have FANOUT
children (the last of a level may have fewer), and the sources' roots make up a tree likewise.

1. Leaves are numbered within their source by ranges of rows. FANOUT ** HEIGHT leaves in a row are a block, the unit
   that a task holds; its root is made of its leaves alone.
2. Butterfly. In round r, FANOUT aligned runs of FANOUT ** r blocks are one group. Each block of a run sends the run's
   root to the block of the same place in every other run, and hashes the next ancestor itself, as all others of its
   group do. So after the last round each block has its source's root and all siblings above it, and nothing is sent
   down. Where the last run of a source is shorter, its blocks take turns in sending for the places that it lacks.
3. The sources' roots go through the same steps as one group.
4. Leaves meet their block's siblings again, and each folds its proof.

Defined cases: null fields are hashed as `-`; a null source is one source, first in order; rows with a null id come first in
their source and aren't tampered with; rows with equal ids are leaves of their own, in order of their hashes; a leaf
without siblings has the hash of nothing as its proof; an empty table gives no rows; texts are hashed whole, of any
length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, lower_ascii, quoted, ranked

FANOUT, HEIGHT = 16, 3
#: Rows whose crc32(doc_id as text) this divides are tampered with before their proof is checked.
TAMPERED = 5
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """What stands for one value in a leaf."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def levels(hashes: list[str], height: int | None) -> list[list[str]]:
    """The nodes of each level from hashes up: height levels above them, or as many as lead to one node."""
    out = [hashes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        out.append([sha("".join(out[-1][i : i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def sides(nodes: list[list[str]], place: int) -> Iterator[tuple[str, str]]:
    """For each level, the siblings before and after the node on the way up from place."""
    for level in nodes[:-1]:
        first = place - place % FANOUT
        yield "".join(level[first:place]), "".join(level[place + 1 : first + FANOUT])
        place //= FANOUT


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = sha(before + node + after)
    return node


def _nodes(block: pa.Table, height: int) -> tuple[pa.Table, list[list[str]]]:
    block = block.sort_by("place")
    single = block["members"][0].as_py() <= FANOUT**height
    return block, levels(block["leaf"].to_pylist(), None if single else height)


def _exchange(blocks: DataFrame, r: int) -> DataFrame:
    """Round r: every block of a group gets the roots of the group's runs, and becomes their parent."""
    span = F.lit(FANOUT**r).cast("bigint")
    node, low = F.floor(F.col("block") / span), F.col("block") % span
    runs = F.ceil(F.col("blocks") / span)
    first = node - node % FANOUT
    sent = blocks.select("*", node.alias("node"), low.alias("low"), F.explode(F.sequence(first, F.least(first + FANOUT - 1, runs - 1))).alias("to"))
    size = lambda n: F.least(span, F.col("blocks") - F.col(n) * span)
    places = F.when(F.col("low") < size("to"), F.sequence(F.col("low"), size("to") - 1, size("node")))
    sent = sent.withColumn("place", F.explode(places))
    own = (F.col("to") == F.col("node")) & (F.col("place") == F.col("low"))
    block = (F.col("to") * span + F.col("place")).alias("block")
    got = sent.groupBy("group", "blocks", block).agg(
        F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("found"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("hash", "before", "after")],
    )
    side = lambda test: F.array_join(F.transform(F.filter("found", test), lambda x: x["hash"]), "")
    here = F.floor(F.col("block") / span)
    got = got.withColumn("left", side(lambda x: x["node"] < here)).withColumn("right", side(lambda x: x["node"] > here))
    over = F.ceil(F.col("blocks") / span) <= 1  # this tree has its root already
    longer = lambda c, new: F.when(over, F.col(c)).otherwise(F.concat(c, F.array(new))).alias(c)
    parent = F.when(over, F.col("hash")).otherwise(F.sha2(F.concat("left", "hash", "right"), 256))
    return got.select("group", "block", "blocks", parent.alias("hash"), longer("before", "left"), longer("after", "right"))


def climb(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """rows (group, place, members, leaf): for each block its group's root (hash) and the siblings above the block, by level."""

    def root(block: pa.Table) -> pa.Table:
        block, nodes = _nodes(block, height)
        one = {c: [block[c][0].as_py()] for c in ("group", "block", "blocks")}
        return pa.table(one | {"hash": [nodes[-1][0]], "before": pa.array([[]], pa.list_(pa.string())), "after": pa.array([[]], pa.list_(pa.string()))})

    schema = "group string, block long, blocks long, hash string, before array<string>, after array<string>"
    blocks = cut(in_blocks(rows, height).groupBy("group", "block").applyInArrow(root, schema))
    most, r = blocks.agg(F.max("blocks")).first()[0] or 0, 0
    while FANOUT**r < most:
        blocks, r = _exchange(blocks, r), r + 1
    return cut(blocks) if r else blocks


def in_blocks(rows: DataFrame, height: int) -> DataFrame:
    size = F.lit(FANOUT**height).cast("bigint")
    return rows.withColumn("block", F.floor(F.col("place") / size)).withColumn("blocks", F.ceil(F.col("members") / size))


def _with_paths(rows: DataFrame, blocks: DataFrame, height: int, each, schema: str) -> DataFrame:
    """each(rows of a block, their blocks row, path of a place) for all blocks."""

    def both(block: pa.Table, above: pa.Table) -> pa.Table:
        block, nodes = _nodes(block, height)
        row = above.to_pylist()[0]
        rest = list(zip(row["before"], row["after"], strict=True))
        start = block["place"][0].as_py()
        return each(block, row, lambda place: [*sides(nodes, place - start), *rest])

    keys = ("group", "block")
    return in_blocks(rows, height).groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(both, schema)


def manifest(docs: DataFrame, names: dict[str, str] | None = None, height: int = HEIGHT) -> DataFrame:
    """For each row: its id, leaf, subroot, root, proof_sha256, folded_root (of what the row is after tampering), verified.

    names: the columns of docs that hold the FIELDS, where they have other names. height: levels within a block."""
    at = {f: F.col(quoted((names or {}).get(f, f))) for f in FIELDS}
    hashed = lambda text: F.sha2(F.concat(*[field(at[f]) for f in FIELDS[:-1]], field(text)), 256)
    hit = F.coalesce(F.crc32(at["doc_id"].cast("string").cast("binary")) % TAMPERED == 0, F.lit(False)) & at["text"].rlike("[A-Z]")
    group = F.coalesce(F.concat(F.lit("="), at["source"].cast("string")), F.lit(""))  # in the sources' order, null first
    leaves = cut(docs.select(group.alias("group"), at["doc_id"].alias("id"), hashed(at["text"]).alias("leaf"), F.when(hit, hashed(lower_ascii(at["text"]))).alias("now")))
    leaves = cut(ranked(leaves, "group", F.col("id").asc_nulls_first(), F.col("leaf"), F.col("now")))
    blocks = climb(leaves, height)
    kind = leaves.schema["id"].dataType.simpleString()

    top = blocks.filter("block = 0").select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("hash").alias("leaf"))
    top = cut(ranked(top, "group", F.col("key")))

    def of_source(block: pa.Table, row: dict, path) -> pa.Table:
        paths = [path(i) for i in block["place"].to_pylist()]
        return pa.table({"source": block["key"], "root": [row["hash"]] * len(paths), "above_before": [[b for b, _ in p] for p in paths], "above_after": [[a for _, a in p] for p in paths]}, schema=pa.schema([("source", pa.string()), ("root", pa.string()), ("above_before", pa.list_(pa.string())), ("above_after", pa.list_(pa.string()))]))

    sources = cut(_with_paths(top, climb(top, height), height, of_source, "source string, root string, above_before array<string>, above_after array<string>"))
    whole = [F.concat(c, f"above_{c}").alias(c) for c in ("before", "after")]
    blocks = blocks.join(sources, F.col("group") == F.col("source")).select("group", "block", F.col("hash").alias("subroot"), "root", *whole)

    def of_leaf(block: pa.Table, row: dict, path) -> pa.Table:
        proofs, folded = [], []
        for place, leaf, now in zip(*[block[c].to_pylist() for c in ("place", "leaf", "now")], strict=True):
            way = path(place)
            proofs.append(sha("".join(b + a for b, a in way)))
            folded.append(fold(now or leaf, way))
        n = len(proofs)
        strings = {"leaf": block["leaf"], "subroot": [row["subroot"]] * n, "root": [row["root"]] * n, "proof_sha256": proofs, "folded_root": folded}
        out = pa.table({"doc_id": block["id"]} | {k: pa.chunked_array([pa.array(v, pa.string())]) if isinstance(v, list) else v for k, v in strings.items()})
        return out.append_column("verified", pa.array([f == row["root"] for f in folded], pa.bool_()))

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = _with_paths(leaves, blocks, height, of_leaf, schema)
    return found.withColumnRenamed("doc_id", (names or {}).get("doc_id", "doc_id"))
