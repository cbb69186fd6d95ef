"""Merkle manifest of a table: a leaf per row, a tree per group, one root over the groups' roots, a proof per row.

``H`` is the lower-case hex SHA-256 of its inputs written one after the other. A leaf is ``H`` of the row's fields, each
``-`` if null, else its length in UTF-8 bytes, ``:``, its value. A tree takes its nodes two by two, the last run may be a single one,
and replaces every run by its ``H`` until one node remains; a lone leaf is its own root. Groups are ordered by name, null first,
and their roots form a tree of the same kind.

Spark's part, a cogrouped subtree exchange:

1. Leaves are computed by SQL functions and ordered once per table by a range partitioning; ranks within a group follow
   from the rows per partition and group, so no window sees a whole group.
2. ``BLOCK`` consecutive nodes of a tree form a superblock. Upwards, a superblock is reduced to one node, which is a
   node of the next, ``BLOCK`` times smaller round, until every tree has one node left.
3. Downwards, the nodes of a round are cogrouped by superblock with the outer nodes that the superblock needs: the siblings on
   its way to the root. One ``applyInPandas`` finishes the local reduction, joins the proofs and folds them.

Every group that reaches Python has at most ``BLOCK`` nodes, whatever the groups' sizes. Texts stay in the JVM and are read once.

Defined results: a null id comes first in its group and is never altered by ``tampered``; rows of equal id are ordered by leaf, equal rows
are leaves of their own; empty texts have length 0; a text of any length is one value; an empty table gives an empty
result; only the named columns enter a leaf, others are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.session import pin

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_BITS = 8
_ROW_BITS = 33  # of monotonically_increasing_id


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def place(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """``nodes`` (written) with ``pos``, the rank within ``tree`` from 0, and ``size``, the nodes of the tree.

    Partitions are ranges of (tree, order), so a partition holds a run of each of its trees, and a rank is the row number in
    the run after the rows of the same tree in earlier partitions.
    """
    ordered = nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ordered = pin(ordered.withColumn("__m", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("__m", _ROW_BITS).alias("__part")
    runs = ordered.groupBy(F.col(tree).alias("__tree"), part).agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    runs = pin(runs, "merkle-runs")  # at most a row per partition and tree
    of_tree = Window.partitionBy("__tree")  # as many rows as partitions that hold the tree
    before = pin(runs.select(
        "__tree", "__part", "__first", (F.sum("__n").over(of_tree.orderBy("__part")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(of_tree).alias("size"),
    ), "merkle-ranks")
    met = (F.col(tree) == F.col("__tree")) & (F.shiftright("__m", _ROW_BITS) == F.col("__part"))
    return ordered.join(before, met).withColumn("pos", F.col("__m") - F.col("__first") + F.col("__before")).drop(
        "__m", "__tree", "__part", "__first", "__before"
    )


def levels(size: int) -> int:
    """Rounds of pairing that ``size`` nodes need to become one."""
    return (size - 1).bit_length()


def grow(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes of every level from the given ones up, ``height`` pairings."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[str]:
    """The other node of each run on the way up from ``at``; an empty text where there is none."""
    found = []
    for level in tree[:-1]:
        other = at ^ 1
        found.append(level[other] if other < len(level) else "")
        at >>= 1
    return found


def fold(node: str, at: int, path: list[str]) -> str:
    """The node reached from position ``at`` with the given siblings."""
    for other in path:
        node = digest(*((node, other) if at & 1 == 0 else (other, node)))
        at >>= 1
    return node


def _height(size: int, done: int, bits: int) -> int:
    return max(0, min(bits, levels(size) - done))


def _reduced(done: int, bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Nodes of a superblock -> the node that stands for it in the next round."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        first = rows.iloc[0]
        top = grow(rows["node"].tolist(), _height(int(first["size"]), done, bits))[-1]
        return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["pos"]) >> bits], "size": [first["size"]], "node": top})

    return run


def _proved(done: int, bits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Nodes of a superblock and the outer nodes it needs -> each node's siblings up to the tree's root."""

    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = grow(rows["node"].tolist(), _height(int(rows["size"].iloc[0]), done, bits))
        above = list(outer["path"].iloc[0])
        return rows[["tree", "pos", "size", "node"]].assign(
            path=[siblings(tree, i) + above for i in range(len(rows))], root=outer["root"].iloc[0]
        )

    return run


_NODE = "tree string, pos bigint, size bigint, node string"
_PATH = _NODE + ", path array<string>, root string"


def _block(bits: int) -> list[Column]:
    return [F.col("tree"), F.shiftright("pos", bits).alias("block")]


def climb(nodes: DataFrame, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """The rounds upwards: ``nodes`` (tree, pos, size, node), the nodes of their superblocks, and so on to one node a tree."""
    rounds, done = [nodes], 0
    while rounds[-1].where(F.col("pos") > 0).limit(1).count():
        above = rounds[-1].groupBy(*_block(bits)).applyInPandas(_reduced(done, bits), _NODE)
        rounds.append(pin(above, "merkle-nodes"))
        done += bits
    return rounds


def descend(rounds: list[DataFrame], bits: int, stop: int) -> DataFrame:
    """Paths (tree, pos, size, node, path, root) of the nodes of round ``stop``, from the top round down."""
    top = rounds[-1]
    paths = top.select("tree", "pos", "size", "node", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    for number in range(len(rounds) - 2, stop - 1, -1):
        nodes = rounds[number].groupBy(*_block(bits))
        outer = paths.select("tree", F.col("pos").alias("block"), "path", "root").groupBy("tree", "block")
        paths = pin(nodes.cogroup(outer).applyInPandas(_proved(number * bits, bits), _PATH), "merkle-paths")
    return paths


def _folded(done: int, bits: int, ids: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Leaves of a superblock and the outer nodes it needs -> the manifest's rows."""

    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        need = outer.iloc[0]
        tree = grow(rows["node"].tolist(), _height(int(rows["size"].iloc[0]), done, bits))
        above, further = list(need["path"]), list(need["top_path"])
        proofs, folded = [], []
        for i, (pos, altered) in enumerate(zip(rows["pos"].tolist(), rows["altered"].tolist())):
            path = siblings(tree, i) + above
            proofs.append(digest(*path, *further))
            folded.append(fold(fold(altered, int(pos), path), int(need["top_pos"]), further))
        return pd.DataFrame({
            "id": rows["id"], "leaf": rows["node"], "subroot": need["subroot"], "root": need["root"],
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == need["root"] for f in folded],
        })

    return run


def manifest(
    rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", doc_id: str = "doc_id",
    tampered: dict[str, Column] | None = None, bits: int = BLOCK_BITS,
) -> DataFrame:
    """The manifest of ``rows``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``tampered`` gives, per field, what a later reader of the row finds in its place; ``folded_root`` starts from that
    reader's leaf and uses the manifest's siblings, so ``verified`` tells the rows that still are what they were.
    """
    found = [(tampered or {}).get(f, F.col(f)) for f in fields]
    # a group's name with its null told apart, in an order that puts null first
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = pin(rows.select(
        tree.alias("tree"), F.col(doc_id).alias("id"), leaf(*[F.col(f) for f in fields]).alias("node"),
        leaf(*found).alias("altered"), F.monotonically_increasing_id().alias("n"),
    ), "merkle-leaves")
    kind = dict(leaves.dtypes)["id"]
    placed = pin(place(leaves, "tree", "id", "node", "n"), "merkle-placed")
    rounds = climb(placed.select("tree", "pos", "size", "node"), bits)
    # a tree over the groups' roots, its nodes named by their group until they have a place
    named = pin(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "merkle-groups")
    tops = pin(place(named, "tree", "name"), "merkle-tops")
    top_rounds = climb(tops.select("tree", "pos", "size", "node"), bits)
    top_paths = descend(top_rounds, bits, 0).select("pos", F.col("path").alias("top_path"), "root")
    top = tops.select(F.col("name").alias("tree"), F.col("pos").alias("top_pos"), F.col("node").alias("subroot"), "pos").join(
        top_paths, "pos"
    ).drop("pos")
    if len(rounds) == 1:  # every group is one row: a superblock each, nothing stands above it but the top
        outer = rounds[0].select("tree", F.shiftright("pos", bits).alias("block"), F.array().cast("array<string>").alias("path"))
    else:
        outer = descend(rounds, bits, 1).select("tree", F.col("pos").alias("block"), "path")
    outer = pin(outer.join(top, "tree"), "merkle-outer")
    ddl = (f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    proved = placed.groupBy(*_block(bits)).cogroup(outer.groupBy("tree", "block")).applyInPandas(_folded(0, bits, doc_id), ddl)
    return proved.withColumnRenamed("id", doc_id)


def altered_count(column: Column, doc_id: Column, every: int = 7) -> Column:
    """``column`` raised by one where ``every`` divides the CRC-32 of the decimal id; nulls stay."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % every == 0
    return F.when(F.coalesce(hit, F.lit(False)), column + 1).otherwise(column)
