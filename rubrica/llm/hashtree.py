"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A tree is a list of leaves (region, rack, shard, weight); an inner node weighs what its leaves weigh
together. A key descends from the root: at every node each child draws ``-ln(u) / weight``, u in
(0, 1) from the md5 of key and child, and the smallest draw wins, so a child is taken with
probability weight over the sum of its siblings. A draw depends on key, child and the child's weight
only. If weights change, a key changes child only at a node with a changed child: it moves into
a child that became heavier or out of one that became lighter, and subtrees whose weights stay
keep the keys they are given as they lay. A rack that is new to the tree is therefore filled
from everywhere, but no key moves between the old shards; that is why ``grown`` opens a region.

The key of a row and the tree decide its shard, nothing else: neither other rows nor
partitioning. Rows with equal keys share a shard, a NULL key counts as the text ``null``. Slots number
the rows of a shard without gaps in the order of key, size and checksum, NULL first; rows
equal in all three are alike, so it does not matter which is first. They come from counts per shard and
range block, so no shard is sorted in one task. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.base import free_name, stored
from rubrica.operators.ranking import rank_within

Leaf = tuple[str, str, int, float]
RACKS, SHARDS = 3, 4
# A draw is 52 bits of the md5, as 13 hexadecimal digits.
DIGITS = 13


def grid(regions: int, racks: int = RACKS, shards: int = SHARDS) -> list[Leaf]:
    """A tree of equal shards, numbered through from 0."""
    places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
    return [(f"{r}", f"{r}/{k}", i, 1.0) for i, (r, k) in enumerate(places)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, the only one of a new region: keys move into that shard only."""
    shard = max((leaf[2] for leaf in tree), default=-1) + 1
    region = f"+{shard}"
    return [*tree, (region, f"{region}/0", shard, float(weight))]


def children(tree: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """Per level the weight of every child of every node; the root has no name, a leaf's is its shard."""
    if not tree:
        raise ValueError("a tree needs a leaf")
    if len({leaf[2] for leaf in tree}) < len(tree) or min(leaf[3] for leaf in tree) <= 0:
        raise ValueError("shards must differ and weigh more than 0")
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in tree:
        path = ["", region, rack, str(shard)]
        for level in range(3):
            siblings = levels[level].setdefault(path[level], {})
            siblings[path[level + 1]] = siblings.get(path[level + 1], 0.0) + weight
    if sum(len(racks) for racks in levels[1].values()) > len(levels[2]):
        raise ValueError("a rack must lie in one region")
    return levels


def _least(key: Column, level: int, siblings: dict[str, float]) -> Column:
    """The child with the smallest draw; equal draws go to the smaller name."""
    if len(siblings) == 1:
        return F.lit(next(iter(siblings)))
    draws = []
    for name, weight in siblings.items():
        digest = F.md5(F.concat(key, F.lit(f":{level}:{name}")))
        bits = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
        draw = -F.ln((bits + 0.5) / float(16**DIGITS)) / F.lit(weight)
        draws.append(F.struct(draw.alias("draw"), F.lit(name).alias("child")))
    return F.least(*draws)["child"]


def descend(docs: DataFrame, key: Column, tree: list[Leaf], names: list[str]) -> DataFrame:
    """``docs`` with the region, rack and shard of ``key`` under three names of its own."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    at = None
    for level, (name, nodes) in enumerate(zip(names, children(tree), strict=True)):
        choice = None
        for node, siblings in nodes.items():
            child = _least(key, level, siblings)
            if at is None or len(nodes) == 1:
                choice = child
            else:
                here = F.col(at) == node
                choice = F.when(here, child) if choice is None else choice.when(here, child)
        docs = docs.withColumn(name, choice.cast("int") if level == 2 else choice)
        at = name
    return docs


def write_shards(
    docs: DataFrame, tree: list[Leaf], path: str, key: str = "doc_id", rows: int = 1_000_000
) -> None:
    """All columns as Parquet, one folder per shard; a large shard is written by many tasks, files are
    cut at ``rows``. The folder column is ``shard``, with underscores added while the table has such a name.
    """
    names = [free_name(docs, n) for n in ("region", "rack", "shard")]
    placed = descend(docs, F.col(key), tree, names).drop(*names[:2])
    placed.write.option("maxRecordsPerFile", rows).partitionBy(names[2]).parquet(path)


def assign(docs: DataFrame, tree: list[Leaf], more: list[Leaf] | None = None, key: str = "doc_id") -> DataFrame:
    """Per row key, size (UTF-8 bytes of the text and 8 more; a NULL text has none), checksum of
    the text, shard and slot, and the shard under the tree ``more``. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = descend(rows, F.col("doc_id"), tree, ["region", "rack", "shard"])
    rows = descend(rows, F.col("doc_id"), more or tree, ["_region", "_rack", "grown_shard"])
    # Slots need the rows three times, the texts are read once.
    rows = stored(rows.drop("_region", "_rack"), "shards").withColumn("_tie", F.monotonically_increasing_id())
    ranked = rank_within(rows, ["shard"], ["doc_id", "size", "text_crc32", "_tie"], "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("slot") - 1).cast("bigint").alias("slot"), "grown_shard", "region", "rack",
    )
