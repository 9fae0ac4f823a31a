"""Near-duplicate documents by an LSH forest of MinHash labels.

Every distinct shingle set (a node; exact and equal-set copies are one) gets ``TREES`` labels of
``DEPTH`` minima. Per tree, nodes with a common label prefix form a region. Depth adapts to the
region: where ``BLOCK`` nodes or more share a prefix, it is cut by the next minimum, down to the
whole label. Candidates come in four rounds, and each is confirmed on the full sets:

1. every node meets the most central node of its region, at each depth that the region has;
2. in regions whose nodes are not one component yet, a node meets its best partner of another
   component, by the share of equal bins of a sketch of one permutation: that joins most of a group;
3. in those still mixed, a node meets its best partner in each other component;
4. then all partners of other components whose share makes a link plausible, in the regions of the least depth: of a
   large one, every part meets every part of what lies outside its largest component.

A pair inside one component cannot change the result, so it is never tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.base import MinHash, bare, rows_of, set_digest, shingles, stored, text_key, words_of
from rubrica.llm.components import components

TREES = 20
START = 3
DEPTH = 6
BLOCK = 256
WIDE = 2048
BINS = 512
# A pair is tested from so many deviations of the sketch below 0.75 on.
DEVIATIONS = 4.5
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(55)
_SIGNED = "doc_id bigint, _h bigint, n_shingles bigint, node binary, sig binary, sketch binary"


def _set_of(text: str) -> np.ndarray:
    return shingles(words_of(text.encode())[0])


def _sketch(items: np.ndarray) -> bytes:
    """One permutation hashing: 8 bits of the least value in each of 512 ranges, 0 where none lies."""
    first = np.searchsorted(items, _EDGES)
    filled = first < np.append(first[1:], len(items))
    out = np.zeros(BINS, np.uint8)
    out[filled] = items[first[filled]] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _plausible(filled: np.ndarray) -> np.ndarray:
    """Least share of equal bins that a pair of similarity 0.75 may show, by the bins it fills.

    The bins are a sample without replacement from the union of both sets, whose size follows from
    the bins left empty. One bin is allowed for on top: small sets have few steps.
    """
    empty = np.maximum(1 - filled / BINS, 1e-9)
    drawn = 1 / filled - 1 / np.maximum(-BINS * np.log(empty), filled)
    return 0.75 - DEVIATIONS * np.sqrt(0.75 * 0.25 * drawn) - 1 / filled


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(TREES * DEPTH)
    for ids, hashes, texts in rows_of(batches, "doc_id", "_h", "text"):
        sizes, nodes, sigs, sketches = [], [], [], []
        for text in texts:
            items = _set_of(text)
            sizes.append(len(items))
            nodes.append(set_digest(items) if len(items) else None)
            low = minhash.signature(items) & np.uint32(0xFFFF)
            sigs.append(low.astype("<u2").tobytes() if len(items) else None)
            sketches.append(_sketch(items) if len(items) else None)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(ids, pa.int64()), "_h": pa.array(hashes, pa.int64()),
             "n_shingles": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.binary()),
             "sig": pa.array(sigs, pa.binary()), "sketch": pa.array(sketches, pa.binary())}
        )


def _prefix(tree: Column, depth: int) -> Column:
    """Name of the region of a node: tree, depth and the first minima of its label."""
    label = F.substring(F.col("sig"), tree * (2 * DEPTH) + 1, F.lit(2 * depth))
    return F.xxhash64(tree, F.lit(depth), label)


def _regions(nodes: DataFrame) -> DataFrame:
    """node, tree, depth, region, size: every node of every region of two nodes or more."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    rows = nodes.select("node", "sig", F.explode(trees).alias("tree"))
    found = []
    for depth in range(START, DEPTH + 1):
        rows = rows.withColumn("region", _prefix(F.col("tree"), depth))
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        named = rows if depth > START else rows.drop("sig")
        named = stored(named.join(sizes, "region"), "regions")
        found.append(named.select("node", "tree", F.lit(depth).alias("depth"), "region", "size"))
        large = named.filter(F.col("size") > BLOCK).drop("region", "size")
        if large.isEmpty():
            break
        rows = large.join(nodes.select("node", "sig"), "node") if depth == START else large
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _star_pairs(regions: DataFrame) -> DataFrame:
    """Each node with the centre of each of its regions: the node that has most company overall."""
    weight = regions.groupBy("node").agg(F.sum("size").alias("_company"))
    rows = regions.join(weight, "node")
    centre = rows.groupBy("region").agg(F.max(F.struct("_company", "node")).alias("_c"))
    pairs = rows.join(centre.select("region", F.col("_c.node").alias("_c")), "region")
    return _pairs(pairs.select(F.col("_c").alias("a"), F.col("node").alias("b")))


def _pairs(df: DataFrame) -> DataFrame:
    """Unordered pairs of different nodes, each once."""
    pairs = df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.distinct()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= 75 * union of their full shingle sets."""
    known: dict[bytes, np.ndarray] = {}

    def items(node: bytes, text: str) -> np.ndarray:
        if node not in known:
            if len(known) >= 64:
                known.clear()
            known[node] = _set_of(text)
        return known[node]

    for cols in rows_of(batches, "a", "b", "text_a", "text_b"):
        left, right = [], []
        for a, b, ta, tb in zip(*cols, strict=True):
            x, y = items(a, ta), items(b, tb)
            if min(len(x), len(y)) * 100 < 75 * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())}
        )


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b")
    return stored(joined.mapInArrow(_confirm, "a binary, b binary"), "links")


def _mixed(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root, region, size, tree of those regions that hold several components."""
    rows = regions.select("node", "region", "size", "tree").join(roots, "node", "left")
    rows = rows.withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("region").agg(F.min("root").alias("_x"), F.max("root").alias("_y"))
    return rows.join(mixed.filter("_x <> _y").select("region"), "region")


def _open_blocks(regions: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, block, guest (false), sketch of regions that hold several components.

    A region that is still too large at full depth is dealt into blocks by node, differently in each tree: that joins
    most of it at little cost. What is left apart meets in ``_whole_blocks``.
    """
    regions = regions.filter((F.col("size") <= BLOCK) | (F.col("depth") == DEPTH))
    salt = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / BLOCK))
    rows = _mixed(regions, roots).select("node", "root", F.xxhash64("region", salt).alias("block"), F.lit(False).alias("guest"))
    rows = rows.withColumn("tree", F.lit(-1))
    return rows.join(nodes.select("node", "sketch", F.lit(None).cast("binary").alias("sig")), "node")


def _whole_blocks(regions: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``_open_blocks``, but so that every two nodes meet that share any region, of the least depth too, and lie
    in different components.

    A region of up to ``BLOCK`` nodes is one block. In a larger one the nodes outside its largest component are the guests:
    two nodes in different components are never both in the largest. Members and guests are dealt into parts of
    ``WIDE``, and every part of members meets every part of guests under a key of its own.
    """
    rows = _mixed(regions.filter(F.col("depth") == START), roots)
    small = rows.filter(F.col("size") <= BLOCK)
    small = small.select("node", "root", F.xxhash64("region").alias("block"), F.lit(False).alias("guest"), "tree")
    large = stored(rows.filter(F.col("size") > BLOCK).select("node", "root", "region", "size", "tree"), "large-regions")
    counts = large.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("region").agg(
        F.max(F.struct("n", "root"))["root"].alias("top"), (F.sum("n") - F.max("n")).alias("others")
    )
    large = large.join(top, "region").withColumns(
        {"parts": F.ceil(F.col("size") / WIDE), "guests": F.ceil(F.col("others") / WIDE), "guest": F.col("root") != F.col("top")}
    )
    zero = F.lit(0).cast("bigint")

    def met(rows: DataFrame, own: str, other: str, guest: bool) -> DataFrame:
        place = F.pmod(F.xxhash64("node", F.lit(7)), F.col(own))
        rows = rows.withColumn("own", place).withColumn("other", F.explode(F.sequence(zero, F.col(other) - 1)))
        pair = ("other", "own") if guest else ("own", "other")
        return rows.select("node", "root", F.xxhash64("region", *pair).alias("block"), F.lit(guest).alias("guest"), "tree")

    dealt = met(large, "parts", "guests", False).unionByName(met(large.filter("guest"), "guests", "parts", True))
    return small.unionByName(dealt).join(nodes.select("node", "sketch", "sig"), "node")


def _block_pairs(reach: str):
    """Pairs inside blocks: of a node and its "best" partner, the best in "each" component, or "all".

    In a block with guests these meet the others; elsewhere every node meets every other one.
    """

    def pairs_in(nodes: list, roots: list, guests: list, sketches: list, trees: list, sigs: list) -> Iterator[tuple[bytes, bytes]]:
        bins = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), -1)
        _, comp = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
        asked = np.flatnonzero(guests)
        others = np.flatnonzero(~np.array(guests, bool)) if len(asked) else np.arange(len(nodes))
        asked = asked if len(asked) else others
        among, kind = bins[others], comp[others]
        once = reach == "all" and trees[0] >= 0
        if once:
            # Two nodes may share regions of several trees: only the first of them passes the pair on.
            labels = np.frombuffer(b"".join(sigs), "<u2").reshape(len(nodes), TREES, DEPTH)[:, :, :START]
        for i in asked.tolist():
            filled = np.count_nonzero(among | bins[i], axis=1)
            share = np.count_nonzero((among == bins[i]) & (among > 0), axis=1) / filled
            fits = np.flatnonzero((share >= _plausible(filled)) & (kind != comp[i]))
            if once and len(fits):
                common = (labels[others[fits]] == labels[i]).all(axis=2)
                fits = fits[common.argmax(axis=1) == trees[0]]
            if reach != "all":
                fits = fits[np.lexsort((fits, -share[fits]))]
                fits = fits[:1] if reach == "best" else fits[np.unique(kind[fits], return_index=True)[1]]
            for j in others[fits].tolist():
                yield min(nodes[i], nodes[j]), max(nodes[i], nodes[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = ([], [], [], [], [], []), None

        def close() -> Iterator[pa.RecordBatch]:
            found: set[tuple[bytes, bytes]] = set()
            for pair in pairs_in(*held) if len(held[0]) > 1 else ():
                found.add(pair)
                if len(found) == 10_000:
                    yield _pair_batch(found)
                    found = set()
            if found:
                yield _pair_batch(found)

        for cols in rows_of(batches, "block", "node", "root", "guest", "sketch", "tree", "sig"):
            for block, *row in zip(*cols, strict=True):
                if block != current:
                    yield from close()
                    held, current = ([], [], [], [], [], []), block
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        yield from close()

    return run


def _pair_batch(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _partner_pairs(blocks: DataFrame, reach: str) -> DataFrame:
    cut = blocks.repartition("block").sortWithinPartitions("block", "node", "guest")
    return _pairs(cut.mapInArrow(_block_pairs(reach), "a binary, b binary"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text), n_shingles and component_id of every document.

    Documents are linked when their sets of five-word shingles (A-Z lower-cased; a shorter text is
    one shingle) have a Jaccard similarity of 0.75 or more. A NULL text counts as empty; without words a
    document is linked with nothing and is its own component. component_id is the smallest doc_id
    that is reachable; NULL ids never are the smallest unless all are NULL. Repeated rows get the same
    answer each. An empty table gives no rows.
    """
    rows = bare(docs).withColumn("_h", text_key())
    signed = stored(rows.mapInArrow(_sign, _SIGNED), "signatures")
    known = signed.filter("node IS NOT NULL")
    nodes = known.groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch"),
        F.min("_h").alias("_h"),
    )
    nodes = stored(nodes, "nodes")
    regions = stored(_regions(nodes), "forest")
    company = regions.select("node").distinct().join(nodes.select("node", "_h"), "node")
    texts = rows.select("_h", "text").join(company, "_h").dropDuplicates(["node"])
    texts = stored(texts.select("node", "text"), "candidates")
    tested = stored(_star_pairs(regions), "pairs")
    links = _links(tested, texts)
    roots = components(links)
    for reach, opened in (("best", _open_blocks), ("each", _open_blocks), ("each", _whole_blocks), ("all", _whole_blocks)):
        blocks = stored(opened(regions, roots, nodes), "blocks")
        if blocks.isEmpty():
            break
        pairs = stored(_partner_pairs(blocks, reach).join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(stars.unionByName(_links(pairs, texts)))
    lows = roots.join(nodes.select("node", "low"), "node")
    least = lows.groupBy("root").agg(F.min("low").alias("_least"))
    least = roots.join(least, "root").select("node", "_least")
    named = nodes.select("node", "low").join(least, "node", "left")
    named = named.select("node", F.coalesce("_least", "low").alias("_component"))
    done = signed.select("doc_id", "_h", "n_shingles", "node").join(named, "node", "left")
    return done.select(
        "doc_id", "_h", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"),
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document with the smallest id of its component)."""
    return near_groups(docs).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
