"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

Vectors of integers are sorted along a Hilbert curve through all their dimensions, cut into blocks of up to
``BLOCK`` rows and written as Parquet, one row per block: packed ids, labels and vectors, and as
its zone map the smallest and largest value of every dimension, the labels it holds and its longest norm.
For an anchor ``a`` and a block with corners lo, hi, interval arithmetic bounds every score in the block:

    sum(max(a,0) * lo + min(a,0) * hi) <= score <= sum(max(a,0) * hi + min(a,0) * lo)

Zone maps alone are read to choose blocks. A block is read for an anchor's positives if it holds the label and can
reach the anchor's fifth best score inside its own block (a floor of the final one), and for its negatives
if it holds another label and its bounds meet one of the anchor's windows [low * p, p]. Both choices
are exact, so nothing is lost; how much they save depends on how far the vectors cluster.

Zone maps are small (some hundred bytes a block): tasks that choose hold all of them, and each group of anchors visits one such task.
Blocks lie on shelves, runs of blocks along the curve of up to ``SHELF_BYTES`` each. A task holds one shelf, and every group
that asked for blocks of it passes by; it multiplies the group by each of them and passes on one row per group with the
first wanted rows of each anchor or window. So a block crosses the network once a search and a group once a shelf, never
once per pair, and nothing is broadcast or sent to the driver. Anchors stay in curve order in groups of up to ``GROUP``. A
label or a vector that many rows share only fills more blocks. No step holds more than zone maps, a shelf, a group and its scores
with one block.

Defined cases. Rows with a NULL label, a NULL vector, a NULL or non-finite component, or a NULL id take no part. A
shorter vector has zeros at its end. Repeated rows are rows of their own: each is a candidate and, if an anchor,
mined on its own. Components beyond 32 bits count as the largest value of 32 bits; scores must fit 64. Other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rubrica.llm.base import rows_of, stored, tasks

BLOCK = 2048
GROUP = 512
# Zone maps of so many blocks are looked through at once.
PAGE = 64
# Range partitions at most: each sends some hundred keys to the driver.
PARTS = 1000
# Packed blocks that a task holds, and as many shelves as tasks up to so many.
SHELF_BYTES = 64 << 20
SHELVES = 64
# Blocks in which positives are sought at once: each has few rows of a label.
TOGETHER = 8
# Rows found that a group holds before it compares them.
HELD = 8192
# Bits of each dimension that place a row on the curve.
CURVE_BITS = 4
LEAST = -(2**62)
_ROW = "vec_id bigint, label int, anchor boolean, vector binary, curve binary"
_BLOCK = (
    "part int, seq int, ids binary, labels binary, anchors binary, vectors binary, lo binary, hi binary, "
    "kinds binary, norm double"
)
_GROUP = "grp bigint, places array<bigint>, ids binary, labels binary, vectors binary, floors binary, norm double"
# Scores and ids of the positives of each anchor, LEAST where there is none.
_WINDOWS = f"{_GROUP}, tops binary, top_ids binary"
# What a shelf has for a group: the anchor's place in the group, id and score of each row.
_FOUND = "grp bigint, who binary, ids binary, scores binary"
_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, as rows of big-endian bytes, of points with coordinates below 2**bits.

    Works on all points at once, bit plane by bit plane from the top: the lower bits of a dimension are
    reflected where its bit is set and exchanged with those of the first dimension where it is not.
    """
    x = cells.astype(np.uint32).T.copy()
    dims, n = x.shape
    for plane in range(bits - 1, 0, -1):
        below = np.uint32((1 << plane) - 1)
        for d in range(dims):
            is_set = (x[d] >> np.uint32(plane) & np.uint32(1)).astype(bool)
            x[0, is_set] ^= below
            swap = np.where(is_set, np.uint32(0), (x[0] ^ x[d]) & below)
            x[0] ^= swap
            x[d] ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(n, np.uint32)
    for plane in range(bits - 1, 0, -1):
        is_set = (x[-1] >> np.uint32(plane) & np.uint32(1)).astype(bool)
        turn[is_set] ^= np.uint32((1 << plane) - 1)
    x ^= turn
    planes = [(x >> np.uint32(p) & np.uint32(1)).astype(np.uint8) for p in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_TYPES = {
    "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(),
    "array<bigint>": pa.list_(pa.int64()),
}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")])


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The matrix back from binary values."""
    if not width or not len(column):
        return np.zeros((len(column), width), kind)
    _, ends, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
    """Of each batch the rows whose components are all finite: their numbers in the batch, lengths, integer components."""
    most = float(2**31 - 1)
    for b in batches:
        if not b.num_rows:
            continue
        vectors = b.column(b.schema.get_field_index("vector"))
        sizes = np.diff(vectors.offsets.to_numpy())
        x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        bad = np.r_[0, np.cumsum(~np.isfinite(x))]
        ends = np.r_[0, np.cumsum(sizes)]
        good = bad[ends[1:]] == bad[ends[:-1]]
        x, sizes = x[np.repeat(good, sizes)], sizes[good]
        with np.errstate(over="ignore"):
            yield b, np.flatnonzero(good), sizes, np.clip(np.floor(x * scale), -most, most).astype(np.int64)


def _extent(scale: int):
    """Number of rows, most components, least and greatest component of every batch."""
    schema = _schema("n bigint, dims bigint, low bigint, high bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, sizes, x in _whole(batches, scale):
            if len(at):
                yield _batch(schema, [(len(at), int(sizes.max()), int(x.min(initial=0)), int(x.max(initial=0)))])

    return run


def _curve(dims: int, low: int, high: int, kind: str, scale: int):
    """Packed integers and the curve place of every row."""
    schema = _schema(_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, sizes, x in _whole(batches, scale):
            whole = np.zeros((len(at), dims), np.int64)
            whole[np.arange(dims) < sizes[:, None]] = x
            cells = ((whole - low).astype(np.float64) * (1 << CURVE_BITS) / (high - low + 1)).astype(np.int64)
            places = hilbert(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS) if dims else np.zeros((len(at), 1), np.uint8)
            ids, labels, anchors = (b.column(b.schema.get_field_index(c)).take(pa.array(at)) for c in ("vec_id", "label", "anchor"))
            yield pa.RecordBatch.from_arrays([ids, labels, anchors, _binary(whole.astype(kind)), _binary(places)], schema=schema)

    return run


def _pack(dims: int, kind: str):
    """Sorted rows of one range partition as blocks."""
    schema = _schema(_BLOCK)

    def block(part: int, seq: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels, anchors, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max())
        return _batch(schema, [(
            part, seq, ids.tobytes(), labels.tobytes(), anchors.tobytes(), vectors.tobytes(), vectors.min(0).tobytes(),
            vectors.max(0).tobytes(), np.unique(labels).tobytes(), float(norm),
        )])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq, part = [], 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            column = dict(zip(b.schema.names, b.columns, strict=True))
            rows = [column[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "anchor")]
            rows.append(_matrix(column["vector"], kind, dims))
            parts = column["part"].to_numpy()
            for lo, hi in pairwise([0, *np.flatnonzero(np.diff(parts)) + 1, len(parts)]):
                if part != parts[lo]:
                    if held:
                        yield block(part, seq, held)
                    held, size, seq, part = [], 0, 0, int(parts[lo])
                while lo < hi:
                    end = min(hi, lo + BLOCK - size)
                    held.append(tuple(x[lo:end] for x in rows))
                    size, lo = size + end - lo, end
                    if size == BLOCK:
                        yield block(part, seq, held)
                        held, size, seq = [], 0, seq + 1
        if held:
            yield block(part, seq, held)

    return run


def blocks_of(rows: DataFrame, scale: int = 256) -> tuple[DataFrame, int, str, int, int]:
    """The table of blocks, the number of dimensions, the type of a component, the number of parts and of shelves.

    ``rows``: vec_id, vector, label, anchor.
    """
    clean = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(
        "vec_id", "vector", F.col("label").cast("int").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor")
    )
    extent = clean.select("vector").mapInArrow(_extent(scale), "n bigint, dims bigint, low bigint, high bigint")
    n, dims, low, high = (x or 0 for x in extent.agg(F.sum("n"), F.max("dims"), F.min("low"), F.max("high")).first())
    kind = "<i2" if max(-low, high) < 2**15 else "<i4"
    keyed = stored(clean.mapInArrow(_curve(dims, low, high, kind, scale), _ROW), "curve")
    spark = rows.sparkSession
    parts = max(1, min(-(-n // BLOCK), PARTS, max(4 * tasks(spark), n // (BLOCK * PAGE))))
    order = ["curve", "vec_id", "label", "_tie"]
    cut = keyed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    cut = cut.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    packed = n * (dims * np.dtype(kind).itemsize + 13)
    shelves = min(parts, max(1, min(tasks(spark), SHELVES), -(-packed // SHELF_BYTES)))
    return stored(cut.mapInArrow(_pack(dims, kind), _BLOCK), "blocks"), dims, kind, parts, shelves


def _products(left: np.ndarray, right: np.ndarray, norms: float) -> np.ndarray:
    """Exact inner products, in the narrowest type whose sums cannot round.

    A limit may be rounded to that type before it is compared: beyond the sums it stays beyond them.
    """
    if norms < 2**23:
        return left.astype(np.float32) @ right.astype(np.float32).T
    if norms < 2**52:
        return left.astype(np.float64) @ right.astype(np.float64).T
    return left.astype(np.int64) @ right.astype(np.int64).T


def _first(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every row: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    ranked = rows[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
    nth = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.r_[starts, len(ranked)]))
    return order[nth < k]


def _places(part: int, seq: int, at: np.ndarray) -> np.ndarray:
    """A number for each row: its part, block and place in the block."""
    return (np.int64(part) << 40) + (np.int64(seq) << 16) + at.astype(np.int64)


def _gather(dims: int, kind: str, wanted: int):
    """Anchors in groups, each with the floor of its last wanted positive found in its own block."""
    schema = _schema(_GROUP)

    def group(parts: list[tuple]) -> tuple:
        places, ids, labels, vectors, floors = (np.concatenate(x) for x in zip(*parts, strict=True))
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max())
        return (
            int(places[0]), places, ids.tobytes(), labels.tobytes(), vectors.tobytes(), floors.tobytes(), float(norm),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ("part", "seq", "ids", "labels", "anchors", "vectors", "norm")
        for columns in rows_of(batches, *names):
            for part, seq, ids, labels, anchors, vectors, norm in zip(*columns, strict=True):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int32)
                vectors = np.frombuffer(vectors, kind).reshape(len(ids), dims)
                found = np.flatnonzero(np.frombuffer(anchors, bool))
                for lo in range(0, len(found), GROUP):
                    at = found[lo : lo + GROUP]
                    scores = _products(vectors[at], vectors, norm * norm).astype(np.int64)
                    same = labels[at][:, None] == labels
                    same[np.arange(len(at)), at] = False
                    scores = np.where(same, scores, LEAST)
                    floors = np.full(len(at), LEAST, np.int64)
                    if len(ids) >= wanted:
                        floors = np.partition(scores, len(ids) - wanted, axis=1)[:, len(ids) - wanted]
                    if size + len(at) > GROUP:
                        yield _batch(schema, [group(held)])
                        held, size = [], 0
                    held.append((_places(part, seq, at), ids[at], labels[at], vectors[at], floors))
                    size += len(at)
        if held:
            yield _batch(schema, [group(held)])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time; binary values are not copied."""
    for b in batches:
        for i in range(b.num_rows):
            cells = {name: column[i] for name, column in zip(b.schema.names, b.columns, strict=True)}
            yield {k: (x.as_buffer() if pa.types.is_binary(x.type) else x.as_py()) if x.is_valid else None for k, x in cells.items()}


def _part_of(scores: np.ndarray, low: int) -> np.ndarray:
    """``low`` percent of whole scores, rounded up; no product beyond the scores themselves."""
    whole, rest = np.divmod(scores, 100)
    return whole * low - (-low * rest // 100)


class _Zones:
    """Zone maps of some blocks."""

    def __init__(self, dims: int, kind: str, rows: list[dict]):
        self.keys = [(r["part"], r["seq"]) for r in rows]
        self.lo, self.hi = (
            np.concatenate([np.frombuffer(r[c], kind) for r in rows]).reshape(len(rows), dims).astype(np.float64).T
            for c in ("lo", "hi")
        )
        kinds = [np.frombuffer(r["kinds"], np.int32) for r in rows]
        self.counts, self.kinds = np.array([len(k) for k in kinds]), np.concatenate(kinds)
        self.of, self.first = np.repeat(np.arange(len(rows)), self.counts), np.array([k[0] for k in kinds])

    def hold(self, labels: np.ndarray, other: bool) -> np.ndarray:
        """Which blocks (columns) hold each label (rows), or a label other than it."""
        if other:
            return (self.counts > 1) | (labels[:, None] != self.first)
        own, nth = np.unique(labels, return_inverse=True)
        at = np.minimum(np.searchsorted(own, self.kinds), len(own) - 1)
        hit = own[at] == self.kinds
        table = np.zeros((len(own), len(self.counts)), bool)
        table[at[hit], self.of[hit]] = True
        return table[nth]


class _Best:
    """The first ``wanted`` rows of each of ``n`` lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, wanted: int):
        self.scores = np.full((n, wanted), LEAST, np.int64)
        self.ids, self.at = np.zeros((n, wanted), np.int64), np.zeros((n, wanted), np.int64)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        last, last_id = self.scores[lists, -1], self.ids[lists, -1]
        better = np.flatnonzero((scores > last) | (scores == last) & (ids < last_id))
        if not len(better):
            return
        lists = lists[better]
        touched, wanted = np.unique(lists), self.scores.shape[1]
        lists = np.concatenate([np.repeat(touched, wanted), lists])
        scores, ids, at = (
            np.concatenate([old[touched].ravel(), x[better]])
            for old, x in ((self.scores, scores), (self.ids, ids), (self.at, at))
        )
        # Every list touched has its old entries, empty ones too, so it gets just as many.
        pick = _first(lists, scores, ids, wanted).reshape(len(touched), wanted)
        self.scores[touched], self.ids[touched], self.at[touched] = scores[pick], ids[pick], at[pick]


class _Anchors:
    """A group of anchors unpacked: with windows once their positives are known, with floors for positives before."""

    def __init__(self, dims: int, kind: str, low: int, wanted: int, row: dict):
        self.labels, self.norm = np.frombuffer(row["labels"], np.int32), row["norm"]
        n = len(self.labels)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, dims)
        # What a search does not compare stays with the group.
        self.ids, self.floors, self.tops, self.top_ids = (
            None if row.get(c) is None else np.frombuffer(row[c], np.int64) for c in ("ids", "floors", "tops", "top_ids")
        )
        self.places = None if row.get("places") is None else np.array(row["places"], np.int64)
        self.windows = self.tops is not None
        if self.windows:
            # Per anchor and positive: its score (LEAST where there is none) and id; a window below 0 is empty.
            self.tops = self.tops.reshape(n, -1)
            self.least = np.where(self.tops >= 0, _part_of(self.tops, low), np.iinfo(np.int64).max)
        self.best = _Best(self.tops.size if self.windows else n, wanted)
        self.held, self.size = [], 0

    def needs(self) -> np.ndarray:
        """The score that a row must reach by now, per anchor or per window."""
        last = self.best.scores[:, -1]
        return np.maximum(self.least, last.reshape(self.tops.shape)) if self.windows else np.maximum(self.floors, last)

    def bounds(self, zones: _Zones) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor in each block."""
        up = np.maximum(self.vectors, 0).astype(np.float64)
        down = np.minimum(self.vectors, 0).astype(np.float64)
        least, most = up @ zones.lo + down @ zones.hi, up @ zones.hi + down @ zones.lo
        # Sums beyond 2**53 may round.
        return least - np.abs(least) * 1e-12, most + np.abs(most) * 1e-12

    def meets(self, least: np.ndarray, most: np.ndarray, holds: np.ndarray) -> np.ndarray:
        """Which anchors (rows) must read which blocks (columns), by their bounds."""
        needs = self.needs()
        if not self.windows:
            return holds & (most >= needs[:, None])
        found = np.zeros(holds.shape, bool)
        for j in range(self.tops.shape[1]):
            found |= (most >= needs[:, j, None]) & (least <= self.tops[:, j, None])
        return holds & found

    def asks(self, zones: _Zones) -> np.ndarray:
        return self.meets(*self.bounds(zones), zones.hold(self.labels, self.windows))

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Rows for the anchors ``who``; they count once enough are held."""
        self.held.append((who, scores, ids, at))
        self.size += len(who)
        if self.size >= HELD:
            self.settle()

    def settle(self) -> None:
        """The held rows into the list of their anchor, or into each window that they meet."""
        if self.size:
            rows = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            for lo in range(0, self.size, 8 * HELD):
                who, scores, ids, at = (x[lo : lo + 8 * HELD] for x in rows)
                if self.windows:
                    fits = (scores[:, None] <= self.tops[who]) & (scores[:, None] >= self.least[who])
                    row, j = np.divmod(np.flatnonzero(fits), fits.shape[1])
                    who, scores, ids, at = who[row] * fits.shape[1] + j, scores[row], ids[row], at[row]
                self.best.add(who, scores, ids, at)
        self.held, self.size = [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, id and score of all rows in lists, a row that several windows of an anchor want once."""
        self.settle()
        lists, nth = np.nonzero(self.best.scores > LEAST)
        who, at = lists // (self.tops.shape[1] if self.windows else 1), self.best.at[lists, nth]
        order = np.lexsort((at, who))
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(who[order]) != 0) | (np.diff(at[order]) != 0)
        lists, nth, who = lists[order[once]], nth[order[once]], who[order[once]]
        return who, self.best.ids[lists, nth], self.best.scores[lists, nth]


class _Block:
    """A block on its shelf, its rows by label."""

    def __init__(self, dims: int, kind: str, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(len(self.ids), dims)
        self.places, self.norm = _places(row["part"], row["seq"], np.arange(len(self.ids))), row["norm"]
        order = np.argsort(self.labels, kind="stable")
        self.ids, self.labels, self.vectors, self.places = (
            x[order] for x in (self.ids, self.labels, self.vectors, self.places)
        )
        self.starts = np.flatnonzero(np.r_[True, np.diff(self.labels) != 0, True])

    def slices(self) -> Iterator[tuple[int, slice]]:
        for lo, hi in pairwise(self.starts.tolist()):
            yield int(self.labels[lo]), slice(lo, hi)


def _reached(scores: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that reach what their row needs."""
    needs = needs.astype(scores.dtype)
    some = np.flatnonzero(scores.max(axis=1) >= needs)
    row, col = np.divmod(np.flatnonzero(scores[some] >= needs[some, None]), scores.shape[1])
    return some[row], col


def _same(anchors: _Anchors, who: np.ndarray, blocks: list[_Block]) -> None:
    """Take the rows that the anchors ``who`` want as positives, label by label."""
    needs, labels = anchors.needs(), anchors.labels[who]
    norms = anchors.norm * max(b.norm for b in blocks)
    held = {}
    for block in blocks:
        for label, rows in block.slices():
            held.setdefault(label, []).append((block.vectors[rows], block.ids[rows], block.places[rows]))
    for label in np.unique(labels).tolist():
        if label not in held:
            continue
        own = who[labels == label]
        vectors, ids, places = (np.concatenate(x) for x in zip(*held[label], strict=True))
        scores = _products(anchors.vectors[own], vectors, norms)
        row, col = _reached(scores, needs[own])
        others = anchors.places[own[row]] != places[col]
        row, col = row[others], col[others]
        anchors.add(own[row], scores[row, col].astype(np.int64), ids[col], places[col])


def _other(anchors: _Anchors, who: np.ndarray, block: _Block) -> None:
    """Take the rows that the anchors ``who`` want as negatives."""
    scores = _products(anchors.vectors[who], block.vectors, anchors.norm * block.norm)
    row, col = _reached(scores, anchors.needs()[who].min(1))
    other = anchors.labels[who[row]] != block.labels[col]
    row, col = row[other], col[other]
    anchors.add(who[row], scores[row, col].astype(np.int64), block.ids[col], block.places[col])


def _choose(dims: int, kind: str, low: int, wanted: int):
    """(group, part, seq) of the blocks that some anchor of the group must read. Zone maps come before groups."""
    schema = _schema("grp bigint, part int, seq int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        desk, rows, pages = None, [], []
        for row in _listed(batches):
            if row["desk"] != desk:
                desk, rows, pages = row["desk"], [], []
            if row["grp"] is None:
                rows.append(row)
                if len(rows) < PAGE:
                    continue
            if rows:
                pages.append(_Zones(dims, kind, rows))
                rows = []
            if row["grp"] is None:
                continue
            anchors = _Anchors(dims, kind, low, wanted, row)
            for zones in pages:
                asked = [(row["grp"], *zones.keys[k]) for k in np.flatnonzero(anchors.asks(zones).any(axis=0))]
                if asked:
                    yield _batch(schema, asked)

    return run


def _match(dims: int, kind: str, low: int, wanted: int):
    """What every group finds in the blocks it asked for. The blocks of a shelf come before groups."""
    schema = _schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, blocks, maps = None, {}, {}
        for row in _listed(batches):
            if row["shelf"] != shelf:
                shelf, blocks, maps = row["shelf"], {}, {}
            if row["grp"] is None:
                key = row["part"] << 32 | row["seq"]
                blocks[key], maps[key] = _Block(dims, kind, row), {c: row[c] for c in ("part", "seq", "lo", "hi", "kinds")}
                continue
            anchors = _Anchors(dims, kind, low, wanted, row)
            asked = sorted(row["asked"])
            for at in range(0, len(asked), PAGE):
                page = asked[at : at + PAGE]
                zones = _Zones(dims, kind, [maps[k] for k in page])
                (least, most), holds = anchors.bounds(zones), zones.hold(anchors.labels, anchors.windows)
                step = 1 if anchors.windows else TOGETHER
                for k in range(0, len(page), step):
                    some = slice(k, k + step)
                    who = np.flatnonzero(anchors.meets(least[:, some], most[:, some], holds[:, some]).any(axis=1))
                    if len(who) and anchors.windows:
                        _other(anchors, who, blocks[page[k]])
                    elif len(who):
                        _same(anchors, who, [blocks[key] for key in page[some]])
            who, ids, scores = anchors.found()
            if len(who):
                yield _batch(schema, [(row["grp"], who.astype(np.int32).tobytes(), ids.tobytes(), scores.tobytes())])

    return run


def _merge(dims: int, kind: str, low: int, wanted: int, windows: bool):
    """The first rows of each anchor or window over all shelves. A group comes before what was found for it."""
    schema = _schema(_MINED if windows else _WINDOWS)

    def ended(row: dict, anchors: _Anchors) -> pa.RecordBatch:
        anchors.settle()
        best = anchors.best
        if not windows:
            cells = [row[f.split()[0]] for f in _GROUP.split(", ")]
            cells = [x.to_pybytes() if isinstance(x, pa.Buffer) else x for x in cells]
            return _batch(schema, [(*cells, best.scores.tobytes(), best.ids.tobytes())])
        lists, nth = np.divmod(np.flatnonzero(best.scores > LEAST), wanted)
        who, j = np.divmod(lists, anchors.tops.shape[1])
        columns = (
            anchors.ids[who], anchors.top_ids[lists], (nth + 1).astype(np.int32), best.ids[lists, nth], anchors.tops[who, j],
            best.scores[lists, nth],
        )
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for row in _listed(batches):
            if row["who"] is None:
                if group is not None:
                    yield ended(group, anchors)
                group, anchors = row, _Anchors(dims, kind, low, wanted, row)
                continue
            scores, ids = np.frombuffer(row["scores"], np.int64), np.frombuffer(row["found"], np.int64)
            anchors.add(np.frombuffer(row["who"], np.int32).astype(np.int64), scores, ids, np.zeros(len(ids), np.int64))
        if group is not None:
            yield ended(group, anchors)

    return run


def _search(blocks: DataFrame, groups: DataFrame, shape: tuple[int, str, int, int], low: int, wanted: int) -> DataFrame:
    """The groups with the first ``wanted`` rows per anchor, or, where groups have windows, the rows of each window."""
    dims, kind, parts, shelves = shape
    how = (dims, kind, low, wanted)
    desks = max(1, min(groups.count(), tasks(blocks.sparkSession), SHELVES))
    zones = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(desks - 1))).alias("desk"), "part", "seq", "lo", "hi", "kinds"
    )
    windows = "tops" in groups.columns
    compared = groups.select("grp", "labels", "vectors", "norm", *(["tops"] if windows else ["floors", "places"]))
    visits = compared.withColumn("desk", F.pmod(F.xxhash64("grp"), F.lit(desks)).cast("int"))
    looks = _first_then(zones, visits, "desk", desks)
    chosen = stored(looks.mapInArrow(_choose(*how), "grp bigint, part int, seq int"), "chosen")
    shelf = F.expr(f"cast(cast(part AS bigint) * {shelves} div {parts} AS int)").alias("shelf")
    key = F.expr("shiftleft(cast(part AS bigint), 32) | seq")
    asked = chosen.groupBy("grp", shelf).agg(F.collect_list(key).alias("asked"))
    # Merged: the file of chosen pairs is far smaller than its rows, too small to be judged by.
    visits = asked.hint("merge").join(compared, "grp")
    stock = blocks.drop("anchors").withColumn("shelf", shelf)
    found = _first_then(stock, visits, "shelf", shelves).mapInArrow(_match(*how), _FOUND)
    found = found.withColumnRenamed("ids", "found")
    both = groups.unionByName(found, allowMissingColumns=True).repartition("grp")
    both = both.sortWithinPartitions("grp", F.col("who").isNotNull())
    return both.mapInArrow(_merge(*how, windows), _MINED if windows else _WINDOWS)


def _first_then(held: DataFrame, visits: DataFrame, key: str, parts: int) -> DataFrame:
    """One task per value of ``key``: there the blocks in their order, then all groups."""
    both = held.unionByName(visits, allowMissingColumns=True).repartitionById(parts, key)
    return both.sortWithinPartitions(key, F.col("grp").asc_nulls_first(), "part", "seq")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """For each anchor and each of its ``positives`` best other rows of its label, the first ``negatives`` rows
    of other labels that score between ``low`` percent of the positive's score and that score.

    ``rows``: vec_id, vector (array of numbers), label, anchor (boolean). A component x counts as floor(scale * x).
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    blocks, *shape = blocks_of(rows, scale)
    groups = stored(blocks.mapInArrow(_gather(*shape[:2], positives), _GROUP), "anchors")
    sought = stored(_search(blocks, groups, shape, low, positives), "windows")
    return _search(blocks, sought, shape, low, negatives)
