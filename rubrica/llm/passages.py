"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

Two sorts of paragraphs are compared. A *line* of ``MIN_WORDS`` words or more, or shorter lines in a
row up to a blank line, get ``BANDS`` bands of ``ROWS`` minima over their five-word shingles (recall
0.996 at a Jaccard similarity of 0.75); in each band the paragraphs that collide meet the smallest
and the largest of them, then all of other components. A bitmap of each set bounds the similarity of
a pair from above; what it leaves counts when the exact similarity of the full sets is 0.75 or more. A *cell* is a content-defined piece of a
line, cut where a word's hash is the smallest within ``REACH`` words, so that a passage which is
moved into another line keeps its cells; a cell's only band is its whole content, 64 bits of hash.
Cells in a row that stand in several documents form a run. Within runs, *windows* of cells with
``MIN_WORDS`` words, the shortest from each cell on and up to each cell, are the passages that are
held against each other: whatever repeats in that many words of whole cells is covered by them.

Keepers go by content. Of a class of lines, joined by confirmed pairs only, the lines of the
smallest doc_id stay. A window stays in the smallest doc_id that holds it outside removed lines; a
cell stays where any window over it stays, so the kept copy of a window is whole. Windows in a row
that the same documents hold form one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rubrica.llm.base import (
    SHINGLE_WORDS,
    MinHash,
    bare,
    mix,
    rows_of,
    shingles,
    shingles_in_order,
    stored,
    words_of,
)
from rubrica.llm.components import components

REACH = 4
MIN_WORDS = 16
BANDS = 10
ROWS = 3
MAP_WORDS = 4
BROADCAST_DOCUMENTS = 1_000_000
BLOCK = 1024
SHARE = 1 << 19
PAIRS = 1 << 19
_PIECE = "doc_id bigint, _d bigint, at int, start int, end int, words int, node bigint, marks array<bigint>"
_PLACE = "doc_id bigint, _d bigint, _run bigint, node bigint, first int, last int, held boolean"
_SEGMENT = "doc_id bigint, _d bigint, start int, end int, n_words bigint, class_id bigint, keep_id bigint, n_docs bigint, kept boolean"


def _prefix_sums(h: np.ndarray) -> np.ndarray:
    """Sums of position-dependent hashes, from which any piece's hash follows."""
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(len(h), 0x9E3779B97F4A7C15, np.uint64)) if len(h) else h
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])


_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _piece_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash per run of words [first, last), the same wherever the run stands."""
    sums = _prefix_sums(h)
    with np.errstate(over="ignore"):
        back = np.concatenate(
            [np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(h), _INVERSE, np.uint64))]
        )
        return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def units_of(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that begin a line, and of those that begin a paragraph.

    ``line`` has the line number of every word. A line of ``MIN_WORDS`` words is a paragraph; shorter
    lines in a row are one paragraph up to a blank line.
    """
    first = np.flatnonzero(np.diff(line, prepend=-1) != 0)
    short = np.diff(np.append(first, len(line))) < MIN_WORDS
    joins = short[1:] & short[:-1] & (np.diff(line[first]) == 1)
    return first, first[np.concatenate([[True], ~joins])] if len(first) else first


def cell_borders(h: np.ndarray, text: np.ndarray, line_starts: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a cell: line starts and strict local minima of the hash.

    ``text`` has the number of each word's text; words of other texts are not looked at.
    """
    at = np.arange(len(h)) + REACH * (text + 1)
    padded = np.zeros(at[-1] + REACH + 1, np.uint64)
    padded[at] = h
    least = np.ones(len(h), bool)
    for k in range(1, REACH + 1):
        least &= (h < padded[at - k]) & (h < padded[at + k])
    return np.union1d(np.flatnonzero(least), line_starts).astype(np.int64)


def _marks(h: np.ndarray, first: np.ndarray, last: np.ndarray, minhash: MinHash) -> np.ndarray:
    """One row per paragraph [first, last) of five words or more: band keys, bitmap, set size."""
    grams = shingles_in_order(h)
    # Shingles that cross a paragraph's end lie between two paragraphs' parts and are skipped by the odd places.
    cuts = np.stack([first, last - SHINGLE_WORDS + 1], 1).ravel()
    cuts = cuts[:-1] if cuts[-1] == len(grams) else cuts
    sig = []
    with np.errstate(over="ignore"):
        for a, b in zip(minhash.a, minhash.b, strict=True):
            sig.append(np.minimum.reduceat(grams * a + b, cuts)[::2] >> np.uint64(32))
        keys = []
        for k in range(BANDS):
            key = mix(np.array([k], np.uint64))
            for s in sig[ROWS * k : ROWS * (k + 1)]:
                key = mix(key + s)
            keys.append(key)
        bit = np.uint64(1) << (grams & np.uint64(63))
        word = (grams >> np.uint64(6)) % np.uint64(MAP_WORDS)
        for k in range(MAP_WORDS):
            keys.append(np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), cuts)[::2])
        n = last - first - SHINGLE_WORDS + 1
        owner = np.repeat(np.arange(len(n)), n)
        places = np.arange(len(owner)) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        _, one = np.unique(mix(grams[places] + mix(owner.astype(np.uint64))), return_index=True)
    keys.append(np.bincount(owner[one], minlength=len(n)).astype(np.uint64))
    return np.stack(keys, 1).view(np.int64)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
        "array<bigint>": pa.list_(pa.int64()),
    }
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def _shares(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SHARE`` bytes; a longer text is a range of its own."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SHARE:
            yield at, k
            at, size = k, 0
        size += len(t) + 2
    if at < len(texts):
        yield at, len(texts)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (``at`` counts them in a text) and paragraphs of ``MIN_WORDS`` words (``at`` is -1, with marks).

    Many texts are hashed as one, two line feeds apart.
    """
    minhash = MinHash(BANDS * ROWS, seed=9)
    for ids, keys, texts in rows_of(batches, "doc_id", "_d", "text"):
        texts = [t.encode() for t in texts]
        for low, high in _shares(texts):
            part = texts[low:high]
            data = b"\n\n".join(part)
            h, starts, ends = words_of(data)
            if not len(h):
                continue
            raw = np.frombuffer(data, np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(t) + 2 for t in part])[:-1]])
            text = np.searchsorted(begin, starts, side="right") - 1
            lines, paragraphs = units_of(np.searchsorted(np.flatnonzero(raw == 10), starts))
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            doc = np.array([-1 if i is None else i for i in ids[low:high]])
            empty = np.array([i is None for i in ids[low:high]])
            key = np.array(keys[low:high])

            def spans(first, last, at, marks):
                t = text[first]
                base = point[begin[t]]
                yield pa.array(doc[t], pa.int64(), mask=empty[t])
                yield key[t]
                yield at
                yield point[starts[first]] - base
                yield point[ends[last - 1]] - base
                yield last - first
                yield _piece_hashes(h, first, last).view(np.int64)
                yield marks

            first = cell_borders(h, text, lines)
            at = np.arange(len(first)) - np.searchsorted(text[first], text[first])
            yield _batch(list(spans(first, np.append(first[1:], len(h)), at, pa.nulls(len(first), pa.list_(pa.int64())))), _PIECE)
            last = np.append(paragraphs[1:], len(h))
            long = last - paragraphs >= MIN_WORDS
            if long.any():
                first, last = paragraphs[long], last[long]
                marks = _marks(h, first, last, minhash)
                flat = pa.ListArray.from_arrays(np.arange(len(marks) + 1) * marks.shape[1], marks.ravel())
                yield _batch(list(spans(first, last, np.full(len(first), -1), flat)), _PIECE)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in rows_of(batches, "a", "b", "text_a", "text_b"):
        out, sets = [], {}
        for a, b, ta, tb in zip(*cols, strict=True):
            for node, text in ((a, ta), (b, tb)):
                if node not in sets:
                    sets[node] = shingles(words_of(text.encode())[0])
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                out.append((a, b))
        yield _batch([[a for a, _ in out], [b for _, b in out]], "a bigint, b bigint")


def may_be_alike(one: str, two: str) -> Column:
    """False only where the bitmaps and set sizes of two paragraphs (columns of structs) rule out 0.75.

    A bit that one bitmap has and the other lacks is a shingle that only one set has, so a set's size
    less such bits bounds the intersection from above.
    """

    def shared(x: str, y: str) -> Column:
        own = [F.bit_count(F.col(f"{x}.b{k}").bitwiseAND(F.bitwise_not(f"{y}.b{k}"))) for k in range(MAP_WORDS)]
        return F.col(f"{x}.n") - sum(own[1:], own[0])

    both = F.least(shared(one, two), shared(two, one))
    return 100 * both >= 75 * (F.col(f"{one}.n") + F.col(f"{two}.n") - both)


def _texts(nodes: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """node and text of the paragraphs in the stored ``nodes``, each read from one ``place``."""
    chosen = places.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    spans = stored(chosen.groupBy("_d").agg(F.collect_list(F.struct("node", "start", "end")).alias("spans")), "paragraph-places")
    # Texts are not shuffled while the list of documents that are read again is short.
    few = spans.count() <= BROADCAST_DOCUMENTS
    texts = rows.select("_d", "text").join(F.broadcast(spans) if few else spans, "_d")
    cut = F.transform("spans", lambda s: F.struct(s["node"], F.substring("text", s["start"] + 1, s["end"] - s["start"]).alias("text")))
    texts = texts.select(F.explode_outer(cut).alias("s")).select("s.node", "s.text")
    return stored(texts.dropDuplicates(["node"]), "paragraph-texts")


def _confirmed(pairs: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the stored ``pairs`` (a, b) with an exact Jaccard similarity of 0.75 or more."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = _texts(stored(nodes.distinct(), "paragraphs"), places, rows)
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b")
    return stored(joined.mapInArrow(_exact, "a bigint, b bigint"), "paragraph-links")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by (band, i, j) as tables of whole cells, with the end of each row's cell."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            start = _cell_starts(table)[-1]
            if start:
                yield table[:start], _cell_ends(table[:start])
            rest = table[start:]
    if rest is not None:
        yield rest, _cell_ends(rest)


def _cell_starts(table: pa.Table) -> np.ndarray:
    band, i, j = (_numbers(table.column(c)) for c in ("band", "i", "j"))
    new = (np.diff(band) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _cell_ends(table: pa.Table) -> np.ndarray:
    bounds = np.append(_cell_starts(table), table.num_rows)
    return np.repeat(bounds[1:], np.diff(bounds))


def _met(table: pa.Table, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell and of different components that the bitmaps do not rule out, some at a time."""
    i, j, part, root, n = (_numbers(table.column(c)) for c in ("i", "j", "part", "root", "n"))
    bits = [_numbers(table.column(f"b{k}")).view(np.uint64) for k in range(MAP_WORDS)]
    later = ends - np.arange(len(ends)) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(ends):
        until = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(at, until), later[at:until])
        b = a + 1 + np.arange(len(a)) - (total[a] - total[at])
        at = until
        open_ = (root[a] != root[b]) & ((i[a] == j[a]) | (part[a] != part[b]))
        a, b = a[open_], b[open_]
        own, other = n[a].copy(), n[b].copy()
        for w in bits:
            own -= np.bitwise_count(w[a] & ~w[b])
            other -= np.bitwise_count(w[b] & ~w[a])
        both = np.minimum(own, other)
        alike = 100 * both >= 75 * (n[a] + n[b] - both)
        yield a[alike], b[alike]


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have a partner in their cell."""
    for table, ends in _cells(batches):
        wanted = np.zeros(table.num_rows, bool)
        for a, b in _met(table, ends):
            wanted[a] = wanted[b] = True
        yield from table.filter(pa.array(wanted)).to_batches()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links, of each group of alike rows only those that join what is not joined yet."""
    for table, ends in _cells(batches):
        nodes, texts = table.column("node").to_pylist(), table.column("text")
        tree = np.unique(_numbers(table.column("root")), return_inverse=True)[1]
        up = list(range(tree.max() + 1))
        sets, out = {}, []

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        def grams(k: int) -> frozenset:
            if nodes[k] not in sets:
                sets[nodes[k]] = frozenset(shingles(words_of(texts[k].as_py().encode())[0]).tolist())
            return sets[nodes[k]]

        for some in _met(table, ends):
            for a, b in zip(*(x.tolist() for x in some), strict=True):
                one, two = top(tree[a]), top(tree[b])
                if one != two:
                    x, y = grams(a), grams(b)
                    both = len(x & y)
                    if 100 * both >= 75 * (len(x) + len(y) - both):
                        up[two] = one
                        out.append((nodes[a], nodes[b]))
        yield _batch([[a for a, _ in out], [b for _, b in out]], "a bigint, b bigint")


def _across(met: DataFrame, links: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between paragraphs of a band that ``links`` does not join yet.

    A band of n paragraphs is dealt into blocks of about ``BLOCK``, and every block meets every other
    one and itself in a cell of its own. Pairs live inside a cell's task only: what leaves it is the rows
    that have a partner, then, with their texts, as many links as it takes to join all that are alike.
    """
    roots = stored(components(links), "first-classes")
    rooted = met.select("band", "p.*").join(roots, "node", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "node")), "rooted-bands")
    bands = rooted.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")
    )
    bands = stored(bands.filter("low <> high").select("band", "parts"), "open-bands")
    dealt = rooted.join(bands, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    meets = F.transform(others, lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    dealt = dealt.withColumn("m", F.explode_outer(meets)).select("*", "m.i", "m.j").drop("m", "parts")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    suspects = stored(dealt.mapInArrow(_suspects, dealt.schema), "suspects")
    texts = _texts(stored(suspects.select("node").distinct(), "suspect-paragraphs"), places, rows)
    dealt = suspects.join(texts, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return stored(dealt.mapInArrow(_joined, "a bigint, b bigint"), "further-links")


def _paragraph_links(paragraphs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of different paragraph contents (a, b) with an exact Jaccard similarity of 0.75 or more.

    The smallest and largest paragraph of each band join most of a class; then all of a band that
    are in different components meet, so every paragraph that collides with a like one is joined to it.
    """
    bits = [F.element_at("marks", BANDS + 1 + k).alias(f"b{k}") for k in range(MAP_WORDS)]
    once = paragraphs.dropDuplicates(["node"]).select(
        "node", F.struct("node", *bits, F.element_at("marks", -1).alias("n")).alias("p"), F.slice("marks", 1, BANDS).alias("bands")
    )
    once = stored(once, "paragraph-marks")
    # Only numbers meet in the bands; marks follow for the paragraphs that collide.
    keyed = once.select("node", F.explode_outer("bands").alias("band"))
    full = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    full = stored(full.filter("low <> high"), "band-ends")
    met = stored(keyed.join(full, "band"), "band-places")
    met = stored(met.join(once.select("node", "p"), "node").drop("node"), "colliding")
    pairs = []
    for end in ("low", "high"):
        ends = met.filter(F.col("p.node") == F.col(end)).select("band", F.col("p").alias("e"))
        alike = met.select("band", "p").join(ends, "band").filter("p.node <> e.node").filter(may_be_alike("p", "e"))
        pairs.append(alike.select(F.least("p.node", "e.node").alias("a"), F.greatest("p.node", "e.node").alias("b")))
    pairs = stored(pairs[0].unionByName(pairs[1]).distinct(), "paragraph-pairs")
    places = paragraphs.select("node", "_d", "start", "end")
    links = _confirmed(pairs, places, rows)
    return links.unionByName(_across(met.select("p", "band"), links, places, rows))


def windows(words: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last cells of the shortest windows of ``MIN_WORDS`` words from, and up to, each cell.

    ``run`` has the number of each cell's run, in ascending order; a window lies in one run.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    first = np.arange(n)
    last = np.searchsorted(total, total[:-1] + MIN_WORDS) - 1
    fits = (last < n) & (run[np.minimum(last, n - 1)] == run)
    up_to = np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1
    ends = (up_to >= 0) & (run[np.maximum(up_to, 0)] == run)
    both = np.unique(np.concatenate([first[fits] * n + last[fits], up_to[ends] * n + first[ends]]))
    return both // n, both % n


def _lists(batch: pa.RecordBatch, name: str, *fields: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each row's list begins in the flat lists, and the flat fields. A NULL list counts as empty."""
    column = batch.column(name)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [flat.field(f) for f in fields]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of every run: content, first and last cell, and whether no removed line touches it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, fields = _lists(batch, "cells", "start", "end", "words", "node")
        start, end, words, node = (_numbers(f) for f in fields)
        run = np.repeat(np.arange(batch.num_rows), np.diff(at))
        first, last = windows(words, run)
        name = _piece_hashes(node.view(np.uint64), first, last + 1).view(np.int64)
        held = np.ones(len(first), bool)
        cuts, fields = _lists(batch, "gone", "start", "end")
        low, high = (_numbers(f) for f in fields)
        of = run[first]
        bounds = np.searchsorted(of, np.arange(batch.num_rows + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            s, e = low[cuts[k] : cuts[k + 1]], high[cuts[k] : cuts[k + 1]]
            order = np.argsort(s)
            s, reach = s[order], np.maximum.accumulate(e[order])
            w = slice(bounds[k], bounds[k + 1])
            before = np.searchsorted(s, end[last[w]])
            held[w] = (before == 0) | (reach[before - 1] <= start[first[w]])
        rows = [batch.column(c).take(pa.array(of)) for c in ("doc_id", "_d", "_run")]
        yield _batch([*rows, name, first - at[of], last - at[of], held], _PLACE)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a run with one class and one fate: a cell stays where a window over it stays."""
    for batch in batches:
        at, fields = _lists(batch, "cells", "start", "end", "words")
        start, end, words = (_numbers(f) for f in fields)
        run = np.repeat(np.arange(batch.num_rows), np.diff(at))
        found, fields = _lists(batch, "found", "first", "last", "class_id", "n_docs", "kept", "keep_id")
        if not len(run) or not found[-1]:
            continue
        first, last, name, n_docs, kept = (_numbers(f) for f in fields[:5])
        keeps, keep = _numbers(pc.is_valid(fields[5])), _numbers(pc.fill_null(fields[5], 0))
        base = np.repeat(at[:-1], np.diff(found))
        # The window that decides is written last: one that stays before all others, then the smallest keeper.
        order = np.lexsort((name, n_docs, -keep, keeps, kept))
        size = (last - first + 1)[order]
        window = np.repeat(order, size)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
        fate = np.full(len(run), -1)
        fate[(base + first)[window] + inside] = window
        facts = np.stack([run, fate >= 0, *(x[fate] for x in (name, keep, keeps, n_docs, kept))])
        new = np.concatenate([[True], (facts[:, 1:] != facts[:, :-1]).any(0)])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(run))
        total = np.concatenate([[0], np.cumsum(words)])
        a, b = a[fate[a] >= 0], b[fate[a] >= 0]
        own, w = [batch.column(c).take(pa.array(run[a])) for c in ("doc_id", "_d")], fate[a]
        keep_id = pa.array(keep[w], pa.int64(), mask=~keeps[w])
        yield _batch([*own, start[a], end[b - 1], total[b] - total[a], name[w], keep_id, n_docs[w], kept[w]], _SEGMENT)


def _runs(found: DataFrame, gone: DataFrame) -> DataFrame:
    """Runs of ``MIN_WORDS`` words or more of repeated cells, and what of them stays.

    ``gone`` has the spans (_d, start, end) of removed lines: their copies of a window keep nothing.
    """
    ahead = W.partitionBy("_d").orderBy("at")
    found = found.withColumn("_new", F.coalesce(F.col("at") != F.lag("at").over(ahead) + 1, F.lit(True)))
    found = found.withColumn("_run", F.sum(F.col("_new").cast("int")).over(ahead))
    cell = F.struct("at", "start", "end", "words", "node")
    runs = found.groupBy("doc_id", "_d", "_run").agg(
        F.sum("words").alias("n"), F.sort_array(F.collect_list(cell)).alias("cells")
    ).filter(F.col("n") >= MIN_WORDS)
    cut = gone.groupBy("_d").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    runs = stored(runs.drop("n").join(cut, "_d", "left"), "runs")
    places = stored(runs.mapInArrow(_places, _PLACE), "windows")
    each = places.groupBy("node", "_d", "doc_id").agg(F.max("held").alias("held"))
    holds = each.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.min(F.when(F.col("held"), F.col("doc_id"))).alias("keep_id"),
        F.max("held").alias("stays"),
        F.sum(F.shiftright(F.xxhash64("_d"), 20)).alias("same"),
    )
    # A window that stands in removed lines only goes with them.
    holds = stored(holds.filter("n_docs > 1 AND stays").drop("stays"), "repeated-windows")
    hits = stored(places.join(holds, "node"), "window-places")
    row = W.partitionBy("_d", "_run").orderBy("first", "last")
    linked = [F.lag(c).over(row).eqNullSafe(F.col(c)) for c in ("n_docs", "keep_id", "same")]
    near = F.lag("last").over(row) + 1 >= F.col("first")
    follows = F.coalesce(linked[0] & linked[1] & linked[2] & near, F.lit(False))
    # Windows in a row are one chain, named by its smallest window; chains that share a window are joined.
    chains = hits.withColumn("_new", (~follows).cast("int")).withColumn("_chain", F.sum("_new").over(row))
    chains = chains.withColumn("chain", F.min("node").over(W.partitionBy("_d", "_run", "_chain"))).drop("_new", "_chain")
    chains = stored(chains, "chains")
    names = chains.groupBy("node").agg(F.min("chain").alias("label"), F.max("chain").alias("top"))
    names = stored(names, "chain-names")
    several = stored(names.filter("label <> top").select("node", "label"), "several-chains")
    edges = chains.select("node", "chain").join(several, "node").select(F.col("label").alias("a"), F.col("chain").alias("b"))
    roots = stored(components(edges.filter("a <> b").distinct()).withColumnRenamed("node", "label"), "run-classes")
    names = names.select("node", "label").join(roots, "label", "left")
    names = stored(names.select("node", F.coalesce("root", "label").alias("class_id")), "window-classes")
    hits = chains.drop("chain").join(names, "node")
    kept = F.col("held") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    told = hits.groupBy("_d", "_run").agg(
        F.collect_list(F.struct("first", "last", "class_id", "keep_id", "n_docs", kept.alias("kept"))).alias("found")
    )
    done = runs.drop("gone").join(told, ["_d", "_run"]).mapInArrow(_segments, _SEGMENT)
    return done.withColumn("kind", F.lit("run"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage that stands in several documents: doc_id, kind (run or line), start, end
    (code points), n_words, class_id, keep_id, n_docs, kept.

    Rows with kept = false are the removals. keep_id is the smallest doc_id that holds the passage
    (of runs: outside removed lines), and its copy stays whole; a run is cut where its keeper
    changes, so a row of a run may have fewer than ``MIN_WORDS`` words. A NULL text counts as empty;
    documents without repeated passages have no row, so neither has an empty table. Rows with equal
    doc_id and text are one document; NULL ids stay NULL and never keep.
    """
    rows = bare(docs).withColumn("_d", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    pieces = stored(rows.mapInArrow(_parse, _PIECE), "pieces")
    cells = pieces.filter("at >= 0").drop("marks")
    # Two documents hold a cell when its smallest and largest document key differ.
    shared = cells.groupBy("node").agg(F.min("_d").alias("low"), F.max("_d").alias("high"))
    shared = stored(shared.filter("low <> high").select("node"), "cells")
    found = stored(cells.join(shared, "node", "left_semi").distinct(), "repeated-cells")
    lines = pieces.filter("at < 0").drop("at")
    links = _paragraph_links(lines, rows)
    roots = stored(components(links), "line-classes")
    lined = lines.select("doc_id", "_d", "start", "end", F.col("words").cast("bigint").alias("n_words"), "node")
    lined = stored(lined.join(roots, "node").distinct().withColumnRenamed("root", "class_id"), "linked-lines")
    classes = lined.groupBy("class_id", "_d").agg(F.min("doc_id").alias("low")).groupBy("class_id")
    classes = classes.agg(F.count(F.lit(1)).alias("n_docs"), F.min("low").alias("keep_id"))
    classes = stored(classes.filter("n_docs > 1"), "kept-lines")
    lined = lined.join(classes, "class_id").withColumns(
        {"kind": F.lit("line"), "kept": F.col("doc_id").eqNullSafe(F.col("keep_id"))}
    )
    lined = stored(lined, "near-lines")
    runs = _runs(found, lined.filter("NOT kept").select("_d", "start", "end"))
    names = ["doc_id", "kind", "start", "end", "n_words", "class_id", "keep_id", "n_docs", "kept"]
    return runs.select(*names).unionByName(lined.select(*names))
