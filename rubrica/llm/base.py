"""Helpers that several training-data operators share: input forms, scratch tables, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.session import scratch_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Words are maximal runs of anything but blank, tab, line feed, vertical tab, form feed and return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SHINGLE_WORDS = 5
_SLICE = 1 << 22


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bare(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, a NULL text as the empty one; other columns cannot clash any more."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def text_key(text: str = "text") -> Column:
    """Tells rows with the same doc_id and different texts apart."""
    return F.xxhash64(text)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_, name__, ... that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns in one struct ``row``, so that an operator's own columns cannot clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unwrapped(rows: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns back from ``row``, with a new ``text`` if one is given."""
    return rows.select(
        *[text.alias(c) if c == "text" and text is not None else F.col("row").getField(c).alias(c) for c in columns]
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Arrow batches as plain Python values, one batch of columns at a time."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_BYTE = _odd(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = _odd(12, SHINGLE_WORDS)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers[base]
    if len(table) < n:
        size = max(n, 2 * len(table), 4096)
        with np.errstate(over="ignore"):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            table = _powers[base] = np.multiply.accumulate(step)
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _slice_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.empty(len(raw) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[raw]] * _power_table(_BASE, len(raw))[: len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power_table(_INVERSE, len(raw))[starts]
    return mix(h), starts, ends


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a UTF-8 text, A-Z lower-cased, with their byte starts and ends.

    A text is worked on in slices that end between words, so memory stays a few times the slice
    (or the longest word).
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= _SLICE:
        return _slice_hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        h, s, e = _slice_hashes(raw[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles_in_order(words: np.ndarray) -> np.ndarray:
    """Hashes of all five-word shingles of a text of five words or more, in their order."""
    m = len(words) - SHINGLE_WORDS + 1
    with np.errstate(over="ignore"):
        total = words[:m] * _PLACES[0]
        for j in range(1, SHINGLE_WORDS):
            total += words[j : j + m] * _PLACES[j]
    return mix(total)


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct five-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < SHINGLE_WORDS:
        with np.errstate(over="ignore"):
            return mix((words * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
    return np.unique(shingles_in_order(words))


class MinHash:
    """``k`` 32-bit minima of multiply-shift hashes over a set of 64-bit values."""

    def __init__(self, k: int, seed: int = 5):
        self.a, self.b = _odd(seed, k), _odd(seed + 1, k)

    def signature(self, items: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(items), 2048):
                h = items[at : at + 2048, None] * self.a + self.b
                best = np.minimum(best, (h.min(0) >> np.uint64(32)).astype(np.uint32))
        return best


def set_digest(items: np.ndarray) -> bytes:
    """128 bits that name a set, from its sorted distinct values."""
    with np.errstate(over="ignore"):
        a = mix(items ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
        b = (mix(items + np.uint64(0x632BE59BD9B4E019)) * _BYTE[7]).sum(dtype=np.uint64)
    return mix(np.array([a + np.uint64(len(items)), b ^ a], np.uint64)).tobytes()
