"""Concatenate and cut: all documents as one stream of ids, cut into equal windows.

Pass 1 encodes every text once and writes ids with their offset inside the scan partition. The
token totals of the partitions (one row each) give every partition its global offset by a prefix
sum. Pass 2 cuts each document where it crosses a multiple of the window and returns one
boundary record per piece. No row is ever shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rubrica.llm.base import bare, rows_of, stored

WINDOW = 1024
END_ID = 0
# Fixed: the pre-tokenizer of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SCHEMA = "part int, before bigint, doc_id bigint, n bigint, ids binary"
_ARROW = pa.schema(
    [("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
     ("ids", pa.binary())]
)
BATCH_BYTES = 4 << 20
_PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


class ByteEncoder:
    """Byte-level BPE over the vocabulary of a tokenizers file, special strings read as its ids.

    Ids rise with the order of merges there, so they are the ranks that tiktoken asks for; it
    gives the same ids several times faster.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in _byte_letters().items()}
        ranks = {
            bytes(byte[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        self.model = tiktoken.Encoding(
            "packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        ids = self.model.encode_to_numpy(text, allowed_special="all")
        return ids.astype("<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@cache
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)],
        schema=_ARROW,
    )


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, held, size = _encoder(path), 0, [], 0
        end = np.asarray([END_ID], "<u4").tobytes()
        for parts, ids, texts in rows_of(batches, "part", "doc_id", "text"):
            for part, doc, text in zip(parts, ids, texts, strict=True):
                data = encoder.encode(text) + end
                held.append((part, before, doc, len(data) // 4, data))
                before += len(data) // 4
                size += len(data)
                if size > BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in rows_of(batches, "doc_id", "place", "n", "ids"):
            out = []
            for doc, place, n, data in zip(*cols, strict=True):
                view, at = memoryview(data), 0
                while at < n:
                    sequence, offset = divmod(place + at, window)
                    length = min(window - offset, n - at)
                    crc = zlib.crc32(view[4 * at : 4 * (at + length)])
                    out.append((doc, at, length, crc, n, sequence, offset))
                    at += length
            names = [f.split()[0] for f in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names
            )

    return run


def encoded_stream(docs: DataFrame, model_path: str) -> DataFrame:
    """Pass 1: part, before (ids of the part before this document), doc_id, n, ids."""
    rows = bare(docs).withColumn("part", F.spark_partition_id())
    return stored(rows.mapInArrow(_encode(model_path), _SCHEMA), "packing")


def pack(docs: DataFrame, model_path: str, window: int = WINDOW) -> DataFrame:
    """Boundary records of all pieces, one per document and window that it touches.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A NULL or empty
    text is the end id alone. Repeated rows are packed each on its own; NULL ids stay NULL.
    Windows are full but for the last one, so nothing else is ever padded. The order is that of
    the scan; an empty table gives no rows.
    """
    stream = encoded_stream(docs, model_path)
    totals = stream.groupBy("part").agg(F.sum("n").alias("tokens"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per scan task: the window and the broadcast grow with the tasks, not the documents.
    places = totals.select(
        "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base")
    )
    placed = stream.join(F.broadcast(places), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("place"), "n", "ids"
    )
    return placed.mapInArrow(_cut(window), _PIECE)
