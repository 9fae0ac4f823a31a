"""Exact dedup by Grace hashing: recursive partitioning until a bucket fits a table in memory.

Level 0 is the scan: every task folds equal texts in a bounded open-addressing table (a Python
dict, which compares whole contents) before anything moves, so a text that fills a third of the
rows leaves each task only a few times. The folded records are spilled to a table in the shared
folder. Buckets are cut by hash bits; a bucket whose records exceed ``memory`` is cut again by
further bits, level by level, until each fits or holds one hash only. Then every bucket passes
through a table once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rubrica.llm.base import bare, rows_of, stored, tasks
from rubrica.session import durable

MEMORY = 64 << 20
FANOUT = 16
_RECORD = "bucket string, h bigint, bytes bigint, text string, sha string, top bigint, n bigint"
_ARROW = pa.schema(
    [("bucket", pa.string()), ("h", pa.int64()), ("bytes", pa.int64()), ("text", pa.string()),
     ("sha", pa.string()), ("top", pa.int64()), ("n", pa.int64())]
)


def _fold(table: dict, text: str, bucket, h, size, sha, top, n) -> int:
    """Put a record into the table; the bytes by which it grew."""
    old = table.get(text)
    if old is None:
        table[text] = [bucket, h, size, sha, top, n]
        return size + 200
    old[5] += n
    if top is not None and (old[4] is None or top > old[4]):
        old[4] = top
    return 0


def _emit(table: dict) -> Iterator[pa.RecordBatch]:
    items = list(table.items())
    at = 0
    while at < len(items):
        end, size = at, 0
        while end < len(items) and size < 16 << 20:
            size += items[end][1][2] + 100
            end += 1
        part = items[at:end]
        cols = [[v[0] for _, v in part], [v[1] for _, v in part], [v[2] for _, v in part],
                [k for k, _ in part], *([v[i] for _, v in part] for i in (3, 4, 5))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW
        )
        at = end


def _folder(memory: int, by_bucket: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size, current = {}, 0, None
        for cols in rows_of(batches, "bucket", "h", "bytes", "text", "sha", "top", "n"):
            for bucket, h, b, text, sha, top, n in zip(*cols, strict=True):
                if (by_bucket and bucket != current) or (not by_bucket and size > memory):
                    yield from _emit(table)
                    table, size, current = {}, 0, bucket
                size += _fold(table, text, bucket, h, b, sha, top, n)
        yield from _emit(table)

    return fold


def _recut(df: DataFrame, over: DataFrame, level: int) -> DataFrame:
    """Records of the buckets in ``over`` move to sub-buckets chosen by the hash bits of a level."""
    bits = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(FANOUT)).cast("string")
    name = F.when(F.col("_over"), F.concat_ws("/", "bucket", bits)).otherwise(F.col("bucket"))
    return df.join(over, "bucket", "left").withColumn("bucket", name).drop("_over")


def grace_classes(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (largest doc_id), group_size."""
    spark = docs.sparkSession
    records = bare(docs).select(
        F.lit("").alias("bucket"), F.xxhash64("text").alias("h"),
        F.octet_length("text").cast("bigint").alias("bytes"), "text",
        F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("top"),
        F.lit(1).cast("bigint").alias("n"),
    )
    spilled = stored(records.mapInArrow(_folder(memory, False), _RECORD), "grace")
    total = spilled.agg(F.sum("bytes")).first()[0] or 0
    first = max(tasks(spark), 2 * total // memory + 1)
    cut = F.pmod("h", F.lit(first)).cast("string")
    spilled = spilled.withColumn("bucket", cut)
    sizes = spilled.groupBy("bucket", "h").agg(F.sum("bytes").alias("bytes"))
    level = 0
    while True:
        level += 1
        loads = sizes.groupBy("bucket").agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        over = loads.filter((F.col("bytes") > memory) & (F.col("low") < F.col("high")))
        over = durable(over.select("bucket", F.lit(True).alias("_over")))
        if over.isEmpty():
            break
        spilled, sizes = _recut(spilled, over, level), _recut(sizes, over, level)
    placed = spilled.select(*_ARROW.names).repartition(first, "bucket")
    folded = placed.sortWithinPartitions("bucket").mapInArrow(_folder(memory, True), _RECORD)
    return folded.select(
        F.col("sha").alias("text_sha256"), F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """Every document with the row that stays for its text.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. A NULL text counts as empty. Of equal
    texts the largest doc_id stays; NULL ids lose to any id, and if all are NULL none is kept by
    id, so every such row is. Repeated rows count towards group_size and share their answer. The
    memory bound only moves the cuts between buckets, never the result.
    """
    classes = grace_classes(docs, memory)
    rows = bare(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return rows.join(classes, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
