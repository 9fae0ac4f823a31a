"""A running cost ledger over a stream whose rows arrive out of order.

A row is held until the watermark (the newest event time less a delay) has passed it; then it is released in event-time order with
the total so far. Rows that come when their time has already been released go to a side table. Nothing is kept in one task: each
micro-batch writes its pool of held and new rows, cuts the released ones into range blocks, and adds the carried total
of the batch before. Every table has one folder per micro-batch and the state of a batch is one row (total, watermark,
whether the alert has fired), so a batch that is run again reads the same state and replaces its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rubrica.operators.costs import ALERT_AT, cost_ledger
from rubrica.sources.readers import path_exists

_CARRY = "total double, mark timestamp_ntz, alerted boolean"
CLOSED = "closed"


def _carry(spark: SparkSession, path: str, batch: int) -> tuple:
    """Total, watermark and alert after a batch; one row."""
    if batch < 0:
        return 0.0, None, False
    return tuple(spark.read.schema(_CARRY).parquet(f"{path}/carry/batch_id={batch}").first())


def _pool(spark: SparkSession, path: str, batch: int, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/pool/batch_id={batch}")


def _after(mark):
    return F.lit(True) if mark is None else F.col("ts") > F.lit(mark)


def _release(ready: DataFrame, path: str, name: str, carry: tuple, mark, cap: float, order: list[str], alert_at: float) -> None:
    total, _, alerted = carry
    spark = ready.sparkSession
    rows = cost_ledger(ready, cap, ["ts", *order], alert_at, start=total, alerted=alerted)
    target = f"{path}/ledger/batch_id={name}"
    rows.write.mode("overwrite").parquet(target)
    done = spark.read.schema(rows.schema).parquet(target)
    after = done.agg(
        (F.coalesce(F.sum("amount"), F.lit(0.0)) + total).alias("total"),
        F.lit(mark).cast("timestamp_ntz").alias("mark"),
        (F.coalesce(F.bool_or("alert"), F.lit(False)) | F.lit(alerted)).alias("alerted"),
    )
    after.write.mode("overwrite").parquet(f"{path}/carry/batch_id={name}")


def stream_ledger(
    costs: DataFrame, path: str, checkpoint: str, cap: float, order: list[str], delay: str = "1 day",
    alert_at: float = ALERT_AT, available_now: bool = True,
) -> StreamingQuery:
    """Keep the ledger of ``costs`` (ts, amount and the columns of ``order``, which break ties of ts) below ``path``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        carry = _carry(spark, path, batch_id - 1)
        mark = carry[1]
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        # A row without a time has no place in the order.
        pool = rows.withColumn("_late", F.col("ts").isNull() | ~_after(mark))
        if batch_id > 0:
            before = _pool(spark, path, batch_id - 1, pool.schema)
            pool = pool.unionByName(before.filter(~F.col("_late") & _after(mark)))
        pool.write.mode("overwrite").partitionBy("_late").parquet(f"{path}/pool/batch_id={batch_id}")
        on_time = _pool(spark, path, batch_id, pool.schema).filter("NOT _late").drop("_late")
        newest = on_time.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("m")).first().m
        mark = max((m for m in (mark, newest) if m is not None), default=None)
        ready = on_time.filter(F.lit(False) if mark is None else ~_after(mark))
        _release(ready, path, str(batch_id), carry, mark, cap, order, alert_at)

    writer = costs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _last_batch(spark: SparkSession, path: str) -> int:
    if not path_exists(spark, f"{path}/carry/batch_id=*"):
        return -1
    ids = spark.read.schema(f"{_CARRY}, batch_id string").parquet(f"{path}/carry")
    return ids.agg(F.max(F.expr("try_cast(batch_id AS int)"))).first()[0]


def close_ledger(spark: SparkSession, path: str, cap: float, order: list[str], alert_at: float = ALERT_AT) -> None:
    """Release what is still held, after the stream has ended for good."""
    last = _last_batch(spark, path)
    if last < 0:
        return
    carry = _carry(spark, path, last)
    pool = spark.read.parquet(f"{path}/pool/batch_id={last}").filter(~F.col("_late").cast("boolean")).drop("_late")
    _release(pool.filter(_after(carry[1])), path, CLOSED, carry, carry[1], cap, order, alert_at)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All released rows with their totals and cap states."""
    return spark.read.parquet(f"{path}/ledger").drop("batch_id")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came after their time had been released, or without a time."""
    return spark.read.parquet(f"{path}/pool").filter(F.col("_late").cast("boolean")).drop("_late", "batch_id")
