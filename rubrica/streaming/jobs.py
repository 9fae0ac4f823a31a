"""Structured Streaming jobs. Log folders are file sources; state is one row per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rubrica.functions import scoring as S
from rubrica.operators.costs import ALERT_AT
from rubrica.sources.writers import write_routed
from rubrica.streaming.state import start_stateful


def stream_files(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", glob: str | None = None
) -> DataFrame:
    """Files arriving in a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def running_scores(judgments: DataFrame) -> DataFrame:
    """Running sums per model of resolved judgments as they come, seeds not collapsed; errored ones only count.

    For the board of the batch run see ``streaming.board``.
    """
    good = S.covered_mask(F.col("judge_error"))
    return judgments.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_judgments"),
        F.count_if(good).alias("n_covered"),
        F.avg(F.when(good, F.col("score_am"))).alias("mean_am"),
        F.avg(F.when(good, F.col("score_gm"))).alias("mean_gm"),
    )


def write_latest(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a table at the state after the newest batch (complete mode, small aggregates)."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return _start(
        stream.writeStream.outputMode("complete").foreachBatch(replace), checkpoint, available_now
    )


def stream_failures(
    records: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Route each batch in one write: ``batch_id=<n>/sink=log`` has every record, ``sink=failures`` the failed ones.

    The batch id is part of the path: a batch that is run again replaces its own files, of both sinks.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        write_routed(batch, f"{path}/batch_id={batch_id}", "overwrite")

    return _start(records.writeStream.foreachBatch(route), checkpoint, available_now)


def running_costs(costs: DataFrame, cap: float, alert_at: float = ALERT_AT) -> DataFrame:
    """Totals per (model, stage)."""
    total = F.sum("amount")
    return costs.groupBy("model", "stage").agg(
        total.alias("total_usd"),
        (total >= cap * alert_at).alias("alert"),
        (total < cap).alias("under_cap"),
    )


class AlertOnce(StatefulProcessor):
    """Total and alert of one ledger; with ``idle_ms`` a timer forgets a ledger that has been quiet so long."""

    def __init__(self, cap: float, alert_at: float, idle_ms: int | None):
        self.cap, self.line, self.idle_ms = cap, cap * alert_at, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", "total double, alerted boolean, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, alerted, last = self.ledger.get() or (0.0, False, 0)
        latest = last
        for pdf in rows:
            total += float(pdf["amount"].sum())
            if self.idle_ms is not None:
                latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
        fire = not alerted and total >= self.line
        self.ledger.update((total, alerted or fire, latest))
        if latest > last:
            if last:
                self.handle.deleteTimer(last + self.idle_ms)
            self.handle.registerTimer(latest + self.idle_ms)
        if fire:
            yield pd.DataFrame({"ledger": [key[0]], "total_usd": [total], "share": [total / self.cap]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ledger.clear()
        return iter([])

    def close(self) -> None:
        pass


def cost_alerts(
    costs: DataFrame, cap: float, alert_at: float = ALERT_AT, idle_ms: int | None = None, delay: str = "1 day"
) -> DataFrame:
    """One row per ledger, once, when its total first reaches the alert share of the cap.

    Rows are summed per Arrow batch where they are read; the keyed state only sees those partial
    sums, so a busy ledger does not pull its rows into one task. ``costs`` needs (ledger, amount), and ``ts`` if ``idle_ms``
    is given: then rows may come late by ``delay``, later ones are dropped, and a ledger without rows for
    ``idle_ms`` of event time is forgotten, total and alert alike.
    """
    timed = idle_ms is not None
    names = ["ledger", "amount", *(["ts"] if timed else [])]

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = {"amount": "sum"} | ({"ts": "max"} if timed else {})
            yield pdf.groupby("ledger", as_index=False, dropna=False).agg(parts)[names]

    schema = "ledger string, amount double" + (", ts timestamp" if timed else "")
    sums = costs.select(*names).mapInPandas(partial_sums, schema)
    if timed:
        sums = sums.withWatermark("ts", delay)
    return sums.groupBy("ledger").transformWithStateInPandas(
        AlertOnce(cap, alert_at, idle_ms), outputStructType="ledger string, total_usd double, share double",
        outputMode="Append", timeMode="EventTime" if timed else "None",
    )


def dedupe_attempts(
    log: DataFrame, keys: list[str], time: str = "timestamp", delay: str = "1 day"
) -> DataFrame:
    """Drop re-delivered attempts of a key within the delay; older keys leave the state."""
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return start_stateful(stream.sparkSession, writer, checkpoint, available_now)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

