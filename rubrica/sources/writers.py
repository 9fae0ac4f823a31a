"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import scoring as S

# Records repeat their field names and questions in every line; readers take the codec from the file name.
CODEC = "gzip"


def append_records(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append rows as compressed JSON lines; each task adds its own files, so no lock is needed."""
    writer = df.write.mode("append").option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)


def append_bucketed(df: DataFrame, table: str, path: str, key: str = "prompt_id", buckets: int = 64) -> None:
    """Append rows to a table kept in ``buckets`` hash buckets of ``key``, sorted by it, with its files below ``path``.

    Grouping by any keys that include ``key`` and joins on it then need no shuffle, against a
    table of as many buckets. Rows are dealt to buckets before they are written, so a run adds one file per bucket.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("append").format("parquet").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def failed_attempts(records: DataFrame) -> DataFrame:
    return records.filter(F.col("status").isin(S.FILTERED, S.ERROR))


def write_routed(records: DataFrame, path: str, mode: str = "append") -> None:
    """Every record below ``sink=log``, filtered and errored ones below ``sink=failures`` as well.

    A record names the sinks it goes to and is written once per sink: the records are computed once, and both
    sinks appear when the one write commits.
    """
    failed = F.col("status").isin(S.FILTERED, S.ERROR)
    sinks = F.when(failed, F.array(F.lit("log"), F.lit("failures"))).otherwise(F.array(F.lit("log")))
    records.withColumn("sink", F.explode(sinks)).write.mode(mode).option("compression", CODEC).partitionBy("sink").json(path)


def route_failures(records: DataFrame, path: str) -> None:
    """Append a run's records to the log and its failures; see ``write_routed``."""
    write_routed(records, path)


def write_score_tables(tables: dict[str, DataFrame], path: str, csv: bool = False) -> list[str]:
    """One parquet table per name; ``csv`` adds a one-file export, as score tables are small."""
    written = []
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(target)
        written.append(target)
        if csv:
            saved = df.sparkSession.read.parquet(target)
            saved.coalesce(1).write.mode("overwrite").csv(f"{target}_csv", header=True)
    return written


def json_list(df: DataFrame, order: list[Column | str]) -> Column:
    """A small ordered table as one JSON array, as a scalar subquery.

    For score tables of one row per model (or model and cell) only.
    """
    rank = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank)]).alias("o"), F.struct(*df.columns).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"])
    return keyed.agg(F.to_json(rows).alias("rows")).scalar()


def bundle_report(summary: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row whose columns are the summary and each score table as JSON text."""
    return summary.select(
        F.to_json(F.struct(*summary.columns)).alias("summary"),
        *[json_list(df, order).alias(name) for name, (df, order) in tables.items()],
    )


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_annotation_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").csv(path, header=True, escape='"')
