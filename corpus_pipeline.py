"""A training corpus from raw documents in five stages, each an operator of ``rubrica.llm``.

Every stage works on all that the one before kept; its rows are written to the shared folder and
read back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.llm import forest, lines, packing, private, quality
from rubrica.llm.base import free_name, read_documents, stored, text_key, unwrapped, wrapped

# Up to so many dropped documents are broadcast, more are shuffled.
BROADCAST_DROPPED = 500_000


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = free_name(docs, "score")
    scored = quality.score(docs, quality.train(docs, labels), name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, lines of repeated runs cut after their first occurrence."""
    return _measured(lines.dedup_lines(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Of rows with equal doc_id and text one stays. A row without a doc_id goes if its group has a row with one;
    groups of such rows only are left as they are, for want of a name.
    """
    groups = stored(forest.near_groups(docs).select(F.struct("doc_id", "_h").alias("key"), "component_id"), "groups")
    leaves = ~F.col("key.doc_id").eqNullSafe(F.col("component_id"))
    dropped = stored(groups.filter(leaves).select("key").distinct(), "dropped")
    twice = groups.filter(~leaves).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    twice = stored(twice, "repeated-rows")
    key = F.struct("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("_h")).alias("key")
    rows = wrapped(docs, key).join(_small(dropped), "key", "left_anti")
    if twice.head(1):
        once = rows.join(_small(twice), "key", "left_semi").dropDuplicates(["key"])
        rows = rows.join(_small(twice), "key", "left_anti").unionByName(once)
    return unwrapped(rows, docs.columns)


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_DROPPED else keys


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and words that disclose it replaced."""
    return _measured(private.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the windows that the documents fill."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("private data", sanitise),
    ("packing", pack),
]

# A trained score and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
