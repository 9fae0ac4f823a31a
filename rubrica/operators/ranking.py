"""Ranks, running totals and top-k that hold up when one group has a third of the rows.

A plain window sends a whole group to one task. Three ways around that are used here:

* ``top_n``: small n, so Spark cuts every group to n rows before the shuffle.
* ``hash_rank`` / ``lowest_hashes``: random order. A hash of the row id spreads a group over
  256 to 65,536 buckets; bucket sizes are counted first (a map-side count), their running sum
  gives each bucket its first rank, and only single buckets are ever sorted.
* ``rank_within`` / ``running_total``: any unique order. A range partitioning on the order
  itself cuts even a single huge group into even blocks; blocks are checkpointed because
  their borders come from a sample, and block totals are carried over as offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rubrica.session import durable

# Above this n Spark no longer prunes groups before the shuffle.
PRUNED_LIMIT = 1000


def _cell(keys: list[str]) -> Column:
    """Keys as one struct: it matches NULL fields too, and join and window share its shuffle."""
    return F.struct(*keys)


def _plain(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_n(
    df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "rank"
) -> DataFrame:
    """The first n rows of every group, with their 1-based rank. ``order`` must be total."""
    if n > PRUNED_LIMIT:
        return rank_within(df, keys, order, rank).filter(F.col(rank) <= n)
    w = W.partitionBy(*keys).orderBy(*_plain(order))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def hash_order(ids: list[str], seed: int) -> Column:
    """A reproducible random order: the md5 text of seed and row id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def _hashed(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """Rows with hash and bucket. A group gets at least 16 buckets per shuffle task, so a hot one
    spreads evenly; more would only lengthen the table of bucket sizes. Ranks do not depend on it.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = 2 if tasks <= 16 else 3 if tasks <= 256 else 4
    h = df.withColumn("_hash", hash_order(ids, seed))
    return h.withColumn("_bucket", F.substring("_hash", 1, chars))


def _bucket_offsets(hashed: DataFrame, keys: list[str]) -> DataFrame:
    sizes = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    cell = W.partitionBy(*keys)
    earlier = cell.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *keys,
        _cell([*keys, "_bucket"]).alias("_cell"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(cell).alias("_group_rows"),
    )


def hash_rank(
    df: DataFrame, keys: list[str], ids: list[str], seed: int,
    rank: str = "rank", group_rows: str = "group_rows",
) -> DataFrame:
    """Every row's exact 1-based rank in its group's hash order, and the group's size.

    ``ids`` must be unique within a group.
    """
    hashed = _hashed(df, ids, seed)
    offsets = _bucket_offsets(hashed, keys).select("_cell", "_before", "_group_rows")
    joined = hashed.withColumn("_cell", _cell([*keys, "_bucket"])).join(offsets, "_cell")
    bucket = W.partitionBy("_cell").orderBy("_hash", *ids)
    return joined.select(
        *df.columns,
        (F.col("_before") + F.row_number().over(bucket)).alias(rank),
        F.col("_group_rows").alias(group_rows),
    )


def lowest_hashes(
    df: DataFrame, keys: list[str], ids: list[str], quota: Column, seed: int,
    rank: str = "rank",
) -> DataFrame:
    """The first ``quota`` rows of every group in hash order: sampling without replacement.

    ``quota`` may use the keys and ``group_rows``. Rows of buckets past the quota are dropped
    in the join, before anything is sorted.
    """
    hashed = _hashed(df, ids, seed)
    offsets = _bucket_offsets(hashed, keys).withColumnRenamed("_group_rows", "group_rows")
    offsets = offsets.withColumn("_quota", quota.cast("bigint")).filter("_before < _quota")
    offsets = offsets.select("_cell", "_before", "_quota")
    joined = hashed.withColumn("_cell", _cell([*keys, "_bucket"])).join(offsets, "_cell")
    bucket = W.partitionBy("_cell").orderBy("_hash", *ids)
    ranked = joined.withColumn(rank, F.col("_before") + F.row_number().over(bucket))
    return ranked.filter(F.col(rank) <= F.col("_quota")).select(*df.columns, rank)


def ordered_blocks(
    df: DataFrame, order: list[Column | str], blocks: int | None = None
) -> DataFrame:
    """Rows cut into even blocks by a total order; ``_block`` ascends with the order."""
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *_plain(order))
    return durable(cut.withColumn("_block", F.spark_partition_id()))


def rank_within(
    df: DataFrame, keys: list[str], order: list[Column | str], rank: str = "rank",
    blocks: int | None = None,
) -> DataFrame:
    """Exact 1-based row number inside each group for any total order."""
    cut = ordered_blocks(df, [*keys, *order], blocks)
    sizes = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    cell = _cell([*keys, "_block"]).alias("_cell")
    offsets = sizes.select(
        cell, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    joined = cut.select("*", cell).join(offsets, "_cell")
    inside = W.partitionBy("_cell").orderBy(*_plain(order))
    return joined.select(
        *df.columns, (F.col("_before") + F.row_number().over(inside)).alias(rank)
    )


def running_total(
    df: DataFrame, value: str, order: list[Column | str], total: str = "running",
    blocks: int | None = None, before: str | None = None,
) -> DataFrame:
    """Running sum of the whole table in a total order; ``before`` names the sum without the row."""
    cut = ordered_blocks(df, order, blocks)
    sums = cut.groupBy("_block").agg(F.sum(value).alias("_sum"))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # One row per block, so the window and the broadcast are bounded by the block count.
    offsets = sums.select(
        "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before")
    )
    inside = (
        W.partitionBy("_block").orderBy(*_plain(order)).rowsBetween(W.unboundedPreceding, 0)
    )
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    sums = {total: inside} | ({before: earlier} if before else {})
    return cut.join(F.broadcast(offsets), "_block").select(
        *df.columns,
        *[
            (F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0.0))).alias(name)
            for name, w in sums.items()
        ],
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join a large side with hot keys to a few groups, one row per key.

    The group side is repeated once per salt, so a hot key is worked on by ``salts`` tasks. For a side that
    grows with the input see ``unique_join``.
    """
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    salted_right = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a large side with hot keys to a side that has one row per key and grows with the input.

    Merged, never broadcast: the size of compressed files says little about the rows in a driver's memory. A hot key
    makes a large partition of the left side, which the skew join of adaptive execution cuts up.
    """
    return left.join(right.hint("merge"), keys, how)
