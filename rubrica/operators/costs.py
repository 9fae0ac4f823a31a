"""Costs: running ledger against a cap, totals, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rubrica.operators.ranking import ordered_blocks

ALERT_AT = 0.8


def cost_ledger(
    costs: DataFrame, cap: float, order: list[Column | str], alert_at: float = ALERT_AT,
    start: float = 0.0, alerted: bool = False,
) -> DataFrame:
    """Running total in arrival order, with the cap state of every row.

    ``alert`` is true on the one row that first brings the total to the alert share;
    ``may_start`` says whether the total before the row was under the cap. A ledger that goes on from
    an earlier one starts with its total and whether it has alerted.

    Rows are cut into blocks of the order once. Totals of the blocks say in which of them the line can
    first be reached (usually one), and only those are looked through for the alert.
    """
    line = cap * alert_at
    cut = ordered_blocks(costs, order)
    sums = cut.groupBy("_block").agg(
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.sum(F.greatest("amount", F.lit(0.0))), F.lit(0.0)).alias("_most"),
    )
    # One row per block, so windows and broadcast are bounded by the block count.
    every = W.orderBy("_block")
    before = F.coalesce(F.sum("_sum").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) + start
    blocks = sums.withColumn("_before", before)
    sure = F.min(F.when(F.col("_before") + F.col("_sum") >= line, F.col("_block"))).over(W.orderBy(F.lit(0)).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing))
    can = (F.col("_before") + F.col("_most") >= line) & (F.col("_block") <= F.coalesce(sure, F.col("_block")))
    blocks = blocks.withColumn("_can", can & F.lit(not alerted)).select("_block", "_before", "_can")

    inside = W.partitionBy("_block").orderBy(*[F.col(c) if isinstance(c, str) else c for c in order])

    def totals(some: DataFrame) -> DataFrame:
        def through(last: int) -> Column:
            held = F.sum("amount").over(inside.rowsBetween(W.unboundedPreceding, last))
            return F.col("_before") + F.coalesce(held, F.lit(0.0))

        joined = cut.join(F.broadcast(some), "_block")
        return joined.withColumns({"running_total": through(0), "_earlier": through(-1)})

    place = F.struct(*order)
    first = totals(blocks.filter("_can")).filter(F.col("running_total") >= line).agg(F.min(place)).scalar()
    return totals(blocks).select(
        *costs.columns,
        "running_total",
        F.coalesce(place == first, F.lit(False)).alias("alert"),
        (F.col("running_total") < cap).alias("under_cap"),
        (F.col("_earlier") < cap).alias("may_start"),
    )


def cost_summary(costs: DataFrame) -> DataFrame:
    """Total, per model and per stage in one table; NULL marks the column not grouped by.

    Rows are summed per (model, stage) first, so the grouping sets expand only that small table.
    """
    named = costs.select(
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce("stage", F.lit("unknown")).alias("stage"),
        "amount",
    )
    cells = named.groupBy("model", "stage").agg(F.sum("amount").alias("amount"))
    return (
        cells.groupingSets([[], [F.col("model")], [F.col("stage")]], F.col("model"), F.col("stage"))
        .agg(F.bround(F.sum("amount"), 4).alias("total_usd"))
        .select("model", "stage", "total_usd")
    )


def cap_check(costs: DataFrame, cap: float) -> DataFrame:
    """One row: the total, the cap and whether the total is still under it."""
    total = F.coalesce(F.sum("amount"), F.lit(0.0))
    return costs.agg(F.bround(total, 4).alias("total_usd"), (total < cap).alias("under_cap")).withColumn(
        "cap_usd", F.lit(cap)
    )


def estimate_cost(models: DataFrame, prompts: DataFrame, seeds: int = 1) -> DataFrame:
    """Planned items and cost of running the given models on the given prompts."""
    n_prompts = prompts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return models.agg(
        F.count(F.lit(1)).alias("n_models"), F.sum("cost_per_unit").alias("price")
    ).select(
        "n_models",
        n_prompts.alias("n_prompts"),
        (F.col("n_models") * n_prompts * seeds).alias("n_items"),
        F.bround(F.coalesce("price", F.lit(0.0)) * n_prompts * seeds, 2).alias("estimated_usd"),
    )
