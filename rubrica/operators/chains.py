"""Multi-turn chains: the final turn and where a chain broke. A chain is (model, prompt_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.functions import text as X
from rubrica.operators.ranking import unique_join

CHAIN = ["model", "prompt_id"]


def final_turn(log: DataFrame, order: Column) -> DataFrame:
    """Per chain the successful record of the highest turn (the first one logged on a tie) and
    the source path of turn 1 (the last one logged).

    ``order`` is the log order, as a number. Both picks are aggregates of fixed-size buffers.
    """
    turn = F.coalesce(F.col("turn"), F.lit(1))
    done = log.filter(F.col("status") == S.SUCCESS)
    return done.groupBy(*CHAIN).agg(
        F.max(turn).alias("turn"),
        F.max_by("image_path", F.struct(turn, -order)).alias("image_path"),
        F.max_by("source_image_path", F.when(turn == 1, order)).alias("source_image_path"),
    )


def chain_status(log: DataFrame) -> DataFrame:
    """Every turn with its source and whether it ran.

    A chain stops at its first turn that did not succeed: later turns are ``after_break``. The
    source of turn n is the output of turn n-1. Previous turns come from an equi-join on
    (chain, turn), so a very long chain is not pulled into one window.
    """
    broken = (
        log.filter(F.col("status") != S.SUCCESS)
        .groupBy(*CHAIN)
        .agg(F.min("turn").alias("break_turn"))
    )
    previous = log.groupBy(*CHAIN, (F.col("turn") + 1).alias("turn")).agg(
        F.max("image_path").alias("_output")
    )
    with_source = log.join(previous, [*CHAIN, "turn"], "left")
    flagged = unique_join(with_source, broken, CHAIN, "left")
    return flagged.withColumn(
        "source_image_path", F.when(F.col("turn") == 1, F.col("source_image_path")).otherwise(F.col("_output"))
    ).withColumn(
        "after_break", F.coalesce(F.col("turn") > F.col("break_turn"), F.lit(False))
    ).drop("_output")


def chain_completion(log: DataFrame) -> DataFrame:
    """One row per chain: turns logged, the breaking turn, complete or not."""
    failed = F.col("status") != S.SUCCESS
    return log.groupBy(*CHAIN).agg(
        F.max("turn").alias("n_turns"),
        F.min(F.when(failed, F.col("turn"))).alias("break_turn"),
        (F.count_if(failed) == 0).alias("complete"),
    )


def edit_instructions(prompts: DataFrame) -> DataFrame:
    """The instruction to judge by: the turns joined by arrows when there is a list of them."""
    return prompts.withColumn(
        "instruction", X.join_turns(F.col("turns"), F.coalesce("edit_instruction", F.lit("")))
    )
