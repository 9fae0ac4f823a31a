"""Weighted question scores of the reasoning benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.operators.ranking import unique_join

ITEM = ("model", "category", "subcategory", "source_id")

# Category order of the printed table.
CATEGORIES = ["causal", "numerical", "logical", "compositional", "commonsense", "concept_mixing"]


def answered_questions(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """Questions of an item with the score its reply gives them, NULL when it gives none.

    ``replies`` has one row per (model, item) with ``scores`` as a map by question id; a reply that
    was not parsed (NULL) leaves its item out. Ids are unique inside one sub-category only.
    """
    parsed = replies.filter("scores IS NOT NULL")
    joined = parsed.join(questions, ["category", "subcategory", "source_id"], "inner")
    return joined.withColumn("score", F.try_element_at("scores", F.col("id"))).drop("scores")


def weighted_score(rows: DataFrame, keys: tuple[str, ...] = ITEM) -> DataFrame:
    """Sum of w*s over sum of w, over the questions that were answered; 0 without any weight."""
    answered = F.col("score").isNotNull()
    weight = F.sum(F.when(answered, F.col("weight")))
    score = F.sum(F.col("weight") * F.col("score")) / F.when(weight > 0, weight)
    return rows.groupBy(*keys).agg(
        S.exact_round(F.coalesce(score, F.lit(0.0)), 2).alias("score"),
        F.count_if(answered).alias("n_answered"),
    )


def category_scores(items: DataFrame, group: str = "category") -> DataFrame:
    return items.groupBy("model", group).agg(
        S.exact_round(S.mean_of_rounded(F.col("score"), 2), 2).alias("avg"), F.count(F.lit(1)).alias("n")
    )


def category_table(scores: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Wide print form; a model without a category shows '---'."""
    names = categories or CATEGORIES
    return scores.groupBy("model").agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("category") == c, S.display(F.col("avg"), 2))),
                F.lit("---"),
            ).alias(c)
            for c in names
        ]
    )


def text_key_join(prompts: DataFrame, known: DataFrame, images: DataFrame) -> DataFrame:
    """Source prompts matched by text to known ``R2I_`` prompts that have an image.

    Of several known prompts with the same text the last id is used.
    """
    ids = (
        known.filter(F.col("prompt_id").startswith("R2I_"))
        .groupBy("prompt_text")
        .agg(F.max("prompt_id").alias("prompt_id"))
    )
    return unique_join(prompts, ids, ["prompt_text"]).join(
        images.select("prompt_id").distinct(), "prompt_id", "left_semi"
    )
