"""Tables behind the reports: ranks, display text, examples, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from rubrica.functions import scoring as S
from rubrica.operators.ranking import top_n

DIVERGENCE = 0.1


def order_by_quality(board: DataFrame) -> DataFrame:
    return board.orderBy(F.desc_nulls_last("overall_gm_covered"), F.desc("overall_gm"), "model")


def model_rank(board: DataFrame, by: str = "overall_gm_covered") -> DataFrame:
    """1-based rank of the one-row-per-model table."""
    return board.withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc_nulls_last(by), "model"))
    )


def leaderboard_display(board: DataFrame) -> DataFrame:
    """Display text: covered scores (full ones where nothing is covered) and n/m coverage."""
    am = F.coalesce("overall_am_covered", "overall_am")
    gm = F.coalesce("overall_gm_covered", "overall_gm")
    return board.orderBy(F.desc(gm), "model").select(
        "model",
        S.display(am).alias("am_covered"),
        S.display(gm).alias("gm_covered"),
        S.display(F.col("overall_am")).alias("am_full"),
        S.display(F.col("overall_gm")).alias("gm_full"),
        F.concat_ws("/", F.col("n_covered"), F.col("n_total")).alias("coverage"),
    )


def top_k(df: DataFrame, order: list, k: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(k)


def worst_examples(judgments: DataFrame, prompts: DataFrame, tie: list[str], n: int = 5) -> DataFrame:
    """Each model's n lowest judgments under GM among those with an image, with prompt text.

    ``judgments`` are resolved. Prompts join after the cut, to models x n rows.
    """
    shown = judgments.filter(F.coalesce("image_path", F.lit("")) != "").select(
        "model", "prompt_id", "seed", "image_path", "score", "score_am", "score_gm", *tie
    )
    worst = top_n(shown, ["model"], ["score_gm", "prompt_id", "seed", *tie], n)
    text = prompts.select("prompt_id", "prompt_text", "sub_category")
    return worst.join(text, "prompt_id", "left").fillna("", ["prompt_text", "sub_category"])


def failure_examples(
    judgments: DataFrame, prompts: DataFrame, tie: list[str], n: int = 3
) -> DataFrame:
    """Each model's n worst covered prompts, with the weakest atom when that atom failed.

    The worst judgment of a prompt is a minimum, so repeats collapse before any sort.
    """
    p = F.transform("answers", lambda a: S.display(a["probability"], 2).cast("double"))
    known = F.filter(p, lambda x: x.isNotNull())
    rows = judgments.filter(F.coalesce(F.col("judge_error"), F.lit("")) == "").filter(
        F.size("answers") > 0
    )
    # The first atom wins among equals; atoms without a probability come last.
    at = F.array_position(p, F.array_min(known)).cast("int")
    weakest = F.coalesce(F.try_element_at("answers", at), F.get("answers", F.lit(0)))
    order = F.struct("score_gm", "seed", *tie)
    first = (
        rows.select(
            "model", "prompt_id", order.alias("_order"), "score_am", "score_gm",
            weakest["question"].alias("question"), weakest["probability"].alias("p"),
        )
        .groupBy("model", "prompt_id")
        .agg(F.min_by(F.struct("score_am", "score_gm", "question", "p"), "_order").alias("w"))
        .select("model", "prompt_id", "w.*")
    )
    worst = top_n(first, ["model"], ["score_gm", "prompt_id"], n)
    failed = ~F.coalesce(F.col("p") >= S.PASS_MARK, F.lit(False))
    shown = F.coalesce(S.display(F.col("p"), 2), F.lit("?"))
    text = prompts.select("prompt_id", "prompt_text", "sub_category")
    return (
        worst.join(text, "prompt_id", "left")
        .fillna({"prompt_text": "", "sub_category": "unknown"})
        .select(
            "model",
            "rank",
            "prompt_id",
            "sub_category",
            "prompt_text",
            S.display(F.col("score_gm"), 2).alias("gm"),
            S.display(F.col("score_am"), 2).alias("am"),
            F.when(
                failed,
                F.concat(
                    F.lit('Weakest atom: "'), F.coalesce("question", F.lit("")),
                    F.lit('" at p='), shown, F.lit("."),
                ),
            ).otherwise("").alias("diagnosis"),
        )
    )


def ranked_atoms(answers, k: int = 7):
    """First k answers of a record by probability, highest first; equal ones keep their order."""
    paired = F.transform(
        answers,
        lambda a, i: F.struct(
            (-F.coalesce(a["probability"], F.lit(0.0))).alias("o"), i.alias("i"), a.alias("a")
        ),
    )
    ranked = F.transform(F.slice(F.array_sort(paired), 1, k), lambda x: x["a"])
    return F.transform(
        ranked,
        lambda a: F.struct(
            a["q_id"].alias("q_id"),
            a["question"].alias("question"),
            a["probability"].alias("probability"),
            F.coalesce(
                a["probability"] >= S.PASS_MARK,
                F.coalesce(a["answer"] == "yes", F.lit(False)),
            ).alias("passed"),
        ),
    )


def cell_extremes(cells: DataFrame) -> DataFrame:
    """Marks the best and worst model of each sub-category."""
    w = W.partitionBy("sub_category")
    mark = (
        F.when(F.col("gm") == F.max("gm").over(w), "top")
        .when(F.col("gm") == F.min("gm").over(w), "low")
        .otherwise("mid")
    )
    return cells.withColumn("cell", mark)


def layer_narrative(layers: DataFrame) -> DataFrame:
    """What the layer gap says about a model; NULL when a layer is missing."""
    gap = F.col("divergence_gm")
    return layers.withColumn(
        "narrative",
        F.when(gap.isNull(), None)
        .when(gap > DIVERGENCE, "saturated")
        .when(gap < -DIVERGENCE, "reversed")
        .otherwise("consistent"),
    )


def compare_pipelines(boards: dict[str, DataFrame]) -> DataFrame:
    """Per pipeline: models, mean GM, best model and the quartiles of a box plot."""
    union = None
    for name, board in boards.items():
        part = board.select(F.lit(name).alias("pipeline"), "model", "overall_gm")
        union = part if union is None else union.unionByName(part)
    q = F.percentile("overall_gm", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return union.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.bround(S.mean_of_rounded(F.col("overall_gm")), 3).alias("mean_gm"),
        F.max(F.struct("overall_gm", "model"))["model"].alias("best_model"),
        *[
            q[i].alias(name)
            for i, name in enumerate(["gm_min", "gm_q1", "gm_median", "gm_q3", "gm_max"])
        ],
    )
