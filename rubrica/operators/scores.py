"""Score tables. All input is one row per (model, prompt) unless a function says otherwise.

Rounding is to four decimals, ties to even, at the places the tables are written; sub-category
and layer tables then compute on the rounded cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rubrica.functions import scoring as S

DIMENSIONS = ("instruction_following", "visual_consistency", "detail_preservation")

# Spellings of the two compared layers.
LAYER_NAMES = {1: ("1", "layer1_gold"), 2: ("2", "layer2_proprietary")}
LAYER_COLUMNS = {1: "layer1_gold", 2: "layer2_proprietary"}


def leaderboard(scores: DataFrame, ci: DataFrame | None = None) -> DataFrame:
    """Full and covered means per model from one pass of conditional aggregates.

    ``ci`` is an optional (model, am_ci_lower, am_ci_upper, gm_ci_lower, gm_ci_upper) table.
    """
    covered = F.col("covered")
    aggs = [
        F.avg("score_am").alias("overall_am"),
        F.avg("score_gm").alias("overall_gm"),
        F.stddev_samp("score_am").alias("std_dev_am"),
        F.stddev_samp("score_gm").alias("std_dev_gm"),
        F.count("score_am").alias("n_total"),
        F.avg(F.when(covered, F.col("score_am"))).alias("overall_am_covered"),
        F.avg(F.when(covered, F.col("score_gm"))).alias("overall_gm_covered"),
        F.count(F.when(covered, F.col("score_am"))).alias("n_covered"),
    ]
    rounded = [
        "overall_am", "overall_gm", "std_dev_am", "std_dev_gm", "overall_am_covered",
        "overall_gm_covered",
    ]
    if "seed_std_dev_am" in scores.columns:
        aggs += [
            F.avg("seed_std_dev_am").alias("seed_std_dev_am"),
            F.avg("seed_std_dev_gm").alias("seed_std_dev_gm"),
        ]
        rounded += ["seed_std_dev_am", "seed_std_dev_gm"]
    out = (
        scores.groupBy("model")
        .agg(*aggs)
        .withColumn("_quality", F.coalesce("overall_gm_covered", "overall_gm"))
        .withColumn("coverage_rate", S.round4(F.col("n_covered") / F.greatest("n_total", F.lit(1))))
        .withColumns({c: S.round4(F.col(c)) for c in rounded})
    )
    if ci is not None:
        out = out.join(ci, "model", "left").fillna(
            0.0, [c for c in ci.columns if c != "model"]
        )
    return out.orderBy(F.desc_nulls_last("_quality"), "model").drop("_quality")


def legacy_aliases(board: DataFrame) -> DataFrame:
    """The older column names of a leaderboard, next to the new ones."""
    return _aliased(
        board,
        {
            "n_prompts": "n_total",
            "overall_score": "overall_am",
            "std_dev": "std_dev_am",
            "seed_std_dev": "seed_std_dev_am",
        },
    )


def _aliased(df: DataFrame, old_to_new: dict[str, str]) -> DataFrame:
    return df.withColumns(
        {old: F.col(new) for old, new in old_to_new.items() if new in df.columns}
    )


def breakdown(scores: DataFrame, by: str) -> DataFrame:
    """(model, ``by``) mean AM and GM, long form. Rows without a value of ``by`` drop out."""
    return (
        scores.filter(F.col(by).isNotNull())
        .groupBy("model", by)
        .agg(
            S.round4(F.avg("score_am")).alias("am"),
            S.round4(F.avg("score_gm")).alias("gm"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def per_subcategory(scores: DataFrame, categories: list[str]) -> DataFrame:
    """Wide form over a given category list; overall is the mean of the rounded cells."""
    cells = breakdown(scores, "sub_category")
    wide = cells.groupBy("model").agg(
        *[
            F.max(F.when(F.col("sub_category") == c, F.col(m))).alias(f"{c}__{m}")
            for m in ("am", "gm")
            for c in categories
        ],
        S.round4(S.mean_of_rounded(F.col("am"))).alias("overall_am"),
        S.round4(S.mean_of_rounded(F.col("gm"))).alias("overall_gm"),
    )
    return wide.orderBy(F.desc("overall_gm"), "model")


def layer_comparison(scores: DataFrame, all_models: bool = True) -> DataFrame:
    """Layer 1 against layer 2 per model, with the divergence of the rounded means.

    ``all_models`` keeps a model without any layer-1 or layer-2 row when no model has one,
    as a bare row.
    """
    layer = F.col("layer").cast("string")
    aggs = []
    for m in ("am", "gm"):
        for n, names in LAYER_NAMES.items():
            mean = F.avg(F.when(layer.isin(*names), F.col(f"score_{m}")))
            aggs.append(S.round4(mean).alias(f"{LAYER_COLUMNS[n]}_{m}"))
    compared = layer.isin(*[s for names in LAYER_NAMES.values() for s in names])
    out = scores.filter(F.col("layer").isNotNull()).groupBy("model").agg(
        *aggs, F.count_if(compared).alias("_compared")
    )
    if all_models:
        # One row per model by now, so the whole-table window is small.
        out = out.withColumn("_any", F.sum("_compared").over(W.partitionBy()))
        out = out.filter("_compared > 0 OR _any = 0").drop("_any")
    else:
        out = out.filter("_compared > 0")
    for m in ("am", "gm"):
        gap = F.col(f"layer1_gold_{m}") - F.col(f"layer2_proprietary_{m}")
        out = out.withColumn(f"divergence_{m}", S.round4(gap))
    return _aliased(
        out.drop("_compared"),
        {
            "layer1_gold": "layer1_gold_am",
            "layer2_proprietary": "layer2_proprietary_am",
            "divergence": "divergence_am",
        },
    )


def failure_analysis(atoms: DataFrame, by: tuple[str, ...] = ("q_type",)) -> DataFrame:
    """Share of "no" verdicts per model and question type, over raw per-seed atoms.

    Edit adds the dimension: ``by=("q_type", "dimension")``. A missing verdict is not a failure.
    """
    named = atoms.withColumns({c: _or_unknown(c) for c in by})
    failed = F.coalesce((F.col("answer") == "no").cast("int"), F.lit(0))
    return (
        named.groupBy("model", *by)
        .agg(S.round4(F.avg(failed)).alias("failure_rate"), F.count(F.lit(1)).alias("n"))
        .orderBy("model", F.desc("failure_rate"), *by)
    )


def _or_unknown(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))


def theme_breakdown(scores: DataFrame, themes: DataFrame) -> DataFrame:
    """Mean and spread per (model, theme); a prompt counts under each of its themes."""
    out = (
        scores.select("model", "prompt_id", "score_am", "score_gm")
        .join(themes.select("prompt_id", "theme"), "prompt_id", "inner")
        .groupBy("model", "theme")
        .agg(
            S.round4(F.avg("score_am")).alias("mean_score_am"),
            S.round4(F.stddev_samp("score_am")).alias("std_dev_am"),
            S.round4(F.avg("score_gm")).alias("mean_score_gm"),
            S.round4(F.stddev_samp("score_gm")).alias("std_dev_gm"),
            F.count(F.lit(1)).alias("n_prompts"),
        )
    )
    out = _aliased(out, {"mean_score": "mean_score_am", "std_dev": "std_dev_am"})
    return out.orderBy("model", F.desc("mean_score_gm"), "theme")


def covered_counts(scores: DataFrame) -> DataFrame:
    """Distinct covered prompts per model."""
    return (
        scores.filter("covered")
        .groupBy("model")
        .agg(F.count_distinct("prompt_id").alias("n_covered"))
    )


def prompt_total(prompts: DataFrame) -> Column:
    """Number of distinct prompts as a scalar subquery."""
    return prompts.agg(F.count_distinct("prompt_id").alias("n")).scalar()


def coverage_lookup(base: DataFrame, counts: DataFrame) -> DataFrame:
    """Covered count of each base row's model, 0 when it has none."""
    return base.join(counts, "model", "left").fillna(0, ["n_covered"])


def filter_rates(
    gen_log: DataFrame | None, counts: DataFrame | None = None, total: Column | None = None
) -> DataFrame:
    """Filtered and errored attempts per model next to its uncovered prompts.

    Models come from the log, or from the coverage counts when the log is empty.
    """
    if gen_log is None and counts is None:
        raise ValueError("need a generation log or coverage counts")
    zero = F.lit(0).cast("bigint")
    if gen_log is None:
        base = counts.select("model", zero.alias("filtered"), zero.alias("errored"), "n_covered")
    else:
        base = gen_log.groupBy("model").agg(
            F.count_if(F.col("status") == S.FILTERED).alias("filtered"),
            F.count_if(F.col("status") == S.ERROR).alias("errored"),
        )
        if counts is not None:
            # Models of the counts alone stay only when the log has no row at all.
            base = base.join(counts, "model", "full").filter(
                F.col("filtered").isNotNull() | ~gen_log.exists()
            )
            base = base.fillna(0, ["filtered", "errored", "n_covered"])
    if counts is not None and total is not None:
        base = base.withColumn("n_total", total)
        base = base.withColumn(
            "uncovered", F.greatest(F.col("n_total") - F.col("n_covered"), zero)
        ).withColumn(
            "uncovered_rate", S.round4(F.col("uncovered") / F.greatest("n_total", F.lit(1)))
        )
    else:
        base = base.withColumns(
            {"n_covered": zero, "n_total": zero, "uncovered": zero, "uncovered_rate": F.lit(0.0)}
        )
    attempts = F.greatest(F.col("filtered") + F.col("errored"), F.lit(1))
    rate = F.col("filtered") / F.when(F.col("n_total") > 0, F.col("n_total")).otherwise(attempts)
    return base.withColumn("filter_rate", S.round4(rate)).orderBy(
        F.desc("uncovered_rate"), "model"
    )


def filter_rates_edit(scores: DataFrame, total: Column) -> DataFrame:
    """Coverage per model over all prompts; models without a covered prompt stay in."""
    out = scores.groupBy("model").agg(
        F.count_distinct(F.when(F.col("covered"), F.col("prompt_id"))).alias("n_covered")
    )
    out = out.withColumn("n_total", total)
    out = out.withColumn("uncovered", F.col("n_total") - F.col("n_covered"))
    return out.withColumn(
        "uncovered_rate", S.round4(F.col("uncovered") / F.greatest("n_total", F.lit(1)))
    ).orderBy(F.desc("uncovered_rate"), "model")


def per_dimension(atoms: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """AM and GM over all atoms of a dimension, per model; NULL where a model has none.

    A plain mean over pooled atoms: not the mean of prompt scores.
    """
    p = S.atom_probability(F.col("answer"), F.col("probability"))
    log_p = F.ln(F.greatest(p, S.floor_probability()))
    aggs = []
    for d in dimensions:
        of_dim = F.col("dimension") == d
        aggs.append(S.round4(F.avg(F.when(of_dim, p))).alias(f"{d}_am"))
        aggs.append(S.round4(F.exp(F.avg(F.when(of_dim, log_p)))).alias(f"{d}_gm"))
    return (
        atoms.groupBy("model").agg(*aggs).orderBy(F.desc_nulls_last(f"{dimensions[0]}_gm"), "model")
    )


def summary_stats(scores: DataFrame) -> DataFrame:
    """One row: sizes and overall means of the merged score table."""
    return scores.agg(
        F.count_distinct("model").alias("n_models"),
        F.count_distinct("prompt_id").alias("n_prompts_judged"),
        F.count(F.lit(1)).alias("n_total_judgments"),
        S.round4(F.avg("score_am")).alias("mean_score_am_overall"),
        S.round4(F.avg("score_gm")).alias("mean_score_gm_overall"),
    )


def wedge_candidates(layers: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Models whose layer gap under GM passes the threshold."""
    return layers.filter(F.col("divergence_gm") > threshold)


def weak_models(cells: DataFrame, threshold: float = 0.85) -> DataFrame:
    """How many models have a sub-category GM below the threshold."""
    per_model = cells.groupBy("model").agg(F.bool_or(F.col("gm") < threshold).alias("weak"))
    return per_model.agg(
        F.count_if("weak").alias("n_weak"), F.count(F.lit(1)).alias("n_models")
    )


def extreme_cells(cells: DataFrame) -> DataFrame:
    """The lowest and the highest (model, sub_category) cell under GM."""
    scored = cells.filter(F.col("gm").isNotNull())
    name = F.struct("model", "sub_category")
    low = F.min(F.struct("gm", "model", "sub_category"))
    high = F.max_by(name, F.struct(F.col("gm"), name))
    return scored.agg(low.alias("w"), high.alias("b"), F.max("gm").alias("g")).select(
        F.col("w.model").alias("worst_model"),
        F.col("w.sub_category").alias("worst_sub_category"),
        F.col("w.gm").alias("worst_gm"),
        F.col("b.model").alias("best_model"),
        F.col("b.sub_category").alias("best_sub_category"),
        F.col("g").alias("best_gm"),
    )
