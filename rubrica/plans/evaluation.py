"""Evaluation runs: judgment, prompt and log folders in, score tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rubrica.functions import scoring as S
from rubrica.operators import judgments as J
from rubrica.operators import scores as A
from rubrica.operators.bootstrap import leaderboard_ci
from rubrica.session import stored
from rubrica.sources import readers, writers


def image_tables(
    judgments: DataFrame, prompts: DataFrame, gen_log: DataFrame | None = None,
    themes: DataFrame | None = None, categories: list[str] | None = None, n_boot: int = 10_000,
    tie: str | None = None, materialise: bool = False,
) -> dict[str, DataFrame]:
    """All score tables of an image run from raw judgments.

    Failure rates use the raw per-seed answers, everything else one row per (model, prompt). With
    ``materialise`` the judgments are read once, now: resolved and collapsed rows go to the shared folder, every
    table reads those, and the figures of the summary are observed while the collapsed rows are written. Without it
    nothing runs here, and each table that is asked for reads the judgments itself.
    """
    resolved = J.resolve_scores(judgments)
    summary = None
    if materialise:
        needed = ["model", "prompt_id", "seed", "score_am", "score_gm", "judge_error", "answers", *([tie] if tie else [])]
        resolved = stored(resolved.select(*needed), "resolved")
        collapsed, summary = _observed(J.collapse_seeds(resolved, tie=tie).drop("answers"), "collapsed")
    else:
        collapsed = J.collapse_seeds(resolved, tie=tie).drop("answers")
    scores = J.attach_prompts(collapsed, prompts)
    counts = A.covered_counts(collapsed)
    tables = {
        "leaderboard": A.legacy_aliases(
            A.leaderboard(collapsed, leaderboard_ci(collapsed, n_boot) if n_boot else None)
        ),
        "per_subcategory": _subcategories(scores, categories),
        "layer_comparison": A.layer_comparison(scores),
        "failure_analysis": A.failure_analysis(J.explode_atoms(resolved, "model")),
        "filter_rates": A.filter_rates(gen_log, counts, A.prompt_total(prompts)),
        "summary": A.summary_stats(collapsed) if summary is None else summary,
    }
    if themes is not None:
        tables["theme_breakdown"] = A.theme_breakdown(collapsed, themes)
    return tables


def edit_tables(
    judgments: DataFrame, prompts: DataFrame, categories: list[str] | None = None,
    n_boot: int = 10_000, materialise: bool = False,
) -> dict[str, DataFrame]:
    """All score tables of an edit run; judgments are taken as they are, without seeds.

    ``materialise`` reads the judgments once, as in ``image_tables``.
    """
    rows = J.as_scores(J.resolve_scores_edit(judgments))
    summary = None
    if materialise:
        needed = ["model", "prompt_id", "score_am", "score_gm", "judge_error", "covered", "answers"]
        rows, summary = _observed(rows.select(*needed), "resolved")
    plain = rows.drop("answers")
    scores = J.attach_prompts(plain, prompts)
    atoms = J.explode_atoms(rows, "model")
    return {
        "leaderboard": A.leaderboard(plain, leaderboard_ci(plain, n_boot) if n_boot else None),
        "per_subcategory": _subcategories(scores, categories),
        "per_dimension": A.per_dimension(atoms),
        "layer_comparison": A.layer_comparison(scores),
        "failure_analysis": A.failure_analysis(atoms, ("q_type", "dimension")),
        "filter_rates": A.filter_rates_edit(plain, A.prompt_total(prompts)),
        "summary": A.summary_stats(plain) if summary is None else summary,
    }


def _observed(scores: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Score rows in the shared folder, and the summary of the run from figures observed while they were written.

    Only the distinct models and prompts need the written rows again: two columns of them.
    """
    seen = Observation(name)
    figures = [
        F.count(F.lit(1)).alias("n_total_judgments"),
        S.round4(F.avg("score_am")).alias("mean_score_am_overall"),
        S.round4(F.avg("score_gm")).alias("mean_score_gm_overall"),
    ]
    written = stored(scores.observe(seen, *figures), name)
    got = seen.get
    kinds = {"n_total_judgments": "bigint"}
    summary = written.agg(
        F.count_distinct("model").alias("n_models"), F.count_distinct("prompt_id").alias("n_prompts_judged")
    ).select("*", *[F.lit(v).cast(kinds.get(k, "double")).alias(k) for k, v in got.items()])
    return written, summary


def _subcategories(scores: DataFrame, categories: list[str] | None) -> DataFrame:
    """Wide over a known category list, long without one: columns then never depend on data."""
    if categories is None:
        return A.breakdown(scores, "sub_category")
    return A.per_subcategory(scores, categories)


def summary_document(tables: dict[str, DataFrame]) -> DataFrame:
    """The summary row with the top three models and the layer gaps or dimensions as JSON."""
    board = tables["leaderboard"]
    quality = F.coalesce("overall_gm_covered", "overall_gm")
    top = board.orderBy(F.desc(quality), "model").limit(3)
    extra = {"leaderboard_top3": (top, [-quality, "model"])}
    if "per_dimension" in tables:
        extra["dimensions"] = (tables["per_dimension"], ["model"])
    else:
        wedges = A.wedge_candidates(tables["layer_comparison"])
        extra["layer_wedge_candidates_gm"] = (wedges, ["model"])
    return tables["summary"].select(
        "*", *[writers.json_list(df, order).alias(name) for name, (df, order) in extra.items()]
    )


def run_image_evaluation(
    spark: SparkSession, judgments_dir: str, prompts_path: str, log_path: str, themes_path: str,
    out_dir: str, categories: list[str] | None = None, n_boot: int = 10_000, csv: bool = False,
) -> list[str]:
    """Read the folders of a run and write its score tables and summary."""
    themes = readers.read_theme_map(spark, themes_path)
    tables = image_tables(
        readers.read_judgments(spark, judgments_dir),
        readers.read_prompts(spark, prompts_path),
        readers.read_generation_log(spark, log_path),
        themes, categories, n_boot, materialise=True,
    )
    return _write(tables, out_dir, csv)


def run_edit_evaluation(
    spark: SparkSession, judgments_dir: str, prompt_paths: list[str], out_dir: str,
    categories: list[str] | None = None, n_boot: int = 10_000, csv: bool = False,
) -> list[str]:
    tables = edit_tables(
        readers.read_judgments(spark, judgments_dir, "edit"),
        readers.read_prompts(spark, *prompt_paths, kind="edit"),
        categories, n_boot, materialise=True,
    )
    return _write(tables, out_dir, csv)


def _write(tables: dict[str, DataFrame], out_dir: str, csv: bool) -> list[str]:
    document = summary_document(tables)
    written = writers.write_score_tables(
        {k: v for k, v in tables.items() if k != "summary"}, out_dir, csv
    )
    target = f"{out_dir.rstrip('/')}/summary_stats"
    writers.write_summary(document, target)
    return [*written, target]
