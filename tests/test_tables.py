"""Score tables on small fixtures, with values retyped from published runs."""

import json

import pytest
from pyspark.sql import functions as F

from rubrica.operators import judgments as J
from rubrica.operators import scores as A
from rubrica.operators import reporting as R
from rubrica.operators import themes as T
from rubrica.plans.evaluation import run_edit_evaluation, run_image_evaluation
from rubrica.sources import readers


@pytest.fixture(scope="module")
def run_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    judged = root / "judgments"
    judged.mkdir()
    rows = {
        "model_a": [("L1_NUM_001", 0.9, "yes"), ("L2_NUM_001", 0.3, "no")],
        "model_b": [("L1_NUM_001", 0.5, "no"), ("L2_NUM_001", 0.5, "yes")],
    }
    for model, records in rows.items():
        lines = [
            json.dumps(
                {
                    "prompt_id": pid, "model": "ignored", "image_path": "x.png", "score": score,
                    "answers": [{"q_id": "q1", "question": "?", "type": "presence", "answer": a}],
                }
            )
            for pid, score, a in records
        ]
        (judged / f"{model}.jsonl").write_text("\n".join(lines) + "\n\n")
    (judged / "notes.txt").write_text("not a judgment")
    prompts = [
        {
            "prompt_id": pid, "layer": layer, "sub_category": "numeracy", "difficulty": "auto",
            "prompt_text": text, "atomic_questions": [{"q_id": "q1", "question": "?", "type": "presence"}],
        }
        for pid, layer, text in [("L1_NUM_001", 1, "three cats"), ("L2_NUM_001", 2, "seven bottles")]
    ]
    (root / "prompts.json").write_text(json.dumps(prompts, indent=1))
    themes = {"L1_NUM_001": ["animals", "counting"], "L2_NUM_001": ["objects", "counting"]}
    (root / "themes.json").write_text(json.dumps(themes))
    return root


def test_legacy_run_end_to_end(spark, run_dir):
    out = str(run_dir / "scores")
    written = run_image_evaluation(
        spark, str(run_dir / "judgments"), str(run_dir / "prompts.json"), str(run_dir / "absent.jsonl"),
        str(run_dir / "themes.json"), out, categories=["numeracy"], n_boot=200, csv=True,
    )
    assert len(written) == 7
    board = spark.read.parquet(f"{out}/leaderboard").collect()
    assert {r.model for r in board} == {"model_a", "model_b"}
    first = max(board, key=lambda r: r.overall_gm_covered)
    assert first.model == "model_a" and first.n_prompts == 2 and first.overall_score == 0.6
    assert first.am_ci_lower <= 0.6 <= first.am_ci_upper
    layers = {r.model: r for r in spark.read.parquet(f"{out}/layer_comparison").collect()}
    a = layers["model_a"]
    assert (a.layer1_gold_am, a.layer2_proprietary_am, a.divergence) == (0.9, 0.3, 0.6)
    summary = spark.read.json(f"{out}/summary_stats").first()
    assert (summary.n_models, summary.n_prompts_judged, summary.n_total_judgments) == (2, 2, 4)
    assert json.loads(summary.layer_wedge_candidates_gm)[0]["model"] == "model_a"
    rates = spark.read.parquet(f"{out}/filter_rates").collect()
    assert {(r.model, r.filtered, r.uncovered) for r in rates} == {("model_a", 0, 0), ("model_b", 0, 0)}
    themes = {(r.model, r.theme): r for r in spark.read.parquet(f"{out}/theme_breakdown").collect()}
    assert themes["model_a", "counting"].n_prompts == 2
    assert themes["model_a", "animals"].std_dev_am is None


def test_edit_run_with_missing_files(spark, tmp_path):
    written = run_edit_evaluation(
        spark, str(tmp_path / "none"), [str(tmp_path / "none.json")], str(tmp_path / "out"), n_boot=50
    )
    assert len(written) == 7
    assert spark.read.parquet(str(tmp_path / "out/leaderboard")).count() == 0


def _scores(spark, rows):
    return spark.createDataFrame(
        rows, "model string, prompt_id string, score_am double, score_gm double, covered boolean, layer int, sub_category string"
    )


def test_leaderboard_views(spark):
    rows = [("a", f"p{i}", 0.8, 0.6, True, 1, "x") for i in range(11)]
    rows += [("a", f"q{i}", 0.0, 0.0, False, 1, "x") for i in range(4)]
    rows += [("z", "p0", 0.0, 0.0, False, 1, "x")]
    got = {r.model: r for r in A.leaderboard(_scores(spark, rows)).collect()}
    a, z = got["a"], got["z"]
    assert (a.n_total, a.n_covered, a.coverage_rate) == (15, 11, 0.7333)
    assert a.overall_gm == 0.44 and a.overall_gm_covered == 0.6
    assert (z.overall_gm_covered, z.std_dev_am, z.coverage_rate) == (None, None, 0.0)
    shown = {r.model: r for r in R.leaderboard_display(A.leaderboard(_scores(spark, rows))).collect()}
    assert shown["a"].coverage == "11/15" and shown["z"].gm_covered == "0.000"


def test_published_subcategory_row(spark):
    """Cells of one published model row give its published overall values."""
    cells = {
        "adversarial_binding": (0.996, 0.9958), "causal_physics": (0.9, 0.618), "comparison_occlusion": (1.0, 1.0),
        "constraint_trading": (1.0, 1.0), "count_binding": (0.9992, 0.9992), "multi_type_counting": (0.8647, 0.658),
        "negation": (0.8, 0.1353), "order_to_space": (1.0, 1.0), "rare_combination": (1.0, 1.0),
    }
    rows = [("gpt_image_2", c, am, gm, True, 1, c) for c, (am, gm) in cells.items()]
    wide = A.per_subcategory(_scores(spark, rows), [*cells, "spatial_conflict"]).first()
    assert (wide.overall_am, wide.overall_gm) == (0.9511, 0.8229)
    assert wide.spatial_conflict__am is None and wide.negation__gm == 0.1353


def test_null_keys_drop_from_breakdowns_only(spark):
    rows = [("m", "a", 1.0, 1.0, True, 1, "x"), ("m", "b", 0.0, 0.0, True, None, None)]
    scores = _scores(spark, rows)
    assert [tuple(r) for r in A.breakdown(scores, "sub_category").collect()] == [("m", "x", 1.0, 1.0, 1)]
    assert A.leaderboard(scores).first().n_total == 2
    assert A.layer_comparison(scores).first().layer1_gold_am == 1.0


def test_layer_fallback_keeps_bare_models(spark):
    scores = _scores(spark, [("m", "a", 1.0, 1.0, True, 3, "x")])
    row = A.layer_comparison(scores).first()
    assert row.model == "m" and row.layer1_gold_am is None
    mixed = _scores(spark, [("m", "a", 1.0, 1.0, True, 3, "x"), ("n", "a", 1.0, 1.0, True, 1, "x")])
    assert [r.model for r in A.layer_comparison(mixed).collect()] == ["n"]


def test_failure_analysis_counts_missing_verdicts_as_passed(spark):
    atoms = spark.createDataFrame(
        [("m", "presence", "no"), ("m", "presence", None), ("m", "", "no"), ("m", None, "yes"), ("m", "presence", "yes")],
        "model string, q_type string, answer string",
    )
    got = {r.q_type: (r.failure_rate, r.n) for r in A.failure_analysis(atoms).collect()}
    assert got == {"presence": (0.3333, 3), "unknown": (0.5, 2)}


def test_filter_rates(spark):
    log = spark.createDataFrame(
        [("flux", "FILTERED")] * 2 + [("flux", "ERROR")] * 4 + [("flux", "SUCCESS")] * 11 + [("new", "SUCCESS")],
        "model string, status string",
    )
    counts = spark.createDataFrame([("flux", 11), ("only_counts", 5)], "model string, n_covered bigint")
    got = {r.model: r for r in A.filter_rates(log, counts, F.lit(622)).collect()}
    assert set(got) == {"flux", "new"}
    flux = got["flux"]
    assert (flux.filtered, flux.errored, flux.uncovered, flux.uncovered_rate, flux.filter_rate) == (2, 4, 611, 0.9823, 0.0032)
    assert got["new"].n_covered == 0
    empty = log.filter("false")
    assert {r.model for r in A.filter_rates(empty, counts, F.lit(622)).collect()} == {"flux", "only_counts"}
    alone = {r.model: r.filter_rate for r in A.filter_rates(log).collect()}
    assert alone == {"flux": 0.3333, "new": 0.0}


def test_per_dimension_pools_atoms(spark):
    atoms = spark.createDataFrame(
        [("m", "instruction_following", "yes", 0.5), ("m", "instruction_following", "no", None), ("m", "other", "yes", 1.0)],
        "model string, dimension string, answer string, probability double",
    )
    row = A.per_dimension(atoms).first()
    assert row.instruction_following_am == 0.25 and row.instruction_following_gm == pytest.approx(0.0048, abs=1e-4)
    assert row.visual_consistency_am is None


def test_weak_models_and_extremes(spark):
    cells = spark.createDataFrame(
        [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.95), ("b", "y", None)], "model string, sub_category string, gm double"
    )
    assert tuple(A.weak_models(cells).first()) == (1, 2)
    got = A.extreme_cells(cells).first()
    assert (got.worst_model, got.worst_sub_category, got.best_model, got.best_gm) == ("a", "y", "b", 0.95)
    marks = {(r.model, r.sub_category): r.cell for r in R.cell_extremes(cells).collect()}
    assert marks["b", "x"] == "top" and marks["a", "x"] == "low"


def test_theme_variance_needs_every_model(spark):
    rows = [("a", "t", 0.9, 20), ("b", "t", 0.1, 20), ("a", "u", 0.9, 20), ("a", "v", 0.5, 3), ("b", "v", 0.5, 20)]
    df = spark.createDataFrame(rows, "model string, theme string, mean_score_gm double, n_prompts bigint")
    assert [r.theme for r in T.theme_variance(df).collect()] == ["t"]
    sides = {(r.model, r.side, r.theme) for r in T.theme_extremes(df, k=1).collect()}
    assert ("a", "top", "t") in sides and ("a", "bottom", "u") in sides


def test_broken_theme_map_reads_empty(spark, tmp_path):
    (tmp_path / "bad.json").write_text("[1, 2")
    assert readers.read_theme_map(spark, str(tmp_path / "bad.json")).count() == 0
    assert readers.read_theme_map(spark, str(tmp_path / "none.json")).count() == 0


def test_judge_errors_uncover(spark):
    rows = [("j", None, "boom", None), ("j", [("Yes", -0.1)], None, None)]
    raw = spark.createDataFrame(
        rows, "judgment string, top_logprobs array<struct<token:string,logprob:double>>, error string, x string"
    )
    out = J.judgment_scores(J.judge_atoms(raw), ("judgment",)).first()
    assert (out.n_atoms, out.n_failed_atoms) == (2, 1)
    assert out.score_am == pytest.approx(0.4524, abs=1e-4)


def test_file_stem_and_quoted_probability(spark, tmp_path):
    from rubrica.sources.readers import read_judgments

    record = '{"prompt_id": "p", "answers": [{"q_id": "q1", "answer": "yes", "probability": "0.9"}, {"q_id": "q2", "probability": 0.4}]}'
    (tmp_path / "sd+xl.jsonl").write_text(record + "\n")
    row = read_judgments(spark, str(tmp_path)).first()
    assert row.model == "sd+xl"
    assert [a.probability for a in row.answers] == [0.9, 0.4]


def test_coverage_totals(spark):
    from rubrica.operators import quality as Q

    rows = [("a", "easy"), ("a", "odd"), (None, "hard"), ("TOTAL", "easy")]
    m = Q.coverage_matrix(spark.createDataFrame(rows, "category string, difficulty string"))
    got = {(r.category, r.is_total): r.total for r in m.collect()}
    assert got == {("a", False): 1, ("???", False): 1, ("TOTAL", False): 1, ("TOTAL", True): 4}
    assert {r.category for r in Q.coverage_gaps(m, 1).collect()} == {"a", "???", "TOTAL"}
