"""Queries: scoring arithmetic, seed collapse, score tables, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.functions import scoring as S
from rubrica.operators import bootstrap as B
from rubrica.operators import resampling as R
from rubrica.operators import judgments as J
from rubrica.operators import scores as A
from rubrica.plans import bindings as b
from rubrica.plans.registry import query
from rubrica.session import stored


def resolved(spark, d):
    return J.resolve_scores(b.judgments(spark, d))


def collapsed(spark, d):
    return J.collapse_seeds(resolved(spark, d), tie="rec_id")


def merged(spark, d):
    return J.attach_prompts(collapsed(spark, d), b.prompts(spark, d))


def edit_scores(spark, d):
    edited = J.as_scores(J.resolve_scores_edit(b.judgments(spark, d)))
    return J.attach_prompts(edited, b.prompts(spark, d))


def atoms(spark, d):
    return J.explode_atoms(b.judgments(spark, d), "model", "prompt_id", "seed", "rec_id", "l_linestatus")


# Arithmetic ------------------------------------------------------------------------------------


@query(
    "soft_am",
    f"WITH {b.ATOMS} SELECT rec_id, round_even(avg(p), 6) AS am FROM atoms GROUP BY rec_id "
    "UNION ALL SELECT rec_id, 0.0e0 FROM rec WHERE no_answers",
)
def soft_am(spark, d):
    probs = S.answer_probabilities(F.col("answers"))
    return b.judgments(spark, d).select("rec_id", F.bround(S.soft_am(probs), 6).alias("am"))


@query(
    "soft_gm",
    f"WITH {b.ATOMS} SELECT rec_id, round_even(exp(avg(ln(greatest(p, {b.FLOOR})))), 6) AS gm "
    "FROM atoms GROUP BY rec_id UNION ALL SELECT rec_id, 0.0e0 FROM rec WHERE no_answers",
)
def soft_gm(spark, d):
    probs = S.answer_probabilities(F.col("answers"))
    return b.judgments(spark, d).select("rec_id", F.bround(S.soft_gm(probs), 6).alias("gm"))


@query(
    "soft_scores_by_model",
    f"WITH {b.ATOMS} SELECT model, round_even(avg(p), 6) AS am, "
    f"round_even(exp(avg(ln(greatest(p, {b.FLOOR})))), 6) AS gm FROM atoms GROUP BY model",
)
def soft_scores_by_model(spark, d):
    p = S.atom_probability(F.col("answer"), F.col("probability"))
    return (
        atoms(spark, d).select("model", p.alias("p")).groupBy("model").agg(
            F.bround(S.soft_am_agg(F.col("p")), 6).alias("am"),
            F.bround(S.soft_gm_agg(F.col("p")), 6).alias("gm"),
        )
    )


@query(
    "atom_probability",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n,
       round_even(sum(CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 10
                      WHEN l_returnflag = 'A' THEN 1.0e0 ELSE {b.FLOOR} END), 4) AS total
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def atom_probability(spark, d):
    """Text probabilities: a number counts, any other text falls back on the answer."""
    text = F.expr(
        "CASE l_linenumber % 3 WHEN 0 THEN cast(l_discount * 10 AS string) WHEN 1 THEN 'n/a' END"
    )
    answer = F.expr("CASE WHEN l_returnflag = 'A' THEN '  YES ' ELSE 'no' END")
    return b.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.sum(S.atom_probability(answer, text)), 4).alias("total"),
    )


_TOP = """CASE l_linenumber % 4
  WHEN 0 THEN array(named_struct('token', 'Yes', 'logprob', -l_discount * 10),
                    named_struct('token', ' yes', 'logprob', -l_tax * 20),
                    named_struct('token', 'No', 'logprob', 0.0D))
  WHEN 1 THEN array(named_struct('token', 'Nope', 'logprob', -0.1D),
                    named_struct('token', cast(null as string), 'logprob', 0.0D))
  WHEN 2 THEN array(named_struct('token', ' YES', 'logprob', cast(null as double)),
                    named_struct('token', 'YES', 'logprob', -l_tax * 20))
  END"""


@query(
    "yes_probability",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(CASE l_linenumber % 4
          WHEN 0 THEN exp(greatest(-l_discount * 10, -l_tax * 20))
          WHEN 2 THEN exp(-l_tax * 20) ELSE {b.FLOOR} END, 6) AS p_yes FROM lineitem""",
)
def yes_probability(spark, d):
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.bround(S.yes_probability(F.expr(_TOP)), 6).alias("p_yes"),
    )


@query(
    "judge_atoms",
    f"""WITH raw AS (SELECT l_orderkey, l_linenumber = 5 AS bad,
            CASE WHEN l_linenumber = 5 THEN {b.FLOOR} WHEN l_linenumber % 4 = 0
              THEN exp(greatest(-l_discount * 10, -l_tax * 20))
              WHEN l_linenumber % 4 = 2 THEN exp(-l_tax * 20) ELSE {b.FLOOR} END AS p FROM lineitem)
        SELECT l_orderkey AS judgment, round_even(avg(p), 4) AS score_am,
          round_even(exp(avg(ln(greatest(p, {b.FLOOR})))), 4) AS score_gm,
          count(*) AS n_atoms, count(*) FILTER (WHERE bad) AS n_failed_atoms
        FROM raw GROUP BY l_orderkey""",
)
def judge_atoms(spark, d):
    """Raw responses to one scored row per judgment, errored atoms held at the floor."""
    raw = b.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("judgment"),
        F.expr(_TOP).alias("top_logprobs"),
        F.expr("CASE WHEN l_linenumber = 5 THEN 'no logprobs' END").alias("error"),
    )
    return J.judgment_scores(J.judge_atoms(raw), ("judgment",))


@query(
    "normalize_verdict",
    """SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN 'no' WHEN l_returnflag = 'N' THEN 'yes'
          WHEN l_returnflag = 'A' THEN 'yes' ELSE 'no' END AS verdict, count(*) AS n
       FROM lineitem GROUP BY 1, 2""",
)
def normalize_verdict(spark, d):
    raw = F.expr(
        "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_returnflag = 'N' THEN ' Yes, it is' "
        "WHEN l_returnflag = 'A' THEN 'y' ELSE 'nay' END"
    )
    return (
        b.table(spark, d, "lineitem")
        .groupBy("l_returnflag", S.normalize_verdict(raw).alias("verdict"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "hard_verdict",
    """SELECT l_discount, CASE WHEN l_discount * 10 >= 0.5e0 THEN 'yes' ELSE 'no' END AS verdict,
          count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def hard_verdict(spark, d):
    verdict = S.hard_verdict(F.col("l_discount") * 10)
    return (
        b.table(spark, d, "lineitem").groupBy("l_discount", verdict.alias("verdict"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "covered_mask",
    f"WITH {b.REC} SELECT model, trim(coalesce(error, '')) = '' AS covered, count(*) AS n "
    "FROM rec GROUP BY 1, 2",
)
def covered_mask(spark, d):
    return (
        b.judgments(spark, d).groupBy("model", S.covered_mask(F.col("error")).alias("covered"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "looks_like_filter",
    f"""WITH {b.LOG} SELECT event_id, lower(error) LIKE '%content policy%' OR lower(error) LIKE
        '%violates%' OR lower(error) LIKE '%nsfw%' OR lower(error) LIKE '%blocked%' AS filtered
        FROM log WHERE error IS NOT NULL""",
)
def looks_like_filter(spark, d):
    rows = b.log(spark, d).filter("error IS NOT NULL")
    return rows.select("event_id", S.looks_like_filter(F.col("error")).alias("filtered"))


@query(
    "failure_status",
    f"WITH {b.LOG} SELECT event_id, status AS derived_status FROM log",
)
def failure_status(spark, d):
    return b.log(spark, d).select("event_id", S.failure_status(F.col("error")).alias("derived_status"))


@query(
    "resolve_scores",
    f"WITH {b.RESOLVED} SELECT rec_id, seed, round_even(score, 6) AS score, "
    "round_even(score_am, 6) AS score_am, round_even(score_gm, 6) AS score_gm FROM j",
)
def resolve_scores(spark, d):
    return resolved(spark, d).select(
        "rec_id", "seed", *[F.bround(c, 6).alias(c) for c in ("score", "score_am", "score_gm")]
    )


@query(
    "resolve_scores_edit",
    f"WITH {b.RESOLVED_EDIT} SELECT rec_id, round_even(score_am, 6) AS score_am, "
    "round_even(score_gm, 6) AS score_gm FROM j",
)
def resolve_scores_edit(spark, d):
    return J.resolve_scores_edit(b.judgments(spark, d)).select(
        "rec_id", *[F.bround(c, 6).alias(c) for c in ("score_am", "score_gm")]
    )


@query(
    "impute_missing_answers",
    f"""WITH {b.ATOMS} SELECT rec_id, q_id,
          CASE WHEN image_path IS NULL THEN 'no' ELSE answer END AS answer,
          CASE WHEN image_path IS NULL THEN 0.0e0 ELSE probability END AS probability,
          CASE WHEN image_path IS NULL THEN 'image_missing_or_filtered' ELSE error END AS error,
          CASE WHEN image_path IS NULL THEN 0.0e0 ELSE score_am END AS score_am
        FROM atoms""",
)
def impute_missing_answers(spark, d):
    """The questions of a record are those of its answers here."""
    records = b.judgments(spark, d).withColumn("questions", F.col("answers"))
    done = J.impute_missing_answers(records)
    return J.explode_atoms(done, "rec_id", "error", "score_am").select(
        "rec_id", "q_id", "answer", "probability", "error", "score_am"
    )


@query(
    "impute_missing_edits",
    f"""WITH {b.CHAINS} SELECT prompt_id, turn, q.q_id, CASE WHEN image_path IS NULL OR
          coalesce(source_image_path, '') = '' THEN 'no' ELSE 'yes' END AS answer,
          CASE WHEN image_path IS NULL THEN 'edited_image_missing_or_filtered'
               WHEN coalesce(source_image_path, '') = '' THEN 'source_image_missing' END AS error
        FROM chains, (VALUES ('q1'), ('q2')) q(q_id)""",
)
def impute_missing_edits(spark, d):
    atoms = F.expr(
        "transform(array('q1', 'q2'), q -> named_struct('q_id', q, 'question', 'ok?', 'type', "
        "'instruction', 'dimension', 'instruction_following'))"
    )
    answered = F.expr(
        "transform(atoms, a -> named_struct('q_id', a.q_id, 'question', a.question, 'type', a.type, "
        "'dimension', a.dimension, 'answer', 'yes', 'probability', 1.0D))"
    )
    records = (
        b.chains(spark, d)
        .withColumnRenamed("image_path", "edited_image_path")
        .withColumn("atoms", atoms)
        .withColumn("answers", answered)
        .withColumn("error", F.lit(None).cast("string"))
    )
    done = J.impute_missing_edits(records)
    return J.explode_atoms(done, "prompt_id", "turn", "error").select(
        "prompt_id", "turn", "q_id", "answer", "error"
    )


@query(
    "floor_errored_atoms",
    f"""WITH x AS (SELECT {b.RECORD_ID} AS rec_id, l_discount * 10 AS p1, l_tax * 12.5e0 AS p2,
          l_tax > 0.05 AS f1, l_discount > 0.05 AS f2, l_linenumber > 4 AS f3, l_quantity > 20 AS f4
          FROM lineitem)
        SELECT rec_id, CASE WHEN f1 THEN 'no' WHEN p1 >= 0.5e0 THEN 'yes' ELSE 'no' END AS answer_1,
          round_even(CASE WHEN f2 THEN {b.FLOOR} ELSE p2 END, 6) AS probability_2,
          CASE WHEN f1 OR f2 OR f3 OR f4 THEN concat('ATOM_ERRORS: [', array_to_string(list_filter([
            CASE WHEN f1 THEN '(q1, e1)' END, CASE WHEN f2 THEN '(q2, e2)' END,
            CASE WHEN f3 THEN '(q3, e3)' END, CASE WHEN f4 THEN '(q4, e4)' END],
            lambda t: t IS NOT NULL)[1:3], ', '), ']') END AS error FROM x""",
)
def floor_errored_atoms(spark, d):
    rows = b.table(spark, d, "lineitem").selectExpr(
        f"{b.RECORD_ID} AS rec_id",
        """array(
          named_struct('q_id', 'q1', 'p', l_discount * 10, 'error', CASE WHEN l_tax > 0.05 THEN 'e1' END),
          named_struct('q_id', 'q2', 'p', l_tax * 12.5D, 'error', CASE WHEN l_discount > 0.05 THEN 'e2' END),
          named_struct('q_id', 'q3', 'p', 1.0D, 'error', CASE WHEN l_linenumber > 4 THEN 'e3' END),
          named_struct('q_id', 'q4', 'p', 1.0D, 'error', CASE WHEN l_quantity > 20 THEN 'e4' END)) AS atoms""",
    )
    return J.floor_errored_atoms(rows).selectExpr(
        "rec_id", "answers[0].answer AS answer_1", "answers[1].probability AS probability_2", "error"
    )


# Tables ----------------------------------------------------------------------------------------


@query(
    "distinct_keys",
    f"WITH {b.REC} SELECT DISTINCT model, prompt_id FROM rec",
)
def distinct_keys(spark, d):
    return J.distinct_keys(b.judgments(spark, d))


@query(
    "collapse_seeds",
    f"""WITH {b.COLLAPSED}, e AS (
          SELECT model, prompt_id,
            min_by(judge_error, (lpad(seed::VARCHAR, 12, '0') || rec_id)) FILTER (WHERE NOT good) AS judge_error,
            min_by(p1, (lpad(seed::VARCHAR, 12, '0') || rec_id)) FILTER (WHERE NOT no_answers) AS first_p
          FROM j GROUP BY model, prompt_id)
        SELECT model, prompt_id, round_even(score_am, 6) AS score_am, round_even(score_gm, 6) AS score_gm,
          round_even(seed_std_dev_am, 6) AS seed_std_dev_am, round_even(seed_std_dev_gm, 6) AS seed_std_dev_gm,
          n_seeds, CASE WHEN n_seeds = 0 THEN judge_error END AS judge_error, first_p
        FROM c JOIN e USING (model, prompt_id)""",
)
def collapse_seeds(spark, d):
    out = J.collapse_seeds(resolved(spark, d), tie="rec_id", answer_fields=["probability"])
    scores = ["score_am", "score_gm", "seed_std_dev_am", "seed_std_dev_gm"]
    return out.select(
        "model", "prompt_id", *[F.bround(c, 6).alias(c) for c in scores], "n_seeds", "judge_error",
        F.get("answers", F.lit(0))["probability"].alias("first_p"),
    )


@query(
    "attach_prompts",
    f"WITH {b.SCORES} SELECT model, prompt_id, layer, sub_category, difficulty, covered FROM s",
)
def attach_prompts(spark, d):
    return merged(spark, d).select("model", "prompt_id", "layer", "sub_category", "difficulty", "covered")


_BOARD = """SELECT model, round_even(avg(score_am), 4) AS overall_am, round_even(avg(score_gm), 4) AS overall_gm,
  round_even(stddev_samp(score_am), 4) AS std_dev_am, round_even(stddev_samp(score_gm), 4) AS std_dev_gm,
  count(*) AS n_total, round_even(avg(score_am) FILTER (WHERE covered), 4) AS overall_am_covered,
  round_even(avg(score_gm) FILTER (WHERE covered), 4) AS overall_gm_covered,
  count(*) FILTER (WHERE covered) AS n_covered,
  round_even(count(*) FILTER (WHERE covered) / greatest(count(*), 1)::DOUBLE, 4) AS coverage_rate"""
BOARD = f"""WITH {b.SCORES}, board AS ({_BOARD},
  round_even(avg(seed_std_dev_am), 4) AS seed_std_dev_am, round_even(avg(seed_std_dev_gm), 4) AS seed_std_dev_gm
  FROM s GROUP BY model)"""
EDIT_BOARD = f"WITH {b.EDIT_SCORES}, board AS ({_BOARD} FROM s GROUP BY model)"


def board(spark, d):
    return A.leaderboard(collapsed(spark, d))


@query("leaderboard", f"{BOARD} SELECT * FROM board")
def leaderboard(spark, d):
    return board(spark, d)


@query("leaderboard_edit", f"{EDIT_BOARD} SELECT * FROM board")
def leaderboard_edit(spark, d):
    return A.leaderboard(J.as_scores(J.resolve_scores_edit(b.judgments(spark, d))))


@query(
    "legacy_aliases",
    f"{BOARD} SELECT *, n_total AS n_prompts, overall_am AS overall_score, std_dev_am AS std_dev, "
    "seed_std_dev_am AS seed_std_dev FROM board",
)
def legacy_aliases(spark, d):
    return A.legacy_aliases(board(spark, d))


CELLS = """cells AS (SELECT model, sub_category, round_even(avg(score_am), 4) AS am,
  round_even(avg(score_gm), 4) AS gm, count(*) AS n FROM s WHERE sub_category IS NOT NULL
  GROUP BY model, sub_category)"""


def cells(spark, d):
    return A.breakdown(merged(spark, d), "sub_category")


@query("breakdown", f"WITH {b.SCORES}, {CELLS} SELECT * FROM cells")
def breakdown(spark, d):
    return cells(spark, d)


_WIDE = ", ".join(
    f"max({m}) FILTER (WHERE sub_category = '{c}') AS \"{c}__{m}\""
    for m in ("am", "gm")
    for c in b.SUB_CATEGORIES
)
PER_SUB = f"""{CELLS} SELECT model, {_WIDE}, round_even(sum(am::DECIMAL(18,4))::DOUBLE / count(am), 4) AS overall_am,
  round_even(sum(gm::DECIMAL(18,4))::DOUBLE / count(gm), 4) AS overall_gm FROM cells GROUP BY model"""


@query("per_subcategory", f"WITH {b.SCORES}, {PER_SUB}")
def per_subcategory(spark, d):
    return A.per_subcategory(merged(spark, d), b.SUB_CATEGORIES)


@query("per_subcategory_edit", f"WITH {b.EDIT_SCORES}, {PER_SUB}")
def per_subcategory_edit(spark, d):
    return A.per_subcategory(edit_scores(spark, d), b.SUB_CATEGORIES)


LAYERS = """l AS (SELECT model,
    round_even(avg(score_am) FILTER (WHERE layer = 1), 4) AS layer1_gold_am,
    round_even(avg(score_am) FILTER (WHERE layer = 2), 4) AS layer2_proprietary_am,
    round_even(avg(score_gm) FILTER (WHERE layer = 1), 4) AS layer1_gold_gm,
    round_even(avg(score_gm) FILTER (WHERE layer = 2), 4) AS layer2_proprietary_gm
    FROM s WHERE layer IN (1, 2) GROUP BY model),
  layers AS (SELECT *, round_even(layer1_gold_am - layer2_proprietary_am, 4) AS divergence_am,
    round_even(layer1_gold_gm - layer2_proprietary_gm, 4) AS divergence_gm,
    layer1_gold_am AS layer1_gold, layer2_proprietary_am AS layer2_proprietary,
    round_even(layer1_gold_am - layer2_proprietary_am, 4) AS divergence FROM l)"""


def layers(spark, d):
    return A.layer_comparison(merged(spark, d))


@query("layer_comparison", f"WITH {b.SCORES}, {LAYERS} SELECT * FROM layers")
def layer_comparison(spark, d):
    return layers(spark, d)


@query("layer_comparison_edit", f"WITH {b.EDIT_SCORES}, {LAYERS} SELECT * FROM layers")
def layer_comparison_edit(spark, d):
    return A.layer_comparison(edit_scores(spark, d))


def _failures(*by):
    named = ", ".join(f"coalesce(nullif({c}, ''), 'unknown') AS {c}" for c in by)
    return (
        f"WITH {b.ATOMS} SELECT model, {named}, round_even(avg(CASE WHEN answer = 'no' THEN 1.0e0 ELSE 0.0e0 END), 4) "
        f"AS failure_rate, count(*) AS n FROM atoms GROUP BY ALL"
    )


@query("failure_analysis", _failures("q_type"))
def failure_analysis(spark, d):
    return A.failure_analysis(atoms(spark, d))


@query("failure_analysis_edit", _failures("q_type", "dimension"))
def failure_analysis_edit(spark, d):
    return A.failure_analysis(atoms(spark, d), ("q_type", "dimension"))


THEME_TABLE = """tb AS (SELECT model, theme, round_even(avg(score_am), 4) AS mean_score_am,
  round_even(stddev_samp(score_am), 4) AS std_dev_am, round_even(avg(score_gm), 4) AS mean_score_gm,
  round_even(stddev_samp(score_gm), 4) AS std_dev_gm, count(*) AS n_prompts,
  round_even(avg(score_am), 4) AS mean_score, round_even(stddev_samp(score_am), 4) AS std_dev
  FROM c JOIN themes USING (prompt_id) GROUP BY model, theme)"""


def theme_table(spark, d):
    from rubrica.operators.themes import theme_rows

    return A.theme_breakdown(collapsed(spark, d), theme_rows(b.tagged(spark, d)))


@query("theme_breakdown", f"WITH {b.COLLAPSED}, {b.THEMES}, {THEME_TABLE} SELECT * FROM tb")
def theme_breakdown(spark, d):
    return theme_table(spark, d)


@query(
    "covered_counts",
    f"WITH {b.COLLAPSED} SELECT model, count(DISTINCT prompt_id) AS n_covered FROM c WHERE covered GROUP BY model",
)
def covered_counts(spark, d):
    return A.covered_counts(collapsed(spark, d))


@query(
    "coverage_lookup",
    f"""WITH {b.COLLAPSED}, cov AS (SELECT model, count(DISTINCT prompt_id) AS n FROM c WHERE covered GROUP BY model)
        SELECT m.model, coalesce(n, 0) AS n_covered FROM (SELECT DISTINCT model FROM c UNION SELECT 'model_new') m
        LEFT JOIN cov USING (model)""",
)
def coverage_lookup(spark, d):
    scores = collapsed(spark, d)
    new = spark.range(1).select(F.lit("model_new").alias("model"))
    return A.coverage_lookup(scores.select("model").distinct().union(new), A.covered_counts(scores))


@query(
    "filter_rates",
    f"""WITH {b.COLLAPSED}, {b.LOG},
        cov AS (SELECT model, count(DISTINCT prompt_id) AS n FROM c WHERE covered GROUP BY model),
        g AS (SELECT model, count(*) FILTER (WHERE status = 'FILTERED') AS filtered,
              count(*) FILTER (WHERE status = 'ERROR') AS errored FROM log GROUP BY model),
        t AS (SELECT g.*, coalesce(cov.n, 0) AS n_covered, (SELECT count(*) FROM part) AS n_total
              FROM g LEFT JOIN cov USING (model))
        SELECT *, greatest(n_total - n_covered, 0) AS uncovered,
          round_even(greatest(n_total - n_covered, 0) / greatest(n_total, 1)::DOUBLE, 4) AS uncovered_rate,
          round_even(filtered / n_total::DOUBLE, 4) AS filter_rate FROM t""",
)
def filter_rates(spark, d):
    counts = A.covered_counts(collapsed(spark, d))
    return A.filter_rates(b.log(spark, d), counts, A.prompt_total(b.prompts(spark, d)))


@query(
    "filter_rates_log_only",
    f"""WITH {b.LOG}, g AS (SELECT model, count(*) FILTER (WHERE status = 'FILTERED') AS filtered,
          count(*) FILTER (WHERE status = 'ERROR') AS errored FROM log GROUP BY model)
        SELECT *, 0::BIGINT AS n_covered, 0::BIGINT AS n_total, 0::BIGINT AS uncovered, 0.0e0 AS uncovered_rate,
          round_even(filtered / greatest(filtered + errored, 1)::DOUBLE, 4) AS filter_rate FROM g""",
)
def filter_rates_log_only(spark, d):
    return A.filter_rates(b.log(spark, d))


@query(
    "filter_rates_edit",
    f"""WITH {b.RESOLVED_EDIT}, t AS (SELECT model,
          count(DISTINCT CASE WHEN covered THEN prompt_id END) AS n_covered,
          (SELECT count(*) FROM part) AS n_total FROM j GROUP BY model)
        SELECT *, n_total - n_covered AS uncovered,
          round_even((n_total - n_covered) / greatest(n_total, 1)::DOUBLE, 4) AS uncovered_rate FROM t""",
)
def filter_rates_edit(spark, d):
    scores = J.as_scores(J.resolve_scores_edit(b.judgments(spark, d)))
    return A.filter_rates_edit(scores, A.prompt_total(b.prompts(spark, d)))


_DIMS = ", ".join(
    f"round_even(avg(p) FILTER (WHERE dimension = '{x}'), 4) AS {x}_am, "
    f"round_even(exp(avg(ln(greatest(p, {b.FLOOR}))) FILTER (WHERE dimension = '{x}')), 4) AS {x}_gm"
    for x in A.DIMENSIONS
)


@query("per_dimension", f"WITH {b.ATOMS} SELECT model, {_DIMS} FROM atoms GROUP BY model")
def per_dimension(spark, d):
    return A.per_dimension(atoms(spark, d))


@query(
    "cap_dimensions",
    f"""WITH {b.ATOMS}, w AS (SELECT model, {_DIMS} FROM atoms GROUP BY model) SELECT model,
        least(visual_consistency_gm, instruction_following_gm) AS visual_consistency_gm,
        least(detail_preservation_gm, instruction_following_gm) AS detail_preservation_gm FROM w""",
)
def cap_dimensions(spark, d):
    wide = A.per_dimension(atoms(spark, d))
    return wide.select(
        "model",
        *[
            S.cap_dimensions(F.col("instruction_following_gm"), F.col(f"{x}_gm")).alias(f"{x}_gm")
            for x in A.DIMENSIONS[1:]
        ],
    )


@query(
    "summary_stats",
    f"""WITH {b.SCORES} SELECT count(DISTINCT model) AS n_models, count(DISTINCT prompt_id) AS n_prompts_judged,
        count(*) AS n_total_judgments, round_even(avg(score_am), 4) AS mean_score_am_overall,
        round_even(avg(score_gm), 4) AS mean_score_gm_overall FROM s""",
)
def summary_stats(spark, d):
    return A.summary_stats(merged(spark, d))


@query(
    "weak_models",
    f"""WITH {b.SCORES}, {CELLS}, m AS (SELECT model, bool_or(gm < 0.3) AS weak FROM cells GROUP BY model)
        SELECT count(*) FILTER (WHERE weak) AS n_weak, count(*) AS n_models FROM m""",
)
def weak_models(spark, d):
    return A.weak_models(cells(spark, d), threshold=0.3)


@query(
    "extreme_cells",
    f"""WITH {b.SCORES}, {CELLS},
        lo AS (SELECT * FROM cells ORDER BY gm, model, sub_category LIMIT 1),
        hi AS (SELECT * FROM cells ORDER BY gm DESC, model DESC, sub_category DESC LIMIT 1)
        SELECT lo.model AS worst_model, lo.sub_category AS worst_sub_category, lo.gm AS worst_gm,
          hi.model AS best_model, hi.sub_category AS best_sub_category, hi.gm AS best_gm FROM lo, hi""",
)
def extreme_cells(spark, d):
    return A.extreme_cells(cells(spark, d))


# Bootstrap -------------------------------------------------------------------------------------

N_BOOT = 10_000
SEED = 42


def _mix(x):
    return f"((xor({x}, {x} >> 16) * {B.MIX}) & 4294967295)"


def _scramble_sql(source, result, x):
    """Three steps that mix the 32-bit integer ``x`` of ``source`` into ``h`` of ``result``."""
    return f"""{result}1 AS (SELECT * EXCLUDE (h), {_mix('h')} AS h FROM (SELECT * EXCLUDE (h), {x} AS h FROM {source})),
      {result}2 AS (SELECT * EXCLUDE (h), {_mix('h')} AS h FROM {result}1),
      {result} AS (SELECT * EXCLUDE (h), xor(h, h >> 16) AS h FROM {result}2)"""


def _half_sql(at):
    return f"('0x' || substr(md5('{SEED}:' || prompt_id), {at}, 8))::BIGINT"


def _draws_sql(measures):
    """``ci``: model and the bounds of each (name, value, log scale) from the same weights."""
    xs = ", ".join(f"{f'ln(greatest({v}, {b.FLOOR}))' if log else v} AS {n}" for n, v, log in measures)
    names = ", ".join(n for n, _, _ in measures)
    steps = " + ".join(f"(h >= {p})::INT" for p in B.POISSON_STEPS)
    stats = ", ".join(f"sum(w * {n}) / sum(w) AS {n}" for n, _, _ in measures)
    bounds = ", ".join(
        f"round_even({'exp' if log else ''}(quantile_cont({n}, {q}e0)), 4) AS {n}_{side}"
        for n, _, log in measures
        for side, q in (("lower", 0.025), ("upper", 0.975))
    )
    return f"""r0 AS (SELECT model, {xs}, {_half_sql(1)} AS h, {_half_sql(9)} AS k FROM c WHERE covered),
      r1 AS (SELECT *, i AS b FROM r0, range({N_BOOT}) t(i)),
      {_scramble_sql('r1', 'p', f'xor(h, (b * {B.STRIDE}) & 4294967295)')},
      {_scramble_sql('p', 'q', 'xor(h, k)')},
      w AS (SELECT model, b, {names}, {steps} AS w FROM q),
      rep AS (SELECT model, b, {stats} FROM w GROUP BY model, b HAVING sum(w) > 0),
      ci AS (SELECT model, {bounds} FROM rep GROUP BY model)"""


def _interval(spark, d, value, stat):
    covered = collapsed(spark, d).filter("covered")
    bounds = B.bootstrap_ci(covered, "model", value, "prompt_id", stat, N_BOOT, seed=SEED)
    return bounds.select("model", *[F.bround(c, 4).alias(c) for c in ("ci_lower", "ci_upper")])


@query("bootstrap_ci_mean", f"WITH {b.COLLAPSED}, {_draws_sql([('ci', 'score_am', False)])} SELECT * FROM ci")
def bootstrap_ci_mean(spark, d):
    return _interval(spark, d, "score_am", "mean")


@query("bootstrap_ci_gm", f"WITH {b.COLLAPSED}, {_draws_sql([('ci', 'score_gm', True)])} SELECT * FROM ci")
def bootstrap_ci_gm(spark, d):
    return _interval(spark, d, "score_gm", "gm")


@query(
    "leaderboard_ci",
    f"""{BOARD}, {_draws_sql([('am_ci', 'score_am', False), ('gm_ci', 'score_gm', True)])}
        SELECT board.*, ci.* EXCLUDE (model) FROM board LEFT JOIN ci USING (model)""",
)
def leaderboard_ci(spark, d):
    """The leaderboard with intervals of covered AM and GM."""
    scores = stored(collapsed(spark, d).drop("answers", "judge_error"), "collapsed")
    return A.leaderboard(scores, B.leaderboard_ci(scores, N_BOOT, seed=SEED))


@query(
    "bootstrap_exact",
    f"""WITH {b.COLLAPSED} SELECT model, count(*) AS n, count(*) AS least_draws, count(*) AS most_draws,
        true AS near_lower, true AS near_upper, round_even(avg(score_am), 6) AS mean FROM c WHERE covered GROUP BY model""",
)
def bootstrap_exact(spark, d):
    """Intervals from replicates of exactly n draws; both bounds lie near those of the normal law."""
    covered = stored(collapsed(spark, d).filter("covered").select("model", "prompt_id", "score_am"), "covered")
    bounds = R.exact_ci(covered, "model", "score_am", "prompt_id", n_boot=N_BOOT, seed=SEED)
    error = F.stddev_pop("score_am") / F.sqrt(F.count("score_am"))
    normal = covered.groupBy("model").agg(F.avg("score_am").alias("mean"), error.alias("error"))

    def near(bound, side):
        return F.abs(F.col(bound) - (F.col("mean") + side * 1.96 * F.col("error"))) < 0.5 * F.col("error")

    return bounds.join(normal, "model").select(
        "model", "n", "least_draws", "most_draws", near("ci_lower", -1).alias("near_lower"),
        near("ci_upper", 1).alias("near_upper"), F.bround("mean", 6).alias("mean"),
    )


@query(
    "bootstrap_median",
    f"""WITH {b.COLLAPSED} SELECT model, count(*) AS n, round_even(median(score_gm), 6) AS middle, true AS low_in_place,
        true AS high_in_place FROM c WHERE covered GROUP BY model""",
)
def bootstrap_median(spark, d):
    """Intervals of a statistic of the caller's own, the median. The numbers of values below its bounds must
    lie where a binomial count does: 1 to 3.3 deviations beside the middle."""
    covered = collapsed(spark, d).filter("covered").select("model", "prompt_id", F.col("score_gm").alias("x"))
    covered = stored(covered, "covered")
    bounds = R.custom_ci(covered, "model", "x", "prompt_id", R.weighted_median, weighted=True, n_boot=N_BOOT, seed=SEED)
    n, half = F.count("x"), 0.5 * F.sqrt(F.count("x"))
    lower, upper = F.count_if(F.col("x") < F.col("ci_lower")), F.count_if(F.col("x") < F.col("ci_upper"))
    lower_too, upper_too = F.count_if(F.col("x") <= F.col("ci_lower")), F.count_if(F.col("x") <= F.col("ci_upper"))
    return covered.join(bounds.drop("n"), "model").groupBy("model").agg(
        n.alias("n"),
        F.bround(F.median("x"), 6).alias("middle"),
        ((lower <= n / 2 - half) & (lower_too >= n / 2 - 3.3 * half)).alias("low_in_place"),
        ((upper_too >= n / 2 + half) & (upper <= n / 2 + 3.3 * half)).alias("high_in_place"),
    )
