"""Judgment rows: resolve scores, explode atoms, collapse seeds, attach prompt attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.operators.ranking import unique_join

MISSING_IMAGE = "image_missing_or_filtered"
MISSING_EDIT = "edited_image_missing_or_filtered"
MISSING_SOURCE = "source_image_missing"


def resolve_scores(judgments: DataFrame, legacy: bool = True) -> DataFrame:
    """Give every judgment an AM and a GM.

    Explicit values win. With neither, a legacy ``score`` stands for both (``legacy=True``
    only: edit judgments have no such rule). Whatever is still missing comes from the answers.
    """
    has = judgments.columns
    am = F.col("score_am") if "score_am" in has else F.lit(None).cast("double")
    gm = F.col("score_gm") if "score_gm" in has else F.lit(None).cast("double")
    old = F.col("score") if "score" in has else F.lit(None).cast("double")
    seed = F.col("seed") if "seed" in has else F.lit(None).cast("int")
    stand_in = F.when(am.isNull() & gm.isNull(), old) if legacy else F.lit(None).cast("double")
    resolved_am = F.coalesce(am, stand_in, S.answers_am(F.col("answers")))
    resolved_gm = F.coalesce(gm, stand_in, S.answers_gm(F.col("answers")))
    return judgments.withColumns(
        {
            "score_am": resolved_am,
            "score_gm": resolved_gm,
            "score": F.coalesce(old, resolved_am) if legacy else resolved_am,
            "seed": F.coalesce(seed, F.lit(0)),
            "judge_error": F.col("error") if "error" in has else F.lit(None).cast("string"),
        }
    )


def resolve_scores_edit(judgments: DataFrame) -> DataFrame:
    return resolve_scores(judgments, legacy=False)


def explode_atoms(judgments: DataFrame, *keep: str) -> DataFrame:
    """One row per answer, with the columns in ``keep`` and the atom's own fields."""
    a = F.col("_atom")
    return judgments.select(*keep, F.explode("answers").alias("_atom")).select(
        *keep,
        a["q_id"].alias("q_id"),
        a["question"].alias("question"),
        a["type"].alias("q_type"),
        a["dimension"].alias("dimension"),
        a["answer"].alias("answer"),
        a["probability"].alias("probability"),
    )


def collapse_seeds(
    judgments: DataFrame, keys: tuple[str, ...] = ("model", "prompt_id"), tie: str | None = None,
    answer_fields: list[str] | None = None,
) -> DataFrame:
    """One row per (model, prompt): scores averaged over the seeds that were judged.

    All buffers have a fixed size, so partial aggregation absorbs a hot prompt. The error text
    and the kept answers fall away from the plan when nothing downstream reads them; ``covered``
    and the scores then stay in hash aggregation. ``answer_fields`` names the fields of the kept answers that are
    wanted (all, if not given): Spark does not prune them through the aggregate, and they make up most of a row.
    """
    good = S.covered_mask(F.col("judge_error"))
    order = [F.col("seed"), *([F.col(tie)] if tie else [])]
    n_good = F.count(F.when(good, F.lit(1)))

    def good_only(c: str) -> Column:
        return F.when(good, F.col(c))

    aggs = [
        F.coalesce(F.avg(good_only("score_am")), F.lit(0.0)).alias("score_am"),
        F.coalesce(F.avg(good_only("score_gm")), F.lit(0.0)).alias("score_gm"),
        F.coalesce(F.stddev_samp(good_only("score_am")), F.lit(0.0)).alias("seed_std_dev_am"),
        F.coalesce(F.stddev_samp(good_only("score_gm")), F.lit(0.0)).alias("seed_std_dev_gm"),
        n_good.alias("n_seeds"),
        F.when(
            n_good == 0, F.min(F.when(~good, F.struct(*order, F.col("judge_error"))))["judge_error"]
        ).alias("judge_error"),
        (n_good > 0).alias("covered"),
    ]
    if "answers" in judgments.columns:
        if answer_fields is not None:
            fields = answer_fields
            wanted = F.transform("answers", lambda a: F.struct(*[a[f].alias(f) for f in fields]))
            judgments = judgments.withColumn("answers", wanted)
        has_answers = F.size("answers") > 0
        aggs.append(
            F.min_by("answers", F.when(has_answers, F.struct(*order))).alias("answers")
        )
    out = judgments.groupBy(*keys).agg(*aggs)
    return out.withColumns({"score": F.col("score_am"), "seed_std_dev": F.col("seed_std_dev_am")})


def as_scores(judgments: DataFrame) -> DataFrame:
    """Uncollapsed judgments in the shape the score tables take (the edit side has no seeds)."""
    return judgments.withColumn("covered", S.covered_mask(F.col("judge_error")))


def attach_prompts(scores: DataFrame, prompts: DataFrame) -> DataFrame:
    """Left join layer, sub-category and difficulty. Collapse first: then no prompt is hot.

    No broadcast hint: the prompt table grows with the benchmark, so Spark decides by size.
    """
    attributes = prompts.select(
        "prompt_id",
        "layer",
        "sub_category",
        F.coalesce(F.col("difficulty"), F.lit("auto")).alias("difficulty"),
    )
    return scores.join(attributes, "prompt_id", "left")


def distinct_keys(judgments: DataFrame) -> DataFrame:
    return judgments.select("model", "prompt_id").distinct()


def impute_missing_answers(records: DataFrame, questions: str = "questions") -> DataFrame:
    """Records without an image get a "no" at 0.0 for every question, zero scores and an error."""
    missing = F.coalesce(F.col("image_path"), F.lit("")) == ""
    return _imputed(records, F.when(missing, MISSING_IMAGE), questions, renumber=False)


def impute_missing_edits(records: DataFrame, atoms: str = "atoms") -> DataFrame:
    """As above for edits: the edited image is looked at first, then the source image."""
    no_edit = F.coalesce(F.col("edited_image_path"), F.lit("")) == ""
    no_source = F.coalesce(F.col("source_image_path"), F.lit("")) == ""
    reason = F.when(no_edit, MISSING_EDIT).when(no_source, MISSING_SOURCE)
    return _imputed(records, reason, atoms, renumber=True)


def _imputed(records: DataFrame, reason: Column, questions: str, renumber: bool) -> DataFrame:
    fields = records.schema[questions].dataType.elementType.names

    def no_answer(q: Column, i: Column) -> Column:
        kept = [
            (F.coalesce(q[f], F.lit("")) if f in fields else F.lit("")).alias(f)
            for f in ("type", "dimension")
        ]
        q_id = F.concat(F.lit("q"), (i + 1).cast("string")) if renumber else q["q_id"]
        return F.struct(
            q_id.alias("q_id"),
            F.lit(None).cast("string").alias("question"),
            *kept,
            F.lit("no").alias("answer"),
            F.lit(0.0).alias("probability"),
        )

    missing = reason.isNotNull()
    zero = {
        c: F.when(missing, F.lit(0.0)).otherwise(F.col(c))
        for c in ("score", "score_am", "score_gm")
        if c in records.columns
    }
    return records.withColumns(
        {
            "answers": F.when(missing, F.transform(questions, no_answer)).otherwise(F.col("answers")),
            "error": F.coalesce(reason, F.col("error")),
            **zero,
        }
    )


def judge_atoms(responses: DataFrame, floor: float = S.LOGPROB_FLOOR) -> DataFrame:
    """Raw judge responses (one row per atom: ``top_logprobs``, ``error``) to scored atoms.

    An atom with an error is held at exp(floor) and stays flagged. ``probability`` is what is
    written (six decimals); ``p`` is the exact value the scores are made of.
    """
    failed = ~S.covered_mask(F.col("error"))
    p = F.when(failed, S.floor_probability(floor)).otherwise(
        S.yes_probability(F.col("top_logprobs"), floor)
    )
    return (
        responses.withColumn("p", p)
        .withColumn("answer", S.hard_verdict(F.col("p")))
        .withColumn("probability", F.bround("p", 6))
        .withColumn("atom_failed", failed)
    )


def floor_errored_atoms(judgments: DataFrame, floor: float = S.LOGPROB_FLOOR) -> DataFrame:
    """Nested form: ``atoms`` array of (q_id, p, error) to answers and an ``ATOM_ERRORS`` text.

    The text names at most the first three failures, and makes the judgment uncovered.
    """
    def fixed(a: Column) -> Column:
        p = F.when(S.covered_mask(a["error"]), a["p"]).otherwise(S.floor_probability(floor))
        return F.struct(
            a["q_id"].alias("q_id"),
            S.hard_verdict(p).alias("answer"),
            F.bround(p, 6).alias("probability"),
        )

    failed = F.filter("atoms", lambda a: ~S.covered_mask(a["error"]))
    named = F.transform(
        F.slice(failed, 1, 3),
        lambda a: F.concat(F.lit("("), a["q_id"], F.lit(", "), a["error"], F.lit(")")),
    )
    text = F.concat(F.lit("ATOM_ERRORS: ["), F.array_join(named, ", "), F.lit("]"))
    return judgments.withColumn("answers", F.transform("atoms", fixed)).withColumn(
        "error", F.when(F.size(failed) > 0, text)
    )


def judgment_scores(atoms: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Scored atoms to one AM/GM row per judgment, in long form (no array is collected)."""
    return atoms.groupBy(*keys).agg(
        S.round4(S.soft_am_agg(F.col("p"))).alias("score_am"),
        S.round4(S.soft_gm_agg(F.col("p"))).alias("score_gm"),
        F.count(F.lit(1)).alias("n_atoms"),
        F.count_if("atom_failed").alias("n_failed_atoms"),
    )


def question_lookup(answers: DataFrame, prompts: DataFrame, questions: str) -> DataFrame:
    """Answer rows (prompt_id, q_id, ...) with question text and type, '' when unknown."""
    known = (
        prompts.select("prompt_id", F.posexplode(questions).alias("_pos", "_q"))
        .groupBy("prompt_id", F.col("_q")["q_id"].alias("q_id"))
        .agg(F.max_by("_q", "_pos").alias("_q"))  # the last question of a repeated q_id wins
        .select(
            "prompt_id",
            "q_id",
            F.col("_q")["question"].alias("question"),
            F.col("_q")["type"].alias("type"),
        )
    )
    joined = unique_join(answers, known, ["prompt_id", "q_id"], "left")
    return joined.fillna({"question": "", "type": ""})


def log_to_prompt(log: DataFrame, prompts: DataFrame, model: str | None = None) -> DataFrame:
    """Log rows (of one model) that belong to a known prompt, with the prompt's columns."""
    rows = log if model is None else log.filter(F.col("model") == model)
    return unique_join(rows, prompts, ["prompt_id"])
