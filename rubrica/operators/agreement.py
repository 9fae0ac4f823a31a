"""Human validation: annotation sheets, label clean-up, judge-human agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.operators.ranking import unique_join

TARGET_KAPPA = 0.6
DEFAULT_ANNOTATOR = "unknown"


def annotation_sheet(sample: DataFrame) -> DataFrame:
    """One row per sampled image and question, the human answer left blank.

    ``sample`` carries ``questions`` and ``judge_answers`` arrays; a question the judge did not
    answer shows ''. The last judge answer of a repeated q_id is shown.
    """
    q = F.col("_q")
    matching = F.filter("judge_answers", lambda a: a["q_id"] == q["q_id"])
    shown = F.coalesce(F.try_element_at(matching, F.lit(-1))["answer"], F.lit(""))
    keep = ["prompt_id", "model", "sub_category", "image_path", "prompt_text"]
    return sample.select(*keep, "judge_answers", F.explode("questions").alias("_q")).select(
        *keep,
        q["q_id"].alias("q_id"),
        q["question"].alias("question"),
        shown.alias("judge_answer"),
        F.lit("").alias("human_answer"),
        F.lit("").alias("annotator"),
    )


def clean_human_answers(sheet: DataFrame) -> DataFrame:
    """Keep the rows a person answered with yes or no."""
    return sheet.withColumn("human_answer", S.clean_human_answer(F.col("human_answer"))).filter(
        F.col("human_answer").isin("yes", "no")
    )


def human_labels(labels: DataFrame, order: Column) -> DataFrame:
    """One label per (prompt, model, question); the last one written wins."""
    return labels.groupBy("prompt_id", "model", "q_id").agg(
        F.max_by("human_answer", order).alias("human_answer")
    )


def label_records(sheet: DataFrame, order: Column) -> DataFrame:
    """Cleaned sheet rows to one record per (prompt, model) with its answers.

    ``order`` is the position of a row in the sheet. The last label of a question wins, questions
    stand in the order of their first label, the annotator is that of the first row. Labels are
    reduced to one per question before records are built, so a record is as long as its prompt
    has questions.
    """
    named = sheet if "annotator" in sheet.columns else sheet.withColumn(
        "annotator", F.lit(DEFAULT_ANNOTATOR)
    )
    keys = ["prompt_id", "model"]
    last = named.groupBy(*keys, "q_id").agg(
        F.max_by("human_answer", order).alias("answer"),
        F.min(F.struct(order.alias("pos"), "annotator")).alias("_first"),
    )
    placed = F.array_sort(F.collect_list(F.struct(F.col("_first")["pos"].alias("pos"), "q_id", "answer")))
    return last.groupBy(*keys).agg(
        F.min("_first")["annotator"].alias("annotator"),
        F.transform(
            placed, lambda a: F.struct(a["q_id"].alias("q_id"), a["answer"].alias("answer"))
        ).alias("human_answers"),
    )


def label_rows(records: DataFrame) -> DataFrame:
    """Human records back to one row per question."""
    return records.select(
        "prompt_id", "model", "annotator", F.posexplode("human_answers").alias("pos", "_a")
    ).select(
        "prompt_id",
        "model",
        "annotator",
        "pos",
        F.col("_a")["q_id"].alias("q_id"),
        F.col("_a")["answer"].alias("human_answer"),
    )


def human_judge_pairs(atoms: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """Counted (judge answer, human answer) pairs on (prompt, model, q_id).

    Judge atoms are counted per key and answer before the join, so a key that repeats over
    many attempts crosses the network as a few counts.
    """
    keys = ["prompt_id", "model", "q_id"]
    counted = atoms.groupBy(*keys, *by, "answer").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(labels, keys, "inner").withColumnRenamed("answer", "judge_answer")


def record_agreement(records: DataFrame, labels: DataFrame, *by: str, salts: int = 4) -> DataFrame:
    """``agreement_by_record`` straight from records with an ``answers`` array, for ``by`` that name a record.

    ``by`` includes prompt_id and model. A record crosses the network once and whole instead of as one row per
    answer; it meets the labels of its prompt in one row. Records of a hot prompt are worked on by ``salts`` tasks, and
    those with equal ``by`` meet in the same one, so the last grouping needs no shuffle.
    """
    answers = F.transform("answers", lambda a: F.struct(a["q_id"].alias("q_id"), a["answer"].alias("answer")))
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int").alias("_salt")
    held = records.select(*by, answers.alias("answers"), salt)
    entries = F.map_from_entries(F.collect_list(F.struct("q_id", "human_answer")))
    known = labels.filter("q_id IS NOT NULL").groupBy("prompt_id", "model").agg(entries.alias("_labels"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = unique_join(held, known, ["prompt_id", "model", "_salt"])
    asked = F.filter("answers", lambda a: F.map_contains_key("_labels", a["q_id"]))
    agreed = F.filter("asked", lambda a: F.try_element_at("_labels", a["q_id"]) == a["answer"])
    counted = joined.withColumn("asked", asked).filter(F.size("asked") > 0)
    counted = counted.select(*by, "_salt", F.size("asked").alias("n"), F.size(agreed).alias("same"))
    return counted.groupBy(*by, "_salt").agg(
        F.sum("n").alias("n_questions"), S.round4(F.sum("same") / F.sum("n")).alias("agreement")
    ).drop("_salt")


def agreement_by_record(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.sum("n").alias("n_questions"), S.round4(_agreed() / F.sum("n")).alias("agreement")
    )


def _agreed() -> Column:
    same = F.coalesce(F.col("judge_answer") == F.col("human_answer"), F.lit(False))
    return F.sum(F.when(same, F.col("n")).otherwise(0))


def agreement(pairs: DataFrame, target: float = TARGET_KAPPA) -> DataFrame:
    """Raw agreement and kappa over all pairs, and whether kappa is above the target."""
    kappa = cohen_kappa(pairs, "judge_answer", "human_answer", weight="n")
    return kappa.select(
        "n_pairs",
        S.round4(F.col("po")).alias("raw_agreement"),
        S.round4(F.col("kappa")).alias("cohen_kappa"),
        F.lit(target).alias("target_kappa"),
        F.coalesce(F.col("kappa") > target, F.lit(False)).alias("meets_target"),
    )


def cohen_kappa(
    pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = (), weight: str | None = None
) -> DataFrame:
    """Kappa of two raters: (po - pe) / (1 - pe), NULL when pe is 1.

    The confusion table is aggregated first; everything after it has labels x labels rows.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    cells = pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(count.alias("n"))
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    agreed = F.when(F.col("a") == F.col("b"), n).otherwise(zero)
    first = F.struct(F.col("a").alias("label"), n.alias("na"), zero.alias("nb"), agreed.alias("same"))
    second = F.struct(F.col("b").alias("label"), zero.alias("na"), n.alias("nb"), zero.alias("same"))
    totals = (
        cells.select(*by, F.inline(F.array(first, second)))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("na", "nb", "same")])
        .groupBy(*by)
        .agg(
            F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"),
            F.sum("na").alias("n_pairs"),
            F.sum("same").alias("same"),
        )
        .filter("n_pairs > 0")
    )
    po = F.col("same") / F.col("n_pairs")
    pe = F.col("cross") / (F.col("n_pairs").cast("double") * F.col("n_pairs"))
    return totals.select(*by, "n_pairs", po.alias("po"), pe.alias("pe")).withColumn(
        "kappa", F.try_divide(F.col("po") - F.col("pe"), 1.0 - F.col("pe"))
    )


def unannotated(sample: DataFrame, labels: DataFrame) -> DataFrame:
    """Sample rows without a human record for their (prompt, model)."""
    done = labels.select("prompt_id", "model").distinct()
    return sample.join(done, ["prompt_id", "model"], "left_anti")


def annotation_progress(sample: DataFrame, labels: DataFrame) -> DataFrame:
    """Sampled, annotated and remaining counts, as the tool reports them."""
    annotated = labels.select(F.count_distinct("prompt_id", "model").alias("n")).scalar()
    return sample.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        annotated.alias("annotated"),
        (F.col("total") - annotated).alias("remaining"),
    )
