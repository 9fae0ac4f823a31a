"""Prompt quality: per-prompt rules, cohort rules, coverage of the category grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import text as X
from rubrica.operators.ranking import unique_join
from rubrica.operators.sampling import DIFFICULTIES

# Difficulty -> (words min, words max, atoms min, atoms max).
DIFFICULTY_BOUNDS = {
    "easy": (3, 15, 2, 3),
    "medium": (10, 30, 3, 5),
    "hard": (20, 60, 5, 8),
}

# What atoms may carry.
VALID_DIMENSIONS = ["instruction_following", "visual_consistency", "detail_preservation"]
VALID_ATOM_TYPES = [
    "instruction", "preservation", "identity", "structure", "quality", "lighting", "placement",
]
VALID_QUESTION_TYPES = ["presence", "attribute", "numeracy", "spatial", "material"]
MIN_QUESTIONS = 3

# Smallest cohort counts.
COHORT_TARGETS = {"compound": 10, "big": 6, "big_with_attribute": 5, "ordinal": 3}
BIG_COUNT = 7
SMALLEST_MAX_COUNT = 4


def _bound(i: int, difficulty: Column) -> Column:
    out = F
    for d, bounds in DIFFICULTY_BOUNDS.items():
        out = out.when(difficulty == d, bounds[i])
    return out


def prompt_warnings(prompts: DataFrame, known_images: DataFrame | None = None) -> DataFrame:
    """Long table of (prompt_id, rule, detail); a clean prompt has no row.

    ``known_images`` is a table of existing ``source_image`` names; without it that rule is off.
    An unknown difficulty is reported alone.
    """
    checked = prompts
    image_missing = F.lit(False)
    if known_images is not None:
        known = known_images.select("source_image").distinct().withColumn("_image", F.lit(True))
        checked = unique_join(prompts, known, ["source_image"], "left")
        image_missing = F.col("_image").isNull()
    instruction = F.coalesce(F.col("edit_instruction"), F.lit(""))
    rows = checked.select(
        "prompt_id",
        F.coalesce(F.col("difficulty"), F.lit("???")).alias("difficulty"),
        instruction.alias("text"),
        F.lower(instruction).alias("lower"),
        X.word_count(instruction).alias("words"),
        X.count_atomic_ops(instruction).alias("ops"),
        F.coalesce(F.col("atoms"), F.array()).alias("atoms"),
        F.coalesce(F.col("source_image"), F.lit("")).alias("source_image"),
        image_missing.alias("image_missing"),
        F.coalesce("category", "sub_category", F.lit("")).alias("category"),
        F.col("turns"),
    )
    return (
        rows.withColumn("_w", F.explode(_warnings()))
        .select("prompt_id", F.col("_w")["rule"].alias("rule"), F.col("_w")["detail"].alias("detail"))
    )


def _warning(when: Column, rule: str, detail: Column) -> Column:
    return F.when(
        when, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    )


def _warnings() -> Column:
    difficulty, lower = F.col("difficulty"), F.col("lower")
    words, n_atoms, ops = F.col("words"), F.size("atoms"), F.col("ops")
    known = difficulty.isin(*DIFFICULTY_BOUNDS)
    easy, hard = difficulty == "easy", difficulty == "hard"

    spatial = X.words_found(lower, X.COMPLEXITY_MARKERS["spatial"])
    harder_spatial = F.array_except(spatial, F.array(*[F.lit(w) for w in X.PLAIN_DIRECTIONS]))
    physics = X.words_found(lower, X.COMPLEXITY_MARKERS["physics"])
    plain_shadow = (F.size(physics) == 1) & (F.get(physics, F.lit(0)) == "shadow") & (ops <= 2)
    any_marker = F.lit(False)
    for kind in X.COMPLEXITY_MARKERS:
        any_marker = any_marker | X.has_complexity(F.col("text"), kind)

    listed = X.turn_list(F.col("turns"))
    multi = F.col("category") == "multi_turn"
    single = F.array_compact(
        F.array(
            _warning(words < _bound(0, difficulty) - 2, "too_few_words", words),
            _warning(words > _bound(1, difficulty) + 10, "too_many_words", words),
            _warning(n_atoms < _bound(2, difficulty), "too_few_atoms", n_atoms),
            _warning(n_atoms > _bound(3, difficulty) + 2, "too_many_atoms", n_atoms),
            _warning(easy & (ops > 2), "easy_many_operations", ops),
            _warning(
                easy & (F.size(harder_spatial) > 0) & ~F.contains(lower, F.lit("flip")),
                "easy_spatial", F.array_join(harder_spatial, ","),
            ),
            _warning(
                easy & (F.size(physics) > 0) & ~plain_shadow, "easy_physics",
                F.array_join(physics, ","),
            ),
            _warning(hard & ~any_marker, "hard_without_markers", F.lit("")),
            _warning(F.col("image_missing"), "source_image_missing", F.col("source_image")),
            _warning(multi & listed.isNull(), "turns_not_a_list", F.lit("")),
            _warning(multi & (F.size(listed) < 2), "too_few_turns", F.size(listed)),
            _warning(
                ~F.exists("atoms", lambda a: F.coalesce(a["type"], F.lit("")) == "instruction"),
                "no_instruction_atom", F.lit(""),
            ),
        )
    )
    per_atom = F.flatten(
        F.array(
            _bad_atoms("dimension", VALID_DIMENSIONS, "invalid_dimension"),
            _bad_atoms("type", VALID_ATOM_TYPES, "invalid_type"),
        )
    )
    unknown = F.array(
        F.struct(F.lit("unknown_difficulty").alias("rule"), difficulty.alias("detail"))
    )
    return F.when(known, F.concat(single, per_atom)).otherwise(unknown)


def _bad_atoms(field: str, valid: list[str], rule: str) -> Column:
    bad = F.filter("atoms", lambda a: ~F.coalesce(a[field], F.lit("")).isin(*valid))
    return F.transform(
        bad,
        lambda a: F.struct(
            F.lit(rule).alias("rule"),
            F.concat_ws(":", a["q_id"], F.coalesce(a[field], F.lit(""))).alias("detail"),
        ),
    )


def warning_stats(prompts: DataFrame, warnings: DataFrame) -> DataFrame:
    """Totals: prompts, clean, with warnings, warnings."""
    per_prompt = warnings.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per_prompt.agg(
        F.count(F.lit(1)).alias("with_warnings"), F.sum("n").alias("warnings")
    )
    total = prompts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.select(
        total.alias("total"),
        (total - F.col("with_warnings")).alias("clean"),
        "with_warnings",
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
    )


def coverage_matrix(prompts: DataFrame) -> DataFrame:
    """category x difficulty counts with row totals and a TOTAL row.

    A prompt without a category counts under '???'. Row totals add the three difficulties, the
    grand total every difficulty that occurs. ``is_total`` marks the TOTAL row.
    """
    named = prompts.withColumn("category", F.coalesce("category", F.lit("???")))
    cells = named.groupBy("category", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    by_difficulty = [
        F.coalesce(F.sum(F.when(F.col("difficulty") == d, F.col("n"))), F.lit(0)).alias(d)
        for d in DIFFICULTIES
    ]
    return (
        cells.rollup("category")
        .agg(*by_difficulty, F.sum("n").alias("_n"), F.grouping("category").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("category")).alias("category"),
            *DIFFICULTIES,
            F.when(F.col("_all") == 1, F.coalesce("_n", F.lit(0)))
            .otherwise(F.col("easy") + F.col("medium") + F.col("hard"))
            .alias("total"),
            (F.col("_all") == 1).alias("is_total"),
        )
    )


def coverage_gaps(matrix: DataFrame, min_per_cell: int = 3) -> DataFrame:
    """(category, difficulty, n) cells of present categories with fewer than the minimum."""
    cells = F.array(
        *[F.struct(F.lit(d).alias("difficulty"), F.col(d).alias("n")) for d in DIFFICULTIES]
    )
    return (
        matrix.filter("NOT is_total")
        .select("category", F.explode(cells).alias("_c"))
        .select("category", F.col("_c")["difficulty"].alias("difficulty"), F.col("_c")["n"].alias("n"))
        .filter(F.col("n") < min_per_cell)
    )


def group_distribution(prompts: DataFrame, path: str = "source_image") -> DataFrame:
    group = X.image_group(F.coalesce(F.col(path), F.lit("")))
    return prompts.groupBy(group.alias("image_group")).agg(F.count(F.lit(1)).alias("n"))


def question_shape_violations(prompts: DataFrame) -> DataFrame:
    """(prompt_id, rule, detail): fewer than three questions, or a type out of the list."""
    qs = F.col("atomic_questions")
    few = F.array_compact(
        F.array(_warning(F.size(qs) < MIN_QUESTIONS, "too_few_questions", F.size(qs)))
    )
    bad = F.transform(
        F.filter(qs, lambda q: ~F.coalesce(q["type"], F.lit("")).isin(*VALID_QUESTION_TYPES)),
        lambda q: F.struct(
            F.lit("invalid_question_type").alias("rule"),
            F.coalesce(q["type"], F.lit("")).alias("detail"),
        ),
    )
    return prompts.select("prompt_id", F.explode(F.concat(few, bad)).alias("_w")).select(
        "prompt_id", F.col("_w")["rule"].alias("rule"), F.col("_w")["detail"].alias("detail")
    )


def prompt_traits(prompts: DataFrame) -> DataFrame:
    """The counts the cohort rules are made of, one row per prompt."""
    qs = F.col("atomic_questions")
    return prompts.select(
        "prompt_id",
        "sub_category",
        "difficulty",
        X.type_count(qs, "numeracy").alias("n_numeracy"),
        X.type_count(qs, "spatial").alias("n_spatial"),
        X.type_count(qs, "material").alias("n_material"),
        F.array_max(X.exactly_counts(qs)).alias("max_exact"),
        X.has_color_attribute(qs).alias("has_color"),
        X.has_attribute_binding(qs).alias("has_binding"),
        X.is_ordinal(F.col("prompt_text")).alias("ordinal"),
    )


def prompt_rule_violations(traits: DataFrame) -> DataFrame:
    """Per-prompt cohort rules for numeracy and complex prompts."""
    numeracy = F.col("sub_category") == "numeracy"
    complex_ = F.col("sub_category") == "complex_compositions"
    level, num, spat = F.col("difficulty"), F.col("n_numeracy"), F.col("n_spatial")
    got = F.concat_ws(
        ",", num, spat, F.col("n_material"), F.col("has_color").cast("int")
    )
    rules = F.array_compact(
        F.array(
            _warning(numeracy & F.col("max_exact").isNull(), "no_exact_count", F.lit("")),
            _warning(
                numeracy & (F.col("max_exact") < SMALLEST_MAX_COUNT), "max_count_too_small",
                F.col("max_exact"),
            ),
            _warning(complex_ & (level == "easy") & (num == 0) & (spat == 0), "easy_unbound", got),
            _warning(
                complex_ & (level == "medium") & ((num < 1) | (spat < 1)), "medium_too_simple", got
            ),
            _warning(
                complex_ & (level == "hard")
                & ((num < 2) | (spat < 1) | (F.col("n_material") < 1) | ~F.col("has_color")),
                "hard_too_simple", got,
            ),
        )
    )
    return traits.select("prompt_id", F.explode(rules).alias("_w")).select(
        "prompt_id", F.col("_w")["rule"].alias("rule"), F.col("_w")["detail"].alias("detail")
    )


def cohort_counts(traits: DataFrame) -> DataFrame:
    """One row of numeracy cohort counts."""
    big = F.coalesce(F.col("max_exact") >= BIG_COUNT, F.lit(False))
    return traits.filter("sub_category = 'numeracy'").agg(
        F.count_if(F.col("n_numeracy") >= 2).alias("compound"),
        F.count_if(big).alias("big"),
        F.count_if(big & F.col("has_binding")).alias("big_with_attribute"),
        F.count_if("ordinal").alias("ordinal"),
    )


def cohort_violations(traits: DataFrame) -> DataFrame:
    """(rule, n, needed) for every cohort count below its target."""
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("rule"), F.col(k).alias("n"), F.lit(v).alias("needed"))
            for k, v in COHORT_TARGETS.items()
        ]
    )
    return cohort_counts(traits).select(F.inline(cells)).filter("n < needed")


def cohort_distribution(traits: DataFrame) -> DataFrame:
    """Numeracy prompts per bucket of their largest exact count."""
    top = F.coalesce(F.col("max_exact"), F.lit(0))
    bucket = (
        F.when(top >= BIG_COUNT, "7+")
        .when(top.isin(4, 5, 6), top.cast("string"))
        .otherwise(f"<{SMALLEST_MAX_COUNT}")
    )
    return (
        traits.filter("sub_category = 'numeracy'")
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def layer_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def difficulty_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("sub_category", "difficulty").agg(F.count(F.lit(1)).alias("n"))


def question_type_counts(prompts: DataFrame) -> DataFrame:
    return (
        prompts.select(F.explode("atomic_questions.type").alias("q_type"))
        .groupBy("q_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
