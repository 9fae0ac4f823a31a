"""Soft-score arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LOGPROB_FLOOR = -10.0

# Answer tokens that count as a yes.
YES_TOKENS = ["Yes", " Yes", "yes", " yes", "YES", " YES"]

# Error texts that mark a content-policy block.
FILTER_MARKERS = [
    "content policy",
    "content_policy",
    "safety",
    "not allowed",
    "nsfw",
    "moderation",
    "violates",
    "blocked",
    "inappropriate",
    "unsafe",
    "prohibited",
    "sensitive_content",
    "safety_system",
]

# Record states.
SUCCESS, FILTERED, ERROR, SKIPPED = "SUCCESS", "FILTERED", "ERROR", "SKIPPED"

PASS_MARK = 0.5

# White space that stripping removes at both ends.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def floor_probability(floor: float = LOGPROB_FLOOR) -> Column:
    return F.lit(math.exp(floor))


def round4(c: Column) -> Column:
    """Score tables carry four decimals, ties to even."""
    return F.bround(c, 4)


def mean_of_rounded(c: Column, digits: int = 4) -> Column:
    """Mean of values that carry ``digits`` decimals, summed exactly so that ties stay ties."""
    exact = F.sum(c.cast(f"decimal(18,{digits})")).cast("double")
    return exact / F.when(F.count(c) > 0, F.count(c))


def soft_am(probs: Column) -> Column:
    """Arithmetic mean of an array of probabilities; nothing judged scores 0."""
    total = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.coalesce(F.size(probs), F.lit(0)) > 0, total / F.size(probs)).otherwise(0.0)


def soft_gm(probs: Column, floor: float = LOGPROB_FLOOR) -> Column:
    """Geometric mean with each probability held at exp(floor) or above; empty scores 0."""
    logs = F.aggregate(
        probs, F.lit(0.0), lambda acc, p: acc + F.ln(F.greatest(p, floor_probability(floor)))
    )
    return F.when(
        F.coalesce(F.size(probs), F.lit(0)) > 0, F.exp(logs / F.size(probs))
    ).otherwise(0.0)


def answers_am(answers: Column, floor: float = LOGPROB_FLOOR) -> Column:
    """``soft_am`` over answer structs in one pass, without an array of probabilities."""
    total = F.aggregate(
        answers,
        F.lit(0.0),
        lambda acc, a: acc + atom_probability(a["answer"], a["probability"], floor),
    )
    return F.when(F.coalesce(F.size(answers), F.lit(0)) > 0, total / F.size(answers)).otherwise(0.0)


def answers_gm(answers: Column, floor: float = LOGPROB_FLOOR) -> Column:
    """``soft_gm`` over answer structs in one pass."""
    logs = F.aggregate(
        answers,
        F.lit(0.0),
        lambda acc, a: acc
        + F.ln(
            F.greatest(
                atom_probability(a["answer"], a["probability"], floor), floor_probability(floor)
            )
        ),
    )
    return F.when(
        F.coalesce(F.size(answers), F.lit(0)) > 0, F.exp(logs / F.size(answers))
    ).otherwise(0.0)


def soft_am_agg(p: Column) -> Column:
    """``soft_am`` over rows; a group of no rows (or only NULLs) scores 0."""
    return F.coalesce(F.avg(p), F.lit(0.0))


def soft_gm_agg(p: Column, floor: float = LOGPROB_FLOOR) -> Column:
    """``soft_gm`` over rows. ``greatest`` ignores NULL, so NULLs must stay out of the log."""
    log_p = F.when(p.isNotNull(), F.ln(F.greatest(p, floor_probability(floor))))
    return F.coalesce(F.exp(F.avg(log_p)), F.lit(0.0))


def says_yes(answer: Column) -> Column:
    return F.coalesce(F.lower(strip(answer)).startswith("y"), F.lit(False))


def atom_probability(
    answer: Column, probability: Column, floor: float = LOGPROB_FLOOR
) -> Column:
    """The explicit probability when it is a number, else 1 for a yes and exp(floor) for a no."""
    return F.coalesce(
        probability.try_cast("double"),
        F.when(says_yes(answer), 1.0).otherwise(floor_probability(floor)),
    )


def answer_probabilities(answers: Column, floor: float = LOGPROB_FLOOR) -> Column:
    """Array of answer structs to array of probabilities."""
    return F.transform(
        answers, lambda a: atom_probability(a["answer"], a["probability"], floor)
    )


def yes_probability(top_logprobs: Column, floor: float = LOGPROB_FLOOR) -> Column:
    """exp of the best log-probability among the yes tokens; exp(floor) when there is none."""
    hits = F.filter(
        top_logprobs, lambda t: t["token"].isin(YES_TOKENS) & t["logprob"].isNotNull()
    )
    best = F.array_max(F.transform(hits, lambda t: t["logprob"]))
    return F.exp(F.coalesce(best, F.lit(floor)))


def normalize_verdict(answer: Column) -> Column:
    return F.when(says_yes(answer), "yes").otherwise("no")


def hard_verdict(p: Column) -> Column:
    return F.when(p >= PASS_MARK, "yes").otherwise("no")


def clean_human_answer(answer: Column) -> Column:
    return F.lower(strip(F.coalesce(answer, F.lit(""))))


def covered_mask(error: Column) -> Column:
    """A row was judged when its error is NULL or blank."""
    return strip(F.coalesce(error, F.lit(""))) == ""


def looks_like_filter(text: Column) -> Column:
    return F.lower(text).rlike("|".join(FILTER_MARKERS))


def failure_status(error: Column) -> Column:
    """State of a finished attempt from its error text."""
    return (
        F.when(covered_mask(error), SUCCESS)
        .when(looks_like_filter(error), FILTERED)
        .otherwise(ERROR)
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 0.80, "green").when(score >= 0.50, "amber").otherwise("red")


def cap_dimensions(instruction: Column, other: Column) -> Column:
    """A side dimension may not score above the instruction dimension."""
    return F.least(other, instruction)


def display(score: Column, digits: int = 3) -> Column:
    """Fixed decimals of the exact binary value, ties to even, without grouping of thousands."""
    return F.replace(F.format_number(score, digits), F.lit(","), F.lit(""))


def exact_round(c: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even."""
    return display(c, digits).cast("double")


def duration_sec(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.bround(micros / 1e6, 2)
