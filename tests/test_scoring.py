import math
import random

import pytest
from pyspark.sql import functions as F

from rubrica.functions import scoring as S
from rubrica.functions import text as X
from rubrica.operators import judgments as J
from rubrica.schemas import ANSWER, TOP_LOGPROBS

FLOOR = math.exp(-10)


def _probs(spark, vectors):
    rows = [(i, v if v is None else [float(p) for p in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "i int, p array<double>")
    out = df.select("i", S.soft_am(F.col("p")).alias("am"), S.soft_gm(F.col("p")).alias("gm"))
    return [(r.am, r.gm) for r in out.orderBy("i").collect()]


def test_soft_scores(spark):
    got = _probs(spark, [[1, 1, 1], [], [1, 1, 0], [1, 0, 0.5], [0.99] * 4 + [0.01], [0.9, 0.8, 0.7]])
    got = [tuple(g) for g in got]
    assert got[0] == pytest.approx((1, 1))
    assert got[1] == (0.0, 0.0)
    assert got[2][1] == pytest.approx(math.exp(-10 / 3))
    assert got[3][0] == pytest.approx(0.5)
    assert got[4][0] > 0.75 and got[4][1] < 0.50
    assert got[5][1] == pytest.approx(0.504 ** (1 / 3))


def test_null_array_scores_zero(spark):
    assert _probs(spark, [None]) == [(0.0, 0.0)]


def test_gm_is_at_most_am(spark):
    rng = random.Random(0)
    vectors = [[rng.random() for _ in range(rng.randint(1, 8))] for _ in range(500)]
    assert all(gm <= am + 1e-12 for am, gm in _probs(spark, vectors))


def test_row_form_keeps_nulls_out_of_the_floor(spark):
    df = spark.createDataFrame([(0.5,), (None,), (0.5,)], "p double")
    row = df.agg(S.soft_gm_agg(F.col("p")).alias("gm"), S.soft_am_agg(F.col("p")).alias("am")).first()
    assert row.gm == pytest.approx(0.5) and row.am == pytest.approx(0.5)
    none = df.filter("p > 2").agg(S.soft_gm_agg(F.col("p")).alias("gm")).first()
    assert none.gm == 0.0


def test_atom_probability(spark):
    rows = [("yes", "0.95"), ("no", "0.1"), ("yes", None), ("no", None), (" Yep", "n/a"), (None, None)]
    df = spark.createDataFrame(rows, "a string, p string")
    got = [r[0] for r in df.select(S.atom_probability(F.col("a"), F.col("p"))).collect()]
    assert got == pytest.approx([0.95, 0.1, 1.0, FLOOR, 1.0, FLOOR])


def test_yes_probability(spark):
    tops = [
        [("No", -2.0), ("Yes", -0.1), (" maybe", -5.0)],
        [("Yes", -0.5), (" Yes", -0.1), ("No", -3.0)],
        [("yes", -0.3)],
        [("No", -0.1), ("Nope", -2.0)],
        [],
        None,
        [("Yes", None), (None, -0.1)],
    ]
    df = spark.createDataFrame([(t,) for t in tops], f"t {TOP_LOGPROBS}")
    got = [r[0] for r in df.select(S.yes_probability(F.col("t"))).collect()]
    expected = [math.exp(-0.1), math.exp(-0.1), math.exp(-0.3), FLOOR, FLOOR, FLOOR, FLOOR]
    assert got == pytest.approx(expected)


def test_filter_texts(spark):
    texts = {
        "Your prompt violates our content policy.": True,
        "safety system blocked this": True,
        "Request blocked: NSFW content": True,
        "Internal server error": False,
        "rate limit exceeded": False,
        "timeout": False,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", S.looks_like_filter(F.col("t"))).collect()}
    assert got == texts


def test_scalar_marks(spark):
    row = spark.range(1).select(
        S.score_band(F.lit(0.8)).alias("green"), S.score_band(F.lit(0.5)).alias("amber"),
        S.score_band(F.lit(0.49)).alias("red"), S.hard_verdict(F.lit(0.5)).alias("hard"),
        S.covered_mask(F.lit(" \t\n")).alias("blank"), S.display(F.lit(0.0625), 3).alias("shown"),
        S.exact_round(F.lit(0.575), 2).alias("rounded"), S.cap_dimensions(F.lit(0.2), F.lit(0.9)).alias("cap"),
    ).first()
    assert tuple(row) == ("green", "amber", "red", "yes", True, "0.062", 0.57, 0.2)


def test_unknown_category_fails(spark):
    df = spark.createDataFrame([("numeracy",), ("cooking",)], "c string")
    ids = df.select(X.prompt_id(F.lit(1), F.col("c"), F.lit(7)).alias("id"))
    known = df.filter("c = 'numeracy'").select(X.prompt_id(F.lit(1), F.col("c"), F.lit(7)).alias("id"))
    assert known.first().id == "L1_NUM_007"
    with pytest.raises(Exception, match="no id code"):
        ids.collect()


JUDGMENT = f"prompt_id string, model string, seed int, score double, score_am double, score_gm double, error string, answers array<{ANSWER}>"


def _answers(*pairs):
    return [(f"q{i}", None, "presence", None, a, p) for i, (a, p) in enumerate(pairs, 1)]


def test_resolve_scores(spark):
    rows = [
        ("explicit", "m", None, 0.1, 0.7, 0.6, None, _answers(("no", 0.0))),
        ("legacy", "m", 2, 0.9, None, None, None, _answers(("no", 0.0))),
        ("half", "m", 0, None, 0.8, None, None, _answers(("yes", 0.5), ("yes", 0.5))),
        ("derived", "m", 0, None, None, None, None, _answers(("yes", None), ("no", 0.5))),
        ("empty", "m", 0, None, None, None, "x", None),
    ]
    df = spark.createDataFrame(rows, JUDGMENT)
    got = {r.prompt_id: r for r in J.resolve_scores(df).collect()}
    assert (got["explicit"].score, got["explicit"].score_am, got["explicit"].score_gm) == (0.1, 0.7, 0.6)
    assert got["explicit"].seed == 0
    assert (got["legacy"].score_am, got["legacy"].score_gm) == (0.9, 0.9)
    assert got["half"].score_gm == pytest.approx(0.5) and got["half"].score == 0.8
    assert got["derived"].score_am == pytest.approx(0.75)
    assert got["derived"].score_gm == pytest.approx(math.sqrt(0.5))
    assert (got["empty"].score_am, got["empty"].score_gm) == (0.0, 0.0)
    edit = {r.prompt_id: r for r in J.resolve_scores_edit(df).collect()}
    assert edit["legacy"].score_am == 0.0 and edit["legacy"].score_gm == pytest.approx(FLOOR)


def test_collapse_seeds(spark):
    rows = [
        ("mixed", "m", 0, None, 0.0, 0.0, "boom", None),
        ("mixed", "m", 1, None, 0.6, 0.4, None, _answers(("yes", 0.6))),
        ("mixed", "m", 2, None, 0.8, 0.6, "  ", _answers(("yes", 0.8))),
        ("bad", "m", 1, None, 0.3, 0.3, "second", _answers(("no", 0.1))),
        ("bad", "m", 0, None, 0.3, 0.3, "first", []),
        ("one", "m", 0, None, 0.5, 0.5, None, []),
    ]
    df = J.resolve_scores(spark.createDataFrame(rows, JUDGMENT))
    got = {r.prompt_id: r for r in J.collapse_seeds(df).collect()}
    mixed, bad, one = got["mixed"], got["bad"], got["one"]
    assert mixed.score_am == pytest.approx(0.7) and mixed.score_gm == pytest.approx(0.5)
    assert mixed.seed_std_dev_am == pytest.approx(math.sqrt(0.02))
    assert (mixed.n_seeds, mixed.covered, mixed.judge_error) == (2, True, None)
    assert mixed.answers[0].probability == 0.6
    assert (bad.score_am, bad.score_gm, bad.n_seeds, bad.covered) == (0.0, 0.0, 0, False)
    assert bad.judge_error == "first" and bad.answers[0].probability == 0.1
    assert (one.seed_std_dev_am, one.answers) == (0.0, None)


def test_collapse_seeds_carries_the_answer_fields_asked_for(spark):
    rows = [("p", "m", 0, None, 0.0, 0.0, None, []), ("p", "m", 1, None, 0.6, 0.4, None, _answers(("yes", 0.6), ("no", 0.2)))]
    df = J.resolve_scores(spark.createDataFrame(rows, JUDGMENT))
    (row,) = J.collapse_seeds(df, answer_fields=["probability"]).collect()
    assert [a.asDict() for a in row.answers] == [{"probability": 0.6}, {"probability": 0.2}]
