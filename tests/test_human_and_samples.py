import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.operators import agreement as H
from rubrica.operators import bootstrap as B
from rubrica.operators import chains as N
from rubrica.operators import costs as C
from rubrica.operators import judgments as J
from rubrica.operators import ranking as K
from rubrica.operators import sampling as M
from rubrica.operators import weighted as G
from rubrica.sources import readers, writers


def _pairs(spark, a, b, c, d):
    rows = [("yes", "yes")] * a + [("yes", "no")] * b + [("no", "yes")] * c + [("no", "no")] * d
    return spark.createDataFrame(rows, "a string, b string")


def test_kappa(spark):
    row = H.cohen_kappa(_pairs(spark, 20, 5, 10, 15), "a", "b").first()
    assert (row.n_pairs, row.po, row.pe, row.kappa) == (50, 0.7, 0.5, pytest.approx(0.4))
    assert H.cohen_kappa(_pairs(spark, 9, 0, 0, 0), "a", "b").first().kappa is None
    assert H.cohen_kappa(_pairs(spark, 0, 0, 0, 0), "a", "b").count() == 0


def test_agreement_last_label_wins(spark):
    labels = spark.createDataFrame(
        [("p", "m", "q1", "no", 1), ("p", "m", "q1", "yes", 2), ("p", "m", "q9", "yes", 1)],
        "prompt_id string, model string, q_id string, human_answer string, pos int",
    )
    atoms = spark.createDataFrame(
        [("p", "m", "q1", "yes", 0), ("p", "m", "q1", "no", 1), ("p", "m", "q2", "yes", 0)],
        "prompt_id string, model string, q_id string, answer string, seed int",
    )
    pairs = H.human_judge_pairs(atoms, H.human_labels(labels, F.col("pos")), "seed")
    got = H.agreement(pairs).first()
    assert (got.n_pairs, got.raw_agreement, got.meets_target) == (2, 0.5, False)
    per = {r.seed: r.agreement for r in H.agreement_by_record(pairs, "prompt_id", "model", "seed").collect()}
    assert per == {0: 1.0, 1: 0.0}


def test_sheet_round_trip(spark, tmp_path):
    sample = spark.createDataFrame(
        [("p", "m", "c", "i.png", 'say "hi",\nthen go', [("q1", "One?", "presence"), ("q2", "Two?", "presence")], [("q1", "no"), ("q1", "yes")])],
        "prompt_id string, model string, sub_category string, image_path string, prompt_text string, "
        "questions array<struct<q_id:string,question:string,type:string>>, judge_answers array<struct<q_id:string,answer:string>>",
    )
    sheet = H.annotation_sheet(sample)
    assert {(r.q_id, r.judge_answer) for r in sheet.collect()} == {("q1", "yes"), ("q2", "")}
    filled = sheet.withColumn("human_answer", F.when(F.col("q_id") == "q1", " YES ").otherwise("dunno"))
    writers.write_annotation_sheet(filled, str(tmp_path / "sheet"))
    back = readers.import_annotation_sheet(spark, str(tmp_path / "sheet"))
    assert [(r.q_id, r.human_answer, r.prompt_text) for r in back.collect()] == [("q1", "yes", 'say "hi",\nthen go')]
    record = H.label_records(back.drop("annotator"), F.col("pos")).first()
    assert record.annotator == "unknown" and record.human_answers[0].answer == "yes"
    assert H.annotation_progress(sample, back).first().remaining == 0


def test_last_label_wins_in_sheet_order(spark):
    rows = [(0, "q2", "yes", "ann"), (1, "q1", "yes", "bob"), (2, "q1", "no", "bob"), (3, "q2", "yes", "ann")]
    sheet = spark.createDataFrame(rows, "pos int, q_id string, human_answer string, annotator string")
    sheet = sheet.selectExpr("*", "'p' AS prompt_id", "'m' AS model").repartition(3)
    record = H.label_records(sheet, F.col("pos")).first()
    assert record.annotator == "ann"
    assert [(a.q_id, a.answer) for a in record.human_answers] == [("q2", "yes"), ("q1", "no")]
    many = spark.range(5000).selectExpr("id AS pos", "'p' AS prompt_id", "'m' AS model", "concat('q', id) AS q_id", "'yes' AS human_answer")
    assert [len(r.human_answers) for r in H.label_records(many, F.col("pos")).collect()] == [5000]


def _skewed(spark, n=3000):
    """A third of all rows in one group, a group of one, and a NULL group."""
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id = 1 THEN 'single' WHEN id % 7 = 1 THEN NULL ELSE concat('g', id % 40) END AS g",
        "cast(id % 5 AS double) AS v",
    )


def test_ranks_equal_brute_force(spark):
    df = _skewed(spark)
    pdf = df.toPandas()
    pdf["g"] = pdf["g"].fillna("~null")
    pdf = pdf.sort_values(["v", "id"])
    pdf["want"] = pdf.groupby("g").cumcount() + 1
    want = dict(zip(pdf["id"], pdf["want"]))
    got = K.rank_within(df, ["g"], ["v", "id"], blocks=7)
    assert {r.id: r["rank"] for r in got.collect()} == want
    hashed = K.hash_rank(df, ["g"], ["id"], 1).toPandas()
    hashed["g"] = hashed["g"].fillna("~null")
    for _, part in hashed.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert set(part["group_rows"]) == {len(part)}
    low = K.lowest_hashes(df, ["g"], ["id"], F.lit(10), 1).toPandas()
    expected = hashed[hashed["rank"] <= 10]
    assert set(low["id"]) == set(expected["id"])


def test_top_n_beyond_the_pruned_limit(spark):
    df = _skewed(spark, 6000)
    got = K.top_n(df, ["g"], ["id"], 1500).groupBy("g").count().toPandas()
    assert got["count"].max() == 1500


def test_running_total(spark):
    df = _skewed(spark)
    got = {r.id: r.running for r in K.running_total(df, "v", ["id"], blocks=5).collect()}
    want = np.cumsum([i % 5 for i in range(3000)])
    assert all(got[i] == want[i] for i in range(3000))


def test_salted_join(spark):
    left = _skewed(spark).filter("g IS NOT NULL")
    right = left.select("g").distinct().withColumn("w", F.lit(1))
    assert K.salted_join(left, right, ["g"], ["id"]).count() == left.count()


def test_question_and_prompt_joins_broadcast_nothing(spark, tmp_path):
    answers = _skewed(spark).selectExpr("g AS prompt_id", "'q1' AS q_id", "id")
    prompts = spark.sql("SELECT 'hot' AS prompt_id, array(named_struct('q_id', 'q1', 'question', 'Why?', 'type', 't')) AS questions")
    prompts.write.parquet(str(tmp_path / "prompts"))
    prompts = spark.read.parquet(str(tmp_path / "prompts"))
    log = answers.withColumn("model", F.lit("m"))
    for joined in (J.question_lookup(answers, prompts, "questions"), J.log_to_prompt(log, prompts, "m")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "_salt" not in plan
    found = J.question_lookup(answers, prompts, "questions").groupBy("prompt_id", "question").count().collect()
    want = {r.prompt_id: r["count"] for r in answers.groupBy("prompt_id").count().collect()}
    assert {r.prompt_id: r["count"] for r in found} == want
    assert {r.question for r in found if r.prompt_id == "hot"} <= {"Why?"} and {r.question for r in found if r.prompt_id != "hot"} == {""}


def test_stratified_sample(spark):
    def texts(n):
        return spark.range(n).selectExpr("id", "repeat('x', cast(id % 11 AS int)) AS t")

    assert M.stratified_sample(texts(30), "t", ["id"], 9).select("id").distinct().count() == 9
    assert M.stratified_sample(texts(3), "t", ["id"], 10).count() == 3
    a = {r.id for r in M.stratified_sample(texts(50), "t", ["id"], 10, seed=5).collect()}
    b = {r.id for r in M.stratified_sample(texts(50), "t", ["id"], 10, seed=5).collect()}
    assert a == b and len(a) == 10
    per = {r.stratum: r["count"] for r in M.stratified_sample(texts(50), "t", ["id"], 10).groupBy("stratum").count().collect()}
    assert per == {0: 3, 1: 3, 2: 4}


def test_annotation_sample_quota(spark):
    rows = spark.range(100).selectExpr(
        "id", "CASE WHEN id < 75 THEN 'a' ELSE 'b' END AS model", "'c' AS sub_category",
        "CASE WHEN id % 25 = 0 THEN '' ELSE 'x.png' END AS image_path",
    )
    got = {r.model: r["count"] for r in M.annotation_sample(rows, ["id"]).groupBy("model").count().collect()}
    assert got == {"a": 7, "b": 2}


def test_quotas_and_split(spark):
    assert M.group_quotas(165) == {"person": 67, "object": 49, "scene": 33, "style": 16}
    split = M.hash_split(spark.range(10), ["id"]).groupBy("layer").count().collect()
    assert {r.layer: r["count"] for r in split} == {1: 7, 2: 3}


def test_balanced_limit(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "id int, c string")
    got = M.balanced_limit(df, "c", ["id"], 6).collect()
    assert {r.id for r in got} == {0, 1, 2, 3, 8, 9}
    assert {r.id for r in M.balanced_limit(df, "c", ["id"], 1).collect()} == {0}


VALUES = [0.70, 0.75, 0.80, 0.82, 0.85, 0.88, 0.90, 0.95]


def test_bootstrap_interval(spark):
    rows = [("m", i, v) for i, v in enumerate(VALUES)] + [("m", 99, None), ("one", 0, 0.5), (None, 0, 0.5), ("none", 0, None)]
    df = spark.createDataFrame(rows, "model string, i int, v double")
    got = {r.model: r for r in B.bootstrap_ci(df, "model", "v", "i", n_boot=4000).collect()}
    again = {r.model: r for r in B.bootstrap_ci(df.repartition(3), "model", "v", "i", n_boot=4000).collect()}
    m = got["m"]
    assert m.ci_lower < np.mean(VALUES) < m.ci_upper
    assert (m.ci_lower, m.ci_upper) == pytest.approx((again["m"].ci_lower, again["m"].ci_upper), abs=1e-12)
    rng = np.random.default_rng(0)
    brute = np.percentile([rng.choice(VALUES, 8).mean() for _ in range(4000)], [2.5, 97.5])
    assert (m.ci_lower, m.ci_upper) == pytest.approx(tuple(brute), abs=0.015)
    assert (got["one"].ci_lower, got["one"].ci_upper) == (0.5, 0.5)
    assert (got[None].ci_lower, got[None].ci_upper) == (0.5, 0.5)
    assert (got["none"].ci_lower, got["none"].ci_upper) == (None, None)
    gm = B.bootstrap_ci(df, "model", "v", "i", "gm", n_boot=1000).filter("model = 'm'").first()
    assert 0 < gm.ci_lower < gm.ci_upper <= 1


def test_bootstrap_agrees_with_resampling(spark):
    df = spark.range(400).selectExpr("'m' AS model", "id", "(id % 97) / 100 AS v")
    values = np.array([(i % 97) / 100 for i in range(400)])
    rng = np.random.default_rng(0)
    brute = np.percentile([rng.choice(values, 400).mean() for _ in range(2000)], [2.5, 97.5])
    row = B.bootstrap_ci(df, "model", "v", "id", n_boot=2000).first()
    assert (row.ci_lower, row.ci_upper) == pytest.approx(tuple(brute), abs=0.005)


def test_bootstrap_weights_are_poisson():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**32, 500, dtype=np.uint32) for _ in range(2))
    w = B.poisson_weights(a, b, np.arange(4000, dtype=np.uint32)).astype(float)
    share = [np.mean(w == k) for k in range(6)]
    assert share == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131, 0.01533, 0.00307], abs=0.002)
    between = np.corrcoef(w[:50])[np.triu_indices(50, 1)]
    assert abs(between.mean()) < 0.005 and np.abs(between).max() < 0.25
    assert len(B.POISSON_STEPS) == 12 and B.POISSON_STEPS == sorted(B.POISSON_STEPS)


def test_costs(spark):
    costs = spark.createDataFrame(
        [(1, 7.0, "flux", "generation"), (2, 1.5, "bria", "editing"), (3, 0.5, "flux", "generation"), (4, 2.0, "flux", "generation")],
        "t int, amount double, model string, stage string",
    )
    ledger = [tuple(r) for r in C.cost_ledger(costs, 10.0, ["t"]).orderBy("t").select("running_total", "alert", "under_cap", "may_start").collect()]
    assert ledger == [(7.0, False, True, True), (8.5, True, True, True), (9.0, False, True, True), (11.0, False, False, True)]
    summary = {(r.model, r.stage): r.total_usd for r in C.cost_summary(costs).collect()}
    assert summary == {(None, None): 11.0, ("flux", None): 9.5, ("bria", None): 1.5, (None, "generation"): 9.5, (None, "editing"): 1.5}


def test_chains(spark):
    log = spark.createDataFrame(
        [
            ("m", "p", 1, "SUCCESS", "a.png", "s1", 0), ("m", "p", 1, "SUCCESS", "b.png", "s2", 1),
            ("m", "q", 1, "SUCCESS", "q1.png", "s", 2), ("m", "q", 2, "ERROR", None, None, 3), ("m", "q", 3, "SUCCESS", "q3.png", None, 4),
        ],
        "model string, prompt_id string, turn int, status string, image_path string, source_image_path string, pos int",
    )
    final = {r.prompt_id: r for r in N.final_turn(log, F.col("pos")).collect()}
    assert (final["p"].image_path, final["p"].source_image_path) == ("a.png", "s2")
    assert (final["q"].turn, final["q"].image_path) == (3, "q3.png")
    status = {r.turn: r for r in N.chain_status(log).filter("prompt_id = 'q'").collect()}
    assert status[2].source_image_path == "q1.png" and status[3].after_break and not status[2].after_break
    done = {r.prompt_id: r.complete for r in N.chain_completion(log).collect()}
    assert done == {"p": True, "q": False}


def test_weighted_score(spark):
    rows = [("m", "c", "s", 1, 2.0, 1.0), ("m", "c", "s", 1, 1.0, 0.5), ("m", "c", "s", 1, 1.0, None), ("m", "c", "s", 2, 1.0, None)]
    rows += [("m", "c", "other", 1, 1.0, 5000.0)]
    df = spark.createDataFrame(rows, "model string, category string, subcategory string, source_id int, weight double, score double")
    got = {(r.subcategory, r.source_id): r.score for r in G.weighted_score(df).collect()}
    assert got == {("s", 1): 0.83, ("s", 2): 0.0, ("other", 1): 5000.0}


def test_one_alert_when_the_total_falls_and_rises(spark):
    costs = spark.createDataFrame([(1, 9.0), (2, -3.0), (3, 4.0)], "t int, amount double")
    rows = C.cost_ledger(costs, 10.0, ["t"]).orderBy("t").collect()
    assert [r.alert for r in rows] == [True, False, False]
    assert [r.may_start for r in rows] == [True, True, True]


def test_unparsed_reply_leaves_its_item_out(spark):
    questions = spark.createDataFrame([("c", "s", 1, "1", 1.0)], "category string, subcategory string, source_id int, id string, weight double")
    replies = spark.createDataFrame(
        [("m", "c", "s", 1, None), ("n", "c", "s", 1, {"1": 0.8}), ("n", "c", "t", 1, {"1": 0.1})],
        "model string, category string, subcategory string, source_id int, scores map<string,double>",
    )
    got = G.weighted_score(G.answered_questions(questions, replies)).collect()
    assert [(r.model, r.score) for r in got] == [("n", 0.8)]


def test_record_agreement_equals_pairs(spark):
    answer = "array<struct<q_id: string, answer: string>>"
    records = spark.createDataFrame(
        [("r1", "p", "m", [("q1", "yes"), ("q2", None), ("q2", "no")]), ("r1", "p", "m", [("q1", "no")]), ("r2", "p", "m", [("q9", "yes")]),
         ("r3", "p", "m", []), ("r4", None, "m", [("q1", "yes")]), ("r5", "p", "m", [(None, "yes"), ("q1", "yes")]), ("r6", "p", "m", None)],
        f"rec_id string, prompt_id string, model string, answers {answer}",
    )
    labels = spark.createDataFrame(
        [("p", "m", "q1", "yes"), ("p", "m", "q2", "no"), ("p", "m", None, "yes"), (None, "m", "q1", "yes")],
        "prompt_id string, model string, q_id string, human_answer string",
    )
    by = ["rec_id", "prompt_id", "model"]
    atoms = records.select(*by, F.inline("answers"))
    want = H.agreement_by_record(H.human_judge_pairs(atoms, labels, "rec_id"), *by)
    got = H.record_agreement(records, labels, *by)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(rec_id") == 0
