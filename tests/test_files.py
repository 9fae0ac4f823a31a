"""Files and tables around a run: logs, human records, bucketed judgments, rejects, one read of the judgments."""

import json

import pytest

from rubrica.operators import agreement as G
from rubrica.operators import judgments as J
from rubrica.operators import replies as RP
from rubrica.plans import evaluation as E
from rubrica.sources import readers, writers

LOG = [
    {"prompt_id": "p1", "model": "a", "status": "SUCCESS", "image_path": "x.png", "cost_usd": 0.04, "seed": 0,
     "timestamp": "2024-01-01T00:00:00Z", "raw_metadata": '{"a": 1}'},
    {"prompt_id": "p2", "model": "a", "status": "FILTERED", "error": "policy"},
    {"prompt_id": "p2", "model": "a", "status": "ERROR", "error": "500"},
]


def _lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_logs_and_human_records_from_disk(spark, tmp_path):
    log = readers.read_generation_log(spark, _lines(tmp_path / "log.jsonl", LOG)).collect()
    assert sorted(r.status for r in log) == ["ERROR", "FILTERED", "SUCCESS"]
    assert {r.raw_metadata for r in log} == {'{"a": 1}', None}
    edit = [{"prompt_id": "p", "model": "m", "status": "SUCCESS", "turn": 2, "source_image_path": "s.png"}]
    row = readers.read_generation_log(spark, _lines(tmp_path / "edit.jsonl", edit), "edit").first()
    assert (row.turn, row.source_image_path) == (2, "s.png")
    human = [{"prompt_id": "p1", "model": "a", "annotator": "x", "human_answers": [{"q_id": "q1", "answer": "yes"}]}]
    row = readers.read_human_records(spark, _lines(tmp_path / "human.jsonl", human)).first()
    assert [(a.q_id, a.answer) for a in row.human_answers] == [("q1", "yes")]
    assert readers.read_human_records(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_append_round_trip(spark, tmp_path):
    path = str(tmp_path / "appended")
    log = readers.read_generation_log(spark, _lines(tmp_path / "log.jsonl", LOG))
    for _ in range(2):
        writers.append_records(log, path)
    back = readers.read_generation_log(spark, path)
    assert back.count() == 6 and sorted(map(str, back.distinct().collect())) == sorted(map(str, log.collect()))


def _judged(tmp_path):
    folder = tmp_path / "judgments"
    folder.mkdir()
    for model, scores in {"a": [0.9, 0.4, None], "b": [0.2, 0.6, 0.5]}.items():
        rows = [
            {"prompt_id": f"p{i % 2 + 1}", "seed": i, "score": s, "error": None if s else "timeout", "image_path": "x.png",
             "answers": [{"q_id": "q1", "type": "presence", "answer": "yes" if s and s > 0.5 else "no"}]}
            for i, s in enumerate(scores)
        ]
        _lines(folder / f"{model}.jsonl", rows)
    prompts = [{"prompt_id": f"p{i}", "layer": i, "sub_category": "x", "prompt_text": "t"} for i in (1, 2)]
    (tmp_path / "prompts.json").write_text(json.dumps(prompts))
    return str(folder)


def test_run_with_a_log_and_human_records(spark, tmp_path):
    folder, out = _judged(tmp_path), str(tmp_path / "out")
    log = _lines(tmp_path / "log.jsonl", LOG)
    E.run_image_evaluation(spark, folder, str(tmp_path / "prompts.json"), log, str(tmp_path / "themes.json"), out, n_boot=50)
    rates = {r.model: r for r in spark.read.parquet(f"{out}/filter_rates").collect()}
    assert (rates["a"].filtered, rates["a"].errored) == (1, 1)
    summary = spark.read.json(f"{out}/summary_stats").first()
    assert (summary.n_models, summary.n_prompts_judged, summary.n_total_judgments) == (2, 2, 4)
    assert summary.mean_score_am_overall == pytest.approx((0.9 + 0.4 + 0.35 + 0.6) / 4, abs=1e-4)
    human = [{"prompt_id": "p2", "model": "b", "human_answers": [{"q_id": "q1", "answer": "yes"}]}]
    records = readers.read_human_records(spark, _lines(tmp_path / "human.jsonl", human))
    from pyspark.sql import functions as F

    labels = records.select("prompt_id", "model", F.inline("human_answers")).withColumnRenamed("answer", "human")
    atoms = J.explode_atoms(readers.read_judgments(spark, folder), "prompt_id", "model")
    joined = atoms.join(labels, ["prompt_id", "model", "q_id"])
    assert [(r.answer, r.human) for r in joined.collect()] == [("yes", "yes")]
    assert G is not None


def test_a_run_reads_judgments_once(spark, tmp_path):
    """All score tables and the summary from one pass over the judgments, equal to those of separate passes."""
    judgments = readers.read_judgments(spark, _judged(tmp_path))
    prompts = readers.read_prompts(spark, str(tmp_path / "prompts.json"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = judgments.mapInArrow(count, judgments.schema)
    once = E.image_tables(counted, prompts, n_boot=20, materialise=True)
    many = E.image_tables(judgments, prompts, n_boot=20)
    for name in many:
        assert sorted(map(str, once[name].collect())) == sorted(map(str, many[name].collect())), name
    assert seen.value == 6
    edit = E.edit_tables(counted, prompts, n_boot=20, materialise=True)
    plain = E.edit_tables(judgments, prompts, n_boot=20)
    for name in plain:
        assert sorted(map(str, edit[name].collect())) == sorted(map(str, plain[name].collect())), name
    assert seen.value == 12


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_judgments_need_no_shuffle(spark, tmp_path):
    judgments = readers.read_judgments(spark, _judged(tmp_path)).drop("timestamp")
    prompts = readers.read_prompts(spark, str(tmp_path / "prompts.json"))
    for _ in range(2):
        writers.append_bucketed(judgments, "bucketed_j", str(tmp_path / "j"), buckets=4)
    writers.append_bucketed(prompts, "bucketed_p", str(tmp_path / "p"), buckets=4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        collapsed = J.collapse_seeds(J.resolve_scores(spark.table("bucketed_j")))
        scores = J.attach_prompts(collapsed, spark.table("bucketed_p"))
        assert "Exchange" not in _plan(collapsed) and "Exchange" not in _plan(scores)
        twice = J.collapse_seeds(J.resolve_scores(judgments.unionByName(judgments)))
        names = ["model", "prompt_id", "score_am", "score_gm", "n_seeds", "covered"]
        assert sorted(collapsed.select(names).collect()) == sorted(twice.select(names).collect())
        assert {(r.prompt_id, r.layer) for r in scores.collect()} == {("p1", 1), ("p2", 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE bucketed_j")
        spark.sql("DROP TABLE bucketed_p")


def test_rejected_replies(spark):
    fields = {"score": "double", "note": "string"}
    good = '{"score": 0.5, "note": "x", "more": {"a": [1]}}'
    cases = {
        good: None, f"```json\n{good}\n```": None, f"Sure: {good} ok?": None, None: RP.EMPTY, " \n": RP.EMPTY,
        "none here": RP.NO_OBJECT, '{"score": 0.5, "note": "x"': RP.NO_OBJECT, "{'score': 1}": RP.MALFORMED,
        '{"score": 1,, "note": "x"}': RP.MALFORMED, f"{good} }}": RP.MALFORMED, f"{good} and {good}": RP.MALFORMED,
        '{"note": "x"}': "missing score", '{"score": null, "note": "x"}': "missing score", '{"score": 1}': "missing note",
        '{"score": "high", "note": "x"}': "wrong type score", '{"score": [1], "note": "x"}': "wrong type score",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, reply string")
    parsed = RP.parse_replies(df, "reply", fields)
    got = {r.reply: r for r in parsed.collect()}
    assert {t: r.reason for t, r in got.items()} == cases
    assert all((r.score, r.note) == ((0.5, "x") if r.reason is None else (None, None)) for r in got.values())
    assert RP.accepted(parsed).columns == ["id", "reply", "score", "note"]
    assert RP.rejected(parsed, fields).count() == sum(v is not None for v in cases.values())
    with pytest.raises(ValueError):
        RP.parse_replies(df, "reply", {"id": "int"})


def test_records_are_written_compressed(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(50).selectExpr("concat('P', id) AS prompt_id", "'m' AS model", "'SUCCESS' AS status", "cast(null AS string) AS error", "cast(id AS int) AS seed")
    writers.append_records(rows, path)
    writers.append_records(rows, path)
    names = [f.name for f in (tmp_path / "log").glob("part-*")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert readers.read_generation_log(spark, path).count() == 100
