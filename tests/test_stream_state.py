"""Streams with state against their batch forms: any split of the files, restarts, rows out of order."""

import datetime as dt
import json
import random

import pytest

from rubrica.operators import judgments as J
from rubrica.operators import scores as A
from rubrica.operators.costs import cost_ledger
from rubrica.streaming import board, jobs, ledger

JUDGED = "model STRING, prompt_id STRING, seed INT, score DOUBLE, score_am DOUBLE, score_gm DOUBLE, error STRING, answers ARRAY<STRUCT<answer: STRING, probability: DOUBLE>>"


def _write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def _judgments(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append({
            "model": rng.choice(["a", "b", "c"]), "prompt_id": f"p{rng.randint(0, 12)}", "seed": i,
            "score_am": rng.choice([0.0, 0.25, 0.5, 0.9, 1.0]), "score_gm": rng.choice([0.0, 0.1, 0.5, 1.0]),
            "error": rng.choice([None, None, " ", "timeout"]),
        })
    return rows + [{"model": "d", "prompt_id": "p", "seed": 0, "score": 0.5, "error": "gone"}]


@pytest.mark.parametrize("cuts", [[0], [5, 30], [1, 2, 60]])
def test_board_equals_the_batch_board(spark, tmp_path, cuts):
    rows = _judgments(80, len(cuts))
    src = tmp_path / "src"
    src.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        _write(src / f"{i}.json", rows[lo:hi])
        stream = J.resolve_scores(jobs.stream_files(spark, str(src), JUDGED))
        board.write_board(stream, out, state).awaitTermination()
        batch = A.leaderboard(J.collapse_seeds(J.resolve_scores(spark.read.schema(JUDGED).json(str(src)))))
        want = {r.model: r.asDict() for r in batch.collect()}
        got = {r.model: r.asDict() for r in board.read_board(spark, out).collect()}
        assert {m: {k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.items()} for m, r in want.items()} == got


def test_board_keeps_state_in_built_in_aggregates(spark, tmp_path):
    (tmp_path / "src").mkdir()
    changes = board.board_changes(J.resolve_scores(jobs.stream_files(spark, str(tmp_path / "src"), JUDGED)))
    plan = changes._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan


def _time(minute):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)).isoformat()


def _batches(spark, tmp_path, batches, run):
    src = tmp_path / "src"
    src.mkdir()
    for i, rows in enumerate(batches):
        _write(src / f"{i}.json", [{"ts": _time(m), "id": k, "amount": a} if m is not None else {"id": k, "amount": a} for m, k, a in rows])
        run(jobs.stream_files(spark, str(src), "ts TIMESTAMP_NTZ, id INT, amount DOUBLE"))


def test_ledger_over_rows_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(m, m, rng.choice([0.5, 1.0, -0.25])) for m in range(40)]
    shuffled = [rows[i] for i in sorted(range(40), key=lambda i: i + rng.randint(0, 6))]
    path, state = str(tmp_path / "ledger"), str(tmp_path / "state")

    def run(stream):
        ledger.stream_ledger(stream, path, state, 10.0, ["id"], "8 minutes").awaitTermination()

    # The last batch also brings a row that is long past and one without a time.
    batches = [shuffled[:11], shuffled[11:12], shuffled[12:30], [*shuffled[30:], (2, 99, 50.0), (None, 98, 50.0)]]
    _batches(spark, tmp_path, batches, run)
    ledger.close_ledger(spark, path, 10.0, ["id"])
    batch = spark.createDataFrame([(_time(m), k, a) for m, k, a in rows], "ts string, id int, amount double")
    batch = batch.withColumn("ts", batch.ts.cast("timestamp_ntz"))
    want = sorted(map(tuple, cost_ledger(batch, 10.0, ["ts", "id"]).collect()))
    got = sorted(tuple(r) for r in ledger.read_ledger(spark, path).select("ts", "id", "amount", "running_total", "alert", "under_cap", "may_start").collect())
    assert got == want and sum(r[4] for r in got) == 1
    assert {r.id for r in ledger.read_late(spark, path).collect()} == {98, 99}


def test_ledger_alerts_once_over_batches(spark, tmp_path):
    path, state = str(tmp_path / "ledger"), str(tmp_path / "state")

    def run(stream):
        ledger.stream_ledger(stream, path, state, 10.0, ["id"], "0 minutes").awaitTermination()

    _batches(spark, tmp_path, [[(0, 0, 9.0)], [(1, 1, -5.0)], [(2, 2, 6.0)]], run)
    rows = sorted(tuple(r)[1:] for r in ledger.read_ledger(spark, path).collect())
    assert [(r[0], r[2], r[3]) for r in rows] == [(0, 9.0, True), (1, 4.0, False), (2, 10.0, False)]


def test_alerts_forget_quiet_ledgers(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    hour = 3_600_000
    batches = [
        [("x", 0, 5.0), ("y", 3, 1.0)],
        # Out of order within the delay.
        [("x", 20, 4.0), ("x", 10, 0.5)],
        [("x", 25, 90.0), ("y", 600, 1.0)],
        # x has been quiet for hours: it starts anew.
        [("x", 610, 7.0), ("z", 605, 8.0)],
        [("x", 611, 2.0), ("y", 1400, 0.0)],
    ]
    for i, rows in enumerate(batches):
        _write(src / f"{i}.json", [{"ledger": k, "ts": _time(m) + "Z", "amount": a} for k, m, a in rows])
        stream = jobs.stream_files(spark, str(src), "ledger STRING, ts TIMESTAMP, amount DOUBLE")
        alerts = jobs.cost_alerts(stream, 10.0, idle_ms=hour, delay="30 minutes")
        jobs.append_stream(alerts, out, state).awaitTermination()
    got = sorted((r.ledger, r.total_usd) for r in spark.read.parquet(out).collect())
    assert got == [("x", 9.0), ("x", 9.5), ("z", 8.0)]


def test_routing_runs_its_input_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from rubrica.sources import writers

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(str(i), s) for i, s in enumerate(["SUCCESS", "ERROR", "FILTERED", None])]
    df = spark.createDataFrame(rows, "prompt_id string, status string").mapInArrow(count, "prompt_id string, status string")
    path = str(tmp_path / "routed")
    writers.route_failures(df, path)
    back = spark.read.json(path)
    assert {(r.sink, r.n) for r in back.groupBy("sink").agg(F.count("*").alias("n")).collect()} == {("log", 4), ("failures", 2)}
    assert seen.value == len(rows)
