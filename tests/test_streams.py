import json

from rubrica.streaming import jobs


def _write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_alert_fires_once_over_batches(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, amounts in enumerate([[3.0, 4.0], [1.5], [5.0]]):
        _write(src / f"{i}.json", [{"ledger": "all", "amount": a} for a in amounts])
        stream = jobs.stream_files(spark, str(src), "ledger STRING, amount DOUBLE")
        jobs.append_stream(jobs.cost_alerts(stream, 10.0), out, state).awaitTermination()
    alerts = spark.read.parquet(out).collect()
    assert [(r.ledger, r.total_usd) for r in alerts] == [("all", 8.5)]
    assert alerts[0].share == 0.85


def test_failures_are_routed_per_batch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    path, state = str(tmp_path / "routed"), str(tmp_path / "state")
    for i, status in enumerate(["SUCCESS", "ERROR", "FILTERED"]):
        _write(src / f"{i}.json", [{"prompt_id": str(i), "status": status}])
        stream = jobs.stream_files(spark, str(src), "prompt_id STRING, status STRING")
        jobs.stream_failures(stream, path, state).awaitTermination()
    back = spark.read.json(path)
    assert back.filter("sink = 'log'").count() == 3
    assert {r.status for r in back.filter("sink = 'failures'").collect()} == {"ERROR", "FILTERED"}


def test_redelivered_attempts_drop(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    row = {"model": "m", "prompt_id": "p", "seed": 0, "timestamp": "2024-01-01T00:00:00Z"}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(3):
        _write(src / f"{i}.json", [row, row])
        stream = jobs.stream_files(spark, str(src), "model STRING, prompt_id STRING, seed INT, timestamp TIMESTAMP")
        once = jobs.dedupe_attempts(stream, ["model", "prompt_id", "seed"])
        jobs.append_stream(once, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 1
