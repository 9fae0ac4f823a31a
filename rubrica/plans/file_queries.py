"""Queries that pass whole tables through files and streams in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rubrica import schemas
from rubrica.operators import judgments as J
from rubrica.operators import scores as A
from rubrica.plans import bindings as b
from rubrica.plans.evaluation import edit_tables, image_tables, summary_document
from rubrica.plans.registry import ORACLES, query
from rubrica.plans.report_queries import CAP
from rubrica.plans.score_queries import BOARD, LAYERS, PER_SUB, merged
from rubrica.session import scratch_path
from rubrica.sources import readers, writers
from rubrica.streaming import board, jobs, ledger

_PER_MODEL = "SELECT model, count(*) AS n, round_even(avg(score_am), 6) AS am, round_even(avg(score_gm), 6) AS gm FROM j GROUP BY model"


def _judgment_rows(spark, d):
    return b.judgments(spark, d).select(
        "prompt_id", "model", "image_path", F.lit("judge").alias("judge_model"), "answers", "score",
        "score_am", "score_gm", "error", "seed",
    )


def _judgment_files(spark, d):
    path = scratch_path(spark, "judgments")
    writers.append_records(_judgment_rows(spark, d), path, partition_by="model")
    return path


@query("read_judgments", f"WITH {b.RESOLVED} {_PER_MODEL}")
def read_judgments(spark, d):
    """JSON lines written per model, read back with the fixed schema and scored."""
    back = J.resolve_scores(readers.read_judgment_table(spark, _judgment_files(spark, d)))
    return back.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("score_am"), 6).alias("am"),
        F.bround(F.avg("score_gm"), 6).alias("gm"),
    )


@query(
    "append_records",
    f"WITH {b.LOG} SELECT model, status, 2 * count(*) AS n FROM log GROUP BY ALL",
)
def append_records(spark, d):
    """The log appended twice to one folder."""
    path = scratch_path(spark, "appended")
    rows = b.log(spark, d).select("prompt_id", "model", "status", "error", "seed")
    for _ in range(2):
        writers.append_records(rows, path)
    back = readers.read_generation_log(spark, path)
    return back.groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


_ROUTED = f"""WITH {b.LOG} SELECT 'log' AS sink, status, count(*) AS n FROM log GROUP BY ALL
  UNION ALL SELECT 'failures', status, count(*) FROM log WHERE status IN ('FILTERED', 'ERROR') GROUP BY ALL"""


def _routed(spark, path):
    rows = spark.read.schema(f"{schemas.GENERATION}, sink STRING").json(path)
    return rows.groupBy("sink", "status").agg(F.count(F.lit(1)).alias("n"))


@query("route_failures", _ROUTED)
def route_failures(spark, d):
    path = scratch_path(spark, "routed")
    rows = b.log(spark, d).select("prompt_id", "model", "status", "error", "seed")
    writers.route_failures(rows, path)
    return _routed(spark, path)


@query("write_score_tables", f"{BOARD} SELECT model, overall_gm_covered, coverage_rate FROM board")
def write_score_tables(spark, d):
    """Leaderboard and cells written as tables, read back from the CSV export."""
    path = scratch_path(spark, "scores")
    scores = merged(spark, d).drop("answers", "judge_error")
    board = A.leaderboard(scores).select([c.split(" ")[0] for c in schemas.LEADERBOARD.split(", ")])
    writers.write_score_tables(
        {"leaderboard": board, "cells": A.breakdown(scores, "sub_category")}, path, csv=True
    )
    back = readers.read_score_table(spark, f"{path}/leaderboard_csv", schemas.LEADERBOARD)
    return back.select("model", "overall_gm_covered", "coverage_rate")


@query(
    "write_summary",
    f"""{BOARD}, top AS (SELECT model FROM board ORDER BY overall_gm_covered DESC, model LIMIT 1)
        SELECT (SELECT count(DISTINCT model) FROM s) AS n_models, (SELECT count(DISTINCT prompt_id) FROM s) AS n_prompts_judged,
          (SELECT count(*) FROM s) AS n_total_judgments, (SELECT model FROM top) AS first_model""",
)
def write_summary(spark, d):
    """The summary document written as JSON and read back."""
    path = scratch_path(spark, "summary")
    tables = image_tables(
        b.judgments(spark, d), b.prompts(spark, d), b.log(spark, d), n_boot=0, tie="rec_id",
        categories=b.SUB_CATEGORIES, materialise=True,
    )
    writers.write_summary(summary_document(tables), path)
    back = spark.read.schema(
        "n_models BIGINT, n_prompts_judged BIGINT, n_total_judgments BIGINT, leaderboard_top3 STRING"
    ).json(path)
    first = F.get_json_object("leaderboard_top3", "$[0].model")
    return back.select("n_models", "n_prompts_judged", "n_total_judgments", first.alias("first_model"))


_CELL_TABLES = "leaderboard layer_comparison per_subcategory".split()


@query(
    "bundle_report_cells",
    f"""{BOARD}, per_sub AS (WITH {PER_SUB}), {LAYERS},
        u AS (SELECT 'leaderboard' AS tbl, * FROM (UNPIVOT (SELECT model, COLUMNS(* EXCLUDE (model))::DOUBLE FROM board) ON COLUMNS(* EXCLUDE (model)) INTO NAME col VALUE v)
          UNION ALL SELECT 'layer_comparison', * FROM (UNPIVOT (SELECT model, COLUMNS(* EXCLUDE (model))::DOUBLE FROM layers) ON COLUMNS(* EXCLUDE (model)) INTO NAME col VALUE v)
          UNION ALL SELECT 'per_subcategory', * FROM (UNPIVOT (SELECT model, COLUMNS(* EXCLUDE (model))::DOUBLE FROM per_sub) ON COLUMNS(* EXCLUDE (model)) INTO NAME col VALUE v))
        SELECT tbl, model, col, v FROM u""",
)
def bundle_report_cells(spark, d):
    """Every cell of the bundled JSON document, parsed back."""
    from rubrica.plans.report_queries import bundle_report

    row = bundle_report(spark, d)
    cells = None
    for name in _CELL_TABLES:
        rows = F.explode(F.from_json(name, "ARRAY<MAP<STRING, STRING>>")).alias("r")
        part = row.select(F.lit(name).alias("tbl"), rows).select(
            "tbl", F.col("r")["model"].alias("model"), F.explode("r").alias("col", "v")
        )
        cells = part if cells is None else cells.unionByName(part)
    return cells.filter("col <> 'model'").select("tbl", "model", "col", F.col("v").cast("double").alias("v"))


@query(
    "bucketed_scores",
    f"WITH {b.SCORES} SELECT model, prompt_id, round_even(score_am, 6) AS score_am, round_even(score_gm, 6) AS score_gm, "
    "n_seeds, covered, layer, sub_category FROM s",
)
def bucketed_scores(spark, d):
    """Judgments of two runs appended to a bucketed table, collapsed and joined to bucketed prompts without a shuffle."""
    name = uuid.uuid4().hex
    rows = _judgment_rows(spark, d)
    odd = F.col("seed") % 2 == 1
    path = scratch_path(spark, "bucketed")
    for run in (rows.filter(odd), rows.filter(~odd)):
        writers.append_bucketed(run, f"judgments_{name}", path)
    writers.append_bucketed(b.prompts(spark, d), f"prompts_{name}", scratch_path(spark, "bucketed-prompts"))
    judged = J.resolve_scores(spark.table(f"judgments_{name}"))
    scores = J.attach_prompts(J.collapse_seeds(judged), spark.table(f"prompts_{name}"))
    return scores.select(
        "model", "prompt_id", *[F.bround(c, 6).alias(c) for c in ("score_am", "score_gm")], "n_seeds", "covered",
        "layer", "sub_category",
    )


# Round trips of the input formats ----------------------------------------------------------------

@query(
    "read_prompts",
    f"""WITH {b.QUESTIONS} SELECT qp.prompt_id, layer, sub_category, difficulty, prompt_text, count(q_id) AS n_questions,
          string_agg(type, ',' ORDER BY q_id) AS types
        FROM qp LEFT JOIN qs USING (prompt_id) GROUP BY ALL""",
)
def read_prompts(spark, d):
    """Prompts written as files of JSON arrays, a hundred or so in each, and read back."""
    path = scratch_path(spark, "prompts")
    prompts = b.question_prompts(spark, d)
    files = F.greatest(F.ceil(prompts.agg(F.count(F.lit(1))).scalar() / 100), F.lit(1))
    dealt = prompts.withColumn("file", F.pmod(F.xxhash64("prompt_id"), files))
    arrays = dealt.groupBy("file").agg(F.to_json(F.collect_list(F.struct(*prompts.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = readers.read_prompts(spark, path, f"{path}-absent")
    kinds = F.transform(F.array_sort("atomic_questions", lambda x, y: F.when(x["q_id"] < y["q_id"], -1).otherwise(1)), lambda q: q["type"])
    return back.select(
        "prompt_id", "layer", "sub_category", "difficulty", "prompt_text",
        F.size("atomic_questions").cast("bigint").alias("n_questions"),
        F.when(F.size("atomic_questions") > 0, F.array_join(kinds, ",")).alias("types"),
    )


_WEIGHTED_FILES = """e AS (SELECT 'cat' || c_mktsegment[1:1] AS category, 'n' || (c_nationkey % 3) AS subcategory, c_custkey AS source_id,
    'q' || (c_custkey % 4) AS id, 'Is it "' || c_name || '",' || chr(10) || 'or not?' AS question, c_acctbal AS weight FROM customer),
  p AS (SELECT category, subcategory, source_id, question || ' ?' AS prompt_text FROM e WHERE NOT (category = 'catA' AND subcategory = 'n1'))"""


def _csv_files(rows, path, name):
    """One CSV file per (category, subcategory), named as the reader expects."""
    spark = rows.sparkSession
    parts = scratch_path(spark, "csv")
    named = rows.withColumn("folder", F.col("category")).withColumn("file", name)
    named.drop("category", "subcategory").repartition("folder", "file").write.partitionBy("folder", "file").csv(
        parts, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(parts).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in fs.globStatus(jvm.Path(f"{parts}/folder=*/file=*/part-*")):
        file = found.getPath()
        folder = f"{path}/{file.getParent().getParent().getName().removeprefix('folder=')}"
        fs.mkdirs(jvm.Path(folder))
        fs.rename(file, jvm.Path(f"{folder}/{file.getParent().getName().removeprefix('file=')}.csv"))


@query(
    "read_weighted_tables",
    f"""WITH {_WEIGHTED_FILES} SELECT e.category, e.subcategory, e.source_id, id, e.question, weight, prompt_text
        FROM e JOIN p USING (category, subcategory, source_id)""",
)
def read_weighted_tables(spark, d):
    """Question and prompt files, quoted line breaks in them, written per category and read back as pairs."""
    path = scratch_path(spark, "weighted")
    rows = b.table(spark, d, "customer").selectExpr(
        "concat('cat', left(c_mktsegment, 1)) AS category", "concat('n', c_nationkey % 3) AS subcategory",
        "cast(c_custkey AS int) AS source_id", "concat('q', c_custkey % 4) AS id",
        "concat('Is it \"', c_name, '\",\n', 'or not?') AS question", "'' AS evaluation_criteria", "c_acctbal AS weight",
    )
    _csv_files(rows, f"{path}/eval", F.concat("subcategory", F.lit("_eval")))
    prompts = rows.filter("NOT (category = 'catA' AND subcategory = 'n1')").select(
        "category", "subcategory", F.col("source_id").alias("id"), F.concat("question", F.lit(" ?")).alias("Prompt")
    )
    _csv_files(prompts, f"{path}/prompts", F.concat_ws("_", "category", "subcategory"))
    questions, texts = readers.read_weighted_tables(spark, f"{path}/eval", f"{path}/prompts")
    return questions.drop("evaluation_criteria").join(texts, ["category", "subcategory", "source_id"])


@query(
    "read_human_records",
    f"""WITH {b.ATOMS} SELECT model, q_id, count(*) AS n, count(*) FILTER (WHERE answer = 'yes') AS n_yes FROM atoms
        WHERE q_id <> 'q3' GROUP BY model, q_id""",
)
def read_human_records(spark, d):
    """Human records written as JSON lines and read back, one row per answer."""
    path = scratch_path(spark, "human")
    labels = F.transform(F.filter("answers", lambda a: a["q_id"] != "q3"), lambda a: F.struct(a["q_id"].alias("q_id"), a["answer"].alias("answer")))
    rows = b.judgments(spark, d).select("prompt_id", "model", F.lit("ann").alias("annotator"), labels.alias("human_answers"))
    writers.append_records(rows, path)
    back = readers.read_human_records(spark, path).select("model", F.inline("human_answers"))
    return back.groupBy("model", "q_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") == "yes").alias("n_yes"))


@query(
    "edit_run_dimensions",
    f"""WITH {b.ATOMS} SELECT model, round_even(avg(p) FILTER (WHERE dimension = 'instruction_following'), 4)
        AS instruction_following_am FROM atoms GROUP BY model""",
)
def edit_run_dimensions(spark, d):
    """The dimension table of a whole edit run."""
    tables = edit_tables(b.judgments(spark, d), b.prompts(spark, d), b.SUB_CATEGORIES, n_boot=0)
    return tables["per_dimension"].select("model", "instruction_following_am")


# Streams ---------------------------------------------------------------------------------------

_EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _event_stream(spark, d):
    events = jobs.stream_files(spark, d, _EVENT_SCHEMA, "parquet", "events.parquet")
    return events.selectExpr(*b._LOG_COLUMNS)


@query(
    "stream_judgments",
    f"WITH {b.RESOLVED} SELECT model, count(*) AS n_judgments, count(*) FILTER (WHERE good) AS n_covered, "
    "round_even(avg(score_am) FILTER (WHERE good), 6) AS mean_am, "
    "round_even(avg(score_gm) FILTER (WHERE good), 6) AS mean_gm FROM j GROUP BY model",
)
def stream_judgments(spark, d):
    path = _judgment_files(spark, d)
    out, state = scratch_path(spark, "running"), scratch_path(spark, "state")
    stream = J.resolve_scores(jobs.stream_files(spark, path, schemas.JUDGMENT))
    jobs.write_latest(jobs.running_scores(stream), out, state).awaitTermination()
    return spark.read.parquet(out).withColumns(
        {c: F.bround(c, 6) for c in ("mean_am", "mean_gm")}
    )


@query("stream_board", f"{BOARD} SELECT * FROM board")
def stream_board(spark, d):
    """The leaderboard kept by a stream over judgment files, several files per batch."""
    path = _judgment_files(spark, d)
    out, state = scratch_path(spark, "board"), scratch_path(spark, "state")
    stream = J.resolve_scores(jobs.stream_files(spark, path, schemas.JUDGMENT))
    board.write_board(stream, out, state).awaitTermination()
    return board.read_board(spark, out)


@query("stream_failures", _ROUTED)
def stream_failures(spark, d):
    path = scratch_path(spark, "routed")
    rows = _event_stream(spark, d).select("prompt_id", "model", "status", "error", "seed")
    jobs.stream_failures(rows, path, scratch_path(spark, "state")).awaitTermination()
    return _routed(spark, path)


@query(
    "stream_cost",
    f"""WITH {b.LOG} SELECT model, stage, round_even(sum(amount), 4) AS total_usd, sum(amount) >= {CAP * 0.8} AS alert,
        sum(amount) < {CAP} AS under_cap FROM log GROUP BY model, stage""",
)
def stream_cost(spark, d):
    out = scratch_path(spark, "costs")
    totals = jobs.running_costs(_event_stream(spark, d).select("model", "stage", "amount"), CAP)
    jobs.write_latest(totals, out, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).withColumn("total_usd", F.bround("total_usd", 4))


@query(
    "stream_cost_alerts",
    f"WITH {b.LOG} SELECT model AS ledger, round_even(sum(amount), 4) AS total_usd FROM log GROUP BY model HAVING sum(amount) >= {CAP * 0.8}",
)
def stream_cost_alerts(spark, d):
    out = scratch_path(spark, "alerts")
    rows = _event_stream(spark, d).select(F.col("model").alias("ledger"), "amount")
    alerts = jobs.cost_alerts(rows, CAP)
    jobs.append_stream(alerts, out, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("ledger", F.bround("total_usd", 4).alias("total_usd"))


@query("stream_ledger", ORACLES["cost_ledger"])
def stream_ledger(spark, d):
    """The cost ledger kept by a stream, its last rows released when it is closed."""
    path = scratch_path(spark, "ledger")
    rows = _event_stream(spark, d).select("ts", "event_id", "amount")
    ledger.stream_ledger(rows, path, scratch_path(spark, "state"), CAP, ["event_id"], "1 day").awaitTermination()
    ledger.close_ledger(spark, path, CAP, ["event_id"])
    return ledger.read_ledger(spark, path).select(
        "event_id", F.bround("running_total", 4).alias("running_total"), "alert", "under_cap", "may_start"
    )


@query(
    "dedupe_attempts",
    f"WITH {b.LOG} SELECT DISTINCT model, prompt_id, seed FROM log",
)
def dedupe_attempts(spark, d):
    """Keys left after the stream dropped re-delivered attempts."""
    out = scratch_path(spark, "attempts")
    rows = _event_stream(spark, d).select(
        "model", "prompt_id", "seed", F.col("ts").cast("timestamp").alias("timestamp")
    )
    once = jobs.dedupe_attempts(rows, ["model", "prompt_id", "seed"], delay="60 days")
    jobs.append_stream(once, out, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("model", "prompt_id", "seed")
