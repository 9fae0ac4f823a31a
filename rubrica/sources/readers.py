"""Readers. All use fixed schemas; a folder that does not exist reads as an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica import schemas
from rubrica.functions import scoring as S
from rubrica.functions import text as X


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(jvm_path)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    return next((p for p in candidates if path_exists(spark, p)), None)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are skipped, a broken line fails the job."""
    if not path_exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _text_probability(kind: str) -> str:
    """The schema of judgments with probabilities as text: some files quote them."""
    schema = schemas.EDIT_JUDGMENT if kind == "edit" else schemas.JUDGMENT
    return schema.replace("probability: DOUBLE", "probability: STRING")


def _numbers(raw: DataFrame) -> DataFrame:
    number = F.transform(
        "answers", lambda a: a.withField("probability", a["probability"].try_cast("double"))
    )
    return raw.withColumn("answers", number)


def read_judgments(spark: SparkSession, path: str, kind: str = "t2i") -> DataFrame:
    """The ``*.jsonl`` files of one folder, one model per file: its stem names the model,
    whatever the records say.

    For many or large models use ``read_judgment_table``: there a model is a folder of files.
    """
    schema = _text_probability(kind)
    if not path_exists(spark, f"{path.rstrip('/')}/*.jsonl"):
        return _empty(spark, schema)
    raw = (
        spark.read.schema(schema)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.jsonl")
        .json(path)
    )
    raw = _numbers(raw)
    stem = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"^(.*)\.jsonl$", 1)
    return raw.withColumn("model", stem)


def read_judgment_table(spark: SparkSession, path: str, kind: str = "t2i") -> DataFrame:
    """Judgments laid out as ``model=<name>/part-*.json``; a filter on model prunes folders."""
    schema = _text_probability(kind)
    return _numbers(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def read_prompts(spark: SparkSession, *paths: str, kind: str = "t2i") -> DataFrame:
    """JSON array files of prompts; missing files are left out."""
    schema = schemas.EDIT_PROMPT if kind == "edit" else schemas.PROMPT
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        return _empty(spark, schema)
    return spark.read.schema(schema).option("multiLine", True).json(present)


def read_theme_map(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, theme) from a JSON object of tag lists; anything else reads as empty."""
    if not path_exists(spark, path):
        return _empty(spark, "prompt_id STRING, theme STRING")
    return theme_map_rows(spark.read.text(path, wholetext=True))


def theme_map_rows(documents: DataFrame) -> DataFrame:
    """(prompt_id, theme) rows of JSON objects held in a ``value`` column."""
    return documents.select(F.explode(X.theme_map(F.col("value"))).alias("prompt_id", "themes")).select(
        "prompt_id", F.explode("themes").alias("theme")
    )


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TAXONOMY).option("multiLine", True).json(path)


def read_generation_log(spark: SparkSession, path: str, kind: str = "t2i") -> DataFrame:
    """The attempt log; an absent one is an empty table with all columns."""
    return read_jsonl(spark, path, schemas.EDIT_RECORD if kind == "edit" else schemas.GENERATION)


def read_human_records(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.HUMAN_RECORD)


def read_score_table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A score table exported as CSV, or None when there is none."""
    if not path_exists(spark, path):
        return None
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def import_annotation_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A filled-in sheet, quoted line breaks allowed; only yes/no rows stay. ``pos`` is the row order
    inside each file: such a file is read by one task."""
    from rubrica.operators.agreement import clean_human_answers

    sheet = spark.read.csv(
        path, header=True, schema=schemas.ANNOTATION_SHEET, multiLine=True, escape='"'
    )
    return clean_human_answers(sheet.withColumn("pos", F.monotonically_increasing_id()))


def read_text_prompts(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """One prompt per line from the first path that exists; trimmed, blanks dropped."""
    path = first_existing(spark, candidates)
    if path is None:
        return _empty(spark, "prompt_text STRING")
    return text_prompts(spark.read.text(path))


def text_prompts(lines: DataFrame) -> DataFrame:
    return lines.select(S.strip(F.col("value")).alias("prompt_text")).filter("prompt_text <> ''")


def read_weighted_tables(spark: SparkSession, eval_dir: str, prompt_dir: str) -> tuple[DataFrame, DataFrame]:
    """Question and prompt CSV files below one folder per category, with the category and
    sub-category taken from the path. Only pairs present on both sides stay."""
    questions = spark.read.csv(
        f"{eval_dir.rstrip('/')}/*/*_eval.csv", header=True, schema=schemas.WEIGHTED_QUESTION,
        multiLine=True, escape='"',
    )
    prompts = spark.read.csv(
        f"{prompt_dir.rstrip('/')}/*/*.csv", header=True, schema=schemas.WEIGHTED_PROMPT,
        multiLine=True, escape='"',
    )
    path = F.col("_metadata.file_path")
    questions = questions.withColumns(
        {"category": _part(path, -2), "subcategory": F.regexp_replace(_part(path, -1), r"_eval\.csv$", "")}
    )
    prompts = prompts.withColumns({"category": _part(path, -2), "_name": _part(path, -1)})
    prompts = prompts.withColumn(
        "subcategory",
        F.expr("regexp_replace(substring(_name, length(category) + 2), '[.]csv$', '')"),
    ).select(
        F.col("id").alias("source_id"), F.col("Prompt").alias("prompt_text"), "category", "subcategory"
    )
    item = ["category", "subcategory", "source_id"]
    return questions.join(prompts.select(*item).distinct(), item, "left_semi"), prompts


def _part(path: Column, i: int) -> Column:
    return F.element_at(F.split(path, "/"), i)
