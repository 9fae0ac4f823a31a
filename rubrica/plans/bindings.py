"""The given tables in the shape of the data model.

``lineitem`` rows are judgments with three answers each, ``part`` rows are prompts, ``events``
are the generation and cost log, ``conversations`` are edit chains, ``documents`` are edit
instructions. Each binding exists twice, for Spark and as SQL text, and is row-wise: no window,
no grouping, no id filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FLOOR = "4.5399929762484854e-05"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Hand out the rows of a scan that has fewer tasks than the session has cores.

    Tables of many files or row groups come through as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


# Judgments -----------------------------------------------------------------------------------

RECORD_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "cast(round(l_extendedprice * 100) as bigint))"
)

# Columns that read the same in both engines.
_RECORD_COLUMNS = [
    "concat('model_', l_suppkey % 5) AS model",
    "concat('P', l_partkey) AS prompt_id",
    "cast(l_orderkey AS int) AS seed",
    f"{RECORD_ID} AS rec_id",
    """CASE WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN NULL
       ELSE concat('img/', l_orderkey, '_', l_linenumber, '.png') END AS image_path""",
    """CASE WHEN l_partkey % 11 = 0 THEN 'image_missing'
       WHEN l_linestatus = 'F' AND l_orderkey % 3 = 0 THEN concat('timeout ', l_linenumber)
       WHEN l_orderkey % 7 = 0 THEN ' ' END AS error""",
    "CASE WHEN l_orderkey % 8 IN (1, 3) THEN l_tax * 10 END AS score",
    "CASE WHEN l_orderkey % 8 IN (0, 2) THEN l_discount * 9 END AS score_am",
    "CASE WHEN l_orderkey % 8 IN (0, 3) THEN l_discount * 7 END AS score_gm",
    "l_linenumber = 7 AS no_answers",
    "l_discount * 10 AS p1",
    "l_tax * 12.5D AS p2",
    """CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 40 THEN ''
       ELSE 'preservation' END AS type2""",
    "CASE WHEN l_linenumber = 4 THEN NULL ELSE 'detail_preservation' END AS dim3",
    "CASE WHEN l_discount * 10 >= 0.5D THEN 'yes' ELSE 'no' END AS a1",
    """CASE WHEN l_linenumber = 3 THEN NULL WHEN l_tax * 12.5D >= 0.5D THEN 'yes'
       ELSE 'no' END AS a2""",
    """CASE WHEN l_returnflag = 'A' THEN 'yes' WHEN l_returnflag = 'N' THEN ' Yes'
       ELSE 'no' END AS a3""",
    "concat('Is part ', l_partkey, ' there?') AS question1",
    "l_linenumber",
    "l_linestatus",
    "l_quantity",
    "l_orderkey",
    "l_partkey",
]


def _duck(columns: list[str]) -> str:
    """A select list for SQL, with its double literals as that dialect writes them."""
    sql = ", ".join(columns).replace("`", '"')
    return sql.replace("12.5D", "12.5e0").replace("0.5D", "0.5e0")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgment records with nested answers, as a judge would have written them."""
    rows = spread(table(spark, sf_dir, "lineitem")).selectExpr(*_RECORD_COLUMNS)
    return rows.withColumn(
        "answers",
        F.expr(
            """CASE WHEN no_answers THEN array() ELSE array(
              named_struct('q_id', 'q1', 'question', question1, 'type', 'instruction',
                'dimension', 'instruction_following', 'answer', a1, 'probability', p1),
              named_struct('q_id', 'q2', 'question', 'Is the rest kept?', 'type', type2,
                'dimension', 'visual_consistency', 'answer', a2, 'probability', p2),
              named_struct('q_id', 'q3', 'question', 'Is it sharp?', 'type', 'quality',
                'dimension', dim3, 'answer', a3, 'probability', cast(null as double))) END"""
        ),
    ).select(
        "model", "prompt_id", "seed", "rec_id", "image_path", "error", "score", "score_am",
        "score_gm", "answers", "l_linestatus", "l_orderkey",
    )


REC = f"rec AS (SELECT {_duck(_RECORD_COLUMNS)} FROM lineitem)"

# One row per answer, in long form.
ATOMS = f"""{REC}, atoms AS (
  SELECT *, 'q1' AS q_id, 'instruction' AS q_type, 'instruction_following' AS dimension,
         a1 AS answer, p1 AS probability, p1 AS p FROM rec WHERE NOT no_answers
  UNION ALL
  SELECT *, 'q2', type2, 'visual_consistency', a2, p2, p2 FROM rec WHERE NOT no_answers
  UNION ALL
  SELECT *, 'q3', 'quality', dim3, a3, NULL,
         CASE WHEN a3 = 'no' THEN {FLOOR} ELSE 1.0e0 END FROM rec WHERE NOT no_answers)"""

_P3 = f"(CASE WHEN a3 = 'no' THEN {FLOOR} ELSE 1.0e0 END)"
_AM = f"CASE WHEN no_answers THEN 0.0e0 ELSE (p1 + p2 + {_P3}) / 3 END"
_GM = (
    f"CASE WHEN no_answers THEN 0.0e0 ELSE exp((ln(greatest(p1, {FLOOR})) "
    f"+ ln(greatest(p2, {FLOOR})) + ln({_P3})) / 3) END"
)
_STAND_IN = "CASE WHEN score_am IS NULL AND score_gm IS NULL THEN score END"

RESOLVED = f"""{REC}, j AS (
  SELECT model, prompt_id, seed, rec_id, image_path, error AS judge_error, no_answers,
         p1, p2, {_P3} AS p3, a1, a2, a3, question1, type2, dim3, l_linestatus, l_orderkey,
         trim(coalesce(error, '')) = '' AS good,
         coalesce(score_am, {_STAND_IN}, {_AM}) AS score_am,
         coalesce(score_gm, {_STAND_IN}, {_GM}) AS score_gm,
         coalesce(score, score_am, {_STAND_IN}, {_AM}) AS score
  FROM rec)"""

RESOLVED_EDIT = f"""{REC}, j AS (
  SELECT model, prompt_id, seed, rec_id, error AS judge_error,
         trim(coalesce(error, '')) = '' AS covered,
         coalesce(score_am, {_AM}) AS score_am, coalesce(score_gm, {_GM}) AS score_gm
  FROM rec)"""

COLLAPSED = f"""{RESOLVED}, c AS (
  SELECT model, prompt_id,
         coalesce(avg(score_am) FILTER (WHERE good), 0) AS score_am,
         coalesce(avg(score_gm) FILTER (WHERE good), 0) AS score_gm,
         coalesce(stddev_samp(score_am) FILTER (WHERE good), 0) AS seed_std_dev_am,
         coalesce(stddev_samp(score_gm) FILTER (WHERE good), 0) AS seed_std_dev_gm,
         count(*) FILTER (WHERE good) AS n_seeds,
         count(*) FILTER (WHERE good) > 0 AS covered
  FROM j GROUP BY model, prompt_id)"""


# Prompts -------------------------------------------------------------------------------------

_PROMPT_COLUMNS = [
    "concat('P', p_partkey) AS prompt_id",
    "cast(p_size % 3 + 1 AS int) AS layer",
    "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_type END AS sub_category",
    """CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size < 17 THEN 'easy' WHEN p_size < 34
       THEN 'medium' ELSE 'hard' END AS difficulty""",
    "p_name AS prompt_text",
]
SUB_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_PROMPT_COLUMNS)


PROMPTS = f"prompts AS (SELECT {_duck(_PROMPT_COLUMNS)} FROM part)"

SCORES = f"""{COLLAPSED}, {PROMPTS}, s AS (
  SELECT c.*, p.layer, p.sub_category, coalesce(p.difficulty, 'auto') AS difficulty
  FROM c LEFT JOIN prompts p USING (prompt_id))"""
SCORES = SCORES.replace(
    "coalesce(p.difficulty, 'auto') AS difficulty",
    "CASE WHEN p.prompt_id IS NULL THEN NULL ELSE coalesce(p.difficulty, 'auto') END AS difficulty",
)

EDIT_SCORES = f"""{RESOLVED_EDIT}, {PROMPTS}, s AS (
  SELECT j.*, p.layer, p.sub_category FROM j LEFT JOIN prompts p USING (prompt_id))"""

_THEME_LIST = "lower(p_type), lower(p_name), CASE WHEN p_size > 25 THEN 'dense' ELSE 'sparse' END"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, themes): three tags, two for small parts, none for a few."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('P', p_partkey) AS prompt_id",
        f"""CASE WHEN p_partkey % 31 = 0 THEN cast(array() AS array<string>)
                 WHEN p_size < 10 THEN slice(array({_THEME_LIST}), 1, 2)
                 ELSE array({_THEME_LIST}) END AS themes""",
    )


TAGGED = f"""tagged AS (SELECT concat('P', p_partkey) AS prompt_id,
  CASE WHEN p_partkey % 31 = 0 THEN CAST([] AS VARCHAR[])
       WHEN p_size < 10 THEN [{_THEME_LIST}][1:2] ELSE [{_THEME_LIST}] END AS themes FROM part)"""
THEMES = f"{TAGGED}, themes AS (SELECT prompt_id, unnest(themes) AS theme FROM tagged)"

_QUESTION_COLUMNS = [
    "concat('L2_', p_partkey) AS prompt_id",
    """CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'numeracy'
       WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'complex_compositions'
       ELSE 'spatial_3d' END AS sub_category""",
    """CASE WHEN p_size < 17 THEN 'easy' WHEN p_size < 34 THEN 'medium'
       ELSE 'hard' END AS difficulty""",
    "2 AS layer",
    """CASE WHEN p_size % 7 = 0 THEN concat('the ', p_size, 'th ', p_name) WHEN p_size % 7 = 1
       THEN concat('the second ', p_name, ' from the left')
       ELSE concat('a shelf with ', p_name, 's') END AS prompt_text""",
    "p_name",
    "p_size",
]


def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with atomic questions built from part names and sizes."""
    rows = table(spark, sf_dir, "part").selectExpr(*_QUESTION_COLUMNS)
    questions = F.expr(
        """filter(array(
             CASE WHEN p_size % 6 <> 5 THEN named_struct('q_id', 'q1', 'question',
               concat('Are there Exactly ', p_size, ' ', p_name, 's?'), 'type', 'numeracy') END,
             CASE WHEN p_size % 5 <> 0 THEN named_struct('q_id', 'q2', 'question',
               'Is the box on the left?', 'type', 'spatial') END,
             CASE WHEN p_size % 3 = 0 THEN named_struct('q_id', 'q3', 'question',
               'Are there exactly 5 golden lids?', 'type', 'numeracy') END,
             CASE WHEN p_size % 4 = 0 THEN named_struct('q_id', 'q4', 'question',
               'Is it made of reddish wood?', 'type', 'material') END,
             CASE WHEN p_size % 9 = 0 THEN named_struct('q_id', 'q5', 'question',
               'Is it nice?', 'type', 'taste') END), q -> q IS NOT NULL)"""
    )
    return rows.withColumn("atomic_questions", questions).drop("p_name", "p_size")


# The same questions as one row each.
QUESTIONS = f"""qp AS (SELECT {_duck(_QUESTION_COLUMNS)} FROM part), qs AS (
  SELECT prompt_id, 'q1' AS q_id, concat('Are there Exactly ', p_size, ' ', p_name, 's?') AS question,
         'numeracy' AS type, p_size AS exact FROM qp WHERE p_size % 6 <> 5
  UNION ALL SELECT prompt_id, 'q2', 'Is the box on the left?', 'spatial', NULL FROM qp WHERE p_size % 5 <> 0
  UNION ALL SELECT prompt_id, 'q3', 'Are there exactly 5 golden lids?', 'numeracy', 5 FROM qp WHERE p_size % 3 = 0
  UNION ALL SELECT prompt_id, 'q4', 'Is it made of reddish wood?', 'material', NULL FROM qp WHERE p_size % 4 = 0
  UNION ALL SELECT prompt_id, 'q5', 'Is it nice?', 'taste', NULL FROM qp WHERE p_size % 9 = 0)"""


# Logs ----------------------------------------------------------------------------------------

_LOG_COLUMNS = [
    "concat('model_', user_id % 5) AS model",
    "concat('P', user_id) AS prompt_id",
    "cast(event_id % 3 AS int) AS seed",
    """CASE WHEN event_type = 'click' THEN 'FILTERED' WHEN event_type = 'error' THEN 'ERROR'
       ELSE 'SUCCESS' END AS status""",
    """CASE WHEN event_type = 'click' AND event_id % 2 = 0
       THEN 'Your prompt violates our Content Policy.' WHEN event_type = 'click'
       THEN 'Request blocked: NSFW content' WHEN event_type = 'error'
       THEN 'Internal server error' END AS error""",
    "value AS amount",
    "event_type AS stage",
    "ts",
    "event_id",
    "props",
]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_LOG_COLUMNS)


LOG = f"log AS (SELECT {_duck(_LOG_COLUMNS)} FROM events)"

_CHAIN_COLUMNS = [
    "concat('model_', conv_id % 3) AS model",
    "concat('C', conv_id) AS prompt_id",
    "cast(turn + 1 AS int) AS turn",
    """CASE WHEN (conv_id * 7 + turn) % 9 = 0 THEN 'ERROR' WHEN (conv_id * 7 + turn) % 9 = 1
       THEN 'FILTERED' ELSE 'SUCCESS' END AS status""",
    """CASE WHEN (conv_id * 7 + turn) % 9 > 1
       THEN concat('C', conv_id, '_t', turn + 1, '.png') END AS image_path""",
    "CASE WHEN turn = 0 THEN concat('src/C', conv_id, '.png') END AS source_image_path",
    "turn AS log_order",
]


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_CHAIN_COLUMNS)


CHAINS = f"chains AS (SELECT {_duck(_CHAIN_COLUMNS)} FROM conversations)"


# Edit prompts --------------------------------------------------------------------------------

_EDIT_COLUMNS = [
    "concat('D', doc_id) AS prompt_id",
    """CASE WHEN doc_id % 41 = 0 THEN 'odd' WHEN n_chars < 300 THEN 'easy' WHEN n_chars < 1500
       THEN 'medium' ELSE 'hard' END AS difficulty""",
    "CASE WHEN doc_id % 6 = 0 THEN 'multi_turn' ELSE concat('cat_', lang) END AS category",
    "text AS edit_instruction",
    """concat('source_images/', CASE doc_id % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'object' WHEN 2
       THEN 'scene' WHEN 3 THEN 'style' ELSE 'misc' END, '/', source, '.jpg') AS source_image""",
    """CASE WHEN doc_id % 12 = 0 THEN '["do this", "then that"]' WHEN doc_id % 24 = 6
       THEN '["only this"]' ELSE '1' END AS turns""",
    "doc_id",
]


def edit_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents")).selectExpr(*_EDIT_COLUMNS)
    atoms = F.expr(
        """transform(sequence(1, cast(1 + doc_id % 11 AS int)), i -> named_struct(
             'q_id', concat('q', i), 'question', concat('Question ', i, '?'),
             'type', CASE WHEN i = 1 AND doc_id % 13 <> 0 THEN 'instruction'
                          WHEN i = 9 THEN 'vibe' ELSE 'preservation' END,
             'dimension', CASE WHEN i = 8 THEN NULL ELSE 'visual_consistency' END))"""
    )
    return rows.withColumn("atoms", atoms)


EDIT_PROMPTS = f"""ep AS (SELECT {_duck(_EDIT_COLUMNS)}, cast(1 + doc_id % 11 AS int) AS n_atoms
  FROM documents)"""


# Images --------------------------------------------------------------------------------------

_IMAGE_COLUMNS = [
    "p_partkey AS image_id",
    """CASE p_size % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'object' WHEN 2 THEN 'scene'
       ELSE 'style' END AS `group`""",
    """CASE WHEN p_size % 4 <> 0 THEN concat(lower(p_brand), '_', p_size % 3) WHEN p_size % 3 = 0
       THEN 'person_portrait' WHEN p_size % 3 = 1 THEN 'person_group'
       ELSE 'person_other' END AS category""",
    """CASE WHEN p_size % 5 = 0 THEN concat('A ', p_name)
       ELSE concat('A steel ', p_name, ' in the street with a worker, a ', lower(p_type), ' lamp with glass, ', p_brand) END AS description""",
    """CASE WHEN p_partkey % 5 = 0 THEN concat('iso_', p_partkey, '.JPG')
       ELSE concat('shot01_full_scene_', p_partkey, '.jpg') END AS filename""",
]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_IMAGE_COLUMNS)


IMAGES = f"images AS (SELECT {_duck(_IMAGE_COLUMNS)} FROM part)"


# Object keys ---------------------------------------------------------------------------------

_KEY = """concat(split_part(split_part(url, '://', 2), '/', 1), CASE page_id % 4
  WHEN 0 THEN concat('/accepted/', page_id, '.JPG') WHEN 1 THEN concat('/rejected/', page_id, '.png')
  WHEN 2 THEN concat('/', page_id, '.webp') ELSE '/notes.txt' END)"""


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(f"{_KEY} AS key")


KEYS = f"keys AS (SELECT {_KEY} AS key FROM pages)"
