"""Explicit schemas of the data model, as DDL. Readers never infer; a missing key becomes NULL."""

QUESTION = "STRUCT<q_id: STRING, question: STRING, type: STRING>"
ATOM_SPEC = "STRUCT<q_id: STRING, question: STRING, type: STRING, dimension: STRING>"
ANSWER = (
    "STRUCT<q_id: STRING, question: STRING, type: STRING, dimension: STRING, "
    "answer: STRING, probability: DOUBLE>"
)

PROMPT = (
    "prompt_id STRING, layer INT, sub_category STRING, difficulty STRING, prompt_text STRING, "
    f"atomic_questions ARRAY<{QUESTION}>"
)

# ``turns`` is a number or a list of strings in the files, so it is read as text.
EDIT_PROMPT = (
    "prompt_id STRING, layer INT, sub_category STRING, category STRING, difficulty STRING, "
    f"source_image STRING, edit_instruction STRING, turns STRING, atoms ARRAY<{ATOM_SPEC}>"
)

GENERATION = (
    "prompt_id STRING, model STRING, status STRING, image_path STRING, cost_usd DOUBLE, "
    "duration_sec DOUBLE, error STRING, raw_metadata STRING, timestamp TIMESTAMP, seed INT"
)

EDIT_RECORD = (
    "prompt_id STRING, model STRING, status STRING, image_path STRING, source_image_path STRING, "
    "turn INT, cost_usd DOUBLE, duration_sec DOUBLE, error STRING, raw_metadata STRING, "
    "timestamp TIMESTAMP"
)

JUDGMENT = (
    "prompt_id STRING, model STRING, image_path STRING, judge_model STRING, "
    f"answers ARRAY<{ANSWER}>, score DOUBLE, score_am DOUBLE, score_gm DOUBLE, cost_usd DOUBLE, "
    "error STRING, timestamp TIMESTAMP, seed INT"
)

EDIT_JUDGMENT = (
    "prompt_id STRING, model STRING, source_image_path STRING, edited_image_path STRING, "
    f"judge_model STRING, answers ARRAY<{ANSWER}>, score DOUBLE, score_am DOUBLE, "
    "score_gm DOUBLE, cost_usd DOUBLE, error STRING, timestamp TIMESTAMP"
)

TOP_LOGPROBS = "ARRAY<STRUCT<token: STRING, logprob: DOUBLE>>"
THEME_MAP = "MAP<STRING, ARRAY<STRING>>"
TAXONOMY = "id STRING, description STRING"

HUMAN_RECORD = (
    "prompt_id STRING, model STRING, annotator STRING, "
    "human_answers ARRAY<STRUCT<q_id: STRING, answer: STRING>>"
)
ANNOTATION_SHEET = (
    "prompt_id STRING, model STRING, sub_category STRING, image_path STRING, prompt_text STRING, "
    "q_id STRING, question STRING, judge_answer STRING, human_answer STRING, annotator STRING"
)

COST = "ts TIMESTAMP, amount DOUBLE, model STRING, stage STRING"
MODEL_DIM = (
    "model STRING, provider STRING, cost_per_unit DOUBLE, pattern STRING, profiles ARRAY<STRING>"
)

WEIGHTED_QUESTION = (
    "source_id INT, id STRING, question STRING, evaluation_criteria STRING, weight DOUBLE"
)
WEIGHTED_PROMPT = "id INT, Prompt STRING"
IMAGE_MANIFEST = (
    "s3_key STRING, `group` STRING, category STRING, description STRING, filename STRING, "
    "local_path STRING"
)
IMAGE_DESCRIPTION = (
    "local_path STRING, `group` STRING, category STRING, description STRING"
)

LEADERBOARD = (
    "model STRING, overall_am DOUBLE, overall_gm DOUBLE, std_dev_am DOUBLE, std_dev_gm DOUBLE, "
    "n_total BIGINT, seed_std_dev_am DOUBLE, seed_std_dev_gm DOUBLE, overall_am_covered DOUBLE, "
    "overall_gm_covered DOUBLE, n_covered BIGINT, coverage_rate DOUBLE"
)
