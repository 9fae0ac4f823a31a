"""Queries: prompt selection, quality rules, ids, text functions, image and key tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.functions import text as X
from rubrica.operators import judgments as J
from rubrica.operators import planning as P
from rubrica.operators import quality as Q
from rubrica.operators import replies as RP
from rubrica.plans import bindings as b
from rubrica.plans.registry import query

# Selection -------------------------------------------------------------------------------------


@query(
    "select_prompts",
    f"WITH {b.PROMPTS} SELECT prompt_id, layer FROM prompts WHERE layer = 2 AND prompt_id IN (SELECT concat('P', l_partkey) FROM lineitem WHERE l_quantity > 49)",
)
def select_prompts(spark, d):
    wanted = b.table(spark, d, "lineitem").filter("l_quantity > 49").selectExpr(
        "concat('P', l_partkey) AS prompt_id"
    )
    chosen = P.select_prompts(b.prompts(spark, d).select("prompt_id", "layer"), layer=2)
    return P.select_prompt_table(chosen, wanted)


@query(
    "union_layers",
    f"""WITH {b.PROMPTS} SELECT prompt_id, layer, prompt_text FROM prompts
        UNION ALL SELECT concat('D', doc_id), 2, NULL FROM documents""",
)
def union_layers(spark, d):
    second = b.edit_prompts(spark, d).select("prompt_id", F.lit(2).alias("layer"))
    return P.union_layers(b.prompts(spark, d).select("prompt_id", "layer", "prompt_text"), second)


@query(
    "difference",
    f"WITH {b.LOG} SELECT concat('P', p_partkey) AS prompt_id FROM part WHERE concat('P', p_partkey) NOT IN (SELECT prompt_id FROM log)",
)
def difference(spark, d):
    return P.difference(b.prompts(spark, d).select("prompt_id"), b.log(spark, d), ["prompt_id"])


@query(
    "intersection",
    f"WITH {b.LOG} SELECT concat('P', p_partkey) AS prompt_id FROM part WHERE concat('P', p_partkey) IN (SELECT prompt_id FROM log)",
)
def intersection(spark, d):
    return P.intersection(b.prompts(spark, d).select("prompt_id"), b.log(spark, d), ["prompt_id"])


_SELECTED = "selected AS (SELECT DISTINCT concat('model_', o_custkey % 7) AS model FROM orders)"


def _models(spark, d):
    selected = b.table(spark, d, "orders").selectExpr("concat('model_', o_custkey % 7) AS model")
    return selected.distinct(), b.log(spark, d).select("model")


@query(
    "unknown_models",
    f"WITH {b.LOG}, {_SELECTED} SELECT model FROM selected WHERE model NOT IN (SELECT model FROM log)",
)
def unknown_models(spark, d):
    return P.unknown_models(*_models(spark, d))


@query(
    "known_models",
    f"WITH {b.LOG}, {_SELECTED} SELECT model FROM selected WHERE model IN (SELECT model FROM log)",
)
def known_models(spark, d):
    return P.known_models(*_models(spark, d))


@query(
    "pending_work",
    f"""WITH {b.LOG} SELECT m AS model, concat('P', p_partkey) AS prompt_id, s::INT AS seed
        FROM part, (VALUES ('model_0'), ('model_1')) t(m), range(3) u(s) WHERE NOT EXISTS (SELECT 1 FROM log
          WHERE status = 'SUCCESS' AND log.model = m AND log.prompt_id = concat('P', p_partkey) AND log.seed = s)""",
)
def pending_work(spark, d):
    return P.pending_work(b.prompts(spark, d), ["model_0", "model_1"], 3, b.log(spark, d))


@query(
    "pending_chains",
    f"""WITH {b.CHAINS}, done AS (SELECT model, prompt_id FROM chains GROUP BY ALL HAVING bool_and(status = 'SUCCESS'))
        SELECT m AS model, prompt_id FROM (SELECT DISTINCT prompt_id FROM chains), (VALUES ('model_0'), ('model_1')) t(m)
        WHERE (m, prompt_id) NOT IN (SELECT (model, prompt_id) FROM done)""",
)
def pending_chains(spark, d):
    from rubrica.operators.chains import chain_completion

    chains = b.chains(spark, d)
    return P.pending_chains(
        chains.select("prompt_id").distinct(), ["model_0", "model_1"], chain_completion(chains)
    )


@query(
    "log_to_prompt",
    f"""WITH {b.LOG}, {b.PROMPTS} SELECT event_id, log.model, log.prompt_id, prompt_text FROM log JOIN prompts USING (prompt_id)
        WHERE log.model = 'model_1'""",
)
def log_to_prompt(spark, d):
    rows = J.log_to_prompt(
        b.log(spark, d).select("event_id", "model", "prompt_id"),
        b.prompts(spark, d).select("prompt_id", "prompt_text"), "model_1",
    )
    return rows.select("event_id", "model", "prompt_id", "prompt_text")


@query(
    "question_lookup",
    f"""WITH {b.QUESTIONS}, a AS (SELECT concat('L2_', l_partkey) AS prompt_id, concat('q', l_linenumber) AS q_id, {b.RECORD_ID} AS rec_id FROM lineitem)
        SELECT a.rec_id, a.q_id, coalesce(question, '') AS question, coalesce(type, '') AS type FROM a LEFT JOIN qs USING (prompt_id, q_id)""",
)
def question_lookup(spark, d):
    answers = b.table(spark, d, "lineitem").selectExpr(
        "concat('L2_', l_partkey) AS prompt_id", "concat('q', l_linenumber) AS q_id",
        f"{b.RECORD_ID} AS rec_id",
    )
    found = J.question_lookup(answers, b.question_prompts(spark, d), "atomic_questions")
    return found.select("rec_id", "q_id", "question", "type")


# Edit prompt rules -----------------------------------------------------------------------------

_SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
_WORDS = f"len(list_filter(regexp_split_to_array(t, '{_SPACES}'), lambda w: w <> ''))"


def _count(marker, col="lower(t)"):
    return f"((length({col}) - length(replace({col}, '{marker}', ''))) // {len(marker)})"


_OPS = (
    "least(8, 1 + " + " + ".join(_count(m) for m in X.OPERATION_CONNECTORS)
    + f" + CASE WHEN contains(t, ':') AND (contains(t, 'flat') OR contains(t, 'strong') OR contains(t, 'wave')) THEN {_count(',', 't')} // 2 ELSE 0 END)"
)


def _any(words, col="lower(t)"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _found(words):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_filter([{listed}], lambda w: contains(lower(t), w))"


@query("word_count", f"SELECT doc_id, {_WORDS}::INT AS words FROM (SELECT doc_id, text AS t FROM documents)")
def word_count(spark, d):
    return b.table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("count_atomic_ops", f"SELECT doc_id, ({_OPS})::INT AS ops FROM (SELECT doc_id, text AS t FROM documents)")
def count_atomic_ops(spark, d):
    return b.table(spark, d, "documents").select("doc_id", X.count_atomic_ops(F.col("text")).alias("ops"))


@query(
    "has_complexity",
    "SELECT doc_id, " + ", ".join(f"{_any(w)} AS {k}" for k, w in X.COMPLEXITY_MARKERS.items())
    + " FROM (SELECT doc_id, text AS t FROM documents)",
)
def has_complexity(spark, d):
    return b.table(spark, d, "documents").select(
        "doc_id", *[X.has_complexity(F.col("text"), k).alias(k) for k in X.COMPLEXITY_MARKERS]
    )


_BOUND_VALUES = ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]})" for k, v in Q.DIFFICULTY_BOUNDS.items())
_HARDER = [w for w in X.COMPLEXITY_MARKERS["spatial"] if w not in X.PLAIN_DIRECTIONS]
_ALL_MARKERS = [w for words in X.COMPLEXITY_MARKERS.values() for w in words]
_RULES = f"""{b.EDIT_PROMPTS}, db(difficulty, w1, w2, a1, a2) AS (VALUES {_BOUND_VALUES}),
  known AS (SELECT DISTINCT source_image FROM ep WHERE doc_id % 3 = 0),
  f AS (SELECT prompt_id, doc_id, difficulty, category, turns, n_atoms, source_image, edit_instruction AS t FROM ep),
  x AS (SELECT f.*, w1, w2, a1, a2, {_WORDS} AS words, {_OPS} AS ops, {_found(_HARDER)} AS sp, {_found(X.COMPLEXITY_MARKERS['physics'])} AS ph
        FROM f JOIN db USING (difficulty)),
  warnings AS (
    SELECT prompt_id, 'unknown_difficulty' AS rule, difficulty AS detail FROM f WHERE difficulty = 'odd'
    UNION ALL SELECT prompt_id, 'too_few_words', words::VARCHAR FROM x WHERE words < w1 - 2
    UNION ALL SELECT prompt_id, 'too_many_words', words::VARCHAR FROM x WHERE words > w2 + 10
    UNION ALL SELECT prompt_id, 'too_few_atoms', n_atoms::VARCHAR FROM x WHERE n_atoms < a1
    UNION ALL SELECT prompt_id, 'too_many_atoms', n_atoms::VARCHAR FROM x WHERE n_atoms > a2 + 2
    UNION ALL SELECT prompt_id, 'easy_many_operations', ops::VARCHAR FROM x WHERE difficulty = 'easy' AND ops > 2
    UNION ALL SELECT prompt_id, 'easy_spatial', array_to_string(sp, ',') FROM x WHERE difficulty = 'easy' AND len(sp) > 0 AND NOT contains(lower(t), 'flip')
    UNION ALL SELECT prompt_id, 'easy_physics', array_to_string(ph, ',') FROM x WHERE difficulty = 'easy' AND len(ph) > 0
      AND NOT (len(ph) = 1 AND ph[1] = 'shadow' AND ops <= 2)
    UNION ALL SELECT prompt_id, 'hard_without_markers', '' FROM x WHERE difficulty = 'hard' AND NOT {_any(_ALL_MARKERS)}
    UNION ALL SELECT prompt_id, 'source_image_missing', source_image FROM x WHERE source_image NOT IN (SELECT source_image FROM known)
    UNION ALL SELECT prompt_id, 'turns_not_a_list', '' FROM x WHERE category = 'multi_turn' AND turns = '1'
    UNION ALL SELECT prompt_id, 'too_few_turns', '1' FROM x WHERE category = 'multi_turn' AND turns LIKE '%only%'
    UNION ALL SELECT prompt_id, 'no_instruction_atom', '' FROM x WHERE doc_id % 13 = 0
    UNION ALL SELECT prompt_id, 'invalid_dimension', 'q8:' FROM x WHERE n_atoms >= 8
    UNION ALL SELECT prompt_id, 'invalid_type', 'q9:vibe' FROM x WHERE n_atoms >= 9)"""


def warnings(spark, d):
    prompts = b.edit_prompts(spark, d)
    known = prompts.filter("doc_id % 3 = 0").select("source_image")
    ready = prompts.withColumn("sub_category", F.col("category"))
    return Q.prompt_warnings(ready, known)


@query("prompt_warnings", f"WITH {_RULES} SELECT * FROM warnings")
def prompt_warnings(spark, d):
    return warnings(spark, d)


@query(
    "warning_stats",
    f"""WITH {_RULES} SELECT (SELECT count(*) FROM ep) AS total, (SELECT count(*) FROM ep) - count(DISTINCT prompt_id) AS clean,
        count(DISTINCT prompt_id) AS with_warnings, count(*) AS warnings FROM warnings""",
)
def warning_stats(spark, d):
    return Q.warning_stats(b.edit_prompts(spark, d), warnings(spark, d))


_MATRIX = f"""{b.EDIT_PROMPTS}, matrix AS (SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category,
    count(*) FILTER (WHERE difficulty = 'easy') AS easy, count(*) FILTER (WHERE difficulty = 'medium') AS medium,
    count(*) FILTER (WHERE difficulty = 'hard') AS hard, CASE WHEN grouping(category) = 1 THEN count(*)
      ELSE count(*) FILTER (WHERE difficulty IN ('easy', 'medium', 'hard')) END AS total, grouping(category) = 1 AS is_total
    FROM (SELECT coalesce(category, '???') AS category, difficulty FROM ep) GROUP BY ROLLUP (category))"""


@query("coverage_matrix", f"WITH {_MATRIX} SELECT * FROM matrix")
def coverage_matrix(spark, d):
    return Q.coverage_matrix(b.edit_prompts(spark, d))


@query(
    "coverage_gaps",
    f"""WITH {_MATRIX}, c AS (UNPIVOT (SELECT category, easy, medium, hard FROM matrix WHERE NOT is_total)
          ON easy, medium, hard INTO NAME difficulty VALUE n) SELECT category, difficulty, n FROM c WHERE n < 40""",
)
def coverage_gaps(spark, d):
    return Q.coverage_gaps(Q.coverage_matrix(b.edit_prompts(spark, d)), min_per_cell=40)


@query(
    "group_distribution",
    f"""WITH {b.EDIT_PROMPTS} SELECT CASE WHEN source_image LIKE '%/person/%' THEN 'person' WHEN source_image LIKE '%/object/%' THEN 'object'
        WHEN source_image LIKE '%/scene/%' THEN 'scene' WHEN source_image LIKE '%/style/%' THEN 'style' ELSE 'unknown' END AS image_group,
        count(*) AS n FROM ep GROUP BY 1""",
)
def group_distribution(spark, d):
    return Q.group_distribution(b.edit_prompts(spark, d))


# Cohort rules ----------------------------------------------------------------------------------

_COLOURS = "(^|[^a-z])(" + "|".join(X.COLOURS) + ")($|[^a-z])"
_TRAITS = f"""{b.QUESTIONS}, tr AS (
  SELECT qp.prompt_id, qp.sub_category, qp.difficulty, qp.prompt_text,
    count(q_id) FILTER (WHERE type = 'numeracy') AS nn, count(q_id) FILTER (WHERE type = 'spatial') AS ns,
    count(q_id) FILTER (WHERE type = 'material') AS nm, count(q_id) AS nq, max(exact) AS mx,
    coalesce(bool_or(regexp_matches(lower(question), '{_COLOURS}')), false) AS color,
    regexp_matches(lower(qp.prompt_text), '[0-9]+(st|nd|rd|th)( |$)') OR
      (contains(lower(qp.prompt_text), 'second ') AND contains(lower(qp.prompt_text), 'from the')) AS ordinal
  FROM qp LEFT JOIN qs USING (prompt_id) GROUP BY ALL)"""


def traits(spark, d):
    return Q.prompt_traits(b.question_prompts(spark, d))


@query(
    "prompt_traits",
    f"""WITH {_TRAITS} SELECT prompt_id, sub_category, difficulty, nn::INT AS n_numeracy, ns::INT AS n_spatial, nm::INT AS n_material,
        mx::INT AS max_exact, color AS has_color, color OR nm >= 1 AS has_binding, ordinal FROM tr""",
)
def prompt_traits(spark, d):
    return traits(spark, d)


@query(
    "question_shape_violations",
    f"""WITH {_TRAITS} SELECT prompt_id, 'too_few_questions' AS rule, nq::VARCHAR AS detail FROM tr WHERE nq < 3
        UNION ALL SELECT prompt_id, 'invalid_question_type', type FROM qs WHERE type = 'taste'""",
)
def question_shape_violations(spark, d):
    return Q.question_shape_violations(b.question_prompts(spark, d))


_GOT = "concat_ws(',', nn, ns, nm, color::INT)"


@query(
    "prompt_rule_violations",
    f"""WITH {_TRAITS} SELECT prompt_id, 'no_exact_count' AS rule, '' AS detail FROM tr WHERE sub_category = 'numeracy' AND mx IS NULL
        UNION ALL SELECT prompt_id, 'max_count_too_small', mx::VARCHAR FROM tr WHERE sub_category = 'numeracy' AND mx < 4
        UNION ALL SELECT prompt_id, 'easy_unbound', {_GOT} FROM tr WHERE sub_category = 'complex_compositions' AND difficulty = 'easy' AND nn = 0 AND ns = 0
        UNION ALL SELECT prompt_id, 'medium_too_simple', {_GOT} FROM tr WHERE sub_category = 'complex_compositions' AND difficulty = 'medium' AND (nn < 1 OR ns < 1)
        UNION ALL SELECT prompt_id, 'hard_too_simple', {_GOT} FROM tr WHERE sub_category = 'complex_compositions' AND difficulty = 'hard'
          AND (nn < 2 OR ns < 1 OR nm < 1 OR NOT color)""",
)
def prompt_rule_violations(spark, d):
    return Q.prompt_rule_violations(traits(spark, d))


_COHORT = f"""{_TRAITS}, co AS (SELECT count(*) FILTER (WHERE nn >= 2) AS compound, count(*) FILTER (WHERE mx >= 7) AS big,
    count(*) FILTER (WHERE mx >= 7 AND (color OR nm >= 1)) AS big_with_attribute, count(*) FILTER (WHERE ordinal) AS ordinal
    FROM tr WHERE sub_category = 'numeracy')"""


@query("cohort_counts", f"WITH {_COHORT} SELECT * FROM co")
def cohort_counts(spark, d):
    return Q.cohort_counts(traits(spark, d))


@query(
    "cohort_violations",
    f"""WITH {_COHORT} SELECT * FROM (SELECT 'compound' AS rule, compound AS n, 10 AS needed FROM co UNION ALL SELECT 'big', big, 6 FROM co
        UNION ALL SELECT 'big_with_attribute', big_with_attribute, 5 FROM co UNION ALL SELECT 'ordinal', ordinal, 3 FROM co) WHERE n < needed""",
)
def cohort_violations(spark, d):
    return Q.cohort_violations(traits(spark, d))


@query(
    "cohort_distribution",
    f"""WITH {_TRAITS} SELECT CASE WHEN coalesce(mx, 0) >= 7 THEN '7+' WHEN mx IN (4, 5, 6) THEN mx::VARCHAR ELSE '<4' END AS bucket,
        count(*) AS n FROM tr WHERE sub_category = 'numeracy' GROUP BY 1""",
)
def cohort_distribution(spark, d):
    return Q.cohort_distribution(traits(spark, d))


@query("layer_counts", f"WITH {b.PROMPTS} SELECT layer, count(*) AS n FROM prompts GROUP BY layer")
def layer_counts(spark, d):
    return Q.layer_counts(b.prompts(spark, d))


@query(
    "difficulty_counts",
    f"WITH {b.PROMPTS} SELECT sub_category, difficulty, count(*) AS n FROM prompts GROUP BY ALL",
)
def difficulty_counts(spark, d):
    return Q.difficulty_counts(b.prompts(spark, d))


@query("question_type_counts", f"WITH {b.QUESTIONS} SELECT type AS q_type, count(*) AS n FROM qs GROUP BY type")
def question_type_counts(spark, d):
    return Q.question_type_counts(b.question_prompts(spark, d))


# Text functions --------------------------------------------------------------------------------


@query(
    "extract_json",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE regexp_extract(props, ': ([0-9]+)', 1)::INT END AS k,
        event_id % 4 = 3 AS rejected FROM events""",
)
def extract_json(spark, d):
    """Replies as plain JSON, fenced JSON, JSON in prose, and without any JSON."""
    reply = F.expr(
        r"""CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json\n', props, '\n```')
            WHEN 2 THEN concat(' Here you go: ', props, ' Bye.') ELSE 'no object here' END"""
    )
    found = X.json_object(reply)
    return b.table(spark, d, "events").select(
        "event_id", F.from_json(found, "k INT")["k"].alias("k"), found.isNull().alias("rejected")
    )


_SHAPES = r"""CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN concat('```json', {nl}, props, {nl}, '```')
            WHEN 2 THEN concat(' Here: ', props, ' Bye.') WHEN 3 THEN 'no object here' WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN ' ' END
            WHEN 5 THEN replace(props, ':', '') WHEN 6 THEN replace(props, '{{', '{{"j": [1, 2, ')
            WHEN 7 THEN replace(props, 'k', 'q') ELSE concat('{{"k": "', event_type, '"}}') END"""
_REPLY_FIELDS = {"k": "int"}


@query(
    "parse_replies",
    f"""WITH r AS (SELECT event_id, {_SHAPES.format(nl="chr(10)")} AS reply FROM events),
        o AS (SELECT *, regexp_extract(reply, '([{{].*[}}])', 1, 's') AS obj FROM r),
        t AS (SELECT *, CASE WHEN trim(coalesce(reply, '')) = '' THEN 'empty' WHEN obj = '' THEN 'no object'
                WHEN NOT json_valid(obj) THEN 'malformed' WHEN json_extract(obj, '$.k') IS NULL THEN 'missing k'
                WHEN try_cast(json_extract_string(obj, '$.k') AS INT) IS NULL THEN 'wrong type k' END AS reason FROM o)
        SELECT event_id, reason, CASE WHEN reason IS NULL THEN json_extract_string(obj, '$.k')::INT END AS k FROM t""",
)
def parse_replies(spark, d):
    """Replies of nine shapes: parsed ones with their field, the others with the reason they were rejected for."""
    replies = b.table(spark, d, "events").selectExpr("event_id", _SHAPES.format(nl=r"'\n'") + " AS reply")
    return RP.parse_replies(replies, "reply", _REPLY_FIELDS).select("event_id", "reason", "k")


@query(
    "extract_fenced_json",
    "SELECT event_id, regexp_extract(props, ': ([0-9]+)', 1)::DOUBLE AS k FROM events",
)
def extract_fenced_json(spark, d):
    reply = F.expr(
        r"""CASE WHEN event_id % 2 = 0 THEN concat('Text\n```json\n', props, '\n```\nmore') ELSE props END"""
    )
    return b.table(spark, d, "events").select(
        "event_id", F.try_element_at(X.fenced_scores(reply), F.lit("k")).alias("k")
    )


@query(
    "normalize_questions",
    """SELECT p_partkey, q.q_id, CASE WHEN p_size % 10 = 0 THEN 'Does the image match the prompt: "' || p_name || '"?' ELSE p_name END AS question,
          CASE WHEN p_size % 10 <> 0 AND q.q_id = 'q2' THEN 'spatial' ELSE 'presence' END AS type
        FROM part, (VALUES ('q1'), ('q2')) q(q_id) WHERE p_size % 10 <> 0 OR q.q_id = 'q1'""",
)
def normalize_questions(spark, d):
    raw = F.expr(
        "CASE WHEN p_size % 10 <> 0 THEN array(named_struct('question', p_name, 'type', cast(null as string)), "
        "named_struct('question', p_name, 'type', 'spatial')) END"
    )
    rows = b.table(spark, d, "part").select(
        "p_partkey", F.explode(X.normalize_questions(raw, F.col("p_name"))).alias("q")
    )
    return rows.select("p_partkey", "q.q_id", "q.question", "q.type")


@query(
    "format_questions",
    f"""WITH {b.QUESTIONS} SELECT prompt_id, string_agg('  - ' || q_id || ': ' || question, chr(10) ORDER BY q_id) AS listed
        FROM qs GROUP BY prompt_id
        UNION ALL SELECT prompt_id, '' FROM qp WHERE prompt_id NOT IN (SELECT prompt_id FROM qs)""",
)
def format_questions(spark, d):
    return b.question_prompts(spark, d).select(
        "prompt_id", X.format_questions(F.col("atomic_questions")).alias("listed")
    )


@query(
    "prompt_id",
    f"""WITH {b.QUESTIONS} SELECT prompt_id AS source, printf('L%d_%s_%03d', layer, CASE sub_category WHEN 'numeracy' THEN 'NUM'
        WHEN 'spatial_3d' THEN 'SP3' ELSE 'CMP' END, p_size) AS prompt_id FROM qp""",
)
def prompt_id(spark, d):
    rows = b.question_prompts(spark, d).join(
        b.table(spark, d, "part").selectExpr("concat('L2_', p_partkey) AS prompt_id", "p_size"), "prompt_id"
    )
    return rows.select(
        F.col("prompt_id").alias("source"),
        X.prompt_id(F.col("layer"), F.col("sub_category"), F.col("p_size")).alias("prompt_id"),
    )


@query(
    "asset_name",
    f"""WITH {b.CHAINS} SELECT prompt_id, turn, prompt_id || CASE WHEN turn > 1 THEN '_t' || turn ELSE '' END || '.png' AS by_turn,
        prompt_id || CASE WHEN turn = 1 THEN '' ELSE '__s' || (turn - 1) END || '.png' AS by_seed FROM chains""",
)
def asset_name(spark, d):
    pid, turn = F.col("prompt_id"), F.col("turn")
    return b.chains(spark, d).select(
        pid, turn, X.turn_asset_name(pid, turn).alias("by_turn"), X.seed_asset_name(pid, turn - 1).alias("by_seed")
    )


@query(
    "strip_data_uri",
    "SELECT doc_id, text AS content FROM documents",
)
def strip_data_uri(spark, d):
    """Whole texts through base64, half of them behind a data-URI head."""
    coded = F.base64(F.encode("text", "UTF-8"))
    uri = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), coded)).otherwise(coded)
    return b.table(spark, d, "documents").select(
        "doc_id", F.decode(X.image_bytes(uri), "UTF-8").alias("content")
    )


@query(
    "image_group",
    f"""WITH {b.EDIT_PROMPTS} SELECT prompt_id, CASE WHEN split_part(source_image, '/', 2) = 'misc' THEN 'unknown'
        ELSE split_part(source_image, '/', 2) END AS image_group, source_image AS stripped FROM ep""",
)
def image_group(spark, d):
    path = F.col("source_image")
    return b.edit_prompts(spark, d).select(
        "prompt_id", X.image_group(path).alias("image_group"),
        X.strip_prefix(F.concat(F.lit("prompts/"), path)).alias("stripped"),
    )


@query(
    "read_text_prompts",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        SELECT trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS prompt_text, count(*) AS n FROM l
        WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY 1""",
)
def read_text_prompts(spark, d):
    """The lines of all documents, written as text files and read as prompts."""
    from rubrica.session import scratch_path
    from rubrica.sources.readers import read_text_prompts as read

    path = scratch_path(spark, "lines")
    b.table(spark, d, "documents").select("text").write.text(path)
    prompts = read(spark, [f"{path}-absent", path])
    return prompts.groupBy("prompt_text").agg(F.count(F.lit(1)).alias("n"))


# Images and keys -------------------------------------------------------------------------------


@query(
    "select_filename",
    f"""WITH {b.IMAGES} SELECT image_id, contains(filename, 'full_scene') AS full_scene,
        regexp_matches(lower(filename), '[.](jpe?g|png|webp|gif)$') AS is_image FROM images""",
)
def select_filename(spark, d):
    name = F.col("filename")
    return b.images(spark, d).select(
        "image_id", X.is_full_scene(name).alias("full_scene"), X.is_image_name(name).alias("is_image")
    )


_PARSED = f"""{b.IMAGES}, parsed AS (SELECT *, contains(description, ' with ') AS rich FROM images)"""


@query(
    "parse_description",
    f"""WITH {_PARSED} SELECT image_id, CASE WHEN rich THEN 'outdoor' ELSE 'indoor' END AS scene_type,
          split_part(description, ' with ', 1) AS primary_subject, rich AS has_people,
          CASE WHEN rich THEN array_to_string(string_split(substr(description, strpos(description, ' with ') + 6), ', '), '|') ELSE '' END AS objects,
          CASE WHEN rich THEN 'glass,steel' ELSE '' END AS materials FROM parsed""",
)
def parse_description(spark, d):
    parsed = P.parse_description(b.images(spark, d))
    return parsed.select(
        "image_id", "scene_type", "primary_subject", "has_people",
        F.array_join("objects", "|").alias("objects"), F.array_join("materials", ",").alias("materials"),
    )


_PERSON_LISTS = " ".join(
    f"WHEN '{k}' THEN '{'|'.join(v)}'".replace("person's", "person''s") for k, v in P.PERSON_REGIONS.items()
    if k != P.DEFAULT_PERSON
)


@query(
    "editable_regions",
    f"""WITH {_PARSED} SELECT image_id, CASE WHEN "group" = 'person' THEN CASE category {_PERSON_LISTS}
            ELSE '{'|'.join(P.PERSON_REGIONS[P.DEFAULT_PERSON])}' END
          ELSE concat_ws('|', CASE WHEN rich THEN 'replace/modify a worker' END, 'background/environment change', 'lighting/time of day change',
            'color/material of main subject', CASE WHEN rich THEN 'person''s clothing/appearance' END, 'add new object to scene',
            'style transfer (artistic/era)', CASE WHEN rich THEN 'remove specific object' END) END AS regions FROM parsed""",
)
def editable_regions(spark, d):
    parsed = P.parse_description(b.images(spark, d))
    return P.editable_regions(parsed).select(
        "image_id", F.array_join("editable_regions", "|").alias("regions")
    )


@query(
    "key_inventory",
    f"""WITH {b.KEYS}, k AS (SELECT key, split_part(key, '/', 1) || '/' AS prefix, CASE WHEN len(string_split(key, '/')) > 2
            THEN split_part(key, '/', 2) END AS second, regexp_matches(lower(key), '[.](jpe?g|png|webp|gif)$') AS img FROM keys),
        c AS (SELECT prefix, count(*) FILTER (WHERE img) AS n_images, count(*) FILTER (WHERE second = 'accepted') AS n_accepted,
            count(*) FILTER (WHERE second = 'rejected') AS n_rejected, count(DISTINCT second) AS n_sub_prefixes FROM k GROUP BY prefix),
        r AS (SELECT prefix, key, row_number() OVER (PARTITION BY prefix ORDER BY key) AS rn FROM k WHERE img),
        s AS (SELECT prefix, max(key) FILTER (WHERE rn = 1) AS sample_1, max(key) FILTER (WHERE rn = 2) AS sample_2,
            max(key) FILTER (WHERE rn = 3) AS sample_3 FROM r GROUP BY prefix)
        SELECT c.*, sample_1, sample_2, sample_3 FROM c LEFT JOIN s USING (prefix) WHERE n_images > 0 OR n_sub_prefixes > 0""",
)
def key_inventory(spark, d):
    return P.key_inventory(b.object_keys(spark, d))
