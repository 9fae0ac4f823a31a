"""Queries: annotation sheets, agreement, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.operators import agreement as H
from rubrica.operators import planning as P
from rubrica.operators import sampling as M
from rubrica.plans import bindings as b
from rubrica.plans.registry import query
from rubrica.plans.score_queries import atoms

# Human labels: one per judged atom of even orders, the newest order's label is the valid one.
_LABELS = """labels_raw AS (SELECT model, prompt_id, q_id, seed, rec_id,
    CASE WHEN l_linestatus = 'O' AND p > 0.2 THEN ' Yes' WHEN p > 0.6 THEN 'yes ' WHEN seed % 10 = 0 THEN 'maybe'
         WHEN seed % 10 = 2 THEN NULL ELSE 'NO' END AS human_answer
    FROM atoms WHERE seed % 2 = 0),
  cleaned AS (SELECT * REPLACE (lower(trim(coalesce(human_answer, ''))) AS human_answer) FROM labels_raw
    WHERE lower(trim(coalesce(human_answer, ''))) IN ('yes', 'no')),
  labels2 AS (SELECT prompt_id, model, q_id,
    max_by(human_answer, (lpad(seed::VARCHAR, 12, '0') || rec_id)) AS human_answer
    FROM cleaned GROUP BY prompt_id, model, q_id),
  judged AS (SELECT model, prompt_id, seed, rec_id, q_id, answer AS judge_answer FROM atoms),
  pairs AS (SELECT * FROM judged JOIN labels2 USING (prompt_id, model, q_id))"""


def raw_labels(spark, d):
    p = F.coalesce(
        F.col("probability"), F.expr(f"CASE WHEN answer = 'no' THEN {b.FLOOR} ELSE 1.0D END")
    )
    return atoms(spark, d).filter("seed % 2 = 0").withColumn("p", p).withColumn(
        "human_answer",
        F.expr(
            "CASE WHEN l_linestatus = 'O' AND p > 0.2 THEN ' Yes' WHEN p > 0.6 THEN 'yes ' "
            "WHEN seed % 10 = 0 THEN 'maybe' WHEN seed % 10 = 2 THEN NULL ELSE 'NO' END"
        ),
    )


def labels(spark, d):
    cleaned = H.clean_human_answers(raw_labels(spark, d))
    return H.human_labels(cleaned, F.struct("seed", "rec_id"))


@query(
    "clean_human_answers",
    f"WITH {b.ATOMS}, {_LABELS} SELECT rec_id, q_id, human_answer FROM cleaned",
)
def clean_human_answers(spark, d):
    return H.clean_human_answers(raw_labels(spark, d)).select("rec_id", "q_id", "human_answer")


@query("human_labels", f"WITH {b.ATOMS}, {_LABELS} SELECT * FROM labels2")
def human_labels(spark, d):
    return labels(spark, d)


@query(
    "human_judge_join",
    f"""WITH {b.ATOMS}, {_LABELS} SELECT prompt_id, model, q_id, judge_answer, human_answer, count(*) AS n
        FROM pairs GROUP BY ALL""",
)
def human_judge_join(spark, d):
    return H.human_judge_pairs(atoms(spark, d), labels(spark, d))


_KAPPA = """cm AS (SELECT judge_answer AS a, human_answer AS h, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL),
  tot AS (SELECT sum(n) AS t, sum(n) FILTER (WHERE a = h) AS agreed FROM cm),
  side AS (SELECT sum(x.na * y.nh) AS cr FROM (SELECT a, sum(n) AS na FROM cm GROUP BY a) x
           JOIN (SELECT h, sum(n) AS nh FROM cm GROUP BY h) y ON x.a = y.h),
  k AS (SELECT t, agreed / t AS po, cr / (t * t) AS pe FROM tot, side)"""


@query(
    "agreement",
    f"""WITH {b.ATOMS}, {_LABELS}, {_KAPPA} SELECT t::BIGINT AS n_pairs, round_even(po, 4) AS raw_agreement,
        round_even((po - pe) / nullif(1 - pe, 0), 4) AS cohen_kappa, 0.6e0 AS target_kappa,
        coalesce((po - pe) / nullif(1 - pe, 0) > 0.6e0, false) AS meets_target FROM k""",
)
def agreement(spark, d):
    return H.agreement(H.human_judge_pairs(atoms(spark, d), labels(spark, d)))


@query(
    "agreement_by_record",
    f"""WITH {b.ATOMS}, {_LABELS} SELECT rec_id, prompt_id, model, count(*) AS n_questions,
        round_even(avg((coalesce(judge_answer = human_answer, false))::INT), 4) AS agreement FROM pairs
        GROUP BY rec_id, prompt_id, model""",
)
def agreement_by_record(spark, d):
    return H.record_agreement(b.judgments(spark, d), labels(spark, d), "rec_id", "prompt_id", "model")


@query(
    "cohen_kappa",
    """WITH x AS (SELECT d.lang, l.quality AS a, l.toxic AS h FROM labels l JOIN documents d USING (doc_id)),
        t AS (SELECT lang, count(*)::DOUBLE AS n, avg((a = h)::INT) AS po, avg(a) AS qa, avg(h) AS qh FROM x GROUP BY lang),
        k AS (SELECT lang, n, po, qa * qh + (1 - qa) * (1 - qh) AS pe FROM t)
        SELECT lang, n::BIGINT AS n_pairs, round_even(po, 6) AS po, round_even(pe, 6) AS pe,
          round_even((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM k""",
)
def cohen_kappa(spark, d):
    """Two binary raters per language."""
    rated = b.table(spark, d, "labels").join(
        b.table(spark, d, "documents").select("doc_id", "lang"), "doc_id"
    )
    out = H.cohen_kappa(rated, "quality", "toxic", by=("lang",))
    return out.select("lang", "n_pairs", *[F.bround(c, 6).alias(c) for c in ("po", "pe", "kappa")])


def _sheet_sample(spark, d):
    """All records as a sample; question q4 was never answered by the judge."""
    return b.judgments(spark, d).select(
        "rec_id", "prompt_id", "model", F.lit("x").alias("sub_category"), "image_path",
        F.lit("text").alias("prompt_text"),
        F.expr(
            "transform(array('q1', 'q2', 'q4'), q -> named_struct('q_id', q, 'question', "
            "concat('Question ', q), 'type', 'presence'))"
        ).alias("questions"),
        F.col("answers").alias("judge_answers"),
    )


@query(
    "export_annotation_sheet",
    f"""WITH {b.REC} SELECT prompt_id, model, 'x' AS sub_category, image_path, 'text' AS prompt_text, q.q_id,
          'Question ' || q.q_id AS question, coalesce(CASE WHEN NOT no_answers THEN
            CASE q.q_id WHEN 'q1' THEN a1 WHEN 'q2' THEN a2 END END, '') AS judge_answer,
          '' AS human_answer, '' AS annotator
        FROM rec, (VALUES ('q1'), ('q2'), ('q4')) q(q_id)""",
)
def export_annotation_sheet(spark, d):
    return H.annotation_sheet(_sheet_sample(spark, d))


@query(
    "import_annotation_sheet",
    f"""WITH {b.ATOMS}, {_LABELS}, first AS (
          SELECT prompt_id, model, 'rater ' || min_by(seed % 10, lpad(seed::VARCHAR, 12, '0') || rec_id) AS annotator
          FROM cleaned GROUP BY prompt_id, model)
        SELECT prompt_id, model, annotator, q_id, human_answer FROM labels2 JOIN first USING (prompt_id, model)""",
)
def import_annotation_sheet(spark, d):
    """Cleaned labels regrouped into records and read back to rows."""
    sheet = H.clean_human_answers(raw_labels(spark, d)).withColumn(
        "annotator", F.expr("concat('rater ', seed % 10)")
    )
    records = H.label_records(sheet, F.struct("seed", "rec_id"))
    return H.label_rows(records).drop("pos")


@query(
    "unannotated",
    f"""WITH {b.ATOMS}, {_LABELS} SELECT DISTINCT model, prompt_id FROM rec
        WHERE (model, prompt_id) NOT IN (SELECT (model, prompt_id) FROM labels2 WHERE q_id = 'q2')""",
)
def unannotated(spark, d):
    sample = b.judgments(spark, d).select("model", "prompt_id").distinct()
    return H.unannotated(sample, labels(spark, d).filter("q_id = 'q2'"))


@query(
    "annotation_progress",
    f"""WITH {b.ATOMS}, {_LABELS}, a AS (SELECT count(DISTINCT (prompt_id, model)) AS n FROM labels2 WHERE q_id = 'q2')
        SELECT total, a.n AS annotated, total - a.n AS remaining
        FROM (SELECT count(*) AS total FROM (SELECT DISTINCT model, prompt_id FROM rec)), a""",
)
def annotation_progress(spark, d):
    sample = b.judgments(spark, d).select("model", "prompt_id").distinct()
    return H.annotation_progress(sample, labels(spark, d).filter("q_id = 'q2'"))


# Samples ---------------------------------------------------------------------------------------


def _hash_sql(ids, seed):
    return f"md5(concat_ws(':', '{seed}', {', '.join(ids)}))"


@query(
    "annotation_sample",
    f"""WITH {b.REC}, {b.PROMPTS}, x AS (
          SELECT rec.model, rec.prompt_id, rec.rec_id, p.sub_category,
            count(*) OVER (PARTITION BY rec.model, p.sub_category) AS n,
            row_number() OVER (PARTITION BY rec.model, p.sub_category
                               ORDER BY {_hash_sql(['rec.rec_id'], 42)}, rec.rec_id) AS rn
          FROM rec JOIN prompts p USING (prompt_id) WHERE image_path IS NOT NULL)
        SELECT model, prompt_id, rec_id, sub_category FROM x WHERE rn <= greatest(1, round_even(n * 0.1e0, 0))""",
)
def annotation_sample(spark, d):
    records = b.judgments(spark, d).select("model", "prompt_id", "rec_id", "image_path")
    # One prompt row per part, so this join cannot multiply rows.
    known = records.join(b.prompts(spark, d).select("prompt_id", "sub_category"), "prompt_id")
    return M.annotation_sample(known, ["rec_id"]).drop("image_path")


@query(
    "stratified_sample",
    f"""WITH a AS (SELECT doc_id, length(text) AS len, count(*) OVER () AS n,
            row_number() OVER (ORDER BY length(text), {_hash_sql(['doc_id'], 42)}, doc_id) AS r FROM documents),
        t AS (SELECT doc_id, CASE WHEN r <= n // 3 THEN 0 WHEN r <= 2 * (n // 3) THEN 1 ELSE 2 END AS stratum FROM a),
        s AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_hash_sql(['doc_id'], 43)}, doc_id) AS rn FROM t)
        SELECT doc_id, stratum FROM s WHERE rn <= CASE WHEN stratum = 2 THEN 34 ELSE 33 END""",
)
def stratified_sample(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    return M.stratified_sample(docs, "text", ["doc_id"], 100).select("doc_id", "stratum")


@query(
    "hash_split",
    f"""WITH x AS (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY {_hash_sql(['doc_id'], 42)}, doc_id) AS r
          FROM documents)
        SELECT doc_id, CASE WHEN r <= floor(n * 0.7e0) THEN 1 ELSE 2 END AS layer FROM x""",
)
def hash_split(spark, d):
    return M.hash_split(b.table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query(
    "balanced_limit",
    f"""WITH {b.PROMPTS}, x AS (SELECT prompt_id, sub_category, row_number() OVER (PARTITION BY sub_category ORDER BY prompt_id) AS rn,
          greatest(1, 100 // (SELECT count(DISTINCT sub_category) FROM prompts)) AS share FROM prompts
          WHERE sub_category IS NOT NULL)
        SELECT prompt_id, sub_category FROM x ORDER BY rn > share, CASE WHEN rn <= share THEN sub_category END, prompt_id LIMIT 100""",
)
def balanced_limit(spark, d):
    rows = b.prompts(spark, d).select("prompt_id", "sub_category").filter("sub_category IS NOT NULL")
    return M.balanced_limit(rows, "sub_category", ["prompt_id"], 100)


_POOL = f"""{b.IMAGES}, pool AS (SELECT *, {_hash_sql(['image_id'], 42)} AS h FROM images
    WHERE ("group" = 'person' AND regexp_matches(lower(filename), '[.](jpe?g|png|webp|gif)$'))
       OR ("group" <> 'person' AND contains(filename, 'full_scene'))),
  capped AS (SELECT *, row_number() OVER (PARTITION BY "group", category ORDER BY h, image_id) AS c FROM pool),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY h, image_id) AS r FROM capped
             WHERE "group" = 'person' OR c <= 2)"""
_MIX = f"""WITH {_POOL} SELECT image_id, "group", category, r AS rank FROM ranked
  WHERE r <= CASE "group" WHEN 'person' THEN 67 WHEN 'object' THEN 49 WHEN 'scene' THEN 33 ELSE 16 END"""


@query("target_mix", _MIX)
def target_mix(spark, d):
    picked = M.target_mix(b.images(spark, d), ["image_id"], 165)
    return picked.select("image_id", "group", "category", "rank")


@query(
    "diversity_cap",
    f"""WITH {b.IMAGES}, x AS (SELECT *, {_hash_sql(['image_id'], 42)} AS h FROM images),
        c AS (SELECT *, row_number() OVER (PARTITION BY "group", category ORDER BY h, image_id) AS c FROM x),
        r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY h, image_id) AS r FROM c
              WHERE "group" = 'person' OR c <= 2)
        SELECT image_id, "group", category FROM r WHERE r <= CASE "group" WHEN 'scene' THEN 10 ELSE 20 END""",
)
def diversity_cap(spark, d):
    quotas = {"person": 20, "object": 20, "scene": 10, "style": 20}
    return M.diversity_cap(b.images(spark, d), ["image_id"], quotas).select(
        "image_id", "group", "category"
    )


_GROUP_VALUES = ", ".join(
    f"('{g}', '{c}')" for g, cats in M.GROUP_CATEGORIES.items() for c in cats
)


@query(
    "group_categories",
    f"""WITH {b.IMAGES}, gc("group", edit_category) AS (VALUES {_GROUP_VALUES})
        SELECT image_id, "group", edit_category FROM images JOIN gc USING ("group")""",
)
def group_categories(spark, d):
    return M.group_categories(b.images(spark, d)).select("image_id", "group", "edit_category")


_CELL_VALUES = ", ".join(
    f"('{c}', '{x}', '{g}', {i})"
    for c, groups in M.CATEGORY_GROUPS.items()
    for x in M.DIFFICULTIES
    for i, g in enumerate(groups)
)


@query(
    "cell_quota_plan",
    f"""WITH {b.IMAGES}, cells(category, difficulty, "group", pos) AS (VALUES {_CELL_VALUES}),
        pool AS (SELECT image_id, "group", row_number() OVER (PARTITION BY "group" ORDER BY {_hash_sql(['image_id'], 42)}, image_id) AS rk
                 FROM images),
        av AS (SELECT "group", least(count(*), 36) AS n FROM pool GROUP BY "group"),
        w AS (SELECT c.*, n, row_number() OVER (PARTITION BY category, difficulty ORDER BY pos) AS pick FROM cells c JOIN av USING ("group")),
        w3 AS (SELECT *, (row_number() OVER (PARTITION BY "group" ORDER BY category, difficulty) - 1) % n + 1 AS rk FROM w WHERE pick <= 3)
        SELECT w3.category, w3.difficulty, w3."group", w3.pick::INT AS pick, pool.image_id FROM w3 JOIN pool USING ("group", rk)""",
)
def cell_quota_plan(spark, d):
    return M.cell_quota_plan(b.images(spark, d).select("image_id", "group"), ["image_id"])


_EDIT_CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.X.EDIT_CATEGORY_CODES.items())


@query(
    "assign_ids",
    f"""WITH {b.IMAGES}, gc("group", edit_category) AS (VALUES {_GROUP_VALUES}),
        x AS (SELECT image_id, edit_category, image_id % 2 + 1 AS layer,
                CASE edit_category {_EDIT_CODES} END AS code FROM images JOIN gc USING ("group"))
        SELECT image_id, edit_category, layer::INT AS layer, printf('L%d_%s_%03d', layer, code,
          row_number() OVER (PARTITION BY layer, code ORDER BY image_id)) AS prompt_id FROM x""",
)
def assign_ids(spark, d):
    planned = M.group_categories(b.images(spark, d)).select(
        "image_id", "edit_category", (F.col("image_id") % 2 + 1).cast("int").alias("layer")
    )
    return P.assign_ids(planned, "edit_category", ["image_id"])
