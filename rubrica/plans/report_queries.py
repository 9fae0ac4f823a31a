"""Queries: ranks, examples, themes, costs, chains, weighted scores, report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.functions import scoring as S
from rubrica.functions import text as X
from rubrica.operators import chains as N
from rubrica.operators import costs as C
from rubrica.operators import reporting as R
from rubrica.operators import scores as A
from rubrica.operators import themes as T
from rubrica.operators import weighted as G
from rubrica.plans import bindings as b
from rubrica.plans.registry import query
from rubrica.plans.score_queries import (
    BOARD, CELLS, EDIT_BOARD, LAYERS, THEME_TABLE, board, cells, layers, leaderboard_edit, resolved,
    theme_table,
)

# Leaderboard -----------------------------------------------------------------------------------


@query(
    "order_by_quality",
    f"""{BOARD} SELECT model, overall_gm_covered, overall_gm FROM board
        ORDER BY overall_gm_covered DESC NULLS LAST, overall_gm DESC, model""",
)
def order_by_quality(spark, d):
    return R.order_by_quality(board(spark, d)).select("model", "overall_gm_covered", "overall_gm")


@query(
    "model_rank",
    f"{BOARD} SELECT model, overall_gm_covered, (row_number() OVER (ORDER BY overall_gm_covered DESC NULLS LAST, model))::INT AS rank FROM board",
)
def model_rank(spark, d):
    return R.model_rank(board(spark, d)).select("model", "overall_gm_covered", "rank")


@query(
    "leaderboard_display",
    f"""{BOARD} SELECT model, printf('%.3f', coalesce(overall_am_covered, overall_am)) AS am_covered,
        printf('%.3f', coalesce(overall_gm_covered, overall_gm)) AS gm_covered, printf('%.3f', overall_am) AS am_full,
        printf('%.3f', overall_gm) AS gm_full, n_covered || '/' || n_total AS coverage FROM board""",
)
def leaderboard_display(spark, d):
    return R.leaderboard_display(board(spark, d))


@query(
    "top_k",
    f"{BOARD} SELECT model, overall_gm_covered FROM board ORDER BY overall_gm_covered DESC, model LIMIT 3",
)
def top_k(spark, d):
    order = [F.desc_nulls_last("overall_gm_covered"), "model"]
    return R.top_k(board(spark, d), order).select("model", "overall_gm_covered")


@query(
    "score_band",
    f"WITH {b.SCORES}, {CELLS} SELECT model, sub_category, CASE WHEN am >= 0.8 THEN 'green' WHEN am >= 0.5 THEN 'amber' ELSE 'red' END AS band FROM cells",
)
def score_band(spark, d):
    return cells(spark, d).select("model", "sub_category", S.score_band(F.col("am")).alias("band"))


@query(
    "cell_extremes",
    f"""WITH {b.SCORES}, {CELLS} SELECT *, CASE WHEN gm = max(gm) OVER (PARTITION BY sub_category) THEN 'top'
        WHEN gm = min(gm) OVER (PARTITION BY sub_category) THEN 'low' ELSE 'mid' END AS cell FROM cells""",
)
def cell_extremes(spark, d):
    return R.cell_extremes(cells(spark, d))


@query(
    "layer_narrative",
    f"""WITH {b.SCORES}, {LAYERS} SELECT model, divergence_gm, CASE WHEN divergence_gm > 0.1 THEN 'saturated'
        WHEN divergence_gm < -0.1 THEN 'reversed' WHEN divergence_gm IS NOT NULL THEN 'consistent' END AS narrative FROM layers""",
)
def layer_narrative(spark, d):
    return R.layer_narrative(layers(spark, d)).select("model", "divergence_gm", "narrative")


@query(
    "wedge_candidates",
    f"WITH {b.SCORES}, {LAYERS} SELECT model, divergence_gm FROM layers WHERE divergence_gm > 0.0",
)
def wedge_candidates(spark, d):
    return A.wedge_candidates(layers(spark, d), threshold=0.0).select("model", "divergence_gm")


@query(
    "compare_pipelines",
    f"""{BOARD}, u AS (SELECT 't2i' AS pipeline, model, overall_gm FROM board
          UNION ALL SELECT 'edit', model, overall_gm FROM ({EDIT_BOARD} SELECT * FROM board))
        SELECT pipeline, count(*) AS n_models, round_even(sum(overall_gm::DECIMAL(18,4))::DOUBLE / count(*), 3) AS mean_gm,
          arg_max(model, (overall_gm, model)) AS best_model, round_even(quantile_cont(overall_gm, 0.0e0), 6) AS gm_min,
          round_even(quantile_cont(overall_gm, 0.25e0), 6) AS gm_q1, round_even(quantile_cont(overall_gm, 0.5e0), 6) AS gm_median,
          round_even(quantile_cont(overall_gm, 0.75e0), 6) AS gm_q3, round_even(quantile_cont(overall_gm, 1.0e0), 6) AS gm_max
        FROM u GROUP BY pipeline""",
)
def compare_pipelines(spark, d):
    out = R.compare_pipelines({"t2i": board(spark, d), "edit": leaderboard_edit(spark, d)})
    quartiles = ["gm_min", "gm_q1", "gm_median", "gm_q3", "gm_max"]
    return out.withColumns({c: F.bround(c, 6) for c in quartiles})


# Examples --------------------------------------------------------------------------------------


@query(
    "worst_examples",
    f"""WITH {b.RESOLVED}, {b.PROMPTS}, w AS (SELECT *, row_number() OVER (PARTITION BY model
          ORDER BY score_gm, prompt_id, seed, rec_id) AS rank FROM j WHERE image_path IS NOT NULL)
        SELECT w.model, w.rank::INT AS rank, w.prompt_id, w.rec_id, round_even(w.score_gm, 6) AS score_gm,
          coalesce(prompt_text, '') AS prompt_text, coalesce(sub_category, '') AS sub_category
        FROM w LEFT JOIN prompts USING (prompt_id) WHERE rank <= 5""",
)
def worst_examples(spark, d):
    worst = R.worst_examples(resolved(spark, d), b.prompts(spark, d), ["rec_id"], 5)
    return worst.select(
        "model", "rank", "prompt_id", "rec_id", F.bround("score_gm", 6).alias("score_gm"),
        "prompt_text", "sub_category",
    )


@query(
    "failure_examples",
    f"""WITH {b.RESOLVED}, {b.PROMPTS},
        o AS (SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY score_gm, seed, rec_id) AS rp
              FROM j WHERE coalesce(judge_error, '') = '' AND NOT no_answers),
        m AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score_gm, prompt_id) AS rank FROM o WHERE rp = 1),
        v AS (SELECT *, printf('%.2f', p1)::DOUBLE <= printf('%.2f', p2)::DOUBLE AS one FROM m WHERE rank <= 3)
        SELECT v.model, v.rank::INT AS rank, v.prompt_id, coalesce(p.sub_category, 'unknown') AS sub_category,
          coalesce(p.prompt_text, '') AS prompt_text, printf('%.2f', v.score_gm) AS gm, printf('%.2f', v.score_am) AS am,
          CASE WHEN (CASE WHEN one THEN p1 ELSE p2 END) >= 0.5e0 THEN ''
            ELSE 'Weakest atom: "' || CASE WHEN one THEN question1 ELSE 'Is the rest kept?' END || '" at p='
              || printf('%.2f', CASE WHEN one THEN p1 ELSE p2 END) || '.' END AS diagnosis
        FROM v LEFT JOIN prompts p USING (prompt_id)""",
)
def failure_examples(spark, d):
    return R.failure_examples(resolved(spark, d), b.prompts(spark, d), ["rec_id"], 3)


@query(
    "ranked_atoms",
    f"""WITH {b.ATOMS}, r AS (SELECT rec_id, q_id, probability, answer,
          row_number() OVER (PARTITION BY rec_id ORDER BY coalesce(probability, 0) DESC, q_id) AS rank FROM atoms)
        SELECT rec_id, rank::INT AS rank, q_id, CASE WHEN probability IS NULL THEN coalesce(answer = 'yes', false)
          ELSE probability >= 0.5e0 END AS passed FROM r WHERE rank <= 2""",
)
def ranked_atoms(spark, d):
    rows = b.judgments(spark, d).select(
        "rec_id", F.posexplode(R.ranked_atoms(F.col("answers"), 2)).alias("pos", "a")
    )
    return rows.select("rec_id", (F.col("pos") + 1).alias("rank"), "a.q_id", "a.passed")


# Themes ----------------------------------------------------------------------------------------


@query(
    "theme_extremes",
    f"""WITH {b.COLLAPSED}, {b.THEMES}, {THEME_TABLE},
        e AS (SELECT model, theme, mean_score_gm, n_prompts FROM tb WHERE n_prompts >= 15),
        t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_score_gm DESC, theme) AS rank, 'top' AS side FROM e),
        w AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_score_gm, theme DESC) AS rank, 'bottom' AS side FROM e)
        SELECT * REPLACE (rank::INT AS rank) FROM (SELECT * FROM t UNION ALL SELECT * FROM w) WHERE rank <= 5""",
)
def theme_extremes(spark, d):
    return T.theme_extremes(theme_table(spark, d))


@query(
    "theme_variance",
    f"""WITH {b.COLLAPSED}, {b.THEMES}, {THEME_TABLE},
        v AS (SELECT theme, count(DISTINCT model) AS n_models, stddev_samp(mean_score_gm) AS spread FROM tb
              WHERE n_prompts >= 15 GROUP BY theme HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM tb))
        SELECT theme, n_models, round_even(spread, 6) AS spread FROM v ORDER BY v.spread DESC, theme LIMIT 5""",
)
def theme_variance(spark, d):
    return T.theme_variance(theme_table(spark, d)).withColumn("spread", F.bround("spread", 6))


@query(
    "theme_tag_stats",
    f"""WITH {b.TAGGED} SELECT min(len(themes))::INT AS min_tags, max(len(themes))::INT AS max_tags,
        round_even(avg(len(themes)), 1) AS mean_tags, count(*) FILTER (WHERE len(themes) = 0) AS n_untagged,
        count(*) AS n_prompts FROM tagged""",
)
def theme_tag_stats(spark, d):
    return T.theme_tag_stats(b.tagged(spark, d))


@query(
    "theme_usage",
    f"WITH {b.THEMES} SELECT theme, count(*) AS n FROM themes GROUP BY theme ORDER BY n DESC, theme LIMIT 10",
)
def theme_usage(spark, d):
    return T.theme_usage(b.tagged(spark, d))


_TAXONOMY = "tax AS (SELECT DISTINCT concat(' ', upper(p_name), ' ') AS id, 'About ' || p_name || ' ' AS description FROM part WHERE p_size % 2 = 0 UNION ALL SELECT '  ', 'blank')"


def _taxonomy(spark, d):
    names = b.table(spark, d, "part").filter("p_size % 2 = 0").selectExpr(
        "concat(' ', upper(p_name), ' ') AS id", "concat('About ', p_name, ' ') AS description"
    )
    blank = spark.range(1).selectExpr("'  ' AS id", "'blank' AS description")
    return names.distinct().union(blank)


@query(
    "clean_taxonomy",
    f"WITH {_TAXONOMY} SELECT lower(trim(id)) AS id, trim(description) AS description FROM tax WHERE trim(id) <> ''",
)
def clean_taxonomy(spark, d):
    return T.clean_taxonomy(_taxonomy(spark, d))


@query(
    "taxonomy_size_check",
    f"WITH {_TAXONOMY} SELECT count(*) AS n_themes, count(*) BETWEEN 15 AND 25 AS in_range FROM tax",
)
def taxonomy_size_check(spark, d):
    return T.taxonomy_size_check(_taxonomy(spark, d))


@query(
    "clean_tags",
    f"""WITH {_TAXONOMY}, ids AS (SELECT DISTINCT lower(trim(id)) AS id FROM tax WHERE trim(id) <> '')
        SELECT concat('P', p_partkey) AS prompt_id, 0 AS pos, p_name AS theme FROM part WHERE p_name IN (SELECT id FROM ids)""",
)
def clean_tags(spark, d):
    """Tags with noise: other case, a repeat, and words that are no theme."""
    tagged = b.table(spark, d, "part").selectExpr(
        "concat('P', p_partkey) AS prompt_id", "array(concat(upper(p_name), ' '), p_name, p_type, 'x') AS tags"
    )
    return T.clean_tags(tagged, T.clean_taxonomy(_taxonomy(spark, d)))


@query(
    "theme_map",
    f"WITH {b.THEMES} SELECT prompt_id, theme FROM themes",
)
def theme_map(spark, d):
    """JSON objects of tag lists, with one broken document that reads as empty."""
    from rubrica.sources.readers import theme_map_rows

    documents = b.tagged(spark, d).select(
        F.to_json(F.map_from_arrays(F.array("prompt_id"), F.array("themes"))).alias("value")
    )
    broken = spark.range(1).select(F.lit("[not a theme map").alias("value"))
    return theme_map_rows(documents.union(broken))


# Costs -----------------------------------------------------------------------------------------

CAP = 5_000.0


@query(
    "cost_ledger",
    f"""WITH {b.LOG}, r AS (SELECT event_id, ts, amount, sum(amount) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS t FROM log)
        SELECT event_id, round_even(t, 4) AS running_total, t < {CAP} AS under_cap,
          t >= {CAP * 0.8} AND NOT coalesce(bool_or(t >= {CAP * 0.8}) OVER earlier, false) AS alert,
          coalesce(last_value(t) OVER earlier, 0) < {CAP} AS may_start FROM r
        WINDOW earlier AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def cost_ledger(spark, d):
    ledger = C.cost_ledger(b.log(spark, d), CAP, ["ts", "event_id"])
    return ledger.select(
        "event_id", F.bround("running_total", 4).alias("running_total"), "alert", "under_cap", "may_start"
    )


@query(
    "cost_summary",
    f"""WITH {b.LOG} SELECT model, stage, round_even(sum(amount), 4) AS total_usd FROM log
        GROUP BY GROUPING SETS ((), (model), (stage))""",
)
def cost_summary(spark, d):
    return C.cost_summary(b.log(spark, d))


@query(
    "cap_check",
    f"WITH {b.LOG} SELECT round_even(sum(amount), 4) AS total_usd, sum(amount) < {CAP} AS under_cap, {CAP}::DOUBLE AS cap_usd FROM log",
)
def cap_check(spark, d):
    return C.cap_check(b.log(spark, d), CAP)


@query(
    "estimate_cost",
    """SELECT count(*) AS n_models, (SELECT count(*) FROM part) AS n_prompts,
        (count(*) * (SELECT count(*) FROM part) * 3)::BIGINT AS n_items,
        round_even(sum(s_acctbal) * (SELECT count(*) FROM part) * 3, 2) AS estimated_usd FROM supplier""",
)
def estimate_cost(spark, d):
    models = b.table(spark, d, "supplier").selectExpr("s_name AS model", "s_acctbal AS cost_per_unit")
    return C.estimate_cost(models, b.prompts(spark, d), seeds=3)


@query(
    "duration_sec",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        round_even((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0e0, 2) AS duration_sec
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def duration_sec(spark, d):
    joined = b.table(spark, d, "lineitem").join(
        b.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        S.duration_sec(F.col("o_orderdate"), F.col("l_shipdate")).alias("duration_sec"),
    )


# Chains ----------------------------------------------------------------------------------------


@query(
    "final_turn",
    f"""WITH {b.CHAINS}, ok AS (SELECT * FROM chains WHERE status = 'SUCCESS')
        SELECT model, prompt_id, max(turn) AS turn, arg_max(image_path, turn) AS image_path,
          max(source_image_path) FILTER (WHERE turn = 1) AS source_image_path FROM ok GROUP BY model, prompt_id""",
)
def final_turn(spark, d):
    return N.final_turn(b.chains(spark, d), F.col("log_order"))


@query(
    "chain_status",
    f"""WITH {b.CHAINS} SELECT c.model, c.prompt_id, c.turn, c.status,
          CASE WHEN c.turn = 1 THEN c.source_image_path ELSE p.image_path END AS source_image_path,
          k.break_turn, coalesce(c.turn > k.break_turn, false) AS after_break
        FROM chains c LEFT JOIN chains p ON p.model = c.model AND p.prompt_id = c.prompt_id AND p.turn + 1 = c.turn
        LEFT JOIN (SELECT model, prompt_id, min(turn) AS break_turn FROM chains WHERE status <> 'SUCCESS' GROUP BY ALL) k
          ON k.model = c.model AND k.prompt_id = c.prompt_id""",
)
def chain_status(spark, d):
    return N.chain_status(b.chains(spark, d)).select(
        "model", "prompt_id", "turn", "status", "source_image_path", "break_turn", "after_break"
    )


@query(
    "chain_completion",
    f"""WITH {b.CHAINS} SELECT model, prompt_id, max(turn) AS n_turns,
          min(turn) FILTER (WHERE status <> 'SUCCESS') AS break_turn, bool_and(status = 'SUCCESS') AS complete
        FROM chains GROUP BY model, prompt_id""",
)
def chain_completion(spark, d):
    return N.chain_completion(b.chains(spark, d))


@query(
    "join_turns",
    f"""WITH {b.EDIT_PROMPTS} SELECT prompt_id, CASE WHEN turns = '1' THEN edit_instruction
          WHEN turns LIKE '%then%' THEN 'do this → then that' ELSE 'only this' END AS instruction FROM ep""",
)
def join_turns(spark, d):
    return N.edit_instructions(b.edit_prompts(spark, d)).select("prompt_id", "instruction")


# Weighted scores -------------------------------------------------------------------------------

_WEIGHTED = """w AS (SELECT concat('model_', l_suppkey % 5) AS model, p_brand AS category, l_returnflag AS subcategory, l_orderkey AS source_id,
    l_quantity AS weight, CASE WHEN l_tax < 0.08 THEN (l_linenumber % 3) * 0.5e0 END AS score
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  items AS (SELECT model, category, subcategory, source_id, printf('%.2f', coalesce(sum(weight * score) /
    sum(weight) FILTER (WHERE score IS NOT NULL), 0))::DOUBLE AS score, count(score) AS n_answered
    FROM w GROUP BY model, category, subcategory, source_id)"""


def _items(spark, d):
    brand = b.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = b.table(spark, d, "lineitem").join(brand, "l_partkey").selectExpr(
        "concat('model_', l_suppkey % 5) AS model", "p_brand AS category", "l_returnflag AS subcategory",
        "l_orderkey AS source_id", "l_quantity AS weight", "CASE WHEN l_tax < 0.08 THEN (l_linenumber % 3) * 0.5D END AS score",
    )
    return G.weighted_score(rows)


@query("weighted_score", f"WITH {_WEIGHTED} SELECT * FROM items")
def weighted_score(spark, d):
    return _items(spark, d)


@query(
    "category_scores",
    f"WITH {_WEIGHTED} SELECT model, category, printf('%.2f', sum(score::DECIMAL(18,2))::DOUBLE / count(score))::DOUBLE AS avg, count(*) AS n FROM items GROUP BY ALL",
)
def category_scores(spark, d):
    return G.category_scores(_items(spark, d))


_BRANDS = [f"Brand#{k}" for k in range(1, 26)]
_BRAND_COLUMNS = ", ".join(
    f"""coalesce(max(printf('%.2f', a)) FILTER (WHERE category = '{c}'), '---') AS "{c}" """
    for c in [*_BRANDS, "none"]
)


@query(
    "category_table",
    f"""WITH {_WEIGHTED}, c AS (SELECT model, category, printf('%.2f', sum(score::DECIMAL(18,2))::DOUBLE / count(score))::DOUBLE AS a FROM items GROUP BY ALL)
        SELECT model, {_BRAND_COLUMNS} FROM c GROUP BY model""",
)
def category_table(spark, d):
    return G.category_table(G.category_scores(_items(spark, d)), [*_BRANDS, "none"])


@query(
    "answered_questions",
    """SELECT concat('model_', o_custkey % 5) AS model, o_orderkey AS source_id, l_linenumber::VARCHAR AS id, l_partkey, l_suppkey,
        l_quantity AS weight, CASE l_linenumber WHEN 1 THEN 0.5e0 WHEN 2 THEN (o_orderkey % 3) * 0.5e0 END AS score
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def answered_questions(spark, d):
    """Fenced replies, one per order, scored against the questions of that order."""
    replies = b.table(spark, d, "orders").selectExpr(
        "concat('model_', o_custkey % 5) AS model", "'c' AS category", "'s' AS subcategory", "o_orderkey AS source_id",
        r"""concat('Sure!\n```json\n{"1": 0.5, \n"2": ', (o_orderkey % 3) * 0.5D, '}\n```') AS reply""",
    )
    replies = replies.select(
        "model", "category", "subcategory", "source_id", X.fenced_scores(F.col("reply")).alias("scores")
    )
    questions = b.table(spark, d, "lineitem").selectExpr(
        "'c' AS category", "'s' AS subcategory", "l_orderkey AS source_id", "cast(l_linenumber AS string) AS id",
        "l_partkey", "l_suppkey", "l_quantity AS weight",
    )
    return G.answered_questions(questions, replies).drop("category", "subcategory")


@query(
    "text_key_join",
    """WITH known AS (SELECT p_name AS t, max(concat('R2I_', p_partkey)) AS prompt_id FROM part WHERE p_size % 2 = 0 GROUP BY p_name)
        SELECT p_partkey AS id, p_name AS prompt_text, k.prompt_id FROM part JOIN known k ON k.t = p_name
        WHERE k.prompt_id IN (SELECT concat('R2I_', l_partkey) FROM lineitem)""",
)
def text_key_join(spark, d):
    part = b.table(spark, d, "part")
    source = part.selectExpr("p_partkey AS id", "p_name AS prompt_text")
    known = part.selectExpr(
        "CASE WHEN p_size % 2 = 0 THEN concat('R2I_', p_partkey) ELSE concat('L1_', p_partkey) END AS prompt_id",
        "p_name AS prompt_text",
    )
    images = b.table(spark, d, "lineitem").selectExpr("concat('R2I_', l_partkey) AS prompt_id")
    return G.text_key_join(source, known, images)


@query(
    "bundle_report",
)
def bundle_report(spark, d):
    """All score tables as one JSON row."""
    from rubrica.plans.score_queries import merged
    from rubrica.sources.writers import bundle_report as bundle

    scores = merged(spark, d)
    return bundle(
        A.summary_stats(scores),
        {
            "leaderboard": (A.leaderboard(scores), [-F.col("overall_gm_covered"), "model"]),
            "layer_comparison": (layers(spark, d), ["model"]),
            "per_subcategory": (A.per_subcategory(scores, b.SUB_CATEGORIES), ["model"]),
        },
    )
