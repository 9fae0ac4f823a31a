import pytest
from pyspark.sql import functions as F

from rubrica.functions import text as X
from rubrica.operators import planning as P
from rubrica.operators import quality as Q
from rubrica.schemas import EDIT_PROMPT

ATOM = ("q1", "Is it done?", "instruction", "instruction_following")
KEEP = ("q2", "Is the rest kept?", "preservation", "visual_consistency")


def _prompt(pid, difficulty, text, atoms, category="x", turns="1"):
    return (pid, 1, category, category, difficulty, "source_images/object/a.jpg", text, turns, atoms)


def _rules(spark, *prompts):
    df = spark.createDataFrame(list(prompts), EDIT_PROMPT)
    out = {}
    for r in Q.prompt_warnings(df).collect():
        out.setdefault(r.prompt_id, set()).add(r.rule)
    return out


def test_every_warning_rule(spark):
    long = " ".join(["word"] * 26)
    got = _rules(
        spark,
        _prompt("clean", "easy", "Make the car blue", [ATOM, KEEP]),
        _prompt("odd", "extreme", "x", []),
        _prompt("short", "medium", "Make it blue", [ATOM, KEEP, KEEP]),
        _prompt("long", "easy", long, [ATOM, KEEP]),
        _prompt("few", "easy", "Make the car blue", [ATOM]),
        _prompt("many", "easy", "Make the car blue", [ATOM] * 6),
        _prompt("ops", "easy", "Paint it and move it and crop it", [ATOM, KEEP]),
        _prompt("space", "easy", "Change the viewpoint of this", [ATOM, KEEP]),
        _prompt("flip", "easy", "Flip the viewpoint of this", [ATOM, KEEP]),
        _prompt("plain", "easy", "Remove the cup on the left", [ATOM, KEEP]),
        _prompt("shadow", "easy", "Add a soft shadow", [ATOM, KEEP]),
        _prompt("chrome", "easy", "Add chrome shadow here", [ATOM, KEEP]),
        _prompt("hard", "hard", " ".join(["word"] * 25), [ATOM] * 5),
        _prompt("bad", "easy", "Make the car blue", [ATOM, ("q2", "?", "vibe", "mood")]),
        _prompt("noinstr", "easy", "Make the car blue", [KEEP, KEEP]),
        _prompt("turns", "easy", "Make the car blue", [ATOM, KEEP], "multi_turn", "2"),
        _prompt("turn1", "easy", "Make the car blue", [ATOM, KEEP], "multi_turn", '["a"]'),
        _prompt("turn2", "easy", "Make the car blue", [ATOM, KEEP], "multi_turn", '["a", "b"]'),
    )
    assert got == {
        "odd": {"unknown_difficulty"},
        "short": {"too_few_words"},
        "long": {"too_many_words"},
        "few": {"too_few_atoms"},
        "many": {"too_many_atoms"},
        "ops": {"easy_many_operations"},
        "space": {"easy_spatial"},
        "chrome": {"easy_physics"},
        "hard": {"hard_without_markers"},
        "bad": {"invalid_dimension", "invalid_type"},
        "noinstr": {"no_instruction_atom"},
        "turns": {"turns_not_a_list"},
        "turn1": {"too_few_turns"},
    }


def test_missing_source_images(spark):
    df = spark.createDataFrame([_prompt("a", "easy", "Make the car blue", [ATOM, KEEP])], EDIT_PROMPT)
    known = spark.createDataFrame([("other.jpg",)], "source_image string")
    assert [r.rule for r in Q.prompt_warnings(df, known).collect()] == ["source_image_missing"]


def test_text_functions(spark):
    row = spark.range(1).select(
        X.word_count(F.lit("  a b\n c ")).alias("words"), X.word_count(F.lit("")).alias("none"),
        X.count_atomic_ops(F.lit("style: flat, wide, tall, red and blue")).alias("ops"),
        X.join_turns(F.lit('["a", "b"]'), F.lit("x")).alias("turns"), X.join_turns(F.lit("2"), F.lit("x")).alias("one"),
        X.strip_prefix(F.lit("prompts/source/a.jpg")).alias("path"), X.image_group(F.lit("s/style/a.jpg")).alias("group"),
        F.decode(X.image_bytes(F.lit("data:image/png;base64,aGk=")), "UTF-8").alias("bytes"),
        X.seed_asset_name(F.lit("p"), F.lit(0)).alias("s0"), X.seed_asset_name(F.lit("p"), F.lit(1)).alias("s1"),
        X.turn_asset_name(F.lit("p"), F.lit(2)).alias("t2"),
    ).first()
    assert tuple(row) == (3, 0, 3, "a → b", "x", "source/a.jpg", "style", "hi", "p.png", "p__s1.png", "p_t2.png")


def test_replies(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', "sure: {\"a\": {\"b\": 2}} ok", "nothing here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.json_object(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None]


def test_question_rules(spark):
    qs = [("q1", "Are there EXACTLY 12 red cups?", "numeracy"), ("q2", "Is it wood?", "material"), ("q3", "reddish?", "taste")]
    df = spark.createDataFrame(
        [("p", "numeracy", "easy", "the third cup from the left", qs), ("n", "numeracy", "easy", "cups", [])],
        "prompt_id string, sub_category string, difficulty string, prompt_text string, "
        "atomic_questions array<struct<q_id:string,question:string,type:string>>",
    )
    got = {r.prompt_id: r for r in Q.prompt_traits(df).collect()}
    assert (got["p"].max_exact, got["p"].has_color, got["p"].ordinal, got["p"].n_material) == (12, True, True, 1)
    assert got["n"].max_exact is None and not got["n"].has_color
    shape = {(r.prompt_id, r.rule) for r in Q.question_shape_violations(df).collect()}
    assert shape == {("p", "invalid_question_type"), ("n", "too_few_questions")}
    assert {r.rule: r.n for r in Q.cohort_violations(Q.prompt_traits(df)).collect()} == {
        "compound": 0, "big": 1, "big_with_attribute": 1, "ordinal": 1,
    }
    assert {(r.bucket, r.n) for r in Q.cohort_distribution(Q.prompt_traits(df)).collect()} == {("7+", 1), ("<4", 1)}


def test_pending_work(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt_id string")
    log = spark.createDataFrame(
        [("m", "a", None, "SUCCESS"), ("m", "b", 0, "ERROR")], "model string, prompt_id string, seed int, status string"
    )
    got = {(r.prompt_id, r.seed) for r in P.pending_work(prompts, ["m"], 2, log).collect()}
    assert got == {("a", 1), ("b", 0), ("b", 1)}


def test_assign_ids(spark):
    df = spark.createDataFrame([(1, "physics", 1), (2, "physics", 1), (3, "cooking", 2)], "i int, c string, layer int")
    got = [r.prompt_id for r in P.assign_ids(df, "c", ["i"]).orderBy("i").collect()]
    assert got == ["L1_PH_001", "L1_PH_002", "L2_XX_001"]


def test_descriptions(spark):
    df = spark.createDataFrame(
        [("scene", "x", "A street with a dog, a steel bench, a chef"), ("person", "odd", "portrait")],
        "`group` string, category string, description string",
    )
    got = {r.group: r for r in P.editable_regions(P.parse_description(df)).collect()}
    scene = got["scene"]
    assert scene.objects == ["a dog", "a steel bench", "a chef"] and scene.materials == ["steel"]
    assert scene.scene_type == "outdoor" and scene.has_people
    assert scene.editable_regions[0] == "replace/modify a dog" and len(scene.editable_regions) == 8
    assert got["person"].editable_regions[5] == "pose/stance"


@pytest.mark.parametrize("layer, n", [(0, 2), (1, 1), (3, 2)])
def test_select_prompts(spark, layer, n):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "prompt_id string, layer int")
    assert P.select_prompts(df, layer).count() == n
