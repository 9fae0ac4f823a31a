"""Text rules: prompt quality, ids, names and model replies, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rubrica.functions.scoring import strip
from rubrica.schemas import THEME_MAP

# Words that mark a complex edit, by kind.
COMPLEXITY_MARKERS = {
    "spatial": [
        "left", "right", "behind", "in front", "above", "below", "next to", "opposite side",
        "viewpoint", "perspective", "parallax", "vanishing point",
    ],
    "physics": [
        "shadow", "reflection", "refraction", "caustic", "mirror", "chrome", "transparent",
        "water flow", "motion blur", "wet",
    ],
    "multi_object": ["all ", "every ", "each ", "both ", "everyone"],
    "compound": [" and ", " while ", " with correct", " matching the", " consistent with"],
}

# Spatial words that an easy prompt may use.
PLAIN_DIRECTIONS = ["left", "right", "behind", "above", "below"]

# Connectors that join two operations.
OPERATION_CONNECTORS = [" and ", " → ", ", then ", " while also ", " plus "]
LIST_STYLE_WORDS = ["flat", "strong", "wave"]
MAX_OPERATIONS = 8

# Ordinal words.
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
]

# Colour words.
COLOURS = [
    "red", "blue", "green", "yellow", "orange", "purple", "pink", "black", "white", "gray",
    "grey", "brown", "gold", "golden", "silver", "copper", "bronze",
]

# Id codes of the prompt sets.
CATEGORY_CODES = {
    "numeracy": "NUM",
    "complex_compositions": "CMP",
    "spatial_3d": "SP3",
}
EDIT_CATEGORY_CODES = {
    "color_material": "CM",
    "object_add": "OA",
    "object_remove": "OR",
    "object_replace": "RP",
    "background_change": "BG",
    "style_transfer": "ST",
    "lighting_weather": "LW",
    "spatial_pose": "SP",
    "anatomy_identity": "AI",
    "physics": "PH",
    "text_editing": "TE",
    "multi_turn": "MT",
}

# Words of image descriptions.
PEOPLE_WORDS = [
    "person", "people", "man", "woman", "child", "worker", "chef", "farmer", "tourist", "dancer",
    "musician",
]
MATERIAL_WORDS = [
    "wooden", "metal", "glass", "stone", "brick", "concrete", "marble", "steel", "plastic",
    "leather", "fabric", "ceramic", "bronze", "copper", "aluminum", "iron",
]
OUTDOOR_WORDS = [
    "outdoor", "street", "garden", "farm", "beach", "mountain", "lake", "river", "forest", "park",
    "road", "highway",
]

# White space of any script, the information separators included.
SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
IMAGE_SUFFIX = r"\.(jpe?g|png|webp|gif)$"
TURN_ARROW = " → "


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def contains_any(text: Column, words: list[str]) -> Column:
    """One regex pass instead of a word-by-word scan; words hold no regex characters."""
    return text.rlike("|".join(words))


def words_found(text: Column, words: list[str]) -> Column:
    """The listed words that occur in the text, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def occurrences(text: Column, marker: str) -> Column:
    """Non-overlapping count of a fixed substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast(
        "int"
    )


def count_atomic_ops(instruction: Column) -> Column:
    """Operations in an instruction: one plus its connectors, plus half the commas of a list."""
    lower = F.lower(instruction)
    joined = F.lit(1)
    for marker in OPERATION_CONNECTORS:
        joined = joined + occurrences(lower, marker)
    listed = F.contains(instruction, F.lit(":")) & contains_any(instruction, LIST_STYLE_WORDS)
    commas = F.floor(occurrences(instruction, ",") / 2).cast("int")
    return F.least(joined + F.when(listed, commas).otherwise(0), F.lit(MAX_OPERATIONS))


def has_complexity(instruction: Column, kind: str) -> Column:
    return contains_any(F.lower(instruction), COMPLEXITY_MARKERS[kind])


def exactly_counts(questions: Column) -> Column:
    """The numbers after "exactly" in the numeracy questions of a prompt."""
    numeracy = F.filter(questions, lambda q: q["type"] == "numeracy")
    found = F.transform(
        numeracy,
        lambda q: F.regexp_extract(q["question"], r"(?i)\bexactly\s+(\d+)", 1).try_cast("int"),
    )
    return F.filter(found, lambda n: n.isNotNull())


def type_count(questions: Column, kind: str) -> Column:
    return F.size(F.filter(questions, lambda q: q["type"] == kind))


def is_ordinal(text: Column) -> Column:
    lower = F.lower(text)
    worded = contains_any(lower, [f"{w} " for w in ORDINALS]) & F.contains(lower, F.lit("from the"))
    return worded | lower.rlike(r"\b\d+(?:st|nd|rd|th)\b")


def has_color_attribute(questions: Column) -> Column:
    """A question names a colour as a whole run of letters."""
    pattern = "(?<![a-z])(?:" + "|".join(COLOURS) + ")(?![a-z])"
    return F.exists(questions, lambda q: F.lower(q["question"]).rlike(pattern))


def has_attribute_binding(questions: Column) -> Column:
    return has_color_attribute(questions) | (type_count(questions, "material") >= 1)


def json_object(text: Column) -> Column:
    """The outermost {...} of a reply, code fences or not; NULL when there is none."""
    body = F.regexp_replace(strip(text), r"^```(?:json)?\s*", "")
    body = F.regexp_replace(body, r"\s*```$", "")
    found = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def fenced_json(text: Column) -> Column:
    """The text inside a json fence (else all of it) without control characters."""
    inside = F.regexp_extract(text, r"(?s)```json\n(.*?)\n```", 1)
    return F.regexp_replace(F.when(inside != "", inside).otherwise(text), r"[\x00-\x1f\x7f]", "")


def fenced_scores(text: Column) -> Column:
    return F.from_json(fenced_json(text), "MAP<STRING, DOUBLE>")


def theme_map(text: Column) -> Column:
    return F.from_json(text, THEME_MAP)


def normalize_questions(questions: Column, prompt_text: Column) -> Column:
    """Number the questions q1.., default type presence; none at all gives one about the prompt."""
    numbered = F.transform(
        questions,
        lambda q, i: F.struct(
            F.concat(F.lit("q"), (i + 1).cast("string")).alias("q_id"),
            q["question"].alias("question"),
            F.coalesce(q["type"], F.lit("presence")).alias("type"),
        ),
    )
    whole = F.array(
        F.struct(
            F.lit("q1").alias("q_id"),
            F.concat(
                F.lit('Does the image match the prompt: "'), prompt_text, F.lit('"?')
            ).alias("question"),
            F.lit("presence").alias("type"),
        )
    )
    return F.when(F.coalesce(F.size(questions), F.lit(0)) > 0, numbered).otherwise(whole)


def format_questions(questions: Column) -> Column:
    return F.array_join(
        F.transform(questions, lambda q: F.concat(F.lit("  - "), q["q_id"], F.lit(": "), q["question"])),
        "\n",
    )


def prompt_id(
    layer: Column, category: Column, n: Column, codes: dict[str, str] | None = None,
    unknown: str | None = None,
) -> Column:
    """``L1_CM_001``; an unknown category takes the given code, or fails the job without one."""
    code = F.element_at(literal_map(codes or CATEGORY_CODES), category)
    fallback = (
        F.lit(unknown)
        if unknown is not None
        else F.raise_error(F.concat(F.lit("no id code for category "), category)).cast("string")
    )
    return F.format_string(
        "L%d_%s_%03d", layer.cast("int"), F.coalesce(code, fallback), n.cast("bigint")
    )


def seed_asset_name(prompt: Column, seed: Column) -> Column:
    return F.concat(
        prompt, F.when(seed == 0, "").otherwise(F.concat(F.lit("__s"), seed.cast("string"))),
        F.lit(".png"),
    )


def turn_asset_name(prompt: Column, turn: Column) -> Column:
    return F.concat(
        prompt, F.when(turn > 1, F.concat(F.lit("_t"), turn.cast("string"))).otherwise(""),
        F.lit(".png"),
    )


def turn_list(turns: Column) -> Column:
    """``turns`` as a list when it holds one, NULL when it is a plain number."""
    return F.when(strip(turns).startswith("["), F.from_json(turns, "ARRAY<STRING>"))


def join_turns(turns: Column, instruction: Column) -> Column:
    return F.coalesce(F.array_join(turn_list(turns), TURN_ARROW), instruction)


def image_bytes(data: Column) -> Column:
    """Base64 text, with or without a data-URI head, to bytes."""
    body = F.when(data.startswith("data:"), F.regexp_replace(data, "^[^,]*,", "")).otherwise(data)
    return F.unbase64(body)


def image_group(path: Column) -> Column:
    out = F
    for group in ["person", "object", "scene", "style"]:
        out = out.when(F.contains(path, F.lit(f"/{group}/")), group)
    return out.otherwise("unknown")


def strip_prefix(path: Column) -> Column:
    return F.regexp_replace(path, "^prompts/", "")


def is_image_name(name: Column) -> Column:
    return F.lower(name).rlike(IMAGE_SUFFIX)


def is_full_scene(name: Column) -> Column:
    return F.contains(name, F.lit("full_scene"))
