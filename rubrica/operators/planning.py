"""Work selection: prompts, models, pending items, ids, images and object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.functions import text as X
from rubrica.operators.ranking import rank_within, top_n

SAMPLE_KEYS = 3


def select_prompts(prompts: DataFrame, layer: int = 0, ids: list[str] | None = None) -> DataFrame:
    """Layer 1 or 2 (anything else keeps all) and, when given, the listed ids."""
    out = prompts.filter(F.col("layer") == layer) if layer in (1, 2) else prompts
    return out.filter(F.col("prompt_id").isin(*ids)) if ids else out


def select_prompt_table(prompts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same by a table of ids."""
    return prompts.join(wanted.select("prompt_id").distinct(), "prompt_id", "left_semi")


def union_layers(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def unknown_models(selected: DataFrame, registered: DataFrame) -> DataFrame:
    return difference(selected, registered, ["model"])


def known_models(selected: DataFrame, registered: DataFrame) -> DataFrame:
    return intersection(selected, registered, ["model"])


def pending_work(prompts: DataFrame, models: list[str], seeds: int, log: DataFrame) -> DataFrame:
    """(model, prompt_id, seed) items without a successful log row.

    The wanted items are exploded from each prompt; the done items are made distinct first, so
    an item logged over and over is one row when it is joined.
    """
    wanted = prompts.select(
        "prompt_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    ).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    done = log.filter(F.col("status") == S.SUCCESS).select(
        "model", "prompt_id", F.coalesce("seed", F.lit(0)).alias("seed")
    )
    return difference(wanted, done, ["model", "prompt_id", "seed"])


def pending_chains(prompts: DataFrame, models: list[str], completion: DataFrame) -> DataFrame:
    """(model, prompt_id) chains that are not complete yet."""
    wanted = prompts.select(
        "prompt_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    )
    return difference(wanted, completion.filter("complete"), ["model", "prompt_id"])


def assign_ids(
    prompts: DataFrame, category: str, order: list[Column | str],
    codes: dict[str, str] | None = None, unknown: str | None = "XX",
) -> DataFrame:
    """Ids like ``L1_CM_001``, numbered in order per (layer, code)."""
    codes = codes or X.EDIT_CATEGORY_CODES
    code = F.coalesce(F.element_at(X.literal_map(codes), F.col(category)), F.lit(unknown or ""))
    numbered = rank_within(prompts.withColumn("_code", code), ["layer", "_code"], order, "_n")
    pid = X.prompt_id(F.col("layer"), F.col(category), F.col("_n"), codes, unknown)
    return numbered.withColumn("prompt_id", pid).drop("_code", "_n")


def key_inventory(keys: DataFrame, key: str = "key") -> DataFrame:
    """Per top-level prefix: images, second-level prefixes, three sample image keys, and the
    keys below ``accepted/`` and ``rejected/``.

    Sample keys come from a top-3 cut; second-level prefixes are counted as distinct values.
    """
    rest = F.substring_index(F.col(key), "/", -1)
    depth = F.size(F.split(F.col(key), "/"))
    second = F.when(depth > 2, F.split(F.col(key), "/")[1])
    rows = keys.select(
        F.col(key).alias("key"),
        F.concat(F.substring_index(F.col(key), "/", 1), F.lit("/")).alias("prefix"),
        second.alias("second"),
        X.is_image_name(rest).alias("is_image"),
    ).filter(F.contains(F.col("key"), F.lit("/")))
    counts = rows.groupBy("prefix").agg(
        F.count_if("is_image").alias("n_images"),
        F.count_if(F.col("second") == "accepted").alias("n_accepted"),
        F.count_if(F.col("second") == "rejected").alias("n_rejected"),
        F.count_distinct("second").alias("n_sub_prefixes"),
    )
    samples = (
        top_n(rows.filter("is_image").select("prefix", "key"), ["prefix"], ["key"], SAMPLE_KEYS)
        .groupBy("prefix")
        .agg(*[
            F.max(F.when(F.col("rank") == i, F.col("key"))).alias(f"sample_{i}")
            for i in range(1, SAMPLE_KEYS + 1)
        ])
    )
    found = counts.filter((F.col("n_images") > 0) | (F.col("n_sub_prefixes") > 0))
    return found.join(samples, "prefix", "left")


def parse_description(images: DataFrame) -> DataFrame:
    """Objects, materials, people and setting read off a scene description."""
    desc = F.coalesce(F.col("description"), F.lit(""))
    lower = F.lower(desc)
    parts = F.split(desc, " with ")
    listed = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " with ")
    objects = F.filter(
        F.transform(F.split(listed, ", "), lambda o: S.strip(o)), lambda o: o != ""
    )
    return images.withColumns(
        {
            "scene_type": F.when(X.contains_any(lower, X.OUTDOOR_WORDS), "outdoor").otherwise("indoor"),
            "primary_subject": F.substring(S.strip(parts[0]), 1, 100),
            "has_people": X.contains_any(lower, X.PEOPLE_WORDS),
            "objects": F.slice(objects, 1, 15),
            "materials": X.words_found(lower, X.MATERIAL_WORDS),
        }
    )


# Editable regions of person images, by category.
PERSON_REGIONS = {
    "person_portrait": [
        "hair color/style", "eye color", "skin tone", "facial expression", "clothing/top",
        "accessories (glasses, jewelry, hat)", "background behind subject", "lighting/mood",
    ],
    "person_fullbody": [
        "hair color/style", "top/shirt", "bottom/pants/skirt", "shoes/footwear",
        "accessories (bag, watch, hat)", "pose/stance", "background/environment",
        "ground surface", "lighting/shadows",
    ],
    "person_group": [
        "specific person's clothing", "add/remove a person", "background environment",
        "group arrangement", "lighting/time of day", "foreground objects",
        "individual accessories", "ground surface",
    ],
}
PERSON_SUBJECTS = {
    "person_portrait": ("studio/outdoor", "person portrait (head and shoulders)"),
    "person_fullbody": ("outdoor/indoor", "person full body shot"),
    "person_group": ("outdoor/indoor", "group of people"),
}
DEFAULT_PERSON = "person_fullbody"
MAX_REGIONS = 8


def editable_regions(parsed: DataFrame) -> DataFrame:
    """What can be edited in an image; persons take the list of their category.

    ``parsed`` comes from ``parse_description``.
    """
    first = F.get("objects", F.lit(0))
    scene = F.array_compact(
        F.array(
            F.when(first.isNotNull(), F.concat(F.lit("replace/modify "), first)),
            F.lit("background/environment change"),
            F.lit("lighting/time of day change"),
            F.lit("color/material of main subject"),
            F.when(F.col("has_people"), F.lit("person's clothing/appearance")),
            F.lit("add new object to scene"),
            F.lit("style transfer (artistic/era)"),
            F.when(F.size("objects") > 2, F.lit("remove specific object")),
        )
    )
    person = F.col("group") == "person"
    kind = F.when(F.col("category").isin(*PERSON_REGIONS), F.col("category")).otherwise(
        DEFAULT_PERSON
    )
    regions, setting, subject = F, F, F
    for name, listed in PERSON_REGIONS.items():
        regions = regions.when(kind == name, F.array(*[F.lit(r) for r in listed]))
        setting = setting.when(kind == name, PERSON_SUBJECTS[name][0])
        subject = subject.when(kind == name, PERSON_SUBJECTS[name][1])
    return parsed.withColumns(
        {
            "editable_regions": F.when(person, regions).otherwise(F.slice(scene, 1, MAX_REGIONS)),
            "scene_type": F.when(person, setting).otherwise(F.col("scene_type")),
            "primary_subject": F.when(person, subject).otherwise(F.col("primary_subject")),
            "has_people": F.when(person, F.lit(True)).otherwise(F.col("has_people")),
        }
    )
