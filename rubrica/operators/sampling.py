"""Reproducible samples and splits. Hash order stands in for a seeded shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from rubrica.functions import text as X
from rubrica.operators.ranking import hash_order, hash_rank, lowest_hashes, salted_join, top_n

# Target shares of the image groups, and the group that takes the remainder.
TARGET_SHARES = {"person": 0.40, "object": 0.30, "scene": 0.20, "style": 0.10}
REMAINDER_GROUP = "person"
PER_CATEGORY = 2

DIFFICULTIES = ["easy", "medium", "hard"]

# Image groups each edit category applies to, in order of preference.
CATEGORY_GROUPS = {
    "color_material": ["person", "object", "scene", "style"],
    "object_add": ["object", "scene", "style"],
    "object_remove": ["object", "scene", "style"],
    "object_replace": ["person", "object", "scene"],
    "background_change": ["person", "object", "scene"],
    "style_transfer": ["person", "object", "scene", "style"],
    "lighting_weather": ["person", "object", "scene", "style"],
    "spatial_pose": ["person", "object", "scene"],
    "anatomy_identity": ["person"],
    "physics": ["object", "scene", "style"],
    "text_editing": ["object", "scene"],
    "multi_turn": ["person", "object", "scene"],
}

# Edit categories each image group may take.
GROUP_CATEGORIES = {
    "person": [
        "color_material", "object_replace", "background_change", "style_transfer",
        "lighting_weather", "spatial_pose", "anatomy_identity", "multi_turn",
    ],
    "object": [
        "color_material", "object_add", "object_remove", "object_replace", "background_change",
        "style_transfer", "lighting_weather", "physics", "text_editing", "multi_turn",
    ],
    "scene": [
        "color_material", "object_add", "object_remove", "object_replace", "background_change",
        "style_transfer", "lighting_weather", "spatial_pose", "physics", "text_editing",
        "multi_turn",
    ],
    "style": [
        "color_material", "object_add", "style_transfer", "lighting_weather", "physics",
        "multi_turn",
    ],
}


def stratified_sample(df: DataFrame, text: str, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows spread over the length terciles of ``text``; the long one takes the remainder.

    Ranks by (length, hash): lengths are counted and accumulated (one row per length), and a
    row's place within its length comes from ``hash_rank``. With n or fewer rows, all stay.
    Only ids and lengths are shuffled; the picked ids fetch their rows at the end.
    """
    sized = df.select(*ids, F.length(text).alias("_len"))
    lengths = sized.groupBy("_len").agg(F.count(F.lit(1)).alias("_c"))
    starts = lengths.select(
        "_len",
        (F.sum("_c").over(W.orderBy("_len")) - F.col("_c")).alias("_start"),
        F.sum("_c").over(W.partitionBy()).alias("_total"),
    )
    placed = hash_rank(sized, ["_len"], ids, seed, rank="_place", group_rows="_same")
    placed = salted_join(placed, starts, ["_len"], ids)
    rank = F.col("_start") + F.col("_place")
    third = F.floor(F.col("_total") / 3)
    stratum = F.when(rank <= third, 0).when(rank <= 2 * third, 1).otherwise(2)
    share = n // 3
    quota = F.when(F.col("_all"), F.col("group_rows")).otherwise(
        F.when(F.col("stratum") == 2, n - 2 * share).otherwise(share)
    )
    labelled = placed.select(*ids, stratum.alias("stratum"), (F.col("_total") <= n).alias("_all"))
    picked = lowest_hashes(labelled, ["stratum", "_all"], ids, quota, seed + 1)
    return df.join(picked.select(*ids, "stratum"), ids)


def annotation_sample(
    records: DataFrame, ids: list[str], frac: float = 0.1, seed: int = 42,
    cell: tuple[str, ...] = ("model", "sub_category"),
) -> DataFrame:
    """A share of every (model, sub_category) cell, at least one row, among rows with an image."""
    with_image = records.filter(F.coalesce(F.col("image_path"), F.lit("")) != "")
    quota = F.greatest(F.lit(1), F.bround(F.col("group_rows") * F.lit(frac)).cast("bigint"))
    return lowest_hashes(with_image, list(cell), ids, quota, seed).drop("rank")


def group_quotas(total: int, shares: dict[str, float] | None = None) -> dict[str, int]:
    """Whole numbers per group; the rounding difference goes to one group."""
    shares = shares or TARGET_SHARES
    counts = {g: max(1, int(total * s)) for g, s in shares.items()}
    counts[REMAINDER_GROUP] = max(1, counts[REMAINDER_GROUP] + total - sum(counts.values()))
    return counts


def diversity_cap(
    images: DataFrame, ids: list[str], quotas: dict[str, int], seed: int = 42,
    capped: tuple[str, ...] = ("object", "scene", "style"),
) -> DataFrame:
    """At most two images per category of the capped groups, then each group's quota."""
    shuffled = images.withColumn("_hash", hash_order(ids, seed))
    order = ["_hash", *ids]
    per_category = top_n(
        shuffled.filter(F.col("group").isin(*capped)), ["group", "category"], order, PER_CATEGORY
    ).drop("rank")
    pool = per_category.unionByName(shuffled.filter(~F.col("group").isin(*capped)))
    picked = top_n(pool, ["group"], order, max(quotas.values()))
    quota = F.element_at(
        F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("group")
    )
    return picked.filter(F.col("rank") <= quota).drop("_hash")


def target_mix(
    images: DataFrame, ids: list[str], total: int = 165, shares: dict[str, float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """A diverse image set of the wanted mix. Other than persons must be full-scene shots."""
    quotas = group_quotas(total, shares)
    pool = images.filter(
        F.when(F.col("group") == REMAINDER_GROUP, X.is_image_name(F.col("filename")))
        .otherwise(X.is_full_scene(F.col("filename")))
    )
    return diversity_cap(pool.filter(F.col("group").isin(*quotas)), ids, quotas, seed)


def hash_split(df: DataFrame, ids: list[str], fraction: float = 0.70, seed: int = 42) -> DataFrame:
    """Shuffle, then the first floor(fraction * N) rows are layer 1 and the rest layer 2."""
    ranked = hash_rank(df, [], ids, seed)
    cut = F.floor(F.col("group_rows") * F.lit(fraction))
    return ranked.withColumn("layer", F.when(F.col("rank") <= cut, 1).otherwise(2)).drop(
        "rank", "group_rows"
    )


def balanced_limit(df: DataFrame, category: str, order: list[str], n: int) -> DataFrame:
    """n rows: the first floor(n / #categories) of each category, then the rest in order.

    No category can give more than n rows, so each is cut to n before the shuffle.
    """
    n_categories = df.select(F.count_distinct(category).alias("c")).scalar()
    share = F.greatest(F.lit(1), F.floor(F.lit(n) / n_categories))
    first = top_n(df, [category], order, n, rank="_rn")
    # Rows of the share go in category order, the fill in overall order.
    fill = F.col("_rn") > share
    by_category = F.when(~fill, F.col(category))
    return (
        first.withColumns({"_fill": fill, "_cat": by_category})
        .orderBy("_fill", "_cat", *order)
        .limit(n)
        .drop("_rn", "_fill", "_cat")
    )


def group_categories(images: DataFrame) -> DataFrame:
    """One row per image and edit category that its group may take."""
    table = F.create_map(
        *[
            F.lit(g) if i == 0 else F.array(*[F.lit(c) for c in cats])
            for g, cats in GROUP_CATEGORIES.items()
            for i in (0, 1)
        ]
    )
    return images.withColumn("edit_category", F.explode(F.element_at(table, F.col("group"))))


def cell_quota_plan(
    images: DataFrame, ids: list[str], min_per_cell: int = 3, seed: int = 42
) -> DataFrame:
    """First planning pass: each (category, difficulty) cell takes one image from each of its
    groups that has any, up to ``min_per_cell``.

    A group is asked for at most one image per cell, so only that many are kept of it; no
    image x cell pairs are formed. Cells walk through the kept images in turn.
    """
    spark = images.sparkSession
    cells = spark.createDataFrame(
        [
            (c, d, g, pos)
            for c, groups in CATEGORY_GROUPS.items()
            for d in DIFFICULTIES
            for pos, g in enumerate(groups)
        ],
        "category string, difficulty string, `group` string, pos int",
    )
    most = len(CATEGORY_GROUPS) * len(DIFFICULTIES)
    pool = top_n(
        images.withColumn("_hash", hash_order(ids, seed)), ["group"], ["_hash", *ids], most
    ).drop("_hash")
    kept = pool.groupBy("group").agg(F.count(F.lit(1)).alias("available"))
    wanted = top_n(
        cells.join(kept, "group"), ["category", "difficulty"], ["pos"], min_per_cell, rank="pick"
    )
    turn = F.row_number().over(W.partitionBy("group").orderBy("category", "difficulty")) - 1
    wanted = wanted.withColumn("rank", turn % F.col("available") + 1)
    return wanted.join(pool.select("group", "rank", *ids), ["group", "rank"]).select(
        "category", "difficulty", "group", "pick", *ids
    )
