"""Theme tags: clean-up, usage, extremes and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions.scoring import strip
from rubrica.operators.ranking import top_n

THEME_MIN_N = 15
TAXONOMY_SIZE = (15, 25)


def clean_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """Trimmed lower-case ids without blanks; trimmed descriptions."""
    return taxonomy.select(
        F.lower(strip(F.coalesce("id", F.lit("")))).alias("id"),
        strip(F.coalesce("description", F.lit(""))).alias("description"),
    ).filter("id <> ''")


def taxonomy_size_check(taxonomy: DataFrame) -> DataFrame:
    """Entries as delivered (before clean-up), and whether they number 15 to 25."""
    return taxonomy.agg(F.count(F.lit(1)).alias("n_themes")).withColumn(
        "in_range", F.col("n_themes").between(*TAXONOMY_SIZE)
    )


def clean_tag_array(tags: Column) -> Column:
    return F.array_distinct(F.transform(tags, lambda t: F.lower(strip(t))))


def clean_tags(tagged: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(prompt_id, pos, theme): known themes only, once per prompt, in tag order.

    Long form: the taxonomy joins by id, whatever its size, and no array is rebuilt.
    """
    tags = tagged.select(
        "prompt_id", F.posexplode(clean_tag_array(F.col("tags"))).alias("pos", "theme")
    )
    return tags.join(taxonomy.select(F.col("id").alias("theme")).distinct(), "theme", "left_semi")


def theme_rows(tagged: DataFrame) -> DataFrame:
    """(prompt_id, themes array) to one row per prompt and theme; repeats stay."""
    return tagged.select("prompt_id", F.explode("themes").alias("theme"))


def theme_tag_stats(tagged: DataFrame) -> DataFrame:
    """Tags per prompt: fewest, most, mean, and how many prompts have none."""
    n = F.coalesce(F.size("themes"), F.lit(0))
    return tagged.agg(
        F.min(n).alias("min_tags"),
        F.max(n).alias("max_tags"),
        F.bround(F.avg(n), 1).alias("mean_tags"),
        F.count_if(n == 0).alias("n_untagged"),
        F.count(F.lit(1)).alias("n_prompts"),
    )


def theme_usage(tagged: DataFrame, k: int = 10) -> DataFrame:
    """The k most used themes."""
    used = theme_rows(tagged).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
    return used.orderBy(F.desc("n"), "theme").limit(k)


def theme_extremes(themes: DataFrame, k: int = 5, min_n: int = THEME_MIN_N) -> DataFrame:
    """Each model's k best and k worst themes under GM among themes with enough prompts."""
    enough = themes.filter(F.col("n_prompts") >= min_n).select(
        "model", "theme", "mean_score_gm", "n_prompts"
    )
    best = top_n(enough, ["model"], [F.desc("mean_score_gm"), "theme"], k)
    worst = top_n(enough, ["model"], ["mean_score_gm", F.desc("theme")], k)
    return best.withColumn("side", F.lit("top")).unionByName(
        worst.withColumn("side", F.lit("bottom"))
    )


def theme_variance(themes: DataFrame, top: int = 5, min_n: int = THEME_MIN_N) -> DataFrame:
    """Themes that differ most between models, among those with enough prompts for every model."""
    n_models = themes.agg(F.count_distinct("model").alias("n")).scalar()
    return (
        themes.filter(F.col("n_prompts") >= min_n)
        .groupBy("theme")
        .agg(
            F.count_distinct("model").alias("n_models"),
            F.stddev_samp("mean_score_gm").alias("spread"),
        )
        .filter((F.col("n_models") == n_models) & (F.col("n_models") >= 2))
        .orderBy(F.desc("spread"), "theme")
        .limit(top)
    )
