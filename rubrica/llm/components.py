"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.llm.base import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"))
    least = least.select("u", F.least("u", "_m").alias("_m"))
    far = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return far.select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("_m"))
    moved = moved.select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.unionByName(least.select("u", F.col("_m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node of ``links`` (a, b).

    Minima are combined before each shuffle, and a node with very many neighbours only meets their
    minimum in a join, which Spark may split. The edges shrink to stars in a logarithmic number
    of rounds. No links give no rows.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stored(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
