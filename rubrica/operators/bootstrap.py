"""Bootstrap confidence intervals (percentile method), one method for tables of every size.

Poisson bootstrap: a row counts Poisson(1) times in each replicate. The count follows from the
seed, the row's key and the replicate number by plain integer mixing, so the interval depends
neither on partitioning nor on retries, and SQL can repeat it. Weights are drawn in numpy blocks
of rows x replicates inside Arrow batches; a task passes on only its sums per group and replicate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.operators.ranking import salted_join
from rubrica.session import stored

# A block of rows x replicates is worked on in the cache of one core.
BLOCK_ROWS = 128
BLOCK_REPLICATES = 1024
# Rows of a group that are drawn in one place.
PART_ROWS = 4096
# Odd multipliers of the integer mixing, shared with its SQL form.
MIX = 73244475
STRIDE = 2654435761


def poisson_steps() -> list[int]:
    """P(w <= 0), P(w <= 1), ... of Poisson(1) on the scale of 32-bit integers, to its end."""
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1.0) / math.factorial(k)
        step = math.ceil(total * 2.0**32)
        if step >= 2**32:
            return steps
        steps.append(step)
        k += 1


POISSON_STEPS = poisson_steps()


def log_scale(stat: str) -> bool:
    if stat not in ("mean", "gm"):
        raise ValueError(f"stat must be mean or gm, not {stat!r}")
    return stat == "gm"


def row_halves(key: Column, seed: int) -> list[Column]:
    """Two 32-bit integers from the md5 of seed and row key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return [
        F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint").alias(name)
        for at, name in ((1, "_a"), (9, "_b"))
    ]


def _scramble(x: np.ndarray) -> np.ndarray:
    """Mix 32-bit integers in place."""
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIX)
    x ^= x >> np.uint32(16)
    return x


def poisson_weights(a: np.ndarray, b: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Weights (replicates x rows) of rows with the halves ``a`` and ``b``."""
    u = (replicates * np.uint32(STRIDE))[:, None] ^ a
    u = _scramble(u)
    u ^= b
    u = _scramble(u)
    steps = np.array(POISSON_STEPS, np.uint32)
    w = np.zeros(u.shape, np.uint8)
    for step in steps[:4]:
        w += u >= step
    rare = np.flatnonzero(u >= steps[3])
    w.flat[rare] = np.searchsorted(steps, u.flat[rare], side="right")
    return w


_PARTIAL = pa.schema([("grp", pa.string()), ("sums", pa.binary())])


def _partial_sums(n_boot: int, columns: int) -> Callable:
    """Per group the sums of weight and weight x value by replicate, over the rows of a task; rows come by group."""
    replicates = np.arange(n_boot, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([held.tobytes()], pa.binary())], schema=_PARTIAL
            )

        for batch in batches:
            groups = np.array([c["grp"] for c in batch.column(0).to_pylist()], object)
            a, b = (batch.column(k).to_numpy().astype(np.uint32) for k in (1, 2))
            x = np.stack([batch.column(3 + k).to_numpy() for k in range(columns)], axis=1)
            starts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1)] if len(groups) else []
            for lo, hi in zip(starts, [*starts[1:], len(groups)], strict=True):
                if held is not None and groups[lo] != name:
                    yield out()
                    held = None
                if held is None:
                    name, held = groups[lo], np.zeros((n_boot, columns))
                for at in range(lo, hi, BLOCK_ROWS):
                    some = slice(at, min(at + BLOCK_ROWS, hi))
                    for r in range(0, n_boot, BLOCK_REPLICATES):
                        w = poisson_weights(a[some], b[some], replicates[r : r + BLOCK_REPLICATES])
                        held[r : r + BLOCK_REPLICATES] += w.astype(np.float64) @ x[some]
        if held is not None:
            yield out()

    return run


def _bounds(n_boot: int, measures: int, ci: float) -> Callable:
    """Bounds of every measure of a group from the sums of the tasks, at most one row of each task."""
    schema = pa.schema([("grp", pa.string()), ("bounds", pa.list_(pa.float64()))])
    ends = [(1.0 - ci) / 2.0, (1.0 + ci) / 2.0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None

        def out() -> pa.RecordBatch:
            found: list[float | None] = []
            for k in range(measures):
                # A replicate that drew no row has no statistic.
                drawn = held[:, 2 * k] > 0
                stats = held[drawn, 2 * k + 1] / held[drawn, 2 * k]
                found += map(float, np.quantile(stats, ends)) if drawn.any() else [None, None]
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([found], schema.field(1).type)], schema=schema
            )

        for batch in batches:
            for group, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(sums).reshape(n_boot, 2 * measures)
                if held is not None and group != name:
                    yield out()
                    held = None
                name, held = group, part.copy() if held is None else held + part
        if held is not None:
            yield out()

    return run


def bootstrap_cis(
    df: DataFrame, group: str, measures: dict[str, tuple[str, str]], key: str,
    n_boot: int = 10_000, ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """group and {measure}_lower, {measure}_upper for several measures from one set of draws.

    ``measures`` maps a name to (value column, "mean" or "gm"). ``key`` names a row within its
    group; rows that share one are drawn together. NULL values do not take part; a group without
    values has NULL bounds.

    A group is dealt to one part per ``PART_ROWS`` rows and parts to tasks, so a small group is in one task and
    a task passes on one array of sums for each group it holds.
    """
    cells = []
    for name, (value, stat) in measures.items():
        v = F.col(value).cast("double")
        x = F.ln(F.greatest(v, S.floor_probability())) if log_scale(stat) else v
        cells += [
            v.isNotNull().cast("double").alias(f"_n_{name}"),
            F.coalesce(x, F.lit(0.0)).alias(f"_x_{name}"),
        ]
    cell = F.struct(F.col(group).cast("string").alias("grp")).alias("_cell")
    # Written once: the parts of a group need its size, and what is above may be dear.
    rows = stored(df.select(cell, *row_halves(F.col(key), seed), *cells), "draws")
    parts = F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("bigint")
    sizes = rows.groupBy("_cell").agg(parts.alias("_parts"))
    dealt = salted_join(rows, sizes, ["_cell"], ["_a", "_b"])
    dealt = dealt.select(*rows.columns, F.expr("pmod(_a, _parts)").alias("_part"))
    # Drawing is the work here, not the size of the rows, so the task count is set by hand.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "_cell", "_part").sortWithinPartitions("_cell")
    partial = dealt.mapInArrow(_partial_sums(n_boot, len(cells)), "grp string, sums binary")
    merged = partial.repartition("grp").sortWithinPartitions("grp")
    bounds = merged.mapInArrow(_bounds(n_boot, len(measures), ci), "grp string, bounds array<double>")
    out = []
    for k, (name, (_, stat)) in enumerate(measures.items()):
        for at, side in enumerate(("lower", "upper")):
            bound = F.col("bounds")[2 * k + at]
            out.append((F.exp(bound) if log_scale(stat) else bound).alias(f"{name}_{side}"))
    return bounds.select(F.col("grp").alias(group), *out)


def bootstrap_ci(
    df: DataFrame, group: str, value: str, key: str, stat: str = "mean", n_boot: int = 10_000,
    ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """(group, ci_lower, ci_upper) of the mean or the floored geometric mean."""
    return bootstrap_cis(df, group, {"ci": (value, stat)}, key, n_boot, ci, seed)


def leaderboard_ci(scores: DataFrame, n_boot: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Intervals of covered AM (mean) and covered GM (geometric mean of prompt GMs)."""
    measures = {"am_ci": ("score_am", "mean"), "gm_ci": ("score_gm", "gm")}
    rows = bootstrap_cis(scores.filter("covered"), "model", measures, "prompt_id", n_boot, ci, seed)
    return rows.select("model", *[S.round4(F.col(c)).alias(c) for c in rows.columns[1:]])
