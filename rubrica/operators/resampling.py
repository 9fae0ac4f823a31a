"""Bootstrap intervals with exactly n draws per replicate, and of a caller's own statistic.

``exact_ci`` draws n rows of n with replacement. Rows are dealt to 2**levels blocks by the hash of their key, and a
replicate's n draws are split down the tree of blocks: of the draws that reach a node, a binomial number
goes to its left half, in proportion to the rows there. Each node's draws come from a generator
named after seed, group and node, so every task that needs a node draws the same numbers: blocks agree on their
shares without talking to each other, and no row moves for a replicate. Inside a block rows are drawn uniformly.

``custom_ci`` takes any function of an array by the bag of little bootstraps: a group is dealt to subsets of
about ``SUBSET_ROWS`` rows, each subset is resampled up to the size of the whole group, and the bounds
of the subsets are averaged. A group of one subset is the ordinary bootstrap.

NULL values take no part; a group without values has NULL bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.operators.bootstrap import log_scale, row_halves
from rubrica.operators.ranking import salted_join
from rubrica.session import stored

BLOCK_ROWS = 4096
SUBSET_ROWS = 8192
# Replicates of a subset, where a group has many.
LEAST_REPLICATES = 200
# Draws that are made at once; they and the values of a block fit a core's cache.
DRAWS = 1 << 17


def generator(seed: int, group: str | None, *place: int) -> np.random.Generator:
    """The same stream of random numbers wherever it is asked for."""
    name = 0 if group is None else int.from_bytes(b"\x01" + group.encode(), "big")
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, name, *place])))


def _values(df: DataFrame, group: str, value: str, key: str, seed: int, log: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (_cell, _a, _b, x) in the shared folder and rows per group; the upstream plan runs once."""
    v = F.col(value).cast("double")
    x = F.ln(F.greatest(v, S.floor_probability())) if log else v
    rows = df.select(
        F.struct(F.col(group).cast("string").alias("grp")).alias("_cell"), *row_halves(F.col(key), seed),
        F.when(v.isNotNull(), x).alias("x"),
    )
    rows = stored(rows, "values")
    return rows.filter("x IS NOT NULL"), rows.groupBy("_cell").agg(F.count("x").alias("n"))


def _blocks(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their block, and one head per block: the group's rows and the nodes above the block."""
    levels = F.greatest(F.ceil(F.log2(F.col("n") / BLOCK_ROWS)), F.lit(0)).cast("int")
    sized = sizes.filter("n > 0").withColumn("levels", levels)
    dealt = salted_join(rows, sized, ["_cell"], ["_a", "_b"])
    dealt = dealt.withColumn("block", F.expr("_a & (shiftleft(1L, levels) - 1)"))
    counts = dealt.groupBy("_cell", "n", "levels", "block").agg(F.count(F.lit(1)).alias("rows"))
    up = counts.filter("levels > 0").withColumn("shift", F.explode(F.expr("sequence(1, levels)")))
    up = up.withColumn("node", F.expr("shiftright(block, shift)"))
    left = F.expr("(shiftright(block, shift - 1) & 1) = 0")
    nodes = up.groupBy("_cell", "shift", "node").agg(
        F.sum("rows").alias("total"), F.sum(F.when(left, F.col("rows")).otherwise(0)).alias("left")
    )
    step = F.struct("shift", "node", "total", "left")
    paths = up.join(nodes, ["_cell", "shift", "node"]).groupBy("_cell", "block").agg(
        F.sort_array(F.collect_list(step), asc=False).alias("path")
    )
    heads = counts.select("_cell", "block", "n").join(paths, ["_cell", "block"], "left")
    return dealt.select("_cell", "block", "_a", "_b", "x"), heads


def block_draws(n_boot: int, seed: int, group: str | None, n: int, block: int, path: list[dict]) -> np.ndarray:
    """How many of each replicate's ``n`` draws fall into a block."""
    draws = np.full(n_boot, n, np.int64)
    for step in path:
        share = generator(seed, group, step["shift"], step["node"]).binomial(draws, step["left"] / step["total"])
        draws = draws - share if block >> (step["shift"] - 1) & 1 else share
    return draws


def _block_sums(x: np.ndarray, draws: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Per replicate the sum of ``draws`` values picked from x."""
    out = np.zeros(len(draws))
    # Short integers take the generator half the time of long ones.
    kind = np.uint16 if len(x) <= 1 << 16 else np.int64
    at = 0
    while at < len(draws):
        ends = np.cumsum(draws[at:])
        some = max(1, int(np.searchsorted(ends, DRAWS, side="right")))
        ends = ends[:some]
        for lo in range(0, max(int(ends[-1]), 1), DRAWS):
            # One replicate may itself have more draws than are made at once.
            hi = min(int(ends[-1]), lo + DRAWS)
            picked = x.take(random.integers(0, len(x), hi - lo, dtype=kind), mode="clip")
            edges = np.clip(np.concatenate([[0], ends]), lo, hi) - lo
            # Replicates with draws in this stretch lie side by side in it.
            has = np.flatnonzero(np.diff(edges))
            if len(has):
                out[at + has] += np.add.reduceat(picked, edges[has])
        at += some
    return out


_PARTIAL = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("sums", pa.binary())])


def _draw(n_boot: int, seed: int):
    """Sums per group and replicate over the blocks of a task; rows come by group and block, heads first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        head: tuple | None = None
        values: list[np.ndarray] = []

        def finish() -> None:
            nonlocal values
            group, n, block, path = head
            draws = block_draws(n_boot, seed, group, n, block, path)
            held[:, 0] += draws
            held[:, 1] += _block_sums(np.concatenate(values), draws, generator(seed, group, 0, block))
            values = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([head[0]], pa.string()), pa.array([head[1]], pa.int64()), pa.array([held.tobytes()], pa.binary())],
                schema=_PARTIAL,
            )

        for batch in batches:
            kind = batch.column(3).to_numpy(zero_copy_only=False)
            x = batch.column(6).to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.flatnonzero(kind == 0)
            if len(x) and (not len(starts) or starts[0] > 0):
                values.append(x[: starts[0] if len(starts) else len(x)])
            for i, at in enumerate(starts):
                if head is not None:
                    finish()
                cell, block, n, _, _, _, _, path = (batch.column(c)[int(at)].as_py() for c in range(8))
                if head is None or cell["grp"] != head[0]:
                    if head is not None:
                        yield out()
                    held = np.zeros((n_boot, 2))
                head = (cell["grp"], n, block, path or [])
                values.append(x[at + 1 : starts[i + 1] if i + 1 < len(starts) else len(x)])
        if head is not None:
            finish()
            yield out()

    return run


def _merge(n_boot: int, ci: float, log: bool):
    """Bounds of every group from the sums of the tasks, at most one row of each task."""
    schema = pa.schema(
        [("grp", pa.string()), ("ci_lower", pa.float64()), ("ci_upper", pa.float64()), ("least", pa.int64()), ("most", pa.int64())]
    )
    ends = [(1.0 - ci) / 2.0, (1.0 + ci) / 2.0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None

        def out() -> pa.RecordBatch:
            bounds = np.quantile(held[:, 1] / held[:, 0], ends)
            bounds = np.exp(bounds) if log else bounds
            draws = held[:, 0].astype(np.int64)
            row = [group, *map(float, bounds), int(draws.min()), int(draws.max())]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part = np.frombuffer(sums).reshape(n_boot, 2)
                if held is not None and name != group:
                    yield out()
                    held = None
                group, held = name, part.copy() if held is None else held + part
        if held is not None:
            yield out()

    return run


def exact_ci(
    df: DataFrame, group: str, value: str, key: str, stat: str = "mean", n_boot: int = 10_000,
    ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """group, ci_lower, ci_upper of the mean or floored geometric mean, the group's values ``n`` and the least
    and most draws of a replicate (both n). ``key`` names a row within its group."""
    log = log_scale(stat)
    rows, sizes = _values(df, group, value, key, seed, log)
    dealt, heads = _blocks(rows, sizes)
    stream = heads.select("_cell", "block", "n", F.lit(0).alias("kind"), "path").unionByName(
        dealt.select("*", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = stream.select("_cell", "block", "n", "kind", "_a", "_b", "x", "path").repartition(tasks, "_cell", "block")
    stream = stream.sortWithinPartitions("_cell", "block", "kind", "_a", "_b", "x")
    partial = stream.mapInArrow(_draw(n_boot, seed), "grp string, n bigint, sums binary")
    merged = partial.repartition("grp").sortWithinPartitions("grp").mapInArrow(
        _merge(n_boot, ci, log), "grp string, ci_lower double, ci_upper double, least_draws bigint, most_draws bigint"
    )
    return _with_empty(sizes, merged, group)


def _with_empty(sizes: DataFrame, bounds: DataFrame, group: str) -> DataFrame:
    bounds = bounds.withColumn("_cell", F.struct("grp")).drop("grp")
    joined = sizes.join(bounds, "_cell", "left")
    return joined.select(F.col("_cell.grp").alias(group), *[c for c in joined.columns if c != "_cell"])


def weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of values that are repeated ``counts`` times."""
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(counts[order])
    low, high = np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")
    return float(values[order[low]] + values[order[high]]) / 2.0


def subset_bounds(
    x: np.ndarray, n: int, stat: Callable, weighted: bool, replicates: int, ci: float, random: np.random.Generator
) -> tuple[float, float]:
    """Bounds from resamples of ``n`` draws of the m values of a subset.

    A statistic of (values, counts) sees all n draws. One of an array alone sees m draws, so that no array outgrows the
    subset, and its deviations from the subset's own value shrink by sqrt(m / n).
    """
    m = len(x)
    if weighted:
        even = np.full(m, 1.0 / m)
        found = [stat(x, random.multinomial(n, even)) for _ in range(replicates)]
    else:
        found = [stat(x[random.integers(0, m, m)]) for _ in range(replicates)]
        if m < n:
            own = stat(x)
            found = [own + (f - own) * math.sqrt(m / n) for f in found]
    low, high = np.quantile(np.array(found, float), [(1.0 - ci) / 2.0, (1.0 + ci) / 2.0])
    return float(low), float(high)


def custom_ci(
    df: DataFrame, group: str, value: str, key: str, stat: Callable, weighted: bool = False,
    n_boot: int = 10_000, ci: float = 0.95, seed: int = 42,
) -> DataFrame:
    """group, n, ci_lower, ci_upper of any statistic: ``stat(values)``, or ``stat(values, counts)`` if ``weighted``.

    No task holds more than a subset. ``key`` must be unique within its group: rows that share one share a
    subset. With k subsets each has n_boot / k replicates, ``LEAST_REPLICATES`` at least.
    """
    rows, sizes = _values(df, group, value, key, seed)
    subsets = F.greatest(F.ceil(F.col("n") / SUBSET_ROWS), F.lit(1)).cast("bigint")
    dealt = salted_join(rows, sizes.filter("n > 0").withColumn("k", subsets), ["_cell"], ["_a", "_b"])
    dealt = dealt.select(F.col("_cell.grp").alias("grp"), "n", "k", F.expr("pmod(_a, k)").alias("subset"), "_a", "_b", "x")

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_a", "_b", "x"])
        name, n, k, subset = pdf["grp"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["k"].iloc[0]), int(pdf["subset"].iloc[0])
        name = None if pd.isna(name) else name
        replicates = n_boot if k == 1 else max(LEAST_REPLICATES, -(-n_boot // k))
        low, high = subset_bounds(
            pdf["x"].to_numpy(), n, stat, weighted, replicates, ci, generator(seed, name, subset)
        )
        return pd.DataFrame({"grp": [name], "m": [len(pdf)], "low": [low], "high": [high]})

    parts = dealt.groupBy("grp", "subset").applyInPandas(bounds, "grp string, m bigint, low double, high double")
    mean = [(F.sum(F.col(c) * F.col("m")) / F.sum("m")).alias(n) for c, n in (("low", "ci_lower"), ("high", "ci_upper"))]
    return _with_empty(sizes, parts.groupBy("grp").agg(*mean), group)
