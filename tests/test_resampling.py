"""Bootstraps with exactly n draws and with own statistics, against numpy."""

import hashlib

import numpy as np
import pytest

from rubrica.operators import resampling as R


def _rows(n, seed, group="g"):
    x = np.random.default_rng(seed).gamma(2.0, size=n)
    return [(group, f"k{i}", float(v), "clash") for i, v in enumerate(x)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "model string, id string, v double, n string")


def _plain(x, stat, n_boot, seed=0):
    random = np.random.default_rng(seed)
    found = [stat(x[random.integers(0, len(x), len(x))]) for _ in range(n_boot)]
    return np.quantile(found, [0.025, 0.975])


@pytest.mark.parametrize("n", [10, 100, 10_000])
def test_exact_draws_agree_with_numpy(spark, n):
    rows = _rows(n, n)
    out = R.exact_ci(_frame(spark, rows), "model", "v", "id", n_boot=2000).first()
    assert (out.n, out.least_draws, out.most_draws) == (n, n, n)
    x = np.array([r[2] for r in rows])
    low, high = _plain(x, np.mean, 2000)
    assert abs(out.ci_lower - low) < 0.15 * (high - low) and abs(out.ci_upper - high) < 0.15 * (high - low)


def test_exact_draws_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 50)
    rows = _rows(3000, 1, "big") + _rows(1, 2, "one") + _rows(60, 3, None)
    rows += [("none", "k", None, ""), ("big", "x", None, "")]
    got = {r.model: r for r in R.exact_ci(_frame(spark, rows), "model", "v", "id", "gm", n_boot=1000).collect()}
    assert {k: (r.n, r.least_draws, r.most_draws) for k, r in got.items()} == {
        "big": (3000, 3000, 3000), "one": (1, 1, 1), None: (60, 60, 60), "none": (0, None, None),
    }
    x = np.log([r[2] for r in rows[:3000]])
    low, high = np.exp(_plain(x, np.mean, 1000))
    assert abs(got["big"].ci_lower - low) < 0.2 * (high - low) and abs(got["big"].ci_upper - high) < 0.2 * (high - low)
    assert got["one"].ci_lower == pytest.approx(rows[3000][2]) == got["one"].ci_upper
    again = R.exact_ci(_frame(spark, rows).repartition(7), "model", "v", "id", "gm", n_boot=1000).collect()
    assert {r.model: r for r in again}["big"].ci_lower == pytest.approx(got["big"].ci_lower)
    assert R.exact_ci(_frame(spark, []), "model", "v", "id", n_boot=10).collect() == []


def test_blocks_share_all_draws():
    """Blocks that split the same nodes take all draws between them."""
    sizes = [5, 0, 7, 3, 1, 1, 20, 2]
    total = np.zeros(500, np.int64)
    for block, size in enumerate(sizes):
        path = []
        for shift in (3, 2, 1):
            node = block >> shift
            members = range(node << shift, (node + 1) << shift)
            rows = sum(sizes[m] for m in members)
            left = sum(sizes[m] for m in members if not m >> (shift - 1) & 1)
            path.append({"shift": shift, "node": node, "total": rows, "left": left})
        draws = R.block_draws(500, 1, "g", sum(sizes), block, path)
        total += draws
        assert size or not draws.any()
        assert abs(draws.mean() - size) < 1
    assert (total == sum(sizes)).all()


def _ordered(rows, seed=42):
    """Values in the order in which a subset takes them."""
    def halves(key):
        digest = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
        return int(digest[:8], 16), int(digest[8:16], 16)

    return np.array([v for *_, v in sorted((*halves(k), v) for _, k, v, _ in rows)])


def test_custom_statistic_is_the_plain_loop(spark):
    rows = _rows(40, 5)

    def spread(x):
        return float(np.quantile(x, 0.9) - np.quantile(x, 0.1))

    out = R.custom_ci(_frame(spark, rows), "model", "v", "id", spread, n_boot=500).first()
    x = _ordered(rows)
    random = R.generator(42, "g", 0)
    found = [spread(x[random.integers(0, 40, 40)]) for _ in range(500)]
    assert (out.ci_lower, out.ci_upper) == pytest.approx(tuple(np.quantile(found, [0.025, 0.975])))


@pytest.mark.parametrize("weighted", [False, True])
def test_little_bootstraps_agree_with_the_whole(spark, monkeypatch, weighted):
    monkeypatch.setattr(R, "SUBSET_ROWS", 500)
    rows = _rows(6000, 8) + _rows(20, 9, None) + [("none", "k", None, "")]
    stat = R.weighted_median if weighted else (lambda x: float(np.median(x)))
    got = {r.model: r for r in R.custom_ci(_frame(spark, rows), "model", "v", "id", stat, weighted, n_boot=2000).collect()}
    assert set(got) == {"g", None, "none"} and got["none"].ci_lower is None
    x = np.array([r[2] for r in rows[:6000]])
    low, high = _plain(x, np.median, 2000)
    assert abs(got["g"].ci_lower - low) < 0.35 * (high - low) and abs(got["g"].ci_upper - high) < 0.35 * (high - low)


def test_weighted_median():
    random = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        x, c = random.normal(size=n), random.integers(0, 4, n)
        c[0] += 1
        assert R.weighted_median(x, c) == pytest.approx(np.median(np.repeat(x, c)))


def test_block_sums_of_one_value_are_its_multiples():
    # Replicates without draws, and one with more draws than are made at once.
    draws = np.array([0, 3, 0, R.DRAWS * 2 + 5, 1, 0])
    sums = R._block_sums(np.full(10, 2.0), draws, R.generator(1, "g"))
    assert (sums == 2.0 * draws).all()
