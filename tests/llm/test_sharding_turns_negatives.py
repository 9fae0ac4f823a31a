"""Sharding, conversation repair and hard negatives against brute force, awkward rows included."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rubrica.llm import hashtree, negatives, turns

DOCS = "doc_id bigint, text string, shard string, _tie string, region string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w" * (i % 7), "x", "x", "x", "x") for i in range(3000)]
    rows += [(None, None, None, None, None, None), (None, "", "x", "x", "x", "x"), rows[5], rows[5], (7, "é😀", "", "", "", "")]
    return spark.createDataFrame(rows, DOCS)


def _descend(key: str, tree: list) -> int:
    levels = hashtree.children(tree)
    at = ""
    for level in range(3):
        draws = []
        for child, weight in levels[level][at].items():
            h = int(hashlib.md5(f"{key}:{level}:{child}".encode()).hexdigest()[:13], 16)
            draws.append((-math.log((h + 0.5) / 2**52) / weight, child))
        at = min(draws)[1]
    return int(at)


def test_shards_against_brute_force(docs):
    tree = hashtree.grid(2)
    rows = hashtree.assign(docs, tree, hashtree.grown(tree)).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    texts = Counter()
    for r in rows:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == _descend(key, tree)
        assert r.grown_shard in (r.shard, 24) and r.grown_shard == _descend(key, hashtree.grown(tree))
        slots[r.shard].append(r.slot)
        texts[r.doc_id, r.size, r.text_crc32] += 1
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        want[r.doc_id, len(data) + 8, zlib.crc32(data)] += 1
    assert texts == want
    moved = sum(r.grown_shard != r.shard for r in rows)
    assert 70 < moved < 180


def test_weights_confine_movement(docs):
    tree = [*hashtree.grid(2)]
    heavy = [(g, k, s, 3.0 if s == 5 else w) for g, k, s, w in tree]
    names = ["r", "k", "s"]
    from pyspark.sql import functions as F

    def shards(t):
        return {r.doc_id: r.s for r in hashtree.descend(docs.select("doc_id"), F.col("doc_id"), t, names).collect()}

    before, after = shards(tree), shards(heavy)
    share = sum(s == 5 for s in after.values()) / len(after)
    assert abs(share - 3 / 26) < 0.02
    for i, s in before.items():
        # Rows go into the region of the heavier shard, inside it into its rack, inside that into it.
        if s != after[i]:
            assert after[i] < 12
            if s < 12:
                assert after[i] // 4 == 1
                if s // 4 == 1:
                    assert after[i] == 5


def test_shards_edge_cases(spark, docs, tmp_path):
    tree = hashtree.grid(1, 1, 1)
    assert hashtree.assign(docs.limit(0), tree).collect() == []
    assert {r.shard for r in hashtree.assign(docs, tree).collect()} == {0}
    with pytest.raises(ValueError):
        hashtree.children([("0", "0/0", 1, 1.0), ("1", "1/0", 1, 1.0)])
    path = str(tmp_path / "shards")
    hashtree.write_shards(docs, hashtree.grid(2), path, rows=10)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)


TURNS = "conv_id bigint, turn bigint, role string, text string, gone string, kind string"


def _automaton(word: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", word) is not None


def _cheapest(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, str]:
    """By trying all edits of short conversations."""
    choices = []
    for role, text, must_go, cut in rows:
        own = [("D", 2, None)]
        if not must_go:
            more = 5 if cut else 0
            own += [("K", more, f"{role}:{text}"), ("R", 1 + more, f"user:{text}"), ("R", 1 + more, f"assistant:{text}")]
        choices.append(own)
    gaps = [[], ["user:"], ["assistant:"], ["user:", "assistant:"], ["assistant:", "user:"]]
    best = None
    for edits in itertools.product(*choices):
        kept = [e for e in edits if e[2] is not None]
        for fill in itertools.product(gaps, repeat=len(kept) + 1):
            if sum(map(len, fill)) > 2:
                continue
            lines, k = list(fill[0]), 0
            for e in kept:
                k += 1
                lines += [e[2], *fill[k]]
            if not _automaton("".join(x[:1] for x in lines)):
                continue
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, fill))
            # Deletes may stand before or after the inserts of their gap: take every order.
            for audit in _orders(edits, [len(f) for f in fill]):
                found = (cost, audit, "\n".join(lines))
                if best is None or found[:2] < best[:2]:
                    best = found
    return best


def _orders(edits, fills: list[int]) -> set[str]:
    """All letter orders: inserts of a gap mix with the deletes of the gap."""
    runs, run = [], ""
    for e in edits:
        if e[0] == "D":
            run += "D"
        else:
            runs.append((run, e[0]))
            run = ""
    runs.append((run, ""))
    out = {""}
    for (deletes, letter), inserts in zip(runs, fills, strict=True):
        mixes = {"".join(p) for p in itertools.permutations(deletes + "I" * inserts)}
        out = {a + m + letter for a in out for m in mixes}
    return out


def test_repair_against_all_edits():
    rng = random.Random(5)
    for _ in range(150):
        rows = []
        for _ in range(rng.randint(0, 4)):
            rows.append((rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b"]),
                         rng.random() < 0.2, rng.random() < 0.3))
        repair = turns.Repair()
        for r in rows:
            repair.row(*r)
        cost, audit, body = _cheapest(rows)
        assert repair.end() == (cost, audit, hashlib.sha256(body.encode()).hexdigest()), rows


def _plain(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, str]:
    """The same search with (cost, text of letters) compared as they are."""
    best = {"n": (0, "", ())}
    gives = {"n": "u", "s": "u", "a": "u", "u": "a"}
    name = {"u": "user", "a": "assistant"}

    def fill(best):
        for _ in range(2):
            for state, (cost, audit, lines) in list(best.items()):
                to = gives[state]
                new = (cost + 5, audit + "I", (*lines, name[to] + ":"))
                if to not in best or new[:2] < best[to][:2]:
                    best = best | {to: new}
        return best

    for role, text, must_go, cut in rows:
        new = {}
        for state, (cost, audit, lines) in fill(best).items():
            ways = [(state, cost + 2, audit + "D", lines)]
            if not must_go:
                more = 5 * cut
                if role[:1] in ("u", "a") and gives[state] == role[:1] or (state, role[:1]) == ("n", "s"):
                    ways.append((role[:1], cost + more, audit + "K", (*lines, f"{role}:{text}")))
                ways.append((gives[state], cost + more + 1, audit + "R", (*lines, f"{name[gives[state]]}:{text}")))
            for to, *way in ways:
                if to not in new or tuple(way[:2]) < new[to][:2]:
                    new[to] = tuple(way)
        best = new
    best = fill(best) if rows else best
    cost, audit, lines = min((best[s] for s in "na" if s in best), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("roles", [["user"], ["user", "assistant"], ["user", "assistant", "system", "x"]])
def test_repair_of_long_conversations(roles):
    rng = random.Random(len(roles))
    for n in (1, 63, 64, 65, 128, 129, 700):
        rows = [(rng.choice(roles), f"t{k}", rng.random() < 0.1, rng.random() < 0.1) for k in range(n)]
        repair = turns.Repair()
        for r in rows:
            repair.row(*r)
        assert repair.end() == _plain(rows)


def _report(rows: list[tuple]) -> dict:
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        by_conv[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by_conv[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in by_conv.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        ts = [t for t, _, _ in found if t is not None]
        seen, rows, counts = set(), [], [0, 0, 0]
        for _, role, text in found:
            solid = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            rows.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        out[conv] = (gaps, *counts, illegal, *_plain(rows))
    return out


def test_repair_report(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.choice([1, 2, 5, 8, 150 if conv == 7 else 3])):
            turn = rng.choice([turn, turn, turn + 1, None]) if rng.random() < 0.2 else turn
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[(turn or 0) % 2]
            text = rng.choice([None, "", " \t\n", "Yes.", "no", "Why?\n", "é!", " "]) if rng.random() < 0.5 else f"t{turn}."
            rows.append((conv, turn, rng.choice([role, role, role, "system", None, ""]), text))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair_report(df).collect()}
    want = _report(rows)
    assert got == want
    assert turns.repair_report(df.limit(0)).collect() == []


def test_hilbert_steps_are_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = negatives.hilbert(points, bits)
        order = np.lexsort(keys.T[::-1])
        assert len({k.tobytes() for k in keys}) == len(points)
        assert set(np.abs(np.diff(points[order], axis=0)).sum(1)) == {1}


VECTORS = "vec_id bigint, vector array<float>, label int, anchor boolean, grp string, part string"


def _mined(rows: list[tuple]) -> Counter:
    good = [r for r in rows if None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = max((len(r[1]) for r in good), default=0)
    q = [[math.floor(256 * x) for x in r[1]] + [0] * (dims - len(r[1])) for r in good]
    out = Counter()
    for a, row in enumerate(good):
        if not row[3]:
            continue
        s = [sum(x * y for x, y in zip(q[a], v, strict=True)) for v in q]
        order = sorted((i for i in range(len(good)) if i != a), key=lambda i: (-s[i], good[i][0]))
        for p in [i for i in order if good[i][2] == row[2]][:5]:
            fit = [n for n in order if good[n][2] != row[2] and 80 * s[p] <= 100 * s[n] <= 100 * s[p]][:5]
            for k, n in enumerate(fit):
                out[row[0], good[p][0], k + 1, good[n][0], s[p], s[n]] += 1
    return out


@pytest.mark.parametrize("block, group, scale", [(16, 3, 1.0), (2048, 512, 1.0), (16, 3, 300.0), (16, 3, 1e6)])
def test_negatives_against_brute_force(spark, monkeypatch, block, group, scale):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(300):
        v = centres[i % 6] + 0.3 * rng.normal(size=8)
        rows.append((i, [float(np.float32(x * scale)) for x in v], int(rng.integers(4)), i % 10 == 0, "c", "c"))
    one = rows[4][1]
    rows += [(1000 + i, one, i % 2, i % 20 == 0, "c", "c") for i in range(60)]
    rows += [
        (2000, None, 1, True, "", ""), (2001, [1.0, None], 1, True, "", ""), (2002, [float("nan")], 1, True, "", ""),
        (2003, [float("inf")], 1, True, "", ""), (2004, [0.1] * 8, None, True, "", ""), (2005, [], 2, True, "", ""),
        (2006, [0.5], 2, True, "", ""), (None, [0.5] * 8, 2, False, "", ""), rows[10],
    ]
    df = spark.createDataFrame(rows, VECTORS)
    got = Counter(tuple(r) for r in negatives.mine(df).collect())
    assert got == _mined(rows)


def test_negatives_skip_far_blocks(spark, monkeypatch):
    """Clustered vectors: most blocks are not read."""
    monkeypatch.setattr(negatives, "BLOCK", 20)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(800):
        centre = np.eye(8)[i % 8]
        rows.append((i, [float(x) for x in centre + 0.01 * rng.normal(size=8)], int(rng.integers(2)), i % 50 == 0, "", ""))
    df = spark.createDataFrame(rows, VECTORS)
    chosen = []
    keep = negatives.stored

    def spy(df, name):
        out = keep(df, name)
        if name == "chosen":
            chosen.append((out.count(), out.select("grp").distinct().count()))
        return out

    monkeypatch.setattr(negatives, "stored", spy)
    got = Counter(tuple(r) for r in negatives.mine(df).collect())
    assert got == _mined(rows) and got
    blocks = 800 // 20
    assert all(pairs < 0.7 * groups * blocks for pairs, groups in chosen), chosen


def test_negatives_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.mine(empty).collect() == []
    none = spark.createDataFrame([(1, None, 1, True, "", "")], VECTORS)
    assert negatives.mine(none).collect() == []


def test_negatives_broadcast_nothing(spark, monkeypatch):
    """Chosen pairs lie in a file far smaller than they are: a broadcast by its size would fill the driver."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "GROUP", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(3)), i % 4 == 0, "", "") for i in range(400)]
    plans = []
    keep = negatives.stored

    def spy(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(negatives, "stored", spy)
    mined = negatives.mine(spark.createDataFrame(rows, VECTORS))
    assert Counter(tuple(r) for r in mined.collect()) == _mined(rows)
    plans.append(mined._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 7 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("limit", [1, 3])
def test_negatives_group_rows_per_shelf(spark, monkeypatch, limit):
    """A group goes to a shelf once, however many blocks of it it asks for, and gets one row back."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "GROUP", 8)
    monkeypatch.setattr(negatives, "SHELVES", limit)
    monkeypatch.setattr(negatives, "PAGE", 4)
    monkeypatch.setattr(negatives, "TOGETHER", 3)
    monkeypatch.setattr(negatives, "HELD", 50)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(3)), i % 4 == 0, "", "") for i in range(400)]
    rows += rows[:9] + [(900 + i, [0.0] * 8, i % 2, i % 3 == 0, "", "") for i in range(40)]
    sent = []
    join = negatives._first_then

    def spy(held, visits, key, parts):
        sent.append((key, parts, visits.count(), visits.select("grp").distinct().count()))
        return join(held, visits, key, parts)

    monkeypatch.setattr(negatives, "_first_then", spy)
    got = Counter(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == _mined(rows)
    assert [key for key, *_ in sent] == ["desk", "shelf"] * 2
    assert all(parts <= limit and n <= groups * (parts if key == "shelf" else 1) for key, parts, n, groups in sent), sent


def test_negatives_without_components(spark):
    rows = [(i, [], i % 2, i < 3, "", "") for i in range(6)]
    assert Counter(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()) == _mined(rows)
