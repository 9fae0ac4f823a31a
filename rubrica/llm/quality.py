"""Quality classifier: a factorisation machine over hashed words, text structure and lengths.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): the
sum-of-squares identity makes all pairwise interactions linear in the number of features. The
model is fitted on at most ``sample`` labelled documents (those with the smallest hash of their
id, never from the held-out fold); every text is scored whole, where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.base import bare, rows_of, words_of

SAMPLE = 6000
WORD_BUCKETS = 1 << 14
BINS = 8
RANK = 8
EPOCHS = 12
BATCH = 256
RATE = 0.1
DECAY = 1e-5
THRESHOLD = 0.3
FOLDS = 5
_STATS = 14
SIZE = WORD_BUCKETS + _STATS * (BINS + 1)


def _share(raw: np.ndarray, chars: bytes) -> float:
    return float(np.isin(raw, np.frombuffer(chars, np.uint8)).mean()) if len(raw) else 0.0


def structure(data: bytes, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Figures of a text between 0 and 1: lengths, character classes and repetition."""
    raw, n = np.frombuffer(data, np.uint8), len(words)
    counts = np.bincount(raw, minlength=256) / max(1, len(raw))
    letters = counts[65:91].sum() + counts[97:123].sum()
    lines = data.split(b"\n")
    same = float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
    return np.array([
        min(1.0, np.log2(len(raw) + 1) / 24),
        min(1.0, np.log2(n + 1) / 20),
        min(1.0, float((ends - starts).mean()) / 20) if n else 0.0,
        min(1.0, float((ends - starts).max()) / 100) if n else 0.0,
        len(np.unique(words)) / n if n else 0.0,
        same,
        counts[65:91].sum() / letters if letters else 0.0,
        counts[48:58].sum(),
        counts[[35, 36, 37, 38, 42]].sum(),
        counts[[33, 63]].sum(),
        counts[[124, 43, 60, 61, 62, 95, 126, 123, 125]].sum(),
        counts[[44, 46, 58, 59]].sum(),
        counts[128:].sum(),
        1 - len(set(lines)) / len(lines),
    ])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: bucket numbers and values."""
    data = text.encode()
    words, starts, ends = words_of(data)
    slots, tf = np.unique(words % np.uint64(WORD_BUCKETS), return_counts=True)
    weight = np.log1p(tf)
    weight = weight / max(1e-9, np.sqrt((weight**2).sum()))
    stats = structure(data, words, starts, ends)
    # Small shares differ by orders of magnitude, so bins follow the square root.
    bins = np.minimum(BINS - 1, (np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64))
    at = WORD_BUCKETS + np.arange(_STATS) * (BINS + 1)
    index = np.concatenate([slots.astype(np.int64), at, at + 1 + bins])
    value = np.concatenate([weight, stats, np.full(_STATS, 0.5)])
    return index.astype(np.int32), value.astype(np.float32)


@dataclass
class Machine:
    """Parameters of a factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Raw scores of rows whose entries begin at ``first``; every row has entries."""
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, first)
        squares = np.add.reduceat(vx * vx, first)
        lin = np.add.reduceat(self.linear[index] * value, first)
        return self.bias + lin + 0.5 * (total * total - squares).sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> Machine:
    """AdaGrad on the logistic loss. Labels of one class only give the constant model."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98))
    linear, factors = np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK))
    model = Machine(float(np.log(share / (1 - share))), linear, factors)
    if len(np.unique(labels)) < 2:
        factors[:] = 0
        return model
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            sizes = np.array([len(rows[i][0]) for i in pick])
            index = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = factors[index] * value[:, None]
            total = np.add.reduceat(vx, first)
            out = model.margins(index, value, first)
            error = (_sigmoid(out) - labels[pick]) / len(pick)
            each = np.repeat(error, sizes) * value
            used, slot = np.unique(index, return_inverse=True)
            gw = np.bincount(slot, each) + DECAY * linear[used]
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            gv = np.stack([np.bincount(slot, pull[:, f]) for f in range(RANK)], 1)
            gv += DECAY * factors[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += error.sum() ** 2
            linear[used] -= RATE * gw / np.sqrt(seen_w[used])
            factors[used] -= RATE * 0.5 * gv / np.sqrt(seen_v[used])
            model.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, labels, texts in rows_of(batches, "doc_id", "label", "text"):
        found = [features(t) for t in texts]
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int32()),
             "index": [i.tobytes() for i, _ in found], "value": [v.tobytes() for _, v in found]}
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents outside the held-out fold.

    ``labels`` has doc_id and quality; rows with NULLs are skipped, and of repeated ids the larger
    label counts. The sample has the smallest hashes of doc_id, so it does not depend on the order of
    rows; its size is the bound for the broadcast and for what reaches the driver.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = bare(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.max("label").alias("label"), F.max("text").alias("text")
    )
    rows = texts.mapInArrow(_featured, "doc_id bigint, label int, index binary, value binary")
    found = sorted(rows.collect())
    pairs = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in found]
    return fit(pairs, np.array([r[1] for r in found], np.float64))


def _scorer(model: Machine, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                index, value = features(text or "")
                scores.append(float(_sigmoid(model.margins(index, value, np.array([0])))[0]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, name]
            )

    return run


def score(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: how likely label 1 is. Only ``text`` is looked at.

    NULL and empty texts are scored alike, by their structure; repeated rows get equal scores. ``name`` must
    be free: see ``free_name``.
    """
    small = Machine(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))
    fields = [f"`{n.replace('`', '``')}` {t}" for n, t in docs.dtypes]
    return docs.mapInArrow(_scorer(small, name), ", ".join([*fields, f"`{name}` double"]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``THRESHOLD`` on) of every document.

    A NULL doc_id is never held out. An empty table gives no rows; without usable labels the score
    is constant.
    """
    scored = score(bare(docs), train(docs, labels, sample))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
