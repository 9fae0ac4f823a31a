"""Conversation structure repair: the cheapest edits that make roles alternate, by integer weights.

A conversation is a path through a graph whose nodes are (row, role state); states are nothing yet, system,
user and assistant, and the kept roles must read ``(s?(ua)+)?``. Every edit is an arc with a letter, Delete, Insert,
Keep or Rerole. The weight of a path is one integer: its high digits are the cost, below
them stands a fixed number of octal digits, one per letter from the left in ASCII order (D 1, I 2, K 3, R 4),
zeros after the last. An arc adds its cost and its letter's digit at the path's next place, and the smallest
integer wins at every node. That decides ties by the audit text as well: of two paths that
have taken the same rows, none is the beginning of the other (the extra letters would all be inserts,
but each path ends with a row's letter), so their digits differ before either ends and whatever
follows cannot turn the order.

Rows come sorted and are taken one by one; of each state only the best path lives. After ``SPAN`` rows its
letters are put away and its digits give way to one, the path's rank among the (at most four)
living ones, so integers stay short and a conversation of any length costs linear time and memory of
its audit letters alone. Each living path carries the sha256 of its repaired text so far; no texts are held.

Defined cases. NULL conv_id: those rows are one conversation. NULL role or text: one space (a space is no legal
role, and blank text). NULL turn: first, and no part in gaps. Rows of the same turn are taken by role, then
text; repeated rows are duplicates. A role counts by its first character, an empty one has none and cannot be
kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rubrica.llm.base import rows_of, tasks

DELETE, INSERT, KEEP, REROLE = "DIKR"
DIGIT = {DELETE: 1, INSERT: 2, KEEP: 3, REROLE: 4}
LETTER = {digit: letter for letter, digit in DIGIT.items()}
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED = 5
START, SYSTEM, USER, ASSISTANT = range(4)
# Where a kept initial leads, and the role that rerole or insert gives in each state.
KEEPS = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
GIVES = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
LEGAL = {"su", "ua", "au"}
# Rows between two renewals of the integers; a row takes at most its own letter and two inserts.
SPAN = 64
INSERTS = 2
PLACES = 1 + (SPAN + 1) * (1 + INSERTS)
LOW = 3 * PLACES
MASK = (1 << LOW) - 1
WHITE = " \t\n\v\f\r"


class Path:
    """The best path into a state: weight, next place, letters put away, hash of the repaired text."""

    __slots__ = ("weight", "place", "past", "hash", "lines")

    def __init__(self, weight=0, place=1, past=None, hash=None, lines=False):
        self.weight, self.place, self.past = weight, place, past
        self.hash, self.lines = hash or hashlib.sha256(), lines

    def arc(self, letter: str, more: int = 0) -> int:
        return self.weight + ((COST[letter] + more) << LOW) + (DIGIT[letter] << 3 * (PLACES - 1 - self.place))

    def along(self, weight: int, line: str | None) -> Path:
        """The path one arc longer; ``line`` joins its text."""
        if line is None:
            return Path(weight, self.place + 1, self.past, self.hash, self.lines)
        hash = self.hash.copy()
        hash.update(("\n" + line if self.lines else line).encode("utf-8", "surrogatepass"))
        return Path(weight, self.place + 1, self.past, hash, True)

    def letters(self) -> str:
        digits = (self.weight & MASK) >> 3 * (PLACES - self.place)
        return "".join(LETTER[digits >> 3 * k & 7] for k in range(self.place - 2, -1, -1))


class Repair:
    """Edits of one conversation whose rows come in order."""

    def __init__(self):
        self.best = {START: Path()}
        self.rows = 0

    def _insert(self) -> None:
        """Up to INSERTS rows of empty text before the next row."""
        edge = self.best
        for _ in range(INSERTS):
            made: dict[int, tuple[int, Path, str]] = {}
            for state, path in edge.items():
                to, role = GIVES[state]
                weight = path.arc(INSERT)
                rivals = [made[to][0]] if to in made else []
                rivals += [self.best[to].weight] if to in self.best else []
                if all(weight < rival for rival in rivals):
                    made[to] = (weight, path, role)
            edge = {to: path.along(weight, f"{role}:") for to, (weight, path, role) in made.items()}
            self.best = self.best | edge

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        if self.rows and self.rows % SPAN == 0:
            self._renew()
        self.rows += 1
        self._insert()
        found: dict[int, tuple[int, Path, str | None]] = {}

        def offer(to: int, weight: int, path: Path, line: str | None) -> None:
            if to not in found or weight < found[to][0]:
                found[to] = (weight, path, line)

        more = TRUNCATED if truncated else 0
        for state, path in self.best.items():
            offer(state, path.arc(DELETE), path, None)
            if must_go:
                continue
            to = KEEPS.get((state, role[:1]))
            if to is not None:
                offer(to, path.arc(KEEP, more), path, f"{role}:{text}")
            to, given = GIVES[state]
            offer(to, path.arc(REROLE, more), path, f"{given}:{text}")
        self.best = {to: path.along(weight, line) for to, (weight, path, line) in found.items()}

    def _renew(self) -> None:
        """Put letters away; a path's digits become its rank among the living, whatever their costs."""
        order = sorted(self.best, key=lambda state: self.best[state].weight & MASK)
        for rank, state in enumerate(order):
            path = self.best[state]
            weight = (path.weight >> LOW << LOW) + (rank << 3 * (PLACES - 1))
            self.best[state] = Path(weight, 1, (path.past, path.letters()), path.hash, path.lines)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit letters and the hash of the repaired text."""
        if self.rows:
            self._insert()
        last = min((self.best[s] for s in (START, ASSISTANT) if s in self.best), key=lambda p: p.weight)
        parts, past = [last.letters()], last.past
        while past is not None:
            past, letters = past
            parts.append(letters)
        return last.weight >> LOW, "".join(reversed(parts)), last.hash.hexdigest()


class Conversation:
    """Figures of one conversation whose rows come in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial: str | None = None
        self.repair = Repair()

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        solid = text.rstrip(WHITE)
        blank, repeated = not solid, bool(solid) and repeated
        cut = bool(solid) and not repeated and solid[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.repair.row(role, text, blank or repeated, cut)

    def figures(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end()


FIGURES = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
NAMES = [f.split()[0] for f in FIGURES.split(", ")]
_TYPES = {"bigint": pa.int64(), "string": pa.string()}
# Conversations whose figures go out in one batch.
BATCH = 2048


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order; a row that is ``gone`` only names its conversation."""
    schema = pa.schema(
        [("conv_id", pa.string())] + [(f.split()[0], _TYPES[f.split()[1]]) for f in FIGURES.split(", ")]
    )
    done: list[tuple] = []
    current, at = None, None

    def out() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for columns in rows_of(batches, "conv_id", "turn", "role", "text", "repeated", "gone"):
        for conv, turn, role, text, repeated, gone in zip(*columns, strict=True):
            if current is None or conv != at:
                if current is not None:
                    done.append((at, *current.figures()))
                    if len(done) == BATCH:
                        yield out()
                        done = []
                current, at = Conversation(), conv
            if not gone:
                current.row(turn, role, text, repeated)
    if current is not None:
        done.append((at, *current.figures()))
        yield out()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id (as text) and figures of every conversation; ``gone`` rows only keep their conversation in the result.

    Rows: conv_id, turn, role, text, gone.
    """
    # One shuffle: the window over equal rows, which saves holding texts to compare with, keeps to it.
    dealt = rows.repartition(tasks(rows.sparkSession), "conv_id")
    same = W.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    flagged = dealt.withColumn("repeated", F.row_number().over(same) > 1)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated"]
    return flagged.sortWithinPartitions(*order).mapInArrow(_figures, f"conv_id string, {FIGURES}")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the damage of the query, by the checksum of conversation and turn."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20).alias("kind"),
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") == 0).alias("gone"),
    )


def repair_report(conversations: DataFrame) -> DataFrame:
    """Figures of every conversation after the damage, conv_id in its own type."""
    kind = conversations.schema["conv_id"].dataType
    return repair(damage(conversations)).select(F.col("conv_id").cast(kind).alias("conv_id"), *NAMES)
