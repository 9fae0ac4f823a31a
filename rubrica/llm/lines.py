"""Line dedup by content-defined chunks of lines at two scales, in built-in expressions only.

Lines with a character other than white space (``[\\x20\\x09-\\x0D]``) count; blank ones between two of them share
their fate. A rolling hash over the hashes of a line and the one before it chooses borders: after a line whose
value is 0 modulo ``spread`` a *chunk* ends. Borders depend on two lines only, so inserted or lost lines move no border
further on. A chunk lies inside a repeated run only by chance at its ends, so at the finer scale every line is a border and
every two neighbouring lines are a *pair*: pairs carry a match line by line to both ends of the run, and find runs too short to
hold a chunk. What repeats as a whole chunk is handled as one; pairs inside it are left out.

Of equal chunks or pairs, in any documents, the first by doc_id, text hash and place stays and the others go. Hashes only
propose repeats: text goes after its bytes were compared with those of the occurrence that stays. Every line that occurs
stays at its first occurrence: no pair or chunk that holds it can have an earlier one.

Only hashes and places are counted and shuffled; bodies are cut from the documents for repeats alone and meet in an
aggregate per hash, so a passage that a third of the documents share is folded where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from rubrica.llm.base import stored, text_key, unwrapped, wrapped

SPREAD = 4
_LEAST = -(2**63)
_CONTENT = "[^\\x20\\x09-\\x0D]"


def _key() -> Column:
    """A document: its id and text; NULL ids match each other inside a struct."""
    return F.struct("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("h")).alias("key")


def _lined(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """``keep``, all lines of ``text``, the places of those with content, and these lines."""
    rows = rows.select(*keep, F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.when(F.rlike(x, F.lit(_CONTENT)), i))
    rows = rows.withColumn("at", F.filter(numbered, lambda i: i.isNotNull()))
    return rows.withColumn("content", F.transform("at", lambda i: F.get("lines", i)))


def _units(docs: DataFrame, spread: int) -> DataFrame:
    """key, first, last (numbers of content lines) and hash of every pair and every chunk of three lines or more."""
    rows = _lined(docs, _key())
    rows = rows.select("key", F.transform("content", lambda x: F.xxhash64(x)).alias("h"))
    n = F.size("h")
    rows = rows.filter(n > 1).withColumn(
        "rolled", F.transform(F.slice("h", 2, n - 1), lambda x, i: F.xxhash64(F.get("h", i), x))
    )
    # A chunk begins at line k when the pair of the two lines before it says so.
    starts = F.transform("rolled", lambda x, i: F.when(x % spread == 0, i + 2))
    starts = F.concat(F.array(F.lit(0)), F.filter(starts, lambda i: i.isNotNull() & (i < n)))
    rows = rows.withColumn("starts", starts)
    pairs = F.transform("rolled", lambda x, i: F.struct(i.alias("first"), (i + 1).alias("last"), x.alias("hash")))
    ends = F.transform("starts", lambda s, q: F.coalesce(F.get("starts", q + 1), F.size("h")) - 1)
    spans = F.filter(F.arrays_zip(F.col("starts").alias("first"), ends.alias("last")), lambda c: c["last"] - c["first"] > 1)
    chunks = F.transform(
        spans,
        lambda c: F.struct(
            c["first"].alias("first"),
            c["last"].alias("last"),
            F.xxhash64(F.slice("h", c["first"] + 1, c["last"] - c["first"] + 1)).alias("hash"),
        ),
    )
    # The outer form: for the inner one Catalyst would evaluate all units once more in a filter.
    return rows.select("key", F.inline_outer(F.concat(pairs, chunks))).filter("hash IS NOT NULL")


def _place() -> Column:
    """The order of occurrences; a NULL id comes first."""
    rank = F.coalesce("key.doc_id", F.lit(_LEAST)).alias("id")
    return F.struct(rank, F.col("key.h").alias("h"), "first", "last")


def _repeats(docs: DataFrame, spread: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences of repeated hashes that would go (key, first, last, hash), and those that stay."""
    units = stored(_units(docs, spread), "units")
    counted = units.groupBy("hash").agg(F.min(_place()).alias("keeper"), F.max(_place()).alias("_last"))
    counted = stored(counted.filter("keeper <> _last").select("hash", "keeper"), "repeated")
    # Stored before the documents are looked at: rows of a very common hash may then be split over tasks.
    again = stored(units.join(counted, "hash").withColumn("gone", _place() != F.col("keeper")).drop("keeper"), "occurrences")
    again = again.repartition("key").distinct()
    # Pairs inside a chunk that goes need no look of their own; their units come after the chunk's.
    before = W.partitionBy("key").orderBy("first", F.desc("last")).rowsBetween(W.unboundedPreceding, -1)
    whole = F.when(F.col("gone") & (F.col("last") - F.col("first") > 1), F.col("last"))
    again = again.withColumn("inside", F.coalesce(F.max(whole).over(before) >= F.col("last"), F.lit(False)))
    wanted = stored(again.filter("gone AND NOT inside").select("key", "first", "last", "hash"), "wanted")
    kept = counted.join(wanted.select("hash").distinct(), "hash", "left_semi").select(
        F.struct(F.nullif("keeper.id", F.lit(_LEAST)).alias("doc_id"), "keeper.h").alias("key"),
        "keeper.first", "keeper.last", "hash",
    )
    return wanted, kept


def line_cuts(keyed: DataFrame, wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """key and cuts of documents that lose lines: ranges (first, last) of content lines, in order and apart.

    ``keyed`` has the key and text of all documents. What goes is compared with the occurrence that stays: bodies
    of both, from their documents.
    """
    places = wanted.unionByName(kept).groupBy("key").agg(F.collect_list(F.struct("first", "last", "hash")).alias("places"))
    read = keyed.join(stored(places, "places"), "key")
    read = _lined(read, "key", "places").select("content", F.explode_outer("places").alias("p"))
    body = F.array_join(F.slice("content", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1), "\n")
    read = read.select(F.col("p.hash").alias("hash"), body.alias("body"))
    bodies = read.groupBy("hash").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    # Dealt out on its own, as it is nearly always empty: a very common hash is then in no join at all.
    unequal = bodies.filter("low <> high").select("hash").repartition("hash")
    cuts = wanted.join(unequal, "hash", "left_anti")
    # Ranges that overlap or touch are one.
    line = W.partitionBy("key").orderBy("first", "last")
    reach = F.max("last").over(line.rowsBetween(W.unboundedPreceding, -1))
    cuts = cuts.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    cuts = cuts.withColumn("run", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    runs = cuts.groupBy("key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def _cut(docs: DataFrame, spread: int, rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` (key, text and ``keep``) with ``left``, and ``cut`` (ranges of lines), NULL without cuts.

    The documents meet their places and their cuts in one plan: rows of key and text only are shuffled once for both.
    """
    cuts = line_cuts(docs.select(_key(), "text"), *_repeats(docs, spread))
    rows = _lined(rows.join(cuts, "key", "left"), *keep, "text", "cuts")
    ranges = F.transform("cuts", lambda c: F.struct(F.get("at", c["first"]).alias("first"), F.get("at", c["last"]).alias("last")))
    rows = rows.select(*keep, "text", "lines", ranges.alias("cut"))
    edges = F.sequence(F.lit(0), F.size("cut"))
    kept = F.transform(edges, lambda k: F.slice("lines", _after(k) + 1, _until(k) - _after(k)))
    left = F.when(F.col("cut").isNotNull(), F.array_join(F.flatten(kept), "\n"))
    return rows.select(*keep, "text", "cut", F.when(F.col("cut").isNull(), F.col("text")).otherwise(left).alias("left"))


def _after(k: Column) -> Column:
    """The first line behind cut k - 1."""
    return F.when(k == 0, 0).otherwise(F.get("cut", k - 1)["last"] + 1)


def _until(k: Column) -> Column:
    """The first line of cut k."""
    return F.when(k == F.size("cut"), F.size("lines")).otherwise(F.get("cut", k)["first"])


def dedup_lines(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """``docs`` with repeated chunks and pairs of lines cut out of ``text``, in the columns of ``docs``.

    A NULL text stays NULL; a text of which nothing is left becomes empty; texts without repeats
    come back byte for byte. Repeated rows (equal doc_id and text) count as one document and keep or
    lose the same lines. A line alone is never cut, and blank lines only go between lines that do. Extra columns
    pass through whatever their names are. An empty table gives no rows.
    """
    rows = wrapped(docs, _key(), F.col("text"))
    return unwrapped(_cut(docs, spread, rows, "row"), docs.columns, F.col("left"))


def line_report(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """Per document: doc_id, n_cut (lines removed), cut (first line:lines of each range), text_sha256.

    An empty table gives no rows; a NULL text counts as empty here.
    """
    done = _cut(docs, spread, docs.select(_key(), "text"), "key")
    listed = F.transform("cut", lambda c: F.concat_ws(":", c["first"], c["last"] - c["first"] + 1))
    lines = F.aggregate("cut", F.lit(0), lambda s, c: s + c["last"] - c["first"] + 1)
    return done.select(
        F.col("key.doc_id").alias("doc_id"), F.coalesce(lines, F.lit(0)).cast("bigint").alias("n_cut"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("cut"),
        F.sha2(F.coalesce("left", F.lit("")), 256).alias("text_sha256"),
    )
