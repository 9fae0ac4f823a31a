"""Document fingerprints by consistent weighted sampling, in built-in expressions only.

A text's terms are its lower-cased words, weighted by their counts. For sample k, term t of weight
S draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from one hash of (t, k), takes i = floor(ln S / r + b)
and ln a = ln c - r (i - b + 1); the term with the smallest a, with its i, is the sample. Two texts
agree in a sample with the probability of their generalised Jaccard similarity. A Gamma(2, 1)
draw is -ln(u v) of two uniform ones. ln a and a 24-bit code of (t, i) share one integer, so that a
plain MIN over the terms of a text keeps sample and code together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rubrica.llm.base import bare, stored
from rubrica.operators.ranking import ordered_blocks

SAMPLES = 24
_SPACE = r"[\x20\x09-\x0D]+"
_OWN = ["_k1", "_k2"]
_NEXT = ["_t1", "_t2"]


def _uniform(x: Column, shift: int, n: int) -> Column:
    """n bits of a hash as a number inside (0, 1)."""
    bits = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << n) - 1))
    return (bits + 0.5) * F.lit(2.0**-n)


def samples(term: Column, log_weight: Column, n: int) -> list[Column]:
    """For each sample the integer whose minimum over a text's terms is the sample."""
    out = []
    for k in range(n):
        x, y = F.xxhash64(term, F.lit(k)), F.xxhash64(term, F.lit(n + k))
        r = -F.log(_uniform(x, 0, 32) * _uniform(x, 32, 32))
        log_c = F.log(-F.log(_uniform(y, 0, 20) * _uniform(y, 20, 20)))
        b = _uniform(y, 40, 24)
        i = F.floor(log_weight / r + b)
        order = F.floor((log_c - r * (i - b + 1) + 128) * F.lit(float(1 << 31)))
        code = (F.shiftrightunsigned(x, 20) + i * 0x9E37).bitwiseAND(F.lit(0xFFFFFF))
        out.append(F.shiftleft(order, 24).bitwiseOR(code))
    return out


def _terms(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per distinct word of each text: its hash and log count. A text without words keeps
    one row of NULLs. Sorted hashes bring equal words together, so counts are lengths of runs.
    """
    words = F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    df = df.select(*keep, hashes.alias("_h"))
    last = F.filter(
        F.sequence(F.lit(1), F.size("_h")),
        lambda i: (i == F.size("_h")) | (F.get("_h", i) != F.get("_h", i - 1)),
    )
    df = df.select(*keep, "_h", F.when(F.size("_h") > 0, last).alias("_last"))
    runs = F.transform(
        "_last",
        lambda e, j: F.struct(
            F.get("_h", e - 1).alias("_term"),
            (e - F.when(j > 0, F.get("_last", j - 1)).otherwise(0)).alias("_count"),
        ),
    )
    df = df.select(*keep, F.inline_outer(runs))
    return df.withColumn("_log", F.log(F.col("_count").cast("double")))


def fingerprints(df: DataFrame, text: str, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """``keys`` and ``_codes``: n 16-bit sample codes, -1 for a text without words."""
    drawn = samples(F.col("_term"), F.col("_log"), n)
    mins = [F.min(c).alias(f"_m{k}") for k, c in enumerate(drawn)]
    found = _terms(df, text, keys).groupBy(*keys).agg(*mins)
    codes = [
        F.coalesce(F.col(f"_m{k}").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(-1))
        for k in range(n)
    ]
    return found.select(*keys, F.array(*codes).alias("_codes"))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples: the estimate of generalised Jaccard similarity."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)
    return F.size(same) / F.size(a)


def printed(codes: str) -> Column:
    """Codes as four hexadecimal digits each."""
    return F.array_join(
        F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.bitwiseAND(F.lit(0xFFFF)))), 4, "0")), ""
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return bare(docs).select(
        F.coalesce("doc_id", F.lit(0)).alias("_k1"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("_k2"),
        "doc_id", "text", F.char_length("text").cast("bigint").alias("n_chars"),
    )


def _successors(keyed: DataFrame) -> DataFrame:
    """Per distinct row its number of copies and its next row by descending doc_id, ties by hash.

    Only ids move here: range blocks are ranked inside, and the first row of each block, one row
    per block, closes the gaps between them.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc("_k2")]
    rows = keyed.groupBy(*_OWN, "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("_copies"))
    cut = ordered_blocks(rows, order)
    inside = W.partitionBy("_block").orderBy(*order)
    cut = cut.withColumns(
        {"_at": F.row_number().over(inside), "_next": F.lead(F.struct(*_OWN)).over(inside)}
    )
    heads = cut.filter("_at = 1").select("_block", F.struct(*_OWN).alias("_head"))
    by_block = W.orderBy("_block")
    whole = by_block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = heads.select(
        "_block",
        F.coalesce(F.lead("_head").over(by_block), F.first("_head").over(whole)).alias("_after"),
    )
    linked = cut.join(F.broadcast(after), "_block")
    return linked.select(
        *_OWN, "doc_id", "n_chars", "_copies", F.coalesce("_next", "_after").alias("_next")
    )


def edited_pairs(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    The edited text ends in the head of the next document by descending doc_id (after the last the
    first): its last floor(n_chars / 2) code points are replaced by as many, or all, of that one's
    first. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A NULL text counts as empty; texts without words all have the fingerprint of that
    case and are alike. NULL ids come last in the order; rows with equal ids follow each other by a
    hash of their text, and repeated rows are each other's next document. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    own = stored(fingerprints(keyed, "text", _OWN, n), "fingerprints")
    first = W.partitionBy(*_OWN).orderBy("doc_id")
    texts = keyed.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1")
    texts = texts.select(*_OWN, "text")
    pairs = _successors(keyed).withColumn("_half", F.floor(F.col("n_chars") / 2))
    to_next = F.struct(F.col("_next._k1"), F.col("_next._k2"), F.lit(1).cast("bigint").alias("_times"))
    to_copy = F.struct(*_OWN, (F.col("_copies") - 1).alias("_times"))
    targets = F.filter(F.array(to_next, to_copy), lambda t: t["_times"] > 0)
    pairs = pairs.select(*_OWN, "doc_id", "n_chars", "_half", F.explode(targets).alias("_to"))
    pairs = pairs.select(
        *_OWN, "doc_id", "n_chars", "_half", F.col("_to._k1").alias("_t1"),
        F.col("_to._k2").alias("_t2"), F.col("_to._times").alias("_times"),
    )
    source = texts.select(F.col("_k1").alias("_t1"), F.col("_k2").alias("_t2"), F.col("text").alias("_source"))
    heads = pairs.join(source, _NEXT).withColumn("_head", F.expr("substring(_source, 1, int(_half))"))
    heads = heads.drop("_source")
    kept = F.expr("substring(text, 1, int(n_chars - _half))")
    edited = heads.join(texts, _OWN).withColumn("_edited", F.concat(kept, "_head"))
    edited = edited.withColumn("edited_sha256", F.sha2("_edited", 256))
    keys = [*_OWN, *_NEXT, "doc_id", "n_chars", "_times", "edited_sha256"]
    found = fingerprints(edited, "_edited", keys, n).withColumnRenamed("_codes", "_edited_codes")
    found = found.join(own, _OWN)
    following = own.select(
        F.col("_k1").alias("_t1"), F.col("_k2").alias("_t2"), F.col("_codes").alias("_next_codes")
    )
    found = found.join(following, _NEXT)
    found = found.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", printed("_codes").alias("fingerprint"),
        printed("_edited_codes").alias("edited_fingerprint"),
        likeness("_codes", "_edited_codes").alias("near_edited"),
        likeness("_codes", "_next_codes").alias("near_next"),
    )
