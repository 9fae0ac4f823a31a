"""Token counts, huge texts by overlapping chunks that are resynchronised.

A text above ``chunk`` characters is cut into chunks that overlap. Two neighbours are spliced at
the first place of their overlap that is a token start in both encodings and is proven stable: no
piece of the model holds the two characters around it side by side, so no merge can cross it,
whatever stands around. If the overlap has no such place it is doubled and encoded again, at last
up to the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rubrica.llm.base import bare, rows_of

CHUNK = 1 << 15
OVERLAP = 256
MARK = "▁"


class Resync:
    """Token starts of parts of a text and the stable places between them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        pair = text[at - 1 : at + 1].replace(" ", MARK)
        return len(pair) == 2 and pair not in self.joined

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where the tokens of text[begin:end] start; the marker put in front counts at begin."""
        spans = self.model.encode(text[begin:end], return_type="offset_mapping")["offsets"]
        return [begin + s[0] for s in spans]

    def splice(self, text: str, left: list[int], right: list[int], begin: int, end: int) -> int:
        """First common stable start inside (begin, end), or -1."""
        common = set(left).intersection(right)
        return next((p for p in range(begin + 1, end) if p in common and self.stable(text, p)), -1)

    def count(self, text: str, chunk: int, overlap: int) -> int:
        if len(text) <= chunk:
            return len(self.model.encode(text))
        total, begin, kept_from, n = 0, 0, 0, len(text)
        while True:
            cut, wide = begin + chunk, overlap
            if cut >= n:
                return total + sum(s >= kept_from for s in self.starts(text, begin, n))
            while True:
                end = min(n, cut + wide)
                left = self.starts(text, begin, end)
                place = self.splice(text, left, self.starts(text, cut, end), cut, end)
                if place > 0:
                    total += sum(kept_from <= s < place for s in left)
                    begin, kept_from = cut, place
                    break
                if end == n:
                    return total + sum(s >= kept_from for s in left)
                wide *= 2


@cache
def _resync(path: str) -> Resync:
    return Resync(path)


def _counts(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resync = _resync(path)
        for docs, sizes, texts in rows_of(batches, "doc_id", "n_bytes", "text"):
            short = [t for t in texts if len(t) <= chunk]
            found = iter([len(ids) for ids in resync.model.encode(short, num_threads=1)])
            n = [
                next(found) if len(t) <= chunk else resync.count(t, chunk, overlap) for t in texts
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (docs, sizes, n)],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every text.

    A NULL text counts as empty: 0 bytes and 0 tokens. Repeated rows each get their row, NULL ids
    stay NULL, an empty table gives no rows. Chunk and overlap change the work, never the count.
    """
    rows = bare(docs).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text"
    )
    counted = rows.mapInArrow(
        _counts(model_path, chunk, overlap), "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
