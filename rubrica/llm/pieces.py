"""SentencePiece encoding and decoding with a table of distinct chunks.

A chunk is a run of white space markers and what follows up to the next marker, or a line feed.
When no piece of the model has a marker behind another character and none has a line feed, no
merge can cross a chunk border, so each distinct chunk is segmented once and a text's ids are
those of its chunks, joined by position. Both facts are checked on the model when it is loaded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rubrica.llm.base import bare, rows_of

MARK = "▁"
CACHED_CHUNKS = 700_000
_CHUNK = re.compile("\n|▁*[^▁\n]+|▁+")
_CODES = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class ChunkTable:
    """Ids of distinct chunks; emptied when it is full, so memory has a bound.

    New chunks are segmented together, one on a line: the line feeds keep them apart and show
    where each one's ids end.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = re.compile("[^▁]▁|\n")
        self.separable = not any(crossing.search(p) for p in pieces)
        self.feed = self.model.encode("\n")[-1]
        self.known: dict[str, tuple[bytes, str]] = {}

    def _keep(self, chunk: str, ids: np.ndarray) -> None:
        self.known[chunk] = (ids.tobytes(), ",".join(map(str, ids.tolist())))

    def learn(self, chunks: set[str]) -> None:
        """Segment those of the chunks that are not in the table."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > CACHED_CHUNKS:
            self.known.clear()
            new = list(chunks)
        self._keep("\n", np.array([self.feed], "<u4"))
        new = [c for c in new if c != "\n"]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.model.encode("\n" + "\n".join(part) + "\n"), "<u4")
            ends = np.flatnonzero(ids == self.feed)
            for c, a, b in zip(part, ends[:-1], ends[1:], strict=True):
                self._keep(c, ids[a + 1 : b])

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids of every text and their decimal list."""
        if not self.separable:
            for ids in self.model.encode(texts, num_threads=1):
                yield ids, ",".join(map(str, ids))
            return
        for at in range(0, len(texts), 64):
            part = [
                _CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at : at + 64]
            ]
            self.learn(set(chain.from_iterable(part)))
            for chunks in part:
                found = [self.known[c] for c in chunks]
                packed = b"".join([f[0] for f in found])
                yield np.frombuffer(packed, "<u4").tolist(), ",".join([f[1] for f in found])


@cache
def _table(path: str) -> ChunkTable:
    return ChunkTable(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _codes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for docs, texts in rows_of(batches, "doc_id", "text"):
            n, shas, decoded = [], [], []
            for ids, listed in table.encode_all(texts):
                n.append(len(ids))
                shas.append(_sha(listed))
                decoded.append(_sha(table.model.decode(ids) if ids else ""))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                 "ids_sha256": shas, "decoded_sha256": decoded}
            )

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for docs, texts in rows_of(batches, "doc_id", "text"):
            ids = [i for i, _ in table.encode_all(texts)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())),
                 "decoded": [table.model.decode(i) if i else "" for i in ids]}
            )

    return run


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them."""
    return bare(docs).mapInArrow(_ids(model_path), "doc_id bigint, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text.

    A NULL text counts as empty: no ids, digests of the empty string. Repeated rows each get their
    row, NULL ids stay NULL, an empty table gives no rows. Texts of any length are segmented whole;
    a table of at most ``CACHED_CHUNKS`` chunks is kept by each worker.
    """
    return bare(docs).mapInArrow(_codes(model_path), _CODES)
