"""Hierarchical packing of token ids into context windows of several sizes.

Documents longer than the largest window give full windows first; the rest and all other documents
go to the tier of the smallest window that holds them. Tiers are packed from the longest down: a
window takes the longest piece of its tier, its gap is filled with the longest fitting pieces of
shorter tiers, and what is still missing is cut from one more piece. So each window but the last of
a task is full. Steps hold windows of one tier and the same number of tokens each.

Tasks pack what they read, 2**19 tokens at a time with the rest carried on, so memory stays bounded and
a lost task packs the same rows into the same windows again. A task leaves under 256 tokens in a
padded window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from orbitable.llm.arrays import chunks
from orbitable.llm.tokens import CHUNK_BYTES, encoder

TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS = 1 << 19
STEP_TOKENS = 16 * TIERS[-1]
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


class _Packer:
    """Windows of one task. A piece is (length, order, document id, start, ids of the document)."""

    def __init__(self, task: int):
        self.first = task << 40
        self.rows: list[tuple] = []
        self.pool: list[tuple] = []  # pieces up to the largest window, by length
        self.tokens = self.sequences = self.order = 0
        self.in_tier = dict.fromkeys(TIERS, 0)

    def _piece(self, doc_id, start: int, length: int, ids) -> tuple:
        self.order += 1
        return (length, self.order, doc_id, start, ids)

    def _emit(self, window: list[tuple], tier: int) -> None:
        step = self.in_tier[tier] // (STEP_TOKENS // tier)
        offset, group = 0, self.first + (step * len(TIERS) + TIERS.index(tier))
        for length, _, doc_id, start, ids in window:
            crc = zlib.crc32(ids[start: start + length])
            self.rows.append((doc_id, start, length, crc, len(ids), self.first + self.sequences, offset, tier, group))
            offset += length
        self.in_tier[tier] += 1
        self.sequences += 1

    def add(self, doc_id, ids) -> None:
        start, longest = 0, TIERS[-1]
        while len(ids) - start >= longest:
            self._emit([self._piece(doc_id, start, longest, ids)], longest)
            start += longest
        if start < len(ids):
            self.pool.append(self._piece(doc_id, start, len(ids) - start, ids))
            self.tokens += len(ids) - start

    def _window(self, tier: int) -> list[tuple]:
        """A full window that starts with the longest piece; the pool holds at least `tier` tokens."""
        window, gap = [], tier
        while gap:
            fits = bisect_right(self.pool, gap, key=lambda p: p[0])
            if fits:
                piece = self.pool.pop(fits - 1)
                window.append(piece)
                gap -= piece[0]
            else:
                length, _, doc_id, start, ids = self.pool.pop(0)
                window.append(self._piece(doc_id, start, gap, ids))
                rest = self._piece(doc_id, start + gap, length - gap, ids)
                self.pool.insert(bisect_left(self.pool, rest[0], key=lambda p: p[0]), rest)
                gap = 0
        self.tokens -= tier
        return window

    def pack(self, last: bool) -> None:
        """Pack the pool; without `last` a part of one window's size waits for the next block."""
        self.pool.sort(key=lambda p: p[:2])
        for tier in reversed(TIERS):
            shorter = tier // 2 if tier > TIERS[0] else 0
            while self.tokens >= tier and self.pool[-1][0] > shorter and (last or self.tokens >= TIERS[-1]):
                self._emit(self._window(tier), tier)
        if last:
            for tier in reversed(TIERS):
                while self.tokens >= tier:
                    self._emit(self._window(tier), tier)
            if self.pool:
                self._emit(self.pool, TIERS[-1] if self.tokens & (self.tokens - 1) else TIERS[0])
                self.pool, self.tokens = [], 0


def _pack(path: str):
    def run(batches):
        packer = _Packer(TaskContext.get().partitionId())

        def rows():
            columns = list(zip(*packer.rows, strict=True)) or [()] * 9
            packer.rows = []
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [field.split()[0] for field in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in chunks(batches, CHUNK_BYTES):
            ids, bounds = encoder(path).encode(batch.column("text"))
            # One end id behind every document: its bounds move by one per document before it.
            ids, bounds = np.insert(ids, bounds[1:], END_ID), (bounds + np.arange(len(bounds))).tolist()
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc_id, ids[bounds[k]: bounds[k + 1]])
            if packer.tokens >= BLOCK_TOKENS:
                packer.pack(last=False)
            yield rows()
        encoder(path).forget()
        packer.pack(last=True)
        yield rows()
    return run


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents in windows of at most 2048 ids; columns as in SCHEMA.

    A null text is empty and gives the end id alone. Repeated rows are packed as often as they occur, a
    null doc_id is carried along. `tier` is the window size; a last, partly filled window has the largest
    (or the smallest, where its length is a power of two and needs no padding).
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_pack(path), SCHEMA)
