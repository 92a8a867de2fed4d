"""Work on batches of documents that exchange sorted number lists by bucket.

A batch is a hash group of documents of about BATCH_BYTES text. Tasks reduce a batch to distinct
values and deal them out to buckets in packed rows, at most one value per batch however often it occurs:
a passage that a third of all documents share costs a bucket one entry per batch. The number of batches and
buckets follows the text size. Nothing depends on the order of rows in a group, so tasks can run again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.llm.arrays import U, binaries

BATCH_BYTES = 2 << 20


def batched(docs: DataFrame, more: list[str] = ()) -> tuple[DataFrame, int]:
    """(doc_id, text, batch) and the text bytes. Rows of one doc_id share a batch; those without one are spread."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BATCH_BYTES))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", "text", F.pmod(key, F.lit(n)).alias("batch")), total


def deal(batch: int, values: np.ndarray, multi: np.ndarray, buckets: int, **more) -> pa.Table:
    """Rows (bucket, batch, values, multi) of sorted distinct values; multi marks values that repeat in the batch.

    `values` are dealt out by their remainder, so a bucket gets them in ascending order.
    """
    bucket = (values % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    bounds = np.append(first, len(order))
    return pa.table({"bucket": pa.array(found, pa.int64()), "batch": pa.array(np.full(len(found), batch), pa.int64()),
                     "vals": binaries(values[order], bounds), "multi": binaries(multi[order].astype(np.uint8), bounds)})


DEALT = "bucket long, batch long, vals binary, multi binary"


def _shared(table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(x, U) for x in table["vals"].to_pylist()]
    multi = [np.frombuffer(x, np.uint8) for x in table["multi"].to_pylist()]
    found, back, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    again = (counts > 1) | (np.bincount(back, weights=np.concatenate(multi), minlength=len(found)) > 0)
    hit = again[back]
    out = {"batch": [], "vals": []}
    end = 0
    for batch, vals in zip(table["batch"].to_pylist(), rows, strict=True):
        mine = vals[hit[end: end + len(vals)]]
        end += len(vals)
        if len(mine):
            out["batch"].append(batch)
            out["vals"].append(mine.tobytes())
    return pa.table({"batch": pa.array(out["batch"], pa.int64()), "vals": pa.array(out["vals"], pa.binary())})


def shared_values(dealt: DataFrame) -> DataFrame:
    """(batch, vals): which of a batch's dealt values occur in other batches or repeat in it."""
    return dealt.groupBy("bucket").applyInArrow(_shared, "batch long, vals binary")


def gathered(table: pa.Table, column: str = "vals") -> np.ndarray:
    """All numbers of a binary column, sorted."""
    return np.sort(np.frombuffer(b"".join(table[column].to_pylist()), U))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash (the leftmost of equals) in each window of `width` hashes; under 2**24 of them.

    Hashes are compared by their upper 40 bits.
    """
    best = (hashes & ~U(0xFFFFFF)) | np.arange(len(hashes), dtype=U)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span:])
    return (best & U(0xFFFFFF)).astype(np.int64)


def runs(chosen: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the maximal runs of valid windows with the same chosen position."""
    change = np.ones(len(valid) + 1, bool)
    change[1:-1] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1])
    edge = np.flatnonzero(change)
    start, stop = edge[:-1], edge[1:]
    keep = valid[start] if len(start) else np.zeros(0, bool)
    return start[keep], stop[keep]


def valid_windows(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n window starts lie in one document with their whole window."""
    step = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= width
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - width + 1, -1)
    return np.cumsum(step)[:n] > 0


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step)[:n] > 0
