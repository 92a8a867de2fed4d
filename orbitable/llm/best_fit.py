"""Best-fit packing planned on the histogram of piece lengths.

Documents are encoded once; one longer than a sequence is cut into pieces of the full length behind a
first piece that may be shorter. The plan needs only how many pieces of each length there are: best-fit decreasing
runs over (length, count), and open sequences of the same history stand for each other, so a step moves whole
ranges of sequences at a time. The plan is a small table of slots: ranks `first_rank` to `first_rank + n` of
one length go to consecutive places of a range of sequences. A piece gets its rank within its length from
the number its task gave it and from the counts of the tasks before, and takes the slot of that rank.

The histogram has at most LIMIT rows, and a plan row closes a range of sequences by at least one length, so the size of the plan
depends on LIMIT alone and not on the corpus. No length is ranked in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitable.llm.arrays import chunks
from orbitable.llm.tokens import CHUNK_BYTES, encoder
from orbitable.session import cut_lineage

LIMIT = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _pieces(path: str, limit: int):
    """Rows of PIECES: `nth` numbers the pieces of one length in the task."""
    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in chunks(batches, CHUNK_BYTES):
            ids, bounds = encoder(path).encode(batch.column("text"))
            ids, bounds = np.insert(ids, bounds[1:], END_ID), bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            counts = -(-sizes // limit)
            doc = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = sizes - (counts - 1) * limit
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * limit)
            length = np.where(piece == 0, first[doc], limit)
            at = (bounds[doc] + start).tolist()
            crc = [zlib.crc32(ids[a: a + n]) for a, n in zip(at, length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            nth = np.empty(len(doc), np.int64)
            nth[order] = seen[ordered] + np.arange(len(doc)) - np.searchsorted(ordered, ordered)
            seen += np.bincount(length, minlength=limit + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)],
                names=[c.split()[0] for c in PIECES.split(", ")])
        encoder(path).forget()
    return run


def plan_slots(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first_rank, n, each, sequence_id, offset) of best-fit decreasing over a length histogram.

    Ranks first_rank.. of a length fill the sequences from sequence_id on, `each` pieces per sequence one behind the
    other from `offset`; the last of these sequences may get fewer. Sequences are numbered without gaps.
    """
    slots, used = [], 0
    open_ranges: list[tuple[int, int, int]] = []  # (room left, first sequence, number of sequences), ascending
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        changed = []
        at = bisect_left(open_ranges, (length, -1, -1))
        while left and at < len(open_ranges):
            # The fullest sequences that still have room; one takes pieces until it has none.
            room, first, n = open_ranges.pop(at)
            each = room // length
            taken = min(n, -(-left // each))
            placed = min(left, taken * each)
            slots.append((length, rank, placed, each, first, limit - room))
            last = placed - (taken - 1) * each
            if taken > 1:
                changed.append((room - each * length, first, taken - 1))
            changed.append((room - last * length, first + taken - 1, 1))
            if taken < n:
                changed.append((room, first + taken, n - taken))
            rank, left = rank + placed, left - placed
        if left:
            each = limit // length
            taken = -(-left // each)
            slots.append((length, rank, left, each, used, 0))
            last = left - (taken - 1) * each
            if taken > 1:
                changed.append((limit - each * length, used, taken - 1))
            changed.append((limit - last * length, used + taken - 1, 1))
            used += taken
        for kept in changed:
            if kept[0]:
                insort(open_ranges, kept)
    return slots


def _place(slots: list[tuple], limit: int):
    """Adds (sequence_id, offset) to pieces with their rank."""
    length, first_rank, _, each, sequence, offset = np.array(slots or [(0,) * 6], np.int64).T
    order = np.lexsort((first_rank, length))
    length, first_rank, each, sequence, offset = (x[order] for x in (length, first_rank, each, sequence, offset))
    starts = np.searchsorted(length, np.arange(limit + 2))

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.empty(len(size), np.int64)
            by_size = np.argsort(size, kind="stable")
            edges = np.searchsorted(size[by_size], np.arange(limit + 2))
            for n in np.unique(size).tolist():
                rows = by_size[edges[n]: edges[n + 1]]
                slot[rows] = starts[n] + np.searchsorted(first_rank[starts[n]: starts[n + 1]], rank[rows], "right") - 1
            step, place = np.divmod(rank - first_rank[slot], each[slot])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence[slot] + step), pa.array(offset[slot] + place * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_best_fit(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of all documents in as few sequences of at most `limit` ids as best-fit decreasing finds.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Every document ends with END_ID, so a null or
    empty text is a piece of one id. Repeated rows are packed as often as they occur, a null doc_id is carried
    along, other columns are not read; pieces of equal length take slots in the order in which tasks read them. A very
    long text becomes many full pieces. An empty table gives no rows. The pieces (some 50 bytes each) are
    written below the checkpoint folder before they are counted, so a lost task cannot change a rank.
    """
    found = cut_lineage(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_pieces(path, limit), PIECES))
    sizes = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    earlier = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    ranked = found.join(earlier, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    return ranked.mapInArrow(_place(plan_slots(counts, limit), limit),
                             "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
