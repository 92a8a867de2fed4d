"""Suffix-array dedup: bytes covered by a long string that also starts in a document with a smaller id.

*Which suffixes meet.* A window of LENGTH bytes selects the least hash of its ANCHOR-byte runs; equal windows
select the same run. Only windows on an anchor that at least two documents hold can repeat across
documents. Those on one anchor occurrence form a stretch of at most 2 * LENGTH - ANCHOR bytes, which goes to the
bucket of its anchor; equal stretches of a batch go once, with the smallest document id.

*Bucket-pointer refinement.* A task sorts the suffixes of its stretches to the depth of LENGTH bytes. The first
8 bytes (the q-gram) give the buckets; a suffix's bucket pointer is the first place of its bucket. A bucket is refined by
sorting its members on the bucket pointers of the suffixes `depth` bytes further on. These are the pointers
refined so far, so each pass at least doubles the depth, and only buckets with several members go on.
Windows in one final bucket are equal; the smallest document of the bucket keeps its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbitable.llm.arrays import U, binaries, mix, powers, prefix_hash, range_hash, text_buffer
from orbitable.llm.batches import DEALT, among, batched, covered, deal, gathered, runs, shared_values, valid_windows, window_minima
from orbitable.llm.substring_dedup import _empty

LENGTH, ANCHOR = 50, 16
BUCKET_VALUES = 250_000
BLOCK = 1 << 22
STRETCHES = "bucket long, batch long, raw binary, sizes binary, docs binary"
FOUND = "batch long, stretch binary, low binary, high binary, doc binary"


class _Stretches:
    """The stretches of a batch: windows [start, stop) on one anchor; bytes [start, stop + LENGTH - 1)."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = text_buffer(table["text"])
        ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        total = max(0, len(self.data) - LENGTH + 1)
        self.start = self.stop = np.zeros(0, np.int64)
        self.anchors = self.digests = np.zeros(0, U)
        self.doc = np.zeros(0, np.int64)
        if not total:
            return
        _, down = powers(len(self.data) + 1)
        prefix, found = prefix_hash(self.data), []
        valid = valid_windows(self.offsets, LENGTH, total)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))[:total]
        valid &= self.known[owner]
        for at in range(0, total, BLOCK):
            end = min(total, at + BLOCK)
            last = end + LENGTH - ANCHOR
            hashes = mix((prefix[at + ANCHOR: last + ANCHOR] - prefix[at:last]) * down[at:last])
            chosen = window_minima(hashes, LENGTH - ANCHOR + 1)
            start, stop = runs(chosen, valid[at:end])
            found.append((start + at, stop + at, mix(hashes[chosen[start]] + U(1))))
        self.start, self.stop, self.anchors = (np.concatenate(x) for x in zip(*found, strict=True))
        self.doc = self.ids[owner[self.start]]
        self.digests = range_hash(prefix, self.start, self.stop + (LENGTH - 1))


def _least(keys: np.ndarray, docs: np.ndarray):
    """(distinct keys, least and greatest document of each, place of each key's first member, inverse)."""
    found, first, back = np.unique(keys, return_index=True, return_inverse=True)
    low, high = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), np.iinfo(np.int64).min)
    np.minimum.at(low, back, docs)
    np.maximum.at(high, back, docs)
    return found, low, high, first, back


def _anchors(buckets: int):
    def run(key, table):
        s = _Stretches(table)
        found, low, high, _, _ = _least(s.anchors, s.doc)
        return deal(key[0].as_py(), found, low != high, buckets)
    return run


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte ranges one after the other."""
    if not len(size):
        return np.zeros(0, np.uint8)
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


def _send(buckets: int):
    def run(key, table, known):
        if not len(table) or not len(known):
            return _empty(STRETCHES)
        s = _Stretches(table)
        hit = np.flatnonzero(among(s.anchors, gathered(known)))
        _, low, _, first, _ = _least(s.digests[hit], s.doc[hit])
        one = hit[first]
        bucket = (s.anchors[one] % U(buckets)).astype(np.int64)
        order = np.lexsort((s.start[one], bucket))
        one, low, bucket = one[order], low[order], bucket[order]
        found, begin = np.unique(bucket, return_index=True)
        bounds = np.append(begin, len(one))
        size = s.stop[one] - s.start[one] + LENGTH - 1
        raw = _slices(s.data, s.start[one], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        return pa.table({"bucket": pa.array(found, pa.int64()), "batch": pa.array(np.full(len(found), key[0].as_py()), pa.int64()),
                         "raw": binaries(raw, ends[bounds]), "sizes": binaries(size.astype(np.uint8), bounds),
                         "docs": binaries(low, bounds)})
    return run


def bucket_pointers(raw: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pointers) of the suffixes that have at least `depth` bytes; equal pointers mean equal first
    `depth` bytes, and pointers are in lexical order. `left` is the number of bytes from each place on that count."""
    reach = min(8, depth)
    n = len(raw)
    grams = np.zeros(n, U)
    for j in range(reach):
        grams[: n - j] |= raw[j:].astype(U) << U(56 - 8 * j)
    pointer = np.zeros(n, np.int64)
    places = np.flatnonzero(left >= reach)
    active, key = places, grams[places]
    base, shared = np.zeros(len(active), np.int64), None
    while True:
        order = np.argsort(key)
        active, key = active[order], key[order]
        if shared is None:
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            pointer[active] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else base
        else:
            old = (key >> U(32)).astype(np.int64)
            fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
            opens = np.append(True, old[1:] != old[:-1])[: len(key)]
            at = np.arange(len(key))
            pointer[active] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(opens, at, 0))
            new = fresh
        if reach >= depth or not len(key):
            break
        step = min(reach, depth - reach)
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        shared = np.repeat(size > 1, size)
        reach += step
        active = active[shared]
        active = active[left[active] >= reach]
        key = (pointer[active].astype(U) << U(32)) | pointer[active + step].astype(U)
    places = np.flatnonzero(left >= depth)
    return places, pointer[places]


def _match(table: pa.Table) -> pa.Table:
    raws, batches = table["raw"].to_pylist(), table["batch"].to_pylist()
    sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table["sizes"].to_pylist()]
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()])
    batch = np.repeat(batches, [len(x) for x in sizes])
    size, raw = np.concatenate(sizes), np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum(size)
    digest = range_hash(prefix_hash(raw), ends - size, ends)
    found, low, _, first, back = _least(digest, docs)
    start, length = (ends - size)[first], size[first]
    text = _slices(raw, start, length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(text))
    owner = np.repeat(np.arange(len(found)), length)
    places, pointer = bucket_pointers(text, left, LENGTH)
    _, least, _, _, group = _least(pointer, low[owner[places]])
    least = least[group]
    # Runs of windows of a stretch whose bytes belong to the same document.
    edge = np.ones(len(places), bool)
    edge[1:] = (owner[places][1:] != owner[places][:-1]) | (least[1:] != least[:-1])
    lead = np.flatnonzero(edge)
    stretch, doc = owner[places][lead], least[lead]
    begin = np.cumsum(length) - length
    lo = places[lead] - begin[stretch]
    hi = np.append(places[lead][1:], 0) - begin[stretch]
    last = np.append(stretch[1:] != stretch[:-1], True)[: len(stretch)]
    hi[last] = (length[stretch] - LENGTH + 1)[last]
    # Every batch that sent a stretch hears of runs that belong to a smaller document than its own smallest.
    by_stretch = np.searchsorted(stretch, np.arange(len(found) + 1))
    count = np.diff(by_stretch)[back]
    sender = np.repeat(np.arange(len(back)), count)
    run = np.repeat(by_stretch[:-1][back] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    tell = doc[run] < docs[sender]
    sender, run = sender[tell], run[tell]
    order = np.argsort(batch[sender], kind="stable")
    sender, run = sender[order], run[order]
    to, first = np.unique(batch[sender], return_index=True)
    bounds = np.append(first, len(sender))
    return pa.table({"batch": pa.array(to, pa.int64()), "stretch": binaries(found[stretch[run]], bounds),
                     "low": binaries(lo[run].astype(np.uint8), bounds), "high": binaries(hi[run].astype(np.uint8), bounds),
                     "doc": binaries(doc[run], bounds)})


def _cut(key, table, found):
    s = _Stretches(table)
    _, low, _, _, back = _least(s.digests, s.doc)
    mine = np.flatnonzero(s.doc > low[back])
    starts, ends = [s.start[mine]], [s.stop[mine] - 1 + LENGTH]
    if len(found) and len(s.digests):
        stretch, a, b, doc = (np.frombuffer(b"".join(found[c].to_pylist()), kind) for c, kind in (
            ("stretch", U), ("low", np.uint8), ("high", np.uint8), ("doc", np.int64)))
        order = np.argsort(s.digests, kind="stable")
        known = s.digests[order]
        lo, hi = np.searchsorted(known, stretch), np.searchsorted(known, stretch, "right")
        count = hi - lo
        row = np.repeat(np.arange(len(stretch)), count)
        at = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        hit = s.doc[at] > doc[row]
        row, at = row[hit], at[hit]
        starts.append(s.start[at] + a[row])
        ends.append(s.start[at] + b[row].astype(np.int64) - 1 + LENGTH)
    n = len(s.data)
    gone = covered(np.concatenate(starts), np.concatenate(ends), n)
    raw, out = s.data.tobytes(), []
    for lo, hi in zip(s.offsets[:-1], s.offsets[1:], strict=True):
        part = gone[lo:hi]
        removed = int(part.sum())
        if not removed:
            out.append((int(hi - lo), 0, 0, hashlib.sha256(raw[lo:hi]).hexdigest(), []))
            continue
        step = np.diff(np.concatenate([[0], part.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        spans = [{"start": int(x), "length": int(y - x)} for x, y in zip(begin, end, strict=True)]
        kept = s.data[lo:hi][~part].tobytes()
        out.append((int(hi - lo), removed, len(spans), hashlib.sha256(kept).hexdigest(), spans))
    columns = list(zip(*out, strict=True)) or [()] * 5
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_bytes": pa.array(columns[0], pa.int64()),
                     "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()),
                     "kept_sha256": pa.array(columns[3], pa.string()), "spans": pa.array(columns[4], kind)})


def remove_copied_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of `docs`.

    A byte is removed if a 50-byte string over it also starts in a document with a smaller doc_id. Texts are
    taken as UTF-8 bytes, null ones as empty. Rows that share a doc_id are not smaller than each other.
    Rows with a null doc_id lose nothing and are no source. `spans` are the maximal removed runs (bytes from 0).
    """
    rows, total = batched(docs)
    buckets = max(8, total // 18 // BUCKET_VALUES)
    dealt = rows.groupBy("batch").applyInArrow(_anchors(buckets), DEALT)
    known = shared_values(dealt)
    sent = rows.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(_send(4 * buckets), STRETCHES)
    found = sent.groupBy("bucket").applyInArrow(_match, FOUND)
    return rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
part AS (
    SELECT doc_id, k, substring(hx, k * 2000 + 1, 2098) AS s
    FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2000 + 1)) AS k FROM d)),
win AS (
    SELECT doc_id, k * 1000 + j AS i, md5(substring(s, 2 * j - 1, 100)) AS h
    FROM (SELECT doc_id, k, s, unnest(range(1, least(1000, len(s) // 2 - 49) + 1)) AS j FROM part)),
least_doc AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN least_doc USING (h) WHERE m < doc_id),
numbered AS (
    SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
        SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM numbered GROUP BY doc_id, g),
piece AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS lo, a - 1 AS hi FROM span
    UNION ALL SELECT doc_id, max(b) + 1, 1000000000 FROM span GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(substring(hx, 2 * lo - 1, 2 * greatest(0, least(hi, len(hx) // 2) - lo + 1)), '' ORDER BY lo) AS t
    FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a + 1) AS k, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, len(hx) // 2 AS n_bytes, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t, hx))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
