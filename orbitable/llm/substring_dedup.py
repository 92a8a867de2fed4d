"""Substring dedup over words by seed and extend.

*Seeds.* Each window of WINDOW words selects the least of the hashes of its SEED-word runs (winnowing); equal
windows select the same run at the same place, so only windows on a seed that occurs again can repeat.
Batches of documents meet on their seeds, in packed lists.
*Extension.* An occurrence of such a seed is extended to the left and right to all windows that selected
it. Documents meet again on the digests of these windows; neighbouring windows that occur again make
a maximal repeat, at least WINDOW words long. No pair of occurrences is ever formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbitable.llm.arrays import U, mix, powers, prefix_hash, range_hash, text_buffer, word_spans
from orbitable.llm.batches import DEALT, among, batched, covered, deal, gathered, runs, shared_values, valid_windows, window_minima

WINDOW, SEED = 35, 12
BUCKET_VALUES = 250_000
BLOCK = 1 << 22


class _Words:
    """Words of a batch with the hashes of their windows and the runs of windows on one seed."""

    def __init__(self, table: pa.Table, window: int, seed: int):
        self.data, self.offsets = text_buffer(table["text"])
        self.starts, self.ends, self.owner = word_spans(self.data, self.offsets)
        words = range_hash(prefix_hash(self.data), self.starts, self.ends)
        n = self.n = len(words)
        self.bounds = np.searchsorted(self.owner, np.arange(len(self.offsets)))
        total = max(0, n - window + 1)
        self.seeds = self.windows = np.zeros(0, U)
        self.start = self.stop = np.zeros(0, np.int64)
        if not total:
            return
        up, down = powers(n + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(words * up[:n])])
        self.windows = mix((sums[window:] - sums[:-window]) * down[:total])
        hashes = mix((sums[seed:] - sums[:-seed]) * down[: n - seed + 1] ^ U(0x1234567))
        valid, found = valid_windows(self.bounds, window, total), []
        for at in range(0, total, BLOCK):
            end = min(total, at + BLOCK)
            chosen = window_minima(hashes[at: end + window - seed], window - seed + 1)
            start, stop = runs(chosen, valid[at:end])
            found.append((start + at, stop + at, mix(hashes[chosen[start] + at])))
        self.start, self.stop, self.seeds = (np.concatenate(x) for x in zip(*found, strict=True))

    def on(self, known: np.ndarray) -> np.ndarray:
        """Window starts whose seed is known."""
        hit = among(self.seeds, known)
        length = (self.stop - self.start)[hit]
        first = np.repeat(self.start[hit] - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length, length)
        return first + np.arange(length.sum())


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(values, return_counts=True)
    return found, counts > 1


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


def _seeds(window: int, seed: int, buckets: int):
    def run(key, table):
        return deal(key[0].as_py(), *_distinct(_Words(table, window, seed).seeds), buckets)
    return run


def _extend(window: int, seed: int, buckets: int):
    def run(key, table, known):
        if not len(table) or not len(known):
            return _empty(DEALT)
        words = _Words(table, window, seed)
        return deal(key[0].as_py(), *_distinct(words.windows[words.on(gathered(known))]), buckets)
    return run


def _remove(window: int, seed: int):
    def run(key, table, known):
        words = _Words(table, window, seed)
        hit = np.flatnonzero(among(words.windows, gathered(known)) & valid_windows(words.bounds, window, len(words.windows)))
        gone = covered(hit, hit + window, words.n)
        raw = words.data.tobytes()
        out = []
        for i in range(len(table)):
            lo, hi = words.bounds[i], words.bounds[i + 1]
            kept = np.arange(lo, hi)[~gone[lo:hi]]
            text = b" ".join([raw[a:b] for a, b in zip(words.starts[kept], words.ends[kept], strict=True)])
            out.append((int(hi - lo), int(hi - lo - len(kept)), hashlib.sha256(text).hexdigest(), text.decode()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_words": pa.array(columns[0], pa.int64()),
                         "n_removed": pa.array(columns[1], pa.int64()), "kept_sha256": pa.array(columns[2], pa.string()),
                         "kept_text": pa.array(columns[3], pa.string())})
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) per row of `docs`.

    Words are runs of characters other than space and 0x09-0x0D. Each word covered by a window of `window`
    words that also starts elsewhere (in any document, the same included) is removed, both copies.
    Null, empty and short texts lose nothing; repeated rows are repeats of each other.
    """
    rows, total = batched(docs)
    seeds = max(8, total // 80 // BUCKET_VALUES)
    wide = max(8, total // 12 // BUCKET_VALUES)
    dealt = rows.groupBy("batch").applyInArrow(_seeds(window, seed, seeds), DEALT)
    known = shared_values(dealt)
    dealt = rows.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(_extend(window, seed, wide), DEALT)
    known = shared_values(dealt)
    return rows.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(
        _remove(window, seed), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (h)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
