"""Vectorised text helpers that run inside tasks: byte buffers, hashes, words, shingles.

Texts of an Arrow column are handled as one byte array with offsets, so that a chunk of many
documents costs a fixed number of numpy calls. Null texts count as empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, values = column.buffers()
    offsets = np.frombuffer(ends, width)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0]: offsets[-1]] if values else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches, limit: int = CHUNK_BYTES, column: str = "text"):
    """Cut record batches into slices of at most `limit` text bytes, a longer text alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.concatenate([[0], np.cumsum(sizes)]), 0
        while start < len(sizes):
            end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over the whole word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def byte_values(fold: bool) -> np.ndarray:
    """A 64-bit value per byte; with `fold`, A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=U) * U(_BASE))
    if fold:
        values[65:91] = values[97:123]
    return values


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U)
            steps[:1] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix sums of byte values times base powers: n + 1 values."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(byte_values(fold)[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end), the same wherever the bytes stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each run of bytes other than space and 0x09-0x0D."""
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    before = np.concatenate([[False], letter])[:-1] if len(data) else letter
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.concatenate([letter[1:], [False]]) if len(data) else letter
    ends = np.flatnonzero(letter & (~after | np.concatenate([edge[1:-1], [True]]))) + 1 if len(data) else starts
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


SHINGLE_FACTORS = mix(np.arange(11, 11 + 64, dtype=U)) | U(1)


def shingles(words: np.ndarray, owner: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and of the whole of a document with fewer; with their documents."""
    counts = np.bincount(owner, minlength=n_docs)
    total = np.zeros(max(0, len(words) - size + 1), U)
    for j in range(size if len(total) else 0):
        total += words[j: j + len(total)] * SHINGLE_FACTORS[j]
    whole = owner[: len(total)] == owner[size - 1:] if len(total) else np.zeros(0, bool)
    out, docs = [mix(total[whole])], [owner[: len(total)][whole]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        value = counts[short].astype(U) * U(0xA0761D6478BD642F)
        for j in range(size - 1):
            has = counts[short] > j
            value[has] += words[first[has] + j] * SHINGLE_FACTORS[j]
        out.append(mix(value))
        docs.append(short)
    return np.concatenate(out), np.concatenate(docs)


def distinct_by_doc(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted by document and value."""
    order = np.argsort(values)
    key = docs[order]
    order = order[np.argsort(key.astype(np.uint16) if len(key) and key.max() < 65536 else key, kind="stable")]
    v, d = values[order], docs[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def document_sets(column, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each text, A-Z folded: (values, row in the chunk)."""
    data, offsets = text_buffer(column)
    starts, ends, owner = word_spans(data, offsets)
    words = range_hash(prefix_hash(data, fold=True), starts, ends)
    return distinct_by_doc(*shingles(words, owner, len(offsets) - 1, size))


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices values[bounds[i]:bounds[i + 1]] as a binary column."""
    raw = np.ascontiguousarray(values)
    ends = (np.asarray(bounds, np.int64) * raw.dtype.itemsize).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return out.cast(pa.binary())
