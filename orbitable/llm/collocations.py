"""Phrase mining with counts from burstable tries.

A first pass counts hashes of words and of adjacent words in a table of fixed size. A bucket that stays below the least
count holds no frequent word or pair, so the second pass leaves those out of its windows. The filter only saves work:
hashes that meet make a bucket heavier, never lighter, and on a corpus that fills all buckets every window is kept.

In the second pass a task numbers the words it meets and keeps, per language, a shallow trie over word numbers whose leaves are
containers: bags of word windows (a word and up to three that follow it in its piece) with their counts. A container
takes unsorted batches, is compacted when they outgrow it, and bursts in two at a word of its prefix when it holds
too many distinct windows. When a task's windows pass SPILL, its subtrees are spilled as runs: sorted windows of one
prefix partition with the words they use. All runs of a prefix partition are merged in one group, which yields exact counts
of the phrases of 2 to 4 words in it; the counts of words come from the same pass.

Prefix partitions are dealt by the first two words. One that turns out larger than CELL_WINDOWS (a very common word
pair) is dealt further by the last two words, and its phrase counts are added up once more; equal windows
arrive once per run, so no phrase, however common, makes a group larger than the number of runs. Only phrases that reach the least
count leave a partition, so what follows is a set of joins over frequent phrases.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitable.llm.arrays import U, chunks, mix, text_buffer
from orbitable.session import broadcast_checked, cut_lineage

LONGEST = 4
LEAST = 30
TOP = 2000
COVERED = 80
SALTS = 16
CHUNK_BYTES = 4 << 20
BURST = 1 << 16
SPILL = 5 << 18
VOCABULARY = 1 << 19
CELL_BYTES = 4 << 20
CELL_WINDOWS = 2 << 20
NO_LANGUAGE = "und"
PAIR_BUCKETS = 1 << 24
WORD_BUCKETS = 1 << 22
SEGMENT = 1 << 12
RUNS = "lang string, part long, n long, words binary, ids binary, counts binary"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPLIT = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
_GAP = _SPLIT | np.isin(np.arange(256), [9, 32])


def piece_words(column) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as bytes, text of each, whether the next word follows in the same piece) of a string column, A-Z folded."""
    data, offsets = text_buffer(column)
    data = _FOLD[data]
    letter = ~_GAP[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[(offsets < len(data))]
    first[edges] = letter[edges]
    starts = np.flatnonzero(first)
    text = np.searchsorted(offsets, starts, "right") - 1
    split = np.append(0, np.cumsum(_SPLIT[data]))[starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (split[1:] == split[:-1]) & (text[1:] == text[:-1])
    upto = np.append(0, np.cumsum(letter))
    flat = np.ascontiguousarray(data[letter])
    ends = np.append(upto[starts], len(flat)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(flat)]), text, follows


class _Words:
    """Words of some texts with hashes of each word and of each word with the one that follows it."""

    def __init__(self, langs: list, column):
        words, text, self.follows = piece_words(column)
        coded = words.dictionary_encode()
        self.distinct, self.code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        self.langs, by_text = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        self.lang = by_text[text] if len(text) else text
        hashes = np.fromiter(map(zlib.crc32, self.distinct), np.uint32, len(self.distinct)).astype(U)[self.code]
        own = np.array([zlib.crc32(x.encode()) for x in self.langs], U)[self.lang] if len(text) else np.zeros(0, U)
        self.words = (mix(hashes + own * U(0xD6E8FEB86659FD93)) % U(WORD_BUCKETS)).astype(np.int64) + PAIR_BUCKETS
        mixed = hashes[:-1] * U(0x9E3779B97F4A7C15) + hashes[1:] + (own[1:] << U(32))
        self.pairs = (mix(mixed) % U(PAIR_BUCKETS)).astype(np.int64)


def _bucket_sums(least: int):
    """Occupied buckets of a task by segment; counts stop at `least`, which decides the same."""
    kind = np.min_scalar_type(2 * least)

    def run(batches):
        total = np.zeros(PAIR_BUCKETS + WORD_BUCKETS, kind)
        for batch in chunks(batches, CHUNK_BYTES):
            words = _Words(batch.column("lang").to_pylist(), batch.column("text"))
            found, n = np.unique(np.concatenate([words.words, words.pairs[words.follows[:-1]]]), return_counts=True)
            total[found] = np.minimum(total[found] + np.minimum(n, least), least)
        at = np.flatnonzero(total)
        segment = at // SEGMENT
        found, first = np.unique(segment, return_index=True)
        places, counts = (at % SEGMENT).astype(np.uint16), total[at]
        edges = [*first.tolist(), len(at)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array([places[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
             pa.array([counts[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["segment", "places", "counts"])
    return run


def _heavy_bits(least: int):
    """One bit per bucket of a segment: whether it reaches `least`. Streams over the rows of a partition."""
    kind = np.min_scalar_type(2 * least)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, places, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "places", "counts")), strict=True):
                mine = total.setdefault(segment, np.zeros(SEGMENT, np.int64))
                mine[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, kind)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(
            [np.packbits(x >= least).tobytes() for x in total.values()], pa.binary())], names=["segment", "bits"])
    return run


def heavy_buckets(rows: DataFrame, least: int) -> np.ndarray:
    """Which hash buckets reach `least`, as packed bits: (PAIR_BUCKETS + WORD_BUCKETS) / 8 bytes whatever the size of the corpus."""
    sums = rows.mapInArrow(_bucket_sums(least), "segment long, places binary, counts binary")
    found = sums.repartition("segment").mapInArrow(_heavy_bits(least), "segment long, bits binary")
    out = np.zeros((PAIR_BUCKETS + WORD_BUCKETS) // SEGMENT * SEGMENT // 8, np.uint8).reshape(-1, SEGMENT // 8)
    for row in found.collect():  # one short row per segment
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows (first two words, last two words, count), sorted."""
    high, low, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    return high[at], low[at], (np.add.reduceat(n, at) if len(at) else n)


class _Container:
    """Windows whose prefix lies in one range of the trie."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = self.compact_size = 0

    def add(self, part: tuple) -> None:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > 2 * self.compact_size + BURST:
            self.compact()

    def compact(self) -> tuple:
        self.parts = [_merged(self.parts)]
        self.size = self.compact_size = len(self.parts[0][0])
        return self.parts[0]


class Trie:
    """Counts of windows under a shallow trie: leaf containers cover ranges of prefixes (first two word numbers)."""

    def __init__(self):
        self.bounds, self.leaves = [U(0)], [_Container()]

    @property
    def size(self) -> int:
        return sum(x.size for x in self.leaves)

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        high, low, n = _merged([(high, low, np.ones(len(high), np.int64))])
        edges = [*np.searchsorted(high, np.array(self.bounds, U)).tolist(), len(high)]
        for k in reversed(range(len(self.leaves))):
            if edges[k] < edges[k + 1]:
                part = slice(edges[k], edges[k + 1])
                self.leaves[k].add((high[part], low[part], n[part]))
                if self.leaves[k].compact_size > BURST:
                    self._burst(k)

    def _burst(self, k: int) -> None:
        """Two containers from one: between two first words, or within one first word between two second words."""
        high, low, n = self.leaves[k].compact()
        middle = high[len(high) // 2]
        if middle >> U(32) != high[0] >> U(32):
            middle = (middle >> U(32)) << U(32)
        if middle == high[0]:
            later = np.flatnonzero(high > middle)
            if not len(later):
                return  # a single prefix stays one container
            middle = high[later[0]]
        at = int(np.searchsorted(high, middle))
        halves = _Container(), _Container()
        halves[0].add((high[:at], low[:at], n[:at]))
        halves[1].add((high[at:], low[at:], n[at:]))
        for half in halves:
            half.compact_size = half.size
        self.leaves[k: k + 1] = halves
        self.bounds.insert(k + 1, middle)

    def subtrees(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows, sorted."""
        found = [leaf.compact() for leaf in self.leaves if leaf.parts]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (U, U, np.int64))


def _four(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    return [(x >> U(s) & U(0xFFFFFFFF)).astype(np.int64) for x in (high, low) for s in (32, 0)]


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers, not negative, in the narrowest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _run(lang: str, part: int, columns: list[np.ndarray], counts: np.ndarray, words: list[bytes]) -> tuple:
    """A row of RUNS: windows over the run's own word numbers (from 1; 0 is no word)."""
    used, codes = np.unique(np.concatenate(columns), return_inverse=True)
    codes = codes + 1 if not len(used) or used[0] else codes
    listed = b" ".join(map(words.__getitem__, used[used > 0].tolist()))
    return lang, part, len(counts), listed, _small(codes).tobytes(), _small(counts).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else np.uint8).astype(np.int64)


class _Counter:
    """Words and tries of one task; `heavy` has the bits of `heavy_buckets`."""

    def __init__(self, parts: int, heavy: np.ndarray):
        self.parts, self.heavy, self.rows = parts, heavy, []
        self.tries: dict[str, Trie] = {}
        self._renumber()

    def _renumber(self):
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]
        self.seen: dict[str, np.ndarray] = {}
        self.total: dict[str, int] = {}

    def _reach(self, buckets: np.ndarray) -> np.ndarray:
        return (self.heavy[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8) & 1).astype(bool)

    def _ids(self, words: _Words) -> np.ndarray:
        """Numbers of the words that may be frequent, 0 for others."""
        often = self._reach(words.words)
        used = np.zeros(len(words.distinct), bool)
        used[words.code[often]] = True
        kept = np.flatnonzero(used)
        listed = [words.distinct[k] for k in kept.tolist()]
        new = [w for w in listed if w not in self.number]
        self.number.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.words += new
        ids = np.zeros(len(words.distinct), U)
        ids[kept] = np.fromiter(map(self.number.__getitem__, listed), U, len(listed))
        return np.where(often, ids[words.code], U(0))

    def add(self, langs: list[str], column) -> None:
        words = _Words(langs, column)
        ids, n = self._ids(words), len(words.code)
        more = words.follows.copy()
        more[:-1] &= self._reach(words.pairs) & (ids[:-1] > 0) & (ids[1:] > 0)
        window, open_ = [ids], np.ones(n, bool)
        for k in range(1, LONGEST):
            open_ = open_ & np.append(more, np.zeros(k, bool))[k - 1: k - 1 + n]
            window.append(np.where(open_, np.append(ids, np.zeros(k, U))[k:], U(0)))
        high, low = (window[0] << U(32)) | window[1], (window[2] << U(32)) | window[3]
        for c, lang in enumerate(words.langs.tolist()):
            mine = words.lang == c
            self.total[lang] = self.total.get(lang, 0) + int(mine.sum())
            counts = np.bincount(ids[mine].astype(np.int64), minlength=len(self.words))
            before = self.seen.get(lang, np.zeros(0, np.int64))
            counts[: len(before)] += before
            counts[0] = 0
            self.seen[lang] = counts
            mine &= more
            if mine.any():
                self.tries.setdefault(lang, Trie()).add(high[mine], low[mine])
        if len(self.words) > VOCABULARY:
            self.finish()
        elif sum(t.size for t in self.tries.values()) > SPILL:
            self.spill()

    def spill(self) -> None:
        """All subtrees become runs; words keep their numbers."""
        hashes = np.fromiter(map(zlib.crc32, self.words), np.uint32, len(self.words)).astype(U)
        for lang, trie in self.tries.items():
            high, low, counts = trie.subtrees()
            columns = _four(high, low)
            part = (mix(hashes[columns[0]] * U(0x9E3779B97F4A7C15) + hashes[columns[1]]) % U(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            for p, rows in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                self.rows.append(_run(lang, p, [x[rows] for x in columns], counts[rows], self.words))
        self.tries = {}

    def finish(self) -> None:
        """Spill the tries and the word counts, and number words anew."""
        self.spill()
        self.rows += [(lang, -2, n, b"", b"", b"") for lang, n in self.total.items()]
        for lang, counts in self.seen.items():
            hit = np.flatnonzero(counts)
            words = b" ".join(map(self.words.__getitem__, hit.tolist()))
            self.rows.append((lang, -1, len(hit), words, b"", _small(counts[hit]).tobytes()))
        self._renumber()

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=[f.split()[0] for f in RUNS.split(", ")])


def _runs(parts: int, heavy: np.ndarray):
    def run(batches):
        counter = _Counter(parts, heavy)
        for batch in chunks(batches, CHUNK_BYTES):
            counter.add(batch.column("lang").to_pylist(), batch.column("text"))
            if counter.rows:
                yield counter.take()
        counter.finish()
        yield counter.take()
    return run


def _word_counts(batches):
    for batch in batches:
        for lang, n, words, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "words", "counts")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(words.decode().split(" ") if n else [], pa.string()),
                                              pa.array(_numbers(counts, n))], names=["lang", "phrase", "f"])


def _dealt_further(batches):
    """Runs of large partitions cut by a hash of the last two words into `cuts` of them."""
    for batch in batches:
        rows = []
        for lang, part, n, words, ids, counts, cuts in zip(
                *(batch.column(c).to_pylist() for c in ("lang", "part", "n", "words", "ids", "counts", "cuts")), strict=True):
            listed = [b"", *words.split(b" ")]
            columns, number = list(_numbers(ids, 4 * n).reshape(4, n)), _numbers(counts, n)
            hashes = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed)).astype(U)
            cut = (mix(hashes[columns[2]] * U(0x9E3779B97F4A7C15) + hashes[columns[3]]) % U(cuts)).astype(np.int64)
            for c in np.unique(cut).tolist():
                at = np.flatnonzero(cut == c)
                _, _, *row = _run(lang, part, [x[at] for x in columns], number[at], listed)
                rows.append((lang, part, *row, cuts, c))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["lang", "part", "n", "words", "ids", "counts", "cuts", "cut"])


def _merge(least: int):
    """Frequent phrases of one prefix partition; where it was cut further, short phrases come with part of their count."""
    def run(table: pa.Table) -> pa.Table:
        lang, whole = table["lang"][0].as_py(), table["cuts"][0].as_py() <= 1
        listed, parts, at = [], [], 0
        for n, words, ids, counts in zip(*(table[c].to_pylist() for c in ("n", "words", "ids", "counts")), strict=True):
            listed += words.split(b" ")
            parts.append((at, _numbers(ids, 4 * n).reshape(4, n), _numbers(counts, n)))
            at = len(listed)
        coded = pa.array(listed, pa.binary()).dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(U) + U(1)
        windows = []
        for start, columns, counts in parts:
            own = np.where(columns > 0, codes[np.maximum(columns - 1, 0) + start], U(0))
            windows.append(((own[0] << U(32)) | own[1], (own[2] << U(32)) | own[3], counts))
        high, low, counts = _merged(windows)
        ids = np.stack(_four(high, low))
        changed = np.zeros(len(high), bool)
        changed[:1] = True
        phrases, found = [], []
        for k in range(1, LONGEST + 1):
            changed[1:] |= ids[k - 1, 1:] != ids[k - 1, :-1]
            if k == 1:
                continue
            first = np.flatnonzero(changed)
            total = np.add.reduceat(counts, first) if len(first) else counts
            keep = (ids[k - 1, first] > 0) & ((total >= least) | (not whole and k < LONGEST))
            for row in ids[:k, first[keep]].T.tolist():
                phrases.append(b" ".join(vocabulary[i - 1] for i in row).decode())
            found.append(total[keep])
        f = np.concatenate(found)
        return pa.table({"lang": pa.array([lang] * len(f), pa.string()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(f, pa.int64())})
    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, cell_bytes: int = CELL_BYTES, cell_windows: int = CELL_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to 4 words with f >= least, (lang, n) number of words)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / cell_bytes))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    runs = cut_lineage(rows.mapInArrow(_runs(parts, heavy_buckets(rows, least)), RUNS))
    words = runs.filter("part = -1").select("lang", "n", "words", "counts").mapInArrow(_word_counts, "lang string, phrase string, f long")
    words = words.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    windows = runs.filter("part >= 0")
    cuts = windows.groupBy("lang", "part").agg(F.ceil(F.sum("n") / cell_windows).alias("cuts")).filter("cuts > 1")
    large = broadcast_checked(cut_lineage(cuts))
    one, none = F.lit(1).cast("long").alias("cuts"), F.lit(0).cast("long").alias("cut")
    dealt = windows.join(large, ["lang", "part"], "left_anti").select("*", one, none).unionByName(
        windows.join(large, ["lang", "part"]).mapInArrow(_dealt_further, f"{RUNS}, cuts long, cut long"))
    longer = dealt.groupBy("lang", "part", "cut").applyInArrow(_merge(least), "lang string, phrase string, f long")
    longer = longer.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    frequent = longer.unionByName(words).filter(F.col("f") >= least)
    return cut_lineage(frequent), runs.filter("part = -2").groupBy("lang").agg(F.sum("n").alias("n"))


def _salted(part: Column, phrase: Column) -> Column:
    """Which copy of a part's count a phrase reads: single words are common parts, so they have SALTS copies."""
    return F.when(F.instr(part, " ") == 0, F.pmod(F.xxhash64(phrase), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cell_bytes: int = CELL_BYTES, cell_windows: int = CELL_WINDOWS) -> DataFrame:
    """The `top` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A null lang counts as `und`; null, empty and wordless texts add nothing; repeated rows count as often as they occur; a text of any
    length is one row; an empty table gives no rows. Ties in score go to the more frequent phrase, then in byte order.
    Only `lang` and `text` are read.
    """
    phrases, sizes = phrase_counts(docs, least, cell_bytes, cell_windows)
    length = F.size(F.split("phrase", " "))
    longer = phrases.withColumn("length", length).filter("length > 1")
    counts = phrases.select(
        "lang", F.col("phrase").alias("part"), "f",
        F.explode(F.when(F.instr("phrase", " ") == 0, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
                  .otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substr(phrase, length(left) + 2)"))
    for side, name in (("left", "l"), ("right", "r")):
        other = counts.select("lang", F.col("part").alias(side), F.col("salt").alias(f"{name}_salt"), F.col("f").alias(name))
        cuts = cuts.withColumn(f"{name}_salt", _salted(F.col(side), F.col("phrase"))).join(other, ["lang", side, f"{name}_salt"])
    score = F.expr("cast((cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.expr("""flatten(transform(sequence(2, length - 1), m -> transform(sequence(0, length - m),
                      i -> array_join(slice(split(phrase, ' '), i + 1, m), ' '))))""")
    covers = (longer.filter("length > 2").select("lang", F.col("f"), F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = best.join(covers, ["lang", "phrase"], "left").filter(
        "longer is null or cast(100 as decimal(3, 0)) * cast(longer as decimal(19, 0)) < " f"cast({COVERED} as decimal(3, 0)) * cast(a as decimal(19, 0))")
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(4 * SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
windows AS (SELECT lang, w[i:i + 3] AS w FROM spots),
grams AS (SELECT lang, array_to_string(w[1:k], ' ') AS phrase, k, count(*) AS f FROM windows, range(1, 5) t(k) WHERE len(w) >= k GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE f >= 30),
cuts AS (SELECT lang, phrase, w, k AS size, f AS a, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.size], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scores),
inner_spots AS (SELECT lang, f, w, k, unnest(range(2, k)) AS m FROM often WHERE k > 2),
inners AS (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM inner_spots),
covers AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM inners GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE nth = 1 AND (c.longer IS NULL OR 100 * c.longer::HUGEINT < 80 * b.a::HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
