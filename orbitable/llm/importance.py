"""Importance resampling toward a target distribution of hashed word n-grams.

Texts are scanned with an Aho-Corasick automaton over the distinct words of a chunk, each bounded by delimiters on
both sides, so a match is a whole word. Its payload is the word's CRC-32 and length. The CRC of a run of words
follows from the payloads alone: appending n bytes to a text is a linear map of its CRC that depends on n only, so adjacent
payloads are composed by table look-ups and no n-gram is ever spelled out.

Texts are scanned once, and the buckets of each document are stored. One pass over them counts per task (at most BUCKETS numbers
leave a task), a second one sums the gains of each document. Dictionaries live for one chunk of at most arrays.CHUNK_BYTES (or one longer text), so memory does not grow with the
vocabulary, and nothing but the two bucket histograms passes through the driver.
"""

from __future__ import annotations

import math
import zlib
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.llm.arrays import binaries, chunks
from orbitable.operators.ranking import numbered, value_buckets
from orbitable.session import cut_lineage

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: A-Z folded, every delimiter a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 32 for b in range(256))
_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_BYTES = np.arange(256, dtype=np.uint32)


def _after(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Apply a linear map, given by its values on each byte of a word (4 x 256), to numbers."""
    return (tables[0][values & 255] ^ tables[1][(values >> 8) & 255] ^ tables[2][(values >> 16) & 255] ^ tables[3][values >> 24])


def _one_byte() -> np.ndarray:
    """What one appended zero byte does to the linear part of a CRC-32: (x >> 8) ^ step of the lowest byte."""
    # The step of byte b is the change of the CRC of one byte; it is linear in b.
    return np.stack([_STEP, _BYTES, _BYTES << np.uint32(8), _BYTES << np.uint32(16)])


def append_tables(lengths: np.ndarray) -> np.ndarray:
    """For each length the 4 x 256 tables that carry a CRC over that many appended bytes."""
    lengths = np.asarray(lengths, np.int64)
    out = np.stack([_BYTES << np.uint32(8 * k) for k in range(4)])[None].repeat(len(lengths), 0)
    power, bit = _one_byte(), 1
    while len(lengths) and bit <= lengths.max():
        has = (lengths & bit) > 0
        out[has] = _after(power, out[has])
        power, bit = _after(power, power), bit * 2
    return out


def compose(left: np.ndarray, right: np.ndarray, tables: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """CRC of left + right from both CRCs; tables[kind] belongs to the length of right."""
    flat = tables.reshape(len(tables), 4 * 256).ravel()
    base = kind * 1024
    moved = (flat[base + (left & 255)] ^ flat[base + 256 + ((left >> 8) & 255)]
             ^ flat[base + 512 + ((left >> 16) & 255)] ^ flat[base + 768 + (left >> 24)])
    return moved ^ right


class Scanner:
    """Automaton over the distinct words of some texts; matches come out as payload numbers."""

    def __init__(self, words: set[str]):
        self.automaton = ahocorasick.Automaton()
        listed = list(words)
        for k, word in enumerate(listed):
            self.automaton.add_word(f" {word} ", k)
        raw = [w.encode() for w in listed]
        self.crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        lengths, self.kind = np.unique(np.fromiter(map(len, raw), np.int64, len(raw)), return_inverse=True)
        self.tables = append_tables(lengths)
        if listed:
            self.automaton.make_automaton()

    def emitted(self, text: str) -> np.ndarray:
        """Payload numbers of the words of a text that starts and ends with a delimiter, in order."""
        return np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int64)


def feature_buckets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every run of 1 to LONGEST words of a string column, and the number of words of each text."""
    texts = [(t or "").encode().translate(_FOLD).decode() for t in column.to_pylist()]
    # A line break stands for the end of a text: it is no word byte, so it meets no word.
    joined = " \n ".join(["", *texts, ""])
    words = set(joined.split(" "))
    words.discard("")
    scanner = Scanner(words)
    found = scanner.emitted(joined)
    breaks = scanner.crc[found] == zlib.crc32(b"\n")
    breaks[breaks] = scanner.kind[found[breaks]] == 0  # one byte long: "\n" is the only such word with this CRC
    text = np.cumsum(breaks) - 1
    crc, kind = scanner.crc[found], scanner.kind[found]
    buckets, owners, run, space = [], [], crc, np.zeros(len(found), np.int64)
    one = append_tables(np.array([1]))
    whole = ~breaks
    for n in range(LONGEST):
        if n:
            # run[i] covers words i .. i + n - 1; take in a space and the next word.
            spaced = compose(run[:-1], np.full(max(0, len(run) - 1), zlib.crc32(b" "), np.uint32), one, space[: max(0, len(run) - 1)])
            run = compose(spaced, crc[n:], scanner.tables, kind[n:])
            whole = whole[:-1] & ~breaks[n:]
        at = np.flatnonzero(whole)
        buckets.append((run[at] % np.uint32(BUCKETS)).astype(np.int64))
        owners.append(text[at])
    counts = np.bincount(owners[0], minlength=len(texts))
    return np.concatenate(buckets), np.concatenate(owners), counts


def _hashed(batches):
    for batch in chunks(batches):
        bucket, text, words = feature_buckets(batch.column("text"))
        order = np.argsort(text, kind="stable")
        ends = np.cumsum(np.bincount(text, minlength=batch.num_rows))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), binaries(bucket[order].astype(np.uint16), np.append(0, ends))],
                                         names=["doc_id", "n_words", "buckets"])


def hashed_features(texts: DataFrame) -> DataFrame:
    """(doc_id, n_words, buckets) of rows (doc_id, text), stored: texts are scanned once, 2 bytes a feature are read from then on."""
    return cut_lineage(texts.mapInArrow(_hashed, "doc_id long, n_words long, buckets binary"))


def _buckets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows one after another, bounds of the rows)."""
    raw = batch.column("buckets").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint16), np.append(0, np.cumsum([len(x) // 2 for x in raw], dtype=np.int64))


def _histogram(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(_buckets(batch)[0], minlength=BUCKETS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])


def bucket_counts(hashed: DataFrame) -> np.ndarray:
    """Features per bucket over all rows: BUCKETS numbers, added up by Spark."""
    found = hashed.select("buckets").mapInArrow(_histogram, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in found.collect():  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, target over source, per bucket."""
    s, t = (float(x.sum()) + BUCKETS for x in (source, target))
    return np.array([math.floor(1000 * math.log((a + 1.0) * s / ((b + 1.0) * t)))
                     for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def _weigh(gains: np.ndarray):
    def run(batches):
        for batch in batches:
            buckets, bounds = _buckets(batch)
            upto = np.append(0, np.cumsum(gains[buckets]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(np.diff(bounds)), pa.array(np.diff(upto[bounds]))],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def resample(docs: DataFrame, target: DataFrame, seed: str = "42", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows of `docs`; `rank` numbers the drawn ones.

    Score is weight plus a Gumbel number drawn from the hash of seed and doc_id, so the highest scores are a draw without
    replacement by importance. Null texts have no words; a null doc_id hashes as the empty one and loses ties;
    repeated rows are weighed, scored and may be drawn each, in any order among themselves. An empty target leaves the
    smoothed uniform one; empty `docs` give no rows. Only `doc_id` and `text` are read.
    """
    ours = hashed_features(docs.selectExpr("cast(doc_id as long) doc_id", "text"))
    gains = bucket_gains(bucket_counts(ours), bucket_counts(hashed_features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"))))
    rows = ours.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((draw.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = cut_lineage(rows.withColumn("score", F.col("weight") + gumbel))
    fit = scored.filter(F.col("n_words") >= least_words)
    wanted = fit.count() * percent // 100
    ordered = fit.withColumn("_down", -F.col("score"))
    ranked = numbered(ordered, [], ["_down", F.col("doc_id").asc_nulls_last()], value_buckets(ordered, "_down"))
    drawn = F.when(F.col("rank") <= wanted, F.col("rank").cast("long")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    short = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, drawn).unionByName(short)


ORACLE = r"""
WITH RECURSIVE
word_lists AS (
  SELECT doc_id, 0 AS kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
spots AS (SELECT kind, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM word_lists),
features AS (
  SELECT kind, doc_id, w[i] AS feature FROM spots
  UNION ALL SELECT kind, doc_id, w[i] || ' ' || w[i + 1] FROM spots WHERE i < len(w)
  UNION ALL SELECT kind, doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 1 < len(w)),
counted AS (SELECT kind, doc_id, feature, count(*) AS n FROM features GROUP BY ALL),
seen AS (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM counted),
-- what a byte does to the checksum with p bytes behind it, and the checksum of n zero bytes
bit_steps(p, b, v) AS (
  SELECT 0, b, v FROM (
    WITH RECURSIVE shifted(b, k, v) AS (
      SELECT x, 0, x FROM range(256) t(x)
      UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM shifted WHERE k < 8)
    SELECT b, v FROM shifted WHERE k = 8)),
one_byte AS MATERIALIZED (SELECT b, v FROM bit_steps),
longest AS (SELECT max(len(h) // 2) AS n FROM seen),
behind(p, b, v) AS (
  SELECT 0, b, v FROM one_byte
  UNION ALL
  SELECT p + 1, behind.b, xor(behind.v >> 8, t.v) FROM behind JOIN one_byte t ON t.b = behind.v % 256 WHERE p + 1 < (SELECT n FROM longest)),
zeros(n, v) AS (
  SELECT 0, 4294967295
  UNION ALL
  SELECT n + 1, xor(zeros.v >> 8, t.v) FROM zeros JOIN one_byte t ON t.b = zeros.v % 256 WHERE n < (SELECT n FROM longest)),
bytes AS (SELECT feature, len(h) // 2 AS n, unnest(range(len(h) // 2)) AS i, h FROM seen),
sums AS (
  SELECT feature, any_value(bytes.n) AS n, bit_xor(v) AS v
  FROM bytes JOIN behind ON p = bytes.n - 1 - i AND b = (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1
  GROUP BY feature),
hashed AS (SELECT feature, xor(xor(sums.v, zeros.v), 4294967295) % 10000 AS bucket FROM sums JOIN zeros ON zeros.n = sums.n),
placed AS (SELECT kind, doc_id, bucket, n FROM counted JOIN hashed USING (feature)),
totals AS (SELECT coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM placed),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, cast(floor(1000 * ln((b.t + 1)::DOUBLE * (totals.s + 10000)::DOUBLE / ((b.s + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM buckets b, totals),
weights AS (SELECT doc_id, sum(n * gain) AS weight, sum(n) AS n_features FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT * FROM word_lists WHERE kind = 0) d LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM ranked) THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
