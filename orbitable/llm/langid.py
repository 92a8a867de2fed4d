"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the vectors of its byte 1- to 4-grams (A-Z folded, hashed into 2**15 buckets)
and the label a softmax over a linear map of that average. Both are learned by stochastic gradient
descent in numpy from a bounded sample of labelled rows (TRAIN_ROWS, shared among the labels and drawn by a
hash of the id). For prediction the two matrices are multiplied out, so a gram costs one table row.

A softmax is sure of any text, also in a language it never saw. What is rejected follows from the surprise of a text, the mean of
-log p over its grams, p being the frequency of the gram in the label where it is most frequent (mixed languages surprise
little). Every fifth row of a label is held out of the training; they calibrate the temperature and the surprise
above which a text is rejected: what 99 in 100 held texts stay below, and a quarter of its distance from their median beyond
(more, the fewer are held). Few grams are weak evidence, so PRIOR_GRAMS of median surprise are added to each text.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitable.llm.arrays import U, byte_values, chunks, mix, text_buffer

TRAIN_ROWS = 3000
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
WIDTH = 16
EPOCHS = 8
UNDETERMINED = "und"
PREDICT_BYTES = 1 << 19  # text bytes that are scored together; some 80 bytes of arrays go with each
LEVEL, MARGIN, PRIOR_GRAMS = 0.99, 0.25, 64


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """For each gram length: (bucket of the gram at each byte, bytes at which a gram of a document starts)."""
    n = len(data)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    values, total = byte_values(True)[data], np.zeros(n, U)
    for size in range(1, max(GRAMS) + 1):
        k = n - size + 1
        if k <= 0:
            return
        total = total[:k] * U(0x9FB21C651E98DF25) + values[size - 1:]
        if size in GRAMS:
            yield (mix(total) & U(buckets - 1)).astype(np.int64), left[:k] >= size


def gram_counts(column, buckets: int = BUCKETS):
    """(rows, buckets, counts) of the grams of each text, sorted by row."""
    data, offsets = text_buffer(column)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = [owner[: len(b)][ok] * buckets + b[ok] for b, ok in gram_buckets(data, offsets, buckets)]
    found, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return found // buckets, found % buckets, counts


@dataclass
class Model:
    """`table` holds the score of every bucket for every label; rejected is what surprises more than `most`."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    surprise: np.ndarray
    usual: float
    most: float

    def stored(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def loaded(cls, raw: bytes) -> Model:
        return cls(**pickle.loads(raw))

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the probabilities of the labels, and whether it is rejected."""
        n, k = len(offsets) - 1, len(self.labels)
        total, grams = np.zeros((n, k + 1)), np.zeros(n)
        columns = [*self.table.T, self.surprise]
        for bucket, ok in gram_buckets(data, offsets, len(self.table)):
            inside = np.minimum(offsets, len(bucket))
            for c in range(k + 2):
                seen = np.where(ok, columns[c][bucket], 0.0) if c <= k else ok.astype(np.float64)
                sums = np.concatenate([[0.0], np.cumsum(seen)])
                change = sums[inside[1:]] - sums[inside[:-1]]
                if c <= k:
                    total[:, c] += change
                else:
                    grams += change
        scores = (total[:, :k] / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        rejected = _damped(total[:, k], grams, self.usual) > self.most
        return scores / scores.sum(axis=1, keepdims=True), rejected


def _damped(total: np.ndarray, grams: np.ndarray, usual: float) -> np.ndarray:
    """Mean surprise with PRIOR_GRAMS grams of `usual` surprise added."""
    return (total + PRIOR_GRAMS * usual) / (grams + PRIOR_GRAMS)


def _surprise(rows: list[tuple[str, np.ndarray, np.ndarray]], labels: list[str], buckets: int) -> np.ndarray:
    """-log of the share of every bucket in the label where it is largest; all texts of a label weigh the same."""
    best = np.zeros(buckets)
    for label in labels:
        share = np.zeros(buckets)
        for found, counts in (x[1:] for x in rows if x[0] == label and len(x[1])):
            share[found] += counts / counts.sum()
        # A hundredth goes to all buckets alike, so no gram is impossible.
        best = np.maximum(best, 0.99 * share / max(share.sum(), 1e-12) + 0.01 / buckets)
    return -np.log(best)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], labels: list[str], buckets: int = BUCKETS, seed: int = 7) -> Model:
    """Stochastic gradient descent over (label, buckets, counts) rows; every fifth row of a label calibrates."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (buckets, WIDTH))
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(labels))), np.zeros(len(labels))
    of_label = {x: [i for i in range(len(rows)) if rows[i][0] == x] for x in labels}
    held = sorted(i for found in of_label.values() for i in found[4::5])
    train = sorted(set(range(len(rows))) - set(held))
    number = {x: i for i, x in enumerate(labels)}
    steps, total = 0, max(1, EPOCHS * len(train))
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            label, found, counts = rows[i]
            if not len(found):
                continue
            rate = 0.5 * (1 - steps / total)
            steps += 1
            share = counts / counts.sum()
            mean = share @ vectors[found]
            error = _softmax(mean @ weights + bias)
            error[number[label]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            # A shared step for all buckets of the text, larger for frequent ones.
            vectors[found] -= (20 * rate) * np.outer(share, back)
    table = vectors @ weights
    surprise = _surprise([rows[i] for i in train], labels, buckets)
    use = [i for i in held if len(rows[i][1])]
    if not use:
        return Model(labels, table, bias, 1.0, surprise, 0.0, np.inf)
    z = np.array([(rows[i][2] / rows[i][2].sum()) @ table[rows[i][1]] + bias for i in use])
    y = np.array([number[rows[i][0]] for i in use])
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 5, 40)}
    temperature = min(loss, key=loss.get)
    grams = np.array([rows[i][2].sum() for i in use])
    total = np.array([rows[i][2] @ surprise[rows[i][1]] for i in use])
    usual = float(np.median(total / grams))
    level = float(np.quantile(_damped(total, grams, usual), LEVEL))
    most = level + (MARGIN + 10 / len(use)) * max(level - usual, 0.25)
    return Model(labels, table, bias, float(temperature), surprise, usual, most)


def _shares(counts: dict[str, int], rows: int) -> list[tuple[str, int, float]]:
    """(label, rows to draw, part of the hashes that holds them)."""
    out, left = [], rows
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        share = min(n, max(1, left // (len(counts) - k)))
        left -= share
        out.append((label, share, min(1.0, (share + 8 * share ** 0.5 + 30) / n)))
    return out


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on about `rows` rows of (id, text, label), of each label the first by a hash of id and text; None without any.

    Every label has the same share; what small labels leave goes to the larger ones, and one row is the least.
    """
    usable = labelled.filter("text is not null and label is not null and text rlike '\\\\p{L}'").withColumn("h", F.xxhash64("id", "text"))
    shares = _shares({r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}, rows)
    if not shares:
        return None
    shares = usable.sparkSession.createDataFrame(shares, "label string, share long, within double")
    # Hashes are even, so the first rows of a label lie within this part of them; only those are sorted.
    drawn = usable.join(F.broadcast(shares), "label").withColumn("draw", F.pmod("h", F.lit(1 << 40))).filter(F.col("draw") <= F.col("within") * (1 << 40))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "h", "text"))
    sample = drawn.withColumn("place", place).filter("place <= share").select("label", "text", "draw", "h")
    # The bounded sample is fitted in one task; the driver gets a table of buckets x labels.
    found = sample.coalesce(1).mapInArrow(_fitted, "model binary").collect()
    return Model.loaded(found[0]["model"]) if found else None


def _fitted(batches):
    rows = [(draw, h, label, text) for batch in batches
            for draw, h, label, text in zip(*(batch.column(c).to_pylist() for c in ("draw", "h", "label", "text")), strict=True)]
    if not rows:
        return
    rows.sort()
    data = []
    for batch in chunks([pa.RecordBatch.from_pydict({"text": pa.array([r[3] for r in rows], pa.large_string())})]):
        owner, found, counts = gram_counts(batch.column("text"))
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
        found, counts, start = found.astype(np.int32), counts.astype(np.int32), len(data)
        data += [(rows[start + k][2], found[x:y], counts[x:y]) for k, (x, y) in enumerate(zip(bounds, bounds[1:]))]
    model = fit(data, sorted({r[2] for r in rows}))
    yield pa.RecordBatch.from_arrays([pa.array([model.stored()], pa.binary())], names=["model"])


def _predict(model: Model | None):
    def run(batches):
        for batch in chunks(batches, PREDICT_BYTES):
            data, offsets = text_buffer(batch.column("text"))
            label, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            rejected = np.ones(batch.num_rows, bool)
            if model is not None:
                p, novel = model.probabilities(data, offsets)
                letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                best = p.argmax(axis=1)
                label = [model.labels[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
                score = np.where(letters, p.max(axis=1), 0.0)
                rejected = ~letters | novel
            kept = [c for c in batch.schema.names if c not in ("text", "letters")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(label), pa.array(score, pa.float64()), pa.array(rejected)],
                names=[*kept, "lang_pred", "score", "rejected"])
    return run


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Model from the rows of `docs` that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")), rows)


def identify(docs: DataFrame, model: Model | None, whole_rows: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) per row of `docs`, from the whole text alone.

    A text that is null or has no letter is `und` with score 0 and rejected, and so is every text
    where there was nothing to learn from. Texts of any length are read whole; repeated rows get the same answer each. With
    `whole_rows` the first column is `row`, a struct of all columns of `docs`, whatever their names, instead of doc_id.
    """
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*(docs.columns if whole_rows else ["doc_id"])).alias("row"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").alias("text"), letters.alias("letters"))
    inner = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_predict(model), f"row {inner}, held_out boolean, lang_pred string, score double, rejected boolean")
    return found.select("row" if whole_rows else "row.*", "held_out", "lang_pred", "score", "rejected")
