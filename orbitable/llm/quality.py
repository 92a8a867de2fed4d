"""Quality classification by hierarchical empirical Bayes.

*Document evidence*: a naive Bayes score over hashed byte 3- and 4-grams of the whole text. Its counts come from at most
TRAIN_ROWS labelled training texts of each class, drawn by a hash of the id (grouped sums by gram and class), the mean log ratio per gram is calibrated by
a two-parameter logistic fit on the rows of another fold.
*Site evidence*: labelled shares by host and by path. Hosts share a beta prior whose mean is the global share and
whose strength comes from how much the host shares differ beyond chance; a path's prior is its host's
posterior, with a strength found the same way. Sparse sites thus stay near what is known above them.
*Combination*: log odds of the document plus the shift of the path's posterior against the global share.

Calibration and site sums are grouped aggregations over all labelled rows; the drawn ids (2 x TRAIN_ROWS numbers) are broadcast, and only tables of fixed
size (BUCKETS grams, CELLS score cells, a dozen sums) reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitable.llm.arrays import chunks, text_buffer
from orbitable.llm.langid import gram_buckets
from orbitable.session import cut_lineage

BUCKETS = 1 << 15
CELLS = 200
TRAIN_ROWS = 20_000  # labelled texts per class that the gram counts are learned from
SIZES = slice(2, 4)  # of the gram lengths 1 to 4


def _grams(column):
    """(row, bucket) of all grams of a chunk, and the number of grams of each text."""
    data, offsets = text_buffer(column)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bucket, ok in list(gram_buckets(data, offsets, BUCKETS))[SIZES]:
        rows.append(owner[: len(bucket)][ok])
        found.append(bucket[ok])
    return np.concatenate(rows), np.concatenate(found), len(offsets) - 1


def _count(batches):
    """One packed row per task and class: how often each bucket occurs."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in chunks(batches):
        rows, found, _ = _grams(batch.column("text"))
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        total += np.bincount(label[rows] * BUCKETS + found, minlength=2 * BUCKETS).reshape(2, BUCKETS)
    at = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])],
                                     names=["bucket", "low", "high"])


def _score(ratios: np.ndarray):
    """Mean log ratio per gram of each text; 0 without grams."""
    def run(batches):
        for batch in chunks(batches):
            rows, found, n = _grams(batch.column("text"))
            count = np.bincount(rows, minlength=n)
            mean = np.bincount(rows, weights=ratios[found], minlength=n) / np.maximum(count, 1)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(mean)], names=[*kept, "evidence"])
    return run


def _scored(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    rest = rows.drop("text").schema.simpleString().removeprefix("struct<").removesuffix(">")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return rows.mapInArrow(_score(ratios), f"{fields}, evidence double") if rest else rows


def _logistic(x: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of k successes in n at x, with a weak pull of the slope to 0 on the standardised scale."""
    mean = (n * x).sum() / n.sum()
    scale = np.sqrt((n * (x - mean) ** 2).sum() / n.sum()) or 1.0
    z, beta = (x - mean) / scale, np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * z, -30, 30)))
        w = n * p * (1 - p)
        gradient = np.array([(k - n * p).sum(), ((k - n * p) * z).sum()]) - 0.5 * beta
        curve = np.array([[w.sum(), (w * z).sum()], [(w * z).sum(), (w * z * z).sum()]]) + 0.5 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] - beta[1] * mean / scale), float(beta[1] / scale)


def _strength(groups: DataFrame, center: Column) -> float:
    """Prior strength of shares k / n around `center`: method of moments over all groups, in one row.

    Var(k / n) = c (1 - c) (1 / n + (1 - 1 / n) / (1 + s)) for each group, summed with weight n.
    """
    gap, even = F.pow(F.col("k") / F.col("n") - center, 2), center * (1 - center)
    got = groups.select((F.col("n") * gap).alias("seen"), even.alias("chance"), (even * (F.col("n") - 1)).alias("room")).agg(
        F.sum("seen"), F.sum("chance"), F.sum("room")).first()
    seen, chance, room = (float(x or 0) for x in got)
    share = (seen - chance) / room if room > 0 else 0.0
    return float(np.clip(1 / share - 1, 1.0, 1e6)) if share > 0 else 1e6


def _fold(doc_id: Column) -> Column:
    """0-3 by a checksum of the id: 2 is held out, 3 calibrates, 0 and 1 train the grams."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def _drawn(marks: DataFrame, rows: int) -> DataFrame:
    """At most `rows` ids of each label, the first by a hash of the id."""
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    # Hashes are even: the first rows of a class lie within this part of them, so only those are sorted.
    within = {k: min(1.0, (rows + 8 * rows ** 0.5 + 30) / n) for k, n in counts.items()}
    near = marks.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40))).filter(
        F.col("h") <= F.when(F.col("label") == 1, within.get(1, 1.0)).otherwise(within.get(0, 1.0)) * float(1 << 40))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    return near.withColumn("place", place).filter(F.col("place") <= rows).select("doc_id", "label")


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, host_rate, path_rate, doc_score, score, keep) per row of `docs`.

    `labels` has doc_id and quality 0/1 (others are ignored; of several labels of an id the greatest counts). `host`
    and `path` are columns of `docs`; null sites are sites of their own. doc_score and score are
    probabilities without and with the site. Null and empty texts have no evidence of their own, and
    without any labels all scores are 0.5. Held-out labels are used nowhere.
    """
    docs = docs.select("doc_id", "text", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    # The drawn ids are few at every size, so they go to the texts and no text is shuffled.
    known = docs.join(F.broadcast(_drawn(marks.filter(_fold(F.col("doc_id")) < 2), rows)), "doc_id")
    counted = known.select("text", "label").mapInArrow(_count, "bucket int, low long, high long")
    table = counted.groupBy("bucket").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toArrow()
    grams = np.ones((2, BUCKETS))
    if len(table):
        grams[0, table["bucket"].to_numpy()] += table["low"].to_numpy()
        grams[1, table["bucket"].to_numpy()] += table["high"].to_numpy()
    ratios = np.log(grams[1] / grams[1].sum()) - np.log(grams[0] / grams[0].sum())

    scored = cut_lineage(_scored(docs.withColumn("fold", _fold(F.col("doc_id"))), ratios))
    marked = scored.join(marks, "doc_id").filter("fold <> 2")
    edges = marked.filter("fold = 3").agg(F.min("evidence").alias("lo"), F.max("evidence").alias("hi")).first()
    intercept, slope = 0.0, 0.0
    if edges["lo"] is not None:
        lo, width = edges["lo"], (edges["hi"] - edges["lo"]) / CELLS or 1.0
        cell = F.least(F.floor((F.col("evidence") - lo) / width), F.lit(CELLS - 1))
        cells = marked.filter("fold = 3").groupBy(cell.alias("cell")).agg(
            F.avg("evidence").alias("x"), F.count("*").alias("n"), F.sum("label").alias("k")).toArrow()
        intercept, slope = _logistic(*(cells[c].to_numpy().astype(np.float64) for c in ("x", "n", "k")))

    paths = cut_lineage(marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("label").alias("k")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    share = (float(total[1]) + 0.5) / (float(total[0]) + 1) if total[0] else 0.5
    strong = _strength(hosts, F.lit(share))
    hosts = hosts.select("host", ((F.col("k") + strong * share) / (F.col("n") + strong)).alias("host_rate"))
    joined = paths.join(hosts, "host")
    near = _strength(joined, F.col("host_rate"))
    sites = joined.select("host", "path", ((F.col("k") + near * F.col("host_rate")) / (F.col("n") + near)).alias("path_rate"))

    rows = scored.join(hosts, "host", "left").join(sites, ["host", "path"], "left")
    rows = rows.withColumn("host_rate", F.coalesce("host_rate", F.lit(share)))
    rows = rows.withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    odds = F.lit(intercept) + F.lit(slope) * F.col("evidence")
    site = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(share / (1 - share)))
    rows = rows.select("doc_id", (F.col("fold") == 2).alias("held_out"), "host_rate", "path_rate",
                       (1 / (1 + F.exp(-odds))).alias("doc_score"), (1 / (1 + F.exp(-(odds + site)))).alias("score"))
    return rows.withColumn("keep", F.col("score") >= 0.5)
