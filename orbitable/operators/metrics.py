"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.operators.ranking import running_sums, value_buckets
from orbitable.session import cut_lineage


def confusion_counts(df: DataFrame, actual: str = "y", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_table(df: DataFrame, actual: str = "y", predicted: str = "predicted") -> DataFrame:
    """Counts with row and column totals (NULL = total) and row percentages.

    A total is told from the row of a NULL label by its grouping flags, so it is matched only once.
    """
    counts = confusion_counts(df, actual, predicted)
    cube = counts.cube("actual", "predicted").agg(
        F.sum("n").alias("n"), F.grouping("actual").alias("_ga"), F.grouping("predicted").alias("_gp")
    )
    totals = cube.where("_gp = 1").select(F.col("actual").alias("_a"), F.col("_ga").alias("_g"), F.col("n").alias("total"))
    return cube.join(totals, cube["actual"].eqNullSafe(totals["_a"]) & (cube["_ga"] == totals["_g"])).select(
        "actual", "predicted", "n", (100 * F.col("n") / F.col("total")).alias("row_percent")
    )


def class_scores(counts: DataFrame) -> DataFrame:
    """Per class support, precision, recall, f1 from confusion counts; 0 on division by zero."""
    rows = counts.groupBy(F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit")
    )
    columns = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    zero = F.lit(0.0)
    both = rows.join(columns, "class", "full_outer").fillna(0, ["support", "hit", "said"])
    precision = F.coalesce(F.try_divide("hit", "said"), zero)
    recall = F.coalesce(F.try_divide("hit", "support"), zero)
    return both.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    ).select("class", "support", "hit", "precision", "recall", "f1")


def weighted_scores(df: DataFrame, actual: str = "y", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1."""
    return class_scores(confusion_counts(df, actual, predicted)).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[(F.sum(F.col("support") * F.col(c)) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
    )


def regression_scores(df: DataFrame, actual: str = "y", predicted: str = "predicted") -> DataFrame:
    """n, r2_corr, r2 (1 - SSE/SST), mae, rmsd over rows that have both values."""
    a, p = F.col(actual), F.col(predicted)
    e = a - p
    return df.where(a.isNotNull() & p.isNotNull()).agg(
        F.count("*").alias("n"),
        (F.corr(a, p) * F.corr(a, p)).alias("r2_corr"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count("*"))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmsd"),
    )


def null_log_likelihood(df: DataFrame, actual: str = "y") -> DataFrame:
    """Sum over classes of n_c ln(n_c / n)."""
    sizes = df.groupBy(actual).agg(F.count("*").alias("n"))
    return sizes.agg((F.sum(F.col("n") * F.log("n")) - F.sum("n") * F.log(F.sum("n"))).alias("ll_null"), F.sum("n").alias("n"))


def log_likelihood(df: DataFrame, probability: str) -> DataFrame:
    """Sum of ln p of the true class, p clipped to [1e-15, 1 - 1e-15]."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(probability)))
    return df.agg(F.sum(F.log(p)).alias("ll"))


def _finite(column: str):
    """The column with NaN and infinities as NULL."""
    return F.when(F.abs(F.col(column).cast("double")) < float("inf"), F.col(column).cast("double")).alias(column)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins from min to max, empty ones included; the last bin is closed: bin, low, high, n.

    NULL, NaN and infinities count as missing, here and in the two operators below.
    """
    df = df.select(_finite(column))
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    low, high = float(low), float(high)
    width = (high - low) / bins or 1.0
    which = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")
    )


def ks_distance(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Largest gap between the two empirical distribution functions.

    Running counts over distinct values are made in buckets, not in one window.
    """
    both = (
        before.select(_finite(column).alias("v"), F.lit(1).alias("b"), F.lit(0).alias("a"))
        .unionByName(after.select(_finite(column).alias("v"), F.lit(0).alias("b"), F.lit(1).alias("a")))
        .where("v IS NOT NULL")
    )
    values = cut_lineage(both.groupBy("v").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))  # read for totals, buckets and sums
    nb, na = values.agg(F.sum("b"), F.sum("a")).first()
    run = running_sums(values, [], "v", value_buckets(values, "v"), {"cb": "b", "ca": "a"})
    return run.agg(F.max(F.abs(F.col("cb") / nb - F.col("ca") / na)).alias("ks"))


def distribution_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Absolute change of mean and of population sd."""
    m0, s0 = before.select(_finite(column)).agg(F.avg(column), F.stddev_pop(column)).first()
    return after.select(_finite(column)).agg(
        F.abs(F.avg(column) - m0).alias("mean_shift"), F.abs(F.stddev_pop(column) - s0).alias("sd_shift")
    )


def cosine_matrix_gap(df: DataFrame, left: list[str], right: list[str], key: str = "id", block: int = 2048) -> DataFrame:
    """Mean |difference| of the 1 - cosine matrices of two feature sets over the same rows.

    Rows are packed into blocks; each pair of blocks is reduced to one number in its task, so no
    row pair is ever emitted.
    """
    import numpy as np
    import pyarrow as pa

    ranked = df.select(key, F.array(*[F.col(c).cast("double") for c in left]).alias("l"),
                       F.array(*[F.col(c).cast("double") for c in right]).alias("r"))
    n = ranked.count()
    n_blocks = max(1, -(-n // block))
    packed = (
        ranked.withColumn("blk", F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int"))
        .groupBy("blk").agg(F.collect_list(F.struct("l", "r")).alias("rows"))
        .select("blk", F.struct(F.flatten("rows.l").alias("l"), F.flatten("rows.r").alias("r")).alias("rows"))
    )
    # Every unordered pair of blocks is an equi-join on its own key.
    one = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    copies = packed.select("blk", "rows", one)
    first = copies.where("blk <= other").select(F.col("blk").alias("i"), F.col("other").alias("j"), F.col("rows").alias("a"))
    second = copies.where("other <= blk").select(F.col("other").alias("i"), F.col("blk").alias("j"), F.col("rows").alias("b"))
    widths = {"l": len(left), "r": len(right)}

    def units(blocks: pa.StructArray, at: int, side: str) -> np.ndarray:
        # The numbers of one block are read where Arrow keeps them; a batch never turns into Python objects.
        flat = blocks.field(side)[at].values.to_numpy(zero_copy_only=False).astype(float)  # null: NaN
        rows = flat.reshape(-1, widths[side])
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)

    def gaps(batches):
        for batch in batches:
            a, b, out = batch.column("a"), batch.column("b"), []
            same = batch.column("i").to_numpy() == batch.column("j").to_numpy()
            for k in range(len(batch)):
                total, w = 0.0, {side: units(b, k, side) for side in widths}
                u = {side: units(a, k, side) for side in widths}
                for at in range(0, len(u["l"]), 1024):
                    total += np.abs(u["l"][at: at + 1024] @ w["l"].T - u["r"][at: at + 1024] @ w["r"].T).sum()
                out.append(total if same[k] else 2 * total)
            # The sum leaves out blocks with a missing value.
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64(), from_pandas=True)], names=["total"])

    return first.join(second, ["i", "j"]).mapInArrow(gaps, "total double").agg(
        (F.sum("total") / float(n) ** 2).alias("mean_gap")
    )
