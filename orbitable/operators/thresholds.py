"""One-feature threshold rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitable.operators.ranking import bucket_count, running_sums


def _long(rows: DataFrame, features: Sequence[str], y) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features]
    return rows.select(y.alias("y"), F.inline(F.array(*cells))).where("x IS NOT NULL AND y IS NOT NULL")


def threshold_scan(rows: DataFrame, features: Sequence[str], target: str, steps: int = 100) -> DataFrame:
    """Best F1 over evenly spaced thresholds per feature, x > t or x < t predicting class 1.

    feature, threshold, direction, accuracy, f1; ties take the lower threshold, then `greater`.
    A row is counted once in the slot between two thresholds; running sums over the at most
    2 * steps + 1 slots then give every threshold's confusion counts.
    """
    low_high = rows.agg(*[F.min(c).cast("double").alias(f"l{i}") for i, c in enumerate(features)],
                        *[F.max(c).cast("double").alias(f"h{i}") for i, c in enumerate(features)]).first()
    low = F.create_map(*[F.lit(v) for i, c in enumerate(features) for v in (c, low_high[f"l{i}"])])[F.col("feature")]
    gap = F.create_map(*[F.lit(v) for i, c in enumerate(features) for v in (c, (low_high[f"h{i}"] - low_high[f"l{i}"]) / (steps - 1))])[F.col("feature")]
    long = _long(rows, features, F.col(target)).withColumns({"low": low, "gap": gap})
    guess = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("low"), F.col("gap"))), F.lit(0))))
    at = lambda k: F.col("low") + k * F.col("gap")
    long = long.withColumn("g", guess)
    # Number of thresholds below x and at or below x; the guess is off by at most one.
    inside = lambda k: (k >= 0) & (k < steps)
    near = [F.col("g") + d for d in (-1, 0, 1)]
    base = F.greatest(F.lit(0), F.col("g") - 1)
    below = base + sum(((inside(k) & (at(k) < F.col("x"))).cast("int") for k in near), F.lit(0))
    upto = base + sum(((inside(k) & (at(k) <= F.col("x"))).cast("int") for k in near), F.lit(0))
    slots = long.groupBy("feature", "low", "gap", below.alias("below"), upto.alias("upto")).agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("pos")
    )
    # x > t_k for all k < below; x < t_k for all k >= upto.
    totals = slots.groupBy("feature").agg(F.sum("n").alias("all"), F.sum("pos").alias("allpos"))
    turn = lambda name, alias: slots.groupBy("feature", "low", "gap", F.col(name).alias("k")).agg(
        F.sum("n").alias(f"n_{alias}"), F.sum("pos").alias(f"p_{alias}")
    )
    grid = slots.select("feature", "low", "gap").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    both = grid.join(turn("below", "b"), ["feature", "low", "gap", "k"], "left").join(
        turn("upto", "u"), ["feature", "low", "gap", "k"], "left"
    ).fillna(0)
    upwards = W.partitionBy("feature").orderBy("k")  # steps + 1 rows per feature
    so_far = upwards.rowsBetween(W.unboundedPreceding, W.currentRow)
    run = both.select(
        "feature", "low", "gap", "k", *[F.sum(c).over(so_far).alias(c) for c in ("n_b", "p_b", "n_u", "p_u")]
    ).where(F.col("k") < steps).join(totals, "feature")
    # rows with below <= k are not greater than t_k; rows with upto <= k are less than t_k.
    sides = F.array(
        F.struct(F.lit("greater").alias("direction"), F.lit(0).alias("o"), (F.col("allpos") - F.col("p_b")).alias("tp"), (F.col("all") - F.col("n_b")).alias("said")),
        F.struct(F.lit("less").alias("direction"), F.lit(1).alias("o"), F.col("p_u").alias("tp"), F.col("n_u").alias("said")),
    )
    each = run.select("feature", "low", "gap", "k", "all", "allpos", F.inline(sides))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("allpos")), F.lit(0.0))
    right = F.col("all") - F.col("said") - F.col("allpos") + 2 * F.col("tp")
    scored = each.withColumns({"f1": F.round(f1, 12), "accuracy": right / F.col("all")})
    best = F.max(F.struct("f1", (-F.col("k")).alias("k"), (-F.col("o")).alias("o"), "direction", "accuracy", "low", "gap"))
    return (
        scored.groupBy("feature").agg(best.alias("b"))
        .select("feature", (F.col("b.low") - F.col("b.k") * F.col("b.gap")).alias("threshold"), "b.direction", "b.accuracy", "b.f1")
        .orderBy(F.desc("f1"), "feature")
    )


def binary_cut(rows: DataFrame, target: str, cutoff="median"):
    """Cut value of a numeric target by 'median', 'mean', ('percentile', p, ...) or a number."""
    if cutoff == "mean":
        return float(rows.agg(F.avg(target)).first()[0])
    if cutoff == "median":
        return float(rows.agg(F.percentile(target, 0.5)).first()[0])
    if isinstance(cutoff, tuple):
        return float(rows.agg(F.percentile(target, cutoff[1] / 100)).first()[0])
    if 0 <= cutoff <= 100:
        return float(rows.agg(F.percentile(target, cutoff / 100)).first()[0])
    return float(cutoff)


def decision_stumps(rows: DataFrame, features: Sequence[str], target: str, cutoff="median", low_is_positive: bool = False) -> DataFrame:
    """Class-balanced one-split Gini tree per feature (M21): feature, threshold, accuracy, f1, recall.

    Counts per distinct value are summed along the value order in buckets, never in one window.
    """
    cut = binary_cut(rows, target, cutoff)
    positive = (F.col(target) <= cut) if low_is_positive else (F.col(target) >= cut)
    long = _long(rows, features, positive.cast("int"))
    values = long.groupBy("feature", "x").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    totals = values.groupBy("feature").agg(F.sum("n").alias("all"), F.sum("pos").alias("allpos"), F.count("*").alias("values"))
    # Buckets of about equal size per feature; the quantiles travel with the rows, one array per feature.
    n = bucket_count(rows)
    cuts = values.groupBy("feature").agg(
        F.array_distinct(F.percentile_approx("x", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(1000))).alias("cuts"))
    placed = values.join(cuts, "feature").withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    run = running_sums(placed, ["feature"], "x", F.col("b"), {"ln": "n", "lp": "pos"}).where("next_x IS NOT NULL")
    side = run.join(totals, "feature").where((F.col("allpos") > 0) & (F.col("allpos") < F.col("all")))
    # Balanced weights: each class weighs one half in total.
    wp, wn = 0.5 / F.col("allpos"), 0.5 / (F.col("all") - F.col("allpos"))
    side = side.withColumns({"l1": F.col("lp") * wp, "l0": (F.col("ln") - F.col("lp")) * wn})
    side = side.withColumns({"r1": 0.5 - F.col("l1"), "r0": 0.5 - F.col("l0")})
    gini = lambda a, b: F.coalesce(F.try_divide(2 * F.col(a) * F.col(b), F.col(a) + F.col(b)), F.lit(0.0))
    side = side.withColumn("impurity", F.round(gini("l1", "l0") + gini("r1", "r0"), 12)).withColumn(
        "threshold", (F.col("x") + F.col("next_x")) / 2
    )
    best = F.min(F.struct("impurity", "threshold", "l1", "l0", "lp", "ln", "all", "allpos"))
    top = side.groupBy("feature").agg(best.alias("b")).select("feature", "b.*")
    left_positive = F.col("l1") > F.col("l0")
    tp = F.when(left_positive, F.col("lp")).otherwise(F.col("allpos") - F.col("lp"))
    said = F.when(left_positive, F.col("ln")).otherwise(F.col("all") - F.col("ln"))
    top = top.withColumns({"tp": tp, "said": said})
    return top.select(
        "feature",
        "threshold",
        ((F.col("all") - F.col("said") - F.col("allpos") + 2 * F.col("tp")) / F.col("all")).alias("accuracy"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("allpos")), F.lit(0.0)).alias("f1"),
        (F.col("tp") / F.col("allpos")).alias("recall"),
    )
