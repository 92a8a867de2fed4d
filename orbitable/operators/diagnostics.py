"""Assumption tests, removals that keep a distribution, lasso, shuffles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orbitable.functions.distributions import chi2_upper, f_upper
from orbitable.operators.moments import complete_rows, moment_rows, moments, unpack
from orbitable.operators.ranking import lagged_pairs, numbered, value_buckets
from orbitable.operators.regress import FittedLine, _merge_moments, _rest, fit_line, permuted_target
from orbitable.operators.sampling import k_folds
from orbitable.session import cut_lineage


@F.pandas_udf(DoubleType())
def _log_normal_cdf(z: pd.Series) -> pd.Series:
    root = math.sqrt(2)
    return z.map(lambda x: math.log(max(0.5 * math.erfc(-x / root), 1e-300)))


def _aux(rows: DataFrame, features: Sequence[str], target: str) -> FittedLine:
    return FittedLine(moments(rows, [*features, target]), features, target)


def _anderson_p(ad: float, n: int) -> float:
    a = ad * (1 + 0.75 / n + 2.25 / n**2)
    # Approximation of the p value (D'Agostino and Stephens).
    if a < 0.2:
        return 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a**2)
    if a < 0.34:
        return 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a**2)
    if a < 0.6:
        return math.exp(0.9177 - 4.279 * a - 1.38 * a**2)
    return math.exp(1.2937 - 5.709 * a + 0.0186 * a**2) if a <= 13 else 0.0


def assumption_tests(rows: DataFrame, features: Sequence[str], target: str, order: str = "id") -> DataFrame:
    """test, statistic, p (M24). Row order, where a test needs one, is the order of `order`.

    Each test is an auxiliary regression or an aggregate over the rows; lags are an equi-join on
    the row position.
    """
    features = list(features)
    spark, p = rows.sparkSession, len(features)
    base = complete_rows(rows, [*features, target])
    model = fit_line(base, features, target)
    n = model.n
    base = base.withColumn("_e", F.col(target) - model.prediction()).withColumn("_f", model.prediction())
    base = cut_lineage(
        numbered(base, [], [order], value_buckets(base, order), "_pos").select(*features, target, "_e", "_f", "_pos")
    )
    e2 = base.withColumn("_e2", F.col("_e") * F.col("_e"))
    out: list[tuple] = []

    # Powers of the fit; scaled, as only the span matters.
    spread = float(np.sqrt(model.sst / n)) or 1.0
    reset = _aux(base.withColumn("_f2", F.pow((F.col("_f") - model.mean_y) / spread, F.lit(2.0))), [*features, "_f2"], target)
    f = (model.sse - reset.sse) / (reset.sse / reset.df)
    out.append(("reset_f", f, f_upper(f, 1, reset.df)))

    low = math.ceil(0.25 * n)
    mid = base.where((F.col("_pos") > low) & (F.col("_pos") <= math.floor(low + 0.5 * n)))
    inner = _aux(mid, features, target)
    f = ((model.sse - inner.sse) / (n - inner.n)) / (inner.sse / inner.df)
    out.append(("rainbow_f", f, f_upper(f, n - inner.n, inner.df)))

    s, k = base.agg(F.skewness("_e"), F.kurtosis("_e")).first()
    jb = n / 6 * (s * s + k * k / 4)
    out.append(("jarque_bera", jb, chi2_upper(jb, 2)))

    bp = _aux(e2, features, "_e2")
    out.append(("breusch_pagan_lm", n * bp.r2, chi2_upper(n * bp.r2, p)))
    f = (bp.r2 / p) / ((1 - bp.r2) / bp.df)
    out.append(("breusch_pagan_f", f, f_upper(f, p, bp.df)))

    terms, names = {}, list(features)
    sd = moments(base, features).sd()
    z = {c: (F.col(c) - float(mu)) / (float(w) or 1.0) for c, mu, w in zip(features, model.mean, sd)}
    for i in range(p):
        for j in range(i, p):
            terms[f"_q{i}_{j}"] = z[features[i]] * z[features[j]]
    names += list(terms)
    white = _aux(e2.withColumns(terms), names, "_e2")
    out.append(("white_lm", n * white.r2, chi2_upper(n * white.r2, len(names))))

    half = n // 2
    first, second = (_aux(base.where(c), features, target) for c in (F.col("_pos") <= half, F.col("_pos") > half))
    f = (second.sse / second.df) / (first.sse / first.df)
    upper = f_upper(f, second.df, first.df)
    out.append(("goldfeld_quandt_f", f, 2 * min(upper, 1 - upper)))

    lagged = lagged_pairs(base.select("_pos", "_e", *features), "_pos", [1, 2, 3, 4, 5], ["_e"])
    row = lagged.agg(
        F.sum(F.pow(F.col("_e") - F.col("_e_lag1"), F.lit(2.0))).alias("d"), F.sum(F.col("_e") * F.col("_e")).alias("s"),
        *[F.sum(F.col("_e") * F.col(f"_e_lag{k}")).alias(f"r{k}") for k in range(1, 6)],
    ).first()
    out.append(("durbin_watson", row["d"] / row["s"], None))
    q = n * (n + 2) * sum((row[f"r{k}"] / row["s"]) ** 2 / (n - k) for k in range(1, 6))
    out.append(("ljung_box_5", q, chi2_upper(q, 5)))
    bg = _aux(lagged.fillna(0.0, ["_e_lag1"]), [*features, "_e_lag1"], "_e")
    out.append(("breusch_godfrey_lm", n * bg.r2, chi2_upper(n * bg.r2, 1)))

    m = moments(base, features)
    gram = np.zeros((p + 1, p + 1))
    gram[0, 0], gram[0, 1:], gram[1:, 0] = n, n * m.mean, n * m.mean
    gram[1:, 1:] = m.cross + n * np.outer(m.mean, m.mean)
    out.append(("condition_number", float(np.linalg.cond(gram)), None))

    scale = float(np.sqrt(model.sse / (n - 1)))
    placed = numbered(base.select("_e", "_pos"), [], ["_e", "_pos"], value_buckets(base, "_e"), "_i")
    z1 = F.col("_e") / scale
    ad = placed.agg(
        F.sum((2 * F.col("_i") - 1) * _log_normal_cdf(z1) + (2 * (n - F.col("_i")) + 1) * _log_normal_cdf(-z1)).alias("s")
    ).first()["s"]
    ad = -n - ad / n
    out.append(("anderson_darling", ad, _anderson_p(ad, n)))
    return spark.createDataFrame([(a, float(b), None if c is None else float(c)) for a, b, c in out], "test string, statistic double, p double")


def removals(rows: DataFrame, target: str, n: int, metric: str = "mean", key: str = "id") -> DataFrame:
    """Greedy removal of n rows that disturbs the distribution least (M27): step, key, value, loss.

    Each step scores every remaining row from a few totals and takes the best with a top-1, the
    lowest key on ties. metric: mean, sd or ks.
    """
    left = rows.select(key, F.col(target).cast("double").alias("v")).where("v IS NOT NULL")
    origin = left.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2")).first()
    n0, m0, s0 = origin["n"], origin["m"], math.sqrt(origin["s2"])
    gone: list[tuple] = []
    taken = None
    for step in range(1, n + 1):
        now = left if taken is None else left.join(F.broadcast(taken), key, "left_anti")  # at most n rows
        if metric == "ks":
            best = _ks_step(left, now, n0, key)
        else:
            t = now.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2")).first()
            c, d = t["n"], F.col("v") - t["m"]
            mean = t["m"] - d / (c - 1)
            var = (t["s2"] * c - d * d * c / (c - 1)) / (c - 1)
            loss = F.abs(mean - m0) if metric == "mean" else F.abs(F.sqrt(F.greatest(var, F.lit(0.0))) - s0)
            best = now.select(key, "v", F.round(loss, 9).alias("loss")).orderBy("loss", key).first()
        gone.append((step, best[key], best["v"], best["loss"]))
        kind = dict(rows.dtypes)[key]
        taken = rows.sparkSession.createDataFrame([(g[1],) for g in gone], f"`{key}` {kind}")
    kind = dict(rows.dtypes)[key]
    return rows.sparkSession.createDataFrame(gone, f"step int, `{key}` {kind}, value double, loss double")


def _ks_step(origin: DataFrame, now: DataFrame, n0: int, key: str):
    """Best single removal for the KS distance.

    Removing value v lowers the count by one at and above v, so its distance is the larger of a
    maximum over smaller values and one over the rest. Both come per bucket first, and only the
    bucket maxima are combined in order.
    """
    from pyspark.sql import Window as W

    counts = origin.groupBy("v").agg(F.count("*").alias("a")).join(
        now.groupBy("v").agg(F.count("*").alias("b"), F.min(key).alias("k")), "v", "left").fillna(0, ["b"])
    from orbitable.operators.ranking import running_sums

    m = now.count()
    bucket = value_buckets(counts, "v")
    run = running_sums(counts, [], "v", bucket, {"ca": "a", "cb": "b"})
    run = run.withColumns({
        "keep": F.abs(F.col("ca") / n0 - F.col("cb") / (m - 1)), "less": F.abs(F.col("ca") / n0 - (F.col("cb") - 1) / (m - 1)), "g": bucket})
    by = run.groupBy("g").agg(F.max("keep").alias("mk"), F.max("less").alias("ml"))
    order = W.orderBy("g")  # one row per bucket
    edge = by.select("g", F.max("mk").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
                     F.max("ml").over(order.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    inside = W.partitionBy("g").orderBy("v")
    full = run.withColumns({
        "b0": F.max("keep").over(inside.rowsBetween(W.unboundedPreceding, -1)), "a0": F.max("less").over(inside.rowsBetween(0, W.unboundedFollowing))
    }).join(edge, "g")
    zero = F.lit(0.0)
    loss = F.greatest(*[F.coalesce(F.col(c), zero) for c in ("b0", "before", "a0", "after")])
    return full.where("b > 0").select(F.col("k").alias(key), "v", F.round(loss, 9).alias("loss")).orderBy("loss", key).first()


def lasso(rows: DataFrame, features: Sequence[str], target: str, alpha: float) -> DataFrame:
    """L1 coefficients for the objective SSE / (2n) + alpha * |w| (M12): term, estimate."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(complete_rows(rows, [*features, target]))
    fit = LinearRegression(
        featuresCol="_x", labelCol=target, regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-10
    ).fit(data)
    table = [("intercept", float(fit.intercept))] + [(c, float(b)) for c, b in zip(features, fit.coefficients)]
    return rows.sparkSession.createDataFrame(table, "term string, estimate double")


def feature_shuffles(
    rows: DataFrame, features: Sequence[str], target: str, runs: int = 10, k: int = 5, key: str = "id", seed: int = 0
) -> DataFrame:
    """Held-out q2 with one feature permuted, per feature and run; feature NULL is the intact model."""
    base = k_folds(complete_rows(rows, [*features, target]), k, key, seed + 7, "fold").select(key, "fold", *features, target)
    base = cut_lineage(base)
    spark, out = rows.sparkSession, []

    def held_out(parts, names):
        total, sse = _merge_moments(parts), 0.0
        t = total.at([target])[0]
        for part in parts:
            fit = FittedLine(_rest(total, part), names, target)
            i = part.at(names)
            inside = part.cross[t, t] - 2 * fit.beta @ part.cross[i, t] + fit.beta @ part.cross[np.ix_(i, i)] @ fit.beta
            sse += max(float(inside), 0.0) + part.n * float(part.mean[t] - fit.intercept - fit.beta @ part.mean[i]) ** 2
        return 1 - sse / float(total.cross[t, t])

    cols = [*features, target]
    out.append((None, 0, held_out([unpack(r, cols) for r in moment_rows(base, cols, ["fold"]).collect()], list(features))))
    for f in features:
        names = [c if c != f else "y_perm" for c in features]
        cols = [*names, target]
        table: dict = {}
        for r in moment_rows(permuted_target(base, f, runs, key, seed), cols, ["run", "fold"]).collect():
            table.setdefault(r["run"], []).append(unpack(r, cols))
        out += [(f, int(run), held_out(parts, names)) for run, parts in sorted(table.items())]
    return spark.createDataFrame(out, "feature string, run int, q2 double")
