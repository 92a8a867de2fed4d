"""Lasso models of all subsets, their folds and left-out rows against plain coordinate descent."""

import itertools
import math

import numpy as np
import pytest

from orbitable.operators import diagnostics as od
from orbitable.operators import moments as mo
from orbitable.operators import metrics, sampling, thresholds
from orbitable.operators import regress as rg
from orbitable.operators import sampling as osm
from orbitable.plans import search as ps

RNG = np.random.default_rng(21)
N, NAMES, ALPHA = 40, ["a", "b", "c"], 0.3
X = RNG.normal(size=(N, 3)) * [1, 4, 0.5] + [0, 20, 1]
X[:, 2] += 0.4 * X[:, 0]
Y = 1.2 * X[:, 0] - 0.3 * X[:, 1] + RNG.normal(size=N)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(Y[i]), *map(float, X[i])) for i in range(N)], "id long, y double, a double, b double, c double").repartition(3)


def plain(x, y, alpha=ALPHA):
    """(intercept, slopes) by coordinate descent on the rows."""
    z, t, beta = x - x.mean(axis=0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(5000):
        before = beta.copy()
        for j in range(len(beta)):
            pull = z[:, j] @ (t - z @ beta + z[:, j] * beta[j]) / len(y)
            beta[j] = np.sign(pull) * max(abs(pull) - alpha, 0) / (z[:, j] @ z[:, j] / len(y))
        if np.abs(beta - before).max() < 1e-14:
            break
    return y.mean() - beta @ x.mean(axis=0), beta


def subsets():
    for k in range(1, 4):
        for i in itertools.combinations(range(3), k):
            yield "|".join(NAMES[j] for j in i), list(i)


def test_fits_equal_descent_and_the_ml_library(spark, rows):
    got = {r["combo_key"]: r for r in rg.fit_subsets(rg.combinations(spark, NAMES, 1, 3), mo.moments(rows, [*NAMES, "y"]), "y", ALPHA).collect()}
    for key, i in subsets():
        a, beta = plain(X[:, i], Y)
        assert np.allclose(got[key]["coefficients"], beta, atol=1e-9) and math.isclose(got[key]["intercept"], a, rel_tol=1e-8, abs_tol=1e-8)
        e = Y - a - X[:, i] @ beta
        assert math.isclose(got[key]["r2"], 1 - e @ e / np.sum((Y - Y.mean()) ** 2), abs_tol=1e-9)
    library = {r["term"]: r["estimate"] for r in od.lasso(rows, NAMES, "y", ALPHA).collect()}
    assert np.allclose([library[c] for c in NAMES], got["a|b|c"]["coefficients"], atol=1e-4)


def test_optimality_with_copies_and_constants():
    x = np.column_stack([X, X[:, 0], np.ones(N)])
    z, t = x - x.mean(axis=0), Y - Y.mean()
    for alpha in (0.01, 0.3, 50.0):
        beta = rg.lasso_solve((z.T @ z)[None], (z.T @ t)[None], N, alpha)[0]
        pull = z.T @ (t - z @ beta) / N
        assert beta[4] == 0 and (np.abs(pull) <= alpha + 1e-9).all()
        assert np.allclose(pull[beta != 0], alpha * np.sign(beta[beta != 0]), atol=1e-9)


def test_left_out_rows_and_folds_equal_refits(spark, rows):
    combos, sst = rg.combinations(spark, NAMES, 1, 3), np.sum((Y - Y.mean()) ** 2)
    loo = {r["combo_key"]: r for r in rg.leave_one_out(rows, combos, mo.moments(rows, [*NAMES, "y"]), "y", ALPHA).collect()}
    folds = {r["combo_key"]: r for r in rg.cross_validate(rows, combos, NAMES, "y", 4, 1, seed=5, alpha=ALPHA).collect()}
    fold = np.array([r["fold"] for r in sorted(osm.k_folds(rows, 4, seed=5).select("id", "fold").collect())])
    for key, i in subsets():
        for got, parts in ((loo[key], [np.arange(N) == k for k in range(N)]), (folds[key], [fold == f for f in range(4)])):
            e = []
            for test in parts:
                a, beta = plain(X[~test][:, i], Y[~test])
                e.append(Y[test] - a - X[test][:, i] @ beta)
            e = np.concatenate(e)
            assert np.allclose([got["q2"], got["mae"], got["rmsd"]], [1 - e @ e / sst, np.abs(e).mean(), math.sqrt(e @ e / N)], rtol=1e-7)


def test_search_ranks_lasso_models(spark, rows):
    top = ps.search_models(rows, NAMES, "y", largest=3, threshold=0.1, alpha=0.05).collect()
    assert top and all(r["q2"] is not None for r in top) and [r["q2"] for r in top] == sorted((r["q2"] for r in top), reverse=True)


def test_missing_values_in_distributions(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, math.nan, math.inf]] + [(None,)], "v double")
    assert [r["n"] for r in metrics.histogram(df, "v", 3).orderBy("bin").collect()] == [1, 1, 2]
    assert metrics.ks_distance(df, df.limit(4), "v").first()["ks"] == 0
    assert metrics.distribution_shift(df, df, "v").first()["mean_shift"] == 0


def test_weighted_draw_takes_the_smallest_keys(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(500)], "id long, w double").repartition(7)
    got = sampling.weighted_draw(df, 60, "w")
    keys = {r["id"]: r["k"] for r in df.where("w > 0").selectExpr("id", "-ln((pmod(xxhash64(id, 42), 1099511627776L) + 0.5) / 1099511627776D) / w k").collect()}
    assert {r["id"] for r in got.collect()} == set(sorted(keys, key=lambda i: (keys[i], i))[:60]) and got.columns == ["id", "w"]


def test_stumps_of_many_features(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 30, size=(80, 70)), rng.normal(size=80)
    names = [f"f{i}" for i in range(70)]
    df = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x)], ["y", *names])
    got = {r["feature"]: r for r in thresholds.decision_stumps(df, names, "y").collect()}
    positive = y >= np.median(y)
    for k, name in enumerate(names):
        best = None
        values = np.unique(x[:, k])
        for low, high in zip(values, values[1:]):
            left = x[:, k] <= low
            l1, l0 = 0.5 * (positive & left).sum() / positive.sum(), 0.5 * (~positive & left).sum() / (~positive).sum()
            gini = round(2 * l1 * l0 / (l1 + l0) + 2 * (0.5 - l1) * (0.5 - l0) / (1 - l1 - l0), 12)
            best = min(best, (gini, (low + high) / 2)) if best else (gini, (low + high) / 2)
        assert got[name]["threshold"] == best[1]
