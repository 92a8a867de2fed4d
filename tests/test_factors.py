"""Models with factors of many levels against the same models on dense indicator columns."""

import math

import numpy as np
import pytest

from orbitable.operators import factors as fa

RNG = np.random.default_rng(5)


def table(spark, **columns):
    names = list(columns)
    types = {np.dtype("int64"): "long", np.dtype("float64"): "double"}
    schema = ", ".join(f"{c} {types[columns[c].dtype]}" for c in names)
    return spark.createDataFrame(list(zip(*[v.tolist() for v in columns.values()])), schema).repartition(5)


def indicators(level):
    return (level[:, None] == np.unique(level)[None, :]).astype(float)


def softmax_fit(z, code, k, ridge, full):
    """Newton on the dense design; the first column is the intercept, without penalty."""
    theta, c = np.zeros((k if full else k - 1, z.shape[1])), np.eye(k)[code]
    first = 0 if full else 1
    weights = np.tile(np.concatenate([[0.0], np.full(z.shape[1] - 1, ridge)]), len(theta))
    for _ in range(60):
        e = z @ theta.T
        e = e if full else np.hstack([np.zeros((len(z), 1)), e])
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True))[:, first:]
        grad = ((c[:, first:] - p).T @ z).ravel() - weights * theta.ravel()
        hess = np.block([[(z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z for b in range(len(theta))] for a in range(len(theta))])
        step = np.linalg.pinv(hess + np.diag(weights), rcond=1e-12, hermitian=True) @ grad
        theta = theta + step.reshape(theta.shape)
        if np.abs(step).max() < 1e-10:
            break
    return theta


def test_linear_with_5000_levels_equals_dense(spark):
    n, g = 8000, 5000
    level = np.concatenate([np.arange(g), np.zeros(1500, int), RNG.integers(0, g, n - g - 1500)])
    x, w = RNG.normal(size=n) + 100, RNG.normal(size=n)
    kind = RNG.integers(0, 3, n)
    y = 2 * x - w + np.sin(level) + 0.5 * kind + 0.1 * RNG.normal(size=n)
    rows = table(spark, x=x, w=w, level=level, kind=kind, copy=2 * x + 1, fixed=np.cos(level), y=y)
    fit = fa.factor_regression(rows, ["x", "w", "copy", "fixed"], ["kind", "level"], "y")
    got = {(r["term"], r["level"]): r["estimate"] for r in fit.terms.collect()}
    design = np.column_stack([np.ones(n), x, w, indicators(kind)[:, 1:], indicators(level)[:, 1:]])
    want = np.linalg.solve(design.T @ design, design.T @ y)
    assert len(got) == 1 + 2 + 2 + g - 1 and ("copy", None) not in got and ("fixed", None) not in got
    assert math.isclose(got["intercept", None], want[0], abs_tol=1e-5)
    assert np.allclose([got["x", None], got["w", None], got["kind_1", None], got["kind_2", None]], want[1:5], atol=1e-7)
    assert np.allclose([got["level", str(i)] for i in range(1, g)], want[5:], atol=1e-6)
    left = y - design @ want
    assert math.isclose(fit.figures["r2"], 1 - left @ left / np.sum((y - y.mean()) ** 2), abs_tol=1e-9) and fit.n == n


def test_missing_levels_numbers_and_fractions(spark):
    rows = spark.createDataFrame([(1.0, 2.5, 1.0), (2.0, 2.5, 3.0), (1.0, None, 7.0), (2.0, None, 9.0), (1.0, 4.0, 0.0), (None, 4.0, 5.0), (2.0, 4.0, float("nan"))],
                                 "x double, g double, y double")
    fit = fa.factor_regression(rows, ["x"], ["g"], "y")
    got = {(r["term"], r["level"]): round(r["estimate"], 9) for r in fit.terms.collect()}
    assert fit.n == 5 and got == {("intercept", None): -1.0, ("x", None): 2.0, ("g", "4"): -1.0, ("g", None): 6.0}


@pytest.mark.parametrize("k", [2, 3])
def test_classes_equal_dense_newton(spark, k):
    n, g = 600, 40
    level, x = RNG.integers(0, g, n) * (RNG.random(n) > 0.3), RNG.normal(size=n)
    code = np.clip((x + np.cos(level) + RNG.normal(size=n) > 0).astype(int) + (RNG.random(n) > 0.6) * (k - 2), 0, k - 1)
    fit = fa.factor_classifier(table(spark, x=x, level=level, y=code), ["x"], ["level"], "y")
    got = {(r["class"], r["term"], r["level"]): r["estimate"] for r in fit.terms.collect()}
    found = np.unique(level)
    z = np.column_stack([np.ones(n), x, indicators(level)])
    theta = softmax_fit(z, code, k, 1.0, k > 2)
    named = [str(c) for c in range(k)] if k > 2 else ["1"]
    for c, want in zip(named, theta):
        mine = np.array([got[c, "x", None], *[got[c, "level", str(i)] for i in found]])
        assert np.allclose(mine, want[1:], atol=1e-6)
    assert fit.converged
    p = z @ theta.T
    said = p.argmax(axis=1) if k > 2 else (p[:, 0] > 0).astype(int)
    assert math.isclose(fit.figures["accuracy"], (said == code).mean(), abs_tol=1e-9)
    plain = softmax_fit(z, code, k, 1e-6, k > 2)
    e = z @ plain.T if k > 2 else np.hstack([np.zeros((n, 1)), z @ plain.T])
    ll = (e[np.arange(n), code] - np.log(np.exp(e).sum(axis=1))).sum()
    share = np.bincount(code) / n
    assert math.isclose(fit.figures["mcfadden_r2"], 1 - ll / (n * share @ np.log(share)), abs_tol=1e-5)


def test_classes_with_5000_levels_meet_the_optimum(spark):
    n, g = 9000, 5000
    level, x = np.concatenate([np.arange(g), np.zeros(3000, int), RNG.integers(0, g, n - g - 3000)]), RNG.normal(size=n)
    code = (x + np.cos(level) + RNG.normal(size=n) > 0).astype(int)
    model = fa._Classifier(table(spark, x=x, level=level, y=code), ["x"], ["level"], "y")
    theta, levels, _, done = model.fit(1.0)
    got = {(r["term"], r["level"]): r["estimate"] for r in model.terms(theta, levels).collect()}
    own = np.array([got["level", str(i)] for i in range(g)])
    pull = code - 1 / (1 + np.exp(-(got["intercept", None] + got["x", None] * x + own[level])))
    assert done and abs(pull.sum()) < 1e-6 and abs(pull @ x - got["x", None]) < 1e-6
    assert np.abs(np.bincount(level, weights=pull) - own).max() < 1e-6


def test_whole_number_columns_enter_as_factors(spark):
    rows = table(spark, a=RNG.normal(size=50), b=RNG.integers(0, 4, 50).astype(float), y=RNG.normal(size=50))
    fit = fa.fit_columns(rows, ["a", "b"], "y")
    assert {r["term"] for r in fit.terms.collect()} == {"intercept", "a", "b"} and fa.fit_columns(rows, ["a"], "y") is None


def test_a_step_sends_one_sum_per_level(spark, monkeypatch):
    n, g = 20_000, 50
    level, x = np.arange(n) % g, RNG.normal(size=n)
    rows = table(spark, x=x, level=level, y=(x + RNG.normal(size=n) > 0).astype(int))
    whole, sent = fa.summed_into, []
    monkeypatch.setattr(fa, "summed_into", lambda models, parts, key, *rest: (key == "key" and sent.append(parts.count())) or whole(models, parts, key, *rest))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        fit = fa.factor_classifier(rows, ["x"], ["level"], "y")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert fit.converged and fit.n == n and max(sent) <= 2 * g


def test_equal_rows_of_indicators_are_one(spark):
    n, g = 6000, 20
    level, kind = RNG.integers(0, g, n), RNG.integers(0, 2, n)
    code = (RNG.random(n) < (level + 1) / (g + 2)).astype(int) + kind * (RNG.random(n) < 0.2)
    rows = table(spark, level=level, kind=kind, y=code)
    model = fa._Classifier(rows, [], ["level", "kind"], "y")
    assert model.rows.agg({"size": "sum"}).first()[0] <= g * 2 * 3 and model.n == n
    plain = fa.factor_classifier(rows, [], ["level"], "y")
    counts = np.array([np.bincount(code[level == i], minlength=3) for i in range(g)])
    part = lambda c: (c[c > 0] * np.log(np.broadcast_to(c.sum(-1, keepdims=True), c.shape)[c > 0] / c[c > 0])).sum()
    assert plain.n == n and math.isclose(plain.figures["mcfadden_r2"], 1 - part(counts) / part(counts.sum(axis=0)), abs_tol=1e-6)
