"""Classifier searches against plain Newton fits."""

import itertools
import math

import numpy as np
import pytest

from orbitable.operators import blocks
from orbitable.operators import classify as oc
from orbitable.operators import moments as mo
from orbitable.operators import regress as rg
from orbitable.operators import sampling as osm
from orbitable.plans import search as ps

RNG = np.random.default_rng(5)
N, NAMES = 120, ["a", "b", "c"]
X = RNG.normal(size=(N, 3)) * [1, 3, 0.2] + [0, 10, 1]
SCORE = X[:, 0] + 0.3 * (X[:, 1] - 10) + RNG.normal(size=N)
TWO, THREE = (SCORE > 0).astype(int), np.digitize(SCORE, [-0.8, 0.9])


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, int(TWO[i]), int(THREE[i]), *map(float, X[i])) for i in range(N)]
    return spark.createDataFrame(data, "id long, two int, three int, a double, b double, c double").repartition(3)


def softmax(z):
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def plain_fit(x, y, k, ridge):
    """Weights (classes, 1 + features): maximum likelihood with class 0 at zero, or penalised with weights for every class (for the second of two)."""
    z, hit = np.column_stack([np.ones(len(x)), x]), np.eye(k)[y]
    first = 0 if ridge and k > 2 else 1
    theta = np.zeros((k, z.shape[1]))
    weights = np.r_[0, np.full(x.shape[1], ridge)]
    for _ in range(200):
        p = softmax(z @ theta.T)
        grad = ((hit - p).T @ z - weights * theta)[first:].ravel()
        hess = sum(np.kron(np.diag(q[first:]) - np.outer(q[first:], q[first:]), np.outer(r, r)) for q, r in zip(p, z))
        step = np.linalg.pinv(hess + np.diag(np.tile(weights, k - first))) @ grad
        theta[first:] += step.reshape(k - first, -1) * min(1, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-11:
            break
    return theta


def plain_scores(theta, x, y, k):
    p = softmax(np.column_stack([np.ones(len(x)), x]) @ theta.T)
    said = p.argmax(axis=1)
    ll = np.log(np.clip(p[np.arange(len(y)), y], 1e-15, 1 - 1e-15)).sum()
    share = np.bincount(y, minlength=k) / len(y)
    null = len(y) * (share[share > 0] * np.log(share[share > 0])).sum()
    f1 = [2 * ((said == c) & (y == c)).sum() / max(1, (said == c).sum() + (y == c).sum()) for c in range(k)]
    return (said == y).mean(), float(np.dot(share, f1)), None if (share > 0).sum() < 2 else 1 - ll / null


def subsets(largest):
    for k in range(1, largest + 1):
        for i in itertools.combinations(range(3), k):
            yield "|".join(NAMES[j] for j in i), list(i)


@pytest.mark.parametrize("target, y, cells", [("two", TWO, (1 << 16, 1 << 27)), ("three", THREE, (3, 200))])
def test_fits_of_all_subsets(spark, rows, monkeypatch, target, y, cells):
    monkeypatch.setattr(blocks, "MODEL_BLOCK", cells[0])
    monkeypatch.setattr(blocks, "GROUP_VALUES", cells[1])
    k = int(y.max()) + 1
    got = {r["combo_key"]: r for r in oc.fit_classifiers(rows, rg.combinations(spark, NAMES, 1, 3), NAMES, target).collect()}
    assert set(got) == {key for key, _ in subsets(3)}
    for key, i in subsets(3):
        accuracy, f1, _ = plain_scores(plain_fit(X[:, i], y, k, 1.0), X[:, i], y, k)
        r2 = plain_scores(plain_fit(X[:, i], y, k, 0.0), X[:, i], y, k)[2]
        r = got[key]
        assert r["converged"] and math.isclose(r["accuracy"], accuracy) and math.isclose(r["f1_score"], f1) and math.isclose(r["mcfadden_r2"], r2, rel_tol=1e-7)


def test_cross_validation_equals_refits(spark, rows):
    folded = osm.k_folds(rows, 4, seed=9)
    fold = np.array([r["fold"] for r in sorted(folded.select("id", "fold").collect())])
    got = {r["combo_key"]: r for r in oc.cross_validate_classifiers(folded, rg.combinations(spark, NAMES, 1, 2), NAMES, "two").collect()}
    for key, i in subsets(2):
        each = [plain_scores(plain_fit(X[fold != f][:, i], TWO[fold != f], 2, 1.0), X[fold == f][:, i], TWO[fold == f], 2) for f in range(4)]
        r = got[key]
        assert r["cv_converged"] and np.allclose([r["avg_accuracy"], r["avg_f1_score"], r["avg_mcfadden_r2"]], np.mean(np.array(each, float), axis=0), rtol=1e-6)


def test_repeats_and_their_means(spark, rows):
    got = oc.repeated_classifier_cv(rows, rg.combinations(spark, NAMES, 1, 1).limit(1), NAMES, "two", 2, 3).collect()
    each = [r["avg_accuracy"] for r in got if r["iteration"]]
    mean = [r["avg_accuracy"] for r in got if r["iteration"] is None]
    assert len(each) == 2 and math.isclose(mean[0], sum(each) / 2)
    first = oc.cross_validate_classifiers(osm.k_folds(rows, 3, seed=42), rg.combinations(spark, NAMES, 1, 1).limit(1), NAMES, "two").first()
    assert first["avg_accuracy"] in each


def test_dependent_columns_leave_the_plain_fit(spark, rows):
    """Constant, copied, scaled and combined columns: McFadden R2 is that of the independent ones, in their order."""
    wide = rows.selectExpr("*", "1.0D one", "a a2", "3 * b - 7 b3", "a + b ab", "a + 1e-13 * c near")
    names = [*NAMES, "one", "a2", "b3", "ab", "near"]
    combos = spark.createDataFrame([("all", ["one", "a", "a2", "near", "b3", "b", "ab"]), ("one", ["one"]), ("ab", ["a", "b"])],
                                   "combo_key string, combo array<string>")
    got = {r["combo_key"]: r for r in oc.fit_classifiers(wide, combos, names, "two").collect()}
    assert math.isclose(got["all"]["mcfadden_r2"], plain_scores(plain_fit(X[:, :2], TWO, 2, 0.0), X[:, :2], TWO, 2)[2], rel_tol=1e-6)
    assert abs(got["one"]["mcfadden_r2"]) < 1e-9 and all(r["converged"] for r in got.values())
    fitter = oc.LogisticFitter(wide, names, "two")
    assert fitter.fit([oc.Job("all", ["one", "a", "a2", "near", "b3", "b", "ab"])])[0].used == ["a", "b3"]


def test_independent_against_rank():
    rng = np.random.default_rng(1)
    for _ in range(50):
        base = rng.normal(size=(200, 6))
        x = np.column_stack([base, base @ rng.normal(size=(6, 4)), np.ones(200), base[:, 2]])[:, rng.permutation(12)]
        d = x - x.mean(axis=0)
        sd = np.sqrt((d * d).sum(axis=0))
        with np.errstate(invalid="ignore"):
            corr = d.T @ d / np.outer(sd, sd)
        corr[sd < 1e-9] = corr[:, sd < 1e-9] = np.nan
        kept = mo.independent(corr, list(range(12)))
        assert len(kept) == 6
        for j in range(12):  # a column goes exactly when the kept ones before it explain it
            before = [i for i in kept if i < j]
            rank = np.linalg.matrix_rank(d[:, [*before, j]], tol=1e-6)
            assert (j in kept) == (rank == len(before) + 1)


def test_lower_gate_validates_stored_fits(spark, rows, tmp_path):
    store = str(tmp_path / "fits")
    high = ps.search_classifiers(rows, NAMES, "two", threshold=0.9, folds=3, store=store).collect()
    assert high and all(r["avg_accuracy"] is None for r in high)
    low = ps.search_classifiers(rows, NAMES, "two", threshold=0.0, folds=3, store=store).collect()
    direct = ps.search_classifiers(rows, NAMES, "two", threshold=0.0, folds=3).collect()
    assert all(r["avg_accuracy"] is not None for r in low if r["mcfadden_r2"] > 0)
    assert [(r["combo_key"], r["avg_accuracy"]) for r in low] == [(r["combo_key"], r["avg_accuracy"]) for r in direct]


def test_unfinished_fits_are_flagged(spark, rows, monkeypatch):
    monkeypatch.setattr(oc, "PASS_LIMIT", 2)
    folded = osm.k_folds(rows, 3, seed=1)
    combos = rg.combinations(spark, NAMES, 1, 1)
    assert not any(r["converged"] for r in oc.fit_classifiers(rows, combos, NAMES, "two").collect())
    assert not any(r["cv_converged"] for r in oc.cross_validate_classifiers(folded, combos, NAMES, "two").collect())
