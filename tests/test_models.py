"""Models against explicit refits, distribution tails against known values."""

import math
import random

import numpy as np
import pytest

from orbitable.functions import distributions as ds
from orbitable.operators import classify as oc
from orbitable.operators import clean
from orbitable.operators import diagnostics as od
from orbitable.operators import metrics as om
from orbitable.operators import moments as mo
from orbitable.operators import regress as rg
from orbitable.operators import sampling as osm
from orbitable.operators import thresholds as oth
from orbitable.operators.ranking import numbered, running_sums, value_buckets
from orbitable.plans import search as ps

N = 40
RNG = np.random.default_rng(7)
X = RNG.normal(size=(N, 3))
Y = 1.5 * X[:, 0] - 0.7 * X[:, 1] + 0.3 * RNG.normal(size=N)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(Y[i]), *map(float, X[i])) for i in range(N)]
    return spark.createDataFrame(data, "id long, y double, a double, b double, c double").repartition(3)


def refit(x, y):
    z = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(z, y, rcond=None)[0]


def test_tails():
    assert math.isclose(ds.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(ds.t_quantile(0.975, 10), 2.228139, abs_tol=1e-5)
    assert math.isclose(ds.f_upper(3.3258, 5, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(ds.chi2_upper(5.991, 2), 0.05, abs_tol=1e-4)
    assert math.isclose(ds.chi2_upper(18.307, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(ds.normal_cdf(1.959964), 0.975, abs_tol=1e-6)


def test_wide_moments_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(60, 20)) + 100
    names = [f"f{i}" for i in range(20)]
    df = spark.createDataFrame([(i % 3, *map(float, r)) for i, r in enumerate(x)], ["g", *names]).repartition(4)
    m = mo.moments(df, names)
    assert np.allclose(m.cross / 60, np.cov(x.T, bias=True)) and np.allclose(m.mean, x.mean(axis=0))
    for r in mo.moment_rows(df, names, ["g"]).collect():
        part = x[r["g"]::3]
        assert np.allclose(mo.unpack(r, names).cross / len(part), np.cov(part.T, bias=True))


def test_leave_one_out_equals_refits(spark, rows):
    combos = rg.combinations(spark, NAMES, 1, 3)
    assert combos.count() == 7
    m = mo.moments(rows, [*NAMES, "y"])
    got = {r["combo_key"]: r for r in rg.leave_one_out(rows, combos, m, "y").collect()}
    for combo in (["a"], ["a", "b"], NAMES):
        i = [NAMES.index(c) for c in combo]
        e = [Y[k] - np.r_[1, X[k, i]] @ refit(np.delete(X[:, i], k, 0), np.delete(Y, k)) for k in range(N)]
        r = got["|".join(combo)]
        assert math.isclose(r["q2"], 1 - np.sum(np.square(e)) / np.sum((Y - Y.mean()) ** 2), rel_tol=1e-9)
        assert math.isclose(r["mae"], np.mean(np.abs(e)), rel_tol=1e-9)


def test_folds_equal_refits(spark, rows):
    folded = {r["id"]: r["fold"] for r in osm.k_folds(rows, 4, seed=5).collect()}
    sizes = [list(folded.values()).count(f) for f in range(4)]
    assert max(sizes) - min(sizes) <= 1
    got = {r["combo_key"]: r for r in rg.cross_validate(rows, rg.combinations(spark, NAMES, 2, 2), NAMES, "y", 4, 1, seed=5).collect()}
    f = np.array([folded[i] for i in range(N)])
    e = np.empty(N)
    for k in range(4):
        theta = refit(X[f != k][:, [0, 2]], Y[f != k])
        e[f == k] = Y[f == k] - np.column_stack([np.ones((f == k).sum()), X[f == k][:, [0, 2]]]) @ theta
    assert math.isclose(got["a|c"]["q2"], 1 - (e @ e) / np.sum((Y - Y.mean()) ** 2), rel_tol=1e-9)
    assert math.isclose(got["a|c"]["mae"], np.abs(e).mean(), rel_tol=1e-9)


def test_exact_line(spark):
    df = spark.createDataFrame([(i, 2.0 * i + 1, float(i)) for i in range(10)], "id long, y double, x double")
    top = ps.search_models(df, ["x"], "y", largest=1, threshold=0.5).first()
    assert math.isclose(top["r2"], 1) and math.isclose(top["q2"], 1) and top["rmsd"] < 1e-9


def test_search_stores_and_skips(spark, rows, tmp_path):
    store = str(tmp_path / "results")
    ps.search_models(rows, NAMES, "y", largest=1, threshold=0.1, store=store)
    assert spark.read.parquet(store).count() == 3
    ps.search_models(rows, NAMES, "y", largest=2, threshold=0.1, store=store)
    stored = spark.read.parquet(store)
    assert stored.count() == 6 and stored.select("combo_key").distinct().count() == 6


def test_relaxed_gate(spark, rows):
    assert ps.search_models(rows, NAMES, "y", largest=1, threshold=0.99).isEmpty()
    assert not ps.search_models(rows, NAMES, "y", largest=1, threshold=0.99, relax=True).isEmpty()


def test_collinear_subset_is_flagged(spark, rows):
    twice = rows.withColumn("d", 2 * rows["a"])
    fit = rg.fit_subsets(rg.combinations(spark, ["a", "d"], 2, 2), mo.moments(twice, ["a", "d", "y"]), "y").first()
    assert fit["rank_deficient"] and 0 < fit["r2"] < 1


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(0.5 + x)))).astype(int)
    df = spark.createDataFrame([(i, int(c), float(v)) for i, (c, v) in enumerate(zip(y, x))], "id long, y int, x double").repartition(3)
    theta = np.zeros(2)
    z = np.column_stack([np.ones(200), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ theta))
        theta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    fitter = oc.LogisticFitter(df, ["x"], "y")
    job = fitter.fit([oc.Job("x", ["x"])])[0]
    assert job.converged and np.allclose(job.theta, theta, atol=1e-7)
    ordinal = oc.LogisticFitter(df, ["x"], "y", "ordinal").fit([oc.Job("x", ["x"])])[0]
    # With two classes the proportional-odds model is the same model: cut = -intercept.
    assert np.allclose(ordinal.theta, [-theta[0], theta[1]], atol=1e-6)


def test_separated_classes_end(spark):
    df = spark.createDataFrame([(i, int(i >= 10), float(i)) for i in range(20)], "id long, y int, x double")
    combos = spark.createDataFrame([("x", ["x"])], "combo_key string, combo array<string>")
    r = oc.fit_classifiers(clean.standardise(df, ["x"]), combos, ["x"], "y").first()
    assert r["accuracy"] == 1 and r["mcfadden_r2"] > 0.99


def test_confusion_totals(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b"), ("b", "a")], "y string, predicted string")
    t = {(r["actual"], r["predicted"]): r["n"] for r in om.confusion_table(df).collect()}
    assert t[(None, None)] == 4 and t[("b", None)] == 2
    assert om.weighted_scores(df).first()["accuracy"] == 0.75


def test_numbering_with_a_hot_key(spark):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, id long")
    got = {r["id"]: r["n"] for r in numbered(df, ["k"], ["v", "id"], value_buckets(df, "v"), "n").collect()}
    seen, want = {}, {}
    for k, v, i in sorted(data):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_running_sums_look_across_buckets(spark):
    df = spark.createDataFrame([(float(i * i), 1) for i in range(500)], "v double, c int")
    run = running_sums(df, [], "v", value_buckets(df, "v"), {"s": "c"}).orderBy("v").collect()
    assert [r["s"] for r in run] == list(range(1, 501))
    assert [r["next_v"] for r in run[:-1]] == [float(i * i) for i in range(1, 500)] and run[-1]["next_v"] is None


@pytest.mark.parametrize("size", [5, 60])
def test_similarity_sample_equals_greedy(spark, size, monkeypatch):
    monkeypatch.setattr(osm, "ROUND", 16)
    rng = np.random.default_rng(9)
    data = [(i, i % 2, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(160, 2)) ** 3)]
    df = spark.createDataFrame(data, "id long, y int, a double, b double")
    sims = {r["id"]: r["similarity"] for r in osm.centroid_similarity(df, ["a", "b"]).where("y = 1").collect()}
    left, want = dict(sims), set()
    for t in np.linspace(min(sims.values()), max(sims.values()), size):
        k = min(left, key=lambda i: (abs(left[i] - t), i))
        want.add(k)
        del left[k]
    got = {r["id"] for r in osm.similarity_sample(df, ["a", "b"], 1, size).where("status = 'kept'").collect()}
    assert got == want


def test_decision_stump_and_scan(spark):
    df = spark.createDataFrame([(float(i), float(i), int(i >= 6)) for i in range(10)], "x double, v double, y int")
    s = oth.decision_stumps(df, ["x"], "v", cutoff=("percentile", 60, "high")).first()
    assert s["accuracy"] == 1 and 5 <= s["threshold"] <= 6
    t = oth.threshold_scan(df, ["x"], "y").first()
    assert t["direction"] == "greater" and t["f1"] == 1 and 5 <= t["threshold"] < 6


def test_removal_by_ks_equals_brute_force(spark):
    values = [1.0, 1.0, 2.0, 3.0, 3.0, 4.0, 7.0, 9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")

    def loss(k):
        rest = values[:k] + values[k + 1:]
        return max(abs(sum(v <= x for v in values) / 8 - sum(v <= x for v in rest) / 7) for x in values)

    best = min(range(8), key=lambda k: (round(loss(k), 9), k))
    got = od.removals(df, "v", 1, "ks").first()
    assert (got["id"], round(got["loss"], 9)) == (best, round(loss(best), 9))


def test_permutation_keeps_the_values(spark, rows):
    out = rg.permuted_target(rows, "y", 3).collect()
    for run in (1, 2, 3):
        assert sorted(r["y_perm"] for r in out if r["run"] == run) == sorted(Y.tolist())
    assert len({tuple(r["y_perm"] for r in sorted(out, key=lambda r: r["id"]) if r["run"] == run) for run in (1, 2, 3)}) == 3


def test_lasso_shrinks(spark, rows):
    got = {r["term"]: r["estimate"] for r in od.lasso(rows, NAMES, "y", 0.4).collect()}
    assert got["c"] == 0 and 0 < got["a"] < 1.5


def test_names_and_columns(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, ""), (3, None)], "seq int, name string")
    assert [r["name"] for r in clean.clean_names(df, "name", "seq").orderBy("seq").collect()] == ["a", "a#2", "row", "row#2"]
    assert clean.name_column(["x", "Molecule", "ID"]) == "Molecule"
    with pytest.raises(ValueError):
        clean.mark_left_out(df.select("seq"), [99], "seq")
