"""Validation of many models at once against plain refits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitable.operators import blocks
from orbitable.operators import metrics as om
from orbitable.operators import moments as mo
from orbitable.operators import regress as rg
from orbitable.operators import sampling as osm

RNG = np.random.default_rng(11)
N, NAMES = 60, ["a", "b", "c", "d", "e"]
X = RNG.normal(size=(N, 5)) * [1, 5, 0.1, 2, 1] + [0, 50, 3, -7, 0]
Y = 2 * X[:, 0] - 0.4 * X[:, 1] + 3 * X[:, 2] + RNG.normal(size=N)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(Y[i]), *map(float, X[i])) for i in range(N)]
    data += [(N, None, *[1.0] * 5), (N + 1, 1.0, float("nan"), *[1.0] * 4)]  # incomplete rows take no part
    return spark.createDataFrame(data, "id long, y double, a double, b double, c double, d double, e double").repartition(4)


def errors_of(columns, train, test):
    z = np.column_stack([np.ones(train.sum()), X[train][:, columns]])
    theta = np.linalg.lstsq(z, Y[train], rcond=None)[0]
    return Y[test] - np.column_stack([np.ones(test.sum()), X[test][:, columns]]) @ theta


def subsets(largest):
    for k in range(1, largest + 1):
        for columns in itertools.combinations(range(5), k):
            yield "|".join(NAMES[i] for i in columns), list(columns)


@pytest.fixture(params=[(1 << 16, 1 << 27), (8, 100)], ids=["one block", "many blocks"])
def sizes(request, monkeypatch):
    """Few and many cells: blocks of 8 models, row groups of some 16 rows."""
    monkeypatch.setattr(blocks, "MODEL_BLOCK", request.param[0])
    monkeypatch.setattr(blocks, "GROUP_VALUES", request.param[1])


def test_leave_one_out_of_all_subsets(spark, rows, sizes):
    m = mo.moments(rows, [*NAMES, "y"])
    got = {r["combo_key"]: r for r in rg.leave_one_out(rows, rg.combinations(spark, NAMES, 1, 4), m, "y").collect()}
    sst = np.sum((Y - Y.mean()) ** 2)
    wanted = dict(subsets(4))
    assert set(got) == set(wanted)
    for key, columns in wanted.items():
        e = np.array([errors_of(columns, np.arange(N) != i, np.arange(N) == i)[0] for i in range(N)])
        r = got[key]
        assert np.allclose([r["q2"], r["mae"], r["rmsd"]], [1 - e @ e / sst, np.abs(e).mean(), math.sqrt(e @ e / N)], rtol=1e-8)


@pytest.mark.parametrize("k, repeats, seed", [(5, 5, 42), (3, 2, 7), (4, 3, None)])
def test_repeated_folds_of_all_subsets(spark, rows, sizes, k, repeats, seed):
    whole = mo.complete_rows(rows, [*NAMES, "y"])
    got = {r["combo_key"]: r for r in rg.cross_validate(rows, rg.combinations(spark, NAMES, 1, 3), NAMES, "y", k, repeats, seed=seed).collect()}
    runs = [None] if seed is None else [seed + r for r in range(repeats)]
    folds = []
    for s in runs:
        fold = {r["id"]: r["fold"] for r in osm.k_folds(whole, k, seed=s).collect()}
        folds.append(np.array([fold[i] for i in range(N)]))
    sst = np.sum((Y - Y.mean()) ** 2)
    assert set(got) == {key for key, _ in subsets(3)}
    for key, columns in subsets(3):
        scores = []
        for fold in folds:
            e = np.concatenate([errors_of(columns, fold != f, fold == f) for f in range(k)])
            scores.append([1 - e @ e / sst, np.abs(e).mean(), math.sqrt(e @ e / N)])
        r = got[key]
        assert np.allclose([r["q2"], r["mae"], r["rmsd"]], np.mean(scores, axis=0), rtol=1e-8)


@pytest.mark.parametrize("share, seed", [(0.1, 42), (0.3, 1), (0.2, None), (0.01, 3)])
def test_repeated_holdout(spark, rows, sizes, share, seed):
    got = {r["combo_key"]: r for r in rg.repeated_holdout(rows, rg.combinations(spark, NAMES, 1, 2), NAMES, "y", share, 3, seed=seed).collect()}
    size = math.ceil(round(share * N, 9))
    tests = []
    for r in range(1 if seed is None else 3):
        key = list(range(N)) if seed is None else [x["h"] for x in spark.range(N).orderBy("id").select(
            rg.hash_order(rg.F.col("id"), seed=seed + r).alias("h")).collect()]
        tests.append(np.isin(np.arange(N), sorted(range(N), key=lambda i: (key[i], i))[:size]))
    for name, columns in subsets(2):
        each = []
        for test in tests:
            e, y = errors_of(columns, ~test, test), Y[test]
            each.append([1 - e @ e / np.sum((y - y.mean()) ** 2) if size >= 2 else np.nan, np.abs(e).mean(), math.sqrt(e @ e / size)])
        r, want = got[name], np.mean(each, axis=0)
        assert np.allclose([r["mae"], r["rmsd"]], want[1:], rtol=1e-8)
        assert r["q2"] is None if size < 2 else math.isclose(r["q2"], want[0], rel_tol=1e-8)


def test_summary_joins_all_three(spark, rows):
    got = rg.cv_summary(rows, rg.combinations(spark, NAMES, 1, 2), NAMES, "y", repeats=2)
    assert len(got.columns) == 10 and got.count() == 15
    three = {r["combo_key"]: r["q2"] for r in rg.cross_validate(rows, rg.combinations(spark, NAMES, 1, 2), NAMES, "y", 3, 2).collect()}
    assert all(math.isclose(r["q2_3fold"], three[r["combo_key"]], rel_tol=1e-9) for r in got.collect())


def test_no_models(spark, rows):
    none = rg.combinations(spark, NAMES, 1, 1).where("false")
    m = mo.moments(rows, [*NAMES, "y"])
    assert rg.leave_one_out(rows, none, m, "y").count() == 0
    assert rg.cross_validate(rows, none, NAMES, "y", 3, 2).count() == 0


def test_cosine_matrix_gap_reads_arrow_blocks(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(70, 5))
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(values)], "id long, a double, b double, c double, d double, e double")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    u, w = unit(values[:, :2]), unit(values[:, 2:])
    out = om.cosine_matrix_gap(df, ["a", "b"], ["c", "d", "e"], block=9)
    assert abs(out.first()["mean_gap"] - np.abs(u @ u.T - w @ w.T).mean()) < 1e-12
    holed = om.cosine_matrix_gap(df.withColumn("a", F.lit(None).cast("double")), ["a", "b"], ["c", "d", "e"], block=9)
    assert holed.first()["mean_gap"] is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan  # rows of blocks never become Python objects
