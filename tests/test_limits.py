"""Wide tables, lost rows, several gates on one store, unscaled and separated classes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitable.operators import classify, metrics, moments, ranking, regress, renumber, sampling
from orbitable.plans import search
from orbitable.sources import xyz
from orbitable.streaming import ingest


def wide(spark, n, p, seed=1, missing=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 1000.0
    x[:, 1::2] += x[:, ::2] * 0.7
    if missing:
        x[rng.random((n, p)) < missing] = np.nan
    names = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    return df.select(*[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(names)]), x, names


def test_moments_of_2048_columns(spark):
    df, x, names = wide(spark, 60, 2048)
    m = moments.moments(df, names)
    centred = x - x.mean(axis=0)
    assert m.n == 60 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.cross, centred.T @ centred, atol=1e-7)


def test_wide_correlation_is_pairwise_complete(spark):
    df, x, names = wide(spark, 80, 60, missing=0.1)
    got = {(r.f1, r.f2): r.r for r in moments.correlation_long(df, names).collect()}
    assert len(got) == 60 * 59 // 2
    for (a, b), r in random.Random(1).sample(sorted(got.items()), 200):
        u, v = x[:, int(a[1:])], x[:, int(b[1:])]
        both = np.isfinite(u) & np.isfinite(v)
        assert r == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-9)


def test_moments_by_key(spark):
    df, x, names = wide(spark, 90, 40)
    keyed = df.withColumn("k", F.when(F.col("c0") > 1000, "a").when(F.col("c0") > 999, "b"))
    rows = {r["k"]: moments.unpack(r, names) for r in moments.moment_rows(keyed, names, ["k"]).collect()}
    label = np.where(x[:, 0] > 1000, "a", np.where(x[:, 0] > 999, "b", "none"))
    for k, name in ((None, "none"), ("a", "a"), ("b", "b")):
        part = x[label == name]
        centred = part - part.mean(axis=0)
        assert rows[k].n == len(part) and np.allclose(rows[k].cross, centred.T @ centred, atol=1e-7)


def test_surplus_lines_and_later_frames(spark, tmp_path):
    good = "2\nc\nH 0 0 0\nC 1 0 0\n"
    texts = {"good": good, "two": good + "2\nc\nH 0 0 1\nC 1 0 1\n", "surplus": "2\nc\nH 0 0 0\nC 1 0 0\nO 2 0 0\n", "short": "3\nc\nH 0 0 0\nC 1 0 0\n",
             "bad": "2\nc\nH 0 0 x\nC 1 0 0\n", "none": "hello\n", "other": good + "3\nc\nH 0 0 1\nC 1 0 1\n"}
    table = spark.createDataFrame(list(texts.items()), "mol_id string, text string")
    atoms, rejected = xyz.parse_xyz(table)
    assert {(r.mol_id, r.atom_idx) for r in atoms.collect()} == {(m, i) for m in ("good", "two") for i in (1, 2)}
    errors = {r.mol_id: r.error for r in rejected.collect()}
    assert errors == {"surplus": "atom count differs", "short": "atom count differs", "bad": "bad coordinate", "none": "no atom count", "other": "atom count differs"}
    for name, text in texts.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.xyz").write_text(text)
    ingest.append_stream(ingest.stream_atoms(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.mol_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"good", "two"}


def test_two_gates_on_one_store(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(40)]
    df = spark.createDataFrame([(i, a, b, a + float(rng.normal())) for i, a, b in rows], "id long, a double, b double, y double")
    fresh = search.search_models(df, ["a", "b"], "y", largest=2, threshold=0.2)
    want = {r.combo_key: round(r.q2, 9) for r in fresh.collect()}
    store = str(tmp_path / "store")
    assert search.search_models(df, ["a", "b"], "y", largest=2, threshold=0.99, store=store).count() == 0
    got = search.search_models(df, ["a", "b"], "y", largest=2, threshold=0.2, store=store)
    assert {r.combo_key: round(r.q2, 9) for r in got.collect()} == want and want
    relaxed = search.search_models(df, ["a", "b"], "y", largest=2, threshold=0.99, store=store, relax=True)
    assert relaxed.count() > 0


def test_classifier_search_resumes(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = [(i, float(x), float(rng.normal()), "u" if x + rng.normal() > 0 else "v") for i, x in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(data, "id long, a double, b double, y string")
    first = search.search_classifiers(df, ["a", "b"], "y", store=str(tmp_path / "s"), threshold=0.0, folds=3).collect()
    again = search.search_classifiers(df, ["a", "b"], "y", store=str(tmp_path / "s"), threshold=0.0, folds=3).collect()
    assert first and {r.combo_key for r in first} == {r.combo_key for r in again}


def test_unscaled_feature(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 0.01, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(1.5 - 310 * x))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    job = classify.LogisticFitter(df, ["x"], "y").fit([classify.Job("k", ["x"])])[0]
    beta, z = np.zeros(2), np.stack([np.ones(400), x], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    assert job.converged and not job.separated and np.allclose(job.theta, beta, rtol=1e-6) and abs(beta[1]) > 50


def test_null_labels_and_empty_bins(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a", float(i // 10 * 10)) for i in range(20)], "id long, y string, v double")
    assert sampling.stratified_folds(df, 2).count() == 20
    assert sampling.stratified_sample(df, "y", 100).count() == 20
    bins = {r.bin: r.n for r in metrics.histogram(df, "v", 5).collect()}
    assert bins == {0: 10, 1: 0, 2: 0, 3: 0, 4: 10}
    two = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None)], "y string, predicted string")
    assert metrics.confusion_table(two).count() == 8


def test_text_order_and_lags(spark):
    df = spark.createDataFrame([(f"name{i * 37 % 100:03d}", float(i)) for i in range(100)], "id string, v double")
    folds = {r.id: r.fold for r in sampling.k_folds(df, 4, seed=None).collect()}
    assert folds == {f"name{i:03d}": i % 4 for i in range(100)}
    rows = spark.createDataFrame([(i, float(i * i)) for i in range(1, 31)], "pos long, v double")
    got = {r.pos: (r.v_lag1, r.v_lag3) for r in ranking.lagged_pairs(rows, "pos", [1, 3], ["v"]).collect()}
    assert got == {i: (float((i - 1) ** 2) if i > 1 else None, float((i - 3) ** 2) if i > 3 else None) for i in range(1, 31)}


def test_exact_holdout_and_mixed_types(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(a), float(2 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(25, 2)))], "id long, a double, y double")
    models = regress.combinations(spark, ["a"], 1, 1)
    row = regress.repeated_holdout(df, models, ["a"], "y", seed=None).first()
    data = np.array(df.orderBy("id").select("a", "y").collect())
    train, test = data[3:], data[:3]
    slope, start = np.polyfit(train[:, 0], train[:, 1], 1)
    e = test[:, 1] - start - slope * test[:, 0]
    assert row.mae == pytest.approx(np.abs(e).mean()) and row.rmsd == pytest.approx(np.sqrt((e ** 2).mean()))
    mapping = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "mol_id long, old int, new long")
    assert renumber.is_permutation(mapping).first().bijective


def test_correlation_is_the_same_at_every_width(spark):
    from orbitable.operators.moments import correlated_pairs, correlation_long, correlation_order

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 17))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    x[4, 0], x[7, 1], x[9, 2], x[11, 3] = np.nan, np.inf, -np.inf, np.nan
    names = [f"c{i}" for i in range(17)]
    df = spark.createDataFrame([[float(v) for v in row] for row in x], ", ".join(f"{c} double" for c in names))
    want = {}
    for i in range(17):
        for j in range(i + 1, 17):
            ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            want[names[i], names[j]] = np.corrcoef(x[ok, i], x[ok, j])[0, 1]
    for width in (16, 17):
        got = {(r.f1, r.f2): r.r for r in correlation_long(df, names[:width]).collect()}
        assert len(got) == width * (width - 1) // 2
        assert all(abs(r - want[k]) < 1e-9 for k, r in got.items())
        assert [(r.f1, r.f2) for r in correlated_pairs(df, names[:width]).collect()] == [("c0", "c1")]
        assert {r.feature for r in correlation_order(df, names[:width]).collect() if r.starred} == {"c0", "c1"}


def test_ends_of_longest_paths_do_not_depend_on_size(spark):
    from orbitable.operators import graph

    rng, mols = random.Random(4), {}
    # Arms of equal length meet in one atom, so there are many longest paths; the numbers are shuffled.
    for mol, (arms, length) in enumerate([(70, 1), (35, 2)]):
        names = list(range(1, arms * length + 2))
        rng.shuffle(names)
        mols[f"m{mol}"] = (names, [(names[0 if j == 0 else i * length + j], names[i * length + j + 1]) for i in range(arms) for j in range(length)])
    # Two pairs of opposite corners of a grid with leaves at its centre; atom 1 is nearer to the lowest pair.
    grid = [(3, 1), (1, 6), (7, 2), (2, 8), (4, 9), (9, 5), (3, 7), (7, 4), (1, 2), (2, 9), (6, 8), (8, 5)]
    mols["grid"] = (list(range(1, 75)), grid + [(2, k) for k in range(10, 75)])
    atoms = spark.createDataFrame([(m, a) for m, (names, _) in mols.items() for a in names], "mol_id string, atom_idx int")
    bonds = spark.createDataFrame([(m, min(e), max(e)) for m, (_, edges) in mols.items() for e in edges], "mol_id string, a int, b int")
    want = {}
    for m, (names, edges) in mols.items():
        near, best = {a: [] for a in names}, (0, 0, 0)
        for a, b in edges:
            near[a].append(b)
            near[b].append(a)
        for a in names:
            depth, layer = {a: 0}, [a]
            while layer:
                layer = {b: depth[x] + 1 for x in layer for b in near[x] if b not in depth}
                depth |= layer
            best = min(best, *((-d, a, b) for b, d in depth.items() if a <= b))
        want[m] = (-best[0], best[1], best[2])
    got = {r.mol_id: (r.diameter, r["first"], r["last"]) for r in graph.graph_diameters(bonds, atoms).collect()}
    assert got == want
