"""What large tables rest on: steps that stay inside a molecule, packs of rows, partitions of bounded size."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitable.operators import blocks
from orbitable.operators import frames as of
from orbitable.operators import graph as og
from orbitable.operators import metrics as om
from orbitable.operators import neighbours as on
from orbitable.operators import regress as rg
from orbitable.operators import renumber as orn
from orbitable.operators import sterimol as ost
from orbitable.plans import extraction as pe
from orbitable.queries import checks
from orbitable.queries.registry import Inputs
from orbitable.sources import logs as sl
from tests.test_graph import atom_rows, bond_rows, search


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def points(spark, rng, sizes):
    rows = [(m, i, rng.choice(["C", "H", "Cl", "Pd", "N"]), *[rng.uniform(0, 3 + n / 12) for _ in range(3)])
            for m, n in sizes.items() for i in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, "mol_id long, atom_idx int, element string, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("whole", [0, 8, 64])
def test_pairs_whole_and_by_cell(spark, monkeypatch, whole):
    monkeypatch.setattr(on, "WHOLE", whole)
    rows, atoms = points(spark, random.Random(6), {1: 3, 2: 8, 3: 9, 4: 70, 5: 1})
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and np.linalg.norm(np.subtract(p[3:], q[3:])) <= 2.0)
    assert sorted((r["mol_id"], r["a"], r["b"]) for r in on.pairs_within(atoms, 2.0).collect()) == want


def test_bonds_of_small_molecules_take_one_shuffle(spark):
    atoms = points(spark, random.Random(2), {1: 5, 2: 9})[1].repartition(4, "mol_id")
    assert exchanges(on.connectivity(atoms)) <= 2  # the atoms as both ends of a pair


def test_diameters_gather_small_molecules(spark, monkeypatch):
    rng = random.Random(4)
    sizes = {f"m{i}": rng.choice([1, 2, 5, 9, 17, 40]) for i in range(25)}
    molecules = {m: [(rng.randint(1, n), rng.randint(1, n)) for _ in range(rng.choice([0, n, 2 * n]))] for m, n in sizes.items()}
    atoms, bonds = atom_rows(spark, sizes), bond_rows(spark, molecules)
    got = sorted(map(tuple, og.graph_diameters(bonds, atoms).collect()))
    monkeypatch.setattr(og, "SMALL", 12)  # some walk step by step
    assert got == sorted(map(tuple, og.graph_diameters(bonds, atoms).collect())) == sorted(map(tuple, og._large_diameters(bonds, atoms).collect()))
    want = []
    for m, n in sizes.items():
        best = (0, 1, 1)
        for s in range(1, n + 1):
            depth, todo = {s: 0}, [s]
            for x in todo:
                for a, b in molecules[m]:
                    for p, q in ((a, b), (b, a)):
                        if p == x and q not in depth:
                            depth[q] = depth[x] + 1
                            todo.append(q)
            best = min(best, *[(-d, min(s, t), max(s, t)) for t, d in depth.items()])
        want.append((m, -best[0], best[1], best[2]))
    assert got == sorted(want)
    calls = []
    monkeypatch.setattr(og, "SMALL", 64)
    monkeypatch.setattr(og, "hop_distances", lambda *args: calls.append(1))
    og.graph_diameters(bonds, atoms).collect()
    assert not calls


def test_only_open_components_are_checked(spark, monkeypatch):
    rng = random.Random(9)
    molecules = {f"m{i:03}": [(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(8)] for i in range(300)}
    whole, checked = og._unsettled, []
    monkeypatch.setattr(og, "_unsettled", lambda stars, keys: checked.append(stars.select(*keys).distinct().count()) or whole(stars, keys))
    got = {(r["mol_id"], r["atom_idx"]): r["component"] for r in og.components(bond_rows(spark, molecules)).collect()}
    assert got == {(m, x): min(search(pairs, x, None)) for m, pairs in molecules.items() for a, b in pairs if a != b for x in (a, b)}
    assert checked and max(checked) < 100


def test_angles_move_arms_once(spark):
    atoms = points(spark, random.Random(3), {1: 6, 2: 7})[1]
    bonds = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 4, 5, 1.0)], "mol_id long, a int, b int, dist double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        angles = of.bond_angles(atoms, bonds)
        assert exchanges(angles) <= 8
        assert [tuple(r)[:4] for r in angles.collect()] == [(1, 1, 2, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_map_check_without_distinct_counts(spark):
    maps = {"swap": [(1, 2), (2, 1)], "same": [(5, 5)], "twice": [(1, 2), (1, 2), (2, 1)], "open": [(1, 2), (2, 3)], "merged": [(1, 3), (3, 3)],
            "missing": [(1, None), (None, 1)]}
    table = spark.createDataFrame([(m, a, b) for m, pairs in maps.items() for a, b in pairs], "mol_id string, old int, new int")
    checked = orn.is_permutation(table)
    assert {r["mol_id"]: r["bijective"] for r in checked.collect()} == {m: m in ("swap", "same") for m in maps}
    assert "Expand" not in checked._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_a_text_are_read_once(spark):
    """Extraction of the numbers stands in a column of its own, not inside the lambda that cuts it into rows."""
    rows = "\n".join(f" {i} 6 0 {i}.5 0.25 -1.5" for i in range(1, 4))
    cut = "-" * 69
    texts = spark.createDataFrame([("m", f"Standard orientation:\n{cut}\n Center\n{cut}\n{rows}\n{cut}\nend")], "mol_id string, text string")
    atoms = sl.geometry(texts)
    assert [(r["atom_idx"], r["element"], r["x"]) for r in sorted(atoms.collect())] == [(1, "C", 1.5), (2, "C", 2.5), (3, "C", 3.5)]
    assert atoms._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_bond_orders_read_lines_once(spark):
    text = "Natural Bond Orbitals (Summary):\n 1. BD ( 1) C 1 - C 2 1.9\n 2. BD ( 2) C 1 - C 2 1.9\n 3. LP ( 1) C 1 1.8\n 4. LP ( 2) C 1 1.8\n 5. LP ( 1) C 9 1.8\n RY*( 1)"
    orders, atoms = sl.bond_orders(spark.createDataFrame([("m", text)], "mol_id string, text string"))
    assert [tuple(r) for r in orders.collect()] == [("m", 1, 2, 2)]
    assert sorted(map(tuple, atoms.collect())) == [("m", 1, 2, 2), ("m", 2, 2, 0)]
    assert "Join" not in atoms._jdf.queryExecution().optimizedPlan().toString()


def test_packs_hold_many_rows(spark):
    rows = spark.range(1000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), F.array(F.col("id").cast("int")).alias("s")).coalesce(1)
    packs = blocks.packed(rows, 2)
    assert packs.count() <= 4 and packs.agg(F.sum("n")).first()[0] == 1000
    back = [(v[0], s[0]) for p in packs.toArrow().to_batches() for b in blocks.unpacked(p) for v, s in zip(b["x"].to_pylist(), b["s"].to_pylist())]
    assert sorted(back) == [(float(i), i) for i in range(1000)]


def test_summary_ranks_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(a), float(b), float(a + 2 * b + c)) for i, (a, b, c) in enumerate(rng.normal(size=(60, 3)))], "id long, a double, b double, y double")
    models = rg.combinations(spark, ["a", "b"], 1, 2)
    want = {k: {r["combo_key"]: r["q2"] for r in rg.cross_validate(rows, models, ["a", "b"], "y", k, 2).collect()} for k in (3, 5)}
    whole, calls = rg.repeated_ranks, []
    monkeypatch.setattr(rg, "repeated_ranks", lambda *args: calls.append(1) or whole(*args))
    for r in rg.cv_summary(rows, models, ["a", "b"], "y", repeats=2).collect():
        assert np.allclose([r["q2_3fold"], r["q2_5fold"]], [want[3][r["combo_key"]], want[5][r["combo_key"]]], rtol=1e-12)
    assert len(calls) == 1


def test_ks_reads_its_rows_once(spark, tmp_path):
    """Totals, buckets and running sums come from the stored values."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    rows = spark.range(100).select(F.col("id").cast("double").alias("y")).mapInArrow(count, "y double")
    assert abs(om.ks_distance(rows, rows.where("y >= 50"), "y").first()[0] - 0.5) < 1e-12
    assert seen.value == 200


def test_lines_are_cut_by_rows_where_there_are_many(spark, tmp_path, monkeypatch):
    lines = spark.range(900).selectExpr("id % 300 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 7 as int) as l_linenumber",
                                        "1d as l_quantity", "1d as l_extendedprice", "0d as l_discount", "0d as l_tax", "timestamp'2020-01-01' as l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = sorted(map(tuple, Inputs(spark, str(tmp_path)).atoms.collect()))
    monkeypatch.setattr(Inputs, "FEW_ROWS", 100)
    monkeypatch.setattr(Inputs, "TASK_ROWS", 50)
    cut = Inputs(spark, str(tmp_path)).atoms
    assert sorted(map(tuple, cut.collect())) == plain and cut.rdd.getNumPartitions() == 18


def sides(points, degree):
    """Smallest side of the outlines of points (x, z, radius) turned by a degree, rounded, by the outline formula."""
    turn, reach = math.radians(degree), []
    for axis in (0.0, math.pi, math.pi / 2, 3 * math.pi / 2):
        way = axis - turn
        gap = abs(way / ost.STEP - round(way / ost.STEP)) * ost.STEP
        reach.append(max(x * math.cos(way) + z * math.sin(way) + r * math.cos(gap) for x, z, r in points))
    return min(round(abs(v), 4) for v in reach)


@pytest.mark.parametrize("batch,at_once", [(10_000, 1 << 10), (7, 5)])
def test_extents_stream_points_past_their_key(spark, monkeypatch, batch, at_once):
    """No row per point and degree; keys go on over Arrow batches and pieces of them."""
    rng = random.Random(8)
    rows = [(m, 1, i, *[rng.uniform(-3, 3) for _ in range(3)], rng.choice([1.0, 1.7])) for m in range(40) for i in range(1, rng.choice([2, 3, 30]))]
    points = spark.createDataFrame(rows, "mol_id long, spec_id int, atom_idx int, x double, y double, z double, radius double").repartition(5)
    monkeypatch.setattr(ost, "POINTS_AT_ONCE", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = ost.extents(points)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and exchanges(found) == 1
        got = {r["mol_id"]: r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {r[0] for r in rows}
    for m, r in got.items():
        mine = [p for p in rows if p[0] == m]
        flat = [(p[3], p[5], p[6]) for p in mine]
        start = min(range(18, 91, 18), key=lambda d: (sides(flat, d), d))
        assert math.isclose(r["B1"], min(sides(flat, d) for d in range(start - 18, start + 19)), abs_tol=1e-9)
        assert math.isclose(r["L"], max(p[4] + p[6] for p in mine), abs_tol=1e-4)


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(1)
    values = [0.12345, -0.12345, 2.00005, 1e-5, 5e-5, -5e-5, 0.0, 123456789.00005, 1e12 + 0.5, float("inf"), float("nan"), *[rng.uniform(-9, 9) for _ in range(500)],
              *[rng.randint(-99999, 99999) / 1e5 for _ in range(500)]]
    want = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", F.round("v", 4).alias("r")).collect()
    assert np.array_equal(ost.half_up(np.array(values)), [r["r"] for r in sorted(want)], equal_nan=True)


def test_cube_points_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            seen.add(rows.num_rows)
            yield rows
    atoms = spark.createDataFrame([(1, 1, "C", 0.0, 0.0, 0.0), (1, 2, "C", 0.0, 1.5, 0.0), (1, 3, "C", 1.4, 2.0, 0.0)],
                                  "mol_id long, atom_idx int, element string, x double, y double, z double")
    bonds = spark.createDataFrame([(1, 1, 2, 1.5), (1, 2, 3, 1.48)], "mol_id long, a int, b int, dist double")
    table = spark.createDataFrame([(1, f"p{i}", 0.5 * i, 2.0 - 0.25 * i, 0.75) for i in range(4)], "mol_id long, point_id string, x double, y double, z double")
    found = ost.cube_sterimol(table.mapInArrow(count, table.schema), atoms, bonds, [(1, 2)]).collect()
    assert seen.value == 4 and [tuple(r)[:2] for r in found] == [(1, 1)] and found[0]["L"] == 2.0
    assert math.isclose(found[0]["B5"], math.hypot(1.5, 0.75), abs_tol=1e-4)


def test_buried_volume_works_on_the_columns_that_a_sphere_meets(monkeypatch):
    whole, inside = ost._ranges, []
    monkeypatch.setattr(ost, "_ranges", lambda square, middle, limit, step: inside.append(bool((square <= limit).all())) or whole(square, middle, limit, step))
    spheres = [(1, 0.4, -0.3, 1.1, 1.9), (1, 2.9, 1.0, 0.0, 1.7), (2, -1.0, -1.25, -3.0, 2.0)]
    ids, *place = zip(*spheres)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([1] * 3), *map(pa.array, place)], names=["mol_id", "centre", "x", "y", "z", "r"])
    got = {m: c for out in ost._buried(3.5, 0.1)(iter([batch])) for m, _, c in zip(*(v.to_pylist() for v in out.columns))}
    assert inside and all(inside)
    spot = (np.arange(-36, 36) + 0.5) * 0.1
    x, y, z = np.meshgrid(spot, spot, spot, indexing="ij")
    for m in (1, 2):
        hit = np.any([(x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 <= r * r for i, a, b, c, r in spheres if i == m], axis=0) & (x * x + y * y + z * z <= 3.5**2)
        assert got[m] == np.bincount(((x > 0) + 2 * (y > 0) + 4 * (z > 0))[hit], minlength=8).tolist()


def test_stored_views_are_numbered_once(spark, tmp_path):
    lines = spark.range(40).selectExpr("id % 9 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 7 as int) as l_linenumber",
                                       "cast(id % 11 as double) as l_quantity", "1d as l_extendedprice", "0d as l_discount", "0d as l_tax", "timestamp'2020-01-01' as l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(9).selectExpr("id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "1d as o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    plain = Inputs(spark, str(tmp_path))
    tables = checks._tables(Inputs(spark, str(tmp_path)))
    for name in ("atoms", "charges", "displacements", "modes"):
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "lineitem.parquet" not in plan
        assert sorted(map(tuple, tables[name].collect())) == sorted(map(tuple, getattr(plain, name).collect()))


def test_centres_of_a_summary_are_found_once(spark, monkeypatch):
    atoms = spark.createDataFrame([(1, 1, "C", 0.0, 0.0, 0.0), (1, 2, "C", 0.0, 1.5, 0.0), (1, 3, "C", 1.4, 2.0, 0.0)],
                                  "mol_id long, atom_idx int, element string, x double, y double, z double")
    bonds = spark.createDataFrame([(1, 1, 2, 1.5), (1, 2, 3, 1.48)], "mol_id long, a int, b int, dist double")
    scalars = spark.createDataFrame([(1, 0.5), (2, 0.25)], "mol_id long, homo_lumo_gap_ev double")
    whole, plans = ost.sterimol, []
    monkeypatch.setattr(ost, "sterimol", lambda a, b, bases, radii: plans.append(bases._jdf.queryExecution().executedPlan().toString()) or whole(a, b, bases, radii))
    rows = pe.molecule_summary({"atoms": atoms, "bonds": bonds, "mol_scalars": scalars}).collect()
    assert [r["mol_id"] for r in rows] == [2, 1] and rows[0]["L"] is None and rows[1]["L"] > 1.5
    assert len(plans) == 1 and "Aggregate" not in plans[0]


def test_features_of_many_shuffles_are_stored_as_found(spark):
    atoms = spark.createDataFrame([(1, 1, "C", 0.0, 0.0, 0.0), (1, 2, "C", 0.0, 1.5, 0.0), (1, 3, "C", 1.4, 2.0, 0.0)],
                                  "mol_id long, atom_idx int, element string, x double, y double, z double")
    bonds = spark.createDataFrame([(1, 1, 2, 1.5), (1, 2, 3, 1.48)], "mol_id long, a int, b int, dist double")
    scalars = spark.createDataFrame([(1, 0.5)], "mol_id long, homo_lumo_gap_ev double")
    rows = pe.long_features({"atoms": atoms, "bonds": bonds, "mol_scalars": scalars}, {"sterimol": [[1, 2]]})
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r["feature"] for r in rows.collect()} == {"B1_1-2", "B5_1-2", "L_1-2", "loc_B5_1-2", "B1_B5_angle_1-2", "homo_lumo_gap_ev"}
