"""Hand-computed geometry, brute force for the cell joins, and invariances."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitable.functions import vectors as v
from orbitable.operators import bonds as ob
from orbitable.operators import frames as of
from orbitable.operators import graph as og
from orbitable.operators import neighbours as on
from orbitable.operators import renumber as orn
from orbitable.operators import sterimol as ost

SCHEMA = "mol_id string, atom_idx int, element string, x double, y double, z double"


def atoms(spark, mol, rows):
    return spark.createDataFrame([(mol, i, e, *map(float, p)) for i, (e, p) in enumerate(rows, 1)], SCHEMA)


def bond_set(df):
    return {(r["a"], r["b"]) for r in df.collect()}


def test_length_angle_dihedral(spark):
    m = atoms(spark, "m", [("C", (0, 0, 0)), ("C", (3, 4, 0))])
    assert of.bond_lengths(m, [(1, 2)]).first()["value"] == 5
    m = atoms(spark, "m", [("C", (1, 0, 0)), ("C", (0, 0, 0)), ("C", (0, 1, 0)), ("C", (-1, 0, 0))])
    got = {r["feature"]: r["value"] for r in of.angles(m, [(1, 2, 3), (1, 2, 4)]).collect()}
    assert math.isclose(got["angle_1-2-3"], 90) and math.isclose(got["angle_1-2-4"], 180)
    for z in (1, -1):
        m = atoms(spark, "m", [("C", (1, 1, 0)), ("C", (1, 0, 0)), ("C", (0, 0, 0)), ("C", (0, 0, z))])
        assert math.isclose(of.angles(m, [(1, 2, 3, 4)]).first()["value"], 90)


def test_angles_do_not_change_with_rotation(spark):
    rng = random.Random(3)
    m = atoms(spark, "m", [("C", [rng.uniform(-2, 2) for _ in range(3)]) for _ in range(5)])
    x, y, z = v.euler_rotate(v.cols("x", "y", "z"), 0.4, -1.1, 2.0, (3.0, -1.0, 0.5))
    turned = m.select("mol_id", "atom_idx", "element", x.alias("x"), y.alias("y"), z.alias("z"))
    for specs in ([(1, 2, 3), (2, 3, 4, 5)],):
        a = {r["feature"]: r["value"] for r in of.angles(m, specs).collect()}
        b = {r["feature"]: r["value"] for r in of.angles(turned, specs).collect()}
        assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_rotation_takes_one_vector_onto_another(spark):
    for target in ((0.0, 0.6, 0.8), (-1.0, 0.0, 0.0)):
        lit = lambda t: tuple(F.lit(float(c)) for c in t)
        row = spark.range(1).select(v.pack(v.rotate_onto(lit((1, 0, 0)), lit((1, 0, 0)), lit(target))).alias("r")).first()["r"]
        assert np.allclose([row["x"], row["y"], row["z"]], target)


def test_charge_dipole(spark):
    m = atoms(spark, "m", [("C", (1, 0, 0)), ("C", (-1, 0, 0)), ("X", (0, 0, 0)), ("X", (0, 1, 0)), ("X", (1, 1, 0))])
    q = spark.createDataFrame([("m", 1, "nbo", 1.0), ("m", 2, "nbo", -1.0)], "mol_id string, atom_idx int, scheme string, charge double")
    got = of.charge_dipoles(m, q, [{"origin": [3], "y": 4, "plane": 5}]).first()
    assert (got["dip_x"], got["dip_y"], got["dip_z"], got["total"]) == (2.0, 0.0, 0.0, 2.0)


def test_connectivity_rules(spark):
    assert bond_set(on.connectivity(atoms(spark, "m", [("H", (0, 0, 0)), ("H", (0.74, 0, 0))]))) == set()
    cl = atoms(spark, "m", [("C", (0, 0, 0)), ("Cl", (2.0, 0, 0)), ("C", (3.75, 0, 0))])
    assert bond_set(on.connectivity(cl)) == {(2, 3)}
    ring = [("N", (1.9 + 0.1 * i, 0, 0)) for i in range(1)]
    axes = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    metal = atoms(spark, "m", [("Pd", (0, 0, 0))] + [("N", [c * (2.0 + 0.1 * i) for c in a]) for i, a in enumerate(axes)])
    assert ring and bond_set(on.connectivity(metal)) == {(1, 2), (1, 3), (1, 4), (1, 5)}


def test_pairs_equal_brute_force_across_cells(spark):
    rng = random.Random(1)
    pts = [("C", [rng.uniform(-15, 15) for _ in range(3)]) for _ in range(400)]
    pts += [("C", (4.0, 4.0, 4.0)), ("C", (4.0, 4.0, 5.5)), ("C", (-4.0, 0.0, 0.0)), ("C", (-6.5, 0.0, 0.0))]
    want = {(i, j) for (i, (_, p)), (j, (_, q)) in itertools.combinations(enumerate(pts, 1), 2) if math.dist(p, q) <= 2.5}
    found = on.pairs_within(atoms(spark, "m", pts), 2.5).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want


def test_nearest_atom_equals_brute_force(spark):
    rng = random.Random(2)
    host = [("C", [rng.uniform(-20, 20) for _ in range(3)]) for _ in range(60)]
    pts = [[rng.uniform(-30, 30) for _ in range(3)] for _ in range(80)]
    points = spark.createDataFrame([("m", i, *p) for i, p in enumerate(pts)], "mol_id string, point_id int, x double, y double, z double")
    got = {r["point_id"]: r["atom_idx"] for r in on.nearest_atom(points, atoms(spark, "m", host)).collect()}
    assert got == {i: min(range(60), key=lambda k: math.dist(p, host[k][1])) + 1 for i, p in enumerate(pts)}


def test_nearest_atom_far_away_and_in_long_molecules(spark):
    rng = random.Random(4)
    hosts = {
        "wide": [("C", [rng.uniform(-400, 400), rng.uniform(-3, 3), rng.uniform(-60, 60)]) for _ in range(300)],
        "one": [("C", (1.0, 2.0, 3.0))],
        "pair": [("C", (0.0, 0.0, 0.0)), ("C", (0.0, 0.0, 0.0)), ("C", (9.0, 0.0, 0.0)), ("C", (float("nan"), 0.0, 0.0))],
    }
    pts = [[rng.uniform(-500, 500), rng.uniform(-9, 9), rng.uniform(-90, 90)] for _ in range(60)]
    pts += [[1e6, 0.0, 0.0], [-3e6, 2e6, 5.0], [0.0, 1e6, 1e6], [4.5, 0.0, 0.0]]
    rows = [(m, i, *p) for m in [*hosts, "empty"] for i, p in enumerate(pts)] + [("one", 999, float("inf"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "mol_id string, point_id int, x double, y double, z double")
    host = None
    for m, held in hosts.items():
        host = atoms(spark, m, held) if host is None else host.unionByName(atoms(spark, m, held))
    got = {(r["mol_id"], r["point_id"]): r["atom_idx"] for r in on.nearest_atom(points, host).collect()}
    near = lambda p, held: min((round(math.dist(p, q), 9), k) for k, (_, q) in enumerate(held, 1) if not math.isnan(q[0]))[1]
    assert got == {(m, i): near(p, held) for m, held in hosts.items() for i, p in enumerate(pts)}


def chain(spark, edges):
    bonds = spark.createDataFrame([("m", a, b, 1.0) for a, b in edges], "mol_id string, a int, b int, dist double")
    n = max(max(e) for e in edges)
    return atoms(spark, "m", [("C", (i, 0, 0)) for i in range(n)]), bonds


def test_reachability(spark):
    a, b = chain(spark, [(1, 2), (2, 3), (1, 4)])
    assert {r["atom_idx"] for r in og.reachable(a, b, [(1, 2)]).collect()} == {1, 2, 3}
    a, b = chain(spark, [(i, i + 1) for i in range(1, 25)])
    assert og.graph_diameters(b, a).first()["diameter"] == 24


def test_ring_and_motif(spark):
    a, b = chain(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 6), (1, 7)])
    r = og.six_rings(b, [1, 7]).collect()
    assert len(r) == 1 and [r[0][f"r{i}"] for i in range(6)] == [1, 2, 3, 4, 5, 6]
    assert {(x["a"], x["b"]) for x in og.opposite_pairs(og.six_rings(b, [1])).collect()} == {(4, 1), (2, 6), (3, 5)}
    m = og.match_motif(a, b, ["C", "C", "C"], [(1, 2), (2, 3)]).first()
    assert (m["m1"], m["m2"], m["m3"]) == (1, 2, 3)
    assert og.reorder_by_motif(a, og.match_motif(a, b, ["C", "C"], [(1, 2)]), 2).count() == 2


def test_drop_atoms_renumbers(spark):
    a, b = chain(spark, [(1, 2), (2, 3), (3, 4)])
    kept, bonds = ob.drop_atoms(a, b, [2])
    assert [r["atom_idx"] for r in kept.orderBy("atom_idx").collect()] == [1, 2, 3] and bond_set(bonds) == {(2, 3)}


def test_map_completion_closes_chains(spark):
    a, _ = chain(spark, [(1, 2), (2, 9)])
    partial = spark.createDataFrame([("m", o, n) for o, n in [(1, 2), (2, 3), (3, 4), (5, 5), (6, 99), (7, 8), (8, 7)]], "mol_id string, old int, new int")
    full = orn.complete_map(a, partial)
    got = {r["old"]: r["new"] for r in full.collect()}
    assert got == {1: 2, 2: 3, 3: 4, 4: 1, 5: 5, 6: 6, 7: 8, 8: 7, 9: 9}
    assert orn.is_permutation(full).first()["bijective"]
    moved = orn.renumber(a, full)
    report = orn.check_renumbering(a, moved, full, ["element", "x"]).collect()
    assert all(r["equal"] for r in report)
    wrong = moved.withColumn("x", F.when(F.col("atom_idx") == 1, F.col("x") + 1).otherwise(F.col("x")))
    bad = {r["column"]: r["mismatches"] for r in orn.check_renumbering(a, wrong, full, ["element", "x"]).collect()}
    assert bad == {"element": 0, "x": 1}


def test_extents_equal_sampled_outlines(spark):
    rng = random.Random(5)
    rows = [("m", 1, i, rng.uniform(-2, 2), rng.uniform(-1, 4), rng.uniform(-2, 2), rng.choice([1.0, 1.5, 1.7])) for i in range(1, 9)]
    pts = spark.createDataFrame(rows, "mol_id string, spec_id int, atom_idx int, x double, y double, z double, radius double")
    got = ost.extents(pts).first()
    a = np.linspace(0, 2 * np.pi, 100)
    plane = np.vstack([np.column_stack((r[3] + r[6] * np.cos(a), r[5] + r[6] * np.sin(a))) for r in rows])

    def b1(deg):
        c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
        t = plane @ np.array([[c, -s], [s, c]]).T
        return np.abs(np.concatenate([t.max(axis=0), t.min(axis=0)])).min()

    start = min(range(18, 108, 18), key=lambda d: round(b1(d), 4))
    assert math.isclose(got["B1"], min(b1(d) for d in range(start - 18, start + 19)), abs_tol=2e-4)
    assert math.isclose(got["B5"], np.linalg.norm(plane, axis=1).max(), abs_tol=2e-4)
    assert math.isclose(got["L"], max(r[4] + r[6] for r in rows), abs_tol=1e-4)


def test_buried_volume_equals_brute_force(spark):
    m = atoms(spark, "m", [("C", (0, 0, 0)), ("O", (1.4, 0, 0)), ("N", (0, -2.0, 0.3)), ("H", (0, 0, 1.0))])
    got = {r["octant"]: (r["points"], r["buried"]) for r in ost.buried_volume(m, [1], 3.5, 0.5).collect()}
    grid = [(i + 0.5) * 0.5 for i in range(-7, 8)]
    want = {}
    for p in itertools.product(grid, repeat=3):
        if sum(c * c for c in p) <= 3.5**2:
            o = sum((1 << b) for b, c in enumerate(p) if c > 0)
            inside = math.dist(p, (1.4, 0, 0)) <= 1.52 * 1.17 or math.dist(p, (0, -2.0, 0.3)) <= 1.55 * 1.17
            n, k = want.get(o, (0, 0))
            want[o] = (n + 1, k + inside)
    assert got == want


def test_longest_path_is_a_walk(spark):
    a, b = chain(spark, [(1, 5), (5, 2), (2, 6), (6, 3), (2, 4)])
    path = [r["atom_idx"] for r in og.longest_paths(b, a).orderBy("position").collect()]
    assert path == [1, 5, 2, 6, 3]


def test_alignment_loss_and_directions(spark):
    host = atoms(spark, "m", [("C", (0, 0, 0)), ("C", (9, 0, 0))])
    points = spark.createDataFrame([("m", 1, 0.5, 0.0, 0.0), ("m", 2, 9.0, 0.0, 0.0)], "mol_id string, point_id int, x double, y double, z double")
    want = 1 - 2 / (1 + math.exp(20 * 0.5)) + 2.5
    assert math.isclose(on.alignment_loss(points, host).first()["loss"], want, rel_tol=1e-12)
    d = on.sphere_directions(spark, 50).collect()
    assert all(math.isclose(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2, 1) for r in d)
    assert np.linalg.norm([sum(r[c] for r in d) for c in "xyz"]) < 1.5


def test_large_molecule_diameter_without_all_pairs(spark):
    rng = random.Random(11)
    n = 90
    edges = {(rng.randrange(max(1, i - 40), i), i) for i in range(2, n + 1)} | {(5, 40), (60, 88)}
    edges |= {(91, 92), (92, 93)}
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)

    def far(s):
        seen, level, d = {s}, {s}, 0
        while level:
            level = {q for p in level for q in near[p]} - seen
            seen |= level
            d += bool(level)
        return d

    a, b = chain(spark, sorted(edges))
    got = og.graph_diameters(b, a).first()
    assert got["diameter"] == max(far(s) for s in near)
    assert far(got["first"]) == far(got["last"]) == got["diameter"]


def points_inside(spheres, radius, step, turn=lambda p: p):
    """Lattice points and how many lie in a sphere, per octant; `turn` maps lattice to molecule coordinates."""
    n, want = math.ceil(radius / step) + 1, {}
    for p in itertools.product([(i + 0.5) * step for i in range(-n, n)], repeat=3):
        if sum(c * c for c in p) <= radius * radius:
            o = sum((1 << b) for b, c in enumerate(p) if c > 0)
            k, hit = want.get(o, (0, 0))
            want[o] = (k + 1, hit + any(math.dist(turn(p), c) <= r for c, r in spheres))
    return want


@pytest.mark.parametrize(("radius", "step"), [(3.5, 0.1), (5.5, 0.37), (1.0, 0.25), (2.0, 0.5)])
def test_buried_volume_counts_intervals(spark, radius, step):
    rng = np.random.default_rng(3)
    rows = [("C", (0.3, -0.2, 0.1))] + [(e, tuple(rng.normal(scale=2.2, size=3).round(3).tolist())) for e in "NOCNOCH"] + [("Xx", (0.5, 0, 0))]
    rows.append(("O", (0.3 + radius + 0.9, -0.2, 0.1)))  # reaches in from outside
    m = atoms(spark, "m", rows)
    bondi = {"C": 1.70, "N": 1.55, "O": 1.52}
    spheres = [(tuple(np.subtract(p, rows[0][1])), bondi[e] * 1.17) for i, (e, p) in enumerate(rows, 1) if e in bondi and i not in (1, 4)]
    got = {r["octant"]: (r["points"], r["buried"]) for r in ost.buried_volume(m, [1], radius, step, excluded=[4]).collect()}
    assert got == points_inside(spheres, radius, step)


def test_buried_volume_turned_by_named_atoms(spark):
    rows = [("C", (1, 1, 1)), ("N", (1, 1, 3.0)), ("O", (2.5, 1.0, 1.5)), ("N", (0.2, 2.5, 0.4))]
    m = atoms(spark, "m", rows)
    bondi = {"N": 1.55, "O": 1.52}
    # Atom 2 is on -z, atom 3 at x > 0: the axes are x, -y and -z of the molecule.
    spheres = [(tuple(np.subtract(p, rows[0][1])), bondi[e] * 1.17) for e, p in rows[1:]]
    got = {r["octant"]: (r["points"], r["buried"]) for r in ost.buried_volume(m, [1], 3.5, 0.25, z_axis=[2], xz_plane=[3]).collect()}
    want = points_inside(spheres, 3.5, 0.25, lambda p: (p[0], -p[1], -p[2]))
    assert got == want
    shells = {(r["radius"], r["quadrant"]): r for r in ost.buried_shells(m, [1], (3.5, 5.5), 0.25, z_axis=[2], xz_plane=[3]).collect()}
    assert len(shells) == 10
    buried = sum(k for _, k in want.values())
    assert math.isclose(shells[3.5, None]["buried_volume"], buried * 0.25**3)
    assert math.isclose(shells[3.5, 1]["percent"], 100 * (want[1][1] + want[5][1]) / (want[1][0] + want[5][0]))
    assert shells[5.5, None]["buried_volume"] > shells[3.5, None]["buried_volume"]
    assert ost.buried_volume(m, [1], z_axis=[9]).count() == 0  # no such atom
    assert ost.buried_volume(m.limit(0), [1]).count() == 0


def test_buried_volume_shuffles_atoms_not_lattice_columns(spark):
    rng = random.Random(8)
    rows = [(m, i, "C" if i > 1 else "N", *(rng.randint(-12, 12) / 4 for _ in range(3))) for m in range(9) for i in range(1, 2 + 5 * m)]
    rows += [(20, 1, "N", 0.0, 0.0, 0.0), (21, 2, "C", 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "mol_id long, atom_idx int, element string, x double, y double, z double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # molecules span batches
    try:
        df = ost.buried_volume(atoms, [1], 2.0, 0.25)
        got = {(r["mol_id"], r["octant"]): r["buried"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    axis = (np.arange(-8, 8) + 0.5) * 0.25
    x, y, z = np.meshgrid(axis, axis, axis, indexing="ij")
    want = {}
    for m in [*range(9), 20]:
        place = {r[1]: np.array(r[3:]) for r in rows if r[0] == m}
        hit = np.zeros(x.shape, bool)
        for i in place:
            if i > 1:
                a, b, c = place[i] - place[1]
                hit |= (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 <= (1.70 * 1.17) ** 2
        hit &= x * x + y * y + z * z <= 4.0
        for o in range(8):
            want[m, o] = int((hit & ((x > 0) + 2 * (y > 0) + 4 * (z > 0) == o)).sum())
    assert got == want
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()
