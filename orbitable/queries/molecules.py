"""Geometry, connectivity, charges and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.functions import elements as el
from orbitable.functions import vectors as v
from orbitable.operators import bonds as ob
from orbitable.operators import frames as of
from orbitable.operators import graph as og
from orbitable.operators import neighbours as on
from orbitable.queries.registry import oracle, query

PAIRS = [(1, 2), (2, 3)]
FRAMES = [{"origin": [1], "y": 2, "plane": 3}, {"origin": [1, 2], "y": 3, "plane": 4}]


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


# --- neighbours and bonds -------------------------------------------------------------------

@query("atom_pairs_within", oracle(
    "SELECT mol_id, a, b, round(dist, 6) AS dist FROM pairs_v WHERE dist <= 1.5", "pairs_v"))
def atom_pairs_within(t):
    return on.pairs_within(t.atoms, 1.5).select("mol_id", "a", "b", _r("dist"))


@query("bond_table", oracle("SELECT mol_id, a, b, round(dist, 6) AS dist FROM bonds_v", "bonds_v"))
def bond_table(t):
    return on.connectivity(t.atoms).select("mol_id", "a", "b", _r("dist"))


@query("bonds_by_cutoff", oracle(
    "SELECT mol_id, a, b, round(dist, 6) AS dist FROM pairs_v WHERE dist > 0 AND dist < 1.0", "pairs_v"))
def bonds_by_cutoff(t):
    return on.connectivity_by_cutoff(t.atoms, 1.0).select("mol_id", "a", "b", _r("dist"))


_RADII = "(VALUES ('H', 0.31), ('C', 0.76), ('N', 0.71), ('O', 0.66), ('Cl', 1.02), ('Pd', 1.39)) r(e, r)"


def _radii_rule(condition: str) -> str:
    return oracle(f"""
        SELECT mol_id, a, b, round(dist, 6) AS dist FROM pairs_v
        JOIN (SELECT e AS e1, CAST(r AS DOUBLE) AS r1 FROM {_RADII}) ON ea = e1
        JOIN (SELECT e AS e2, CAST(r AS DOUBLE) AS r2 FROM {_RADII}) ON eb = e2
        WHERE dist > 0 AND NOT (ea = 'H' AND eb = 'H') AND {condition}""", "pairs_v")


@query("bonds_by_radii_scaled", _radii_rule("dist < (r1 + r2) * CAST(1.08 AS DOUBLE)"))
def bonds_by_radii_scaled(t):
    return on.connectivity_by_radii(t.atoms, 1.08).select("mol_id", "a", "b", _r("dist"))


@query("bonds_by_radii_slack", _radii_rule("dist < (r1 + r2) + CAST(0.45 AS DOUBLE)"))
def bonds_by_radii_slack(t):
    return on.connectivity_by_radii(t.atoms, 1.0, 0.45).select("mol_id", "a", "b", _r("dist"))


@query("atom_clashes", oracle(
    "SELECT mol_id, a, b, round(dist, 6) AS dist FROM pairs_v WHERE dist < 0.5", "pairs_v"))
def atom_clashes(t):
    return on.clashes(t.atoms).select("mol_id", "a", "b", _r("dist"))


@query("overlaps_separated", oracle("""
    WITH f AS (SELECT mol_id, b, min(a) AS a FROM pairs_v WHERE dist < 0.5 AND dist > 0 GROUP BY mol_id, b),
    m AS (SELECT f.mol_id, f.b, p.x AS x0, p.y AS y0, p.z AS z0
          FROM f JOIN atoms_v p ON p.mol_id = f.mol_id AND p.atom_idx = f.a),
    j AS (SELECT p.*, x0, y0, z0,
                 sqrt((p.x-x0)*(p.x-x0) + (p.y-y0)*(p.y-y0) + (p.z-z0)*(p.z-z0)) AS gap
          FROM atoms_v p LEFT JOIN m ON m.mol_id = p.mol_id AND m.b = p.atom_idx)
    SELECT mol_id, atom_idx, round(coalesce(x0 + 0.3 * (x - x0) / gap, x), 6) + 0.0 AS x,
           round(coalesce(y0 + 0.3 * (y - y0) / gap, y), 6) + 0.0 AS y,
           round(coalesce(z0 + 0.3 * (z - z0) / gap, z), 6) + 0.0 AS z FROM j""", "pairs_v"))
def overlaps_separated(t):
    return on.separate_overlaps(t.atoms).select("mol_id", "atom_idx", _r("x"), _r("y"), _r("z"))


@query("halogen_shortest_bond", oracle("""
    SELECT b.mol_id, e.atom_idx, count(*) AS n_bonds, round(min(b.dist), 6) AS dist
    FROM bonds_v b JOIN (SELECT mol_id, atom_idx FROM atoms_v WHERE element = 'Cl') e
      ON b.mol_id = e.mol_id AND (b.a = e.atom_idx OR b.b = e.atom_idx)
    GROUP BY b.mol_id, e.atom_idx""", "bonds_v"))
def halogen_shortest_bond(t):
    ends = of.bond_length_table(t.bonds).withColumnRenamed("a", "atom_idx")
    halogens = t.atoms.where(F.col("element").isin(*el.HALOGENS)).select("mol_id", "atom_idx")
    return (
        ends.join(halogens, ["mol_id", "atom_idx"], "left_semi")
        .groupBy("mol_id", "atom_idx")
        .agg(F.count("*").alias("n_bonds"), F.round(F.min("dist"), 6).alias("dist"))
    )


@query("metal_bond_count", oracle("""
    WITH c AS (SELECT mol_id, CASE WHEN ea = 'Pd' THEN a ELSE b END AS centre
               FROM bonds_v b JOIN pairs_v p USING (mol_id, a, b) WHERE ea = 'Pd' OR eb = 'Pd')
    SELECT mol_id, centre, count(*) AS n_bonds FROM c GROUP BY mol_id, centre""", "bonds_v"))
def metal_bond_count(t):
    metals = t.atoms.where(F.col("element") == "Pd").select("mol_id", F.col("atom_idx").alias("a"), F.lit(True).alias("ma"))
    other = metals.select("mol_id", F.col("a").alias("b"), F.col("ma").alias("mb"))
    marked = t.bonds.join(metals, ["mol_id", "a"], "left").join(other, ["mol_id", "b"], "left")
    centre = F.when(F.col("ma"), F.col("a")).when(F.col("mb"), F.col("b"))
    return (
        marked.select("mol_id", centre.alias("centre")).where("centre IS NOT NULL")
        .groupBy("mol_id", "centre").agg(F.count("*").alias("n_bonds"))
    )


@query("distinct_bonds", oracle("""
    SELECT mol_id, least(atom_idx, partner) AS a, greatest(atom_idx, partner) AS b, count(*) // 2 AS one
    FROM ends_v GROUP BY 1, 2, 3""", "ends_v"))
def distinct_bonds(t):
    return on.distinct_bonds(of.bond_length_table(t.bonds)).select("mol_id", "a", "b", F.lit(1).cast("bigint").alias("one"))


@query("bonds_without_hydrogen", oracle("""
    SELECT mol_id, a, b FROM bonds_v JOIN pairs_v USING (mol_id, a, b) WHERE ea <> 'H' AND eb <> 'H'""", "bonds_v"))
def bonds_without_hydrogen(t):
    return ob.drop_element_bonds(t.bonds, t.atoms, "H").select("mol_id", "a", "b")


@query("bonds_decorated", oracle("""
    SELECT mol_id, a, b, ea AS element_a, eb AS element_b FROM bonds_v JOIN pairs_v USING (mol_id, a, b)
    WHERE ea IN ('C', 'N', 'O') AND eb IN ('C', 'N', 'O')""", "bonds_v"))
def bonds_decorated(t):
    return ob.bonds_in_set(t.bonds, t.atoms, t.atoms.where(F.col("element").isin("C", "N", "O")))


@query("bonded_spec_pairs", oracle("""
    SELECT mol_id, spec_id FROM bonds_v
    JOIN (VALUES (1, 1, 2), (2, 2, 3)) s(spec_id, a, b) USING (a, b)""", "bonds_v"))
def bonded_spec_pairs(t):
    return ob.bonded_pairs(t.bonds, PAIRS).select("mol_id", "spec_id")


@query("shared_centre", oracle("""
    SELECT DISTINCT p.mol_id, 1 AS spec_id, p.partner AS centre FROM ends_v p
    JOIN ends_v q ON p.mol_id = q.mol_id AND p.partner = q.partner
    WHERE p.atom_idx = 1 AND q.atom_idx = 3""", "ends_v"))
def shared_centre(t):
    return ob.shared_centres(t.bonds, [(1, 3)]).select("mol_id", "spec_id", "centre")


@query("bond_change_report", oracle("""
    WITH o AS (SELECT mol_id, a, b FROM bonds_v),
    n AS (SELECT mol_id, a, b FROM pairs_v WHERE dist > 0 AND dist < 1.0)
    SELECT mol_id, a, b, CASE WHEN o.a IS NULL THEN 'new' WHEN n.a IS NULL THEN 'missing' ELSE 'kept' END AS status
    FROM (SELECT *, 1 AS one FROM o) o FULL JOIN n USING (mol_id, a, b)""".replace("o.a IS NULL", "o.one IS NULL")
    .replace("n.a IS NULL", "n.one IS NULL").replace("FULL JOIN n", "FULL JOIN (SELECT *, 1 AS one FROM n) n"),
    "bonds_v"))
def bond_change_report(t):
    return ob.bond_changes(t.bonds, on.connectivity_by_cutoff(t.atoms, 1.0))


@query("atom_type", oracle("""
    WITH c AS (SELECT mol_id, atom_idx, count(*) AS n FROM ends_v GROUP BY 1, 2)
    SELECT a.mol_id, a.atom_idx, coalesce(n, 0) AS n_bonds,
           CASE WHEN element = 'O' THEN CASE WHEN coalesce(n, 0) < 1.5 THEN 'O2' ELSE 'O' END
                WHEN element = 'N' THEN CASE WHEN coalesce(n, 0) < 2.5 THEN 'C6/N6' ELSE 'N' END
                WHEN element = 'C' THEN CASE WHEN coalesce(n, 0) < 2.5 THEN 'C3' WHEN coalesce(n, 0) < 3.5 THEN 'C6/N6' ELSE 'C' END
                WHEN element IN ('H', 'Cl') THEN element ELSE 'X' END AS atype
    FROM atoms_v a LEFT JOIN c ON a.mol_id = c.mol_id AND a.atom_idx = c.atom_idx""", "ends_v"))
def atom_type(t):
    return ob.atom_types(t.atoms, t.bonds).select("mol_id", "atom_idx", "n_bonds", "atype")


@query("direction_atoms", oracle("""
    WITH c AS (SELECT mol_id, partner, CASE WHEN atom_idx = 2 AND partner = 4 THEN 0 WHEN atom_idx = 2 THEN 1 ELSE 2 END AS k
               FROM ends_v WHERE (atom_idx = 2 AND partner <> 1) OR (atom_idx = 1 AND partner <> 2))
    SELECT mol_id, 1 AS origin, 2 AS direction, third FROM (
        SELECT mol_id, partner AS third, row_number() OVER (PARTITION BY mol_id ORDER BY k, partner) AS r FROM c) WHERE r = 1""",
    "ends_v"))
def direction_atoms(t):
    return ob.direction_atoms(t.bonds, [(1, 2, 4)]).select("mol_id", "origin", "direction", "third")


@query("atoms_dropped", oracle("""
    SELECT mol_id, CAST(atom_idx - CASE WHEN atom_idx > 2 THEN 1 ELSE 0 END AS INT) AS atom_idx, element
    FROM atoms_v WHERE atom_idx <> 2""", "atoms_v"))
def atoms_dropped(t):
    return ob.drop_atoms(t.atoms, t.bonds, [2])[0].select("mol_id", "atom_idx", "element")


@query("bonds_after_drop", oracle("""
    SELECT mol_id, CAST(a - CASE WHEN a > 2 THEN 1 ELSE 0 END AS INT) AS a,
           CAST(b - CASE WHEN b > 2 THEN 1 ELSE 0 END AS INT) AS b
    FROM bonds_v WHERE a <> 2 AND b <> 2""", "bonds_v"))
def bonds_after_drop(t):
    return ob.drop_atoms(t.atoms, t.bonds, [2])[1].select("mol_id", "a", "b")


@query("mapped_with_partner", oracle("""
    SELECT DISTINCT p.mol_id, p.atom_idx FROM ends_v p JOIN atoms_v q
      ON p.mol_id = q.mol_id AND p.partner = q.atom_idx AND q.element = 'C'
    JOIN atoms_v s ON p.mol_id = s.mol_id AND p.atom_idx = s.atom_idx AND s.element = 'C'""", "ends_v"))
def mapped_with_partner(t):
    return ob.mapped_with_partner(t.atoms.where("element = 'C'"), t.bonds).select("mol_id", "atom_idx")


_MASS = "(VALUES ('H', 1.008), ('C', 12.011), ('N', 14.007), ('O', 15.999), ('Cl', 35.453), ('Pd', 106.42)) w(e, m)"


@query("centre_atoms", oracle(f"""
    WITH m AS (SELECT mol_id, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz
               FROM (SELECT a.*, CAST(w.m AS DOUBLE) AS m FROM atoms_v a JOIN {_MASS} ON a.element = w.e) GROUP BY mol_id),
    d AS (SELECT a.mol_id, a.atom_idx, cx, cy, cz, row_number() OVER (PARTITION BY a.mol_id ORDER BY
              round((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz), 9), a.atom_idx) AS r
          FROM atoms_v a JOIN m ON a.mol_id = m.mol_id),
    p AS (SELECT mol_id, atom_idx, coalesce(min(partner) FILTER (partner > atom_idx), min(partner)) AS partner
          FROM ends_v GROUP BY 1, 2)
    SELECT d.mol_id, round(cx, 6) + 0.0 AS com_x, round(cy, 6) + 0.0 AS com_y, round(cz, 6) + 0.0 AS com_z,
           d.atom_idx AS centre, partner
    FROM d LEFT JOIN p ON d.mol_id = p.mol_id AND d.atom_idx = p.atom_idx WHERE r = 1""", "ends_v"))
def centre_atoms(t):
    return ob.centre_atoms(t.atoms, t.bonds).select("mol_id", _r("com_x"), _r("com_y"), _r("com_z"), "centre", "partner")


@query("smallest_molecule", oracle("""
    SELECT mol_id, count(*) AS n_atoms FROM atoms_v GROUP BY mol_id ORDER BY 2, 1 LIMIT 1""", "atoms_v"))
def smallest_molecule(t):
    return ob.smallest_molecule(t.atoms)


@query("atoms_swapped", oracle("""
    WITH h AS (SELECT mol_id FROM atoms_v WHERE atom_idx IN (1, 3) GROUP BY mol_id HAVING count(*) = 2)
    SELECT a.mol_id, a.atom_idx, a.element, round(s.x, 6) AS x, round(s.y, 6) AS y, round(s.z, 6) AS z
    FROM atoms_v a LEFT JOIN h ON a.mol_id = h.mol_id
    JOIN atoms_v s ON s.mol_id = a.mol_id AND s.atom_idx =
        CASE WHEN h.mol_id IS NULL THEN a.atom_idx WHEN a.atom_idx = 1 THEN 3 WHEN a.atom_idx = 3 THEN 1 ELSE a.atom_idx END""",
    "atoms_v"))
def atoms_swapped(t):
    return ob.swap_atoms(t.atoms, 1, 3).select("mol_id", "atom_idx", "element", _r("x"), _r("y"), _r("z"))


@query("coordinates_centred", oracle("""
    SELECT a.mol_id, atom_idx, round(x - mx, 6) + 0.0 AS x, round(y - my, 6) + 0.0 AS y, round(z - mz, 6) + 0.0 AS z
    FROM atoms_v a JOIN (SELECT mol_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM atoms_v GROUP BY mol_id) m
      ON a.mol_id = m.mol_id""", "atoms_v"))
def coordinates_centred(t):
    return ob.centre_coordinates(t.atoms).select("mol_id", "atom_idx", _r("x"), _r("y"), _r("z"))


@query("atoms_shuffled_sizes", oracle("""
    SELECT mol_id, count(*) AS n, CAST(sum(atom_idx) AS BIGINT) AS total, max(atom_idx) AS top FROM atoms_v GROUP BY mol_id""",
    "atoms_v"))
def atoms_shuffled_sizes(t):
    return ob.shuffle_atoms(t.atoms, 7).groupBy("mol_id").agg(
        F.count("*").alias("n"), F.sum("new_idx").alias("total"), F.max("new_idx").alias("top"))


@query("element_reference", oracle(f"""
    SELECT a.element, count(*) AS n, round(sum(CAST(w.m AS DOUBLE)), 3) AS mass
    FROM atoms_v a JOIN {_MASS} ON a.element = w.e GROUP BY a.element""", "atoms_v"))
def element_reference(t):
    table = el.elements(t.spark)
    return t.atoms.join(table, "element").groupBy("element").agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("mass"))


@query("element_bond_counts", oracle("""
    SELECT ea || '-' || eb AS kind, count(*) AS n, round(avg(dist), 6) AS mean_dist
    FROM (SELECT least(ea, eb) AS ea, greatest(ea, eb) AS eb, b.dist
          FROM bonds_v b JOIN pairs_v p USING (mol_id, a, b)) GROUP BY 1""", "bonds_v"))
def element_bond_counts(t):
    pairs = on.pairs_within(t.atoms, 2.6).select("mol_id", "a", "b", "element_a", "element_b")
    kind = F.concat_ws("-", F.least("element_a", "element_b"), F.greatest("element_a", "element_b"))
    return t.bonds.join(pairs, ["mol_id", "a", "b"]).groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("mean_dist"))


# --- lengths, angles, frames, dipoles, charges -------------------------------------------------

def _at(i: int) -> str:
    return f"(SELECT * FROM atoms_v WHERE atom_idx = {i})"


@query("bond_length_features", oracle(f"""
    SELECT p.mol_id, 'bond_length_1-2' AS feature, round(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)), 6) AS value
    FROM {_at(1)} p JOIN {_at(2)} q ON p.mol_id = q.mol_id
    UNION ALL
    SELECT p.mol_id, 'bond_length_2-3', round(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)), 6)
    FROM {_at(2)} p JOIN {_at(3)} q ON p.mol_id = q.mol_id""", "atoms_v"))
def bond_length_features(t):
    return of.bond_lengths(t.atoms, PAIRS).select("mol_id", "feature", _r("value"))


@query("bond_length_matrix", oracle("""
    SELECT mol_id, a, b, round(dist, 6) AS dist FROM bonds_v
    UNION ALL SELECT mol_id, b, a, round(dist, 6) FROM bonds_v""", "bonds_v"))
def bond_length_matrix(t):
    return of.bond_length_table(t.bonds).select("mol_id", "a", "b", _r("dist"))


_ANGLE = """CASE WHEN nu > 1e-12 AND nv > 1e-12 THEN degrees(acos(least(1.0, greatest(-1.0, d / sqrt(nu * nv))))) END"""


@query("angle_features", oracle(f"""
    WITH v AS (SELECT p.mol_id, p.x-q.x AS ux, p.y-q.y AS uy, p.z-q.z AS uz, r.x-q.x AS vx, r.y-q.y AS vy, r.z-q.z AS vz
               FROM {_at(1)} p JOIN {_at(2)} q ON p.mol_id = q.mol_id JOIN {_at(3)} r ON r.mol_id = p.mol_id),
    w AS (SELECT p.mol_id, q.x-p.x AS ax, q.y-p.y AS ay, q.z-p.z AS az, r.x-q.x AS b1, r.y-q.y AS b2, r.z-q.z AS b3,
                 s.x-r.x AS cx, s.y-r.y AS cy, s.z-r.z AS cz
          FROM {_at(1)} p JOIN {_at(2)} q ON p.mol_id = q.mol_id JOIN {_at(3)} r ON r.mol_id = p.mol_id
          JOIN {_at(4)} s ON s.mol_id = p.mol_id),
    n AS (SELECT mol_id, ay*b3-az*b2 AS ux, az*b1-ax*b3 AS uy, ax*b2-ay*b1 AS uz,
                 b2*cz-b3*cy AS vx, b3*cx-b1*cz AS vy, b1*cy-b2*cx AS vz FROM w),
    u AS (SELECT mol_id, 'angle_1-2-3' AS feature, ux*vx+uy*vy+uz*vz AS d, ux*ux+uy*uy+uz*uz AS nu, vx*vx+vy*vy+vz*vz AS nv FROM v
          UNION ALL
          SELECT mol_id, 'dihedral_1-2-3-4', ux*vx+uy*vy+uz*vz, ux*ux+uy*uy+uz*uz, vx*vx+vy*vy+vz*vz FROM n)
    SELECT mol_id, feature, round({_ANGLE}, 4) + 0.0 AS value FROM u""", "atoms_v"))
def angle_features(t):
    return of.angles(t.atoms, [(1, 2, 3), (1, 2, 3, 4)]).select("mol_id", "feature", _r("value", 4))


@query("bond_angle_table", oracle(f"""
    WITH e AS (SELECT n.mol_id, n.atom_idx AS centre, n.partner AS p, q.x-c.x AS x, q.y-c.y AS y, q.z-c.z AS z
               FROM ends_v n JOIN atoms_v c ON n.mol_id = c.mol_id AND n.atom_idx = c.atom_idx
               JOIN atoms_v q ON n.mol_id = q.mol_id AND n.partner = q.atom_idx),
    u AS (SELECT f.mol_id, f.p AS a, f.centre, g.p AS b, f.x*g.x+f.y*g.y+f.z*g.z AS d,
                 f.x*f.x+f.y*f.y+f.z*f.z AS nu, g.x*g.x+g.y*g.y+g.z*g.z AS nv
          FROM e f JOIN e g ON f.mol_id = g.mol_id AND f.centre = g.centre AND f.p < g.p)
    SELECT mol_id, a, centre, b, round({_ANGLE}, 4) + 0.0 AS angle FROM u""", "ends_v"))
def bond_angle_table(t):
    return of.bond_angles(t.atoms, t.bonds).select("mol_id", "a", "centre", "b", _r("angle", 4))


@query("vector_norms", oracle("""
    SELECT mol_id, atom_idx, round(sqrt(x*x + y*y + z*z), 6) AS norm FROM atoms_v""", "atoms_v"))
def vector_norms(t):
    return t.atoms.select("mol_id", "atom_idx", v.norm(v.cols("x", "y", "z")).alias("norm")).select(
        "mol_id", "atom_idx", _r("norm"))


@query("atom_group_centroids", oracle("""
    SELECT mol_id, 1 AS spec_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n_atoms
    FROM atoms_v WHERE atom_idx IN (1, 2) GROUP BY mol_id
    UNION ALL
    SELECT mol_id, 2, round(avg(x), 6), round(avg(y), 6), round(avg(z), 6), count(*)
    FROM atoms_v WHERE atom_idx IN (2, 3, 4) GROUP BY mol_id""", "atoms_v"))
def atom_group_centroids(t):
    return of.centroids(t.atoms, [(1, 2), (2, 3, 4)]).select("mol_id", "spec_id", _r("x"), _r("y"), _r("z"), "n_atoms")


# Frames of the two specs in FRAMES, as CTEs over atoms_v.
FRAME_SQL = f"""
    WITH o AS (
        SELECT p.mol_id, 1 AS spec_id, p.x AS ox, p.y AS oy, p.z AS oz, q.x AS qx, q.y AS qy, q.z AS qz, r.x AS rx, r.y AS ry, r.z AS rz
        FROM {_at(1)} p JOIN {_at(2)} q ON p.mol_id = q.mol_id JOIN {_at(3)} r ON p.mol_id = r.mol_id
        UNION ALL
        SELECT p.mol_id, 2, (p.x + s.x) / 2, (p.y + s.y) / 2, (p.z + s.z) / 2, q.x, q.y, q.z, r.x, r.y, r.z
        FROM {_at(1)} p JOIN {_at(2)} s ON p.mol_id = s.mol_id JOIN {_at(3)} q ON p.mol_id = q.mol_id
        JOIN {_at(4)} r ON p.mol_id = r.mol_id),
    f1 AS (SELECT *, sqrt((qx-ox)*(qx-ox)+(qy-oy)*(qy-oy)+(qz-oz)*(qz-oz)) AS ly,
                  sqrt((rx-ox)*(rx-ox)+(ry-oy)*(ry-oy)+(rz-oz)*(rz-oz)) AS lp FROM o),
    f2 AS (SELECT mol_id, spec_id, ox, oy, oz, (qx-ox)/ly AS yx, (qy-oy)/ly AS yy, (qz-oz)/ly AS yz,
                  CASE WHEN lp > 1e-12 THEN (rx-ox)/lp ELSE 0 END AS px, CASE WHEN lp > 1e-12 THEN (ry-oy)/lp ELSE 0 END AS py,
                  CASE WHEN lp > 1e-12 THEN (rz-oz)/lp ELSE 0 END AS pz FROM f1 WHERE ly > 1e-12),
    f3 AS (SELECT *, px*yx+py*yy+pz*yz AS c FROM f2),
    f4 AS (SELECT *, px-c*yx AS ax, py-c*yy AS ay, pz-c*yz AS az FROM f3),
    f5 AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) < 1e-9 AS degenerate FROM f4),
    f6 AS (SELECT mol_id, spec_id, ox, oy, oz, yx, yy, yz, degenerate,
                  CASE WHEN NOT degenerate THEN ax WHEN abs(yx) < 0.9 THEN 0.0 ELSE yz END AS b1,
                  CASE WHEN NOT degenerate THEN ay WHEN abs(yx) < 0.9 THEN -yz ELSE 0.0 END AS b2,
                  CASE WHEN NOT degenerate THEN az WHEN abs(yx) < 0.9 THEN yy ELSE -yx END AS b3 FROM f5),
    f7 AS (SELECT *, sqrt(b1*b1+b2*b2+b3*b3) AS l FROM f6),
    f8 AS (SELECT mol_id, spec_id, ox, oy, oz, yx, yy, yz, degenerate, b1/l AS xx, b2/l AS xy, b3/l AS xz FROM f7),
    frames AS (SELECT *, xy*yz-xz*yy AS zx, xz*yx-xx*yz AS zy, xx*yy-xy*yx AS zz FROM f8)"""

PLACED_SQL = """,
    placed AS (SELECT a.mol_id, spec_id, atom_idx, element,
        xx*(x-ox)+xy*(y-oy)+xz*(z-oz) AS x, yx*(x-ox)+yy*(y-oy)+yz*(z-oz) AS y,
        zx*(x-ox)+zy*(y-oy)+zz*(z-oz) AS z FROM atoms_v a JOIN frames f ON a.mol_id = f.mol_id)"""


@query("frame_axes", oracle(FRAME_SQL + """
    SELECT mol_id, spec_id, round(ox, 5) + 0.0 AS ox, round(yx, 5) + 0.0 AS yx, round(yy, 5) + 0.0 AS yy, round(yz, 5) + 0.0 AS yz,
           round(xx, 5) + 0.0 AS xx, round(xy, 5) + 0.0 AS xy, round(xz, 5) + 0.0 AS xz, round(zz, 5) + 0.0 AS zz FROM frames""", "atoms_v"))
def frame_axes(t):
    names = {"ox": "origin.x", "yx": "ey.x", "yy": "ey.y", "yz": "ey.z", "xx": "ex.x", "xy": "ex.y", "xz": "ex.z", "zz": "ez.z"}
    return of.local_frames(t.atoms, FRAMES).select(
        "mol_id", "spec_id", *[(F.round(F.col(c), 5) + 0.0).alias(n) for n, c in names.items()])


@query("frame_coordinates", oracle(FRAME_SQL + PLACED_SQL + """
    SELECT mol_id, spec_id, atom_idx, element, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM placed""",
    "atoms_v"))
def frame_coordinates(t):
    return of.frame_coordinates(t.atoms, FRAMES, digits=None).select(
        "mol_id", "spec_id", "atom_idx", "element", _r("x", 5), _r("y", 5), _r("z", 5))


@query("charge_dipole", oracle(FRAME_SQL + PLACED_SQL + """
    , d AS (SELECT p.mol_id, spec_id, sum(c.charge * x) AS dx, sum(c.charge * y) AS dy, sum(c.charge * z) AS dz
            FROM placed p JOIN charges_v c ON c.mol_id = p.mol_id AND c.atom_idx = p.atom_idx AND c.scheme = 'nbo' GROUP BY 1, 2)
    SELECT mol_id, spec_id, round(dx, 6) + 0.0 AS dip_x, round(dy, 6) + 0.0 AS dip_y, round(dz, 6) + 0.0 AS dip_z,
           round(sqrt(dx*dx+dy*dy+dz*dz), 6) AS total FROM d""", "atoms_v", "charges_v"))
def charge_dipole(t):
    return of.charge_dipoles(t.atoms, t.charges, FRAMES, digits=None).select(
        "mol_id", "spec_id", _r("dip_x"), _r("dip_y"), _r("dip_z"), _r("total"))


@query("dipole_in_frame", oracle(FRAME_SQL + """
    SELECT f.mol_id, spec_id, round(xx*dip_x+xy*dip_y+xz*dip_z, 5) + 0.0 AS dipole_x,
           round(yx*dip_x+yy*dip_y+yz*dip_z, 5) + 0.0 AS dipole_y, round(zx*dip_x+zy*dip_y+zz*dip_z, 5) + 0.0 AS dipole_z,
           round(sqrt(dip_x*dip_x+dip_y*dip_y+dip_z*dip_z), 5) AS total, degenerate
    FROM frames f JOIN scalars_v s ON f.mol_id = s.mol_id""", "atoms_v", "scalars_v"))
def dipole_in_frame(t):
    return of.dipoles_in_frame(t.atoms, t.scalars, FRAMES).select(
        "mol_id", "spec_id", _r("dipole_x", 5), _r("dipole_y", 5), _r("dipole_z", 5), _r("total", 5), "degenerate")


@query("plane_rotation", oracle("""
    SELECT mol_id, atom_idx, round(round(cos(radians(30.0)) * x - sin(radians(30.0)) * z, 4), 3) + 0.0 AS u,
           round(round(sin(radians(30.0)) * x + cos(radians(30.0)) * z, 4), 3) + 0.0 AS w FROM atoms_v""", "atoms_v"))
def plane_rotation(t):
    u, w = v.rotate_plane(F.col("x"), F.col("z"), F.lit(30.0))
    return t.atoms.select("mol_id", "atom_idx", (F.round(u, 3) + 0.0).alias("u"), (F.round(w, 3) + 0.0).alias("w"))


@query("space_rotation", oracle("""
    WITH a AS (SELECT mol_id, atom_idx, x, cos(0.3) * y - sin(0.3) * z AS y, sin(0.3) * y + cos(0.3) * z AS z FROM atoms_v),
    b AS (SELECT mol_id, atom_idx, cos(0.5) * x + sin(0.5) * z AS x, y, cos(0.5) * z - sin(0.5) * x AS z FROM a)
    SELECT mol_id, atom_idx, round(cos(0.7) * x - sin(0.7) * y + 1.0, 6) + 0.0 AS x,
           round(sin(0.7) * x + cos(0.7) * y + 2.0, 6) + 0.0 AS y, round(z + 3.0, 6) + 0.0 AS z FROM b""", "atoms_v"))
def space_rotation(t):
    x, y, z = v.euler_rotate(v.cols("x", "y", "z"), 0.3, 0.5, 0.7, (1.0, 2.0, 3.0))
    return t.atoms.select("mol_id", "atom_idx", x.alias("x"), y.alias("y"), z.alias("z")).select(
        "mol_id", "atom_idx", _r("x"), _r("y"), _r("z"))


@query("atom_charge_features", oracle("""
    SELECT mol_id, scheme || '_atom_' || CAST(atom_idx AS VARCHAR) AS feature, round(charge, 6) + 0.0 AS value
    FROM charges_v WHERE atom_idx IN (1, 3)""", "charges_v"))
def atom_charge_features(t):
    return of.atom_charges(t.charges, [1, 3]).select("mol_id", "feature", _r("value"))


@query("charge_difference_features", oracle("""
    SELECT p.mol_id, p.scheme || '_diff_1-2' AS feature, round(p.charge - q.charge, 6) + 0.0 AS value
    FROM charges_v p JOIN charges_v q ON p.mol_id = q.mol_id AND p.scheme = q.scheme AND p.atom_idx = 1 AND q.atom_idx = 2""",
    "charges_v"))
def charge_difference_features(t):
    return of.charge_differences(t.charges, [(1, 2)]).select("mol_id", "feature", _r("value"))


# --- graph walks -------------------------------------------------------------------------------

@query("reachable_atoms", oracle("""
    WITH s AS (SELECT mol_id FROM atoms_v WHERE atom_idx IN (1, 2) GROUP BY mol_id HAVING count(*) = 2),
    walk AS (SELECT mol_id, 2 AS atom_idx FROM s
             UNION SELECT w.mol_id, e.partner FROM walk w JOIN ends_v e
               ON e.mol_id = w.mol_id AND e.atom_idx = w.atom_idx WHERE e.partner <> 1)
    SELECT mol_id, CAST(atom_idx AS INT) AS atom_idx FROM walk UNION ALL SELECT mol_id, 1 FROM s""", "ends_v", recursive=True))
def reachable_atoms(t):
    return og.reachable(t.atoms, t.bonds, [(1, 2)]).select("mol_id", "atom_idx")


@query("graph_diameter", oracle("""
    WITH h AS (SELECT mol_id, atom_idx AS s, atom_idx AS t, 0 AS depth FROM atoms_v
               UNION SELECT h.mol_id, h.s, e.partner, h.depth + 1 FROM h JOIN ends_v e
                 ON e.mol_id = h.mol_id AND e.atom_idx = h.t WHERE h.depth < 12),
    d AS (SELECT mol_id, s, t, min(depth) AS depth FROM h GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY depth DESC, s, t) AS k FROM d WHERE s <= t)
    SELECT mol_id, depth AS diameter, s AS first, t AS last FROM r WHERE k = 1""", "ends_v", recursive=True))
def graph_diameter(t):
    return og.graph_diameters(t.bonds, t.atoms)


_RINGS = """
    WITH h AS (SELECT e.mol_id, e.partner AS p, f.partner AS q, g.partner AS r3
               FROM ends_v e JOIN ends_v f ON e.mol_id = f.mol_id AND e.partner = f.atom_idx
               JOIN ends_v g ON f.mol_id = g.mol_id AND f.partner = g.atom_idx
               WHERE e.atom_idx = 1 AND f.partner <> 1 AND g.partner <> 1 AND g.partner <> e.partner),
    c AS (SELECT a.mol_id, a.p AS r1, a.q AS r2, a.r3, b.q AS r4, b.p AS r5 FROM h a JOIN h b
          ON a.mol_id = b.mol_id AND a.r3 = b.r3 WHERE a.p < b.p AND a.q <> b.q AND a.p <> b.q AND a.q <> b.p),
    rings AS (SELECT mol_id, 1 AS seed, r1, r2, r3, r4, r5 FROM (SELECT *, row_number() OVER (
        PARTITION BY mol_id ORDER BY r1, r2, r3, r4, r5) AS k FROM c) WHERE k = 1)"""


@query("six_rings", oracle(_RINGS + " SELECT * FROM rings", "ends_v"))
def six_rings(t):
    return og.six_rings(t.bonds, [1]).drop("r0")


@query("motif_match", oracle("""
    WITH m AS (SELECT x.mol_id, x.atom_idx AS m1, e.partner AS m2, f.partner AS m3 FROM atoms_v x
          JOIN ends_v e ON e.mol_id = x.mol_id AND e.atom_idx = x.atom_idx
          JOIN atoms_v y ON y.mol_id = e.mol_id AND y.atom_idx = e.partner
          JOIN ends_v f ON f.mol_id = e.mol_id AND f.atom_idx = e.partner
          JOIN atoms_v z ON z.mol_id = f.mol_id AND z.atom_idx = f.partner
          WHERE x.element = 'C' AND y.element = 'N' AND z.element = 'O'
            AND NOT EXISTS (SELECT 1 FROM ends_v g WHERE g.mol_id = x.mol_id AND g.atom_idx = x.atom_idx AND g.partner = z.atom_idx))
    SELECT mol_id, m1, m2, m3 FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY m1, m2, m3) AS k FROM m) WHERE k = 1""",
    "ends_v"))
def motif_match(t):
    return og.match_motif(t.atoms, t.bonds, ["C", "N", "O"], [(1, 2), (2, 3)])


@query("motif_reordered", oracle("""
    WITH m AS (SELECT x.mol_id, x.atom_idx AS m1, y.atom_idx AS m2, row_number() OVER (PARTITION BY x.mol_id ORDER BY x.atom_idx, y.atom_idx) AS k
               FROM atoms_v x JOIN ends_v e ON e.mol_id = x.mol_id AND e.atom_idx = x.atom_idx
               JOIN atoms_v y ON y.mol_id = e.mol_id AND y.atom_idx = e.partner WHERE x.element = 'C' AND y.element = 'O')
    SELECT m.mol_id, 1 AS atom_idx, element, round(x, 6) AS x FROM m JOIN atoms_v a ON a.mol_id = m.mol_id AND a.atom_idx = m1 WHERE k = 1
    UNION ALL SELECT m.mol_id, 2, element, round(x, 6) FROM m JOIN atoms_v a ON a.mol_id = m.mol_id AND a.atom_idx = m2 WHERE k = 1""", "ends_v"))
def motif_reordered(t):
    found = og.match_motif(t.atoms, t.bonds, ["C", "O"], [(1, 2)])
    return og.reorder_by_motif(t.atoms, found, 2).select("mol_id", "atom_idx", "element", _r("x"))


@query("ring_opposite_pairs", oracle(_RINGS + """
    SELECT mol_id, pair_no, a, b FROM rings, LATERAL (VALUES (1, r3, 1), (2, r1, r5), (3, r2, r4)) p(pair_no, a, b)""", "ends_v"))
def ring_opposite_pairs(t):
    return og.opposite_pairs(og.six_rings(t.bonds, [1])).select("mol_id", "pair_no", "a", "b")


@query("longest_path", oracle("""
    WITH h AS (SELECT mol_id, atom_idx AS s, atom_idx AS t, 0 AS depth FROM atoms_v
               UNION SELECT h.mol_id, h.s, e.partner, h.depth + 1 FROM h JOIN ends_v e
                 ON e.mol_id = h.mol_id AND e.atom_idx = h.t WHERE h.depth < 12),
    d AS (SELECT mol_id, s, t, min(depth) AS depth FROM h GROUP BY 1, 2, 3)
    SELECT mol_id, max(depth) + 1 AS n_atoms FROM d GROUP BY mol_id""", "ends_v", recursive=True))
def longest_path(t):
    path = og.longest_paths(t.bonds, t.atoms)
    return path.groupBy("mol_id").agg(F.count("*").cast("int").alias("n_atoms"))
