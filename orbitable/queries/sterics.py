"""Steric extents, buried volume and contact scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.operators import neighbours as on
from orbitable.operators import sterimol as ost
from orbitable.queries.registry import oracle, query


def _r(name: str, digits: int = 4):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


# The whole molecule seen from atom 1 towards atom 2; atoms placed without rounding would tie less,
# so both engines compare 3 decimals of sizes.
_BODY = """
    WITH d AS (SELECT mol_id, min(CASE WHEN atom_idx = 2 THEN partner END) AS x2, min(CASE WHEN atom_idx = 1 THEN partner END) AS x1
               FROM (SELECT * FROM ends_v WHERE (atom_idx = 2 AND partner <> 1) OR (atom_idx = 1 AND partner <> 2)) GROUP BY mol_id),
    t AS (SELECT mol_id, coalesce(x2, x1) AS third FROM d),
    o AS (SELECT p.mol_id, p.x AS ox, p.y AS oy, p.z AS oz, q.x AS qx, q.y AS qy, q.z AS qz, r.x AS rx, r.y AS ry, r.z AS rz
          FROM t JOIN atoms_v p ON p.mol_id = t.mol_id AND p.atom_idx = 1 JOIN atoms_v q ON q.mol_id = t.mol_id AND q.atom_idx = 2
          JOIN atoms_v r ON r.mol_id = t.mol_id AND r.atom_idx = t.third),
    f1 AS (SELECT *, sqrt((qx-ox)*(qx-ox)+(qy-oy)*(qy-oy)+(qz-oz)*(qz-oz)) AS ly,
                  sqrt((rx-ox)*(rx-ox)+(ry-oy)*(ry-oy)+(rz-oz)*(rz-oz)) AS lp FROM o),
    f2 AS (SELECT mol_id, ox, oy, oz, (qx-ox)/ly AS yx, (qy-oy)/ly AS yy, (qz-oz)/ly AS yz,
                  (rx-ox)/lp AS px, (ry-oy)/lp AS py, (rz-oz)/lp AS pz FROM f1 WHERE ly > 1e-12 AND lp > 1e-12),
    f3 AS (SELECT *, px*yx+py*yy+pz*yz AS c FROM f2),
    f4 AS (SELECT *, px-c*yx AS ax, py-c*yy AS ay, pz-c*yz AS az FROM f3),
    f5 AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS l FROM f4 WHERE sqrt(ax*ax+ay*ay+az*az) >= 1e-9),
    f6 AS (SELECT *, ax/l AS xx, ay/l AS xy, az/l AS xz FROM f5),
    n AS (SELECT mol_id, atom_idx, count(*) AS n FROM ends_v GROUP BY 1, 2),
    w AS (SELECT a.mol_id, a.atom_idx, x, y, z,
            CASE WHEN element = 'O' THEN CAST(1.35 AS DOUBLE) WHEN element = 'N' THEN CASE WHEN n < 2.5 THEN CAST(1.70 AS DOUBLE) ELSE CAST(1.50 AS DOUBLE) END
                 WHEN element = 'C' THEN CASE WHEN n < 2.5 THEN CAST(1.60 AS DOUBLE) WHEN n < 3.5 THEN CAST(1.70 AS DOUBLE) ELSE CAST(1.50 AS DOUBLE) END
                 WHEN element = 'H' THEN CAST(1.00 AS DOUBLE) WHEN element = 'Cl' THEN CAST(1.80 AS DOUBLE) ELSE CAST(1.92 AS DOUBLE) END AS radius
          FROM atoms_v a JOIN n ON a.mol_id = n.mol_id AND a.atom_idx = n.atom_idx),
    placed AS (SELECT w.mol_id, w.atom_idx, radius,
            xx*(x-ox)+xy*(y-oy)+xz*(z-oz) AS x, yx*(x-ox)+yy*(y-oy)+yz*(z-oz) AS y,
            (xy*yz-xz*yy)*(x-ox)+(xz*yx-xx*yz)*(y-oy)+(xx*yy-xy*yx)*(z-oz) AS z
          FROM w JOIN f6 ON w.mol_id = f6.mol_id)"""

_WALK = """,
    s AS (SELECT mol_id FROM atoms_v WHERE atom_idx IN (1, 2) GROUP BY mol_id HAVING count(*) = 2),
    walk AS (SELECT mol_id, 2 AS atom_idx FROM s
             UNION SELECT k.mol_id, e.partner FROM walk k JOIN ends_v e
               ON e.mol_id = k.mol_id AND e.atom_idx = k.atom_idx WHERE e.partner <> 1),
    member AS (SELECT mol_id, atom_idx FROM walk UNION ALL SELECT mol_id, 1 FROM s),
    inside AS (SELECT DISTINCT e.mol_id, e.atom_idx FROM ends_v e
               JOIN member p ON p.mol_id = e.mol_id AND p.atom_idx = e.atom_idx
               JOIN member q ON q.mol_id = e.mol_id AND q.atom_idx = e.partner),
    chosen AS (SELECT p.* FROM placed p JOIN inside i ON p.mol_id = i.mol_id AND p.atom_idx = i.atom_idx)"""

# The DuckDB twin lays out all 100 outline samples per atom.
_SCAN = """,
    ring AS (SELECT 2 * pi() * CAST(k AS DOUBLE) / 99 AS a FROM range(100) r(k)),
    dots AS (SELECT mol_id, x + radius * cos(a) AS u, z + radius * sin(a) AS w FROM chosen, ring),
    coarse AS (SELECT mol_id, g, least(abs(round(max(cos(radians(g))*u - sin(radians(g))*w), 4)), abs(round(min(cos(radians(g))*u - sin(radians(g))*w), 4)),
                 abs(round(max(sin(radians(g))*u + cos(radians(g))*w), 4)), abs(round(min(sin(radians(g))*u + cos(radians(g))*w), 4))) AS b1
               FROM dots, (VALUES (18), (36), (54), (72), (90)) d(g) GROUP BY mol_id, g),
    start AS (SELECT mol_id, g FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY b1, g) AS k FROM coarse) WHERE k = 1),
    fine AS (SELECT d.mol_id, s.g + f AS g, least(abs(round(max(cos(radians(s.g + f))*u - sin(radians(s.g + f))*w), 4)), abs(round(min(cos(radians(s.g + f))*u - sin(radians(s.g + f))*w), 4)),
                 abs(round(max(sin(radians(s.g + f))*u + cos(radians(s.g + f))*w), 4)), abs(round(min(sin(radians(s.g + f))*u + cos(radians(s.g + f))*w), 4))) AS b1
             FROM dots d JOIN start s ON d.mol_id = s.mol_id, range(-18, 19) e(f) GROUP BY d.mol_id, s.g, f),
    b1s AS (SELECT mol_id, min(b1) AS b1 FROM fine GROUP BY mol_id),
    b5s AS (SELECT mol_id, max(sqrt(u*u + w*w)) AS b5 FROM dots GROUP BY mol_id)
    SELECT c.mol_id, round(b1, 2) AS B1, round(b5, 3) AS B5, round(max(y + radius), 3) AS L
    FROM chosen c JOIN b1s ON b1s.mol_id = c.mol_id JOIN b5s ON b5s.mol_id = c.mol_id GROUP BY c.mol_id, b1, b5"""


@query("steric_extents", oracle(_BODY + _WALK + _SCAN, "ends_v", recursive=True))
def steric_extents(t):
    t.stored("atoms_v")
    placed = ost.substituent_atoms(t.atoms, t.bonds, [(1, 2)], digits=None)
    return ost.extents(placed, digits=9).select("mol_id", _r("B1", 2), _r("B5", 3), _r("L", 3))


@query("steric_length", oracle(_BODY + _WALK + """
    SELECT mol_id, count(*) AS n_atoms, round(max(y + radius), 3) AS L FROM chosen GROUP BY mol_id""", "ends_v", recursive=True))
def steric_length(t):
    return ost.substituent_atoms(t.atoms, t.bonds, [(1, 2)], digits=None).groupBy("mol_id").agg(
        F.count("*").alias("n_atoms"), F.round(F.max(F.col("y") + F.col("radius")), 3).alias("L"))


@query("buried_volume", oracle("""
    WITH ax AS (SELECT (CAST(i AS DOUBLE) + 0.5) * 0.5 AS v FROM range(-7, 8) r(i)),
    grid AS (SELECT a.v AS dx, b.v AS dy, c.v AS dz, CASE WHEN a.v > 0 THEN 1 ELSE 0 END + CASE WHEN b.v > 0 THEN 2 ELSE 0 END
                    + CASE WHEN c.v > 0 THEN 4 ELSE 0 END AS octant
             FROM ax a, ax b, ax c WHERE a.v * a.v + b.v * b.v + c.v * c.v <= 12.25),
    p AS (SELECT mol_id, octant, x + dx AS x, y + dy AS y, z + dz AS z, row_number() OVER () AS k FROM atoms_v, grid WHERE atom_idx = 1),
    s AS (SELECT mol_id, x, y, z, r * CAST(1.17 AS DOUBLE) AS r FROM atoms_v
          JOIN (SELECT e, CAST(r AS DOUBLE) AS r FROM (VALUES ('C', 1.70), ('N', 1.55), ('O', 1.52), ('Cl', 1.75)) v(e, r)) ON e = element WHERE atom_idx <> 1),
    hit AS (SELECT DISTINCT p.k FROM p JOIN s ON p.mol_id = s.mol_id AND (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) <= s.r * s.r)
    SELECT mol_id, octant, count(*) AS points, count(hit.k) AS buried, round(100 * count(hit.k) / count(*), 4) + 0.0 AS percent
    FROM p LEFT JOIN hit ON p.k = hit.k GROUP BY mol_id, octant""", "atoms_v"))
def buried_volume(t):
    return ost.buried_volume(t.atoms, [1], radius=3.5, step=0.5).select(
        "mol_id", "octant", "points", "buried", _r("percent"))


def _interval_twin(radii, step: float, final: str) -> str:
    """Lattice columns met by the spheres, z intervals of either side, and what each adds to the union of those before it."""
    n = int(max(radii) / step) + 2
    return oracle(f"""
    WITH ax AS (SELECT i, (CAST(i AS DOUBLE) + 0.5) * {step} AS v FROM range(-{n}, {n}) r(i)),
    ball AS (SELECT CAST(radius AS DOUBLE) AS radius FROM (VALUES {", ".join(f"({float(r)})" for r in radii)}) t(radius)),
    grid AS (SELECT radius, a.i AS ix, b.i AS iy, a.v AS px, b.v AS py, sqrt(radius * radius - a.v * a.v - b.v * b.v) AS reach
             FROM ball, ax a, ax b WHERE a.v * a.v + b.v * b.v <= radius * radius),
    total AS (SELECT radius, CAST(sum(CAST(floor(reach / {step} - 0.5) AS BIGINT) + 1) AS BIGINT) // 4 AS points FROM grid GROUP BY radius),
    o AS (SELECT mol_id, x AS x0, y AS y0, z AS z0 FROM atoms_v WHERE atom_idx = 1),
    s AS (SELECT mol_id, atom_idx, x - x0 AS x, y - y0 AS y, z - z0 AS z, r * CAST(1.17 AS DOUBLE) AS r FROM atoms_v JOIN o USING (mol_id)
          JOIN (SELECT e, CAST(r AS DOUBLE) AS r FROM (VALUES ('C', 1.70), ('N', 1.55), ('O', 1.52), ('Cl', 1.75)) v(e, r)) ON e = element WHERE atom_idx <> 1),
    c AS (SELECT mol_id, radius, ix, iy, z, reach, sqrt(r * r - (px - x) * (px - x) - (py - y) * (py - y)) AS half
          FROM s, grid WHERE (px - x) * (px - x) + (py - y) * (py - y) <= r * r),
    i AS (SELECT mol_id, radius, ix, iy, CAST(ceil(greatest(z - half, -reach) / {step} - 0.5) AS BIGINT) AS low,
                 CAST(floor(least(z + half, reach) / {step} - 0.5) AS BIGINT) AS high FROM c),
    side AS (SELECT mol_id, radius, ix, iy, 0 AS up, low, least(high, -1) AS high FROM i WHERE low <= least(high, -1)
             UNION ALL SELECT mol_id, radius, ix, iy, 1, greatest(low, 0), high FROM i WHERE greatest(low, 0) <= high),
    u AS (SELECT *, max(high) OVER (PARTITION BY mol_id, radius, ix, iy, up ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM side),
    k AS (SELECT mol_id, radius, CASE WHEN ix >= 0 THEN 1 ELSE 0 END + CASE WHEN iy >= 0 THEN 2 ELSE 0 END AS quadrant, up,
                 sum(greatest(high - greatest(low - 1, coalesce(before, low - 1)), 0)) AS buried FROM u GROUP BY ALL),
    q AS (SELECT mol_id, radius, quadrant, up, coalesce(CAST(buried AS BIGINT), 0) AS buried, points
          FROM o JOIN total ON true JOIN (SELECT j % 4 AS quadrant, j // 4 AS up FROM range(8) t(j)) ON true LEFT JOIN k USING (mol_id, radius, quadrant, up))
    {final}""", "atoms_v")


@query("buried_volume_fine", _interval_twin([3.5], 0.1, """
    SELECT mol_id, CAST(quadrant + 4 * up AS INT) AS octant, points, buried, round(100 * buried / points, 4) + 0.0 AS percent FROM q"""))
def buried_volume_fine(t):
    return ost.buried_volume(t.atoms, [1], radius=3.5, step=0.1).select("mol_id", "octant", "points", "buried", _r("percent"))


@query("buried_shells", _interval_twin([3.5, 5.5], 0.25, """
    SELECT mol_id, radius, CAST(quadrant AS INT) AS quadrant, round(100 * sum(buried) / sum(points), 4) + 0.0 AS percent,
           round(sum(buried) * 0.015625, 4) + 0.0 AS buried_volume, round(sum(points - buried) * 0.015625, 4) + 0.0 AS free_volume
    FROM q GROUP BY GROUPING SETS ((mol_id, radius, quadrant), (mol_id, radius))"""))
def buried_shells(t):
    return ost.buried_shells(t.atoms, [1], (3.5, 5.5), 0.25).select(
        "mol_id", "radius", "quadrant", _r("percent"), _r("buried_volume"), _r("free_volume"))


@query("contact_score", oracle("""
    WITH r(e, r) AS (VALUES ('H', 0.31), ('C', 0.76), ('N', 0.71), ('O', 0.66), ('Cl', 1.02), ('Pd', 1.39)),
    p AS (SELECT q.mol_id, q.atom_idx AS candidate_id,
                 greatest(CAST(r1.r AS DOUBLE) + CAST(r2.r AS DOUBLE) + 0.2 - sqrt((q.x-h.x)*(q.x-h.x)+(q.y-h.y)*(q.y-h.y)+(q.z-h.z)*(q.z-h.z)), 0) AS o
          FROM atoms_v q JOIN r r1 ON q.element = r1.e
          LEFT JOIN (SELECT * FROM atoms_v WHERE element = 'C') h ON h.mol_id = q.mol_id
          LEFT JOIN r r2 ON h.element = r2.e WHERE q.element = 'O')
    SELECT mol_id, candidate_id, round(-coalesce(sum(o * o), 0), 6) + 0.0 AS score FROM p GROUP BY 1, 2""", "atoms_v"))
def contact_score(t):
    candidates = t.atoms.where("element = 'O'").withColumn("candidate_id", F.col("atom_idx"))
    return on.clash_score(candidates, t.atoms.where("element = 'C'")).select("mol_id", "candidate_id", _r("score", 6))


@query("nearest_carbon", oracle("""
    SELECT mol_id, point_id, atom_idx, round(round(dist, 9), 6) AS dist FROM (
        SELECT p.mol_id, p.atom_idx AS point_id, q.atom_idx, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS dist,
               row_number() OVER (PARTITION BY p.mol_id, p.atom_idx ORDER BY round((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z), 9), q.atom_idx) AS k
        FROM atoms_v p JOIN atoms_v q ON p.mol_id = q.mol_id WHERE p.element <> 'C' AND q.element = 'C') WHERE k = 1""", "atoms_v"))
def nearest_carbon(t):
    points = t.atoms.where("element <> 'C'").withColumnRenamed("atom_idx", "point_id")
    return on.nearest_atom(points, t.atoms.where("element = 'C'")).select("mol_id", "point_id", "atom_idx", _r("dist", 6))


@query("mutual_nearest", oracle("""
    WITH d AS (SELECT p.mol_id, p.atom_idx AS l, q.atom_idx AS r, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS dist
               FROM atoms_v p JOIN atoms_v q ON p.mol_id = q.mol_id WHERE p.element IN ('C', 'H') AND q.element IN ('N', 'O')),
    k AS (SELECT *, row_number() OVER (PARTITION BY mol_id, l ORDER BY round(dist, 9), r) AS a,
                 row_number() OVER (PARTITION BY mol_id, r ORDER BY round(dist, 9), l) AS b FROM d WHERE dist <= 1.2)
    SELECT mol_id, l AS left_idx, r AS right_idx, round(round(dist, 9), 6) AS dist FROM k WHERE a = 1 AND b = 1""", "atoms_v"))
def mutual_nearest(t):
    left, right = t.atoms.where("element IN ('C', 'H')"), t.atoms.where("element IN ('N', 'O')")
    return on.mutual_nearest(left, right, 1.2).select("mol_id", "left_idx", "right_idx", _r("dist", 6))


@query("alignment_loss", oracle("""
    WITH d AS (SELECT p.mol_id, p.atom_idx, min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))) AS d
               FROM atoms_v p JOIN atoms_v q ON p.mol_id = q.mol_id WHERE p.element <> 'C' AND q.element = 'C' GROUP BY 1, 2)
    SELECT mol_id, round(sum(1 - 2 / (1 + exp(20 * d)) + 5 * d), 5) AS loss FROM d GROUP BY mol_id""", "atoms_v"))
def alignment_loss(t):
    points = t.atoms.where("element <> 'C'").withColumnRenamed("atom_idx", "point_id")
    return on.alignment_loss(points, t.atoms.where("element = 'C'")).select("mol_id", _r("loss", 5))


@query("cube_extents", None)
def cube_extents(t):
    from orbitable.queries.texts import _cube_text
    from orbitable.sources import grid as sg

    t.stored("atoms_v")
    points = sg.surface_points(sg.cube_grid(_cube_text(t)), 0.0031)
    return ost.cube_sterimol(points, t.atoms, t.bonds, [(1, 2)])
