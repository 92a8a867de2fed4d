"""Vibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.operators import graph as og
from orbitable.operators import vibrations as ov
from orbitable.queries.molecules import _RINGS
from orbitable.queries.registry import oracle, query


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


def _best(rows: str, keys: str = "mol_id, spec_id") -> str:
    return f"""SELECT {keys}, mode_idx, frequency, round(amplitude, 6) AS amplitude FROM (SELECT *, row_number() OVER (
        PARTITION BY {keys} ORDER BY round(amplitude, 9) DESC, mode_idx) AS k FROM {rows}) WHERE k = 1"""


@query("mode_displacements", oracle("""
    SELECT d.mol_id, mode_idx, atom_idx, frequency, round(sqrt(dx*dx+dy*dy+dz*dz), 6) AS size
    FROM displacements_v d JOIN modes_v m USING (mol_id, mode_idx)""", "displacements_v", "modes_v"))
def mode_displacements(t):
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return ov.aligned(t.modes, t.displacements).select(
        "mol_id", "mode_idx", "atom_idx", "frequency", F.round(size, 6).alias("size"))


@query("mode_window", oracle("""
    SELECT mol_id, mode_idx, frequency, ir FROM modes_v WHERE frequency > 1600 AND frequency < 3500""", "modes_v"))
def mode_window(t):
    return ov.in_window(t.modes, 1600, 3500).select("mol_id", "mode_idx", "frequency", "ir")


@query("mode_groups", oracle("""
    SELECT mol_id, mode_idx, frequency, count(*) AS n_atoms, round(sum(sqrt(dx*dx+dy*dy+dz*dz)), 6) AS total
    FROM displacements_v JOIN modes_v USING (mol_id, mode_idx) GROUP BY 1, 2, 3""", "displacements_v", "modes_v"))
def mode_groups(t):
    return ov.mode_sizes(t.modes, t.displacements).select("mol_id", "mode_idx", "frequency", "n_atoms", _r("total"))


@query("imaginary_frequency", oracle("""
    SELECT mol_id, min(frequency) < 0 AS imaginary, min(frequency) AS lowest FROM modes_v GROUP BY mol_id""", "modes_v"))
def imaginary_frequency(t):
    return ov.imaginary_frequency(t.modes)


@query("stretch_vibration", oracle("""
    WITH p AS (SELECT a.mol_id, a.x-b.x AS bx, a.y-b.y AS b2, a.z-b.z AS b3,
                      EXISTS (SELECT 1 FROM bonds_v k WHERE k.mol_id = a.mol_id AND k.a = 1 AND k.b = 2) AS bonded
               FROM atoms_v a JOIN atoms_v b ON a.mol_id = b.mol_id AND a.atom_idx = 1 AND b.atom_idx = 2),
    s AS (SELECT p.mol_id, 1 AS spec_id, d.mode_idx, m.frequency,
                 abs(d.dx*bx+d.dy*b2+d.dz*b3) + abs(e.dx*bx+e.dy*b2+e.dz*b3) AS amplitude
          FROM p JOIN displacements_v d ON d.mol_id = p.mol_id AND d.atom_idx = 1
          JOIN displacements_v e ON e.mol_id = p.mol_id AND e.atom_idx = 2 AND e.mode_idx = d.mode_idx
          JOIN modes_v m ON m.mol_id = p.mol_id AND m.mode_idx = d.mode_idx
          WHERE bonded AND frequency > 1600 AND frequency < 3500),
    b AS (""" + _best("s") + """)
    SELECT p.mol_id, 1 AS spec_id, mode_idx, frequency, amplitude FROM p LEFT JOIN b ON b.mol_id = p.mol_id""",
    "bonds_v", "displacements_v", "modes_v"))
def stretch_vibration(t):
    return ov.stretches(t.atoms, t.bonds, t.modes, t.displacements, [(1, 2)]).select(
        "mol_id", "spec_id", "mode_idx", "frequency", _r("amplitude"))


@query("bend_vibration", oracle("""
    WITH c AS (SELECT DISTINCT p.mol_id FROM ends_v p JOIN ends_v q ON p.mol_id = q.mol_id AND p.partner = q.partner
               WHERE p.atom_idx = 1 AND q.atom_idx = 3),
    s AS (SELECT d.mol_id, 1 AS spec_id, d.mode_idx, frequency,
                 sqrt(pow(d.dy*e.dz-d.dz*e.dy, 2) + pow(d.dz*e.dx-d.dx*e.dz, 2) + pow(d.dx*e.dy-d.dy*e.dx, 2)) AS amplitude
          FROM c JOIN displacements_v d ON d.mol_id = c.mol_id AND d.atom_idx = 1
          JOIN displacements_v e ON e.mol_id = c.mol_id AND e.atom_idx = 3 AND e.mode_idx = d.mode_idx
          JOIN modes_v m ON m.mol_id = c.mol_id AND m.mode_idx = d.mode_idx WHERE frequency > 1300)
    """ + _best("s"), "ends_v", "displacements_v", "modes_v"))
def bend_vibration(t):
    return ov.bends(t.bonds, t.modes, t.displacements, [(1, 3)]).select(
        "mol_id", "spec_id", "mode_idx", "frequency", _r("amplitude"))


@query("strongest_mode", oracle("""
    WITH s AS (SELECT mol_id, mode_idx, frequency, sum(sqrt(dx*dx+dy*dy+dz*dz)) AS amplitude
               FROM displacements_v JOIN modes_v USING (mol_id, mode_idx)
               WHERE atom_idx IN (1, 2) AND frequency > 1500 GROUP BY 1, 2, 3)
    """ + _best("s", "mol_id"), "displacements_v", "modes_v"))
def strongest_mode(t):
    return ov.strongest_by_displacement(t.modes, t.displacements, [1, 2]).select(
        "mol_id", "mode_idx", "frequency", _r("amplitude"))


_RING_MODES = _RINGS + """,
    slots AS (SELECT mol_id, unnest([1, r1, r2, r3, r4, r5]) AS atom_idx, unnest([0, 1, 2, 3, 4, 5]) AS slot FROM rings),
    sums AS (SELECT d.mol_id, d.mode_idx,
        sum(dx) FILTER (slot % 2 = 1) AS ox, sum(dy) FILTER (slot % 2 = 1) AS oy, sum(dz) FILTER (slot % 2 = 1) AS oz,
        sum(dx) FILTER (slot % 2 = 0) AS ex, sum(dy) FILTER (slot % 2 = 0) AS ey, sum(dz) FILTER (slot % 2 = 0) AS ez
        FROM displacements_v d JOIN slots s ON s.mol_id = d.mol_id AND s.atom_idx = d.atom_idx GROUP BY 1, 2),
    axis AS (SELECT p.mol_id, p.x-q.x AS ax, p.y-q.y AS ay, p.z-q.z AS az FROM slots s
        JOIN atoms_v p ON p.mol_id = s.mol_id AND p.atom_idx = s.atom_idx AND s.slot = 0
        JOIN slots u ON u.mol_id = s.mol_id AND u.slot = 3 JOIN atoms_v q ON q.mol_id = u.mol_id AND q.atom_idx = u.atom_idx),
    rm AS (SELECT s.mol_id, s.mode_idx, frequency, ox*ex+oy*ey+oz*ez AS product,
        CASE WHEN ex*ex+ey*ey+ez*ez > 1e-12 AND ax*ax+ay*ay+az*az > 1e-12 THEN
          abs(sin(acos(least(1.0, greatest(-1.0, (ex*ax+ey*ay+ez*az) / sqrt((ex*ex+ey*ey+ez*ez)*(ax*ax+ay*ay+az*az))))))) END AS sine
        FROM sums s JOIN modes_v m ON m.mol_id = s.mol_id AND m.mode_idx = s.mode_idx JOIN axis a ON a.mol_id = s.mol_id)"""


@query("ring_modes", oracle(_RING_MODES + """
    SELECT mol_id, mode_idx, frequency, round(product, 6) + 0.0 AS product, round(sine, 5) + 0.0 AS sine FROM rm""",
    "ends_v", "displacements_v", "modes_v"))
def ring_modes(t):
    rings = og.six_rings(t.bonds, [1])
    return ov.ring_modes(t.atoms, rings, t.modes, t.displacements).select(
        "mol_id", "mode_idx", "frequency", _r("product"), _r("sine", 5))


@query("ring_mode_filter", oracle(_RING_MODES + """
    SELECT mol_id, mode_idx, frequency FROM rm WHERE abs(product) > 0.01 AND frequency > 1200 AND frequency < 3000""",
    "ends_v", "displacements_v", "modes_v"))
def ring_mode_filter(t):
    rings = og.six_rings(t.bonds, [1])
    rows = ov.ring_modes(t.atoms, rings, t.modes, t.displacements)
    return ov.ring_filter(rows, 0.01, 1200, 3000).select("mol_id", "mode_idx", "frequency")


@query("ring_vibration", oracle(_RING_MODES + """
    , f AS (SELECT *, round(sine, 9) AS s FROM rm WHERE abs(product) > 0.01 AND frequency > 1200 AND frequency < 3000 AND sine IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY s, mode_idx) AS lo,
                 row_number() OVER (PARTITION BY mol_id ORDER BY s DESC, mode_idx) AS hi FROM f)
    SELECT mol_id, max(frequency) FILTER (lo = 1) AS "cross", max(frequency) FILTER (hi = 1) AS para,
           round(degrees(asin(least(max(s) FILTER (lo = 1), 1))), 3) + 0.0 AS cross_angle,
           round(degrees(asin(least(max(s) FILTER (hi = 1), 1))), 3) + 0.0 AS para_angle
    FROM k GROUP BY mol_id""", "ends_v", "displacements_v", "modes_v"))
def ring_vibration(t):
    rings = og.six_rings(t.bonds, [1])
    return ov.ring_vibrations(t.atoms, rings, t.modes, t.displacements, 1200, 3000).select(
        "mol_id", "cross", "para", _r("cross_angle", 3), _r("para_angle", 3))


@query("similar_amplitude_atoms", oracle("""
    WITH b AS (SELECT p.mol_id, p.x-q.x AS x, p.y-q.y AS y, p.z-q.z AS z FROM atoms_v p JOIN atoms_v q
               ON p.mol_id = q.mol_id AND p.atom_idx = 1 AND q.atom_idx = 2),
    l AS (SELECT *, sqrt(x*x+y*y+z*z) AS len FROM b),
    m AS (SELECT d.mol_id, d.mode_idx, d.atom_idx, abs(dx*x+dy*y+dz*z) / len AS amp
          FROM displacements_v d JOIN l ON d.mol_id = l.mol_id WHERE len > 1e-12),
    p AS (SELECT mol_id, mode_idx, sum(amp) AS pair FROM m WHERE atom_idx IN (1, 2) GROUP BY 1, 2)
    SELECT m.mol_id, m.mode_idx, m.atom_idx, round(amp, 6) AS amplitude, round(pair, 6) AS pair_amplitude
    FROM m JOIN p ON m.mol_id = p.mol_id AND m.mode_idx = p.mode_idx
    WHERE m.atom_idx NOT IN (1, 2) AND abs(amp - pair) <= 1e-8 + 0.1 * abs(pair)""", "displacements_v"))
def similar_amplitude_atoms(t):
    return ov.similar_atoms(t.atoms, t.modes, t.displacements, (1, 2)).select(
        "mol_id", "mode_idx", "atom_idx", _r("amplitude"), _r("pair_amplitude"))


@query("pair_symmetry", oracle("""
    WITH p AS (SELECT d.mol_id, d.mode_idx, d.dx*e.dx+d.dy*e.dy+d.dz*e.dz AS dot,
                      sqrt((d.dx*d.dx+d.dy*d.dy+d.dz*d.dz)*(e.dx*e.dx+e.dy*e.dy+e.dz*e.dz)) AS l
               FROM displacements_v d JOIN displacements_v e ON d.mol_id = e.mol_id AND d.mode_idx = e.mode_idx
                 AND d.atom_idx = 1 AND e.atom_idx = 2)
    SELECT mol_id, mode_idx, round(CASE WHEN l > 0 THEN dot / l ELSE 0 END, 6) + 0.0 AS cosine,
           CASE WHEN l > 0 AND dot > 0 THEN 'asymmetric' WHEN l > 0 AND dot < 0 THEN 'symmetric' ELSE 'unclear' END AS kind FROM p""",
    "displacements_v"))
def pair_symmetry(t):
    return ov.pair_symmetry(t.displacements, [(1, 2)]).select("mol_id", "mode_idx", _r("cosine"), "kind")
