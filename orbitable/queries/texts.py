"""Text round trips: logs and XYZ text are written from the atoms and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.functions import elements as el
from orbitable.functions import energy as fe
from orbitable.functions import labels as fl
from orbitable.queries.registry import oracle, query
from orbitable.sources import grid as sg
from orbitable.sources import logs as sl
from orbitable.sources import xyz as sx


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


def _block(rows, line, key="mol_id", order="atom_idx"):
    """mol_id, body: the lines of a molecule in order."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda s: s["l"]), "\n").alias("body"))


def _num(c, digits: int = 6):
    return F.format_string(f"%.{digits}f", c)


def _gap(*parts):
    return F.concat_ws("   ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


CUT = "-" * 69


def geometry_text(t):
    z = el.lookup({s: n for n, s in enumerate(el.SYMBOLS, 1)}, F.col("element")).cast("string")
    line = _gap(F.col("atom_idx").cast("string"), z, "0", _num("x"), _num("y"), _num("z"))
    head = f"Standard orientation:\n{CUT}\n Center Atomic Atomic Coordinates\n Number Number Type X Y Z\n{CUT}\n"
    return _block(t.atoms, line).select("mol_id", F.concat(F.lit("Input\n" + head + "9 9 9 9.0 9.0 9.0\n" + CUT + "\n" + head), F.col("body"), F.lit("\n" + CUT + "\nend 1.0")).alias("text"))


@query("log_geometry", oracle("""
    SELECT mol_id, atom_idx, element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM atoms_v""", "atoms_v"))
def log_geometry(t):
    return sl.geometry(geometry_text(t)).select("mol_id", "atom_idx", "element", _r("x"), _r("y"), _r("z"))


@query("log_population_charges", oracle("""
    SELECT mol_id, atom_idx, round(q, 5) + 0.0 AS charge FROM (SELECT mol_id, atom_idx, CAST(q AS DOUBLE) AS q FROM atoms_v)""", "atoms_v"))
def log_population_charges(t):
    rows = t.view("atoms_v")
    line = _gap("X", F.col("atom_idx").cast("string"), _num(F.col("q").cast("double"), 5), "1.99950", "4.00000", "0.01000", "6.01000")
    text = _block(rows, line).select("mol_id", F.concat(F.lit("Summary of old\n1 2.0\n=====\nSummary of Natural Population Analysis:\n"), "body", F.lit("\n" + "=" * 71 + "\n * Total *  0.0")).alias("text"))
    return sl.population_charges(text).select("mol_id", "atom_idx", _r("charge", 5))


@query("log_hirshfeld_charges", oracle("""
    SELECT mol_id, atom_idx, 'hirshfeld' AS scheme, round(x - 1, 6) + 0.0 AS charge FROM atoms_v
    UNION ALL SELECT mol_id, atom_idx, 'cm5', round(z - 1, 6) + 0.0 FROM atoms_v""", "atoms_v"))
def log_hirshfeld_charges(t):
    line = _gap(F.col("atom_idx").cast("string"), F.col("element"), _num(F.col("x") - 1), "0.100000", "0.200000", "0.300000", "0.400000", _num(F.col("z") - 1))
    text = _block(t.atoms, line).select("mol_id", F.concat(F.lit("Hirshfeld charges, spin densities, dipoles, and CM5 charges:\n"), "body", F.lit("\nHirshfeld charges with hydrogens summed into heavy atoms:\n 1 9.0 9.0")).alias("text"))
    return sl.hirshfeld_charges(text).select("mol_id", "atom_idx", "scheme", _r("charge"))


@query("log_scalars", oracle("""
    SELECT mol_id, round(dip_x, 4) + 0.0 AS dip_x, round(dip_y, 4) + 0.0 AS dip_y, round(dip_z, 4) + 0.0 AS dip_z,
           round(iso, 4) AS iso, round(aniso, 4) AS aniso, false AS pol_missing FROM scalars_v""", "scalars_v"))
def log_scalars(t):
    s = t.scalars
    d = [_num(c, 4) for c in ("dip_x", "dip_y", "dip_z")]
    text = s.select("mol_id", F.concat(
        F.lit("Dipole moment (field-independent basis, Debye):\n"), _gap("X=", d[0], "Y=", d[1], "Z=", d[2], "Tot=", "1.0000"),
        F.lit("\nQuadrupole moment\n Polarizability\n iso "), _gap(_num(F.col("iso") / 1000, 7), "0.1", "0.2", "0.3", "0.4", _num(F.col("aniso") / 1000, 7), "0.5"),
        F.lit("\n xx 1.0\n")).alias("text"))
    return sl.dipoles(text).join(sl.polarizabilities(text), "mol_id").select(
        "mol_id", _r("dip_x", 4), _r("dip_y", 4), _r("dip_z", 4), _r("iso", 4), _r("aniso", 4), "pol_missing")


def modes_text(t):
    """Three modes per block; numbers 7-9 hold the intensities."""
    at = lambda k, c: F.max(F.when(F.col("mode_idx") == k, F.col(c)))
    head = t.modes.groupBy("mol_id").agg(*[at(k, "frequency").alias(f"f{k}") for k in (1, 2, 3)], *[at(k, "ir").alias(f"i{k}") for k in (1, 2, 3)])
    d = t.displacements
    wide = d.groupBy("mol_id", "atom_idx").agg(*[at(k, c).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("dx", "dy", "dz")])
    line = _gap(F.col("atom_idx").cast("string"), "6", *[_num(f"{c}{k}", 2) for k in (1, 2, 3) for c in ("dx", "dy", "dz")])
    body = _block(wide, line)
    three = lambda p, n=4: _gap(*[_num(f"{p}{k}", n) for k in (1, 2, 3)])
    return head.join(body, "mol_id").select("mol_id", F.concat(
        F.lit("Harmonic frequencies (cm**-1)\n 1 2 3\n Frequencies -- "), three("f"), F.lit("\n Red. masses -- 1.0 1.0 1.0\n IR -- "), three("i"),
        F.lit("\n Other -- 2.0 2.0 2.0\n Atom AN X Y Z X Y Z X Y Z\n"), "body", F.lit("\n" + "-" * 19 + "\n Thermochemistry 298.15")).alias("text"))


@query("log_modes", oracle("""
    SELECT mol_id, CAST(mode_idx AS INT) AS mode_idx, round(frequency, 4) AS frequency, round(ir, 4) AS ir FROM modes_v""", "modes_v"))
def log_modes(t):
    return sl.modes(modes_text(t)).select("mol_id", F.col("mode_idx").cast("int"), _r("frequency", 4), _r("ir", 4))


@query("log_displacements", oracle("""
    SELECT mol_id, CAST(mode_idx AS INT) AS mode_idx, atom_idx, round(dx, 2) + 0.0 AS dx, round(dy, 2) + 0.0 AS dy, round(dz, 2) + 0.0 AS dz
    FROM displacements_v""", "displacements_v"))
def log_displacements(t):
    return sl.displacements(modes_text(t)).select("mol_id", F.col("mode_idx").cast("int"), "atom_idx", _r("dx", 2), _r("dy", 2), _r("dz", 2))


@query("log_frontier_gap", """
    SELECT o_orderkey AS mol_id, round((o_totalprice / 1000000 + 0.25) * 27.2114, 6) AS homo_lumo_gap_ev FROM orders""")
def log_frontier_gap(t):
    gap = _num(F.col("o_totalprice") / 1000000, 10)
    text = t.table("orders").select(F.col("o_orderkey").alias("mol_id"), F.concat(
        F.lit("Alpha  occ. eigenvalues -- -9.0 -8.0\nAlpha virt. eigenvalues -- 5.0\nAlpha  occ. eigenvalues -- -0.90 -0.25000\nAlpha virt. eigenvalues -- "),
        gap, F.lit(" 3.0\n")).alias("text"))
    return sl.frontier_gaps(text).select("mol_id", _r("homo_lumo_gap_ev"))


@query("log_listed_bonds", oracle("""
    SELECT mol_id, atom_idx AS a, atom_idx + 1 AS b FROM atoms_v""", "atoms_v"))
def log_listed_bonds(t):
    line = F.concat(F.lit("! R1 R("), F.col("atom_idx").cast("string"), F.lit(","), (F.col("atom_idx") + 1).cast("string"), F.lit(") 1.4 !"))
    return sl.listed_bonds(_block(t.atoms, line).withColumnRenamed("body", "text"))


def _orders_text(t):
    i = F.col("atom_idx").cast("string")
    j = (F.col("atom_idx") + 1).cast("string")
    line = F.concat(F.lit(" 1. BD ( 1) C "), i, F.lit(" - C "), j, F.lit("  1.98\n 2. BD ( 2) C "), i, F.lit(" - C "), j, F.lit("  1.90\n 3. LP ( 1) C "), i, F.lit("  1.8"))
    return _block(t.atoms, line).select("mol_id", F.concat(F.lit("Natural Bond Orbitals (Summary):\n"), "body", F.lit("\n 9. RY*( 1) C 1\n BD ( 3) C 1 - C 2")).alias("text"))


@query("log_bond_orders", oracle("SELECT mol_id, atom_idx AS a, atom_idx + 1 AS b, 2 AS bond_order FROM atoms_v", "atoms_v"))
def log_bond_orders(t):
    return sl.bond_orders(_orders_text(t))[0]


@query("formal_charges", oracle("""
    WITH v AS (SELECT mol_id, atom_idx, element, max(atom_idx) OVER (PARTITION BY mol_id) AS top FROM atoms_v)
    SELECT mol_id, atom_idx, CAST(CASE element WHEN 'H' THEN 1 WHEN 'C' THEN 4 WHEN 'N' THEN 5 WHEN 'O' THEN 6 WHEN 'Cl' THEN 7 END
           - 2 - CASE WHEN atom_idx = 1 THEN 2 ELSE 4 END AS BIGINT) AS formal_charge FROM v""", "atoms_v"))
def formal_charges(t):
    _, by_atom = sl.bond_orders(_orders_text(t))
    return sl.formal_charges(by_atom, t.atoms)


@query("log_report", oracle("""
    SELECT mol_id, 6 AS n_missing FROM (SELECT DISTINCT mol_id FROM atoms_v)""", "atoms_v"))
def log_report(t):
    return sl.extract_all(geometry_text(t))["report"].select("mol_id", F.size("missing_blocks").alias("n_missing"))


@query("xyz_round_trip", oracle("""
    SELECT mol_id, atom_idx, element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM atoms_v""", "atoms_v"))
def xyz_round_trip(t):
    atoms, _ = sx.parse_xyz(sx.xyz_text(t.atoms))
    return atoms.select("mol_id", "atom_idx", "element", _r("x"), _r("y"), _r("z"))


@query("xyz_rejected", oracle("""
    SELECT mol_id, 'failed' AS status, 'atom count differs' AS error FROM atoms_v WHERE atom_idx = 4""", "atoms_v"))
def xyz_rejected(t):
    texts = sx.xyz_text(t.atoms)
    big = t.atoms.where("atom_idx = 4").select("mol_id", F.lit(True).alias("big"))
    cut = F.when(F.col("big"), F.regexp_replace("text", r"\n[^\n]*$", "")).otherwise(F.col("text"))
    return sx.parse_xyz(texts.join(big, "mol_id", "left").select("mol_id", cut.alias("text")))[1]


@query("xyz_frames", oracle("""
    SELECT mol_id, frame, atom_idx, element, round(x, 6) AS x FROM atoms_v, (SELECT unnest([0, 1]) AS frame)""", "atoms_v"))
def xyz_frames(t):
    twice = sx.xyz_text(t.atoms).select("mol_id", F.concat("text", F.lit("\n"), "text").alias("text"))
    return sx.xyz_rows(twice).select("mol_id", "frame", "atom_idx", "element", _r("x"))


@query("xyz_lines", oracle("""
    SELECT mol_id, count(*) + 2 AS n_lines FROM atoms_v GROUP BY mol_id""", "atoms_v"))
def xyz_lines(t):
    return sx.xyz_lines(t.atoms).groupBy("mol_id").agg(F.count("*").alias("n_lines"))


def _cube_text(t):
    """A 3 x 2 x 2 grid per molecule whose densities follow from the molecule number."""
    dens = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.format_string("%.5f", F.pmod(F.col("mol_id") + i.cast("long"), F.lit(5)) * 0.0011)), " ")
    z = el.lookup({s: n for n, s in enumerate(el.SYMBOLS, 1)}, F.col("element")).cast("string")
    lines = F.sort_array(F.collect_list(F.struct(F.col("atom_idx").alias("o"), _gap(z, "0.0", _num("x"), _num("y"), _num("z")).alias("l"))))
    whole = t.atoms.where("mol_id IS NOT NULL").groupBy("mol_id").agg(F.count("*").cast("string").alias("n"), lines.alias("lines"))
    body = F.array_join(F.transform("lines", lambda s: s["l"]), "\n")
    return whole.select("mol_id", F.concat(
        F.lit("title\ncomment\n"), "n", F.lit(" -1.0 -2.0 -3.0\n3 0.5 0.0 0.0\n2 0.0 0.25 0.0\n2 0.0 0.0 0.125\n"), body, F.lit("\n"), dens).alias("text"))


@query("cube_surface", oracle("""
    WITH g AS (SELECT mol_id, p // 4 AS ix, (p // 2) % 2 AS iy, p % 2 AS iz, round(((mol_id + p) % 5) * 0.0011, 5) AS d
               FROM (SELECT DISTINCT mol_id FROM atoms_v), range(12) r(p))
    SELECT mol_id, round(CAST(-1.0 + (ix + 1) * 0.5 AS DOUBLE) * 0.529177249, 5) + 0.0 AS x, round(CAST(-2.0 + (iy + 1) * 0.25 AS DOUBLE) * 0.529177249, 5) AS y,
           round(CAST(-3.0 + (iz + 1) * 0.125 AS DOUBLE) * 0.529177249, 5) AS z FROM g WHERE d >= 0.003 AND d <= 0.0034""", "atoms_v"))
def cube_surface(t):
    grid = sg.cube_grid(_cube_text(t))
    return sg.surface_points(grid, 0.0031).select("mol_id", _r("x", 5), _r("y", 5), _r("z", 5))


@query("cube_atoms", oracle("""
    SELECT mol_id, atom_idx, element, round(round(x, 6) * 0.529177249, 5) AS x FROM atoms_v""", "atoms_v"))
def cube_atoms(t):
    return sg.cube_atoms(_cube_text(t)).select("mol_id", "atom_idx", "element", _r("x", 5))


@query("spec_text_parsed", """
    SELECT o_orderkey AS id, unnest([o_custkey % 9 + 1, 4]) AS a, unnest([2, o_custkey % 5 + 1]) AS b, unnest([0, 1]) AS pos FROM orders""")
def spec_text_parsed(t):
    c = F.col("o_custkey")
    text = F.concat((c % 9 + 1).cast("string"), F.lit(",2 4,"), (c % 5 + 1).cast("string"))
    rows = t.table("orders").select(F.col("o_orderkey").alias("id"), F.posexplode(fl.nested_int_list(text)).alias("pos", "g"))
    return rows.select("id", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"), "pos")


@query("combination_labels", """
    SELECT o_orderkey AS id, least('f' || CAST(o_custkey AS VARCHAR), 'g,1(' || o_orderstatus || ')') || '|' ||
           greatest('f' || CAST(o_custkey AS VARCHAR), 'g,1(' || o_orderstatus || ')') AS combo_key, 2 AS k FROM orders""")
def combination_labels(t):
    text = F.concat(F.lit("('g,1("), "o_orderstatus", F.lit(")', 'f"), F.col("o_custkey").cast("string"), F.lit("')"))
    names = fl.tuple_text_to_names(text)
    return t.table("orders").select(F.col("o_orderkey").alias("id"), fl.combo_key(names).alias("combo_key"), F.size(names).alias("k"))


@query("equation_text", """
    SELECT o_orderkey AS id, 'y = + 0.50 a ' || CASE WHEN o_custkey % 3 - 1 < 0 THEN '- ' ELSE '+ ' END ||
           printf('%.2f', abs(CAST(o_custkey % 3 - 1 AS DOUBLE))) || ' b + 2.00' AS equation FROM orders""")
def equation_text(t):
    names, coef = F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.5), (F.col("o_custkey") % 3 - 1).cast("double"))
    return t.table("orders").select(F.col("o_orderkey").alias("id"), fe.equation_text(names, coef, F.lit(2.0)).alias("equation"))


@query("percent_errors", oracle("""
    SELECT id, round(CASE WHEN y <> 0 THEN abs(y - 30000 * n_lines) / abs(y) * 100 END, 4) AS percent FROM samples_v""", "samples_v"))
def percent_errors(t):
    return t.samples.select("id", F.round(fe.percent_error(F.col("y"), 30000 * F.col("n_lines")), 4).alias("percent"))
