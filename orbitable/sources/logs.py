"""Text extraction from quantum-chemistry logs.

Every reader takes rows (mol_id, text) and is a projection of string functions followed by an
explode; a block that is absent simply gives no rows. What an explode reads several times, such as the numbers of a text, is a column
of its own before: inside a lambda it would be read anew for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitable.functions import elements as el
from orbitable.functions.energy import HARTREE_TO_EV

# Text markers and number patterns of the log format.
NUMBER = r"-?\d+(?:\.\d+)?"
DECIMAL = r"-?\d*\.\d+"
CHARGE_START, CHARGE_END = "Summary of", "====="
DIPOLE_START, DIPOLE_END = "Dipole moment", "Quadrupole moment"
ORIENTATION_START, CUTOFF = "Standard orientation:", "-" * 69
HIRSHFELD_START, HIRSHFELD_END = "Hirshfeld", "Hirshfeld charges with hydrogens "
FREQUENCY_START, FREQUENCY_END, FREQUENCY_LINE = "Harmonic frequencies", "Thermochemistry", "Frequencies --"
OCCUPIED, VIRTUAL = "Alpha  occ. eigenvalues", "Alpha virt. eigenvalues"
ORBITAL_START = "natural bond orbitals (summary):"


def numbers(text: Column, pattern: str = NUMBER) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: s.cast("double"))


def after_last(text: Column, marker: str) -> Column:
    """Text after the last marker, NULL when it is absent."""
    return F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, -1))


def before_last(text: Column, marker: str) -> Column:
    tail = F.length(F.substring_index(text, marker, -1)) + len(marker)
    return F.when(F.contains(text, F.lit(marker)), F.substring(text, F.lit(1), F.length(text) - tail))


def before_first(text: Column, marker: str) -> Column:
    return F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, 1))


def rows_of(values: Column, width: int) -> Column:
    """Array of complete rows of `width` numbers."""
    count = F.floor(F.size(values) / width).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * width + 1, width)))


def population_charges(texts: DataFrame) -> DataFrame:
    """mol_id, atom_idx, scheme = nbo, charge: every 6th number from the 2nd."""
    block = before_last(after_last(F.col("text"), CHARGE_START), CHARGE_END)
    return texts.select("mol_id", F.posexplode(F.filter(numbers(block), lambda v, i: i % 6 == 1)).alias("i", "charge")).select(
        "mol_id", (F.col("i") + 1).alias("atom_idx"), F.lit("nbo").alias("scheme"), "charge"
    )


def hirshfeld_charges(texts: DataFrame) -> DataFrame:
    """Hirshfeld (column 1) and CM5 (column 6) charges."""
    body = before_last(F.col("text"), HIRSHFELD_END)
    values = texts.select("mol_id", numbers(after_last(body, HIRSHFELD_START), DECIMAL).alias("v"))
    table = values.select("mol_id", F.posexplode(rows_of(F.col("v"), 6)).alias("i", "r"))
    pair = F.array(
        F.struct(F.lit("hirshfeld").alias("scheme"), F.get("r", F.lit(0)).alias("charge")),
        F.struct(F.lit("cm5").alias("scheme"), F.get("r", F.lit(5)).alias("charge")),
    )
    return table.select("mol_id", (F.col("i") + 1).alias("atom_idx"), F.inline(pair))


def dipoles(texts: DataFrame) -> DataFrame:
    """First four numbers of the last dipole block."""
    # The block heading itself holds no numbers.
    block = before_first(after_last(F.col("text"), DIPOLE_START), DIPOLE_END)
    v = texts.select("mol_id", numbers(block).alias("v")).where(F.size("v") >= 4)
    return v.select("mol_id", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("dip_x", "dip_y", "dip_z", "total_dipole"))])


def geometry(texts: DataFrame) -> DataFrame:
    """Atoms of the last orientation table; rows of number, atomic number, type, x, y, z."""
    body = F.get(F.split(after_last(F.col("text"), ORIENTATION_START), r"-{69}"), F.lit(2))
    symbol = el.lookup({n: s for n, s in enumerate(el.SYMBOLS, 1)}, F.get("r", F.lit(1)).cast("int"))
    values = texts.select("mol_id", numbers(body).alias("v"))
    return values.select("mol_id", F.posexplode(rows_of(F.col("v"), 6)).alias("i", "r")).select(
        "mol_id", (F.col("i") + 1).alias("atom_idx"), symbol.alias("element"),
        *[F.get("r", F.lit(k)).alias(c) for k, c in ((3, "x"), (4, "y"), (5, "z"))],
    )


def polarizabilities(texts: DataFrame) -> DataFrame:
    """iso and aniso (numbers 1 and 6 between `iso` and `xx`, times 1000); absent: NULL and a flag."""
    block = F.regexp_extract("text", r"iso\s([\s\S]*?)xx\s", 1)
    v = F.regexp_extract_all(block, F.lit(r"-?\d*\.\d+(?:[DE][+-]?\d+)?"), F.lit(0))
    value = lambda i: F.expr(f"try_cast(replace(get(v, {i}), 'D', 'E') AS DOUBLE)") * 1000
    out = texts.select("mol_id", v.alias("v")).select("mol_id", value(0).alias("iso"), value(5).alias("aniso"))
    return out.withColumn("pol_missing", F.col("iso").isNull() | F.col("aniso").isNull())


def _mode_blocks(texts: DataFrame) -> DataFrame:
    section = F.regexp_extract("text", FREQUENCY_START + r"([\s\S]*?)" + FREQUENCY_END, 1)
    cut = texts.select("mol_id", F.split(section, FREQUENCY_LINE).alias("blocks"))
    own = F.transform(F.slice("blocks", 2, F.greatest(F.size("blocks") - 1, F.lit(0))), lambda b: F.substring_index(b, "-" * 19, 1))
    return cut.select("mol_id", F.posexplode(own).alias("block", "body")).select("mol_id", "block", numbers(F.col("body")).alias("v"))


def modes(texts: DataFrame) -> DataFrame:
    """mol_id, mode_idx, frequency, ir: numbers 1-3 and 7-9 of each block."""
    three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(
        i.alias("i"), F.get("v", i).alias("frequency"), F.get("v", i + 6).alias("ir")))
    return (
        _mode_blocks(texts).select("mol_id", "block", F.inline(three)).where("frequency IS NOT NULL")
        .select("mol_id", (F.col("block") * 3 + F.col("i") + 1).alias("mode_idx"), "frequency", "ir")
    )


def displacements(texts: DataFrame) -> DataFrame:
    """mol_id, mode_idx, atom_idx, dx, dy, dz: after 12 numbers, rows of atom, Z, 3 x (x, y, z)."""
    body = F.slice("v", 13, F.greatest(F.size("v") - 12, F.lit(0)))
    rows = _mode_blocks(texts).select("mol_id", "block", body.alias("v"))
    rows = rows.select("mol_id", "block", F.explode(rows_of(F.col("v"), 11)).alias("r"))
    three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(
        i.alias("i"), F.get("r", i * 3 + 2).alias("dx"), F.get("r", i * 3 + 3).alias("dy"), F.get("r", i * 3 + 4).alias("dz")))
    return rows.select("mol_id", "block", F.get("r", F.lit(0)).cast("int").alias("atom_idx"), F.inline(three)).select(
        "mol_id", (F.col("block") * 3 + F.col("i") + 1).alias("mode_idx"), "atom_idx", "dx", "dy", "dz"
    )


def frontier_gaps(texts: DataFrame) -> DataFrame:
    """First virtual after the last occupied level minus that level, in eV."""
    tail = after_last(F.col("text"), OCCUPIED)
    homo = F.element_at(numbers(F.substring_index(tail, "\n", 1), DECIMAL), -1)
    lumo = F.get(numbers(F.substring_index(F.when(F.contains(tail, F.lit(VIRTUAL)), F.get(F.split(tail, VIRTUAL), F.lit(1))), "\n", 1), DECIMAL), F.lit(0))
    return texts.where(F.contains("text", F.lit(OCCUPIED))).select("mol_id", ((lumo - homo) * HARTREE_TO_EV).alias("homo_lumo_gap_ev"))


def listed_bonds(texts: DataFrame) -> DataFrame:
    """All R(i,j) entries."""
    found = F.regexp_extract_all("text", F.lit(r"R\((\d+,\d+)"), F.lit(1))
    pair = F.transform(found, lambda s: F.struct(F.split(s, ",")[0].cast("int").alias("a"), F.split(s, ",")[1].cast("int").alias("b")))
    return texts.select("mol_id", F.inline(pair))


def bond_orders(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders, atoms) from the orbital summary.

    orders: mol_id, a, b, bond_order, the last one of a pair; atoms: mol_id, atom_idx,
    total_order, lone_pairs. Reading stops at the first RY line.
    """
    low = F.lower("text")
    start = F.locate(ORBITAL_START, low)
    body = F.substring("text", F.col("start"), F.length("text"))
    part = texts.withColumn("start", start).where("start > 0").select("mol_id", F.substring_index(body, "RY", 1).alias("body"))
    lines = part.select("mol_id", F.posexplode(F.split("body", "\n")).alias("no", "line"))
    tag = F.when(F.contains("line", F.lit("BD")), "BD").when(F.contains("line", F.lit("LP")), "LP")
    tagged = lines.withColumn("tag", tag).where("tag IS NOT NULL")
    v = numbers(F.substring("line", F.locate("BD", F.col("line")), F.length("line")), r"[-+]?\d*\.\d+|\d+")
    w = numbers(F.substring("line", F.locate("LP", F.col("line")), F.length("line")), r"[-+]?\d*\.\d+|\d+")
    tagged = tagged.withColumn("v", F.when(F.col("tag") == "BD", v).otherwise(w))
    item = lambda i: F.get("v", F.lit(i)).cast("int")
    bond = F.col("tag") == "BD"
    # The last line of a bond or lone pair holds; one pass over the lines serves both tables, and no step leaves the molecule.
    kept = (
        tagged.where(F.size("v") >= F.when(bond, 3).otherwise(2))
        .select("mol_id", "tag", "no", item(1).alias("a"), F.when(bond, item(2)).alias("b"), item(0).alias("n"))
        .groupBy("mol_id", "tag", "a", "b")
        .agg(F.max_by("n", "no").alias("n"))
    )
    orders = kept.where(bond).select("mol_id", "a", "b", F.col("n").alias("bond_order"))
    ends = kept.select("mol_id", "tag", "n", F.explode(F.when(bond, F.array("a", "b")).otherwise(F.array("a"))).alias("atom_idx"))
    atoms = (
        ends.groupBy("mol_id", "atom_idx")
        .agg(F.sum(F.when(bond, F.col("n"))).alias("total_order"), F.max(F.when(~bond & F.col("mol_id").isNotNull(), F.col("n"))).alias("lone_pairs"), F.max(bond).alias("bonded"))
        .where("bonded").select("mol_id", "atom_idx", "total_order", F.coalesce("lone_pairs", F.lit(0)).alias("lone_pairs"))
    )
    return orders, atoms


def formal_charges(orders_by_atom: DataFrame, atoms: DataFrame) -> DataFrame:
    """valence - 2 * lone pairs - bonds."""
    valence = el.lookup(el.VALENCE_ELECTRONS, F.col("element"))
    return orders_by_atom.join(atoms.select("mol_id", "atom_idx", "element"), ["mol_id", "atom_idx"]).select(
        "mol_id", "atom_idx", (valence - 2 * F.col("lone_pairs") - F.col("total_order")).alias("formal_charge")
    )


def extract_all(texts: DataFrame) -> dict[str, DataFrame]:
    """All normalised tables of a set of logs, plus a report of missing blocks."""
    orders, by_atom = bond_orders(texts)
    scalars = (
        texts.select("mol_id").join(dipoles(texts), "mol_id", "left").join(polarizabilities(texts), "mol_id", "left")
        .join(frontier_gaps(texts), "mol_id", "left")
    )
    has = lambda m: F.contains("text", F.lit(m))
    checks = {"charges": has(CHARGE_START), "dipole": has(DIPOLE_START), "geometry": has(ORIENTATION_START),
              "hirshfeld": has(HIRSHFELD_END), "modes": has(FREQUENCY_START), "gap": has(OCCUPIED), "bonds": has("R(")}
    missing = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return {
        "atoms": geometry(texts),
        "charges": population_charges(texts).unionByName(hirshfeld_charges(texts)),
        "scalars": scalars,
        "modes": modes(texts),
        "displacements": displacements(texts),
        "bonds": listed_bonds(texts),
        "bond_orders": orders,
        "atom_orders": by_atom,
        "report": texts.select("mol_id", missing.alias("missing_blocks")),
    }
