"""Bond-table operators (A4, F7, J5-J7, J13, J21, PF11, PF12, A2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitable.functions import elements as el
from orbitable.session import broadcast_rows


def both_ways(bonds: DataFrame) -> DataFrame:
    """Every bond from both ends: mol_id, atom_idx, partner. One pass over the bonds."""
    turn = lambda p, q: F.struct(F.col(p).alias("atom_idx"), F.col(q).alias("partner"))
    return bonds.select("mol_id", F.inline(F.array(turn("a", "b"), turn("b", "a"))))


def atom_types(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Atoms with n_bonds and the atom type used for the steric radii."""
    counts = both_ways(bonds).groupBy("mol_id", "atom_idx").agg(F.count("*").alias("n_bonds"))
    e, n = F.col("element"), F.col("n_bonds")
    atype = (
        F.when(e == "O", F.when(n < 1.5, "O2").otherwise("O"))
        .when(e == "S", F.when(n < 2.5, "S").when(n < 5.5, "S4").otherwise("S1"))
        .when(e == "N", F.when(n < 2.5, "C6/N6").otherwise("N"))
        .when(e == "C", F.when(n < 2.5, "C3").when(n < 3.5, "C6/N6").otherwise("C"))
        .when(e.isin("H", "F", "P", "Cl", "Br", "I"), e)
        .otherwise("X")
    )
    return (
        atoms.join(counts, ["mol_id", "atom_idx"], "left")
        .withColumn("n_bonds", F.coalesce("n_bonds", F.lit(0)))
        .withColumn("atype", atype)
    )


def with_radius(typed: DataFrame, radii: str = "CPK") -> DataFrame:
    """Add `radius` by atom type (CPK) or by element (bondi); unknown types give NULL."""
    if radii.upper() == "CPK":
        return typed.withColumn("radius", el.lookup(el.CPK_RADIUS, F.col("atype")))
    return typed.withColumn("radius", el.lookup(el.BONDI_RADIUS, F.col("element")))


def bonds_in_set(bonds: DataFrame, atoms: DataFrame, members: DataFrame) -> DataFrame:
    """Bonds with both ends in `members` (mol_id, atom_idx), with the elements of both ends."""
    ends = atoms.join(members.select("mol_id", "atom_idx"), ["mol_id", "atom_idx"], "left_semi")
    left = ends.select("mol_id", F.col("atom_idx").alias("a"), F.col("element").alias("element_a"))
    right = ends.select("mol_id", F.col("atom_idx").alias("b"), F.col("element").alias("element_b"))
    return bonds.join(left, ["mol_id", "a"]).join(right, ["mol_id", "b"]).select(
        "mol_id", "a", "b", "element_a", "element_b"
    )


def pair_table(spark, pairs: Sequence[Sequence[int]]) -> DataFrame:
    rows = [(i, int(p[0]), int(p[1]), min(p), max(p)) for i, p in enumerate(pairs, 1)]
    return broadcast_rows(spark.createDataFrame(rows, "spec_id int, first int, second int, a int, b int"), len(rows))


def bonded_pairs(bonds: DataFrame, pairs: Sequence[Sequence[int]]) -> DataFrame:
    """Molecules in which a spec pair is bonded, either orientation: mol_id, spec_id, first, second."""
    table = pair_table(bonds.sparkSession, pairs)
    low = bonds.select("mol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return low.join(table, ["a", "b"]).select("mol_id", "spec_id", "first", "second").distinct()


def shared_centres(bonds: DataFrame, pairs: Sequence[Sequence[int]]) -> DataFrame:
    """Common neighbours of each spec pair: mol_id, spec_id, first, second, centre.

    Counting the two roles per (molecule, pair, neighbour) needs one shuffle and no self-join.
    """
    rows = [(i, role, int(a)) for i, p in enumerate(pairs, 1) for role, a in enumerate(p[:2])]
    table = bonds.sparkSession.createDataFrame(rows, "spec_id int, role int, atom_idx int")
    ids = lambda k: F.create_map(*[F.lit(x) for i, p in enumerate(pairs, 1) for x in (i, int(p[k]))])
    return (
        both_ways(bonds)
        .join(broadcast_rows(table, len(rows)), "atom_idx")
        .groupBy("mol_id", "spec_id", F.col("partner").alias("centre"))
        .agg(F.max(F.when(F.col("role") == 0, 1)).alias("r0"), F.max(F.when(F.col("role") == 1, 1)).alias("r1"))
        .where((F.col("r0") == 1) & (F.col("r1") == 1))
        .select("mol_id", "spec_id", ids(0)[F.col("spec_id")].alias("first"), ids(1)[F.col("spec_id")].alias("second"), "centre")
    )


def base_roles(spark, bases) -> tuple[DataFrame, list[str]]:
    """Base atoms as rows (spec_id, origin, direction, wish, atom_idx), and the columns to join atoms on.

    `bases` is a list [origin, direction(, third)] that holds for every molecule, or a table
    mol_id, spec_id, origin, direction with the atoms of each molecule.
    """
    ends = F.explode(F.array("origin", "direction")).alias("atom_idx")
    if isinstance(bases, DataFrame):
        wish = F.lit(None).cast("int").alias("wish")
        return bases.select("mol_id", "spec_id", "origin", "direction", wish, ends), ["mol_id", "atom_idx"]
    rows = [(i, int(b[0]), int(b[1]), int(b[2]) if len(b) > 2 else None) for i, b in enumerate(bases, 1)]
    table = spark.createDataFrame(rows, "spec_id int, origin int, direction int, wish int")
    return broadcast_rows(table.select("spec_id", "origin", "direction", "wish", ends), 2 * len(rows)), ["atom_idx"]


def direction_atoms(bonds: DataFrame, bases) -> DataFrame:
    """[origin, direction, third] per molecule for each base [origin, direction(, third)].

    The given third atom is kept when bonded to the direction atom; otherwise the lowest other
    neighbour of the direction atom, otherwise the lowest other neighbour of the origin.
    """
    roles, on = base_roles(bonds.sparkSession, bases)
    from_direction = F.col("atom_idx") == F.col("direction")
    usable = F.col("partner") != F.when(from_direction, F.col("origin")).otherwise(F.col("direction"))
    rank = F.when(from_direction & (F.col("partner") == F.col("wish")), 0).when(from_direction, 1).otherwise(2)
    return (
        both_ways(bonds)
        .join(roles, on)
        .where(usable)
        .groupBy("mol_id", "spec_id", "origin", "direction")
        .agg(F.min(F.struct(rank.alias("rank"), F.col("partner").alias("third"))).alias("pick"))
        .select("mol_id", "spec_id", "origin", "direction", "pick.third")
    )


def drop_atoms(atoms: DataFrame, bonds: DataFrame, dropped: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Remove atoms and the bonds touching them; renumber the rest without gaps."""
    gone = sorted({int(d) for d in dropped})
    shift = sum(((F.lit(d) < F.col("atom_idx")).cast("int") for d in gone), F.lit(0))
    renumbered = lambda c: c - sum(((F.lit(d) < c).cast("int") for d in gone), F.lit(0))
    kept = atoms.where(~F.col("atom_idx").isin(*gone)).withColumn("atom_idx", (F.col("atom_idx") - shift).cast("int"))
    left = bonds.where(~F.col("a").isin(*gone) & ~F.col("b").isin(*gone))
    return kept, left.withColumns({c: renumbered(F.col(c)).cast("int") for c in "ab"})


def drop_element_bonds(bonds: DataFrame, atoms: DataFrame, element: str = "H") -> DataFrame:
    """Bonds with that element at neither end."""
    e = atoms.where(F.col("element") == element).select("mol_id", "atom_idx")
    for end in "ab":
        bonds = bonds.join(e.withColumnRenamed("atom_idx", end), ["mol_id", end], "left_anti")
    return bonds


def bond_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """kept / missing / new per bond."""
    old = before.select("mol_id", "a", "b", F.lit(True).alias("was"))
    new = after.select("mol_id", "a", "b", F.lit(True).alias("now"))
    status = F.when(F.col("was") & F.col("now"), "kept").when(F.col("was"), "missing").otherwise("new")
    return old.join(new, ["mol_id", "a", "b"], "full_outer").select("mol_id", "a", "b", status.alias("status"))


def mapped_with_partner(mapping: DataFrame, bonds: DataFrame) -> DataFrame:
    """Mapped atoms bonded to another mapped atom (J13). mapping: mol_id, atom_idx, ..."""
    inside = mapping.select("mol_id", F.col("atom_idx").alias("partner")).distinct()
    linked = both_ways(bonds).join(inside, ["mol_id", "partner"], "left_semi").select("mol_id", "atom_idx")
    return mapping.join(linked, ["mol_id", "atom_idx"], "left_semi")


def centre_atoms(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Centre of mass, the closest atom to it and that atom's first partner (A2)."""
    weighted = atoms.withColumn("weight", el.lookup(el.ATOMIC_WEIGHT, F.col("element")))
    centre = weighted.groupBy("mol_id").agg(
        *[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(f"com_{c}") for c in "xyz"]
    )
    square = sum((F.col(c) - F.col(f"com_{c}")) * (F.col(c) - F.col(f"com_{c}")) for c in "xyz")
    closest = (
        atoms.join(centre, "mol_id")
        .groupBy("mol_id", "com_x", "com_y", "com_z")
        .agg(F.min(F.struct(F.round(square, 9).alias("d"), F.col("atom_idx").alias("i"))).alias("best"))
        .select("mol_id", "com_x", "com_y", "com_z", F.col("best.i").alias("atom_idx"))
    )
    # As `first partner`: the other end of bonds listed from this atom first, else of the rest.
    partner = both_ways(bonds).groupBy("mol_id", "atom_idx").agg(
        F.coalesce(
            F.min(F.when(F.col("partner") > F.col("atom_idx"), F.col("partner"))), F.min("partner")
        ).alias("partner")
    )
    return closest.join(partner, ["mol_id", "atom_idx"], "left").select(
        "mol_id", "com_x", "com_y", "com_z", F.col("atom_idx").alias("centre"), "partner"
    )


def smallest_molecule(atoms: DataFrame) -> DataFrame:
    """The molecule with the fewest atoms, lowest id first."""
    sizes = atoms.groupBy("mol_id").agg(F.count("*").alias("n_atoms"))
    return sizes.orderBy("n_atoms", "mol_id").limit(1)


def swap_atoms(atoms: DataFrame, first: int, second: int) -> DataFrame:
    """Exchange the coordinates of two atoms in molecules that have both (PF23)."""
    pair = atoms.where(F.col("atom_idx").isin(first, second))
    take = lambda i, c: F.max(F.when(F.col("atom_idx") == i, F.col(c))).alias(f"{c}_{i}")
    both = pair.groupBy("mol_id").agg(*[take(i, c) for i in (first, second) for c in "xyz"]).dropna()
    out = atoms.join(both, "mol_id", "left")
    new = {
        c: F.coalesce(
            F.when(F.col("atom_idx") == first, F.col(f"{c}_{second}")).when(
                F.col("atom_idx") == second, F.col(f"{c}_{first}")
            ),
            F.col(c),
        )
        for c in "xyz"
    }
    return out.withColumns(new).select(*atoms.columns)


def shuffle_atoms(atoms: DataFrame, seed: int = 0) -> DataFrame:
    """Random but repeatable new atom numbers inside each molecule (PF24)."""
    order = W.partitionBy("mol_id").orderBy(F.xxhash64("mol_id", "atom_idx", F.lit(seed)), "atom_idx")
    return atoms.withColumn("new_idx", F.row_number().over(order))


def centre_coordinates(atoms: DataFrame) -> DataFrame:
    """Subtract the molecule mean. Averages are joined back, so a large molecule stays spread out."""
    means = atoms.groupBy("mol_id").agg(*[F.avg(c).alias(f"m_{c}") for c in "xyz"])
    return atoms.join(means, "mol_id").withColumns({c: F.col(c) - F.col(f"m_{c}") for c in "xyz"}).select(*atoms.columns)
