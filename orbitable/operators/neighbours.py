"""Atom pairs within a cutoff, bonds, clashes and nearest points.

Only molecules of at most WHOLE atoms form all their pairs, in the task that holds the molecule. In larger ones space is cut
into cubic cells and an atom is copied to each cell its half-cutoff ball overlaps (mostly one). Two atoms closer than the cutoff
both reach the cell that holds their midpoint, so an equi-join on (molecule, cell) finds every
pair, and keeping a pair only in its midpoint cell yields it once. A molecule that holds a large
share of all atoms is spread over its cells, hence over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orbitable.functions import elements as el
from orbitable.session import cut_lineage

WHOLE = 64  # atoms
CELL_EDGE = 8.0  # angstrom; at the density of solids about 50 atoms


def _cell(value: Column, edge: float) -> Column:
    # Cells are centred on the origin, where small molecules usually sit.
    return F.floor(value / edge + 0.5)


def _with_cells(points: DataFrame, reach: float, edge: float) -> DataFrame:
    out = points
    for axis in "xyz":
        low, high = _cell(F.col(axis) - reach, edge), _cell(F.col(axis) + reach, edge)
        out = out.withColumn(f"c{axis}", F.explode(F.sequence(low, high)))
    return out


def pairs_within(atoms: DataFrame, cutoff: float, keys=("mol_id",), edge: float = CELL_EDGE) -> DataFrame:
    """All atom pairs a < b of a molecule with distance <= cutoff.

    Returns keys, a, b, element_a, element_b, dist. Atoms of molecules of at most WHOLE atoms meet by molecule, so where `atoms` is
    partitioned by molecule, so are its pairs; those of larger molecules meet by cell.
    """
    keys = list(keys)
    atoms = atoms.select(*keys, "atom_idx", "element", "x", "y", "z")
    large = cut_lineage(atoms.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).select(*keys))
    if large.isEmpty():
        return _meet(atoms, keys, cutoff)
    edge = max(edge, cutoff)
    copies = _with_cells(atoms.join(large, keys, "left_semi"), cutoff / 2 * (1 + 1e-9) + 1e-9, edge)
    return _meet(atoms.join(large, keys, "left_anti"), keys, cutoff).unionByName(_meet(copies, keys, cutoff, edge))


def _meet(copies: DataFrame, keys: list[str], cutoff: float, edge: float | None = None) -> DataFrame:
    """Pairs within the cutoff of atoms with equal keys and, with an edge, in one cell of that edge."""
    on = [*keys, "cx", "cy", "cz"] if edge else keys
    left = copies.select(*on, *[F.col(c).alias(f"{c}_a") for c in ("atom_idx", "element", "x", "y", "z")])
    right = copies.select(*on, *[F.col(c).alias(f"{c}_b") for c in ("atom_idx", "element", "x", "y", "z")])
    delta = [F.col(f"{c}_a") - F.col(f"{c}_b") for c in "xyz"]
    square = delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2]
    same_cell = F.lit(True)
    for c in "xyz" if edge else "":
        same_cell = same_cell & (_cell((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2, edge) == F.col(f"c{c}"))
    return (
        left.join(right, on)
        .where(F.col("atom_idx_a") < F.col("atom_idx_b"))
        .where(square <= cutoff * cutoff * (1 + 1e-12))
        .where(same_cell)
        .select(
            *keys,
            F.col("atom_idx_a").alias("a"),
            F.col("atom_idx_b").alias("b"),
            "element_a",
            "element_b",
            F.sqrt(square).alias("dist"),
        )
        .where(F.col("dist") <= cutoff)
    )


def connectivity(atoms: DataFrame, threshold: float = 1.82, metal: str = "Pd") -> DataFrame:
    """Bonds by distance rules; halogens keep their shortest bond, metals their four shortest."""
    ea, eb, d = F.col("element_a"), F.col("element_b"), F.col("dist")
    hal_a, hal_b = ea.isin(*el.HALOGENS), eb.isin(*el.HALOGENS)
    has_metal = (ea == metal) | (eb == metal)
    some_h, both_h = (ea == "H") | (eb == "H"), (ea == "H") & (eb == "H")
    plain = (
        ~both_h
        & ~(some_h & (d >= 1.5))
        & F.when(has_metal, d <= 2.6).otherwise(d < threshold)
    )
    long_halogen = (hal_a | hal_b) & (d > 1.8) & (d < 2.6)
    found = pairs_within(atoms, max(2.6, threshold)).where((d > 0) & (plain | long_halogen))

    # One row per halogen end; rank 1 survives, and a pair needs every halogen end to agree. Other
    # pairs form a group of their own (guard = b), so one pass over the pairs serves both kinds.
    no_halogen = ~hal_a & ~hal_b
    ends = F.when(no_halogen, F.array(F.col("a"))).otherwise(
        F.array_compact(F.array(F.when(hal_a, F.col("a")), F.when(hal_b, F.col("b"))))
    )
    nearest = W.partitionBy("mol_id", "end", "guard").orderBy("dist", "a", "b")
    kept = (
        found.withColumn("ends", ends)
        .withColumn("guard", F.when(no_halogen, F.col("b")).otherwise(0))
        .select("mol_id", "a", "b", "element_a", "element_b", "dist", "guard", F.size("ends").alias("need"),
                F.explode("ends").alias("end"))
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= 1)
        .groupBy("mol_id", "a", "b", "element_a", "element_b", "dist", "need")
        .agg(F.count("*").alias("got"))
        .where(F.col("got") == F.col("need"))
        .drop("got", "need")
    )

    centre = F.when(ea == metal, F.col("a")).when(eb == metal, F.col("b")).otherwise(F.col("a"))
    shortest = W.partitionBy("mol_id", "centre", "guard").orderBy("dist", "a", "b")
    return (
        kept.withColumn("centre", centre)
        .withColumn("guard", F.when(has_metal, 0).otherwise(F.col("b")))
        .withColumn("rank", F.row_number().over(shortest))
        .where(F.col("rank") <= 4)
        .select("mol_id", "a", "b", "dist")
    )


def connectivity_by_cutoff(atoms: DataFrame, cutoff: float = 1.82) -> DataFrame:
    """Plain cutoff rule."""
    return pairs_within(atoms, cutoff).where(
        (F.col("dist") > 0) & (F.col("dist") < cutoff)
    ).select("mol_id", "a", "b", "dist")


def connectivity_by_radii(
    atoms: DataFrame, scale: float = 1.08, slack: float = 0.0, forced: DataFrame | None = None
) -> DataFrame:
    """d < (r1 + r2) * scale + slack with covalent radii; `forced` bonds (mol_id, a, b) always stay."""
    widest = 2 * max(el.COVALENT_RADIUS.values()) * scale + slack
    ra = el.lookup(el.COVALENT_RADIUS, F.col("element_a"))
    rb = el.lookup(el.COVALENT_RADIUS, F.col("element_b"))
    both_h = (F.col("element_a") == "H") & (F.col("element_b") == "H")
    found = (
        pairs_within(atoms, widest)
        .where((F.col("dist") > 0) & ~both_h & (F.col("dist") < (ra + rb) * scale + slack))
        .select("mol_id", "a", "b", "dist")
    )
    if forced is None:
        return found
    ends = [
        atoms.select("mol_id", F.col("atom_idx").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in "xyz"]) for e in "ab"
    ]
    gap = sum((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "xyz")
    extra = (
        forced.select("mol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .join(ends[0], ["mol_id", "a"])
        .join(ends[1], ["mol_id", "b"])
        .select("mol_id", "a", "b", F.sqrt(gap).alias("dist"))
    )
    return distinct_bonds(found.unionByName(extra))


def distinct_bonds(bonds: DataFrame) -> DataFrame:
    """One row per unordered pair, a < b."""
    return (
        bonds.withColumn("lo", F.least("a", "b"))
        .withColumn("hi", F.greatest("a", "b"))
        .groupBy("mol_id", F.col("lo").alias("a"), F.col("hi").alias("b"))
        .agg(F.min("dist").alias("dist"))
    )


def clashes(atoms: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs closer than the threshold."""
    return pairs_within(atoms, threshold).where(F.col("dist") < threshold)


def separate_overlaps(atoms: DataFrame, threshold: float = 0.5, shift: float = 0.3) -> DataFrame:
    """Move the second atom of a flagged pair to a + shift * unit(b - a); first flagged pair per atom.

    Coincident pairs have no direction and stay.
    """
    first = (
        clashes(atoms, threshold)
        .where(F.col("dist") > 0)
        .groupBy("mol_id", "b")
        .agg(F.min("a").alias("a"))
    )
    anchor = atoms.select("mol_id", F.col("atom_idx").alias("a"), *[F.col(c).alias(f"{c}0") for c in "xyz"])
    moved = first.join(anchor, ["mol_id", "a"]).withColumnRenamed("b", "atom_idx").drop("a")
    gap = F.sqrt(sum((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"))
    new = {c: F.coalesce(F.col(f"{c}0") + F.try_divide(shift * (F.col(c) - F.col(f"{c}0")), gap), F.col(c)) for c in "xyz"}
    return atoms.join(moved, ["mol_id", "atom_idx"], "left").withColumns(new).drop("x0", "y0", "z0")


def nearest_within(points: DataFrame, atoms: DataFrame, cutoff: float, mismatch: float = 0.0) -> DataFrame:
    """Nearest atom of the same molecule for every point, at most `cutoff` away.

    points: mol_id, point_id, x, y, z (and element when `mismatch` is used). An element mismatch
    adds `mismatch` in quadrature. Points without an atom in reach are absent. Ties go to the
    lowest atom number.
    """
    edge = max(CELL_EDGE, cutoff)
    near = _with_cells(atoms, cutoff * (1 + 1e-9) + 1e-9, edge).select(
        "mol_id", "cx", "cy", "cz", "atom_idx", F.col("element").alias("atom_element"),
        *[F.col(c).alias(f"{c}_atom") for c in "xyz"],
    )
    own = points.withColumns({f"c{c}": _cell(F.col(c), edge) for c in "xyz"})
    square = sum((F.col(c) - F.col(f"{c}_atom")) * (F.col(c) - F.col(f"{c}_atom")) for c in "xyz")
    if mismatch:
        square = square + F.when(F.col("element") == F.col("atom_element"), 0.0).otherwise(mismatch * mismatch)
    return (
        own.join(near, ["mol_id", "cx", "cy", "cz"])
        .withColumn("dist", F.sqrt(square))
        .where(F.col("dist") <= cutoff)
        .groupBy("mol_id", "point_id")
        .agg(F.min(F.struct(F.round("dist", 9).alias("dist"), F.col("atom_idx"))).alias("best"))
        .select("mol_id", "point_id", "best.atom_idx", "best.dist")
    )


def _finite(df: DataFrame) -> DataFrame:
    return df.where(" AND ".join(f"abs({c}) < double('Infinity')" for c in "xyz"))


def nearest_atom(points: DataFrame, atoms: DataFrame, leaf: float = 4.0) -> DataFrame:
    """Nearest atom of the same molecule at any distance: mol_id, point_id, atom_idx, dist.

    The box of a molecule is halved into cells down to an edge of `leaf`. Points descend from the box to the cells that may
    hold their nearest atom: a cell stays while its atoms' box begins no further away than the nearest box ends. So
    the number of rounds follows from the size of the largest molecule, however far the points are, and no point meets
    all atoms. Ties go to the lowest atom number. Positions that are not finite count as missing; molecules without atoms drop out.
    """
    corner = [F.min(c).alias(f"{c}0") for c in "xyz"]
    edge = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("edge")
    known = _finite(atoms.select("mol_id", "atom_idx", "x", "y", "z"))
    depth = F.greatest(F.lit(0), F.least(F.lit(60), F.ceil(F.log2(F.col("edge") / leaf)))).cast("int")
    box = cut_lineage(known.groupBy("mol_id").agg(*corner, edge).withColumn("depth", F.when(F.col("edge") > leaf, depth).otherwise(0)))
    deepest = box.agg(F.max("depth")).first()[0] or 0
    parts = F.pow(F.lit(2.0), F.col("depth"))
    place = {f"i{c}": F.when(F.col("depth") > 0, F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("edge") * parts), parts - 1)).otherwise(0).cast("long")
             for c in "xyz"}
    cell = ["ix", "iy", "iz"]
    own = cut_lineage(known.join(box, "mol_id").withColumns(place).select("mol_id", "depth", *cell, "atom_idx", *[F.col(c).alias(f"{c}_atom") for c in "xyz"]))
    # Cells of one height above the leaves, with the box of their atoms, from the cells one below.
    tight = lambda low, high: [f(F.col(v.format(c))).alias(n.format(c)) for c in "xyz" for f, v, n in ((F.min, low, "{}_lo"), (F.max, high, "{}_hi"))]
    heights = []
    for h in range(deepest):
        below = own.where("depth > 0") if h == 0 else heights[-1].where(f"depth > {h}").withColumns({c: F.shiftright(c, 1) for c in cell})
        names = ("{}_atom", "{}_atom") if h == 0 else ("{}_lo", "{}_hi")
        heights.append(cut_lineage(below.groupBy("mol_id", "depth", *cell).agg(*tight(*names))))
    waiting = _finite(points.select("mol_id", "point_id", "x", "y", "z")).join(box.select("mol_id", "depth"), "mol_id")
    at_root = waiting.withColumns({c: F.lit(0).cast("long") for c in cell})
    here = at_root.where(F.col("depth") == deepest)
    for h in range(deepest - 1, -1, -1):
        children = heights[h].select("mol_id", *[F.shiftright(c, 1).alias(f"p{c}") for c in cell], *[F.col(c).alias(f"n{c}") for c in cell],
                                     *[f"{c}_{e}" for c in "xyz" for e in ("lo", "hi")])
        met = here.withColumnsRenamed({c: f"p{c}" for c in cell}).join(children, ["mol_id", *[f"p{c}" for c in cell]])
        gap = sum(F.pow(F.greatest(F.col(f"{c}_lo") - F.col(c), F.col(c) - F.col(f"{c}_hi"), F.lit(0.0)), F.lit(2.0)) for c in "xyz")
        end = sum(F.pow(F.greatest(F.abs(F.col(c) - F.col(f"{c}_lo")), F.abs(F.col(c) - F.col(f"{c}_hi"))), F.lit(2.0)) for c in "xyz")
        bound = F.min(F.sqrt(end)).over(W.partitionBy("mol_id", "point_id"))
        kept = met.withColumn("_bound", bound).where(F.sqrt(gap) <= F.col("_bound") * (1 + 1e-12) + 1e-8)
        down = kept.select("mol_id", "point_id", "x", "y", "z", "depth", *[F.col(f"n{c}").alias(c) for c in cell])
        here = cut_lineage(down.unionByName(at_root.where(F.col("depth") == h)))
    gap = sum((F.col(c) - F.col(f"{c}_atom")) * (F.col(c) - F.col(f"{c}_atom")) for c in "xyz")
    return (
        here.drop("depth").join(own.drop("depth"), ["mol_id", *cell])
        .groupBy("mol_id", "point_id")
        .agg(F.min(F.struct(F.round(F.sqrt(gap), 9).alias("dist"), F.col("atom_idx"))).alias("best"))
        .select("mol_id", "point_id", "best.atom_idx", "best.dist")
    )


def mutual_nearest(left: DataFrame, right: DataFrame, cutoff: float, mismatch: float = 0.0) -> DataFrame:
    """Pairs that are each other's nearest neighbour across two atom sets of the same molecule."""
    as_points = lambda t: t.withColumnRenamed("atom_idx", "point_id")
    forth = nearest_within(as_points(left), right, cutoff, mismatch).select(
        "mol_id", F.col("point_id").alias("left_idx"), F.col("atom_idx").alias("right_idx"), "dist"
    )
    back = nearest_within(as_points(right), left, cutoff, mismatch).select(
        "mol_id", F.col("atom_idx").alias("left_idx"), F.col("point_id").alias("right_idx")
    )
    return forth.join(back, ["mol_id", "left_idx", "right_idx"], "left_semi")


def clash_score(candidates: DataFrame, hosts: DataFrame, slack: float = 0.2) -> DataFrame:
    """Per candidate set: -sum(max(ri + rj + slack - d, 0)^2) against the host atoms.

    candidates: mol_id, candidate_id, atom_idx, element, x, y, z. Only pairs within the largest
    possible contact matter, so the cell join finds them all.
    """
    contact = 2 * max(el.COVALENT_RADIUS.values()) + slack
    edge = max(CELL_EDGE, contact)
    near = _with_cells(hosts, contact * (1 + 1e-9), edge).select(
        "mol_id", "cx", "cy", "cz", F.col("element").alias("host_element"), *[F.col(c).alias(f"{c}_h") for c in "xyz"]
    )
    own = candidates.withColumns({f"c{c}": _cell(F.col(c), edge) for c in "xyz"})
    square = sum((F.col(c) - F.col(f"{c}_h")) * (F.col(c) - F.col(f"{c}_h")) for c in "xyz")
    reach = (
        el.lookup(el.COVALENT_RADIUS, F.col("element"))
        + el.lookup(el.COVALENT_RADIUS, F.col("host_element"))
        + slack
    )
    overlap = F.greatest(reach - F.sqrt(square), F.lit(0.0))
    return (
        own.join(near, ["mol_id", "cx", "cy", "cz"], "left")
        .groupBy("mol_id", "candidate_id")
        .agg((-F.coalesce(F.sum(overlap * overlap), F.lit(0.0))).alias("score"))
    )


def alignment_loss(points: DataFrame, targets: DataFrame, sigma: float = 20.0) -> DataFrame:
    """Per molecule, the sum over points of the least 1 - 2 / (1 + exp(sigma d)) + 5 d to a target.

    The term grows with the distance, so the least one belongs to the nearest target.
    """
    d = F.col("dist")
    term = 1 - 2 / (1 + F.exp(F.least(sigma * d, F.lit(700.0)))) + 5 * d
    return nearest_atom(points, targets).groupBy("mol_id").agg(F.sum(term).alias("loss"))


def sphere_directions(spark, n: int) -> DataFrame:
    """n evenly spread unit vectors on a Fibonacci sphere: direction_id, x, y, z."""
    i = F.col("id") + 0.5
    height = 1 - 2 * i / n
    ring = F.sqrt(1 - height * height)
    turn = F.lit(math.pi * (1 + math.sqrt(5))) * i
    return spark.range(n).select(
        F.col("id").alias("direction_id"), (F.cos(turn) * ring).alias("x"), (F.sin(turn) * ring).alias("y"), height.alias("z")
    )
