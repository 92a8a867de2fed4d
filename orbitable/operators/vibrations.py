"""Mode operators: stretch, bend, ring modes, similar amplitudes (F10-F13, J11, W10, A21, PF13, PF14, PF22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.functions import vectors as v
from orbitable.operators import bonds as ob
from orbitable.operators.frames import spec_points
from orbitable.session import broadcast_rows


def in_window(modes: DataFrame, lower: float, upper: float | None = None) -> DataFrame:
    """Modes strictly above `lower` and, when given, strictly below `upper`."""
    out = modes.where(F.col("frequency") > lower)
    return out if upper is None else out.where(F.col("frequency") < upper)


def aligned(modes: DataFrame, displacements: DataFrame) -> DataFrame:
    """Displacement of every atom with the frequency of its mode."""
    return displacements.join(modes, ["mol_id", "mode_idx"])


def spec_displacements(displacements: DataFrame, specs: Sequence[Sequence[int]]) -> DataFrame:
    """mol_id, mode_idx, spec_id, d1..dk: displacement of each spec atom, complete specs only."""
    rows = [(i, s, int(a)) for i, spec in enumerate(specs, 1) for s, a in enumerate(spec, 1)]
    width = len(specs[0])
    table = displacements.sparkSession.createDataFrame(rows, "spec_id int, slot int, atom_idx int")
    move = F.struct(F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"))
    return (
        displacements.join(broadcast_rows(table, len(rows)), "atom_idx")
        .groupBy("mol_id", "mode_idx", "spec_id")
        .agg(*[F.max(F.when(F.col("slot") == k, move)).alias(f"d{k}") for k in range(1, width + 1)])
        .dropna()
    )


def strongest(rows: DataFrame, keys: Sequence[str], amplitude: str = "amplitude") -> DataFrame:
    """The mode with the largest amplitude per key; the lowest mode number on ties."""
    best = F.max(F.struct(F.round(amplitude, 9).alias("a"), (-F.col("mode_idx")).alias("m"), F.col("frequency").alias("f")))
    return rows.groupBy(*keys).agg(best.alias("best")).select(
        *keys, (-F.col("best.m")).alias("mode_idx"), F.col("best.f").alias("frequency"), F.col("best.a").alias("amplitude")
    )


def stretch_amplitudes(
    atoms: DataFrame,
    bonds: DataFrame,
    modes: DataFrame,
    displacements: DataFrame,
    pairs: Sequence[Sequence[int]],
    lower: float = 1600.0,
    upper: float | None = 3500.0,
) -> DataFrame:
    """|da.b| + |db.b| per mode of bonded pairs; b is the bond vector, not normalised."""
    bonded = ob.bonded_pairs(bonds, pairs).select("mol_id", "spec_id")
    ends = spec_points(atoms, pairs).select(
        "mol_id", "spec_id", v.pack(v.sub(v.vec("p1"), v.vec("p2"))).alias("bond")
    ).join(bonded, ["mol_id", "spec_id"], "left_semi")
    amplitude = F.abs(v.dot(v.vec("d1"), v.vec("bond"))) + F.abs(v.dot(v.vec("d2"), v.vec("bond")))
    return (
        spec_displacements(displacements, pairs)
        .join(in_window(modes, lower, upper), ["mol_id", "mode_idx"])
        .join(ends, ["mol_id", "spec_id"])
        .select("mol_id", "spec_id", "mode_idx", "frequency", amplitude.alias("amplitude"))
    )


def stretches(atoms, bonds, modes, displacements, pairs, lower=1600.0, upper=3500.0) -> DataFrame:
    """Strongest stretch per bonded pair; a pair that is not bonded gives a row of NULLs."""
    best = strongest(
        stretch_amplitudes(atoms, bonds, modes, displacements, pairs, lower, upper), ["mol_id", "spec_id"]
    )
    present = spec_points(atoms, pairs).select("mol_id", "spec_id")
    return present.join(best, ["mol_id", "spec_id"], "left")


def bends(bonds, modes, displacements, pairs, lower: float = 1300.0) -> DataFrame:
    """Strongest bend per pair with a shared centre: amplitude = |da x db|."""
    shared = ob.shared_centres(bonds, pairs).select("mol_id", "spec_id").distinct()
    rows = (
        spec_displacements(displacements, pairs)
        .join(in_window(modes, lower), ["mol_id", "mode_idx"])
        .join(shared, ["mol_id", "spec_id"], "left_semi")
        .select("mol_id", "spec_id", "mode_idx", "frequency", v.pack(v.cross(v.vec("d1"), v.vec("d2"))).alias("c"))
        .select("mol_id", "spec_id", "mode_idx", "frequency", v.norm(v.vec("c")).alias("amplitude"))
    )
    return strongest(rows, ["mol_id", "spec_id"])


def strongest_by_displacement(modes, displacements, atom_idx: Sequence[int], lower: float = 1500.0) -> DataFrame:
    """Mode that moves the listed atoms most (sum of displacement norms) above a frequency."""
    moved = (
        displacements.where(F.col("atom_idx").isin(*atom_idx))
        .groupBy("mol_id", "mode_idx")
        .agg(F.sum(v.norm(v.cols("dx", "dy", "dz"))).alias("amplitude"))
        .join(in_window(modes, lower), ["mol_id", "mode_idx"])
    )
    return strongest(moved, ["mol_id"])


def ring_modes(atoms: DataFrame, rings: DataFrame, modes: DataFrame, displacements: DataFrame) -> DataFrame:
    """Per mode of a six-ring: product of the alternate-atom sums and |sin| of the angle to r3 -> r0.

    mol_id, seed, mode_idx, frequency, product, sine.
    """
    ring = [F.struct(F.lit(i).alias("slot"), F.col(f"r{i}").alias("atom_idx")) for i in range(6)]
    slots = rings.select("mol_id", "seed", F.inline(F.array(*ring)))
    part = lambda odd, c: F.sum(F.when(F.col("slot") % 2 == odd, F.col(c))).alias(c[1:])
    # Even ring positions hold r0, r2, r4 (second sum), odd ones r1, r3, r5 (first sum).
    sums = (
        displacements.join(slots, ["mol_id", "atom_idx"])
        .groupBy("mol_id", "seed", "mode_idx")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(F.when(F.col("slot") % 2 == 1, F.col(f"d{c}"))).alias(f"o{c}") for c in "xyz"],
            *[F.sum(F.when(F.col("slot") % 2 == 0, F.col(f"d{c}"))).alias(f"e{c}") for c in "xyz"],
        )
        .where(F.col("n") == 6)
    )
    at = lambda s, n: F.max(F.when(F.col("slot") == s, F.struct("x", "y", "z"))).alias(n)
    axis = (
        atoms.join(slots.where(F.col("slot").isin(0, 3)), ["mol_id", "atom_idx"])
        .groupBy("mol_id", "seed")
        .agg(at(0, "p0"), at(3, "p3"))
        .select("mol_id", "seed", v.pack(v.sub(v.vec("p0"), v.vec("p3"))).alias("axis"))
    )
    odd, even = v.cols("ox", "oy", "oz"), v.cols("ex", "ey", "ez")
    sine = F.abs(F.sin(F.radians(v.angle_deg(even, v.vec("axis")))))
    return (
        sums.join(modes, ["mol_id", "mode_idx"])
        .join(axis, ["mol_id", "seed"])
        .select("mol_id", "seed", "mode_idx", "frequency", v.dot(odd, even).alias("product"), sine.alias("sine"))
    )


def ring_filter(rows: DataFrame, product: float = 0.01, lower: float = 1600.0, upper: float = 1750.0) -> DataFrame:
    """|product| above the limit and frequency strictly inside the window (PF14)."""
    return in_window(rows.where(F.abs("product") > product), lower, upper)


def ring_vibrations(atoms, rings, modes, displacements, lower: float = 1600.0, upper: float = 1750.0) -> DataFrame:
    """cross = frequency at the smallest sine, para = at the largest, with their angles in degrees."""
    rows = ring_filter(ring_modes(atoms, rings, modes, displacements), 0.01, lower, upper).where("sine IS NOT NULL")
    rows = rows.withColumn("s", F.round("sine", 9))
    low = F.min(F.struct("s", "mode_idx", "frequency")).alias("low")
    high = F.max(F.struct("s", (-F.col("mode_idx")).alias("m"), "frequency")).alias("high")
    return rows.groupBy("mol_id", "seed").agg(low, high).select(
        "mol_id",
        "seed",
        F.col("low.frequency").alias("cross"),
        F.degrees(F.asin(F.least(F.col("low.s"), F.lit(1.0)))).alias("cross_angle"),
        F.col("high.frequency").alias("para"),
        F.degrees(F.asin(F.least(F.col("high.s"), F.lit(1.0)))).alias("para_angle"),
    )


def similar_atoms(
    atoms: DataFrame, modes: DataFrame, displacements: DataFrame, pair: Sequence[int], tolerance: float = 0.1,
    kind: str = "projection",
) -> DataFrame:
    """Atoms outside the pair whose amplitude is close to the pair's, per mode."""
    a, b = int(pair[0]), int(pair[1])
    bond = spec_points(atoms, [(a, b)]).select("mol_id", v.pack(v.sub(v.vec("p1"), v.vec("p2"))).alias("bond"))
    bond = bond.withColumn("len", v.norm(v.vec("bond"))).where(F.col("len") > 1e-12)
    moved = aligned(modes, displacements).join(bond, "mol_id")
    d = v.cols("dx", "dy", "dz")
    amp = F.try_divide(F.abs(v.dot(d, v.vec("bond"))), F.col("len")) if kind == "projection" else v.norm(d)
    moved = moved.select("mol_id", "mode_idx", "frequency", "atom_idx", amp.alias("amplitude"))
    pair_amp = (
        moved.where(F.col("atom_idx").isin(a, b))
        .groupBy("mol_id", "mode_idx")
        .agg(F.sum("amplitude").alias("pair_amplitude"))
    )
    return (
        moved.where(~F.col("atom_idx").isin(a, b))
        .join(pair_amp, ["mol_id", "mode_idx"])
        .where(F.abs(F.col("amplitude") - F.col("pair_amplitude")) <= 1e-8 + tolerance * F.abs("pair_amplitude"))
        .select("mol_id", "mode_idx", "frequency", "pair_amplitude", "atom_idx", "amplitude")
    )


def pair_symmetry(displacements: DataFrame, pairs: Sequence[Sequence[int]]) -> DataFrame:
    """Cosine between the two displacements and its class (same direction = asymmetric)."""
    d1, d2 = v.vec("d1"), v.vec("d2")
    length = F.sqrt(v.dot(d1, d1) * v.dot(d2, d2))
    cosine = F.coalesce(F.try_divide(v.dot(d1, d2), length), F.lit(0.0))
    kind = F.when(F.col("cosine") > 0, "asymmetric").when(F.col("cosine") < 0, "symmetric").otherwise("unclear")
    return (
        spec_displacements(displacements, pairs)
        .select("mol_id", "mode_idx", "spec_id", cosine.alias("cosine"))
        .withColumn("kind", kind)
    )


def mode_sizes(modes: DataFrame, displacements: DataFrame) -> DataFrame:
    """Atoms and total displacement per mode."""
    return (
        displacements.groupBy("mol_id", "mode_idx")
        .agg(F.count("*").alias("n_atoms"), F.sum(v.norm(v.cols("dx", "dy", "dz"))).alias("total"))
        .join(modes, ["mol_id", "mode_idx"])
    )


def imaginary_frequency(modes: DataFrame) -> DataFrame:
    """Whether a molecule has a negative (imaginary) frequency (PF22)."""
    return modes.groupBy("mol_id").agg((F.min("frequency") < 0).alias("imaginary"), F.min("frequency").alias("lowest"))
