"""Steric extents L, B1, B5 and buried volume.

The reference outline of an atom is a circle of 100 sample points in the x-z plane. Its extreme
in a direction is the sample nearest to that direction, which has a closed form, so the scan
costs one row per atom and degree instead of one per atom, degree and sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitable.functions import elements as el
from orbitable.functions import vectors as v
from orbitable.operators import bonds as ob
from orbitable.operators import graph as og
from orbitable.operators.frames import frames_from_points, into_frame
from orbitable.session import broadcast_checked, cut_lineage

STEP = 2 * math.pi / 99  # 100 samples from 0 to a full turn, both ends included
COARSE = 18


def sample_gap(direction: Column) -> Column:
    """Angle (radians) between a direction and the nearest outline sample."""
    turns = direction / STEP
    return F.abs(turns - F.round(turns)) * STEP


def outline_reach(u: Column, w: Column, radius: Column, direction: Column) -> Column:
    """Largest projection of the outline of a circle at (u, w) on a direction (radians)."""
    return u * F.cos(direction) + w * F.sin(direction) + radius * F.cos(sample_gap(direction))


def outline_norm(u: Column, w: Column, radius: Column) -> Column:
    """Largest distance of an outline sample from the origin."""
    gap = sample_gap(F.atan2(w, u))
    size = F.sqrt(u * u + w * w)
    return F.sqrt(size * size + radius * radius + 2 * size * radius * F.cos(gap))


def substituent_atoms(
    atoms: DataFrame, bonds: DataFrame, bases: Sequence[Sequence[int]], radii: str = "CPK", whole: bool = False,
    digits: int | None = 4,
) -> DataFrame:
    """Atoms of each substituent in its local frame with radius: mol_id, spec_id, atom_idx, x, y, z, radius.

    The frame is [origin, direction, third]; y runs along origin -> direction. With `whole` every
    bonded atom counts, otherwise those reached through the direction atom.
    """
    frame = ob.direction_atoms(bonds, bases)
    role = F.when(F.col("atom_idx") == F.col("origin"), "o").when(F.col("atom_idx") == F.col("direction"), "y").otherwise("p")
    named = frame.select("*", F.explode(F.array("origin", "direction", "third")).alias("atom_idx"))
    point = lambda r, n: F.max(F.when(F.col("role") == r, F.struct("x", "y", "z"))).alias(n)
    basis = frames_from_points(
        atoms.select("mol_id", "atom_idx", "x", "y", "z")
        .join(named, ["mol_id", "atom_idx"])
        .withColumn("role", role)
        .groupBy("mol_id", "spec_id")
        .agg(point("o", "origin"), point("y", "py"), point("p", "pp"))
        .dropna()
    ).where(~F.col("degenerate")).select("mol_id", "spec_id", "origin", "ex", "ey", "ez")
    typed = ob.with_radius(ob.atom_types(atoms, bonds), radii)
    # Only atoms with a bond inside the chosen set count, as bonds define the substituent.
    if whole:
        chosen = typed.where(F.col("n_bonds") > 0)
        placed = into_frame(chosen.join(basis, "mol_id"), digits=digits)
    else:
        inside = og.reachable(atoms, bonds, bases).select("mol_id", "spec_id", "atom_idx")
        linked = (
            ob.both_ways(bonds)
            .join(inside, ["mol_id", "atom_idx"])
            .join(inside.withColumnRenamed("atom_idx", "partner"), ["mol_id", "spec_id", "partner"], "left_semi")
            .select("mol_id", "spec_id", "atom_idx")
            .distinct()
        )
        placed = into_frame(typed.join(linked, ["mol_id", "atom_idx"]).join(basis, ["mol_id", "spec_id"]), digits=digits)
    return placed.select("mol_id", "spec_id", "atom_idx", "x", "y", "z", "radius").where("radius IS NOT NULL")


def half_up(values: np.ndarray, digits: int = 4) -> np.ndarray:
    """Rounding as Spark's round: half away from zero, of the decimal number that a double prints as."""
    size = np.abs(values) * 10.0**digits
    with np.errstate(invalid="ignore"):
        near = np.isfinite(values) & ((np.abs(size - np.floor(size) - 0.5) < 1e-6) | (size > 1e9))
    out = np.copysign(np.floor(size + 0.5) / 10.0**digits, values)
    unit = Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) if abs(v) < 1e15 else v for v in values[near].tolist()]
    return out


def _directions(spark, degrees: Sequence[int]) -> np.ndarray:
    """What outline_reach multiplies u, w and the radius by, for each side (+x, -x, +y, -y) and degree of turn: (3, 4, degrees)."""
    turn = F.radians(F.lit(degrees[0]) + F.col("id"))
    quarter = math.pi / 2
    ways = [F.lit(axis) - turn for axis in (0.0, math.pi, quarter, 3 * quarter)]
    parts = (F.cos, F.sin, lambda way: F.cos(sample_gap(way)))
    rows = spark.range(0, len(degrees), 1, 1).select("id", F.array(*[part(way) for part in parts for way in ways]).alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows)]).T.reshape(3, 4, len(degrees))


def _largest(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The largest row (v, i, t) of each group 0, 1, 2, ..."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], group))
    return rows[order[np.append(np.flatnonzero(np.diff(group[order])), len(order) - 1)]]


POINTS_AT_ONCE = 1 << 10
SCANNED = ["b1", "degree", "arrow", "top", "far", "tip", "wide"]


def _scanned(keys: int, table: np.ndarray, degrees: Sequence[int], coarse: Sequence[int]):
    """SCANNED of each key, from rows sorted by key: keys, x, z, radius, top and two triples (v, i, t).

    b1 is the smallest side over the degrees, arrow the way of that side, top the largest top; far and tip are v and t of the largest first triple,
    wide is t of the largest second one. With `coarse`, only degrees at most COARSE from the best of these count. What is kept of an open key
    is its reach per side and degree and its largest triples, however many points it has. NULLs count as less than anything.
    """
    c, s, g = table.reshape(3, -1)
    around = np.arange(-COARSE, COARSE + 1)

    def narrowest(reach: np.ndarray) -> list[np.ndarray]:
        reach = reach.reshape(len(reach), 4, -1)
        size, every = np.abs(reach), np.arange(len(reach))
        least = np.fmin.reduce(size, axis=1)
        lowest = lambda v: np.where(np.isnan(v), np.inf, v).argmin(axis=1)
        at = np.broadcast_to(np.arange(len(degrees)), least.shape)
        if coarse:
            start = np.array(coarse) - degrees[0]
            at = start[lowest(half_up(least[:, start]))][:, None] + around
        b1 = half_up(np.take_along_axis(least, at, axis=1))
        k = lowest(b1)
        b1, at = b1[every, k], at[every, k]
        # Arrow of the smallest extent: +x, -x, +y, -y in this order of preference.
        ahead = reach[every, :, at]
        side = ((half_up(np.abs(ahead)) == b1[:, None]) | np.isnan(b1)[:, None]).argmax(axis=1)
        arrow = np.where((ahead >= 0) | np.isnan(ahead), [0.0, 180.0, 90.0, 270.0], [180.0, 0.0, 270.0, 90.0])[every, side]
        unseen = np.isneginf(reach).all(axis=(1, 2))
        return [np.where(unseen, -np.inf, v) for v in (b1, at + degrees[0], arrow)]

    def result(names: list[pa.Array], values: list[np.ndarray], fields: list[str]) -> pa.RecordBatch:
        columns = [pa.array(v, pa.float64(), mask=np.isneginf(v)) for v in (values[i] for i in (0, 1, 2, 3, 4, 6, 9))]
        return pa.RecordBatch.from_arrays([*names, *columns], names=[*fields, *SCANNED])

    def run(batches):
        name, reached, best, fields, types = None, None, None, [], []
        for batch in batches:
            if not len(batch):
                continue
            ids, (x, z, radius), rest = batch.columns[:keys], batch.columns[keys: keys + 3], batch.columns[keys + 3:]
            fields, types = batch.schema.names[:keys], [k.type for k in ids]
            fresh = np.zeros(len(batch), bool)
            fresh[0] = name != [k[0].as_py() for k in ids]
            for k in ids:
                fresh[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
            missing = np.any([v.is_null().to_numpy(zero_copy_only=False) for v in (x, z, radius)], axis=0)
            x, z, radius = (v.fill_null(0.0).to_numpy() for v in (x, z, radius))
            rest = np.column_stack([v.fill_null(-np.inf).to_numpy() for v in rest])
            done = []
            for at in range(0, len(fresh), POINTS_AT_ONCE):
                some = slice(at, at + POINTS_AT_ONCE)
                begun, mine = fresh[some], rest[some]
                reach = x[some, None] * c + z[some, None] * s + radius[some, None] * g
                reach[missing[some]] = -np.inf
                starts, group = np.flatnonzero(begun), np.cumsum(begun) - 1
                if not begun[0]:  # goes on with the open key
                    reach[0] = np.maximum(reach[0], reached[0])
                    starts, group, mine = np.append(0, starts), np.append(0, group + 1), np.concatenate([best, mine])
                elif reached is not None:
                    done.append([*narrowest(reached), *best.T])
                firsts = np.flatnonzero(np.diff(group, prepend=-1))
                sides = np.maximum.reduceat(reach, starts, axis=0)
                found = np.column_stack([np.maximum.reduceat(mine[:, 0], firsts), _largest(group, mine[:, 1:4]), _largest(group, mine[:, 4:7])])
                if len(sides) > 1:
                    done.append([*narrowest(sides[:-1]), *found[:-1].T])
                reached, best = sides[-1:], found[-1:]
            heads = np.flatnonzero(fresh)
            if done:
                begun = [k.take(pa.array(heads[:-1])) for k in ids]
                names = begun if name is None else [pa.concat_arrays([pa.array([n], k.type), k]) for n, k in zip(name, begun)]
                yield result(names, [np.concatenate(v) for v in zip(*done)], fields)
            if len(heads):
                name = [k[int(heads[-1])].as_py() for k in ids]
        if name is not None:
            yield result([pa.array([n], t) for n, t in zip(name, types)], [*narrowest(reached), *best.T], fields)

    return run


def _scan(points: DataFrame, keys: list[str], top: Column, far: Sequence[Column], wide: Sequence[Column], degrees: Sequence[int],
          coarse: Sequence[int] = ()) -> DataFrame:
    """keys and SCANNED from points with x, z, radius: they are shuffled and sorted once and stream past the maxima of their key."""
    raw = points.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys)
    numbers = [F.col("x"), F.col("z"), F.col("radius"), top, *far, *wide]
    types = dict(raw.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{c} double" for c in SCANNED])
    rows = raw.select(*keys, *[c.cast("double").alias(f"_{i}") for i, c in enumerate(numbers)])
    return rows.mapInArrow(_scanned(len(keys), _directions(points.sparkSession, degrees), list(degrees), list(coarse)), schema)


def extents(points: DataFrame, keys: Sequence[str] = ("mol_id", "spec_id"), digits: int = 4) -> DataFrame:
    """B1, B5, L, loc_B5, B1_B5_angle per key from placed atoms with radius."""
    keys = list(keys)
    points = points.select(*keys, "atom_idx", "x", "y", "z", "radius")
    reach = F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")) + F.col("radius")
    far = outline_norm(F.col("x"), F.col("z"), F.col("radius"))
    ray = F.round(F.atan2(F.col("z"), F.col("x")) / STEP) * STEP
    tip = F.degrees(
        F.atan2(F.col("z") + F.col("radius") * F.sin(ray), F.col("x") + F.col("radius") * F.cos(ray))
    )
    first = -F.col("atom_idx")
    best = _scan(points, keys, F.col("y") + F.col("radius"), (F.round(far, 9), first, tip), (F.round(reach, 9), first, F.col("y")),
                 range(0, 91 + COARSE), range(COARSE, 91, COARSE))
    gap = F.abs(F.pmod(F.col("tip") + F.col("degree"), F.lit(360.0)) - F.col("arrow"))
    return best.select(
        *keys,
        F.round("b1", 4).alias("B1"),
        F.round("far", digits).alias("B5"),
        F.round("top", digits).alias("L"),
        F.round("wide", digits).alias("loc_B5"),
        F.round(F.when(gap > 180, 360 - gap).otherwise(gap), 4).alias("B1_B5_angle"),
    )


def sterimol(
    atoms: DataFrame, bonds: DataFrame, bases: Sequence[Sequence[int]], radii: str = "CPK", whole: bool = False
) -> DataFrame:
    """Steric extents of each substituent: mol_id, spec_id, B1, B5, L, loc_B5, B1_B5_angle."""
    return extents(substituent_atoms(atoms, bonds, bases, radii, whole))


def _mean_points(atoms: DataFrame, numbers: Sequence[int], name: str) -> DataFrame:
    """Mean position of the named atoms, in molecules that have all of them: mol_id, <name> (struct x, y, z)."""
    numbers = sorted(set(numbers))
    found = atoms.where(F.col("atom_idx").isin(*numbers)).groupBy("mol_id").agg(
        F.count("*").alias("n"), F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias(name))
    return found.where(F.col("n") == len(numbers)).drop("n")


def _around_centres(atoms: DataFrame, centres: Sequence[int], z_axis: Sequence[int], xz_plane: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(origins, atoms seen from each origin): mol_id, centre and mol_id, centre, atom_idx, element, x, y, z."""
    place = F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"])
    origins = atoms.where(F.col("atom_idx").isin(*centres)).select("mol_id", F.col("atom_idx").alias("centre"), place.alias("origin"))
    if z_axis:
        origins = origins.join(_mean_points(atoms, z_axis, "py"), "mol_id")
        origins = origins.join(_mean_points(atoms, xz_plane, "pp"), "mol_id") if xz_plane else origins.withColumn("pp", F.col("py"))
        origins = frames_from_points(origins).select("mol_id", "centre", "origin", "ex", "ey", "ez")
    origins = cut_lineage(origins)
    seen = atoms.select("mol_id", "atom_idx", "element", "x", "y", "z").join(broadcast_checked(origins), "mol_id")
    if z_axis:
        seen = into_frame(seen, digits=None).withColumns({"y": F.col("z"), "z": -F.col("y")})
    else:
        seen = seen.withColumns({c: F.col(c) - F.col(f"origin.{c}") for c in "xyz"})
    return origins.select("mol_id", "centre"), seen.select("mol_id", "centre", "atom_idx", "element", "x", "y", "z")


WORD = 64
CHUNK = 1 << 17  # lattice columns worked on at once


def _ranges(square: np.ndarray, middle, limit, step: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last lattice index k with square + ((k + 0.5) * step - middle)^2 <= limit; last < first where there is none.

    The root gives the ends; where one is so near to a lattice point that rounding may decide, its neighbours are
    tried by the inequality itself.
    """
    half = np.sqrt(np.maximum(limit - square, 0.0))
    first, last = (middle - half) / step - 0.5, (middle + half) / step - 0.5
    low, high = np.ceil(first), np.floor(last)
    near = 0.5 - 1e-6 * max(1.0, float(np.max(limit, initial=0.0))) / step
    close = np.nonzero(np.maximum(np.abs(low - first - 0.5), np.abs(last - high - 0.5)) > near)
    if len(close[0]):
        square, middle, limit = (np.broadcast_to(v, low.shape)[close] for v in (square, middle, limit))
        fits = lambda k: square + ((k + 0.5) * step - middle) * ((k + 0.5) * step - middle) <= limit
        at, to = low[close], high[close]
        low[close] = np.where(fits(at - 1), at - 1, np.where(fits(at), at, at + 1))
        high[close] = np.where(fits(to + 1), to + 1, np.where(fits(to), to, to - 1))
    return low, high


def _buried(radius: float, step: float):
    """Lattice points inside a sphere round the origin and inside any of its atom spheres, per octant.

    Rows (mol_id, centre, x, y, z, r) come sorted by mol_id and centre. A centre is held as one bit a lattice point, a
    word for every WORD points of a lattice column (ix, iy), however many atoms it has. Words end at z = 0. An atom sphere sets an interval
    of every column that it meets, in the box of columns round it.
    """
    n = math.ceil(radius / step) + 1
    spot = (np.arange(-n, n) + 0.5) * step
    side = math.ceil(n / WORD)  # words on either side of z = 0
    # For every word and lattice index from -n - 1 to n + 1, the bits below it and the others.
    ends = np.clip(np.arange(-n - 1, n + 2)[None, :] - (np.arange(-side, side) * WORD)[:, None], 0, WORD)
    below = np.append((np.uint64(1) << np.arange(WORD, dtype=np.uint64)) - np.uint64(1), ~np.uint64(0))[ends]
    above = ~below

    def bits(square: np.ndarray, middle, limit) -> np.ndarray:
        """(rows, words, columns, columns): the interval that a sphere sets of each column."""
        met = np.flatnonzero(square <= limit)
        middle, limit = (np.broadcast_to(v, square.shape).reshape(-1)[met] if np.ndim(v) else v for v in (middle, limit))
        low, high = _ranges(square.reshape(-1)[met], middle, limit, step)
        first, last = low.astype(np.int64) + n + 1, high.astype(np.int64) + n + 2
        out = np.zeros((len(square), 2 * side, square[0].size), np.uint64)
        at = met + met // square[0].size * (square[0].size * (2 * side - 1))
        flat = out.reshape(-1)
        for k in range(2 * side):
            flat[at + k * square[0].size] = below[k].take(last, mode="clip") & above[k].take(first, mode="clip")
        return out.reshape(len(square), 2 * side, *square.shape[1:])

    plane = (spot * spot)[None, :, None] + (spot * spot)[None, None, :]
    ball = bits(plane, 0.0, float(radius) ** 2)
    empty = np.zeros(ball.shape[1:], np.uint64)

    def count(hits: np.ndarray) -> np.ndarray:
        found = np.bitwise_count(hits & ball).reshape(-1, 2, side, 2, n, 2 * n).sum(axis=4, dtype=np.uint32)
        return found.reshape(-1, 2, side, 2, 2, n).sum(axis=(2, 5), dtype=np.int64).transpose(0, 1, 3, 2).reshape(-1, 8)

    def run(batches):
        rows = max(1, CHUNK // plane.size)
        key, last = None, np.zeros((0, *empty.shape), np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            ids, centres, *place = batch.columns
            place = [c.to_numpy() for c in place]
            change = pc.or_(pc.not_equal(ids[1:], ids[:-1]), pc.not_equal(centres[1:], centres[:-1])).to_numpy(zero_copy_only=False)
            fresh = np.append(key != (ids[0], centres[0]), change)
            counts = []
            for at in range(0, len(fresh), rows):
                begun = fresh[at: at + rows]
                x, y, z, r = (c[at: at + rows] for c in place)
                m = min(2 * n, math.ceil(2 * r.max() / step) + 3)
                box = [np.clip(np.floor((c - r) / step - 0.5).astype(np.int64) + n, 0, 2 * n - m) for c in (x, y)]
                off = [(spot[s[:, None] + np.arange(m)] - c[:, None]) ** 2 for s, c in zip(box, (x, y), strict=True)]
                found = bits(off[0][:, :, None] + off[1][:, None, :], z[:, None, None], (r * r)[:, None, None])
                group = np.cumsum(begun) - 1 + len(last)
                groups = np.zeros((int(group[-1]) + 1, *empty.shape), np.uint64)
                groups[: len(last)] = last
                for k, (g, i, j) in enumerate(zip(group.tolist(), *(s.tolist() for s in box), strict=True)):
                    groups[g, :, i: i + m, j: j + m] |= found[k]
                counts.append(count(groups[:-1]))
                last = groups[-1:]
            heads = np.flatnonzero(fresh)
            names = [([key[k]] if key else []) + c.take(pa.array(heads)).to_pylist() for k, c in enumerate((ids, centres))]
            schema = batch.schema
            yield _counted([n[:-1] for n in names], np.concatenate(counts), schema)
            key = (ids[len(ids) - 1], centres[len(ids) - 1])
        if key:
            yield _counted([[k] for k in key], count(last), schema)

    return run


def _counted(names: list[list], counts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    names = [pa.array([getattr(v, "as_py", lambda v=v: v)() for v in n], schema.field(k).type) for k, n in enumerate(names)]
    counts = pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * 8, counts.ravel())
    return pa.RecordBatch.from_arrays([*names, counts], names=["mol_id", "centre", "counts"])


def buried_volume(
    atoms: DataFrame,
    centres: Sequence[int],
    radius: float = 3.5,
    step: float = 0.1,
    scale: float = 1.17,
    with_hydrogen: bool = False,
    excluded: Sequence[int] = (),
    z_axis: Sequence[int] = (),
    xz_plane: Sequence[int] = (),
) -> DataFrame:
    """Share of a sphere round each centre atom inside any other atom sphere, per octant.

    mol_id, centre, octant (sign bits of x, y, z), points, buried, percent. Points are those of a lattice of spacing `step`, half a
    step off the axes so that none falls between octants. Only atom spheres are shuffled: those of a
    centre meet in one task, which sets their intervals of the lattice columns (ix, iy) in a bit lattice of fixed size.

    `excluded` atoms have no sphere. `z_axis` and `xz_plane` name atoms that turn the octants: the mean of the first lies on the
    negative z axis, that of the second in the half plane x > 0 of the xz plane (without them, a fixed axis decides). Molecules
    that lack one of the named atoms, or whose z axis has no length, drop out. Atoms without a known radius have no sphere.
    """
    origins, seen = _around_centres(atoms, centres, z_axis, xz_plane)
    spheres = seen.withColumn("r", el.lookup(el.BONDI_RADIUS, F.col("element")) * scale).where(
        (F.col("atom_idx") != F.col("centre")) & F.col("r").isNotNull())
    if not with_hydrogen:
        spheres = spheres.where(F.col("element") != "H")
    if excluded:
        spheres = spheres.where(~F.col("atom_idx").isin(*excluded))
    far = F.lit(float(radius)) + F.col("r")
    spheres = spheres.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= far * far * (1 + 1e-9))

    numbers = [F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "r")]
    dealt = spheres.select("mol_id", "centre", *numbers).repartition("mol_id", "centre").sortWithinPartitions("mol_id", "centre")
    types = dict(dealt.dtypes)
    inside = dealt.mapInArrow(_buried(radius, step), f"mol_id {types['mol_id']}, centre {types['centre']}, counts array<long>")

    # All octants hold as many lattice points, as the lattice is its own mirror image.
    squares = ((np.arange(math.ceil(radius / step) + 1) + 0.5) * step) ** 2
    plane = squares[:, None] + squares[None, :]
    points = sum(int((plane + z <= float(radius) ** 2).sum()) for z in squares)
    none = F.array(*[F.lit(0).cast("long")] * 8)
    total = origins.join(inside, ["mol_id", "centre"], "left").select("mol_id", "centre", F.posexplode(F.coalesce("counts", none)).alias("octant", "buried"))
    return total.select(
        "mol_id", "centre", "octant", F.lit(points).cast("long").alias("points"), "buried",
        (100 * F.col("buried") / F.lit(points).cast("long")).alias("percent"))


def buried_shells(atoms: DataFrame, centres: Sequence[int], radii: Sequence[float] = (3.5, 5.5), step: float = 0.1, **options) -> DataFrame:
    """Buried and free volume per sphere, whole and by quadrant (J22): mol_id, centre, radius, quadrant, percent, buried_volume, free_volume.

    `quadrant` has the sign bits of x and y; NULL is the whole sphere. Volumes are lattice points times step^3 (cubic A).
    `options` are those of `buried_volume`.
    """
    parts = None
    for radius in radii:
        one = buried_volume(atoms, centres, radius, step, **options).withColumn("radius", F.lit(float(radius)))
        parts = one if parts is None else parts.unionByName(one)
    parts = parts.select("mol_id", "centre", "radius", F.expr("octant & 3").alias("quadrant"), "points", "buried")
    sums = [F.sum(c).alias(c) for c in ("points", "buried")]
    quarters = cut_lineage(parts.groupBy("mol_id", "centre", "radius", "quadrant").agg(*sums))
    whole = quarters.groupBy("mol_id", "centre", "radius").agg(*sums).withColumn("quadrant", F.lit(None).cast("int"))
    cube = float(step) ** 3
    return quarters.unionByName(whole).select(
        "mol_id", "centre", "radius", "quadrant", (100 * F.col("buried") / F.col("points")).alias("percent"),
        (F.col("buried") * cube).alias("buried_volume"), ((F.col("points") - F.col("buried")) * cube).alias("free_volume"))


def cube_sterimol(
    grid_points: DataFrame, atoms: DataFrame, bonds: DataFrame, bases: Sequence[Sequence[int]], reach: float = 4.0
) -> DataFrame:
    """Extents of density points near the substituent atoms (A26): mol_id, spec_id, B1, B5, L, loc_B5.

    grid_points: mol_id, point_id, x, y, z. A point counts when its nearest atom belongs to the
    substituent. Points have no radius, so B1 is the smallest side over 1..90 degrees.
    """
    from orbitable.operators.neighbours import nearest_atom

    grid_points = cut_lineage(grid_points)  # read by the search and by the points it places
    owner = nearest_atom(grid_points, atoms, reach).select("mol_id", "point_id", "atom_idx")
    inside = og.reachable(atoms, bonds, bases).select("mol_id", "spec_id", "atom_idx")
    frame = ob.direction_atoms(bonds, bases)
    named = frame.select("*", F.explode(F.array("origin", "direction", "third")).alias("atom_idx"))
    point = lambda c, n: F.max(F.when(F.col("atom_idx") == F.col(c), F.struct("x", "y", "z"))).alias(n)
    basis = frames_from_points(
        atoms.select("mol_id", "atom_idx", "x", "y", "z")
        .join(named, ["mol_id", "atom_idx"])
        .groupBy("mol_id", "spec_id")
        .agg(point("origin", "origin_"), point("direction", "py"), point("third", "pp"))
        .withColumnRenamed("origin_", "origin")
        .dropna()
    ).where(~F.col("degenerate")).select("mol_id", "spec_id", "origin", "ex", "ey", "ez")
    placed = into_frame(
        grid_points.join(owner, ["mol_id", "point_id"])
        .join(inside, ["mol_id", "atom_idx"])
        .join(basis, ["mol_id", "spec_id"])
    )
    points = placed.select("mol_id", "spec_id", "x", "y", "z", F.lit(0.0).alias("radius"))
    keys = ["mol_id", "spec_id"]
    far = (v.norm((F.col("x"), F.lit(0.0), F.col("z"))), F.lit(0.0), F.col("y"))
    best = _scan(points, keys, F.col("y"), far, far, range(1, 91))
    return best.select(
        *keys, F.round("b1", 4).alias("B1"), F.round("far", 4).alias("B5"), F.round("top", 4).alias("L"), F.round("tip", 4).alias("loc_B5"),
    )
