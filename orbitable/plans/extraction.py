"""Feature extraction: a spec and normalised tables to one row of descriptors per molecule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.operators import bonds as ob
from orbitable.operators import frames as of
from orbitable.operators import graph as og
from orbitable.operators import sterimol as ost
from orbitable.operators import vibrations as ov
from orbitable.session import cut_lineage
from orbitable.sources.tables import parse_spec

WIDE_LIMIT = 5000  # beyond this many features the result stays long


def frame_of(group: Sequence) -> dict:
    """[origin, y, plane], [o1, o2, ..., y, plane] or [[o1, o2], y, plane]."""
    head = group[0] if isinstance(group[0], (list, tuple)) else list(group[:-2])
    return {"origin": [int(a) for a in head], "y": int(group[-2]), "plane": int(group[-1])}


def _tag(group: Sequence) -> str:
    return "-".join(str(a) for a in group)


def _long(df: DataFrame, tags: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Columns of a (mol_id, spec_id) table as rows <prefix>_<tag>."""
    tag = F.create_map(*[F.lit(x) for i, t in enumerate(tags, 1) for x in (i, t)])[F.col("spec_id")]
    cells = [F.struct(F.concat(F.lit(f"{label}_"), tag).alias("feature"), F.col(c).cast("double").alias("value")) for c, label in columns.items()]
    return df.select("mol_id", F.inline(F.array(*cells))).where("value IS NOT NULL")


STRETCH = {"frequency": "stretch_frequency", "amplitude": "stretch_amplitude"}
BEND = {"frequency": "bend_frequency", "amplitude": "bend_amplitude"}
RING = {"cross": "ring_cross", "cross_angle": "ring_cross_angle", "para": "ring_para", "para_angle": "ring_para_angle"}
NPA = {"dip_x": "npa_x", "dip_y": "npa_y", "dip_z": "npa_z", "total": "npa_total"}
DIPOLE = {"dipole_x": "dip_x", "dipole_y": "dip_y", "dipole_z": "dip_z", "total": "dip_total"}
STERIMOL = {"B1": "B1", "B5": "B5", "L": "L", "loc_B5": "loc_B5", "B1_B5_angle": "B1_B5_angle"}
SCALARS = ("iso", "aniso", "homo_lumo_gap_ev")


def feature_names(spec: dict[str, list[list[int]]], schemes: Sequence[str]) -> list[str]:
    """Every column the spec can give, in report order; known before any data is read."""
    out: list[str] = []
    for kind, labels in (("ring", RING), ("stretching", STRETCH), ("bending", BEND), ("npa", NPA), ("dipole", DIPOLE)):
        for group in spec.get(kind, []):
            tag = _tag(group[:1]) if kind == "ring" else _tag(group)
            out += [f"{label}_{tag}" for label in labels.values()]
    for group in spec.get("charges", []) or []:
        out += [f"{s}_atom_{a}" for s in schemes for a in group]
    for group in spec.get("charge_diff", []) or []:
        out += [f"{s}_diff_{_tag(group)}" for s in schemes]
    for group in spec.get("sterimol", []):
        out += [f"{label}_{_tag(group)}" for label in STERIMOL.values()]
    for group in spec.get("bond_angle", []):
        out.append(f"{'angle' if len(group) == 3 else 'dihedral'}_{_tag(group)}")
    for group in spec.get("bond_length", []):
        out.append(f"bond_length_{_tag(group)}")
    return list(dict.fromkeys([*out, *SCALARS]))


def long_features(
    tables: dict[str, DataFrame], spec: dict, *, schemes: Sequence[str] = ("nbo", "hirshfeld", "cm5"), radii: str = "CPK",
    stretch: float = 1600.0, upper_stretch: float = 3500.0, bend: float = 1300.0,
) -> DataFrame:
    """mol_id, feature, value for everything the spec asks for; missing values give no row.

    The tables are read once per kind of feature, so they should be stored tables (see
    `sources.records`), not views with a long plan behind them. Features that take many shuffles are stored as they are found, so
    the shuffles of one end before those of the next begin.
    """
    spec = spec if all(isinstance(v, list) for v in spec.values()) else parse_spec(spec)
    first = lambda key, default: float(spec[key][0][0]) if spec.get(key) else default
    stretch, upper_stretch, bend = first("stretch", stretch), first("upper_stretch", upper_stretch), first("bend", bend)
    sub = [a for group in spec.get("sub_atoms", []) for a in group] or None
    atoms, bonds = tables["atoms"], tables["bonds"]
    parts: list[DataFrame] = []
    if spec.get("ring"):
        seeds = [g[0] for g in spec["ring"]]
        rings = og.six_rings(bonds, seeds)
        rows = ov.ring_vibrations(atoms, rings, tables["modes"], tables["displacements"])
        position = F.create_map(*[F.lit(x) for i, s in enumerate(seeds, 1) for x in (s, i)])
        parts.append(_long(rows.withColumn("spec_id", position[F.col("seed")]), [str(s) for s in seeds], RING))
    if spec.get("stretching"):
        rows = cut_lineage(ov.stretches(atoms, bonds, tables["modes"], tables["displacements"], spec["stretching"], stretch, upper_stretch))
        parts.append(_long(rows, [_tag(g) for g in spec["stretching"]], STRETCH))
    if spec.get("bending"):
        rows = cut_lineage(ov.bends(bonds, tables["modes"], tables["displacements"], spec["bending"], bend))
        parts.append(_long(rows, [_tag(g) for g in spec["bending"]], BEND))
    if spec.get("npa"):
        rows = of.charge_dipoles(atoms, tables["charges"], [frame_of(g) for g in spec["npa"]], "nbo", sub)
        parts.append(_long(rows, [_tag(g) for g in spec["npa"]], NPA))
    if spec.get("dipole"):
        rows = of.dipoles_in_frame(atoms, tables["mol_scalars"], [frame_of(g) for g in spec["dipole"]])
        parts.append(_long(rows, [_tag(g) for g in spec["dipole"]], DIPOLE))
    if spec.get("charges"):
        parts.append(of.atom_charges(tables["charges"], sorted({a for g in spec["charges"] for a in g}), schemes))
    if spec.get("charge_diff"):
        parts.append(of.charge_differences(tables["charges"], spec["charge_diff"], schemes))
    if spec.get("sterimol"):
        bases, a, b = spec["sterimol"], atoms, bonds
        dropped = sorted({i for g in spec.get("drop_atoms", []) for i in g})
        if dropped:
            a, b = ob.drop_atoms(atoms, bonds, dropped)
            bases = [[i - sum(d < i for d in dropped) for i in g] for g in bases]
        parts.append(_long(cut_lineage(ost.sterimol(a, b, bases, radii)), [_tag(g) for g in spec["sterimol"]], STERIMOL))
    if spec.get("bond_angle"):
        parts.append(of.angles(atoms, spec["bond_angle"]))
    if spec.get("bond_length"):
        parts.append(of.bond_lengths(atoms, spec["bond_length"]))
    scalars = tables["mol_scalars"]
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in SCALARS if c in scalars.columns]
    parts.append(scalars.select("mol_id", F.inline(F.array(*cells))).where("value IS NOT NULL"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def feature_matrix(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per molecule with the named columns, NULL where a feature is missing."""
    if len(names) > WIDE_LIMIT:
        raise ValueError(f"more than {WIDE_LIMIT} features: keep the long form")
    return long.groupBy("mol_id").pivot("feature", list(names)).agg(F.first("value"))


def extract_features(tables: dict[str, DataFrame], spec: dict, schemes: Sequence[str] = ("nbo", "hirshfeld", "cm5"), **options) -> DataFrame:
    """Spec to feature matrix."""
    parsed = spec if all(isinstance(v, list) for v in spec.values()) else parse_spec(spec)
    return feature_matrix(long_features(tables, parsed, schemes=schemes, **options), feature_names(parsed, schemes))


def quality_report(matrix: DataFrame, names: Sequence[str], threshold: float = 0.8, duplicate: float = 0.999) -> DataFrame:
    """Correlated pairs, near duplicates and missing shares as rows: kind, feature, other, value."""
    from orbitable.operators.clean import missing_percent
    from orbitable.operators.moments import correlation_long

    long = correlation_long(matrix, names).where(F.abs("r") > threshold)
    pairs = long.select(
        F.when(F.abs("r") > duplicate, "duplicate").otherwise("correlated").alias("kind"), F.col("f1").alias("feature"),
        F.col("f2").alias("other"), F.col("r").alias("value"),
    )
    missing = missing_percent(matrix, names).where("percent > 0").select(
        F.lit("missing").alias("kind"), F.col("column").alias("feature"), F.lit(None).cast("string").alias("other"), F.col("percent").alias("value"))
    return pairs.unionByName(missing)


def molecule_summary(tables: dict[str, DataFrame], radii: str = "CPK") -> DataFrame:
    """Gap, dipole and the extents seen from the central atom, sorted by gap."""
    atoms, bonds = tables["atoms"], tables["bonds"]
    bases = cut_lineage(ob.centre_atoms(atoms, bonds).where("partner IS NOT NULL").select(
        "mol_id", F.lit(1).alias("spec_id"), F.col("centre").alias("origin"), F.col("partner").alias("direction")))
    extents = ost.sterimol(atoms, bonds, bases, radii).drop("spec_id")
    return tables["mol_scalars"].join(extents, "mol_id", "left").orderBy("homo_lumo_gap_ev", "mol_id")
