"""Atom renumbering, map repair and the permutation check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.session import cut_lineage


def _mapped(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    table = mapping.select("mol_id", F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(table, ["mol_id", column], "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new")


def renumber(df: DataFrame, mapping: DataFrame, column: str = "atom_idx") -> DataFrame:
    """Apply a 1-based old -> new map to one atom column; unlisted atoms keep their number."""
    return _mapped(df, mapping, column).select(*df.columns)


def renumber_bonds(bonds: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends mapped, then put in order again."""
    out = _mapped(_mapped(bonds, mapping, "a"), mapping, "b")
    return out.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).select(*bonds.columns)


def renumber_tables(tables: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """Every normalised table of a set of molecules."""
    out = dict(tables)
    for name, df in tables.items():
        if name == "bonds":
            out[name] = renumber_bonds(df, mapping)
        elif "atom_idx" in df.columns:
            out[name] = renumber(df, mapping)
    return out


def invert(mapping: DataFrame) -> DataFrame:
    return mapping.select("mol_id", F.col("new").alias("old"), F.col("old").alias("new"))


def complete_map(atoms: DataFrame, mapping: DataFrame) -> DataFrame:
    """A permutation of every molecule's atoms from a partial map: mol_id, old, new.

    Maps to itself or outside the molecule are dropped, then repeated sources and targets (lowest
    kept); the tail of an open chain is sent to its head; the rest keeps its number. Heads are
    carried to tails by pointer doubling, so a chain of length L takes about log2(L) rounds.
    """
    known = atoms.select("mol_id", "atom_idx")
    clean = (
        mapping.where(F.col("old") != F.col("new"))
        .join(known.withColumnRenamed("atom_idx", "old"), ["mol_id", "old"], "left_semi")
        .join(known.withColumnRenamed("atom_idx", "new"), ["mol_id", "new"], "left_semi")
        .groupBy("mol_id", "old").agg(F.min("new").alias("new"))
        .groupBy("mol_id", "new").agg(F.min("old").alias("old"))
        .select("mol_id", "old", "new")
    )
    clean = cut_lineage(clean)
    heads = clean.join(clean.select("mol_id", F.col("new").alias("old")), ["mol_id", "old"], "left_anti")
    walk = heads.select("mol_id", F.col("old").alias("head"), F.col("new").alias("at"))
    jump = clean
    while True:
        hop = jump.select("mol_id", F.col("old").alias("at"), F.col("new").alias("_to"))
        moved = cut_lineage(walk.join(hop, ["mol_id", "at"], "left"))
        walk = moved.select("mol_id", "head", F.coalesce("_to", "at").alias("at"))
        if moved.where("_to IS NOT NULL").isEmpty():
            break
        twice = jump.select("mol_id", F.col("old").alias("new"), F.col("new").alias("_far"))
        jump = cut_lineage(
            jump.join(twice, ["mol_id", "new"], "left").select("mol_id", "old", F.coalesce("_far", "new").alias("new"))
        )
    closing = walk.select("mol_id", F.col("at").alias("old"), F.col("head").alias("new"))
    listed = clean.unionByName(closing)
    rest = known.select("mol_id", F.col("atom_idx").alias("old")).join(listed, ["mol_id", "old"], "left_anti")
    return listed.unionByName(rest.select("mol_id", "old", F.col("old").alias("new")))


def is_permutation(mapping: DataFrame) -> DataFrame:
    """mol_id, bijective: sources and targets are the same set, each once."""
    side = lambda c, old: F.struct(F.col(c).alias("atom"), F.lit(old).alias("old"))
    ends = mapping.select("mol_id", F.inline(F.array(side("old", 1), side("new", 0))))
    atoms = ends.groupBy("mol_id", "atom").agg(F.sum("old").alias("old"), F.count("*").alias("n"))
    return atoms.groupBy("mol_id").agg(F.min(F.col("atom").isNotNull() & (F.col("old") == 1) & (F.col("n") == 2)).alias("bijective"))


def check_renumbering(
    before: DataFrame, after: DataFrame, mapping: DataFrame, columns: Sequence[str], atol: float = 1e-8, rtol: float = 1e-5
) -> DataFrame:
    """Per column: rows compared, mismatches, largest absolute difference, equal.

    A row missing on one side counts as a mismatch; two NULLs are equal.
    """
    moved = renumber(before, mapping).select("mol_id", "atom_idx", F.lit(True).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    other = after.select("mol_id", "atom_idx", F.lit(True).alias("_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    both = moved.join(other, ["mol_id", "atom_idx"], "full_outer")
    types, cells = dict(before.dtypes), []
    for c in columns:
        b, a = F.col(f"{c}_b"), F.col(f"{c}_a")
        present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        if types[c] in ("string", "boolean"):
            diff, same = F.lit(None).cast("double"), b.eqNullSafe(a)
        else:
            diff = F.abs(b - a).cast("double")
            same = F.coalesce(diff <= atol + rtol * F.abs(a), b.isNull() & a.isNull())
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("rows"),
                F.sum(F.when(present & same, 0).otherwise(1)).alias("mismatches"), F.max(diff).alias("largest"),
            )
        )
    return both.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).withColumn("equal", F.col("mismatches") == 0)
