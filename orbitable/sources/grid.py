"""Volumetric grid text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.functions import elements as el
from orbitable.functions.energy import BOHR_TO_ANGSTROM

_NUMBER = r"-?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?"


def _numbers(text):
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda s: s.cast("double"))


def _lines(texts: DataFrame) -> DataFrame:
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    head = texts.select("mol_id", lines.alias("l"))
    row = lambda i: _numbers(F.get("l", F.lit(i)))
    return head.select("mol_id", "l", row(2).alias("o"), row(3).alias("ax"), row(4).alias("ay"), row(5).alias("az"))


def cube_atoms(texts: DataFrame) -> DataFrame:
    """Atoms in angstrom."""
    n = F.get("o", F.lit(0)).cast("int")
    rows = _lines(texts).select("mol_id", F.posexplode(F.slice("l", F.lit(7), n)).alias("i", "line")).withColumn("v", _numbers(F.col("line")))
    symbol = el.lookup({k: s for k, s in enumerate(el.SYMBOLS, 1)}, F.get("v", F.lit(0)).cast("int"))
    return rows.select("mol_id", (F.col("i") + 1).alias("atom_idx"), symbol.alias("element"),
                       *[(F.get("v", F.lit(k)) * BOHR_TO_ANGSTROM).alias(c) for k, c in ((2, "x"), (3, "y"), (4, "z"))])


def cube_grid(texts: DataFrame) -> DataFrame:
    """mol_id, ix, iy, iz (0-based), density and the grid geometry. Values follow x, then y, then z."""
    n = F.get("o", F.lit(0)).cast("int")
    head = _lines(texts)
    body = head.select(
        "mol_id", *[F.get(f"a{c}", F.lit(0)).cast("int").alias(f"n{c}") for c in "xyz"],
        *[F.get("o", F.lit(i + 1)).alias(f"o{c}") for i, c in enumerate("xyz")],
        *[F.get(f"a{c}", F.lit(i + 1)).alias(f"s{c}") for i, c in enumerate("xyz")],
        F.posexplode(_numbers(F.array_join(F.slice("l", n + 7, F.size("l")), " "))).alias("pos", "density"),
    )
    return body.select(
        "mol_id",
        F.floor(F.col("pos") / (F.col("ny") * F.col("nz"))).cast("int").alias("ix"),
        F.pmod(F.floor(F.col("pos") / F.col("nz")), F.col("ny").cast("long")).cast("int").alias("iy"),
        F.pmod(F.col("pos"), F.col("nz")).cast("int").alias("iz"),
        "density", "ox", "oy", "oz", "sx", "sy", "sz",
    )


def surface_points(grid: DataFrame, isovalue: float = 0.003, angstrom: bool = True) -> DataFrame:
    """Points with iso <= density <= 1.1 iso: mol_id, point_id, x, y, z; origin + (i + 1) * step."""
    unit = BOHR_TO_ANGSTROM if angstrom else 1.0
    place = lambda c: ((F.col(f"o{c}") + (F.col(f"i{c}") + 1) * F.col(f"s{c}")) * unit).alias(c)
    return grid.where(F.col("density").between(isovalue, 1.1 * isovalue)).select(
        "mol_id", F.concat_ws("-", "ix", "iy", "iz").alias("point_id"), *[place(c) for c in "xyz"]
    )
