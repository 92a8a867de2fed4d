"""Molecule record files and the normalised tables."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitable.sources.xyz import molecule_name

TABLES = ("atoms", "charges", "mol_scalars", "modes", "displacements", "bonds")
CELL_SCHEMA = "mol_id string, status string, error string, block string, row int, mode int, name string, value double"
# Column blocks of a record file.
BLOCKS = {
    "atoms": ["x", "y", "z"],
    "scalars": ["dip_x", "dip_y", "dip_z", "total_dipole", "iso", "aniso", "energy"],
    "charges": ["nbo_charge", "hirshfeld_charge", "cm5_charge"],
    "modes": ["Frequency", "IR"],
}


def _cells(name: str, content: bytes) -> list[tuple]:
    """Long cells of one record file: blocks of different length sit side by side, padded with NaN."""
    import numpy as np
    import pyarrow.feather as feather

    table = feather.read_table(io.BytesIO(content)).to_pandas()
    table.columns = [str(c).strip() for c in table.columns]
    out = []
    if "atom" in table:
        for i, e in enumerate(table["atom"].dropna(), 1):
            out.append((name, "ok", str(e), "element", i, None, "element", None))
    for block, columns in BLOCKS.items():
        for c in columns:
            if c in table:
                values = np.asarray(table[c], dtype=float)
                for i, v in enumerate(values[~np.isnan(values)], 1):
                    out.append((name, "ok", None, block, i, None, c, float(v)))
    for c in table.columns:
        parts = c.split("_")
        if len(parts) == 3 and parts[0] == "mode" and parts[1].isdigit() and parts[2] in "xyz":
            values = np.asarray(table[c], dtype=float)
            for i, v in enumerate(values[~np.isnan(values)], 1):
                out.append((name, "ok", None, "displacements", i, int(parts[1]), f"d{parts[2]}", float(v)))
    return out


def read_records(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All record files under a path as normalised tables; unreadable files go to `rejected`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select(
        molecule_name(F.col("path")).alias("mol_id"), "content"
    )

    def unpack(batches):
        import pandas as pd

        names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch["mol_id"], batch["content"]):
                try:
                    rows = _cells(name, content)
                except Exception as error:  # noqa: BLE001
                    rows = [(name, "failed", str(error)[:500], None, None, None, None, None)]
                frame = pd.DataFrame(rows, columns=names)
                for c in ("row", "mode"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    from orbitable.session import cut_lineage

    cells = cut_lineage(files.mapInPandas(unpack, CELL_SCHEMA))
    wide = lambda block, keys, names: cells.where(F.col("block") == block).groupBy("mol_id", *keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    element = cells.where("block = 'element'").select("mol_id", F.col("row").alias("atom_idx"), F.col("error").alias("element"))
    atoms = wide("atoms", ["row"], ["x", "y", "z"]).withColumnRenamed("row", "atom_idx").join(element, ["mol_id", "atom_idx"])
    charges = cells.where("block = 'charges'").select(
        "mol_id", F.col("row").alias("atom_idx"), F.regexp_replace("name", "_charge$", "").alias("scheme"), F.col("value").alias("charge"))
    scalars = wide("scalars", [], BLOCKS["scalars"]).withColumnRenamed("energy", "homo_lumo_gap_ev")
    modes = wide("modes", ["row"], ["Frequency", "IR"]).select(
        "mol_id", F.col("row").alias("mode_idx"), F.col("Frequency").alias("frequency"), F.col("IR").alias("ir"))
    # In the file, the column number is the atom and the row is the mode.
    moves = wide("displacements", ["row", "mode"], ["dx", "dy", "dz"]).select(
        "mol_id", F.col("row").alias("mode_idx"), F.col("mode").alias("atom_idx"), "dx", "dy", "dz")
    return {
        "atoms": atoms.select("mol_id", "atom_idx", "element", "x", "y", "z"), "charges": charges, "mol_scalars": scalars,
        "modes": modes, "displacements": moves,
        "rejected": cells.where("status = 'failed'").select("mol_id", "status", "error"),
    }


def write_tables(tables: dict[str, DataFrame], folder: str, buckets: int = 256) -> None:
    """Normalised tables as Parquet, spread over `bucket` folders by a hash of the molecule."""
    for name, df in tables.items():
        df.withColumn("bucket", F.pmod(F.xxhash64("mol_id"), F.lit(buckets)).cast("int")).write.partitionBy("bucket").mode(
            "overwrite").parquet(f"{folder}/{name}")


def save_bucketed(tables: dict[str, DataFrame], database: str, buckets: int = 256) -> None:
    """The same as managed tables bucketed by molecule, so that later joins on it need no shuffle."""
    for name, df in tables.items():
        df.write.bucketBy(buckets, "mol_id").sortBy("mol_id").mode("overwrite").saveAsTable(f"{database}.{name}")


def dump_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per table and molecule."""
    for name, df in tables.items():
        df.write.partitionBy("mol_id").mode("overwrite").csv(f"{folder}/{name}", header=True)
