"""File-source streams over the same parsers as the batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitable.sources.xyz import frame_fault, molecule_name, xyz_rows


def stream_texts(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder as (mol_id, text), at most `max_files` per micro-batch."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder, wholetext=True)
    return raw.select(molecule_name(F.input_file_name()).alias("mol_id"), F.col("value").alias("text"))


def stream_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """Atoms of new XYZ files; files append to the normalised table with a checkpointed sink.

    A file enters whole or not at all: wrong line counts or an unreadable coordinate leave it out (see stream_rejects).
    """
    texts = stream_texts(spark, folder).withColumn("_fault", text_fault("text")).where("_fault IS NULL")
    return xyz_rows(texts).where("frame = 0").select("mol_id", "atom_idx", "element", "x", "y", "z")


def text_fault(text: str):
    """As frame_fault, with unreadable atom lines of the first frame, from the text's one row."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), "\r", ""), "\n")
    atoms = F.slice(lines, 3, F.greatest(F.coalesce(F.trim(lines[0]).try_cast("int"), F.lit(0)), F.lit(0)))
    number = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
    good = F.forall(atoms, lambda line: F.trim(line).rlike(rf"^\S+\s+{number}\s+{number}\s+{number}(\s.*)?$"))
    return F.coalesce(frame_fault(text), F.when(~good, "bad coordinate"))


def stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """mol_id, error of new files that stream_atoms leaves out."""
    texts = stream_texts(spark, folder).withColumn("error", text_fault("text"))
    return texts.where("error IS NOT NULL").select("mol_id", "error")


def append_stream(atoms: DataFrame, table: str, checkpoint: str):
    """Exactly-once Parquet sink; processes what is there and stops."""
    return (
        atoms.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
