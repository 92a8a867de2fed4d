"""XYZ geometry text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitable.session import cut_lineage


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: mol_id (file name without suffix), path, text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.withColumn("mol_id", molecule_name(F.col("path")))


def molecule_name(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _split_lines(text):
    return F.split(F.regexp_replace(F.rtrim(F.regexp_replace(text, r"\s+$", "")), "\r", ""), "\n")


def xyz_rows(texts: DataFrame) -> DataFrame:
    """Atom lines of every frame: mol_id, frame, n_declared, atom_idx, element, x, y, z.

    Frames of equal atom count may follow each other in one text. Works the same on a stream.
    """
    lines = _split_lines("text")
    step = texts.select("mol_id", lines.alias("lines"))
    step = step.withColumn("n", F.expr("try_cast(trim(lines[0]) AS INT)"))
    step = step.select("mol_id", "n", F.posexplode("lines").alias("pos", "line"))
    size = F.col("n") + 2
    step = step.where("n IS NOT NULL").withColumns(
        {"frame": F.floor(F.col("pos") / size).cast("int"), "at": F.pmod(F.col("pos"), size).cast("int")}
    ).where("at >= 2")
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.expr(f"try_cast(get(parts, {i}) AS DOUBLE)")
    return step.withColumn("parts", parts).select(
        "mol_id", "frame", F.col("n").alias("n_declared"), (F.col("at") - 1).alias("atom_idx"),
        F.get("parts", F.lit(0)).alias("element"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"),
    )


def frame_fault(text: str):
    """What is wrong with the line counts of an XYZ text, NULL for whole frames of the first frame's size.

    Every frame starts with the same atom count; its lines are counted in the text's one row, so the
    check is the same on a stream.
    """
    return _lines_fault(_split_lines(text))


def _lines_fault(lines):
    count = lambda line: F.trim(line).try_cast("int")
    n = F.when(count(lines[0]) >= 0, count(lines[0]))
    starts = F.filter(lines, lambda line, i: F.pmod(i, n + 2) == 0)
    return F.when(n.isNull(), "no atom count").when(
        F.pmod(F.size(lines), n + 2) != 0, "atom count differs").when(
        F.exists(starts, lambda line: ~F.coalesce(count(line) == n, F.lit(False))), "atom count differs")


def parse_xyz(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, rejected) of the first frame: molecules whose lines do not match the declared count are rejected.

    rejected: mol_id, status, error. Further frames must be whole; surplus or missing lines reject the molecule.
    """
    # Lines are a column of their own: the check names them several times.
    texts = texts.withColumn("lines", _split_lines("text")).withColumn("_fault", _lines_fault(F.col("lines")))
    # The lines of a text are counted in its own row, in one pass; what follows joins these counts only.
    declared = F.expr("try_cast(trim(lines[0]) AS INT)")
    number = lambda parts, i: F.get(parts, F.lit(i)).try_cast("double").isNotNull()
    whole = lambda parts: number(parts, 1) & number(parts, 2) & number(parts, 3)
    good = F.filter(F.slice("lines", F.lit(3), F.col("n")), lambda line: whole(F.split(F.trim(line), r"\s+")))
    counted = texts.select("mol_id", "_fault", "lines").withColumn("n", F.when(F.col("_fault").isNull(), declared))
    counted = cut_lineage(counted.select("mol_id", "_fault", "n", F.when(F.col("n") > 0, F.size(good)).cast("long").alias("good")))
    faults = counted.where("_fault IS NOT NULL").select("mol_id", "_fault")
    check = counted.where("n > 0").groupBy("mol_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("n_declared"), F.sum("good").alias("n_good"))
    ok = check.where((F.col("n") == F.col("n_declared")) & (F.col("n_good") == F.col("n"))).select("mol_id")
    rows = xyz_rows(texts.where("_fault IS NULL").drop("lines").join(ok, "mol_id", "left_semi")).where("frame = 0")
    atoms = rows.select("mol_id", "atom_idx", "element", "x", "y", "z")
    error = F.coalesce("_fault", F.when(F.col("n").isNull(), "no atom count").when(
        F.col("n") != F.col("n_declared"), "atom count differs").otherwise("bad coordinate"))
    rejected = (
        counted.select("mol_id").join(ok, "mol_id", "left_anti").join(check, "mol_id", "left").join(faults, "mol_id", "left")
        .select("mol_id", F.lit("failed").alias("status"), error.alias("error"))
    )
    return atoms, rejected


def _atom_line():
    """Number and text of an atom's line."""
    number = lambda c: F.format_string("%.6f", F.col(c))
    return ((F.col("atom_idx") + 2).cast("long").alias("line_no"),
            F.concat_ws(" ", "element", number("x"), number("y"), number("z")).alias("line"))


def _top_lines(n, comment: str):
    return F.array(*[F.struct(F.lit(k).cast("long").alias("line_no"), line.alias("line")) for k, line in ((1, n), (2, F.lit(comment)))])


def xyz_lines(atoms: DataFrame, comment: str = "") -> DataFrame:
    """Lines of the XYZ text per molecule: mol_id, line_no, line. No molecule is gathered in one task."""
    head = atoms.groupBy("mol_id").agg(F.count("*").cast("string").alias("n"))
    return atoms.select("mol_id", *_atom_line()).unionByName(head.select("mol_id", F.inline(_top_lines(F.col("n"), comment))))


def xyz_text(atoms: DataFrame, comment: str = "") -> DataFrame:
    """mol_id, text: one text per molecule, for molecules that fit in a file. The atoms are read once."""
    met = atoms.groupBy("mol_id").agg(F.collect_list(F.struct(*_atom_line())).alias("body"), F.count("*").cast("string").alias("n"))
    lines = F.sort_array(F.concat("body", _top_lines(F.col("n"), comment)))
    return met.select("mol_id", F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("text"))


def write_xyz(atoms: DataFrame, path: str) -> None:
    """One folder per molecule; lines are range-partitioned, so part files are in line order."""
    (
        xyz_lines(atoms).repartitionByRange("mol_id", "line_no").sortWithinPartitions("mol_id", "line_no")
        .select("mol_id", "line").write.partitionBy("mol_id").mode("overwrite").text(path)
    )
