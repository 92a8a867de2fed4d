"""Feature tables, targets, identifiers and specs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitable.functions.labels import first_integer, parse_spec_value
from orbitable.operators import clean


def read_features(spark: SparkSession, path: str, target: str, name: str | None = None, drops: Sequence = (), sep: str = ",") -> DataFrame:
    """A feature CSV, all columns read as text and then cleaned: id, seq, y, features."""
    raw = spark.read.csv(path, header=True, sep=sep)
    unnamed = {c: "name" for c in raw.columns if not c.strip() or c == "_c0"}
    for old, new in list(unnamed.items())[:1]:
        raw = raw.withColumnRenamed(old, new)
    # monotonically_increasing_id follows the order of the lines of a file.
    return clean.prepare(raw.withColumn("_seq", F.monotonically_increasing_id()), target, "_seq", name, drops)


def join_target(features: DataFrame, targets: DataFrame, key: str = "id", target: str = "y") -> DataFrame:
    """Target from a second table, matched by name."""
    return features.drop(target).join(targets.select(key, target), key)


def read_identifiers(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Headerless CSV of name and identifier."""
    return spark.read.csv(path, header=False, encoding=encoding).toDF("name", "identifier")


def spec_key(prompt: str) -> str:
    """First word of the prompt, lower-case, with underscores."""
    return prompt.split()[0].lower().replace("-", "_")


def parse_spec(entries: dict) -> dict[str, list[list[int]]]:
    """Prompt -> value into key -> list of atom lists."""
    return {spec_key(k): parse_spec_value(v) for k, v in entries.items()}


def read_spec(spark: SparkSession, path: str) -> dict[str, list[list[int]]]:
    """A spec JSON file; it is one small object, read through Spark so any file system works."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return parse_spec(json.loads(text))


def save_spec(spark: SparkSession, entries: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def spec_table(spark: SparkSession, spec: dict[str, list[list[int]]]) -> DataFrame:
    rows = [(kind, i, atoms) for kind, groups in spec.items() for i, atoms in enumerate(groups, 1)]
    return spark.createDataFrame(rows, "kind string, spec_id int, atoms array<int>")


def write_matrix(wide: DataFrame, path: str, name: str = "mol_id") -> None:
    """Feature matrix CSV ordered by the first integer of the name."""
    order = [first_integer(F.col(name).cast("string")).asc_nulls_last(), F.col(name).asc()]
    wide.orderBy(*order).write.mode("overwrite").csv(path, header=True)
