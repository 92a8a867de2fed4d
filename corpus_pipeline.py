"""Corpus cleaning in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet
below the checkpoint folder and reads it again, so that a lost executor costs one stage at most. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orbitable.llm import decontaminate, langid, line_dedup, minhash, packing
from orbitable.llm.queries import BYTE_BPE
from orbitable.session import scratch_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled rows of `docs`."""
    return langid.identify(docs, langid.learn(docs), whole_rows=True).filter("not rejected").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no line is left."""
    return line_dedup.dedup_lines(docs, min_chars=line_dedup.ANY_LENGTH)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontaminate.contained_items(docs, items).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in training windows."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language id", language),
    ("line dedup", lines),
    ("minhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("packing", windows),
]

#: A learned language model, edit distances and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
