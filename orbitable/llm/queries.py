"""Registered queries of the operators in this folder, with their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitable.llm import best_fit, collocations, decontaminate, embedding_dedup, importance, langid, line_dedup
from orbitable.llm import minhash, quality, substring_dedup, suffix_dedup
from orbitable.llm.minhash import near_duplicates
from orbitable.llm.packing import pack
from orbitable.llm.substring_dedup import remove_repeats
from orbitable.llm.suffix_dedup import remove_copied_bytes
from orbitable.llm.token_counts import count_tokens
from orbitable.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op9_minhash_near_dedup", minhash.ORACLE)
def _minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op7_token_counts")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts with a cache of this run's own; a corpus that keeps its cache passes the same folder each time."""
    cache = f"{scratch_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, folder, "documents"), BYTE_BPE, cache)


@query("op5_packing")
def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), BYTE_BPE)


@query("op6_language_id")
def _language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.learn(docs))


@query("op10_decontamination", decontaminate.ORACLE)
def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_line_dedup")
def _line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"), min_chars=line_dedup.ANY_LENGTH)


@query("op3_substring_dedup", substring_dedup.ORACLE)
def _substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept_text")


@query("op1_suffix_array_dedup", suffix_dedup.ORACLE)
def _suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_copied_bytes(table(spark, folder, "documents")).drop("spans")


@query("op4_embedding_near_dedup", embedding_dedup.ORACLE)
def _embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


@query("op8_quality_classifier")
def _quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The source stands for the host, a language section of it for the path."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.score_quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


@query("op11_importance_resampling", importance.ORACLE)
def _importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_phrase_collocations", collocations.ORACLE)
def _phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_best_fit_packing")
def _best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.pack_best_fit(table(spark, folder, "documents"), BYTE_BPE)
