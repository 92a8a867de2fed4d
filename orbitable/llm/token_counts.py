"""Token counts through a digest cache.

Each text has a digest, each vocabulary file has one too. Counts live in a table keyed by both; only
distinct texts that the table lacks are encoded and then appended, so a corpus that was counted once
costs a join. An append is one committed Spark write: a lost task or job leaves no half rows, and
rows that two writers appended at once are read as one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.llm.arrays import chunks
from orbitable.llm.tokens import CHUNK_BYTES, encoder, version

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def _count(path: str, tokenizer: str):
    def run(batches):
        for batch in chunks(batches, CHUNK_BYTES):
            counts = encoder(path).count(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([tokenizer] * len(counts)), pa.array(counts, pa.int64())],
                names=["digest", "tokenizer", "n_tokens"])
        encoder(path).forget()
    return run


def _stored(spark, cache: str, tokenizer: str) -> DataFrame:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)
    return found.filter(F.col("tokenizer") == tokenizer)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of `docs`; `cache` is the folder of the count table.

    A null text counts as empty. Repeated rows and ids stay as they are. `path` is a vocabulary
    file that every worker has (.json: tokenizers, .model: sentencepiece).
    """
    spark, tokenizer = docs.sparkSession, version(path)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))
    misses = keyed.select("digest", "text").join(_stored(spark, cache, tokenizer).select("digest"), "digest", "left_anti")
    misses = misses.dropDuplicates(["digest"])
    misses.mapInArrow(_count(path, tokenizer), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = _stored(spark, cache, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
