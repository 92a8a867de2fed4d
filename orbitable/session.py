"""Session helpers: builder, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a table may have before it is no longer broadcast. Every broadcast in the
# package goes through `broadcast_rows` or `broadcast_checked`.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "orbitable", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a molecule that holds a large share of the atoms even where that costs a shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; only a single-process session may fall back to its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="orbitable-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the checkpoint folder and read it back.

    Lineage ends there, so a lost executor costs no recomputation; unlike an RDD checkpoint the
    table keeps column pruning, filters and size statistics for the plans that follow.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/orbitable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_rows(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a table built from `n_rows` driver-side rows, if that is small enough."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROW_LIMIT else df


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast `df` after counting (at most limit + 1 rows); beyond the limit Spark shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
