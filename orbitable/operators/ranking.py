"""Row numbers and running sums that do not put a group into one task.

A plain window sorts each partition key in one task; with no key, or with a key that holds a third
of all rows, that task is the job. Here rows are cut into buckets that follow the order, numbered
inside (key, bucket), and shifted by the sizes of the earlier buckets, which are a small aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_BUCKETS = 32
CUT_SAMPLE = 20_000


def bucket_count(df: DataFrame) -> int:
    """Buckets for `df`: two per shuffle partition, so that sorting keeps the whole cluster busy."""
    return max(LEAST_BUCKETS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_order(*columns, seed: int = 0) -> Column:
    """Repeatable pseudo-random order key."""
    return F.xxhash64(*columns, F.lit(seed))


def hash_buckets(df: DataFrame, name: str) -> Column:
    """Buckets of a 64-bit hash column, in hash order."""
    bits = (bucket_count(df) - 1).bit_length()
    return F.shiftright(F.col(name), 64 - bits)


def value_buckets(df: DataFrame, name: str, n: int | None = None) -> Column:
    """Buckets of about equal size that follow an orderable column; NULLs come first.

    Text columns are cut at quantiles of a bounded sample of their values, drawn by a hash.
    """
    n = n or bucket_count(df)
    value = F.col(name)
    if dict(df.dtypes)[name] == "string":
        sample = df.select(value.alias("v")).where("v IS NOT NULL").distinct().orderBy(F.xxhash64("v"), "v").limit(CUT_SAMPLE)
        seen = [r["v"] for r in sample.orderBy("v").collect()]
        cuts = sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []
    else:
        value = value.cast("double")
        shares = F.array(*[F.lit(i / n) for i in range(1, n)])
        cuts = sorted(set(df.agg(F.percentile_approx(value, shares, F.lit(1000)).alias("c")).first()["c"] or []))
    below = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value) if cuts else None
    return F.lit(0) if below is None else F.when(value.isNull(), 0).otherwise(F.size(below))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on `keys` in which two NULLs are equal; the keys of `left` stay."""
    renamed = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, same).drop(*[f"_key_{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, name: str = "rank") -> DataFrame:
    """row_number() over (partition by keys order by order). `bucket` must follow the order."""
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        join_null_safe(rows.withColumn("_inner", F.row_number().over(inside)), offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_inner") + F.col("_offset"))
        .drop("_bucket", "_inner", "_offset")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, sums: dict[str, str]) -> DataFrame:
    """Running totals of columns over (keys order by order), plus next_<order>, the following value.

    `sums` maps new column -> summed column. Rows are expected to have distinct order values per key.
    """
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], F.min(order).alias("_first")
    )
    by_bucket = W.partitionBy(*keys).orderBy("_bucket")
    earlier = by_bucket.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        F.lead("_first").over(by_bucket).alias("_after"),
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows
    for n, c in sums.items():
        out = out.withColumn(f"_i_{n}", F.sum(c).over(upto))
    out = join_null_safe(out.withColumn("_next", F.lead(order).over(inside)), offsets, [*keys, "_bucket"])
    return out.select(
        *df.columns,
        *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        F.coalesce("_next", "_after").alias(f"next_{order}"),
    )


def lagged_pairs(df: DataFrame, order: str, lags: Sequence[int], values: Sequence[str]) -> DataFrame:
    """Rows with value_lag<k> columns: the value k rows earlier in a gap-free integer order.

    Every row goes to its own position and to the positions of its lags, in one shuffle; a position
    gathers one row per lag. NULL before the start.
    """
    lags, names = list(dict.fromkeys(lags)), [c for c in df.columns]
    copies = F.explode(F.array(*[F.lit(k) for k in [0, *lags]])).alias("_lag")
    rows = df.select(F.struct(*names).alias("_row"), copies)
    rows = rows.withColumn("_at", F.col("_row")[order] + F.col("_lag"))
    pick = lambda k: F.first(F.when(F.col("_lag") == k, F.col("_row")), ignorenulls=True)
    met = rows.groupBy("_at").agg(*[pick(k).alias(f"_r{k}") for k in [0, *lags]]).where("_r0 IS NOT NULL")
    return met.select(*[F.col("_r0")[c].alias(c) for c in names],
                      *[F.col(f"_r{k}")[v].alias(f"{v}_lag{k}") for k in lags for v in values])
