"""Cleaning of feature tables (PF1-PF10, PF15-PF21, A12)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitable.operators.ranking import numbered, value_buckets

# Column names that may hold the row name, in order of preference.
NAME_COLUMNS = ("name", "names", "molecule", "molecule_name", "mol", "compound", "sample", "id")
# Text columns that are never features.
TEXT_COLUMNS = ("smiles", "canonical_smiles", "random_smiles")


def resolve(columns: Sequence[str], wanted: str) -> str:
    """Case-insensitive column lookup; an exact match wins."""
    if wanted in columns:
        return wanted
    for c in columns:
        if c.strip().lower() == wanted.strip().lower():
            return c
    raise KeyError(f"{wanted!r} not among {list(columns)}")


def name_column(columns: Sequence[str]) -> str:
    """First preferred name column, else the first column."""
    lower = {c.strip().lower(): c for c in reversed(columns)}
    return next((lower[n] for n in NAME_COLUMNS if n in lower), columns[0])


def unique_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns with the same name (PF4)."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            keep.append(i)
        seen.add(c)
    if len(keep) == len(df.columns):
        return df
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(df.columns[i]) for i in keep])


def drop_columns(df: DataFrame, drops: Sequence[str | int]) -> DataFrame:
    """Drop by name (case-insensitive) or position; unknown names are ignored (PF2, PF3)."""
    lower = {c.lower(): c for c in df.columns}
    names = {df.columns[d] if isinstance(d, int) else lower.get(str(d).lower()) for d in drops}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def to_number(column: str) -> Column:
    """DOUBLE or NULL; NaN becomes NULL."""
    value = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    return F.when(~F.isnan(value), value)


def numeric_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns with at least one number, in one pass (PF6)."""
    counts = df.agg(*[F.count(to_number(c)).alias(f"c{i}") for i, c in enumerate(names)]).collect()[0]
    return [c for i, c in enumerate(names) if counts[f"c{i}"] > 0]


def clean_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Trim, replace empty names by `row`, number repeats name#2, name#3 in `order` (PF7)."""
    text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    text = F.when((text == "") | (F.lower(text) == "nan"), "row").otherwise(text)
    named = df.withColumn(name, text)
    return (
        numbered(named, [name], [order], value_buckets(named, order), "_k")
        .withColumn(name, F.when(F.col("_k") > 1, F.concat(F.col(name), F.lit("#"), F.col("_k"))).otherwise(F.col(name)))
        .drop("_k")
    )


def prepare(df: DataFrame, target: str, order: str, name: str | None = None, drops: Sequence[str | int] = ()) -> DataFrame:
    """PF1-PF8 in one go: columns id, y, and the numeric features; rows without a target go.

    The target is numeric unless none of it parses; then its text is kept.
    """
    df = unique_columns(df)
    target = resolve(df.columns, target)
    ident = resolve(df.columns, name) if name else name_column([c for c in df.columns if c != order])
    df = drop_columns(drop_columns(df, TEXT_COLUMNS), drops)
    candidates = [c for c in df.columns if c not in (target, ident, order)]
    usable = numeric_columns(df, [*candidates, target])
    features = [c for c in candidates if c in usable]
    y = to_number(target) if target in usable else F.col(f"`{target}`").cast("string")
    out = df.select(
        F.col(f"`{ident}`").cast("string").alias("id"), F.col(f"`{order}`").alias("seq"), y.alias("y"),
        *[to_number(c).alias(c) for c in features],
    )
    return clean_names(out.where(F.col("y").isNotNull()), "id", "seq")


def keep_ids(df: DataFrame, ids: DataFrame | Sequence, key: str = "id") -> DataFrame:
    return df.join(_as_table(df, ids, key), key, "left_semi")


def leave_out(df: DataFrame, ids: DataFrame | Sequence, key: str = "id") -> DataFrame:
    return df.join(_as_table(df, ids, key), key, "left_anti")


def mark_left_out(df: DataFrame, ids: Sequence, key: str = "id") -> DataFrame:
    """Add is_leftout; unknown ids are an error, as a typo would otherwise go unseen."""
    table = _as_table(df, ids, key)
    unknown = table.join(df.select(key), key, "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown ids: {[r[key] for r in unknown]}")
    return df.join(table.withColumn("is_leftout", F.lit(True)), key, "left").withColumn(
        "is_leftout", F.coalesce("is_leftout", F.lit(False))
    )


def _as_table(df: DataFrame, ids, key: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(key).distinct()
    kind = dict(df.dtypes)[key]
    return df.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` {kind}").distinct()


def finite_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows whose metrics are all present and finite (PF15)."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in metrics]
    return df.where(reduce(lambda a, b: a & b, ok))


def has_required(df: DataFrame, required: Sequence[str], combo: str = "combo") -> DataFrame:
    """Combinations that contain every required feature (PF16)."""
    return df.where(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.col(combo))) == 0) if required else df


def fill_mean(df: DataFrame, names: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in names]).collect()[0]
    return df.fillna({c: means[c] for c in names if means[c] is not None})


def column_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One pass: column, missing_percent, low, high, whole-number and constant tests."""
    cells = []
    for c in names:
        v = F.col(c)
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                (100 * F.avg(F.when(v.isNull(), 1.0).otherwise(0.0))).alias("missing_percent"),
                F.min(v).cast("double").alias("low"),
                F.max(v).cast("double").alias("high"),
                (F.max(F.abs(v - F.round(v))) == 0).alias("whole"),
                (F.min(v) == F.max(v)).alias("constant"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def useful_columns(df: DataFrame, names: Sequence[str], key: str, tolerance: float = 1e-8) -> list[str]:
    """Drop constant, duplicate and perfectly correlated columns, keeping the first (PF18)."""
    from orbitable.operators.moments import moments

    stats = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"),
                      F.sum(F.xxhash64(F.col(key), F.col(c).cast("double")).cast("decimal(38,0)")).alias("dg")).alias(f"s{i}")
             for i, c in enumerate(names)]
    row = df.agg(*stats).collect()[0]
    kept, digests = [], set()
    for i, c in enumerate(names):
        s = row[f"s{i}"]
        if s["lo"] != s["hi"] and s["dg"] not in digests:
            kept.append(c)
            digests.add(s["dg"])
    corr = moments(df, kept).correlation()
    final: list[int] = []
    for i in range(len(kept)):
        if all(abs(abs(corr[i, j]) - 1) > tolerance for j in final):
            final.append(i)
    return [kept[i] for i in final]


def categorical_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns whose values are all whole numbers (PF19)."""
    row = df.agg(*[F.max(F.abs(F.col(c) - F.round(c))).alias(f"c{i}") for i, c in enumerate(names)]).collect()[0]
    return [c for i, c in enumerate(names) if row[f"c{i}"] == 0]


def one_hot(df: DataFrame, name: str, drop_first: bool = True, limit: int = 1000) -> tuple[DataFrame, list[str]]:
    """Indicator columns for the levels of a column; too many levels are an error, never cut."""
    levels = [r[0] for r in df.select(name).distinct().limit(limit + 1).collect() if r[0] is not None]
    if len(levels) > limit:
        raise ValueError(f"{name} has more than {limit} levels")
    levels = sorted(levels)[1 if drop_first else 0:]
    text = lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    names = [f"{name}_{text(x)}" for x in levels]
    out = df.withColumns({n: F.when(F.col(name) == x, 1.0).otherwise(0.0) for n, x in zip(names, levels)})
    return out.drop(name), names


def standardise(df: DataFrame, names: Sequence[str], only_continuous: bool = False) -> DataFrame:
    """(x - mean) / population sd; constant columns become 0. Optionally skip whole-number columns (PF21)."""
    if only_continuous:
        whole = set(categorical_columns(df, names))
        names = [c for c in names if c not in whole]
    if not names:
        return df
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]).collect()[0]
    return df.withColumns(
        {c: (F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0) for i, c in enumerate(names)}
    )


def missing_percent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("column"), (100 * F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0))).alias("percent"))
        for c in names
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
