"""Moment (Gram) matrices in one pass (M1) and what follows from them.

Narrow tables use Catalyst's `covar_pop`, which merges partial aggregates stably and stays in
generated code. Wide ones sum block products per Arrow batch in a task: each task emits one row
per group and feature, whatever its number of rows, so no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NARROW = 16
SHIFT_ROWS = 256
STATE_BYTES = 256 << 20


@dataclass
class Moments:
    """Count, means and centred cross products of some columns."""

    names: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def at(self, names: Sequence[str]) -> list[int]:
        where = {c: i for i, c in enumerate(self.names)}
        return [where[c] for c in names]

    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cross), 0.0) / max(self.n, 1))

    def correlation(self) -> np.ndarray:
        d = np.sqrt(np.maximum(np.diag(self.cross), 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.cross / np.outer(d, d)


def complete_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in which every named column is present and finite (PF20)."""
    values = F.array(*[F.col(c).cast("double") for c in names])
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.forall(values, usable)) if names else df


def moment_rows(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: n, mean array, upper triangle of the centred cross products as an array."""
    names, keys = list(names), list(keys)
    if len(names) <= NARROW:
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        cross = [F.covar_pop(F.col(names[i]), F.col(names[j])) * F.count(F.lit(1)) for i, j in pairs]
        grouped = df.groupBy(*keys) if keys else df.groupBy()
        return grouped.agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(c) for c in names]).alias("mean"),
            F.array(*cross).alias("cross"),
        )
    return _wide_moment_rows(df, names, keys)


def _shift(df: DataFrame) -> np.ndarray:
    """Means of the finite values of a bounded number of rows: a common origin that keeps sums well conditioned."""
    got = [[np.nan if v is None else v for v in r[0]] for r in df.select("_x").limit(SHIFT_ROWS).collect()]
    x = np.array(got, dtype=float)
    x[~np.isfinite(x)] = np.nan
    seen = np.isfinite(x).sum(axis=0) if len(got) else 0
    return np.where(seen > 0, np.nansum(x, axis=0) / np.maximum(seen, 1), 0.0) if len(got) else np.zeros(1)


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, i, n, v) added up over the tasks, one row of the triangle at a time."""
    types = dict(parts.dtypes)

    def add(pdf):
        import pandas as pd

        total = np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "i": [pdf["i"].iloc[0]], "n": [int(pdf["n"].sum())], "v": [total]})

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["i int, n long, v array<double>"])
    return parts.groupBy(*keys, "i").applyInPandas(add, schema)


def _wide_moment_rows(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Sums and products around a common origin; tasks send one row per feature, which are added up apart.

    A task holds at most STATE_BYTES of groups x p x p sums; beyond that it sends what it has.
    """
    p = len(names)
    data = df.select(*keys, F.array(*[F.col(c).cast("double") for c in names]).alias("_x"))
    origin = _shift(data)

    def partials(batches: Iterator) -> Iterator:
        import pandas as pd

        def flush(state):
            rows = [
                [*(key if isinstance(key, tuple) else (key,)), i, n, np.append(total[i], cross[i, i:]).tobytes()]
                for key, (n, total, cross) in state.items() for i in range(p)
            ]
            return pd.DataFrame(rows, columns=[*keys, "i", "n", "v"])

        state: dict = {}
        for batch in batches:
            groups = batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]
            for key, part in groups:
                x = np.stack(part["_x"].to_numpy()) - origin
                n, total, cross = state.get(key, (0, 0.0, 0.0))
                state[key] = (n + len(x), total + x.sum(axis=0), cross + x.T @ x)
                if len(state) * p * p * 8 > STATE_BYTES:
                    yield flush(state)
                    state = {}
        if state:
            yield flush(state)

    types = dict(data.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["i int, n long, v binary"])
    rows = _summed(data.mapInPandas(partials, schema), keys)
    listed = F.sort_array(F.collect_list(F.struct("i", "v")))
    triangle = rows.groupBy(*keys).agg(F.max("n").alias("n"), listed.alias("t"))
    offset = F.transform(F.col("t"), lambda s: F.element_at(s["v"], 1) / F.col("n"))
    centred = F.transform(F.col("t"), lambda s: F.transform(
        F.slice(s["v"], 2, p), lambda v, k: v - F.col("n") * F.get(F.col("d"), s["i"]) * F.get(F.col("d"), s["i"] + k)))
    start = F.array(*[F.lit(float(m)) for m in origin])
    return triangle.withColumn("d", offset).select(
        *keys, "n", F.zip_with("d", start, lambda d, m: d + m).alias("mean"), F.flatten(centred).alias("cross"))


def unpack(row, names: Sequence[str]) -> Moments:
    p = len(names)
    cross = np.zeros((p, p))
    upper = np.triu_indices(p)
    cross[upper] = np.asarray(row["cross"], dtype=float)
    cross = cross + np.triu(cross, 1).T
    return Moments(list(names), int(row["n"]), np.asarray(row["mean"], dtype=float), cross)


def moments(df: DataFrame, names: Sequence[str]) -> Moments:
    """Moments over complete rows; only a p x p result reaches the driver."""
    row = moment_rows(complete_rows(df, names), names).collect()[0]
    if not row["n"]:
        raise ValueError("no complete rows")
    return unpack(row, names)


def independent(corr: np.ndarray, index: Sequence[int], least: float = 2e-8) -> list[int]:
    """The columns of `index`, in order, that are no linear combination of the ones kept before.

    One Cholesky sweep over the correlations: constant columns (no correlation with themselves), copies and exact
    combinations have no variance left; `least` is the share that has to be left, so of two columns with |r| > 1 - 1e-8 the later goes.
    """
    kept: list[int] = []
    rows = np.zeros((0, len(index)))
    block = np.nan_to_num(corr[np.ix_(index, index)])
    for j in range(len(index)):
        left = block[j, j] - rows[:, j] @ rows[:, j]
        if left > least:
            rows = np.vstack([rows, (block[j] - rows[:, j] @ rows) / np.sqrt(left)])
            kept.append(index[j])
    return kept


def correlation_long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations of all i < j as rows: f1, f2, r (one pass).

    NaN and infinities count as missing, at every width.
    Beyond NARROW columns tasks add up masked block products: for every pair the number of rows that
    have both values, their sums, squares and products.
    """
    names = list(names)
    finite = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c) for c in names]
    df = df.select(*finite)
    if len(names) <= NARROW:
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
        cells = [
            F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.corr(F.col(a), F.col(b)).alias("r")) for a, b in pairs
        ]
        return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    p = len(names)
    data = df.select(F.array(*names).alias("_x"))
    origin = _shift(data)

    def partials(batches: Iterator) -> Iterator:
        import pandas as pd

        state, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([[np.nan if v is None else v for v in row] for row in batch["_x"]], dtype=float) - origin
            has = np.isfinite(x)
            x, m = np.where(has, x, 0.0), has.astype(float)
            sums = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            state, n = sums if state is None else state + sums, n + len(x)
        if state is not None:
            yield pd.DataFrame({"i": range(p - 1), "n": n, "v": [state[:, i, i + 1:].tobytes() for i in range(p - 1)]})

    rows = _summed(data.mapInPandas(partials, "i int, n long, v binary"), [])
    width = F.lit(p - 1) - F.col("i")
    at = lambda k: F.get(F.col("v"), k * width + F.col("pos"))
    each = rows.select("i", "v", F.explode(F.sequence(F.lit(0), width - 1)).alias("pos")).select(
        "i", "pos", *[at(k).alias(c) for k, c in enumerate(("n", "sx", "sy", "xx", "yy", "xy"))])
    spread = F.sqrt((F.col("xx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")))
    r = F.when((F.col("n") > 1) & (spread > 0), (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / spread)
    listed = F.array(*[F.lit(c) for c in names])
    return each.select(F.get(listed, F.col("i")).alias("f1"), F.get(listed, F.col("i") + 1 + F.col("pos")).alias("f2"), r.alias("r"))


def correlated_pairs(df: DataFrame, names: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Pairs with |r| above the threshold, strongest first."""
    return (
        correlation_long(df, names)
        .where(F.abs("r") > threshold)
        .orderBy(F.abs("r").desc(), "f1", "f2")
    )


def flagged_features(pairs: DataFrame) -> DataFrame:
    """Every feature of any flagged pair."""
    return pairs.select(F.explode(F.array("f1", "f2")).alias("feature")).distinct()


def correlation_order(df: DataFrame, names: Sequence[str], star: float = 0.95) -> DataFrame:
    """Features by total |r| with the others; starred when some |r| exceeds `star` (T5)."""
    long = correlation_long(df, names)
    ends = long.select(F.explode(F.array("f1", "f2")).alias("feature"), F.abs("r").alias("r"))
    return (
        ends.groupBy("feature")
        .agg(F.sum("r").alias("total"), (F.max("r") > star).alias("starred"))
        .orderBy(F.desc("total"), "feature")
    )


def vif_values(m: Moments, names: Sequence[str]) -> np.ndarray:
    """Variance inflation factors: diagonal of the inverse correlation matrix."""
    i = m.at(names)
    corr = m.correlation()[np.ix_(i, i)]
    if len(i) == 1:
        return np.ones(1)
    try:
        if np.linalg.cond(corr) > 1e12:
            raise np.linalg.LinAlgError
        return np.diag(np.linalg.inv(corr))
    except np.linalg.LinAlgError:
        return np.full(len(i), np.inf)


def vif(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, vif (A10)."""
    values = vif_values(moments(df, names), names)
    rows = [(c, float(x) if np.isfinite(x) else None) for c, x in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def prune_by_vif(df: DataFrame, names: Sequence[str], correlation: float = 0.8, threshold: float = 10.0) -> DataFrame:
    """Greedy pruning: drop the flagged feature with the largest VIF until all are small.

    One data pass; the steps work on the p x p matrix. feature, kept, step, vif.
    """
    m = moments(df, names)
    corr = np.abs(m.correlation())
    np.fill_diagonal(corr, 0.0)
    kept, rows, step = list(names), [], 0
    flagged = {names[i] for i in range(len(names)) if np.nanmax(corr[i], initial=0.0) > correlation}
    while True:
        values = dict(zip(kept, vif_values(m, kept)))
        over = [(values[c], c) for c in kept if c in flagged and values[c] > threshold]
        if not over or len(kept) == 1:
            break
        worst = max(over, key=lambda item: (item[0], item[1]))[1]
        step += 1
        rows.append((worst, False, step, float(values[worst]) if np.isfinite(values[worst]) else None))
        kept.remove(worst)
    values = dict(zip(kept, vif_values(m, kept)))
    rows += [(c, True, None, float(values[c]) if np.isfinite(values[c]) else None) for c in kept]
    return df.sparkSession.createDataFrame(rows, "feature string, kept boolean, step int, vif double")
