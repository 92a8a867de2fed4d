"""Linear and logistic models with indicator columns of factors (M3, M13, M15, PF19).

The levels of the largest factor never become columns. They are rows of a level table, and the normal equations of every
step are solved by elimination: a level only meets its own rows, so its block of the Hessian is small and is inverted in
the task that adds up its sums, and what is left is a system over the other columns. Only that small system reaches the driver; the number of
levels is not limited. Rows are stored once, in packs of one level each, so a step joins packs to levels and sends one sum per level and batch.
Without numeric columns, rows that agree in everything are one row with a weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitable.operators.blocks import PACK_BYTES, matrix, summed_into
from orbitable.operators.classify import FALLBACK_RIDGE, METRICS, PASS_LIMIT, class_labels, scores
from orbitable.operators.clean import categorical_columns, one_hot
from orbitable.operators.moments import complete_rows, independent, moment_rows, moments, unpack
from orbitable.session import broadcast_rows, cut_lineage

PIECE_VALUES = 1 << 22  # numbers a task works on at once


@dataclass
class FactorFit:
    """Estimates (class, term, level, estimate) of one model and its figures; class is NULL in linear models."""

    terms: DataFrame
    n: int
    figures: dict
    converged: bool = True


def _level(df: DataFrame, name: str) -> Column:
    """The value of a factor as text; whole numbers without a fraction. NULL is a level of its own."""
    text = F.col(name).cast("string")
    if dict(df.dtypes)[name] in ("double", "float"):
        text = F.when(F.col(name) == F.round(F.col(name)), F.col(name).cast("decimal(38,0)").cast("string")).otherwise(text)
    return text


def _prepared(rows: DataFrame, features: Sequence[str], factors: Sequence[str], drop_first: bool) -> tuple[DataFrame, list[str], str]:
    """Rows with the smaller factors as indicator columns, the numeric columns, and the factor with most levels."""
    if not factors:
        raise ValueError("name a factor")
    largest = factors[0]
    if len(factors) > 1:
        counts = rows.agg(*[F.countDistinct(c).alias(f"n{i}") for i, c in enumerate(factors)]).collect()[0]
        largest = max(factors, key=lambda c: counts[f"n{list(factors).index(c)}"])
    columns = list(features)
    for name in factors:
        if name != largest:
            rows, made = one_hot(rows, name, drop_first)
            columns += made
    return rows, columns, largest


def factor_regression(rows: DataFrame, features: Sequence[str], factors: Sequence[str], target: str) -> FactorFit:
    """Least squares on numeric columns and the indicator columns of factors, lowest level of each left out.

    Rows with a missing number are left out; a missing level counts as a level, after all others. Numeric columns that the
    levels or earlier columns determine get no estimate. Figures: r2.
    """
    rows, columns, factor = _prepared(rows, features, factors, True)
    names = [*columns, target]
    good = complete_rows(rows, names).select(F.col(factor).alias("_order"), _level(rows, factor).alias("level"),
                                             *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    at = [f"x{i}" for i in range(len(names))]
    m = moments(good, at)
    means = [F.avg(F.col(c) - float(mu)).alias(c) for c, mu in zip(at, m.mean)]
    levels = cut_lineage(good.groupBy("level").agg(F.min("_order").alias("_order"), F.count(F.lit(1)).alias("n"), *means))
    # Cross products of the level means, weighted by the rows of the level: the moments of sqrt(n) * mean, not centred.
    spread = unpack(moment_rows(levels.select(*[(F.sqrt("n") * F.col(c)).alias(c) for c in at]), at).collect()[0], at)
    within = m.cross - spread.cross - spread.n * np.outer(spread.mean, spread.mean)
    size = np.sqrt(np.where(np.diag(m.cross) > 0, np.diag(m.cross), 1.0))
    kept = independent(within / np.outer(size, size), range(len(columns)))
    t = len(columns)
    beta = np.linalg.solve(within[np.ix_(kept, kept)], within[kept, t]) if kept else np.zeros(0)
    r2 = 1 - float(within[t, t] - beta @ within[kept, t]) / m.cross[t, t] if m.cross[t, t] > 0 else float("nan")
    base = float(m.mean[t] - beta @ m.mean[kept])
    own = F.lit(base) + F.col(at[t]) - sum((float(b) * F.col(at[j]) for b, j in zip(beta, kept)), F.lit(0.0))
    placed = levels.select("level", "_order", own.alias("own"))
    first = placed.orderBy(F.col("_order").asc_nulls_last()).limit(1).collect()[0]
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(None, "intercept", None, first["own"]), *[(None, columns[j], None, float(b)) for b, j in zip(beta, kept)]],
                                  "class string, term string, level string, estimate double")
    effects = placed.where(~F.col("level").eqNullSafe(F.lit(first["level"]))).select(
        F.lit(None).cast("string").alias("class"), F.lit(factor).alias("term"), "level", (F.col("own") - F.lit(first["own"])).alias("estimate"))
    return FactorFit(fixed.unionByName(effects), m.n, {"r2": r2})


LEVELS = "key string, level string, best array<double>, step array<double>"
STEPPED = f"{LEVELS}, u array<double>, v array<double>, c array<double>, penalty double"
PARTS = "key string, i int, v binary"


def _probabilities(z: np.ndarray, own: np.ndarray, theta: np.ndarray, full: bool) -> np.ndarray:
    logits = z @ theta.T + own
    if not full:
        logits = np.hstack([np.zeros((len(z), 1)), logits])
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True)


def _pack_rows(batches):
    """Rows (key, level, x, code, n) as packs of rows of one level: `rows` holds class numbers, weights and columns one after the other."""
    for batch in batches:
        if not len(batch):
            continue
        flat = np.column_stack([batch.column("code").to_numpy(), batch.column("n").to_numpy(), matrix(batch.column("x"))])
        size = max(1, PACK_BYTES // (8 * flat.shape[1]))
        edges = np.append(np.flatnonzero(np.diff(batch.column("key").dictionary_encode().indices.to_numpy(), prepend=-1)), len(batch)).tolist()
        cuts = [(at, min(at + size, stop)) for start, stop in zip(edges, edges[1:]) for at in range(start, stop, size)]
        heads = pa.array([at for at, _ in cuts])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(heads), batch.column("level").take(heads), pa.array([flat[at:to].T.tobytes() for at, to in cuts], pa.binary()),
             pa.array([to - at for at, to in cuts], pa.int32()), pa.array(np.add.reduceat(flat[:, 1], heads.to_numpy()))], names=["key", "level", "rows", "size", "n"])


PACKS = "key string, level string, rows binary, size int, n double"


def _pieces(batch: pa.RecordBatch, most: int):
    """Slices of a batch of packs with about `most` rows each, at least one pack."""
    sizes = np.cumsum(batch.column("size").to_numpy(), dtype=np.int64)
    edges = np.append(np.flatnonzero(np.diff((sizes - 1) // most, prepend=-1)), len(batch)).tolist()
    for at, to in zip(edges, edges[1:]):
        yield batch.slice(at, to - at)


def _read(batch: pa.RecordBatch, width: int, theta: np.ndarray, share: float, full: bool):
    """Design, class numbers, weights and probabilities of the rows of packs beside the state of their levels, and the row each pack begins with."""
    flat = np.concatenate([np.frombuffer(raw).reshape(width + 2, -1) for raw in batch.column("rows").to_pylist()], axis=1)
    size = batch.column("size").to_numpy()
    z = np.vstack([np.ones((1, flat.shape[1])), flat[2:]]).T
    own = np.repeat(matrix(batch.column("best")) + share * matrix(batch.column("step")), size, axis=0)
    return z, flat[0].astype(int), flat[1], _probabilities(z, own, theta, full), np.cumsum(size) - size


def _packed(dense: np.ndarray) -> list[tuple]:
    return [(None, i, row.tobytes()) for i, row in enumerate(dense)]


def _parts(found: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate(types)], names=["key", "i", "v"])


def _row_sums(theta: np.ndarray, share: float, full: bool):
    """Per level: gradient, Hessian and the Hessian between level and columns; per task: the same over the columns, and the log-likelihood."""
    k, q = theta.shape
    d = k * q

    def run(batches):
        dense = np.zeros((d + 1, d + 1))
        for whole in batches:
            for batch in _pieces(whole, max(1, PIECE_VALUES // (k * d))):
                z, code, weight, p, starts = _read(batch, q - 1, theta, share, full)
                n = len(code)
                dense[d, 0] += weight @ np.log(np.clip(p[np.arange(n), code], 1e-300, None))
                pull = -p
                pull[np.arange(n), code] += 1.0
                pull, p = weight[:, None] * pull[:, p.shape[1] - k:], p[:, p.shape[1] - k:]
                w = (weight[:, None] * p)[:, :, None] * (np.eye(k)[None] - p[:, None, :])
                cross = (w[:, :, :, None] * z[:, None, None, :]).reshape(n, k * d)
                dense[:d, d] += (pull.T @ z).ravel()
                dense[:d, :d] += (cross.T @ z).reshape(k, d, q).transpose(0, 2, 1).reshape(d, d)
                keys = batch.column("key").dictionary_encode()
                number = keys.indices.to_numpy()
                order = np.argsort(number, kind="stable")
                sums = np.add.reduceat(np.hstack([pull, w.reshape(n, -1), cross]), starts)[order]
                sums = np.add.reduceat(sums, np.flatnonzero(np.diff(number[order], prepend=-1)))
                yield _parts([(name, None, v.tobytes()) for name, v in zip(keys.dictionary.to_pylist(), sums, strict=True)])
        yield _parts(_packed(dense))
    return run


def _eliminated(k: int, d: int):
    """What the levels take from the system over the columns, per task."""
    def run(batches):
        dense = np.zeros((d + 1, d + 1))
        for batch in batches:
            c = matrix(batch.column("c")).reshape(-1, k, d)
            dense[:d, :d] -= np.einsum("gki,gkj->ij", c, matrix(batch.column("v")).reshape(-1, k, d))
            dense[:d, d] -= np.einsum("gki,gk->i", c, matrix(batch.column("u")).reshape(-1, k))
            dense[d, 0] -= batch.column("penalty").to_numpy().sum()
        yield _parts(_packed(dense))
    return run


class _Classifier:
    """Newton steps on softmax models whose largest factor is a table of levels."""

    def __init__(self, rows: DataFrame, features: Sequence[str], factors: Sequence[str], target: str):
        rows, self.columns, self.factor = _prepared(rows, features, factors, False)
        good = complete_rows(rows, self.columns).where(F.col(target).isNotNull())
        self.labels = class_labels(good, target)
        if len(self.labels) < 2:
            raise ValueError("fewer than two classes")
        self.full = len(self.labels) > 2
        self.k = len(self.labels) if self.full else 1
        code = F.lit(0)
        for i, label in enumerate(self.labels):
            code = F.when(F.col(target) == label, i).otherwise(code)
        level = _level(rows, self.factor)
        self.center, self.scale = np.zeros(0), np.ones(0)
        if self.columns:
            m = moments(good, self.columns)
            self.center, self.scale = m.mean, np.where(m.sd() > 0, m.sd(), 1.0)
        scaled = [(F.col(c).cast("double") - float(mu)) / float(s) for c, mu, s in zip(self.columns, self.center, self.scale)]
        key = F.coalesce(F.concat(F.lit("="), level), F.lit(""))
        names = [f"x{i}" for i in range(len(scaled))]
        good = good.select(key.alias("key"), level.alias("level"), code.cast("int").alias("code"), *[c.alias(x) for c, x in zip(scaled, names)])
        if features:
            good = good.withColumn("n", F.lit(1.0))
        else:  # indicators only: rows of the same levels and class are the same row
            good = good.groupBy("key", "level", "code", *names).agg(F.count("*").cast("double").alias("n"))
        x = F.array(*names) if names else F.array().cast("array<double>")
        # Dealt by level, and a level with too many rows for a task to several; a pack holds rows of one level either way.
        dealt = good.select("key", "level", x.alias("x"), "code", "n").hint("rebalance", "key").sortWithinPartitions("key")
        self.rows = cut_lineage(dealt.mapInArrow(_pack_rows, PACKS))
        self.n = int(self.rows.agg(F.sum("n")).first()[0])
        self.n_levels = self.rows.select("key").distinct().count()

    def _beside(self, levels: DataFrame) -> DataFrame:
        return self.rows.select("key", "rows", "size").join(broadcast_rows(levels.select("key", "best", "step"), self.n_levels), "key")

    def fit(self, ridge: float, tolerance: float = 1e-8):
        """(theta, levels, log-likelihood less penalty, converged); theta is on the standardised columns."""
        k, q = self.k, len(self.columns) + 1
        d = k * q
        zeros = F.array_repeat(F.lit(0.0), k)
        levels = cut_lineage(self.rows.groupBy("key").agg(F.min("level").alias("level")).withColumns({"best": zeros, "step": zeros}))
        best, move, share, value = np.zeros((k, q)), np.zeros((k, q)), 1.0, None
        weights = np.tile(np.concatenate([[0.0], ridge / self.scale**2]), k)

        def solve(level: dict, flat: np.ndarray) -> dict:
            own = np.array(level["best"]) + share * np.array(level["step"])
            grad, hess, cross = flat[:k], flat[k: k + k * k].reshape(k, k), flat[k + k * k:].reshape(k, d)
            inner = np.linalg.inv(hess + ridge * np.eye(k))
            return {**level, "best": own, "u": inner @ (grad - ridge * own), "v": (inner @ cross).ravel(), "c": cross.ravel(),
                    "penalty": 0.5 * ridge * float(own @ own)}

        slots = self.rows.sparkSession.range(d + 1).select(F.col("id").cast("string").alias("i"))
        for _ in range(PASS_LIMIT):
            theta = best + share * move
            parts = cut_lineage(self._beside(levels).mapInArrow(_row_sums(theta, share, self.full), PARTS))
            stepped = cut_lineage(summed_into(levels, parts.where("key IS NOT NULL"), "key", solve, STEPPED))
            dense = parts.where("key IS NULL").unionByName(stepped.mapInArrow(_eliminated(k, d), PARTS))
            summed = summed_into(slots, dense.select(F.col("i").cast("string").alias("i"), "v"), "i",
                                 lambda m, v: {"i": m["i"], "v": v}, "i string, v array<double>")
            system = np.array([r["v"] for r in sorted(summed.collect(), key=lambda r: int(r["i"]))])
            flat = theta.ravel()
            now = system[d, 0] - 0.5 * float(weights @ (flat * flat))
            if value is not None and (not np.isfinite(now) or now < value - 1e-9 * (1 + abs(value))):
                share /= 2  # went too far: half the step from the same place
                if share < 1e-6:
                    return best, levels, value, False
                continue
            delta = np.linalg.pinv(system[:d, :d] + np.diag(weights), rcond=1e-12, hermitian=True) @ (system[:d, d] - weights * flat)

            def turned(batches, delta=delta):
                for batch in batches:
                    u, v = np.stack(batch["u"]), np.stack(batch["v"]).reshape(-1, k, d)
                    yield batch[["key", "level", "best"]].assign(step=list(u - v @ delta))

            levels = cut_lineage(stepped.mapInPandas(turned, LEVELS))
            largest = levels.agg(F.max(F.array_max(F.transform("step", F.abs)))).collect()[0][0]
            gain = None if value is None else now - value
            best, move, share, value = theta, delta.reshape(k, q), 1.0, now
            if max(largest, np.abs(delta).max()) < tolerance or (gain is not None and gain < 1e-11 * (1 + abs(now))):
                return best, levels, value, True
        return best, levels, value, False

    def scored(self, theta: np.ndarray, levels: DataFrame) -> dict:
        """Class scores of a fitted model on its rows."""
        n, full, width = len(self.labels), self.full, len(self.columns)
        most = max(1, PIECE_VALUES // (n + width))

        def count(batches):
            cells, logs = np.zeros(n * n), np.zeros(n * n)
            for batch in (piece for whole in batches for piece in _pieces(whole, most)):
                _, code, weight, p, _ = _read(batch, width, theta, 0.0, full)
                cell = code * n + p.argmax(axis=1)
                cells += np.bincount(cell, weights=weight, minlength=n * n)
                logs += np.bincount(cell, weights=weight * np.log(np.clip(p[np.arange(len(code)), code], 1e-15, None)), minlength=n * n)
            yield pa.RecordBatch.from_arrays([pa.array(range(n * n), pa.int32()), pa.array(cells), pa.array(logs)], names=["cell", "n", "ll"])

        found = self._beside(levels).mapInArrow(count, "cell int, n double, ll double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ll").alias("ll"))
        return scores(pd.DataFrame([r.asDict() for r in found.collect()]), n)

    def terms(self, theta: np.ndarray, levels: DataFrame) -> DataFrame:
        """class, term, level, estimate on the columns as they are."""
        named = [str(v) for v in self.labels[len(self.labels) - self.k:]]
        slopes = theta[:, 1:] / self.scale
        start = theta[:, 0] - slopes @ self.center
        fixed = [(c, "intercept", None, float(start[i])) for i, c in enumerate(named)]
        fixed += [(c, name, None, float(slopes[i, j])) for i, c in enumerate(named) for j, name in enumerate(self.columns)]
        table = levels.sparkSession.createDataFrame(fixed, "class string, term string, level string, estimate double")
        each = levels.select("level", F.posexplode("best").alias("at", "estimate"))
        return table.unionByName(each.select(F.get(F.lit(named), F.col("at")).alias("class"), F.lit(self.factor).alias("term"), "level", "estimate"))


def factor_classifier(rows: DataFrame, features: Sequence[str], factors: Sequence[str], target: str, ridge: float = 1.0) -> FactorFit:
    """Logistic model on numeric columns and the indicator columns of all levels of the factors.

    The penalty is on all estimates but the intercepts. With two classes the estimates are those of the second, with more every class has
    its own. Rows with a missing number or class are left out; a missing level of the largest factor counts as a level. Figures: the
    scores of classify.METRICS; mcfadden_r2 is that of the fit without penalty (FALLBACK_RIDGE, as levels of one class have no finite estimate).
    """
    if not ridge > 0:
        raise ValueError("levels need a penalty above 0")
    model = _Classifier(rows, features, factors, target)
    theta, levels, _, done = model.fit(ridge)
    figures = model.scored(theta, levels)
    plain, own, _, also = model.fit(FALLBACK_RIDGE)
    figures["mcfadden_r2"] = model.scored(plain, own)["mcfadden_r2"]
    return FactorFit(model.terms(theta, levels), model.n, {c: figures[c] for c in METRICS}, done and also)


def fit_columns(rows: DataFrame, columns: Sequence[str], target: str, classes: bool = False) -> FactorFit | None:
    """Fit one subset of columns: those that hold whole numbers only enter as factors (PF19). None if there are none."""
    factors = categorical_columns(rows, columns)
    if not factors:
        return None
    fit = factor_classifier if classes else factor_regression
    return fit(rows, [c for c in columns if c not in factors], factors, target)
