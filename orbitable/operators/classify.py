"""Logistic and ordinal models over feature subsets.

All models of a search are rows of one state table: parameters, best value so far, next step, and whether the model
is done. A Newton step meets the unfinished models with the rows (see blocks), adds up log-likelihood, gradient and Hessian
per model over the tasks, and writes the moved state as the next table. So no model, sum or score passes through the driver, a
lost executor costs one step, and neither the number of models nor the class sizes decide what one task holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.operators.blocks import matrix, meet, packed, summed_into, unpacked
from orbitable.operators.moments import complete_rows, independent, moments
from orbitable.session import cut_lineage

MAX_CLASSES = 100
PASS_LIMIT = 60  # Newton passes before a model counts as not converged
FALLBACK_RIDGE = 1e-6  # on standardised coefficients, where classes are separated


@dataclass
class Job:
    """One named model to fit: a feature list, the fold left out (None: fit on all rows) and the L2 penalty.

    ridge is 0 for maximum likelihood, 1 for the usual penalty on standardised features. `theta` has no entries for columns
    that a fit without penalty leaves out as constant or dependent (see `used`).
    """

    key: str
    features: list[str]
    fold: int | None = None
    ridge: float = 0.0
    theta: np.ndarray | None = None
    converged: bool = False
    separated: bool = False
    used: list[str] = field(default_factory=list)


def class_labels(rows: DataFrame, target: str) -> list:
    found = [r[0] for r in rows.select(target).distinct().limit(MAX_CLASSES + 1).collect() if r[0] is not None]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return sorted(found)


def _softmax(z: np.ndarray, theta: np.ndarray, full: bool) -> np.ndarray:
    logits = z @ theta.T
    if not full:
        logits = np.hstack([np.zeros((len(z), 1)), logits])
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True)


def _softmax_sums(z, code, theta, full):
    p = _softmax(z, theta, full)
    ll = np.log(np.clip(p[np.arange(len(code)), code], 1e-300, None)).sum()
    first = 0 if full else 1
    q = p[:, first:]
    hit = np.zeros_like(p)
    hit[np.arange(len(code)), code] = 1.0
    grad = (hit[:, first:] - q).T @ z
    k, d = q.shape[1], z.shape[1]
    hess = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            w = q[:, a] * ((a == b) - q[:, b])
            hess[a, :, b, :] = hess[b, :, a, :] = (z * w[:, None]).T @ z
    return ll, grad.ravel(), hess.reshape(k * d, k * d)


def _ordinal_probabilities(x: np.ndarray, theta: np.ndarray, n_classes: int):
    cuts, beta = theta[: n_classes - 1], theta[n_classes - 1:]
    u = cuts[None, :] - (x @ beta)[:, None]
    cum = 1.0 / (1.0 + np.exp(-np.clip(u, -700, 700)))
    edge = np.ones((len(x), 1))
    p = np.diff(np.hstack([0 * edge, cum, edge]), axis=1)
    return p, cum * (1 - cum)


def _ordinal_sums(x, code, theta, n_classes):
    """Log-likelihood, gradient and expected information of the proportional-odds model."""
    p, slope = _ordinal_probabilities(x, theta, n_classes)
    n, d = x.shape
    if (p <= 0).any():
        p = np.maximum(p, 1e-300)
    jac = np.zeros((n, n_classes, n_classes - 1 + d))
    padded = np.hstack([np.zeros((n, 1)), slope, np.zeros((n, 1))])
    for k in range(n_classes):
        if k < n_classes - 1:
            jac[:, k, k] += padded[:, k + 1]
        if k > 0:
            jac[:, k, k - 1] -= padded[:, k]
        jac[:, k, n_classes - 1:] = -(padded[:, k + 1] - padded[:, k])[:, None] * x
    own = p[np.arange(n), code]
    grad = (jac[np.arange(n), code] / own[:, None]).sum(axis=0)
    info = np.einsum("nka,nkb,nk->ab", jac, jac, 1.0 / p)
    return np.log(own).sum(), grad, info


def _design(x: np.ndarray, kind: str) -> np.ndarray:
    return x if kind == "ordinal" else np.hstack([np.ones((len(x), 1)), x])


JOBS = "job string, combo_key string, combo array<string>, column int, fold int, ridge double, at array<int>"
STATE = f"{JOBS}, theta array<double>, value double, best array<double>, step array<double>, done boolean, converged boolean, separated boolean"


class _Sums:
    """Log-likelihood, gradient and Hessian of a block of models over the rows they learn from."""

    def __init__(self, models: pa.Table, fitter: LogisticFitter):
        self.fitter, self.models = fitter, models.select(["job", "column", "fold", "ridge", "at", "theta"]).to_pylist()
        self.sums: list[np.ndarray | None] = [None] * len(self.models)

    def add(self, batch: pa.RecordBatch) -> None:
        f = self.fitter
        x, (code, *folds) = matrix(batch.column("x")), matrix(batch.column("s"), np.int64).T
        for i, m in enumerate(self.models):
            keep = slice(None) if m["fold"] < 0 else folds[m["column"]] != m["fold"]
            z, c, theta = _design(x[keep][:, m["at"]], f.kind), code[keep], np.array(m["theta"])
            if not len(c):
                continue
            if f.kind == "ordinal":
                ll, grad, hess = _ordinal_sums(z, c, theta, len(f.labels))
            else:
                ll, grad, hess = _softmax_sums(z, c, theta.reshape(-1, z.shape[1]), f.full(m["ridge"]))
            flat = np.concatenate([[ll], grad, hess.ravel()])
            self.sums[i] = flat if self.sums[i] is None else self.sums[i] + flat

    def result(self):
        found = [(m["job"], v.tobytes()) for m, v in zip(self.models, self.sums, strict=True) if v is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], names=["job", "v"])


class _Confusion(_Sums):
    """Confusion counts and log-likelihoods of a block of models on the rows they are judged on: the left-out fold, or all."""

    def add(self, batch: pa.RecordBatch) -> None:
        f = self.fitter
        n = len(f.labels)
        x, (code, *folds) = matrix(batch.column("x")), matrix(batch.column("s"), np.int64).T
        for i, m in enumerate(self.models):
            keep = slice(None) if m["fold"] < 0 else folds[m["column"]] == m["fold"]
            z, c, theta = _design(x[keep][:, m["at"]], f.kind), code[keep], np.array(m["theta"])
            if not len(c):
                continue
            p = _ordinal_probabilities(z, theta, n)[0] if f.kind == "ordinal" else _softmax(z, theta.reshape(-1, z.shape[1]), f.full(m["ridge"]))
            own = np.log(np.clip(p[np.arange(len(c)), c], 1e-15, 1 - 1e-15))
            cell = c * n + p.argmax(axis=1)
            flat = np.concatenate([np.bincount(cell, minlength=n * n), np.bincount(cell, weights=own, minlength=n * n)]).astype(float)
            self.sums[i] = flat if self.sums[i] is None else self.sums[i] + flat


class LogisticFitter:
    """Fits many subsets over the same rows, standardised and stored once.

    kind: "logit" (binary or multinomial) or "ordinal" (proportional odds). `folds` names integer columns; a model may
    leave out the rows of one value (not negative) of one of them. Rows with a missing feature or class are left out.
    """

    def __init__(self, rows: DataFrame, features: Sequence[str], target: str, kind: str = "logit", folds: Sequence[str] = ()):
        self.features, self.target, self.kind = list(features), target, kind
        good = complete_rows(rows, self.features).where(F.col(target).isNotNull())
        # Read for the labels, the moments and the vectors.
        good = cut_lineage(good.select(*dict.fromkeys([*self.features, target, *folds])))
        self.labels = class_labels(good, target)
        if len(self.labels) < 2:
            raise ValueError("fewer than two classes")
        code = F.lit(0)
        for i, label in enumerate(self.labels):
            code = F.when(F.col(target) == label, i).otherwise(code)
        m = moments(good, self.features)
        sd = m.sd()
        self.n, self.center, self.scale, self.corr = m.n, m.mean, np.where(sd > 0, sd, 1.0), m.correlation()
        scaled = [(F.col(c).cast("double") - float(mu)) / float(s) for c, mu, s in zip(self.features, self.center, self.scale)]
        uses = [code.cast("int"), *[F.col(c).cast("int") for c in folds]]
        vectors = good.select(F.array(*scaled).alias("x"), F.array(*uses).alias("s"))
        self.rows = cut_lineage(packed(vectors, len(self.features) + 2))

    def __getstate__(self):
        """What tasks need: no table."""
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def full(self, ridge: float) -> bool:
        """With a penalty and several classes every class has its own weights."""
        return self.kind == "logit" and ridge > 0 and len(self.labels) > 2

    def fold_values(self) -> list[tuple[int, int]]:
        """(fold column, value) of every fold."""
        def seen(batches):
            for packs in batches:
                for rows in unpacked(packs):
                    uses = matrix(rows.column("s"), np.int32)[:, 1:]
                    found = [(i, int(f)) for i in range(uses.shape[1]) for f in np.unique(uses[:, i])]
                    yield pa.RecordBatch.from_pylist([{"column": i, "fold": f} for i, f in found], schema=pa.schema([("column", pa.int32()), ("fold", pa.int32())]))

        each = self.rows.mapInArrow(seen, "column int, fold int").distinct()
        return [tuple(r) for r in each.orderBy("column", "fold").collect()]

    def _start(self, ridge: float, d: int) -> np.ndarray:
        k = len(self.labels)
        if self.kind == "ordinal":
            return np.concatenate([np.linspace(-1, 1, k - 1) if k > 2 else np.zeros(1), np.zeros(d)])
        return np.zeros((k if self.full(ridge) else k - 1) * (d + 1))

    def _penalty(self, m: dict) -> np.ndarray:
        """Ridge weights: the penalty is on the unscaled coefficients, the fallback on the scaled ones."""
        each = m["ridge"] / self.scale[m["at"]] ** 2 + (FALLBACK_RIDGE if m["separated"] else 0.0)
        if self.kind == "ordinal":
            return np.concatenate([np.zeros(len(self.labels) - 1), each])
        return np.tile(np.concatenate([[0.0], each]), len(m["theta"]) // (len(m["at"]) + 1))

    def started(self, jobs: DataFrame) -> DataFrame:
        """State of models (combo_key, combo, column, fold, ridge) before the first step.

        A fit without penalty leaves out columns that are constant or that earlier columns of the subset determine.
        """
        place = {c: i for i, c in enumerate(self.features)}

        def run(batches):
            for batch in batches:
                at = [[place[c] for c in combo] for combo in batch["combo"]]
                at = [independent(self.corr, i) if ridge == 0 else i for i, ridge in zip(at, batch["ridge"])]
                theta = [self._start(ridge, len(i)) for i, ridge in zip(at, batch["ridge"])]
                yield batch.assign(at=at, theta=theta, value=None, best=None, step=None, done=False, converged=False, separated=False)

        named = jobs.select(F.concat_ws("\x01", "combo_key", "column", "fold", "ridge").alias("job"), "combo_key", "combo", "column", "fold", "ridge")
        return cut_lineage(named.mapInPandas(run, STATE))

    def _moved(self, m: dict, flat: np.ndarray | None, tolerance: float) -> dict:
        """A model after a Newton step with its sums at theta."""
        if flat is None:
            return {**m, "done": True}
        theta = np.array(m["theta"])
        d = len(theta)
        ll, grad, hess = flat[0], flat[1: 1 + d], flat[1 + d:].reshape(d, d)
        weights = self._penalty(m)
        value = ll - 0.5 * float(weights @ (theta * theta))
        ordered = self.kind != "ordinal" or len(self.labels) == 2 or (np.diff(theta[: len(self.labels) - 1]) > 0).all()
        if m["value"] is not None and (not np.isfinite(value) or value < m["value"] - 1e-9 or not ordered):
            best, step = np.array(m["best"]), np.array(m["step"]) / 2  # went too far: half the step
            if np.abs(step).max(initial=0.0) < tolerance:
                return {**m, "theta": best, "done": True, "converged": True}
            return {**m, "theta": best + step, "step": step}
        step = np.linalg.pinv(hess + np.diag(weights), rcond=1e-11, hermitian=True) @ (grad - weights * theta)
        largest = np.abs(step).max(initial=0.0)
        if largest < tolerance:
            return {**m, "done": True, "converged": True}
        if m["value"] is not None and not m["separated"] and value - m["value"] < 1e-7 * (1 + abs(value)) and largest > 0.1:
            # Steps stay large and gain nothing: the classes are separated and the likelihood has
            # no maximum. A small ridge gives one.
            return {**m, "separated": True, "value": None, "best": None}
        return {**m, "value": float(value), "best": theta, "step": step, "theta": theta + step}

    def _unscaled(self, at: list[int], theta: np.ndarray) -> np.ndarray:
        """Parameters on the columns as they are; fitting works on standardised ones."""
        center, scale = self.center[at], self.scale[at]
        if self.kind == "ordinal":
            cuts, beta = np.split(theta, [len(self.labels) - 1])
            return np.concatenate([cuts + (beta / scale) @ center, beta / scale])
        table = theta.reshape(-1, len(at) + 1).copy()
        table[:, 1:] /= scale
        table[:, 0] -= table[:, 1:] @ center
        return table.ravel()

    def _met(self, state: DataFrame, kernel) -> DataFrame:
        """(job, v): vectors of the kernel per model and cell."""
        k, width = len(self.labels), len(self.features)
        size = max(1, (1 << 23) // ((k * (min(width, 64) + 1)) ** 2))
        models = state.select("job", "column", "fold", "ridge", "at", "theta")
        return meet(self.rows, self.n, width + 2, models, state.count(), F.col("job"), lambda block: kernel(block, self), "job string, v binary", size)

    def fit_table(self, jobs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
        """Fitted state of models (combo_key, combo, column, fold, ridge): STATE, theta on the standardised columns.

        A model that PASS_LIMIT steps do not finish keeps its best parameters with converged = false.
        """
        state, finished = self.started(jobs), None
        for _ in range(PASS_LIMIT):
            if state.isEmpty():
                break
            stepped = cut_lineage(summed_into(state, self._met(state, _Sums), "job", lambda m, v: self._moved(m, v, tolerance), STATE))
            done = stepped.where("done")
            finished = done if finished is None else finished.unionByName(done)
            state = stepped.where("not done")
        # Some models may be left: their best parameters so far.
        rest = state.withColumn("theta", F.coalesce("best", "theta"))
        return rest if finished is None else finished.unionByName(rest)

    def scored(self, state: DataFrame) -> DataFrame:
        """Class scores and McFadden R2 of fitted models on the rows they are judged on, beside combo_key, combo, column, fold, ridge, converged."""
        n_classes = len(self.labels)
        cells, kept = n_classes * n_classes, ("combo_key", "combo", "column", "fold", "ridge", "converged")

        def score(m: dict, flat: np.ndarray | None) -> dict:
            flat = np.zeros(2 * cells) if flat is None else flat
            found = scores(pd.DataFrame({"cell": range(cells), "n": flat[:cells], "ll": flat[cells:]}), n_classes)
            return {**{c: m[c] for c in kept}, **{c: found[c] for c in METRICS}}

        state = cut_lineage(state)
        types = "combo_key string, combo array<string>, column int, fold int, ridge double, converged boolean"
        return summed_into(state, self._met(state, _Confusion), "job", score, types + "".join(f", {c} double" for c in METRICS))

    def fit(self, jobs: list[Job], tolerance: float = 1e-9) -> list[Job]:
        """Fit a few named models whose parameters the caller needs."""
        spark = self.rows.sparkSession
        table = spark.createDataFrame([(f"{i}", j.features, 0, -1 if j.fold is None else j.fold, float(j.ridge)) for i, j in enumerate(jobs)],
                                      "combo_key string, combo array<string>, column int, fold int, ridge double")
        for r in self.fit_table(table, tolerance).collect():
            j = jobs[int(r["combo_key"])]
            j.theta, j.converged, j.separated = self._unscaled(r["at"], np.array(r["theta"])), r["converged"], r["separated"]
            j.used = [self.features[i] for i in r["at"]]
        return jobs


METRICS = ("accuracy", "precision", "recall", "f1_score", "mcfadden_r2")


def scores(cells: pd.DataFrame, n_classes: int) -> dict:
    """Accuracy, weighted precision, recall, F1, McFadden R2 from one job's confusion cells."""
    table = np.zeros((n_classes, n_classes))
    table.ravel()[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    support, said, hit = table.sum(axis=1), table.sum(axis=0), np.diag(table)
    n = support.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        precision = np.where(said > 0, hit / said, 0.0)
        recall = np.where(support > 0, hit / support, 0.0)
        f1 = np.where(precision + recall > 0, 2 * precision * recall / (precision + recall), 0.0)
    seen = support[support > 0]
    null = float((seen * np.log(seen / n)).sum())
    return {
        "accuracy": hit.sum() / n,
        "precision": float(support @ precision / n),
        "recall": float(support @ recall / n),
        "f1_score": float(support @ f1 / n),
        "mcfadden_r2": 1 - float(cells["ll"].sum()) / null if len(seen) > 1 else None,
    }


RESULT_SCHEMA = (
    "combo_key string, combo array<string>, k int, accuracy double, precision double, recall double, f1_score double, "
    "mcfadden_r2 double, converged boolean"
)


def fit_classifiers(rows: DataFrame, combos: DataFrame, features: Sequence[str], target: str, kind: str = "logit") -> DataFrame:
    """Scores per combination (M13): class scores of the penalised model, McFadden R2 of the unpenalised one.

    `converged` says whether both fits ended; ordinal models have one fit without penalty.
    """
    fitter = LogisticFitter(rows, features, target, kind)
    ridges = [0.0] if kind == "ordinal" else [0.0, 1.0]
    jobs = combos.select("combo_key", "combo", F.lit(0).alias("column"), F.lit(-1).alias("fold"), F.explode(F.array(*[F.lit(r) for r in ridges])).alias("ridge"))
    found = cut_lineage(fitter.scored(fitter.fit_table(jobs)))
    plain = found.where("ridge = 0").select("combo_key", "mcfadden_r2", F.col("converged").alias("_plain"))
    soft = found.where(F.col("ridge") == ridges[-1]).drop("mcfadden_r2")
    return soft.join(plain, "combo_key").select(
        "combo_key", "combo", F.size("combo").alias("k"), *METRICS, (F.col("converged") & F.col("_plain")).alias("converged"))


def _cross_validated(folded: DataFrame, combos: DataFrame, features: Sequence[str], target: str, folds: Sequence[str], kind: str) -> DataFrame:
    """combo_key, column and the means over the folds of each fold column; all folds of all columns are fitted together."""
    fitter = LogisticFitter(folded, features, target, kind, folds)
    ridge = F.lit(0.0 if kind == "ordinal" else 1.0)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(f).alias("fold")) for c, f in fitter.fold_values()])
    jobs = combos.select("combo_key", "combo", F.inline(each), ridge.alias("ridge"))
    found = fitter.scored(fitter.fit_table(jobs))
    return found.groupBy("combo_key", "column").agg(
        F.avg("accuracy").alias("avg_accuracy"), F.avg("f1_score").alias("avg_f1_score"), F.avg("mcfadden_r2").alias("avg_mcfadden_r2"),
        F.min("converged").alias("cv_converged"))


def cross_validate_classifiers(
    folded: DataFrame, combos: DataFrame, features: Sequence[str], target: str, fold: str = "fold", kind: str = "logit"
) -> DataFrame:
    """combo_key, avg_accuracy, avg_f1_score, avg_mcfadden_r2, cv_converged: means over the folds.

    Folds of one class have no R2. cv_converged is false where a fold's fit did not end.
    """
    return _cross_validated(folded, combos, features, target, [fold], kind).drop("column")


def repeated_classifier_cv(
    rows: DataFrame, combos: DataFrame, features: Sequence[str], target: str, runs: int = 10, folds: int = 5, kind: str = "logit",
    key: str = "id", seed: int = 42,
) -> DataFrame:
    """combo_key, iteration, avg_accuracy, avg_f1_score, avg_mcfadden_r2, cv_converged.

    One row per repeat (random folds, seeded seed + repeat) and one with iteration NULL for the means over the repeats.
    """
    from orbitable.operators.sampling import repeated_folds

    folded, names = repeated_folds(rows.select(key, *features, target), folds, runs, key, seed)
    parts = cut_lineage(_cross_validated(folded, combos, features, target, names, kind))
    means = ["avg_accuracy", "avg_f1_score", "avg_mcfadden_r2"]
    overall = parts.groupBy("combo_key").agg(*[F.avg(c).alias(c) for c in means], F.min("cv_converged").alias("cv_converged"))
    each = parts.select("combo_key", (F.col("column") + 1).alias("iteration"), *means, "cv_converged")
    return each.unionByName(overall.select("combo_key", F.lit(None).cast("int").alias("iteration"), *means, "cv_converged"))


def probability_table(rows: DataFrame, features: Sequence[str], target: str, key: str = "id", ridge: float = 1.0, kind: str = "logit") -> DataFrame:
    """key, y, p_<class> and the predicted class as column expressions."""
    fitter = LogisticFitter(rows, features, target, kind)
    job = fitter.fit([Job("all", list(features), ridge=ridge if kind == "logit" else 0.0)])[0]
    k, labels = len(fitter.labels), fitter.labels
    x = [F.col(c).cast("double") for c in job.used]
    if kind == "ordinal":
        cuts, beta = job.theta[: k - 1], job.theta[k - 1:]
        score = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        cum = [1 / (1 + F.exp(score - float(c))) for c in cuts] + [F.lit(1.0)]
        p = [cum[0]] + [cum[i] - cum[i - 1] for i in range(1, k)]
        out = rows.select(key, F.col(target).alias("y"), *[c.alias(f"p_{v}") for c, v in zip(p, labels)])
    else:
        theta = job.theta.reshape(-1, len(job.used) + 1)
        logits = [] if fitter.full(job.ridge) else [F.lit(0.0)]
        logits += [sum((float(b) * c for b, c in zip(t[1:], x)), F.lit(float(t[0]))) for t in theta]
        step = rows.select(key, F.col(target).alias("y"), *[c.alias(f"_s{i}") for i, c in enumerate(logits)])
        top = F.greatest(*[F.col(f"_s{i}") for i in range(k)])
        total = sum((F.exp(F.col(f"_s{i}") - top) for i in range(k)), F.lit(0.0))
        out = step.select(key, "y", *[(F.exp(F.col(f"_s{i}") - top) / total).alias(f"p_{v}") for i, v in enumerate(labels)])
    best = F.greatest(*[F.col(f"p_{v}") for v in labels])
    predicted = F.lit(None)
    for v in reversed(labels):
        predicted = F.when(F.col(f"p_{v}") == best, F.lit(v)).otherwise(predicted)
    return out.withColumn("predicted", predicted)


def classify_left_out(rows: DataFrame, left_out: DataFrame, features: Sequence[str], target: str, key: str = "id") -> DataFrame:
    """Train on `rows`, classify `left_out` (M14): key, y, predicted."""
    fitter = LogisticFitter(rows, features, target)
    job = fitter.fit([Job("all", list(features), ridge=1.0)])[0]
    theta = job.theta.reshape(-1, len(features) + 1)
    logits = [] if fitter.full(job.ridge) else [F.lit(0.0)]
    logits += [sum((float(b) * F.col(c) for b, c in zip(t[1:], features)), F.lit(float(t[0]))) for t in theta]
    filled = left_out.fillna(0.0, list(features))
    step = filled.select(key, F.col(target).alias("y"), *[c.alias(f"_s{i}") for i, c in enumerate(logits)])
    best = F.greatest(*[F.col(f"_s{i}") for i in range(len(logits))])
    predicted = F.lit(None)
    for i in reversed(range(len(logits))):
        predicted = F.when(F.col(f"_s{i}") == best, F.lit(fitter.labels[i])).otherwise(predicted)
    return step.select(key, "y", predicted.alias("predicted"))
