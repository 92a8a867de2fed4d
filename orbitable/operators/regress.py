"""Linear models over feature subsets.

One pass gives the moments of all features and the target; every subset is solved from them.
Cross-validation by folds needs one more pass (moments per fold): the training moments are the total
minus the fold, and the squared errors on the fold follow from its moments. Only leave-one-out and
absolute errors look at rows again; each task then emits one partial sum per model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.functions.distributions import t_quantile, t_two_sided
from orbitable.operators.blocks import matrix, meet, packed
from orbitable.operators.moments import Moments, complete_rows, moment_rows, moments, unpack
from orbitable.operators.ranking import hash_buckets, hash_order, numbered, value_buckets
from orbitable.operators.sampling import fold_count, folds_of_ranks, k_folds, repeated_ranks
from orbitable.session import cut_lineage

PASS_VALUES = 1 << 22  # numbers a task works on at once when many models meet a batch of rows
MODELS_AT_ONCE, ROWS_AT_ONCE = 256, 1 << 13
MAX_FEATURES = 4000  # p x p moments of this many doubles are 128 MB
CONDITION_LIMIT = 1e12


def combinations(spark, features: Sequence[str], smallest: int = 1, largest: int | None = None, n_rows: int | None = None) -> DataFrame:
    """All feature subsets of size smallest..largest: combo_key, combo, k (M2).

    Each level extends the one before by a later position, an explode without any join. The
    default largest size is a fifth of the number of rows, if known.
    """
    names = sorted(features)
    p = len(names)
    if largest is None:
        largest = max(1, int((n_rows or p) / 5))
    largest = min(largest, p)
    level = spark.range(1, p + 1).select(F.array(F.col("id").cast("int")).alias("at"), F.col("id").cast("int").alias("last"))
    out = None
    for k in range(1, largest + 1):
        if k > 1:
            level = level.where(F.col("last") < p).select(
                "at", F.explode(F.sequence(F.col("last") + 1, F.lit(p))).alias("last")
            ).select(F.array_append("at", F.col("last")).alias("at"), "last")
        if k >= smallest:
            part = level.select("at", F.lit(k).alias("k"))
            out = part if out is None else out.unionByName(part)
    table = F.lit(names)
    combo = F.transform("at", lambda i: F.element_at(table, i))
    return out.select(F.array_join(combo, "|").alias("combo_key"), combo.alias("combo"), "k")


FIT_SCHEMA = "combo_key string, combo array<string>, k int, r2 double, intercept double, coefficients array<double>, rank_deficient boolean"


def _solve(corr: np.ndarray, index: np.ndarray, target: int):
    """Standardised coefficients and R2 of many subsets of one size: index is (models, k)."""
    a = corr[index[:, :, None], index[:, None, :]]
    b = corr[index, target]
    eig = np.linalg.eigvalsh(a)
    bad = (eig[:, 0] <= eig[:, -1] / CONDITION_LIMIT) | ~np.isfinite(eig).all(axis=1)
    beta = np.zeros_like(b)
    good = ~bad
    if good.any():
        beta[good] = np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0]
    for i in np.flatnonzero(bad):
        beta[i] = np.linalg.pinv(a[i], rcond=1e-10, hermitian=True) @ b[i]
    return beta, np.einsum("ij,ij->i", beta, b), bad


def lasso_solve(cross: np.ndarray, with_target: np.ndarray, n, alpha: float, tolerance: float = 1e-13, sweeps: int = 20_000) -> np.ndarray:
    """Coefficients of many lasso models of one size (M12), by coordinate descent on centred cross products.

    Minimises SSE / (2n) + alpha * |w|: cross is (models, k, k), with_target (models, k), n a number or one per model. Constant columns get 0.
    """
    n = np.broadcast_to(np.asarray(n, float), len(cross))
    gram, c = cross / n[:, None, None], with_target / n[:, None]
    diagonal = np.einsum("mjj->mj", gram)
    usable = diagonal > 1e-12 * np.maximum(diagonal.max(axis=1, initial=0.0, keepdims=True), 1e-300)
    beta, live = np.zeros_like(c), np.arange(len(c))
    for _ in range(sweeps):
        if not len(live):
            break
        g, b, moved = gram[live], beta[live], np.zeros(len(live))
        for j in range(c.shape[1]):
            pull = c[live, j] - np.einsum("mj,mj->m", g[:, j], b) + diagonal[live, j] * b[:, j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - alpha, 0.0)
            new = np.where(usable[live, j], new / np.where(usable[live, j], diagonal[live, j], 1.0), 0.0)
            moved = np.maximum(moved, np.abs(new - b[:, j]) * np.sqrt(diagonal[live, j]))
            b[:, j] = new
        beta[live] = b
        size = (np.abs(b) * np.sqrt(diagonal[live])).max(axis=1, initial=0.0)
        live = live[moved > tolerance * np.maximum(size, 1e-300)]
    return beta


def fit_subsets(combos: DataFrame, m: Moments, target: str, alpha: float | None = None) -> DataFrame:
    """Fit every combination from the moments (M3); coefficients are on the scale of the columns.

    With `alpha` the models are lasso models (M12).
    """
    if len(m.names) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features: choose some first")
    corr, sd, cross = np.nan_to_num(m.correlation()), m.sd(), m.cross
    where, mean, t = {c: i for i, c in enumerate(m.names)}, m.mean, m.at([target])[0]

    def fit(batches):
        for batch in batches:
            for _, part in batch.groupby("k", sort=False):
                index = np.array([[where[c] for c in combo] for combo in part["combo"]], dtype=int)
                if alpha is None:
                    beta, r2, bad = _solve(corr, index, t)
                    coef = beta * sd[t] / np.where(sd[index] > 0, sd[index], 1.0)
                else:
                    block, own = cross[index[:, :, None], index[:, None, :]], cross[index, t]
                    coef = lasso_solve(block, own, m.n, alpha)
                    left = cross[t, t] - 2 * np.einsum("ij,ij->i", coef, own) + np.einsum("ij,ijk,ik->i", coef, block, coef)
                    r2, bad = 1 - left / cross[t, t], np.zeros(len(coef), bool)
                yield pd.DataFrame(
                    {
                        "combo_key": part["combo_key"],
                        "combo": part["combo"],
                        "k": part["k"],
                        "r2": r2,
                        "intercept": mean[t] - np.einsum("ij,ij->i", coef, mean[index]),
                        "coefficients": list(coef),
                        "rank_deficient": bad,
                    }
                )

    return combos.select("combo_key", "combo", "k").mapInPandas(fit, FIT_SCHEMA)


class _LassoLeaveOneOut:
    """As _LeaveOneOut for lasso models: every row's model is refitted from the cross products without that row."""

    def __init__(self, models: pa.Table, mean: np.ndarray, n: int, alpha: float):
        self.mean, self.n, self.alpha, self.keys = mean, n, alpha, models["combo_key"].to_pylist()
        self.at, self.numbers = models["at"].to_pylist(), [np.array(v) for v in models["numbers"].to_pylist()]
        self.sums = np.zeros((len(self.keys), 2))

    def add(self, batch: pa.RecordBatch) -> None:
        x, more = matrix(batch.column("x")) - self.mean, self.n / (self.n - 1)
        for m, at in enumerate(self.at):
            k = len(at)
            with_target, cross = self.numbers[m][:k], self.numbers[m][k:].reshape(k, k)
            for i in range(0, len(x), max(1, PASS_VALUES // (k * k))):
                part = x[i: i + max(1, PASS_VALUES // (k * k))]
                z, y = part[:, at], part[:, -1]
                beta = lasso_solve(cross - more * z[:, :, None] * z[:, None, :], with_target - more * z * y[:, None], self.n - 1, self.alpha)
                e = more * (y - (beta * z).sum(axis=1))
                self.sums[m] += [e @ e, np.abs(e).sum()]

    def result(self):
        yield pa.RecordBatch.from_arrays([pa.array(self.keys, pa.string()), pa.array(self.sums[:, 0]), pa.array(self.sums[:, 1])],
                                         names=["combo_key", "sq", "ab"])


class _LeaveOneOut:
    """Sums of squared and absolute leave-one-out errors of a block of models; `at` is the place of the target."""

    def __init__(self, models: pa.Table, mean: np.ndarray, n: int):
        self.mean, self.n, self.keys, self.groups = mean, n, models["combo_key"].to_pylist(), []
        at, numbers = models["at"].combine_chunks(), models["numbers"].combine_chunks()
        sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False)
        self.sums = np.zeros((len(sizes), 2))
        for k in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == k)
            values = matrix(numbers.take(pa.array(which)))
            self.groups.append((which, matrix(at.take(pa.array(which)), np.int64), values[:, :k], values[:, k:].reshape(-1, k, k)))

    def add(self, batch: pa.RecordBatch) -> None:
        x = matrix(batch.column("x")) - self.mean
        for which, at, beta, inverse in self.groups:
            step = max(1, PASS_VALUES // (len(x) * at.shape[1]))
            for i in range(0, len(which), step):
                part = slice(i, i + step)
                z = x[:, at[part]].transpose(1, 0, 2)  # models, rows, features
                h = 1.0 / self.n + ((z @ inverse[part]) * z).sum(axis=2)
                e = (x[None, :, -1] - (z @ beta[part][:, :, None])[:, :, 0]) / np.maximum(1.0 - h, 1e-12)
                self.sums[which[part], 0] += (e * e).sum(axis=1)
                self.sums[which[part], 1] += np.abs(e).sum(axis=1)

    def result(self):
        yield pa.RecordBatch.from_arrays([pa.array(self.keys, pa.string()), pa.array(self.sums[:, 0]), pa.array(self.sums[:, 1])],
                                         names=["combo_key", "sq", "ab"])


def row_vectors(rows: DataFrame, names: Sequence[str], splits: Sequence[str] = ()) -> DataFrame:
    """The complete rows as vectors: x, the named columns, and s, integer columns that say how a row is used."""
    return complete_rows(rows, names).select(
        F.array(*[F.col(c).cast("double") for c in names]).alias("x"), F.array(*[F.col(c).cast("int") for c in splits]).cast("array<int>").alias("s"))


def leave_one_out(rows: DataFrame, models: DataFrame, m: Moments, target: str, alpha: float | None = None) -> DataFrame:
    """combo_key, q2, mae, rmsd by leave-one-out (M5), exact: the held-out error is e / (1 - h); lasso models are refitted per row.

    One scan of the rows, whatever the number of models; neither rows nor models pass through the driver.
    """
    where = {c: i for i, c in enumerate(m.names)}
    t, sst, n, cross = where[target], float(m.cross[where[target], where[target]]), m.n, m.cross
    names = [c for c in m.names if c != target]
    place = {c: i for i, c in enumerate(names)}

    def solved(batches):
        for batch in batches:
            at, numbers = [], []
            for combo in batch["combo"]:
                i = [where[c] for c in combo]
                block, own = cross[np.ix_(i, i)], cross[i, t]
                if alpha is None:
                    block = np.linalg.pinv(block, rcond=1e-12, hermitian=True)
                    own = block @ own
                at.append([place[c] for c in combo])
                numbers.append(np.concatenate([own, block.ravel()]))
            yield pd.DataFrame({"combo_key": batch["combo_key"], "at": at, "numbers": numbers})

    prepared = cut_lineage(models.select("combo_key", "combo").mapInPandas(solved, "combo_key string, at array<int>, numbers array<double>"))
    mean = np.append(m.mean[[where[c] for c in names]], m.mean[t])
    parts = meet(cut_lineage(packed(row_vectors(rows, [*names, target]), len(mean))), n, len(mean), prepared, prepared.count(), F.col("combo_key"),
                 lambda block: _LeaveOneOut(block, mean, n) if alpha is None else _LassoLeaveOneOut(block, mean, n, alpha),
                 "combo_key string, sq double, ab double")
    return parts.groupBy("combo_key").agg(
        (1 - F.sum("sq") / sst).alias("q2"), (F.sum("ab") / n).alias("mae"), F.sqrt(F.sum("sq") / n).alias("rmsd")
    )


def _rest(total: Moments, part: Moments) -> Moments:
    """Moments of the rows of `total` that are not in `part`."""
    n = total.n - part.n
    mean = (total.n * total.mean - part.n * part.mean) / n
    delta = part.mean - mean
    cross = total.cross - part.cross - np.outer(delta, delta) * (part.n * n / total.n)
    return Moments(total.names, n, mean, cross)


def split_errors(models: DataFrame, splits: dict, target: str, alpha: float | None = None) -> DataFrame:
    """combo_key, split, sse, n from moments only: train on the rest, test on the part. With `alpha` lasso models.

    splits: {label: (train moments, test moments)}.
    """
    any_train = next(iter(splits.values()))[0]
    where = {c: i for i, c in enumerate(any_train.names)}
    t = where[target]

    def score(batches):
        for batch in batches:
            out = []
            for _, part in batch.groupby("k", sort=False):
                index = np.array([[where[c] for c in combo] for combo in part["combo"]], dtype=int)
                for label, (train, test) in splits.items():
                    a = train.cross[index[:, :, None], index[:, None, :]]
                    b = train.cross[index, t]
                    if alpha is None:
                        beta = np.einsum("ijk,ik->ij", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
                    else:
                        beta = lasso_solve(a, b, train.n, alpha)
                    inside = test.cross[t, t] - 2 * np.einsum("ij,ij->i", beta, test.cross[index, t])
                    inside += np.einsum("ij,ijk,ik->i", beta, test.cross[index[:, :, None], index[:, None, :]], beta)
                    shift = (test.mean[t] - train.mean[t]) - np.einsum("ij,ij->i", beta, test.mean[index] - train.mean[index])
                    sse = np.maximum(inside, 0.0) + test.n * shift**2
                    icept = train.mean[t] - np.einsum("ij,ij->i", beta, train.mean[index])
                    out.append(pd.DataFrame({"combo_key": part["combo_key"], "combo": part["combo"], "split": label, "sse": sse,
                                             "n": test.n, "intercept": icept, "coefficients": list(beta)}))
            if out:
                yield pd.concat(out)

    return models.select("combo_key", "combo", "k").mapInPandas(
        score,
        "combo_key string, combo array<string>, split string, sse double, n long, intercept double, coefficients array<double>",
    )


class _Absolute:
    """Sums of absolute errors of a block of models, each on the rows of its own split.

    `split` numbers (column of s, value there): a model with (r, f) reads the rows whose s[r] is f.
    """

    def __init__(self, models: pa.Table, width: int):
        self.keys, self.splits = models["combo_key"].to_pylist(), []
        self.sums = np.zeros(len(self.keys))
        column, value = (models[c].to_numpy() for c in ("column", "value"))
        at, slopes, intercept = models["at"].to_pylist(), models["slopes"].to_pylist(), models["intercept"].to_numpy()
        order = np.lexsort((np.array(self.keys, object).astype(str), value, column)) if self.keys else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.append(True, (column[order][1:] != column[order][:-1]) | (value[order][1:] != value[order][:-1])))
        for group in np.split(order, cut[1:]):
            blocks = []
            for i in range(0, len(group), MODELS_AT_ONCE):
                which = group[i: i + MODELS_AT_ONCE]
                used = np.unique(np.concatenate([np.asarray(at[j], np.int64) for j in which]))
                weights = np.zeros((len(used), len(which)))
                for c, j in enumerate(which):
                    weights[np.searchsorted(used, at[j]), c] = slopes[j]
                blocks.append((which, used, weights, intercept[which]))
            self.splits.append((int(column[group[0]]), int(value[group[0]]), blocks))

    def add(self, batch: pa.RecordBatch) -> None:
        x, s = matrix(batch.column("x")), matrix(batch.column("s"), np.int64)
        for column, value, blocks in self.splits:
            own = x[s[:, column] == value]
            for i in range(0, len(own) if blocks else 0, ROWS_AT_ONCE):
                part = own[i: i + ROWS_AT_ONCE]
                for which, used, weights, intercept in blocks:
                    self.sums[which] += np.abs(part[:, -1:] - intercept - part[:, used] @ weights).sum(axis=0)

    def result(self):
        # Splits of one model are added up here, so a cell yields one row per model.
        found, back = np.unique(np.array(self.keys, object).astype(str), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.string()), pa.array(np.bincount(back, weights=self.sums, minlength=len(found)))],
                                         names=["combo_key", "ab"])


def absolute_errors(vectors: DataFrame, n_rows: int, fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """combo_key, ab: sum of |error| of each fit on the rows of its split, in one scan of the rows for all splits.

    `vectors` comes from row_vectors over [*features, target] of a stored table, as `fits`, which has combo_key, combo, column and value (which rows: s[column] =
    value), intercept, coefficients.
    """
    listed = F.array(*[F.lit(c) for c in features])
    models = fits.select(
        "combo_key", F.transform("combo", lambda c: (F.array_position(listed, c) - 1).cast("int")).alias("at"), "column", "value", "intercept",
        F.col("coefficients").alias("slopes"))
    width = len(features) + 1
    parts = meet(packed(vectors, width), n_rows, width, models, fits.count(), F.col("combo_key"), lambda block: _Absolute(block, width), "combo_key string, ab double")
    return parts.groupBy("combo_key").agg(F.sum("ab").alias("ab"))


def _moments_by_split(rows: DataFrame, cols: list[str], columns: Sequence[str]) -> dict[tuple[int, int], Moments]:
    """Moments of the rows of every value of every split column, in one pass: {(column, value): moments}."""
    copies = rows.select(*cols, F.posexplode(F.array(*[F.col(c).cast("int") for c in columns])).alias("_column", "_value"))
    return {(r["_column"], r["_value"]): unpack(r, cols) for r in moment_rows(copies, cols, ["_column", "_value"]).collect()}


def _placed(errors: DataFrame) -> DataFrame:
    """Split labels `column:value` of split_errors as two numbers."""
    part = F.split("split", ":")
    return errors.withColumn("column", F.get(part, F.lit(0)).cast("int")).withColumn("value", F.get(part, F.lit(1)).cast("int"))


def _ranked_rows(rows: DataFrame, cols: Sequence[str], repeats: int, key: str, seed: int | None) -> DataFrame:
    """Complete rows with their ranks in the order of every repeat, stored."""
    base = complete_rows(rows, cols).select(key, *[c for c in cols if c != key])
    return repeated_ranks(base, 1 if seed is None else repeats, key, seed)


def cross_validate(
    rows: DataFrame, models: DataFrame, features: Sequence[str], target: str, k: int = 5, repeats: int = 5,
    key: str = "id", seed: int | None = 42, alpha: float | None = None, ranked: DataFrame | None = None,
) -> DataFrame:
    """combo_key, q2, mae, rmsd: pooled held-out errors per repeat, averaged over repeats (M6).

    seed None orders by the key itself (one repeat), otherwise by hashes seeded seed + repeat. Moments of all folds of all repeats come
    from one scan, absolute errors from another one. `ranked` are the rows of _ranked_rows, where several numbers of folds share them.
    """
    cols = [*features, target]
    repeats = 1 if seed is None else repeats
    ranked = _ranked_rows(rows, cols, repeats, key, seed) if ranked is None else ranked
    k = fold_count(ranked.count(), k)
    folded, names = folds_of_ranks(ranked, k, repeats)
    table = _moments_by_split(folded, cols, names)
    total = _merge_moments([p for (column, _), p in table.items() if column == 0])
    splits = {f"{column}:{value}": (_rest(total, p), p) for (column, value), p in table.items()}
    errors = cut_lineage(_placed(split_errors(models, splits, target, alpha)))
    t = total.at([target])[0]
    absolute = absolute_errors(row_vectors(folded, cols, names), total.n, errors, features)
    sst, n = float(total.cross[t, t]), total.n
    squared = errors.groupBy("combo_key", "column").agg(F.sum("sse").alias("sse")).groupBy("combo_key").agg(
        F.avg(1 - F.col("sse") / sst).alias("q2"), F.avg(F.sqrt(F.col("sse") / n)).alias("rmsd"))
    return squared.join(absolute, "combo_key").select("combo_key", "q2", (F.col("ab") / (n * repeats)).alias("mae"), "rmsd")


def repeated_holdout(
    rows: DataFrame, models: DataFrame, features: Sequence[str], target: str, test_share: float = 0.1, repeats: int = 5,
    key: str = "id", seed: int | None = 42,
) -> DataFrame:
    """combo_key, q2, mae, rmsd: mean over repeated random test sets of ceil(test_share * n) rows (M7).

    q2 is NULL below two test rows. seed None tests the first rows by key (one repeat).
    """
    cols = [*features, target]
    base = complete_rows(rows, cols)
    size = math.ceil(round(test_share * base.count(), 9))
    repeats = 1 if seed is None else repeats
    flagged, names = base, [f"_test{r}" for r in range(repeats)]
    for r, name in enumerate(names):
        # The first `size` rows of the order are the test set.
        if seed is None:
            ordered, by, bucket = flagged, [key], value_buckets(flagged, key)
        else:
            ordered = flagged.withColumn("_h", hash_order(F.col(key), seed=seed + r))
            by, bucket = ["_h", key], hash_buckets(ordered, "_h")
        ranked = numbered(ordered, [], by, bucket, "_rank")
        flagged = cut_lineage(ranked.withColumn(name, (F.col("_rank") <= size).cast("int")).drop("_rank", "_h"))
    table = _moments_by_split(flagged, cols, names)
    if len(table) < 2 * repeats:
        raise ValueError("a holdout needs rows on both sides")
    t = table[0, 1].at([target])[0]
    errors = cut_lineage(_placed(split_errors(models, {f"{r}:1": (table[r, 0], table[r, 1]) for r in range(repeats)}, target)))
    spread = F.element_at(F.array(*[F.lit(float(table[r, 1].cross[t, t])) for r in range(repeats)]), F.col("column") + 1)
    q2 = F.when((spread > 0) & F.lit(size >= 2), 1 - F.col("sse") / spread)
    squared = errors.groupBy("combo_key").agg(F.avg(q2).alias("q2"), F.avg(F.sqrt(F.col("sse") / size)).alias("rmsd"))
    absolute = absolute_errors(row_vectors(flagged, cols, names), table[0, 0].n + size, errors, features)
    return squared.join(absolute, "combo_key").select("combo_key", "q2", (F.col("ab") / (size * repeats)).alias("mae"), "rmsd")


def _merge_moments(parts: list[Moments]) -> Moments:
    out = parts[0]
    for p in parts[1:]:
        n = out.n + p.n
        delta = p.mean - out.mean
        cross = out.cross + p.cross + np.outer(delta, delta) * (out.n * p.n / n)
        out = Moments(out.names, n, out.mean + delta * (p.n / n), cross)
    return out


def cv_summary(rows: DataFrame, models: DataFrame, features: Sequence[str], target: str, key: str = "id", seed: int | None = 42, repeats: int = 5) -> DataFrame:
    """Nine metrics per model: 3-fold, 5-fold and leave-one-out (M8)."""
    named = lambda df, tag: df.select("combo_key", *[F.col(c).alias(f"{c}_{tag}") for c in ("q2", "mae", "rmsd")])
    # Every pass reads the stored rows, and both numbers of folds their ranks.
    rows = _ranked_rows(rows, [*features, target], repeats, key, seed)
    three = named(cross_validate(rows, models, features, target, 3, repeats, key, seed, ranked=rows), "3fold")
    five = named(cross_validate(rows, models, features, target, 5, repeats, key, seed, ranked=rows), "5fold")
    loo = named(leave_one_out(rows, models, moments(rows, [*features, target]), target), "loo")
    return three.join(five, "combo_key").join(loo, "combo_key")


class FittedLine:
    """One least-squares model solved from moments, with the closed forms its reports need."""

    def __init__(self, m: Moments, features: Sequence[str], target: str):
        i, t = m.at(features), m.at([target])[0]
        self.features, self.target, self.n, self.mean_y = list(features), target, m.n, float(m.mean[t])
        self.mean = m.mean[i]
        self.inverse = np.linalg.pinv(m.cross[np.ix_(i, i)], rcond=1e-12, hermitian=True)
        self.beta = self.inverse @ m.cross[i, t]
        self.intercept = self.mean_y - float(self.beta @ self.mean)
        self.sst = float(m.cross[t, t])
        self.sse = max(self.sst - float(self.beta @ m.cross[i, t]), 0.0)
        self.df = m.n - len(i) - 1
        self.s2 = self.sse / self.df if self.df > 0 else float("nan")
        self.r2 = 1 - self.sse / self.sst if self.sst > 0 else float("nan")

    def prediction(self):
        return sum((F.lit(float(b)) * F.col(c) for b, c in zip(self.beta, self.features)), F.lit(self.intercept))

    def leverage(self):
        """h of a row as a Column: 1/n + (x - mean)' C^-1 (x - mean)."""
        z = [F.col(c) - float(mu) for c, mu in zip(self.features, self.mean)]
        out = F.lit(1.0 / self.n)
        for a in range(len(z)):
            out = out + float(self.inverse[a, a]) * z[a] * z[a]
            for b in range(a + 1, len(z)):
                out = out + float(2 * self.inverse[a, b]) * z[a] * z[b]
        return out


def fit_line(rows: DataFrame, features: Sequence[str], target: str) -> FittedLine:
    return FittedLine(moments(rows, [*features, target]), features, target)


def predict(rows: DataFrame, model: FittedLine, level: float | None = None) -> DataFrame:
    """Add prediction and, with a level, the prediction interval (M9)."""
    out = rows.withColumn("prediction", model.prediction())
    if level is None:
        return out
    t = t_quantile(0.5 + level / 2, model.df)
    half = t * F.sqrt(model.s2 * (1 + model.leverage()))
    return out.withColumn("lower", F.col("prediction") - half).withColumn("upper", F.col("prediction") + half)


def coefficient_table(spark, model: FittedLine) -> DataFrame:
    """term, estimate, std_error, t, p."""
    var = [model.s2 * (1.0 / model.n + float(model.mean @ model.inverse @ model.mean))]
    var += [model.s2 * float(v) for v in np.diag(model.inverse)]
    rows = []
    for term, b, v in zip(["intercept", *model.features], [model.intercept, *model.beta], var):
        se = float(np.sqrt(v))
        t = float(b) / se if se > 0 else float("nan")
        rows.append((term, float(b), se, t, t_two_sided(t, model.df)))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, t double, p double")


def predict_left_out(rows: DataFrame, left_out: DataFrame, features: Sequence[str], target: str, key: str = "id") -> DataFrame:
    """Train on `rows`, predict `left_out` (missing features count as 0) with errors in percent."""
    from orbitable.functions.energy import percent_error

    model = fit_line(rows, features, target)
    scored = predict(left_out.fillna(0.0, list(features)), model)
    return scored.select(
        key, F.col(target).alias("actual"), "prediction", (F.col(target) - F.col("prediction")).alias("error"),
        percent_error(F.col(target), F.col("prediction")).alias("percent_error"),
    )


def linear_contributions(rows: DataFrame, model: FittedLine, key: str = "id") -> DataFrame:
    """Per row contribution of every feature, coefficient * (x - mean)."""
    return rows.select(
        key, *[(float(b) * (F.col(c) - float(mu))).alias(c) for b, c, mu in zip(model.beta, model.features, model.mean)]
    )


def contribution_ranking(rows: DataFrame, model: FittedLine) -> DataFrame:
    """Features by mean absolute contribution (M23): feature, importance."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.avg(F.abs(float(b) * (F.col(c) - float(mu)))).alias("importance"))
        for b, c, mu in zip(model.beta, model.features, model.mean)
    ]
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).orderBy(F.desc("importance"), "feature")


def influence(rows: DataFrame, model: FittedLine, key: str = "id") -> DataFrame:
    """Leverage, internally studentised residual, Cook, DFFITS, max |DFBETA|, covariance ratio, flags."""
    n, p = model.n, len(model.features)
    q = p + 1
    base = complete_rows(rows, [*model.features, model.target]).withColumn("h", model.leverage()).withColumn(
        "e", F.col(model.target) - model.prediction()
    )
    base = base.withColumn("student", F.col("e") / F.sqrt(model.s2 * (1 - F.col("h"))))
    # Residual variance without the row.
    s2_out = (model.s2 * model.df - F.col("e") * F.col("e") / (1 - F.col("h"))) / (model.df - 1)
    base = base.withColumn("s2_out", s2_out).withColumn(
        "external", F.col("e") / F.sqrt(F.col("s2_out") * (1 - F.col("h")))
    )
    z = [F.col(c) - float(mu) for c, mu in zip(model.features, model.mean)]
    change = []
    for a in range(p):
        move = sum((float(model.inverse[a, b]) * z[b] for b in range(p)), F.lit(0.0))
        scale = F.sqrt(F.col("s2_out") * float(model.inverse[a, a]))
        change.append(F.abs(move * F.col("e") / (1 - F.col("h")) / scale))
    # The intercept moves by what the mean residual and the slopes move.
    w = model.inverse @ model.mean
    icept = 1.0 / n - sum((float(w[b]) * z[b] for b in range(p)), F.lit(0.0))
    var0 = 1.0 / n + float(model.mean @ w)
    change.append(F.abs(icept * F.col("e") / (1 - F.col("h")) / F.sqrt(F.col("s2_out") * var0)))
    h, r = F.col("h"), F.col("student")
    out = base.select(
        key,
        "h",
        r.alias("student"),
        F.col("external"),
        (r * r * h / (1 - h) / q).alias("cook"),
        (r * F.sqrt(h / (1 - h))).alias("dffits"),
        (F.greatest(*change) if len(change) > 1 else change[0]).alias("max_dfbeta"),
        (F.pow(F.col("s2_out") / model.s2, F.lit(q)) / (1 - h)).alias("cov_ratio"),
    )
    flags = {
        "flag_cook": F.col("cook") > 4 / (n - p - 1),
        "flag_leverage": F.col("h") > 2 * q / n,
        "flag_student": F.abs("student") > 3,
        "flag_dffits": F.abs("dffits") > 2 * (q / n) ** 0.5,
        "flag_dfbeta": F.col("max_dfbeta") > 2 / n**0.5,
    }
    return out.withColumns(flags)


def robust_errors(rows: DataFrame, model: FittedLine) -> DataFrame:
    """HC3 standard errors: sandwich with e^2 / (1 - h)^2 (M26). term, std_error."""
    cols = ["_one", *model.features]
    base = complete_rows(rows, [*model.features, model.target]).withColumn("_one", F.lit(1.0))
    w = F.pow((F.col(model.target) - model.prediction()) / (1 - model.leverage()), F.lit(2.0))
    base = base.withColumn("_w", w)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = base.agg(*[F.sum(F.col("_w") * F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = row[f"s{i}_{j}"]
    bread = np.zeros_like(meat)
    wmean = model.inverse @ model.mean
    bread[1:, 1:] = model.inverse
    bread[0, 1:] = bread[1:, 0] = -wmean
    bread[0, 0] = 1.0 / model.n + float(model.mean @ wmean)
    errors = np.sqrt(np.diag(bread @ meat @ bread))
    data = [(c, float(e)) for c, e in zip(["intercept", *model.features], errors)]
    return rows.sparkSession.createDataFrame(data, "term string, std_error double")


def permuted_target(rows: DataFrame, target: str, runs: int, key: str = "id", seed: int = 0) -> DataFrame:
    """Rows repeated per run with the target permuted over rows: adds run and y_perm.

    Rows and targets are each ranked in their own hash order and joined on the rank; ranks are
    unique, so the join has no hot key.
    """
    copies = rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    by_row = numbered(copies.withColumn("_h", hash_order(F.col(key), F.col("run"), seed=seed)), ["run"], ["_h", key],
                      hash_buckets(rows, "_h"), "_rank").drop("_h")
    values = copies.select("run", key, F.col(target).alias("y_perm")).withColumn(
        "_h", hash_order(F.col(key), F.col("run"), seed=seed + 1)
    )
    by_value = numbered(values, ["run"], ["_h", key], hash_buckets(rows, "_h"), "_rank").select("run", "_rank", "y_perm")
    return by_row.join(by_value, ["run", "_rank"]).drop("_rank")


def y_randomisation(rows: DataFrame, features: Sequence[str], target: str, runs: int = 50, key: str = "id", seed: int = 0) -> DataFrame:
    """In-sample R2 of the model per permutation run; run 0 is the true target (M22). run, r2."""
    shuffled = permuted_target(complete_rows(rows, [*features, target]), target, runs, key, seed)
    cols = [*features, "y_perm"]
    spark = rows.sparkSession
    table = moment_rows(shuffled, cols, ["run"]).collect()  # one p x p row per run
    out = [(0, float(fit_line(rows, features, target).r2))]
    out += [(int(r["run"]), float(FittedLine(unpack(r, cols), features, "y_perm").r2)) for r in table]
    return spark.createDataFrame(sorted(out), "run int, r2 double")


def y_randomisation_cv(rows: DataFrame, features: Sequence[str], target: str, runs: int = 10, k: int = 5, key: str = "id", seed: int = 0) -> DataFrame:
    """Held-out q2 and rmsd per permutation run from moments per (run, fold): run, q2, rmsd."""
    base = k_folds(complete_rows(rows, [*features, target]), k, key, seed + 7, "fold")
    shuffled = permuted_target(base, target, runs, key, seed).withColumn("run", F.col("run"))
    cols = [*features, "y_perm"]
    table: dict = {}
    for r in moment_rows(shuffled, cols, ["run", "fold"]).collect():
        table.setdefault(r["run"], []).append(unpack(r, cols))
    out = []
    for run, parts in sorted(table.items()):
        total, sse = _merge_moments(parts), 0.0
        for part in parts:
            train = FittedLine(_rest(total, part), features, "y_perm")
            i, t = part.at(features), part.at(["y_perm"])[0]
            inside = part.cross[t, t] - 2 * train.beta @ part.cross[i, t] + train.beta @ part.cross[np.ix_(i, i)] @ train.beta
            sse += max(float(inside), 0.0) + part.n * float(part.mean[t] - train.intercept - train.beta @ part.mean[i]) ** 2
        t = total.at(["y_perm"])[0]
        out.append((int(run), 1 - sse / float(total.cross[t, t]), float(np.sqrt(sse / total.n))))
    return rows.sparkSession.createDataFrame(out, "run int, q2 double, rmsd double")
