"""Principal components and plane fits from moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.operators.moments import Moments, moments


def _components(m: Moments, scale: bool) -> tuple[np.ndarray, np.ndarray]:
    base = np.nan_to_num(m.correlation()) if scale else m.cross / m.n
    values, vectors = np.linalg.eigh(base)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    # Fixed sign: the entry of largest size is positive.
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def explained_variance(df: DataFrame, names: Sequence[str], k: int, scale: bool = True) -> DataFrame:
    """component, ratio."""
    values, _ = _components(moments(df, names), scale)
    total = values.sum()
    rows = [(i + 1, float(v / total)) for i, v in enumerate(values[:k])]
    return df.sparkSession.createDataFrame(rows, "component int, ratio double")


def component_scores(df: DataFrame, names: Sequence[str], k: int, scale: bool = True) -> DataFrame:
    """Rows with pc1..pck; the scores are plain column expressions."""
    m = moments(df, names)
    _, vectors = _components(m, scale)
    sd = m.sd() if scale else np.ones(len(names))
    out = {}
    for c in range(k):
        weights = vectors[:, c] / np.where(sd > 0, sd, 1.0)
        out[f"pc{c + 1}"] = sum(
            (float(w) * (F.col(n) - float(mu)) for w, n, mu in zip(weights, names, m.mean)), F.lit(0.0)
        )
    return df.withColumns(out)


def plane_fits(atoms: DataFrame, members: Sequence[int] | None = None) -> DataFrame:
    """Per molecule: rms and largest distance to the least-squares plane, and its main direction.

    The 3 x 3 covariance is an aggregate; its eigenvectors are found for a whole batch at a time.
    """
    chosen = atoms.where(F.col("atom_idx").isin(*members)) if members else atoms
    axes = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    stats = chosen.groupBy("mol_id").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"],
        *[F.covar_pop(F.col(a), F.col(b)).alias(f"c{a}{b}") for a, b in axes],
    ).where("n >= 3")

    def solve(batches):
        for batch in batches:
            c = batch[[f"c{a}{b}" for a, b in axes]].to_numpy(dtype=float)
            s = np.empty((len(c), 3, 3))
            for k, (i, j) in enumerate([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]):
                s[:, i, j] = s[:, j, i] = c[:, k]
            values, vectors = np.linalg.eigh(s)
            yield pd.DataFrame(
                {
                    "mol_id": batch["mol_id"], "n": batch["n"], "mx": batch["mx"], "my": batch["my"], "mz": batch["mz"],
                    "rms": np.sqrt(np.maximum(values[:, 0], 0.0)), "normal": list(vectors[:, :, 0]), "direction": list(vectors[:, :, 2]),
                }
            )

    kind = dict(atoms.dtypes)["mol_id"]
    planes = stats.mapInPandas(
        solve, f"mol_id {kind}, n long, mx double, my double, mz double, rms double, normal array<double>, direction array<double>"
    )
    gap = sum(((F.col(c) - F.col(f"m{c}")) * F.get("normal", F.lit(i)) for i, c in enumerate("xyz")), F.lit(0.0))
    far = chosen.join(planes, "mol_id").groupBy("mol_id").agg(F.max(F.abs(gap)).alias("largest"))
    return planes.join(far, "mol_id").select("mol_id", "n", "rms", "largest", "direction")
