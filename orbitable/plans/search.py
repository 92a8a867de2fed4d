"""Model search over feature subsets."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orbitable.operators import clean
from orbitable.operators import regress as rg
from orbitable.operators.moments import moments
from orbitable.session import cut_lineage

REGRESSION_SCHEMA = (
    "combo_key string, combo array<string>, k int, r2 double, q2 double, mae double, rmsd double, threshold double, "
    "intercept double, coefficients array<double>, rank_deficient boolean"
)


def load_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored results, or None when nothing has been stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_results(results: DataFrame, path: str) -> None:
    """One append per search; rows flow from the executors to the table."""
    results.write.mode("append").parquet(str(PurePosixPath(path)))


def union_results(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def skip_finished(combos: DataFrame, finished: DataFrame | None) -> DataFrame:
    """Combinations without a stored result."""
    return combos if finished is None else combos.join(finished.select("combo_key").distinct(), "combo_key", "left_anti")


def rank_models(results: DataFrame, by: Sequence[str] = ("q2", "r2")) -> DataFrame:
    """Drop rows with a missing or infinite metric, best first."""
    return clean.finite_metrics(results, by).orderBy(*[F.desc(c) for c in by], "combo_key")


def top_models(results: DataFrame, n: int, at_least: int = 0, by: Sequence[str] = ("q2", "r2")) -> DataFrame:
    """First max(n, at_least) ranked models."""
    return rank_models(results, by).limit(max(n, at_least))


def evaluate(rows: DataFrame, combos: DataFrame, features: Sequence[str], target: str, threshold: float = 0.7,
             alpha: float | None = None) -> DataFrame:
    """Fit all combinations; those above the R2 gate also get leave-one-out metrics (M3, M5, with `alpha` M12)."""
    m = moments(rows, [*features, target])
    fits = cut_lineage(rg.fit_subsets(combos, m, target, alpha))
    passed = fits.where(F.col("r2") > threshold)
    loo = rg.leave_one_out(rows, passed, m, target, alpha)
    return fits.join(loo, "combo_key", "left").withColumn("threshold", F.lit(float(threshold))).select(
        *[c.split()[0] for c in REGRESSION_SCHEMA.split(", ")]
    )


def search_models(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    smallest: int = 1,
    largest: int | None = None,
    threshold: float = 0.7,
    required: Sequence[str] = (),
    top_n: int = 20,
    at_least: int = 5,
    store: str | None = None,
    relax: bool = False,
    step: float = 0.05,
    lowest: float = 0.2,
    alpha: float | None = None,
) -> DataFrame:
    """Standardise, enumerate, fit, gate, cross-validate, store and rank (M4); with `alpha` lasso models.

    A store holds models of one kind: use one per alpha.

    With `relax`, a gate nothing passes is lowered step by step; stored fits are filtered again,
    no subset is refitted.
    """
    spark = rows.sparkSession
    rows = clean.standardise(rows, features)
    combos = rg.combinations(spark, features, smallest, largest, None if largest else rows.count())
    combos = clean.has_required(combos, required)
    old = load_results(spark, store) if store else None
    results = evaluate(rows, skip_finished(combos, old), features, target, threshold, alpha)
    if store:
        append_results(results, store)
        results = spark.read.parquet(store)
    passed = validated(results, rows, features, target, threshold, alpha)
    if relax:
        # The gate is lowered on the fits alone; models are validated once a gate lets one through.
        best = results.agg(F.max("r2")).first()[0]
        while rank_models(passed).isEmpty() and threshold - step >= lowest:
            threshold -= step
            if best is not None and best > threshold:
                passed = validated(results, rows, features, target, threshold, alpha)
    return top_models(passed, top_n, at_least)


def validated(results: DataFrame, rows: DataFrame, features: Sequence[str], target: str, threshold: float, alpha: float | None = None) -> DataFrame:
    """Results above the gate; those that were stored without leave-one-out metrics get them now."""
    passed = cut_lineage(results.where(F.col("r2") > threshold))
    lacking = passed.where("q2 IS NULL")
    if lacking.isEmpty():
        return passed
    loo = rg.leave_one_out(rows, lacking, moments(rows, [*features, target]), target, alpha)
    added = lacking.drop("q2", "mae", "rmsd").join(loo, "combo_key").select(*passed.columns)
    return cut_lineage(passed.where("q2 IS NOT NULL").unionByName(added))


def search_classifiers(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    smallest: int = 1,
    largest: int = 2,
    threshold: float = 0.5,
    required: Sequence[str] = (),
    folds: int = 5,
    top_n: int = 50,
    kind: str = "logit",
    key: str = "id",
    seed: int | None = 42,
    store: str | None = None,
) -> DataFrame:
    """Fit classifiers for all subsets, gate on McFadden R2 (accuracy when there is none), cross-validate, rank."""
    from orbitable.operators import classify as oc
    from orbitable.operators import sampling as osm

    spark = rows.sparkSession
    rows = clean.standardise(rows, features)
    combos = clean.has_required(rg.combinations(spark, features, smallest, largest), required)
    old = load_results(spark, store) if store else None
    fits = cut_lineage(oc.fit_classifiers(rows, skip_finished(combos, old), features, target, kind))
    gate = F.coalesce(F.col("mcfadden_r2"), F.col("accuracy")) > threshold
    folded = osm.stratified_folds(rows, folds, target, key, seed)
    scored = ("avg_accuracy", "avg_f1_score", "avg_mcfadden_r2", "cv_converged")

    def validated_fits(found: DataFrame) -> DataFrame:
        passed = found.where(gate).select("combo_key", "combo")
        if passed.isEmpty():
            return found.withColumns({c: F.lit(None).cast("boolean" if c == "cv_converged" else "double") for c in scored})
        return found.join(oc.cross_validate_classifiers(folded, passed, features, target, kind=kind), "combo_key", "left")

    results = validated_fits(fits.withColumn("threshold", F.lit(float(threshold))))
    if store:
        append_results(results, store)
        results = spark.read.parquet(store)
        # Fits stored under a higher gate have no cross-validation yet.
        lacking = cut_lineage(results.where(gate & F.col("avg_accuracy").isNull()).drop(*scored))
        if not lacking.isEmpty():
            results = results.where(~(gate & F.col("avg_accuracy").isNull())).unionByName(validated_fits(lacking))
    return rank_models(results, ["mcfadden_r2"]).limit(top_n)
