"""Single-model report as one long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.functions.energy import equation_text
from orbitable.operators import regress as rg
from orbitable.operators.moments import moments, vif_values
from orbitable.session import cut_lineage


def model_report(rows: DataFrame, features: Sequence[str], target: str, left_out: DataFrame | None = None, key: str = "id", seed: int | None = 42) -> DataFrame:
    """section, name, item, value: coefficients, VIF, cross-validation, left-out errors, equation."""
    spark, features = rows.sparkSession, list(features)
    rows = cut_lineage(rows.select(*dict.fromkeys([key, *features, target])))  # read for the moments, the folds and the left-out rows
    m = moments(rows, [*features, target])
    model = rg.FittedLine(m, features, target)
    table = rg.coefficient_table(spark, model)
    cells = [F.struct(F.lit("coefficient").alias("section"), F.col("term").alias("name"), F.lit(c).alias("item"), F.col(c).alias("value"))
             for c in ("estimate", "std_error", "t", "p")]
    out = table.select(F.inline(F.array(*cells)))
    rows_vif = [("vif", c, "vif", float(v)) for c, v in zip(features, vif_values(m, features))] + [("fit", target, "r2", float(model.r2))]
    out = out.unionByName(spark.createDataFrame(rows_vif, "section string, name string, item string, value double"))
    one = rg.combinations(spark, features, len(features), len(features))
    cv = rg.cv_summary(rows, one, features, target, key, seed)
    cells = [F.struct(F.lit("cv").alias("section"), F.lit(target).alias("name"), F.lit(c).alias("item"), F.col(c).alias("value"))
             for c in cv.columns if c != "combo_key"]
    out = out.unionByName(cv.select(F.inline(F.array(*cells))))
    if left_out is not None:
        errors = rg.predict_left_out(rows, left_out, features, target, key)
        out = out.unionByName(errors.select(F.lit("left_out").alias("section"), F.col(key).cast("string").alias("name"),
                                            F.lit("percent_error").alias("item"), F.col("percent_error").alias("value")))
    return out


def report_equation(spark, model: rg.FittedLine) -> DataFrame:
    data = spark.createDataFrame([(model.features, [float(b) for b in model.beta], float(model.intercept))],
                                 "names array<string>, coefficients array<double>, intercept double")
    return data.select(equation_text(F.col("names"), F.col("coefficients"), F.col("intercept")).alias("equation"))
