"""Correlation, VIF and PCA queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.operators import moments as mo
from orbitable.operators import reduce as red
from orbitable.queries.registry import oracle, query

FEATURES = ["n_lines", "sum_qty", "avg_qty", "sum_disc", "avg_tax", "o_totalprice"]

_CORR = "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM samples_v"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]) + ")"


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


@query("correlation_matrix", oracle(_CORR + " SELECT f1, f2, round(r, 6) + 0.0 AS r FROM c", "samples_v"))
def correlation_matrix(t):
    return mo.correlation_long(t.samples, FEATURES).select("f1", "f2", _r("r"))


@query("correlated_pairs", oracle(_CORR + " SELECT f1, f2, round(r, 6) + 0.0 AS r FROM c WHERE abs(r) > 0.8", "samples_v"))
def correlated_pairs(t):
    return mo.correlated_pairs(t.samples, FEATURES).select("f1", "f2", _r("r"))


@query("flagged_features", oracle(_CORR + """
    SELECT DISTINCT unnest([f1, f2]) AS feature FROM c WHERE abs(r) > 0.7""", "samples_v"))
def flagged_features(t):
    return mo.flagged_features(mo.correlated_pairs(t.samples, FEATURES, 0.7))


@query("correlation_order", oracle(_CORR + """
    SELECT feature, round(sum(abs(r)), 6) AS total, max(abs(r)) > 0.85 AS starred FROM (SELECT f1 AS feature, r FROM c UNION ALL SELECT f2, r FROM c)
    GROUP BY feature""", "samples_v"))
def correlation_order(t):
    return mo.correlation_order(t.samples, FEATURES, 0.85).select("feature", _r("total"), "starred")


# VIF of three features in closed form: 1 / (1 - R2 on the other two).
@query("vif", oracle("""
    WITH r AS (SELECT corr(n_lines, sum_qty) AS a, corr(n_lines, sum_disc) AS b, corr(sum_qty, sum_disc) AS c FROM samples_v),
    d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM r)
    SELECT 'n_lines' AS feature, round((1 - c * c) / d, 6) AS vif FROM d UNION ALL
    SELECT 'sum_qty', round((1 - b * b) / d, 6) FROM d UNION ALL SELECT 'sum_disc', round((1 - a * a) / d, 6) FROM d""", "samples_v"))
def vif(t):
    return mo.vif(t.samples, ["n_lines", "sum_qty", "sum_disc"]).select("feature", _r("vif"))


@query("vif_pruning", oracle("""
    WITH r AS (SELECT corr(n_lines, sum_qty) AS a, corr(n_lines, sum_disc) AS b, corr(sum_qty, sum_disc) AS c FROM samples_v),
    d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM r)
    SELECT 'n_lines' AS feature, false AS kept, round((1 - c * c) / d, 6) AS vif FROM d UNION ALL
    SELECT 'sum_qty', true, round(1 / (1 - c * c), 6) FROM d UNION ALL SELECT 'sum_disc', true, round(1 / (1 - c * c), 6) FROM d""", "samples_v"))
def vif_pruning(t):
    return mo.prune_by_vif(t.samples, ["n_lines", "sum_qty", "sum_disc"], 0.7, 3.0).select("feature", "kept", _r("vif"))


@query("principal_components", oracle("""
    SELECT 1 AS component, round((1 + abs(corr(n_lines, sum_qty))) / 2, 6) AS ratio FROM samples_v UNION ALL
    SELECT 2, round((1 - abs(corr(n_lines, sum_qty))) / 2, 6) FROM samples_v""", "samples_v"))
def principal_components(t):
    return red.explained_variance(t.samples, ["n_lines", "sum_qty"], 2).select("component", _r("ratio"))


@query("component_scores", oracle("""
    WITH z AS (SELECT id, (n_lines - avg(n_lines) OVER ()) / stddev_pop(n_lines) OVER () AS a,
                      (sum_qty - avg(sum_qty) OVER ()) / stddev_pop(sum_qty) OVER () AS b FROM samples_v)
    SELECT id, round((a + b) / sqrt(2), 6) + 0.0 AS pc1 FROM z""", "samples_v"))
def component_scores(t):
    return red.component_scores(t.samples, ["n_lines", "sum_qty"], 1).select("id", _r("pc1"))


@query("embedding_components", None)
def embedding_components(t):
    names = [f"e{i}" for i in range(64)]
    rows = t.table("embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return red.explained_variance(rows, names, 10).select("component", _r("ratio", 4))
