"""Linear model queries over samples_v."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.operators import clean
from orbitable.operators import factors as ofa
from orbitable.operators import regress as rg
from orbitable.operators.moments import moments
from orbitable.plans import search as ps
from orbitable.queries.registry import oracle, query

FEATURES = ["n_lines", "sum_qty", "avg_qty", "sum_disc", "avg_tax", "o_totalprice"]
PAIR = ["n_lines", "sum_qty"]


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


def _list(items) -> str:
    return ", ".join(items)


# Standardised long form: one row per sample and feature, then closed forms for one and two features.
_Z = """
    WITH s AS (SELECT id, y, """ + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" for f in FEATURES) + """ FROM samples_v),
    one AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS combo_key, 1 AS k, id, y, {f} AS x1, 0.0 AS x2 FROM s" for f in FEATURES) + """),
    two AS (""" + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS combo_key, 2 AS k, id, y, {a} AS x1, {b} AS x2 FROM s"
    for a in sorted(FEATURES) for b in sorted(FEATURES) if a < b) + """),
    g AS (SELECT combo_key, k, count(*) AS n, avg(y) AS my, var_pop(y) AS vy, covar_pop(x1, x2) AS r,
                 covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2),
    fit AS (SELECT *, CASE WHEN k = 1 THEN c1 ELSE (c1 - r * c2) / (1 - r * r) END AS b1,
                   CASE WHEN k = 1 THEN 0 ELSE (c2 - r * c1) / (1 - r * r) END AS b2 FROM g),
    fits AS (SELECT *, (b1 * c1 + b2 * c2) / vy AS r2 FROM fit),
    loo AS (SELECT f.combo_key, f.k, f.r2, f.n, f.vy, f.b1, f.b2, f.my,
               (d.y - f.my - f.b1 * x1 - f.b2 * x2) /
               (1 - 1.0 / f.n - CASE WHEN f.k = 1 THEN x1 * x1 / f.n ELSE (x1 * x1 - 2 * f.r * x1 * x2 + x2 * x2) / (f.n * (1 - f.r * f.r)) END) AS e
            FROM fits f JOIN (SELECT * FROM one UNION ALL SELECT * FROM two) d ON d.combo_key = f.combo_key WHERE f.r2 > 0.5),
    cv AS (SELECT combo_key, k, r2, 1 - sum(e * e) / (n * vy) AS q2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmsd
           FROM loo GROUP BY combo_key, k, r2, n, vy)"""


@query("model_search_top", oracle(_Z + """
    SELECT combo_key, k, round(r2, 6) AS r2, round(q2, 6) AS q2, round(mae, 3) AS mae, round(rmsd, 3) AS rmsd
    FROM cv ORDER BY q2 DESC, r2 DESC, combo_key LIMIT 10""", "samples_v"))
def model_search_top(t):
    top = ps.search_models(t.samples, FEATURES, "y", largest=2, threshold=0.5, top_n=10)
    return top.select("combo_key", "k", _r("r2"), _r("q2"), _r("mae", 3), _r("rmsd", 3))


@query("model_fits", oracle(_Z + """
    SELECT combo_key, k, round(r2, 6) AS r2, round(my, 3) AS intercept, round(b1, 3) + 0.0 AS b1 FROM fits""", "samples_v"))
def model_fits(t):
    rows = clean.standardise(t.samples, FEATURES)
    fits = rg.fit_subsets(rg.combinations(t.spark, FEATURES, 1, 2), moments(rows, [*FEATURES, "y"]), "y")
    return fits.select("combo_key", "k", _r("r2"), _r("intercept", 3), (F.round(F.element_at("coefficients", 1), 3) + 0.0).alias("b1"))


@query("model_gate_loo", oracle(_Z + """
    SELECT f.combo_key, round(f.r2, 6) AS r2, round(q2, 6) AS q2, round(mae, 3) AS mae
    FROM fits f LEFT JOIN cv ON cv.combo_key = f.combo_key""", "samples_v"))
def model_gate_loo(t):
    rows = clean.standardise(t.samples, FEATURES)
    out = ps.evaluate(rows, rg.combinations(t.spark, FEATURES, 1, 2), FEATURES, "y", 0.5)
    return out.select("combo_key", _r("r2"), _r("q2"), _r("mae", 3))


@query("feature_combinations", oracle(f"""
    WITH n AS (SELECT count(*) AS n FROM samples_v WHERE {" AND ".join(f + " IS NOT NULL" for f in FEATURES)}),
    f AS (SELECT unnest([{', '.join(repr(c) for c in FEATURES)}]) AS c)
    SELECT c AS combo_key, 1 AS k, n AS n_rows FROM f, n UNION ALL
    SELECT a.c || '|' || b.c, 2, n FROM f a JOIN f b ON a.c < b.c, n UNION ALL
    SELECT a.c || '|' || b.c || '|' || d.c, 3, n FROM f a JOIN f b ON a.c < b.c JOIN f d ON b.c < d.c, n""", "samples_v"))
def feature_combinations(t):
    rows = t.samples
    names = clean.numeric_columns(rows, [c for c in rows.columns if c not in ("id", "y")])
    n = moments(rows, names).n
    return rg.combinations(t.spark, names, 1, 3).select("combo_key", "k", F.lit(n).cast("bigint").alias("n_rows"))


@query("required_feature_models", oracle(_Z + """
    SELECT combo_key, round(r2, 6) AS r2 FROM fits WHERE k = 2 AND combo_key LIKE '%sum_disc%'""", "samples_v"))
def required_feature_models(t):
    combos = clean.has_required(rg.combinations(t.spark, FEATURES, 2, 2), ["sum_disc"])
    return rg.fit_subsets(combos, moments(t.samples, [*FEATURES, "y"]), "y").select("combo_key", _r("r2"))


@query("finished_models_skipped", oracle(_Z + """
    SELECT combo_key FROM fits WHERE r2 <= 0.5""", "samples_v"))
def finished_models_skipped(t):
    combos = rg.combinations(t.spark, FEATURES, 1, 2)
    fits = rg.fit_subsets(combos, moments(t.samples, [*FEATURES, "y"]), "y")
    return ps.skip_finished(combos, fits.where("r2 > 0.5")).select("combo_key")


@query("results_union", oracle(_Z + """
    SELECT combo_key, round(r2, 6) AS r2, CAST(NULL AS DOUBLE) AS q2 FROM fits WHERE k = 1
    UNION ALL SELECT combo_key, round(r2, 6), round(q2, 6) FROM cv WHERE k = 2""", "samples_v"))
def results_union(t):
    rows = clean.standardise(t.samples, FEATURES)
    m = moments(rows, [*FEATURES, "y"])
    old = rg.fit_subsets(rg.combinations(t.spark, FEATURES, 1, 1), m, "y").select("combo_key", _r("r2"))
    new = ps.evaluate(rows, rg.combinations(t.spark, FEATURES, 2, 2), FEATURES, "y", 0.5).where("q2 IS NOT NULL")
    return ps.union_results(old, new.select("combo_key", _r("r2"), _r("q2"))).select("combo_key", "r2", "q2")


_MOM = ", ".join(FEATURES + ["y"])


@query("moment_matrix", oracle("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(covar_pop({a}, {b}), 4) + 0.0 AS cov FROM samples_v"
    for i, a in enumerate(FEATURES[:5]) for b in FEATURES[i:5]) + ")", "samples_v"))
def moment_matrix(t):
    names = FEATURES[:5]
    m = moments(t.samples, names)
    rows = [(a, b, float(m.cross[i, j] / m.n)) for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return t.spark.createDataFrame(rows, "f1 string, f2 string, cov double").select("f1", "f2", _r("cov", 4))


# k-fold by order of the id: fold = (row_number - 1) % 5, on (n_lines) and (n_lines, sum_qty).
_FOLD = """
    WITH f AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) % 5 AS fold FROM samples_v),
    tr AS (SELECT g.fold, count(*) AS n, avg(y) AS my, avg(n_lines) AS m1, avg(sum_qty) AS m2, covar_pop(n_lines, y) AS c1,
                  covar_pop(sum_qty, y) AS c2, var_pop(n_lines) AS v1, var_pop(sum_qty) AS v2, covar_pop(n_lines, sum_qty) AS v12
           FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY g.fold),
    b AS (SELECT fold, my, m1, m2, c1 / v1 AS s1, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS d1,
                 (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS d2 FROM tr),
    e AS (SELECT f.id, f.fold, f.y, y - my - s1 * (n_lines - m1) AS e1, y - my - d1 * (n_lines - m1) - d2 * (sum_qty - m2) AS e2
          FROM f JOIN b ON f.fold = b.fold)"""


@query("kfold_cross_validation", oracle(_FOLD + """
    SELECT 'n_lines' AS combo_key, round(1 - sum(e1 * e1) / (count(*) * var_pop(y)), 6) AS q2, round(avg(abs(e1)), 3) AS mae,
           round(sqrt(avg(e1 * e1)), 3) AS rmsd FROM e
    UNION ALL SELECT 'n_lines|sum_qty', round(1 - sum(e2 * e2) / (count(*) * var_pop(y)), 6), round(avg(abs(e2)), 3),
           round(sqrt(avg(e2 * e2)), 3) FROM e""", "samples_v"))
def kfold_cross_validation(t):
    models = rg.combinations(t.spark, PAIR, 1, 2).where("combo_key <> 'sum_qty'")
    return rg.cross_validate(t.samples, models, PAIR, "y", 5, seed=None).select(
        "combo_key", _r("q2"), _r("mae", 3), _r("rmsd", 3))


# A lasso model of one feature has a closed form: the covariance moved towards 0 by alpha.
@query("lasso_fits", oracle("WITH f AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS combo_key, covar_pop({c}, y) AS c, var_pop({c}) AS v, var_pop(y) AS w FROM samples_v" for c in FEATURES) + """),
    b AS (SELECT *, sign(c) * greatest(abs(c) - 5000, 0) / v AS b FROM f)
    SELECT combo_key, round(b, 4) AS slope, round(1 - (w - 2 * b * c + b * b * v) / w, 6) AS r2 FROM b""", "samples_v"))
def lasso_fits(t):
    fits = rg.fit_subsets(rg.combinations(t.spark, FEATURES, 1, 1), moments(t.samples, [*FEATURES, "y"]), "y", 5000.0)
    return fits.select("combo_key", F.round(F.get("coefficients", F.lit(0)), 4).alias("slope"), _r("r2"))


@query("lasso_search", None)
def lasso_search(t):
    return ps.search_models(t.samples, FEATURES, "y", largest=3, threshold=0.5, alpha=1000.0).select(
        "combo_key", _r("r2"), _r("q2"), _r("mae", 3), _r("rmsd", 3))


@query("repeated_kfold", None)
def repeated_kfold(t):
    models = rg.combinations(t.spark, FEATURES, 1, 2)
    return rg.cross_validate(t.samples, models, FEATURES, "y").select("combo_key", _r("q2"), _r("mae", 3), _r("rmsd", 3))


@query("repeated_holdout", None)
def repeated_holdout(t):
    models = rg.combinations(t.spark, FEATURES, 1, 2)
    return rg.repeated_holdout(t.samples, models, FEATURES, "y").select("combo_key", _r("q2"), _r("mae", 3), _r("rmsd", 3))


@query("cv_summary", None)
def cv_summary(t):
    models = rg.combinations(t.spark, FEATURES, 1, 2)
    return rg.cv_summary(t.samples, models, FEATURES, "y")


# Two-feature model n_lines + sum_qty in closed form.
_LINE = """
    WITH g AS (SELECT count(*) AS n, avg(y) AS my, avg(n_lines) AS m1, avg(sum_qty) AS m2, var_pop(y) * count(*) AS syy,
                      covar_pop(n_lines, y) * count(*) AS c1, covar_pop(sum_qty, y) * count(*) AS c2, var_pop(n_lines) * count(*) AS v1,
                      var_pop(sum_qty) * count(*) AS v2, covar_pop(n_lines, sum_qty) * count(*) AS v12 FROM samples_v),
    i AS (SELECT *, v2 / (v1 * v2 - v12 * v12) AS i1, v1 / (v1 * v2 - v12 * v12) AS i2, -v12 / (v1 * v2 - v12 * v12) AS i12 FROM g),
    l AS (SELECT *, i1 * c1 + i12 * c2 AS b1, i12 * c1 + i2 * c2 AS b2 FROM i),
    m AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * c1 - b2 * c2) / (n - 3) AS s2 FROM l),
    r AS (SELECT id, y, n_lines, sum_qty, m.*, b0 + b1 * n_lines + b2 * sum_qty AS p, y - (b0 + b1 * n_lines + b2 * sum_qty) AS e,
                 1.0 / n + i1 * (n_lines - m1) * (n_lines - m1) + i2 * (sum_qty - m2) * (sum_qty - m2)
                 + 2 * i12 * (n_lines - m1) * (sum_qty - m2) AS h FROM samples_v, m)"""


@query("predictions", oracle(_LINE + " SELECT id, round(p, 3) AS prediction, round(e, 3) + 0.0 AS error FROM r", "samples_v"))
def predictions(t):
    rows = t.samples
    out = rg.predict(rows, rg.fit_line(rows, PAIR, "y"))
    return out.select("id", _r("prediction", 3), (F.round(F.col("y") - F.col("prediction"), 3) + 0.0).alias("error"))


@query("prediction_interval", oracle(_LINE + """
    SELECT id, round(p, 3) AS prediction, round(sqrt(s2 * (1 + h)), 3) AS spread FROM r""", "samples_v"))
def prediction_interval(t):
    from orbitable.functions.distributions import t_quantile

    rows = t.samples
    model = rg.fit_line(rows, PAIR, "y")
    out = rg.predict(rows, model, 0.95)
    q = t_quantile(0.975, model.df)
    return out.select("id", _r("prediction", 3), F.round((F.col("upper") - F.col("lower")) / (2 * q), 3).alias("spread"))


@query("coefficient_table", oracle(_LINE + """
    SELECT 'intercept' AS term, round(b0, 4) AS estimate, round(sqrt(s2 * (1.0 / n + i1 * m1 * m1 + i2 * m2 * m2 + 2 * i12 * m1 * m2)), 4) AS std_error FROM m
    UNION ALL SELECT 'n_lines', round(b1, 4), round(sqrt(s2 * i1), 4) FROM m
    UNION ALL SELECT 'sum_qty', round(b2, 4), round(sqrt(s2 * i2), 4) FROM m""", "samples_v"))
def coefficient_table(t):
    return rg.coefficient_table(t.spark, rg.fit_line(t.samples, PAIR, "y")).select("term", _r("estimate", 4), _r("std_error", 4))


@query("robust_errors", oracle(_LINE + """
    , w AS (SELECT pow(e / (1 - h), 2) AS w, n_lines AS x1, sum_qty AS x2, n, m1, m2, i1, i2, i12 FROM r),
    u AS (SELECT w, i1 * (x1 - m1) + i12 * (x2 - m2) AS u1, i12 * (x1 - m1) + i2 * (x2 - m2) AS u2, n, m1, m2 FROM w)
    SELECT 'n_lines' AS term, round(sqrt(sum(w * u1 * u1)), 4) AS std_error FROM u
    UNION ALL SELECT 'sum_qty', round(sqrt(sum(w * u2 * u2)), 4) FROM u
    UNION ALL SELECT 'intercept', round(sqrt(sum(w * pow(1.0 / n - m1 * u1 - m2 * u2, 2))), 4) FROM u""", "samples_v"))
def robust_errors(t):
    rows = t.samples
    return rg.robust_errors(rows, rg.fit_line(rows, PAIR, "y")).select("term", _r("std_error", 4))


@query("influence_table", oracle(_LINE + """
    , s AS (SELECT *, e / sqrt(s2 * (1 - h)) AS st, (s2 * (n - 3) - e * e / (1 - h)) / (n - 4) AS so FROM r)
    SELECT id, round(h, 8) AS h, round(st, 5) + 0.0 AS student, round(st * st * h / (1 - h) / 3, 7) AS cook, round(st * sqrt(h / (1 - h)), 6) + 0.0 AS dffits,
           round(pow(so / s2, 3) / (1 - h), 6) AS cov_ratio, st * st * h / (1 - h) / 3 > 4.0 / (n - 3) AS flag_cook, h > 6.0 / n AS flag_leverage,
           abs(st) > 3 AS flag_student,
           round(greatest(abs((i1 * (n_lines - m1) + i12 * (sum_qty - m2)) * e / (1 - h) / sqrt(so * i1)),
                    abs((i12 * (n_lines - m1) + i2 * (sum_qty - m2)) * e / (1 - h) / sqrt(so * i2)),
                    abs((1.0 / n - m1 * (i1 * (n_lines - m1) + i12 * (sum_qty - m2)) - m2 * (i12 * (n_lines - m1) + i2 * (sum_qty - m2))) * e / (1 - h)
                        / sqrt(so * (1.0 / n + i1 * m1 * m1 + i2 * m2 * m2 + 2 * i12 * m1 * m2)))), 6) AS max_dfbeta
    FROM s""", "samples_v"))
def influence_table(t):
    rows = t.samples
    out = rg.influence(rows, rg.fit_line(rows, PAIR, "y"))
    return out.select("id", _r("h", 8), _r("student", 5), _r("cook", 7), _r("dffits"), _r("cov_ratio"), "flag_cook",
                      "flag_leverage", "flag_student", _r("max_dfbeta"))


@query("linear_contributions", oracle(_LINE + """
    SELECT id, round(b1 * (n_lines - m1), 3) + 0.0 AS n_lines, round(b2 * (sum_qty - m2), 3) + 0.0 AS sum_qty FROM r""", "samples_v"))
def linear_contributions(t):
    rows = t.samples
    return rg.linear_contributions(rows, rg.fit_line(rows, PAIR, "y")).select("id", _r("n_lines", 3), _r("sum_qty", 3))


@query("contribution_ranking", oracle(_LINE + """
    SELECT 'n_lines' AS feature, round(avg(abs(b1 * (n_lines - m1))), 3) AS importance FROM r
    UNION ALL SELECT 'sum_qty', round(avg(abs(b2 * (sum_qty - m2))), 3) FROM r""", "samples_v"))
def contribution_ranking(t):
    rows = t.samples
    return rg.contribution_ranking(rows, rg.fit_line(rows, PAIR, "y")).select("feature", _r("importance", 3))


@query("left_out_predictions", oracle("""
    WITH o AS (SELECT s.* FROM samples_v s JOIN orders ON id = o_orderkey WHERE o_orderstatus = 'P'),
    tr AS (SELECT s.* FROM samples_v s JOIN orders ON id = o_orderkey WHERE o_orderstatus <> 'P'),
    g AS (SELECT avg(y) AS my, avg(n_lines) AS m1, covar_pop(n_lines, y) / var_pop(n_lines) AS b FROM tr)
    SELECT id, round(y, 3) AS actual, round(my + b * (n_lines - m1), 3) AS prediction, round(y - (my + b * (n_lines - m1)), 3) + 0.0 AS error,
           round(CASE WHEN y <> 0 THEN abs(y - (my + b * (n_lines - m1))) / abs(y) * 100 END, 4) AS percent_error FROM o, g""", "samples_v"))
def left_out_predictions(t):
    held = t.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    rows = t.samples
    train, test = clean.leave_out(rows, held), clean.keep_ids(rows, held)
    return rg.predict_left_out(train, test, ["n_lines"], "y").select(
        "id", _r("actual", 3), _r("prediction", 3), _r("error", 3), _r("percent_error", 4))


@query("y_randomisation", None)
def y_randomisation(t):
    return rg.y_randomisation(t.samples, PAIR, "y", 10)


@query("y_randomisation_cv", None)
def y_randomisation_cv(t):
    return rg.y_randomisation_cv(t.samples, PAIR, "y", 5)


# One slope beside the levels of a factor: deviations from the level means give the slope, what is left of the means the levels.
@query("factor_regression", """
    WITH v AS (SELECT l_partkey AS g, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
    m AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM v GROUP BY g),
    b AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM v JOIN m USING (g)),
    a AS (SELECT g, my - b * mx AS a FROM m, b),
    f AS (SELECT min_by(a, g) AS first, min(g) AS g0 FROM a)
    SELECT 'intercept' AS term, NULL AS level, round(first, 4) AS estimate FROM f
    UNION ALL SELECT 'l_quantity', NULL, round(b, 4) FROM b
    UNION ALL SELECT 'l_partkey', CAST(g AS VARCHAR), round(a - first, 4) + 0.0 FROM a, f WHERE g > g0""")
def factor_regression(t):
    return ofa.factor_regression(t.table("lineitem"), ["l_quantity"], ["l_partkey"], "l_extendedprice").terms.select(
        "term", "level", _r("estimate", 4))
