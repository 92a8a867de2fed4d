"""Renumbering, assumption tests, whole extraction and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.operators import clean
from orbitable.operators import diagnostics as od
from orbitable.operators import moments as mo
from orbitable.operators import reduce as red
from orbitable.operators import regress as rg
from orbitable.operators import renumber as orn
from orbitable.plans import extraction as pe
from orbitable.plans import report as pr
from orbitable.queries.models import _LINE, PAIR
from orbitable.queries.registry import oracle, query


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


# Reverse the atom numbers of every molecule.
def _reverse(t):
    top = t.atoms.groupBy("mol_id").agg(F.max("atom_idx").alias("top"))
    return t.atoms.join(top, "mol_id").select("mol_id", F.col("atom_idx").alias("old"), (F.col("top") + 1 - F.col("atom_idx")).alias("new"))


_REVERSE = "m AS (SELECT mol_id, atom_idx AS old, max(atom_idx) OVER (PARTITION BY mol_id) + 1 - atom_idx AS new FROM atoms_v)"


@query("atoms_renumbered", oracle("WITH " + _REVERSE + """
    SELECT a.mol_id, m.new AS atom_idx, element, round(x, 6) AS x FROM atoms_v a JOIN m ON a.mol_id = m.mol_id AND a.atom_idx = m.old""", "atoms_v"))
def atoms_renumbered(t):
    return orn.renumber(t.atoms, _reverse(t)).select("mol_id", "atom_idx", "element", _r("x"))


@query("bonds_renumbered", oracle("WITH " + _REVERSE + """
    SELECT b.mol_id, least(p.new, q.new) AS a, greatest(p.new, q.new) AS b FROM bonds_v b
    JOIN m p ON p.mol_id = b.mol_id AND p.old = b.a JOIN m q ON q.mol_id = b.mol_id AND q.old = b.b""", "bonds_v"))
def bonds_renumbered(t):
    return orn.renumber_bonds(t.bonds, _reverse(t)).select("mol_id", "a", "b")


@query("renumber_map_completed", oracle("""
    WITH n AS (SELECT mol_id, atom_idx AS old, max(atom_idx) OVER (PARTITION BY mol_id) AS n FROM atoms_v)
    SELECT mol_id, old, CAST(CASE WHEN n >= 4 AND old < 4 THEN old + 1 WHEN n >= 4 AND old = 4 THEN 1
                                  WHEN n IN (2, 3) AND old < n THEN old + 1 WHEN n IN (2, 3) AND old = n THEN 1 ELSE old END AS INT) AS new FROM n""", "atoms_v"))
def renumber_map_completed(t):
    # 1 -> 2 -> 3 -> 4 and targets that some molecules lack; the chain is closed back to 1.
    partial = t.atoms.where("atom_idx <= 3").select("mol_id", F.col("atom_idx").alias("old"), (F.col("atom_idx") + 1).alias("new"))
    return orn.complete_map(t.atoms, partial)


@query("renumber_map_check", oracle("SELECT DISTINCT mol_id, true AS bijective FROM atoms_v", "atoms_v"))
def renumber_map_check(t):
    return orn.is_permutation(_reverse(t))


@query("renumbering_check", oracle("""
    SELECT c AS "column", n AS rows, 0 AS mismatches, CAST(d AS DOUBLE) AS largest, true AS equal FROM (SELECT count(*) AS n FROM atoms_v),
    (VALUES ('element', NULL), ('x', 0.0), ('y', 0.0), ('z', 0.0)) v(c, d)""", "atoms_v"))
def renumbering_check(t):
    mapping = _reverse(t)
    after = orn.renumber(t.atoms, mapping)
    return orn.check_renumbering(t.atoms, after, mapping, ["element", "x", "y", "z"])


@query("renumber_round_trip", oracle("SELECT mol_id, atom_idx, element FROM atoms_v", "atoms_v"))
def renumber_round_trip(t):
    mapping = _reverse(t)
    return orn.renumber(orn.renumber(t.atoms, mapping), orn.invert(mapping)).select("mol_id", "atom_idx", "element")


@query("plane_fit", oracle("""
    SELECT mol_id, count(*) AS n FROM atoms_v GROUP BY mol_id HAVING count(*) >= 3""", "atoms_v"))
def plane_fit(t):
    return red.plane_fits(t.atoms).select("mol_id", "n")


# --- assumption tests --------------------------------------------------------------------------

_TESTS = _LINE + """
    , o AS (SELECT *, row_number() OVER (ORDER BY id) AS pos, lag(e, 1) OVER (ORDER BY id) AS e1, lag(e, 2) OVER (ORDER BY id) AS e2,
                   lag(e, 3) OVER (ORDER BY id) AS e3, lag(e, 4) OVER (ORDER BY id) AS e4, lag(e, 5) OVER (ORDER BY id) AS e5, e * e AS q FROM r),
    bp AS (SELECT covar_pop(n_lines, q) AS c1, covar_pop(sum_qty, q) AS c2, var_pop(n_lines) AS v1, var_pop(sum_qty) AS v2, covar_pop(n_lines, sum_qty) AS v12,
                  var_pop(q) AS vq, count(*) AS n FROM o),
    h AS (SELECT CASE WHEN pos <= any_value(n) OVER () // 2 THEN 1 ELSE 2 END AS half, * FROM o),
    gq AS (SELECT half, count(*) AS n, (var_pop(y) - (covar_pop(n_lines, y) * (covar_pop(n_lines, y) * var_pop(sum_qty) - covar_pop(sum_qty, y) * covar_pop(n_lines, sum_qty))
              + covar_pop(sum_qty, y) * (covar_pop(sum_qty, y) * var_pop(n_lines) - covar_pop(n_lines, y) * covar_pop(n_lines, sum_qty)))
              / (var_pop(n_lines) * var_pop(sum_qty) - pow(covar_pop(n_lines, sum_qty), 2))) * count(*) / (count(*) - 3) AS s2 FROM h GROUP BY half)"""


@query("assumption_tests", oracle(_TESTS + """
    SELECT 'durbin_watson' AS test, round(sum(pow(e - e1, 2)) / sum(e * e), 6) AS statistic FROM o
    UNION ALL SELECT 'ljung_box_5', round(any_value(n) * (any_value(n) + 2) * (pow(sum(e*e1)/sum(e*e), 2)/(any_value(n)-1) + pow(sum(e*e2)/sum(e*e), 2)/(any_value(n)-2)
        + pow(sum(e*e3)/sum(e*e), 2)/(any_value(n)-3) + pow(sum(e*e4)/sum(e*e), 2)/(any_value(n)-4) + pow(sum(e*e5)/sum(e*e), 2)/(any_value(n)-5)), 6) FROM o
    UNION ALL SELECT 'jarque_bera', round(any_value(n) / 6 * (pow(avg(e*e*e) / pow(avg(e*e), 1.5), 2) + pow(avg(e*e*e*e) / pow(avg(e*e), 2) - 3, 2) / 4), 4) FROM o
    UNION ALL SELECT 'breusch_pagan_lm', round(n * (c1 * (c1 * v2 - c2 * v12) + c2 * (c2 * v1 - c1 * v12)) / (v1 * v2 - v12 * v12) / vq, 6) FROM bp
    UNION ALL SELECT 'goldfeld_quandt_f', round(max(s2) FILTER (half = 2) / max(s2) FILTER (half = 1), 6) FROM gq""", "samples_v"))
def assumption_tests(t):
    tests = od.assumption_tests(t.samples, PAIR, "y")
    named = tests.where(F.col("test").isin("durbin_watson", "ljung_box_5", "jarque_bera", "breusch_pagan_lm", "goldfeld_quandt_f"))
    digits = F.when(F.col("test") == "jarque_bera", F.round("statistic", 4)).otherwise(F.round("statistic", 6))
    return named.select("test", digits.alias("statistic"))


@query("assumption_tests_all", None)
def assumption_tests_all(t):
    return od.assumption_tests(t.samples, PAIR, "y")


@query("removal_by_mean", oracle("""
    WITH s AS (SELECT count(*) AS n, avg(y) AS m FROM samples_v)
    SELECT 1 AS step, id, round(y, 4) AS value FROM samples_v, s ORDER BY round(abs(m - (y - m) / (n - 1) - m), 9), id LIMIT 1""", "samples_v"))
def removal_by_mean(t):
    return od.removals(t.samples, "y", 1, "mean").select("step", "id", _r("value", 4))


@query("removal_by_ks", None)
def removal_by_ks(t):
    return od.removals(t.samples, "n_lines", 2, "ks")


@query("lasso", None)
def lasso(t):
    rows = clean.standardise(t.samples, PAIR)
    return od.lasso(rows, PAIR, "y", 1000.0).select("term", _r("estimate", 2))


@query("feature_shuffles", None)
def feature_shuffles(t):
    return od.feature_shuffles(t.samples, PAIR, "y", 2)


# --- whole plans -------------------------------------------------------------------------------

SPEC = {"npa": [[1, 2, 3]], "dipole": [[1, 2, 3]], "charges": [[1, 2]], "charge_diff": [[1, 2]], "sterimol": [[1, 2]],
        "stretching": [[1, 2]], "bending": [[1, 3]], "bond_angle": [[1, 2, 3]], "bond_length": [[1, 2], [2, 3]]}


def _tables(t):
    t.stored("atoms_v", "modes_v")
    return {"atoms": t.atoms, "bonds": t.bonds, "charges": t.charges, "mol_scalars": t.scalars, "modes": t.modes, "displacements": t.displacements}


@query("feature_extraction", oracle("""
    WITH b AS (SELECT p.mol_id, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS d FROM atoms_v p JOIN atoms_v q
               ON p.mol_id = q.mol_id AND p.atom_idx = 1 AND q.atom_idx = 2),
    c AS (SELECT mol_id, max(charge) FILTER (scheme = 'nbo' AND atom_idx = 1) AS a1, max(charge) FILTER (scheme = 'nbo' AND atom_idx = 2) AS a2 FROM charges_v GROUP BY mol_id)
    SELECT s.mol_id, round(b.d, 6) AS "bond_length_1-2", round(c.a1, 6) + 0.0 AS nbo_atom_1, round(c.a1 - c.a2, 6) + 0.0 AS "nbo_diff_1-2", round(s.iso, 6) AS iso
    FROM scalars_v s LEFT JOIN b ON b.mol_id = s.mol_id LEFT JOIN c ON c.mol_id = s.mol_id""", "atoms_v", "charges_v", "scalars_v"))
def feature_extraction(t):
    wide = pe.extract_features(_tables(t), SPEC, ("nbo", "hirshfeld"))
    return wide.select("mol_id", _r("`bond_length_1-2`").alias("bond_length_1-2"), _r("nbo_atom_1").alias("nbo_atom_1"),
                       _r("`nbo_diff_1-2`").alias("nbo_diff_1-2"), _r("iso"))


@query("long_to_wide", oracle("""
    SELECT mol_id, max(round(charge, 6) + 0.0) FILTER (scheme = 'nbo' AND atom_idx = 1) AS nbo_atom_1,
           max(round(charge, 6) + 0.0) FILTER (scheme = 'hirshfeld' AND atom_idx = 2) AS hirshfeld_atom_2
    FROM charges_v WHERE atom_idx IN (1, 2) GROUP BY mol_id""", "charges_v"))
def long_to_wide(t):
    from orbitable.operators.frames import atom_charges

    wide = pe.feature_matrix(atom_charges(t.charges, [1, 2]), ["nbo_atom_1", "hirshfeld_atom_2"])
    return wide.select("mol_id", _r("nbo_atom_1"), _r("hirshfeld_atom_2"))


@query("feature_quality", oracle("""
    WITH c AS (SELECT mol_id, max(charge) FILTER (scheme = 'nbo' AND atom_idx = 1) AS nbo_atom_1, max(charge) FILTER (scheme = 'nbo' AND atom_idx = 2) AS nbo_atom_2,
                      max(charge) FILTER (scheme = 'hirshfeld' AND atom_idx = 2) AS hirshfeld_atom_2 FROM charges_v WHERE atom_idx IN (1, 2) GROUP BY mol_id)
    SELECT 'correlated' AS kind, 'nbo_atom_2' AS feature, 'hirshfeld_atom_2' AS other, round(corr(nbo_atom_2, hirshfeld_atom_2), 6) AS value FROM c
    UNION ALL SELECT 'missing', unnest(['nbo_atom_2', 'hirshfeld_atom_2']), NULL, round(100 * avg(CASE WHEN nbo_atom_2 IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM c""", "charges_v"))
def feature_quality(t):
    from orbitable.operators.frames import atom_charges

    names = ["nbo_atom_1", "nbo_atom_2", "hirshfeld_atom_2"]
    wide = pe.feature_matrix(atom_charges(t.charges, [1, 2]), names)
    return pe.quality_report(wide, names).select("kind", "feature", "other", _r("value"))


@query("molecule_summary", oracle("""
    SELECT mol_id, round(homo_lumo_gap_ev, 7) AS gap, round(dip_x, 6) + 0.0 AS dip_x FROM scalars_v""", "scalars_v"))
def molecule_summary(t):
    return pe.molecule_summary(_tables(t)).select("mol_id", F.round("homo_lumo_gap_ev", 7).alias("gap"), _r("dip_x"))


@query("model_report", oracle(_LINE + """
    SELECT 'coefficient' AS section, 'n_lines' AS name, 'estimate' AS item, round(b1, 4) AS value FROM m
    UNION ALL SELECT 'fit', 'y', 'r2', round(1 - s2 * (n - 3) / syy, 4) FROM m
    UNION ALL SELECT 'vif', 'n_lines', 'vif', round(1 / (1 - v12 * v12 / (v1 * v2)), 4) FROM g
    UNION ALL SELECT 'cv', 'y', 'q2_loo', round(1 - sum(pow(e / (1 - h), 2)) / any_value(syy), 4) FROM r""", "samples_v"))
def model_report(t):
    report = pr.model_report(t.samples, PAIR, "y", seed=None)
    keep = (F.col("item").isin("r2", "q2_loo")) | (F.col("name") == "n_lines") & F.col("item").isin("estimate", "vif")
    return report.where(keep).select("section", "name", "item", _r("value", 4))


@query("wide_moments", oracle("""
    SELECT round(covar_pop(n_lines, y), 3) AS cov, count(*) AS n FROM samples_v""", "samples_v"))
def wide_moments(t):
    rows = t.samples
    extra = {f"x{i}": F.col("n_lines") * (i + 1) for i in range(16)}
    names = ["n_lines", "y", *extra]
    m = mo.moments(rows.withColumns(extra), names)
    i, j = m.at(["n_lines", "y"])
    return t.spark.createDataFrame([(round(float(m.cross[i, j] / m.n), 3), m.n)], "cov double, n long")


@query("report_equation", oracle(_LINE + """
    SELECT 'y = ' || CASE WHEN b1 < 0 THEN '- ' ELSE '+ ' END || printf('%.2f', abs(b1)) || ' n_lines ' || CASE WHEN b2 < 0 THEN '- ' ELSE '+ ' END ||
           printf('%.2f', abs(b2)) || ' sum_qty ' || CASE WHEN b0 < 0 THEN '- ' ELSE '+ ' END || printf('%.2f', abs(b0)) AS equation FROM m""", "samples_v"))
def report_equation(t):
    return pr.report_equation(t.spark, rg.fit_line(t.samples, PAIR, "y"))
