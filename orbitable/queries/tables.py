"""Cleaning, reshaping and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitable.functions import energy as fe
from orbitable.functions import labels as fl
from orbitable.operators import clean
from orbitable.operators import metrics as om
from orbitable.operators import sampling as osm
from orbitable.operators.ranking import lagged_pairs, numbered, value_buckets
from orbitable.queries.registry import oracle, query

FEATURES = ["n_lines", "sum_qty", "avg_qty", "sum_disc", "avg_tax", "o_totalprice"]


def _r(name: str, digits: int = 6):
    return (F.round(F.col(name), digits) + 0.0).alias(name)


# A table as it comes from text: everything a string, blanks, repeated names, a column with no number.
RAW = """
    raw AS (SELECT CAST(c_custkey AS BIGINT) AS seq, CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN 'nan'
                   ELSE 'M' || CAST(c_custkey % 50 AS VARCHAR) END AS "Name",
                   CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS f1,
                   c_mktsegment AS smiles, c_mktsegment AS words, CAST(c_acctbal AS VARCHAR) AS f2,
                   CASE WHEN c_custkey % 13 = 0 THEN '' ELSE CAST(c_custkey % 17 AS VARCHAR) END AS target FROM customer)"""


def raw(t):
    c, k = t.table("customer"), F.col("c_custkey")
    name = F.when(k % 7 == 0, " ").when(k % 11 == 0, "nan").otherwise(F.concat(F.lit("M"), (k % 50).cast("string")))
    return c.select(
        k.cast("bigint").alias("seq"), name.alias("Name"),
        F.when(k % 5 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("f1"),
        F.col("c_mktsegment").alias("smiles"), F.col("c_mktsegment").alias("words"),
        F.col("c_acctbal").cast("string").alias("f2"),
        F.when(k % 13 == 0, "").otherwise((k % 17).cast("string")).alias("target"),
    )


@query("prepared_samples", "WITH " + RAW + """,
    n AS (SELECT seq, CASE WHEN trim("Name") = '' OR lower(trim("Name")) = 'nan' THEN 'row' ELSE trim("Name") END AS id,
                 TRY_CAST(f1 AS DOUBLE) AS f1, TRY_CAST(f2 AS DOUBLE) AS f2, TRY_CAST(target AS DOUBLE) AS y FROM raw
          WHERE TRY_CAST(target AS DOUBLE) IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM n)
    SELECT CASE WHEN k > 1 THEN id || '#' || CAST(k AS VARCHAR) ELSE id END AS id, seq, y, f1, round(f2, 4) AS f2 FROM k""")
def prepared_samples(t):
    return clean.prepare(raw(t), "TARGET", "seq").select("id", "seq", "y", "f1", _r("f2", 4))


@query("numeric_coercion", "WITH " + RAW + """
    SELECT seq, TRY_CAST(f1 AS DOUBLE) AS f1, TRY_CAST(words AS DOUBLE) AS words FROM raw""")
def numeric_coercion(t):
    return raw(t).select("seq", clean.to_number("f1").alias("f1"), clean.to_number("words").alias("words"))


@query("unique_names", "WITH " + RAW + """,
    n AS (SELECT seq, CASE WHEN trim("Name") = '' OR lower(trim("Name")) = 'nan' THEN 'row' ELSE trim("Name") END AS b FROM raw),
    k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY seq) AS k FROM n)
    SELECT seq, CASE WHEN k > 1 THEN b || '#' || CAST(k AS VARCHAR) ELSE b END AS "Name" FROM k""")
def unique_names(t):
    return clean.clean_names(raw(t).select("seq", "Name"), "Name", "seq")


@query("columns_dropped", "WITH " + RAW + ' SELECT seq, "Name", f1, f2, target FROM raw')
def columns_dropped(t):
    return clean.drop_columns(clean.drop_columns(raw(t), clean.TEXT_COLUMNS), ["WORDS"])


@query("duplicate_columns_dropped", "SELECT o_orderkey, o_custkey FROM orders")
def duplicate_columns_dropped(t):
    o = t.table("orders")
    return clean.unique_columns(o.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("o_custkey")))


@query("target_joined", oracle("""
    SELECT s.id, n_lines, round(o.o_totalprice, 2) AS target FROM samples_v s JOIN orders o ON s.id = o.o_orderkey
    WHERE o.o_orderstatus = 'F'""", "samples_v"))
def target_joined(t):
    target = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("target"))
    return t.samples.select("id", "n_lines").join(target, "id")


@query("leave_out_samples", oracle("""
    SELECT id, n_lines FROM samples_v WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""", "samples_v"))
def leave_out_samples(t):
    held = t.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return clean.leave_out(t.samples, held).select("id", "n_lines")


@query("keep_only_samples", oracle("""
    SELECT id, n_lines FROM samples_v WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""", "samples_v"))
def keep_only_samples(t):
    held = t.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return clean.keep_ids(t.samples, held).select("id", "n_lines")


@query("standardised_samples", oracle("SELECT id, " + ", ".join(
    f"round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 6) + 0.0 AS {f}" for f in FEATURES) + " FROM samples_v", "samples_v"))
def standardised_samples(t):
    return clean.standardise(t.samples, FEATURES).select("id", *[_r(f) for f in FEATURES])


@query("standardised_continuous", oracle("""SELECT id, n_lines, round((avg_qty - avg(avg_qty) OVER ()) / stddev_pop(avg_qty) OVER (), 6) + 0.0
    AS avg_qty FROM samples_v""", "samples_v"))
def standardised_continuous(t):
    return clean.standardise(t.samples, ["n_lines", "avg_qty"], only_continuous=True).select("id", "n_lines", _r("avg_qty"))


@query("column_profile", oracle(" UNION ALL ".join(f"""
    SELECT '{f}' AS "column", CAST(0 AS DOUBLE) AS missing_percent, round(min({f}), 4) AS low, round(max({f}), 4) AS high,
           max(abs({f} - round({f}))) = 0 AS whole, min({f}) = max({f}) AS "constant" FROM samples_v""" for f in FEATURES), "samples_v"))
def column_profile(t):
    return clean.column_profile(t.samples, FEATURES).select("column", "missing_percent", _r("low", 4), _r("high", 4), "whole", "constant")


@query("missing_percent", "WITH " + RAW + """
    SELECT 'f1' AS "column", round(100 * avg(CASE WHEN TRY_CAST(f1 AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END), 4) AS percent FROM raw
    UNION ALL SELECT 'target', round(100 * avg(CASE WHEN TRY_CAST(target AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM raw""")
def missing_percent(t):
    rows = raw(t).select(clean.to_number("f1").alias("f1"), clean.to_number("target").alias("target"))
    return clean.missing_percent(rows, ["f1", "target"]).select("column", _r("percent", 4))


@query("mean_filled", "WITH " + RAW + """, v AS (SELECT seq, TRY_CAST(f1 AS DOUBLE) AS f1 FROM raw)
    SELECT seq, round(coalesce(f1, (SELECT avg(f1) FROM v)), 6) AS f1 FROM v""")
def mean_filled(t):
    return clean.fill_mean(raw(t).select("seq", clean.to_number("f1").alias("f1")), ["f1"]).select("seq", _r("f1"))


@query("useful_columns", oracle("""
    SELECT unnest(['n_lines', 'sum_qty']) AS feature, count(*) AS n_rows FROM samples_v""", "samples_v"))
def useful_columns(t):
    rows = t.samples.withColumns({"same": F.col("sum_qty"), "flat": F.lit(1.0), "twice": 2 * F.col("n_lines") + 1})
    names = clean.useful_columns(rows, ["n_lines", "sum_qty", "same", "flat", "twice"], "id")
    return rows.groupBy().agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("feature"), "n_rows")


@query("complete_rows", "WITH " + RAW + """
    SELECT seq, TRY_CAST(f1 AS DOUBLE) AS f1, TRY_CAST(target AS DOUBLE) AS y FROM raw
    WHERE TRY_CAST(f1 AS DOUBLE) IS NOT NULL AND TRY_CAST(target AS DOUBLE) IS NOT NULL""")
def complete_rows(t):
    from orbitable.operators.moments import complete_rows as keep

    return keep(raw(t).select("seq", clean.to_number("f1").alias("f1"), clean.to_number("target").alias("y")), ["f1", "y"])


@query("finite_metrics", """SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)""")
def finite_metrics(t):
    marked = t.table("events").select("event_id", "value")
    return clean.finite_metrics(marked, ["value"])


@query("one_hot", oracle("""
    SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS DOUBLE) AS "s_O",
           CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS DOUBLE) AS "s_P" FROM orders"""))
def one_hot(t):
    rows = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    out, names = clean.one_hot(rows, "s")
    return out.select("id", *names)


@query("natural_order", oracle("""
    SELECT c_name, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT), c_name) AS pos FROM customer"""))
def natural_order(t):
    rows = t.table("customer").select("c_name", fl.first_integer(F.col("c_name")).alias("_n"))
    return numbered(rows, [], ["_n", "c_name"], value_buckets(rows, "_n"), "pos").select("c_name", "pos")


@query("excess_classes", oracle("""
    SELECT id, round((exp(2 * (-d / (2 * 0.0019872041 * 298.15))) - 1) / (exp(2 * (-d / (2 * 0.0019872041 * 298.15))) + 1) * 100, 4) + 0.0 AS ee,
           abs((exp(2 * (-d / (2 * 0.0019872041 * 298.15))) - 1) / (exp(2 * (-d / (2 * 0.0019872041 * 298.15))) + 1) * 100) >= 35 AS class
    FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_discount AS DOUBLE) * 20 - 1 AS d FROM lineitem)"""))
def excess_classes(t):
    d = F.col("l_discount").cast("double") * 20 - 1
    return t.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.round(fe.enantiomeric_excess(d), 4) + 0.0).alias("ee"), fe.excess_class(d).alias("class"))


@query("name_differences", """
    SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 4)""")
def name_differences(t):
    li = t.table("lineitem")
    return li.select(F.col("l_partkey").alias("k")).distinct().join(
        li.where("l_quantity < 4").select(F.col("l_partkey").alias("k")), "k", "left_anti")


# --- folds and samples --------------------------------------------------------------------------

@query("k_folds", oracle("""
    SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % 5 AS INT) AS fold FROM samples_v""", "samples_v"))
def k_folds(t):
    return osm.k_folds(t.samples.select("id"), 5, seed=None)


@query("k_fold_sizes", oracle("""
    SELECT (i - 1) AS fold, (SELECT count(*) FROM samples_v) // 5 + CASE WHEN (i - 1) < (SELECT count(*) FROM samples_v) % 5 THEN 1 ELSE 0 END AS n
    FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i)""", "samples_v"))
def k_fold_sizes(t):
    return osm.k_folds(t.samples.select("id"), 5).groupBy("fold").agg(F.count("*").alias("n"))


@query("stratified_folds", oracle("""
    SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY id) - 1) % 4 AS INT) AS fold FROM classes_v""", "classes_v"))
def stratified_folds(t):
    return osm.stratified_folds(t.classes.select("id", "y"), 4, seed=None)


@query("random_folds", oracle("SELECT count(*) AS n, 6 AS folds FROM samples_v", "samples_v"))
def random_folds(t):
    return osm.folds_no_empty(t.samples.select("id"), 6).agg(
        F.count("*").alias("n"), F.count_distinct("fold").cast("int").alias("folds"))


@query("weighted_draw", oracle("SELECT 200 AS n, 200 AS ids FROM (SELECT count(*) AS c FROM samples_v) WHERE c >= 200", "samples_v"))
def weighted_draw(t):
    return osm.weighted_draw(t.samples, 200, "n_lines").agg(
        F.count("*").cast("int").alias("n"), F.count_distinct("id").cast("int").alias("ids"))


@query("draws_with_replacement", oracle("SELECT 300 AS n FROM (SELECT count(*) AS c FROM samples_v) WHERE c > 0", "samples_v"))
def draws_with_replacement(t):
    return osm.draw_with_replacement(t.samples, 300).agg(F.count("*").cast("int").alias("n"))


@query("stratified_sample", """
    SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders)
    WHERE r <= 40""")
def stratified_sample(t):
    rows = t.table("orders").select("o_orderkey", "o_orderpriority")
    return osm.stratified_sample(rows, "o_orderpriority", 40, "o_orderkey", seed=None).select("o_orderkey", "o_orderpriority")


@query("stratified_share", """
    SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r,
        count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r <= greatest(1, floor(CAST(0.1 AS DOUBLE) * n))""")
def stratified_share(t):
    rows = t.table("orders").select("o_orderkey", "o_orderpriority")
    return osm.stratified_sample(rows, "o_orderpriority", 0.1, "o_orderkey", seed=None).select("o_orderkey", "o_orderpriority")


@query("class_sizes", oracle("SELECT y, count(*) AS n FROM classes_v GROUP BY y", "classes_v"))
def class_sizes(t):
    return osm.class_sizes(t.classes)


_SIM = """
    WITH z AS (SELECT id, y, (n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER () AS a,
                      (n_words - avg(n_words) OVER ()) / stddev_pop(n_words) OVER () AS b FROM classes_v),
    c AS (SELECT y, avg(a) AS ca, avg(b) AS cb FROM z GROUP BY y),
    s AS (SELECT id, z.y, CASE WHEN (a*a+b*b) * (ca*ca+cb*cb) = 0 THEN 0 ELSE (a*ca+b*cb) / sqrt((a*a+b*b)) / sqrt(ca*ca+cb*cb) END AS similarity
          FROM z JOIN c ON z.y = c.y)"""


@query("centroid_similarity", oracle(_SIM + " SELECT id, y, round(similarity, 6) + 0.0 AS similarity FROM s", "classes_v"))
def centroid_similarity(t):
    return osm.centroid_similarity(t.classes, ["n_chars", "n_words"]).select("id", "y", _r("similarity"))


@query("similarity_sample", oracle("""
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN y <> 1 THEN 'other' WHEN row_number() OVER (PARTITION BY y ORDER BY id) <= 12 THEN 'kept' ELSE 'dropped' END AS status
    FROM classes_v) GROUP BY status""", "classes_v"))
def similarity_sample(t):
    rows = t.classes
    sampled = osm.similarity_sample(rows, ["n_chars", "n_words"], 1, 12)
    return osm.sample_status(rows, sampled, 1).groupBy("status").agg(F.count("*").alias("n"))


@query("lagged_values", oracle("""
    SELECT id, n_lines, lag(n_lines, 1) OVER (ORDER BY id) AS n_lines_lag1, lag(n_lines, 3) OVER (ORDER BY id) AS n_lines_lag3 FROM samples_v""",
    "samples_v"))
def lagged_values(t):
    rows = t.samples.select("id", "n_lines")
    placed = numbered(rows, [], ["id"], value_buckets(rows, "id"), "pos")
    return lagged_pairs(placed, "pos", [1, 3], ["n_lines"]).drop("pos")


@query("value_histogram", oracle("""
    WITH b AS (SELECT min(y) AS lo, (max(y) - min(y)) / 10 AS w FROM samples_v)
    SELECT CAST(least(9, floor((y - lo) / w)) AS INT) AS bin, count(*) AS n FROM samples_v, b GROUP BY 1""", "samples_v"))
def value_histogram(t):
    return om.histogram(t.samples, "y").select("bin", "n")


@query("ks_distance", oracle("""
    WITH v AS (SELECT y, 1 AS b, CASE WHEN n_lines >= 3 THEN 1 ELSE 0 END AS a FROM samples_v),
    c AS (SELECT y, sum(b) OVER (ORDER BY y) AS cb, sum(a) OVER (ORDER BY y) AS ca, sum(b) OVER () AS nb, sum(a) OVER () AS na FROM v)
    SELECT round(max(abs(cb / nb - ca / na)), 6) AS ks FROM c""", "samples_v"))
def ks_distance(t):
    rows = t.samples
    return om.ks_distance(rows, rows.where("n_lines >= 3"), "y").select(_r("ks"))


@query("distribution_shift", oracle("""
    SELECT round(abs(avg(y) FILTER (n_lines >= 3) - avg(y)), 3) AS mean_shift,
           round(abs(stddev_pop(y) FILTER (n_lines >= 3) - stddev_pop(y)), 3) AS sd_shift FROM samples_v""", "samples_v"))
def distribution_shift(t):
    rows = t.samples
    return om.distribution_shift(rows, rows.where("n_lines >= 3"), "y").select(_r("mean_shift", 3), _r("sd_shift", 3))


@query("cosine_matrix_gap", """
    WITH v AS (SELECT vec_id AS id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c, embedding[4] AS d FROM embeddings),
    p AS (SELECT abs((x.a*y.a+x.b*y.b) / sqrt((x.a*x.a+x.b*x.b) * (y.a*y.a+y.b*y.b)) - (x.c*y.c+x.d*y.d) / sqrt((x.c*x.c+x.d*x.d) * (y.c*y.c+y.d*y.d))) AS g
          FROM (SELECT id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM v) x,
               (SELECT id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM v) y)
    SELECT round(avg(g), 6) AS mean_gap FROM p""")
def cosine_matrix_gap(t):
    rows = t.table("embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abcd")])
    return om.cosine_matrix_gap(rows, ["a", "b"], ["c", "d"], block=256).select(_r("mean_gap"))
