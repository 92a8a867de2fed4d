"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Short items inside long documents have a tiny Jaccard similarity, so the search is on containment:
the share of an item's 5-word shingles that a document holds. The shingles of an item are put in the
order of a random hash (its MinHash order). Items are partitioned by size, and all of a partition keep
as many leading shingles as its largest size u needs: floor((1 - threshold) * u) + 1. A document that
holds `threshold` of the item lacks at most floor((1 - threshold) * n) of its n <= u shingles and so
holds one of those kept. The search misses nothing. Documents that hit are verified with the exact count.

One pass over the documents finds all shingles that belong to any item. It broadcasts the item shingles
only while their counted number is small, and shuffles beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitable.session import broadcast_checked, cut_lineage

SHINGLE = 5
SIZE_STEP = 2  # upper bounds of the size partitions are powers of it


def words(text: Column) -> Column:
    """Words between spaces and 0x09-0x0D, A-Z folded; none of a null text."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(words_column: str) -> Column:
    """64-bit hashes of an item's runs of five words; one of the whole where there are fewer, none of nothing."""
    w = F.col(words_column)
    whole = F.array(F.xxhash64(F.concat_ws(" ", w), F.size(w)))
    return F.when(F.size(w) >= SHINGLE, _runs(w, SHINGLE)).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _runs(w: Column, length: int) -> Column:
    """Hashes of all runs of `length` words; those under SHINGLE words are hashed as a short item is."""
    if length == SHINGLE:
        one = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    else:
        one = lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i + 1, length)), F.lit(length))
    found = F.transform(F.sequence(F.lit(0), F.size(w) - length), one)
    return F.when(F.size(w) >= length, found).otherwise(F.array().cast("array<bigint>"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where the document holds at least `threshold` of the item.

    Rows that share a doc_id (or an item_id) count as one document (item) with all their shingles. Null
    ids, null or empty texts and empty tables give no row. An item of under five words is its whole sequence, found in
    documents of any length that hold these words in a row. Ids may be of any type that can be grouped.
    """
    parts = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w"))
    short = parts.filter(F.size("w").between(1, SHINGLE - 1)).select(F.size("w").alias("n")).distinct()
    lengths = sorted(r["n"] for r in short.collect())  # at most four numbers
    parts = parts.select("item_id", F.explode(shingle_hashes("w")).alias("s")).distinct()
    sized = parts.join(parts.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")
    upper = F.pow(F.lit(float(SIZE_STEP)), F.ceil(F.log(float(SIZE_STEP), F.col("n_item"))))
    kept = F.floor(F.lit(1 - threshold) * upper + 1e-9) + 1
    ranked = sized.select("item_id", "s", "n_item", kept.alias("kept"),
                          F.xxhash64(F.lit("order"), "s").alias("draw"))
    order = F.array_sort(F.collect_list(F.struct("draw", "s")))
    lead = ranked.groupBy("item_id", "kept").agg(order.alias("all"))
    lead = lead.select("item_id", F.explode(F.expr("slice(all, 1, cast(least(kept, size(all)) as int))")).alias("x"))
    lead = lead.select("item_id", F.col("x.s").alias("s"), F.lit(True).alias("leads"))
    index = cut_lineage(sized.join(lead, ["item_id", "s"], "left").select(
        "item_id", "s", "n_item", F.coalesce("leads", F.lit(False)).alias("leads")))

    probe = docs.filter("doc_id is not null").select("doc_id", words(F.col("text")).alias("w"))
    found = [_runs(F.col("w"), n) for n in [SHINGLE, *lengths]]
    probe = probe.select("doc_id", F.explode(F.concat(*found) if lengths else found[0]).alias("s"))
    hits = probe.join(broadcast_checked(index.select("s").distinct()), "s", "left_semi").distinct()
    hits = cut_lineage(hits)
    found = hits.join(broadcast_checked(index.filter("leads").select("item_id", "s")), "s").select("doc_id", "item_id").distinct()
    exact = found.join(index.select("item_id", "s", "n_item"), "item_id").join(hits, ["doc_id", "s"])
    exact = exact.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("n_item").alias("n_item"))
    return exact.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_item"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, n_items, worst_item, worst_share) of the documents that hold an item; ties go to the smaller id."""
    share = F.col("n_shared") / F.col("n_item")
    worst = F.min(F.struct((-share).alias("less"), "item_id")).alias("worst")
    out = contained_items(docs, items, threshold).groupBy("doc_id").agg(F.count("*").alias("n_items"), worst)
    return out.select("doc_id", "n_items", F.col("worst.item_id").alias("worst_item"), (-F.col("worst.less")).alias("worst_share"))


ORACLE = """
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'),
        lambda x: x <> '') AS w FROM documents),
b AS (
    SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'),
        lambda x: x <> '') AS w FROM benchmark),
ds AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
        FROM d JOIN (SELECT DISTINCT least(len(w), 5) AS n FROM b WHERE len(w) > 0) lengths ON len(w) >= n)),
bs AS (
    SELECT DISTINCT item_id, s FROM (
        SELECT item_id, unnest(CASE WHEN len(w) >= 5
            THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
hit AS (
    SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id),
full_hit AS (
    SELECT doc_id, item_id, n_shared / n_item AS share FROM hit JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item)
SELECT doc_id, count(*) AS n_items, max(share) AS worst_share,
       arg_min(item_id, struct_pack(a := -share, b := item_id)) AS worst_item
FROM full_hit GROUP BY doc_id
"""
