"""MinHash near-duplicates with SuperMinHash signatures, banding, full-set checks and components.

Every shingle draws one random permutation of the signature slots; its j-th value is j plus a random
fraction and goes to the j-th slot of the permutation. Ranks of one shingle are thus correlated
(no slot gets two of them), which lowers the variance, and a document stops as soon as no slot can
still be lowered. 32 bands of 4 slots bring documents of similarity 0.75 together with probability
1 - 5e-6. Equal sets form a class beforehand; classes that are connected through their bands form a candidate
group, and only links inside a group are searched:

1. Each class is confirmed against the smallest partner of its bands, on the full sets. Most of a group of
   copies is one component after this.
2. What is left are pairs of one group in different components. Groups are cut into blocks, a large component
   into blocks of its own, and each pair of blocks that are not both of one component is compared completely:
   sets become bit rows over the shingles that several of them hold, and intersections are counted bits.

Links inside one component need no check, so no link that matters is left out. Tasks emit one link per
pair of components, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.llm.arrays import U, binaries, chunks, document_sets, mix
from orbitable.llm.components import components
from orbitable.session import cut_lineage

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
BLOCK = 2048


def superminhash(values: np.ndarray, docs: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs x slots) of the sets given as (value, document) pairs."""
    low = np.full(n_docs * slots, ~U(0), U)
    active, perm = np.arange(len(values)), None
    for j in range(slots):
        if not len(active):
            break
        draw = mix(values[active] + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        slot = j + (((draw & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)
        if perm is not None:
            rows = np.arange(len(active))
            chosen = perm[rows, slot].copy()
            perm[rows, slot] = perm[:, j]
            perm[:, j] = chosen
            first, slot = slot, chosen.astype(np.int64)
        else:
            first = slot
        np.minimum.at(low, docs[active] * slots + slot, (U(j) << U(32)) | (draw >> U(32)))
        seen = np.unique(docs[active])
        open_docs = np.zeros(n_docs, bool)
        open_docs[seen] = low.reshape(n_docs, slots)[seen].max(axis=1) >= (U(j + 1) << U(32))
        stay = open_docs[docs[active]]
        active = active[stay]
        if perm is None:  # after the first step only documents with few shingles go on
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(active), 1))
            rows, first = np.arange(len(active)), first[stay]
            perm[rows, first], perm[:, 0] = 0, first
        else:
            perm = perm[stay]
    return low.reshape(n_docs, slots)


def _sign(batches):
    for batch in chunks(batches):
        n = batch.num_rows
        values, docs = document_sets(batch.column("text"))
        size = np.bincount(docs, minlength=n)
        digest = [np.zeros(n, U), np.zeros(n, U)]
        for k, out in enumerate(digest):
            np.add.at(out, docs, mix(values ^ U(k * 0x5851F42D4C957F2D + 0x14057B7EF767814F)))
        signature = superminhash(values, docs, n)
        key = np.zeros((n, BANDS), U)
        parts = signature.reshape(n, BANDS, ROWS)
        for r in range(ROWS):
            key = mix(key * U(0x9FB21C651E98DF25) + parts[:, :, r])
        key = mix(key + np.arange(1, BANDS + 1, dtype=U)[None, :] * U(0xD6E8FEB86659FD93))
        has = size > 0
        bounds = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest[0].view(np.int64)),
             pa.array(digest[1].view(np.int64)),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key[has].ravel().view(np.int64)))],
            names=["doc_id", "n", "d1", "d2", "bands"])


def _sets(batches):
    for batch in chunks(batches):
        values, docs = document_sets(batch.column("text"))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=batch.num_rows))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), binaries(values, bounds)], names=["doc_id", "items"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                at = np.searchsorted(b, a)
                both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def bit_rows(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits per set, over the values that at least two of the sets hold."""
    values = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    found, back, counts = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    kept = counts[back] > 1
    owner, place = owner[kept], place[back[kept]]
    rows = np.zeros((len(sets), (int((counts > 1).sum()) + 63) // 64), U)
    np.bitwise_or.at(rows.reshape(-1), owner * rows.shape[1] + place // 64, U(1) << (place % 64).astype(U))
    return rows


def _cross(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between two blocks of one group (or inside one), at most one per pair of components."""
        ids, comp, part = (table[c].to_numpy() for c in ("node", "comp", "part"))
        sets = [np.frombuffer(x, U) for x in table["items"].to_pylist()]
        size, rows = np.array([len(x) for x in sets]), bit_rows(sets)
        one, two = np.flatnonzero(part < 2), np.flatnonzero(part > 0)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in one:
            both = np.bitwise_count(rows[i][None, :] & rows[two]).sum(axis=1, dtype=np.int64)
            hit = two[(100 * both >= percent * (size[i] + size[two] - both)) & (comp[two] != comp[i])]
            a.append(np.full(len(hit), i))
            b.append(hit)
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], axis=1)
        _, first = np.unique(pair, axis=0, return_index=True)
        a, b = ids[a[first]], ids[b[first]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    full = pairs.join(a, "a").join(b, "b").select("a", "b", "items_a", "items_b")
    return cut_lineage(full.mapInArrow(_confirm(percent), "a long, b long"))


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """`members` with the component each node has so far."""
    known = comps.select("node", F.col("component").alias("comp"))
    return members.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`.

    Links join documents with 100 * intersection >= percent * union of their distinct 5-word
    shingle sets. Null, empty and word-less texts have an empty set and link with nothing. Rows that
    share a doc_id are one document; a null doc_id is linked with nothing, has no component and is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut_lineage(docs.mapInArrow(
        _sign, "doc_id long, n long, d1 long, d2 long, bands array<long>"))
    real = signed.filter("n > 0 and doc_id is not null")
    classes = cut_lineage(real.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")))
    same = real.select("doc_id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("doc_id", "rep")
    members = real.join(classes, ["d1", "d2", "n"]).filter("doc_id = rep").select(
        F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    members = cut_lineage(members)
    leaders = members.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last")
    pairs = members.join(leaders, "band").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = cut_lineage(pairs.distinct())
    groups = components(pairs).withColumnRenamed("component", "grp")
    # Merged at every size: which side is small depends on how much of the corpus is copied.
    grouped = docs.join(groups.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = cut_lineage(grouped.mapInArrow(_sets, "doc_id long, items binary"))

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _links(first, sets, percent)
    comps = components(links)

    placed = cut_lineage(_placed(groups, comps))
    mixed = placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("grp")
    units = placed.join(mixed, "grp", "left_semi")
    large = units.groupBy("grp", "comp").agg(F.count("*").alias("size")).filter(F.col("size") >= BLOCK).select("grp", "comp", F.col("comp").alias("own"))
    units = units.join(large, ["grp", "comp"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    sizes = units.groupBy("grp", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    units = units.join(sizes, ["grp", "own"]).select(
        "node", "comp", "grp", "own", F.xxhash64("grp", "own", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    units = cut_lineage(units)
    blocks = units.select("grp", "own", "block").distinct()
    other = blocks.select("grp", F.col("own").alias("own_j"), F.col("block").alias("j"))
    met = blocks.withColumnRenamed("block", "i").join(other, "grp").filter("i <= j and (own <> own_j or own = -1)").select("i", "j")
    met = cut_lineage(met)
    ends = met.select("i", "j", F.col("i").alias("block"), F.when(F.col("i") == F.col("j"), 1).otherwise(0).alias("part")).unionByName(
        met.filter("i < j").select("i", "j", F.col("j").alias("block"), F.lit(2).alias("part")))
    dealt = units.select("node", "comp", "block").join(sets.select(F.col("doc_id").alias("node"), "items"), "node").join(ends, "block")
    dealt = dealt.select("i", "j", "part", "node", "comp", "items")
    found = dealt.groupBy("i", "j").applyInArrow(_cross(percent), "a long, b long")
    comps = components(links.unionByName(cut_lineage(found)))

    whole = _placed(same.distinct().select("doc_id", F.col("rep").alias("node")), comps).select(
        "doc_id", F.col("comp").alias("component_id"))
    whole = whole.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(whole, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
    SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(node, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT node, b FROM reach JOIN link ON other = a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN comp ON node = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
