"""Folds, samples and similarity sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitable.operators.ranking import hash_buckets, hash_order, join_null_safe, numbered, value_buckets
from orbitable.session import broadcast_checked, cut_lineage

ROUND = 256


def _order(df: DataFrame, key: str, seed: int | None) -> tuple[DataFrame, list, Column]:
    """Order column and buckets: a seeded hash of the key, or the key itself when seed is None."""
    if seed is None:
        return df.withColumn("_o", F.col(key)), ["_o"], value_buckets(df, key)
    hashed = df.withColumn("_o", hash_order(F.col(key), seed=seed))
    return hashed, ["_o", key], hash_buckets(df, "_o")


def k_folds(df: DataFrame, k: int, key: str = "id", seed: int | None = 42, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 per row; sizes differ by at most one."""
    rows, order, bucket = _order(df, key, seed)
    out = numbered(rows, [], order, bucket, "_r")
    return out.withColumn(name, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r", "_o")


def repeated_folds(df: DataFrame, k: int, repeats: int, key: str = "id", seed: int | None = 42) -> tuple[DataFrame, list[str]]:
    """One fold column per repeat, seeded seed + repeat, and their names.

    Each step is stored: a fold needs its rows twice (bucket sizes and ranks), so a chain of steps would double the work each time.
    """
    return folds_of_ranks(repeated_ranks(df, repeats, key, seed), k, repeats)


def repeated_ranks(df: DataFrame, repeats: int, key: str = "id", seed: int | None = 42) -> DataFrame:
    """Rows with _rank<r>, their place from 1 in the order of repeat r, stored step by step."""
    for r in range(repeats):
        rows, order, bucket = _order(df, key, None if seed is None else seed + r)
        df = cut_lineage(numbered(rows, [], order, bucket, f"_rank{r}").drop("_o"))
    return df


def folds_of_ranks(ranked: DataFrame, k: int, repeats: int) -> tuple[DataFrame, list[str]]:
    """Rows of repeated_ranks with a fold column per repeat instead of the ranks, and their names."""
    names = [f"_fold{r}" for r in range(repeats)]
    folds = [F.pmod(F.col(f"_rank{r}") - 1, F.lit(k)).cast("int").alias(name) for r, name in enumerate(names)]
    return ranked.select(*[c for c in ranked.columns if c not in {f"_rank{r}" for r in range(repeats)}], *folds), names


def fold_count(n_rows: int, k: int) -> int:
    """k, but at most half the rows and at least two."""
    return min(max(2, n_rows // 2), k)


def stratified_folds(
    df: DataFrame, k: int, group: str = "y", key: str = "id", seed: int | None = 42, name: str = "fold"
) -> DataFrame:
    """As k_folds inside each class; k is at most the smallest class and at least two."""
    k = max(2, min(k, smallest_class(df, group)))
    rows, order, bucket = _order(df, key, seed)
    out = numbered(rows, [group], order, bucket, "_r")
    return out.withColumn(name, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r", "_o")


def folds_no_empty(df: DataFrame, k: int, key: str = "id", seed: int = 42, name: str = "fold") -> DataFrame:
    """Random folds 1..k: the first k rows of the hash order seed the folds, the rest are uniform."""
    rows, order, bucket = _order(df, key, seed)
    out = numbered(rows, [], order, bucket, "_r")
    drawn = F.pmod(hash_order(F.col(key), seed=seed + 1), F.lit(k)) + 1
    fold = F.when(F.col("_r") <= k, F.col("_r")).otherwise(drawn)
    return out.withColumn(name, fold.cast("int")).drop("_r", "_o")


def weighted_draw(df: DataFrame, n: int, weight: str | None = None, key: str = "id", seed: int = 42) -> DataFrame:
    """n rows without replacement, with probability proportional to `weight` (exponential keys)."""
    u = (F.pmod(hash_order(F.col(key), seed=seed), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    p = F.col(weight) if weight else F.lit(1.0)
    # Ranked in buckets of the key, so no task sorts or holds the draw.
    keyed = df.where(p > 0).withColumn("_k", F.try_divide(-F.log(u), p))
    return numbered(keyed, [], ["_k", key], value_buckets(keyed, "_k"), "_r").where(F.col("_r") <= n).drop("_k", "_r")


def draw_with_replacement(df: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """n uniform draws with replacement; a row drawn twice appears twice, with its draw number."""
    total = df.count()
    rows, order, bucket = _order(df, key, seed)
    ranked = numbered(rows, [], order, bucket, "_r").drop("_o")
    draws = df.sparkSession.range(1, n + 1).select(
        F.col("id").alias("draw"), (F.pmod(hash_order(F.col("id"), seed=seed + 1), F.lit(total)) + 1).alias("_r")
    )
    return draws.join(ranked, "_r").drop("_r")


def class_sizes(df: DataFrame, group: str = "y") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))


def smallest_class(df: DataFrame, group: str = "y") -> int:
    return class_sizes(df, group).agg(F.min("n")).first()[0]


def stratified_sample(
    df: DataFrame, group: str, size: int | float | dict, key: str = "id", seed: int | None = 42
) -> DataFrame:
    """Per group: an absolute size, a share below 1 (at least one row) or a size per group."""
    rows, order, bucket = _order(df, key, seed)
    ranked = numbered(rows, [group], order, bucket, "_r")
    sizes = broadcast_checked(class_sizes(df, group))
    if isinstance(size, dict):
        want = F.create_map(*[F.lit(x) for item in size.items() for x in item])
        target = F.coalesce(F.try_element_at(want, F.col(group)), F.lit(0))
    elif isinstance(size, float) and size < 1:
        target = F.greatest(F.lit(1), F.floor(F.lit(size) * F.col("n")))
    else:
        target = F.least(F.lit(int(size)), F.col("n"))
    return join_null_safe(ranked, sizes, [group]).where(F.col("_r") <= target).drop("_r", "_o", "n")


def centroid_similarity(
    df: DataFrame, features: Sequence[str], group: str = "y", compare_with="self", key: str = "id"
) -> DataFrame:
    """Cosine of each z-scored row with its own (or one named) class centroid: key, group, similarity.

    Missing values take the column mean; constant columns are left out; 0 when a norm is 0. The
    centroid table has one row per class and is broadcast after a size check.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(F.coalesce(F.col(c), F.lit(None))).alias(f"s{i}") for i, c in enumerate(features)],
        *[F.count(c).alias(f"c{i}") for i, c in enumerate(features)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    usable = [i for i in range(len(features)) if stats[f"s{i}"]]
    if not usable:
        raise ValueError("no usable numeric feature")
    # Filling with the mean adds no spread, so the sd over all rows shrinks by the share present.
    sd = {i: stats[f"s{i}"] * (stats[f"c{i}"] / stats["n"]) ** 0.5 for i in usable}
    scaled = df.select(
        key, group, *[((F.coalesce(F.col(features[i]), F.lit(stats[f"m{i}"])) - stats[f"m{i}"]) / sd[i]).alias(f"z{i}") for i in usable]
    )
    centre = scaled.groupBy(group).agg(*[F.avg(f"z{i}").alias(f"c{i}") for i in usable])
    if compare_with != "self":
        row = centre.where(F.col(group) == compare_with).first()
        if row is None:
            raise KeyError(f"no class {compare_with!r}")
        joined = scaled.withColumns({f"c{i}": F.lit(row[f"c{i}"]) for i in usable})
    else:
        joined = scaled.join(broadcast_checked(centre), group)
    total = lambda f: sum((f(i) for i in usable), F.lit(0.0))
    dot = total(lambda i: F.col(f"z{i}") * F.col(f"c{i}"))
    zz = total(lambda i: F.col(f"z{i}") * F.col(f"z{i}"))
    cc = total(lambda i: F.col(f"c{i}") * F.col(f"c{i}"))
    return joined.select(key, group, F.coalesce(F.try_divide(dot, F.sqrt(zz) * F.sqrt(cc)), F.lit(0.0)).alias("similarity"))


def similarity_sample(
    df: DataFrame, features: Sequence[str], label, size: int, group: str = "y", compare_with="self", key: str = "id"
) -> DataFrame:
    """Rows of class `label` with status kept or dropped: key, similarity, status.

    `size` evenly spaced similarity targets from the lowest to the highest; each target in turn
    takes the nearest unused row, the lower key on ties. Targets are handled `ROUND` at a time. In a
    round at most ROUND - 1 unused rows get taken before a target's turn, so its row is among the
    ROUND unused rows on either side of it: only those, a bounded list, reach the driver.
    """
    sims = cut_lineage(
        centroid_similarity(df, features, group, compare_with, key).where(F.col(group) == label).select(key, "similarity")
    )
    low, high, n = sims.agg(F.min("similarity"), F.max("similarity"), F.count("*")).first()
    if not n:
        raise ValueError(f"no rows of class {label!r}")
    if size >= n:
        return sims.select(key, "similarity", F.lit("kept").alias("status"))
    step = (high - low) / (size - 1) if size > 1 else 0.0
    kind = dict(df.dtypes)[key]
    unused, parts = sims, []
    for start in range(0, size, ROUND):
        targets = [low + step * i for i in range(start, min(size, start + ROUND))]
        taken = _take_round(unused, targets, step, key)
        kept = df.sparkSession.createDataFrame([(k,) for k in taken], f"`{key}` {kind}")
        parts.append(kept)
        if start + ROUND < size:
            unused = cut_lineage(unused.join(F.broadcast(kept), key, "left_anti"))  # at most ROUND rows
    marks = parts[0]
    for part in parts[1:]:
        marks = marks.unionByName(part)
    status = F.when(F.col("_kept"), "kept").otherwise("dropped")
    return sims.join(marks.withColumn("_kept", F.lit(True)), key, "left").select(key, "similarity", status.alias("status"))


def _take_round(unused: DataFrame, targets: list[float], step: float, key: str) -> list:
    """Rows taken by one round of targets, in turn."""
    ranked = numbered(unused, [], ["similarity", key], value_buckets(unused, "similarity"), "pos")
    m = len(targets)
    # How many unused rows lie below each target, from one small aggregate; a row that floating
    # point puts into the neighbouring slot moves a position by its slot only, so spans are padded.
    slot = F.floor((F.col("similarity") - targets[0]) / step) if step else F.lit(0)
    counts = {r["slot"]: r["n"] for r in unused.groupBy(
        F.greatest(F.lit(-1), F.least(F.lit(m), slot)).alias("slot")).agg(F.count("*").alias("n")).collect()}
    spans, below = [], counts.get(-1, 0)
    for i in range(m):
        around = counts.get(i - 1, 0) if i else 0
        spans.append((below - m - 2 - min(around, 1), below + m + 2 + min(counts.get(i, 0), 1)))
        below += counts.get(i, 0)
    near = F.lit(False)
    for a, b in _merge(spans):
        near = near | F.col("pos").between(a, b)
    rows = [(r["pos"], r["similarity"], r[key]) for r in ranked.where(near).collect()]
    return _take_nearest(rows, targets)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _take_nearest(rows: list[tuple], targets: list[float]) -> list:
    left, taken = {r[2]: r for r in rows}, []
    for t in targets:
        best = min(left.values(), key=lambda r: (abs(r[1] - t), r[2]))
        taken.append(best[2])
        del left[best[2]]
    return taken


def sample_status(df: DataFrame, sampled: DataFrame, label, group: str = "y", key: str = "id") -> DataFrame:
    """Every row with status kept, dropped or other."""
    marks = sampled.select(key, F.col("status").alias("_s"))
    status = F.when(F.col(group) == label, F.coalesce("_s", F.lit("dropped"))).otherwise("other")
    return df.join(marks, key, "left").withColumn("status", status).drop("_s")


def true_class_rank(probabilities: DataFrame, classes: Sequence, key: str = "id") -> DataFrame:
    """Rank (ties share the best) of the true class by probability, with its colour.

    probabilities: key, y, p_<class> columns. The rank is one plus the number of larger
    probabilities in the same row, so no shuffle is needed.
    """
    own = F.lit(None).cast("double")
    for c in classes:
        own = F.when(F.col("y") == c, F.col(f"p_{c}")).otherwise(own)
    larger = sum(((F.col(f"p_{c}") > F.col("_own")).cast("int") for c in classes), F.lit(0))
    rank = F.when(F.col("_own").isNotNull(), larger + 1)
    colour = F.when(F.col("rank") == 1, "green").when(F.col("rank") == 2, "yellow").when(F.col("rank") == 3, "red").otherwise("gray")
    return probabilities.withColumn("_own", own).withColumn("rank", rank).withColumn("colour", colour).drop("_own")
