"""Walks over bonds: reachability, shortest and longest paths, six-rings, motifs.

Components and reachability contract whole blocks of bonds, so their rounds do not grow with the length of a walk.
The frontier loops, for hop counts, advance all molecules together, one shuffle join per step. In an undirected
graph the neighbours of level t lie in levels t-1, t, t+1, so a step only has to be compared with
the last two levels, not with everything visited. Each level is checkpointed: lineage stays short
and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitable.operators.bonds import base_roles, both_ways
from orbitable.session import broadcast_rows, cut_lineage

BLOCK = 1 << 12  # atom numbers whose bonds meet in one task
SMALL = 64  # atoms; walks from all of them stay a bounded amount of work per molecule
WALK_CELLS = 1 << 20  # numbers in the distance tables of the molecules that are walked at once


def _unseen(reached: DataFrame, seen: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Distinct reached rows that no seen level holds, in one aggregation instead of distinct + anti-join."""
    rows = reached.select(*key, F.lit(0).alias("_old"))
    for level in seen:
        rows = rows.unionByName(level.select(*key, F.lit(1).alias("_old")))
    return rows.groupBy(*key).agg(F.max("_old").alias("_old")).where("_old = 0").drop("_old")


def _forest(keys: Sequence[str], block: int):
    """Edges (keys, _blk, a, b) as stars (keys, a = lowest atom, b) of the components that the edges of an Arrow batch form.

    `_open` marks what may go on elsewhere: the first and last group of a batch, and groups that reach beyond the first block.
    """
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            change = np.zeros(len(batch), bool)
            change[0] = True
            for k in [*keys, "_blk"]:
                v = batch[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            group = np.cumsum(change) - 1
            ends = np.concatenate([batch["a"].to_numpy(), batch["b"].to_numpy()])
            nodes, at = np.unique(np.stack([np.tile(group, 2), ends]), axis=1, return_inverse=True)
            u, v = at.ravel()[: len(batch)], at.ravel()[len(batch):]
            label = np.arange(nodes.shape[1])
            while True:
                low = np.minimum(label[u], label[v])
                if (label[u] == label[v]).all():
                    break
                np.minimum.at(label, label[u], low)
                np.minimum.at(label, label[v], low)
                while (label[label] != label).any():
                    label = label[label]
            child = np.flatnonzero(label != np.arange(len(label)))
            found = batch[list(keys)].iloc[np.flatnonzero(change)[nodes[0, child]]]
            beyond = np.zeros(group[-1] + 1, bool)
            beyond[[0, -1]] = True
            np.logical_or.at(beyond, group, (batch["_blk"].to_numpy() != 0) | (batch["b"].to_numpy() >= block))
            yield found.assign(a=nodes[1, label[child]], b=nodes[1, child], _open=beyond[nodes[0, child]])
    return run


def _unsettled(stars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that hold an atom below two roots, or a root that hangs below another."""
    children = stars.groupBy(*keys, F.col("b").alias("atom")).agg(F.count("*").alias("n"))
    roots = stars.select(*keys, F.col("a").alias("atom"), F.lit(1).cast("long").alias("n")).distinct()
    twice = children.unionByName(roots).groupBy(*keys, "atom").agg(F.sum("n").alias("n")).where("n > 1")
    return twice.select(*keys).distinct()


def components(edges: DataFrame, keys: Sequence[str] = ("mol_id",), block: int = BLOCK) -> DataFrame:
    """Connected components of bonded atoms: keys, atom_idx, component (its lowest atom). `edges` has the keys, a and b.

    Edges meet in blocks of atom numbers, and every block is replaced by one star per component, which settles molecules
    of up to `block` atoms in one shuffle. What spans blocks or Arrow batches is contracted further: every atom passes its higher
    neighbours on to its lowest one, then its lower ones, so the number of rounds grows with the logarithm of the size.
    """
    keys = list(keys)
    ends = [*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    near = F.greatest(F.floor(F.col("a") / block), F.lit(0).cast("long"))
    dealt = edges.select(*ends).where("a < b").withColumn("_blk", near).repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk")
    types = dict(dealt.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "a", "b"])
    first = cut_lineage(dealt.mapInPandas(_forest(keys, block), f"{schema}, _open boolean"))
    stars, settled = first.drop("_open"), None
    while True:
        open_keys = cut_lineage(_unsettled(first.where("_open") if settled is None else stars, keys))
        if open_keys.isEmpty():
            break
        done = stars.join(open_keys, keys, "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        stars = stars.join(open_keys, keys, "left_semi")
        turn = F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        both = stars.select(*keys, turn)
        lowest = both.groupBy(*keys, "u").agg(F.min(F.least("u", "v")).alias("m"))
        stars = cut_lineage(both.join(lowest, [*keys, "u"]).where("v > u").select(*keys, F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        lowest = stars.groupBy(*keys, "b").agg(F.min("a").alias("m"))
        passed = stars.join(lowest, [*keys, "b"]).where("a <> m").select(*keys, F.col("m").alias("a"), F.col("a").alias("b"))
        stars = cut_lineage(passed.unionByName(lowest.select(*keys, F.col("m").alias("a"), "b")).distinct())
    stars = stars if settled is None else settled.unionByName(stars)
    roots = stars.select(*keys, F.col("a").alias("atom_idx"), F.col("a").alias("component")).distinct()
    return stars.select(*keys, F.col("b").alias("atom_idx"), F.col("a").alias("component")).unionByName(roots)


def _based(atoms: DataFrame, bases) -> DataFrame:
    """Molecules that have both atoms of a base: mol_id, spec_id, source, direction."""
    roles, on = base_roles(atoms.sparkSession, bases)
    return (
        atoms.select("mol_id", "atom_idx")
        .join(roles, on)
        .groupBy("mol_id", "spec_id", F.col("origin").alias("source"), "direction")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == 2)
        .drop("n")
    )


def reachable(atoms: DataFrame, bonds: DataFrame, bases) -> DataFrame:
    """Atoms on simple paths source -> direction -> ...: mol_id, spec_id, atom_idx.

    This is the source plus the component of the direction atom in the graph without the source.
    The pair (source, direction) need not be bonded. Molecules without both atoms drop out.
    `bases` is a list of (source, direction) or a table mol_id, spec_id, origin, direction.
    """
    keys = ["mol_id", "spec_id"]
    start = cut_lineage(_based(atoms, bases))
    edges = bonds.select("mol_id", "a", "b").join(start.drop("direction"), "mol_id").where("a <> source AND b <> source")
    found = components(edges.select(*keys, "a", "b"), keys)
    named = found.join(start.select(*keys, F.col("direction").alias("atom_idx")), [*keys, "atom_idx"], "left_semi")
    inside = found.join(named.select(*keys, "component"), [*keys, "component"], "left_semi").select(*keys, "atom_idx")
    ends = start.select(*keys, F.explode(F.array("source", "direction")).alias("atom_idx"))
    return inside.unionByName(ends).distinct()


def reachable_depths(atoms: DataFrame, bonds: DataFrame, bases) -> DataFrame:
    """As `reachable`, with the number of bonds from the source: mol_id, spec_id, atom_idx, depth. One round per bond."""
    start = _based(atoms, bases)
    keys = ["mol_id", "spec_id", "source"]
    zero = start.select(*keys, F.col("source").alias("atom_idx"), F.lit(0).alias("depth"))
    first = start.select(*keys, F.col("direction").alias("atom_idx"), F.lit(1).alias("depth"))
    steps = cut_lineage(both_ways(bonds))
    levels, previous, frontier = [zero, first], zero, cut_lineage(first)
    depth = 1
    while True:
        depth += 1
        reached = (
            frontier.join(steps, ["mol_id", "atom_idx"])
            .where(F.col("partner") != F.col("source"))
            .select(*keys, F.col("partner").alias("atom_idx"))
        )
        new = cut_lineage(_unseen(reached, [previous, frontier], [*keys, "atom_idx"]).withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        levels.append(new)
        previous, frontier = frontier, new
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("source")


def hop_distances(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """Hop counts from given sources (mol_id, source): mol_id, source, atom_idx, depth.

    `steps` is the bond table from both ends, stored. The result has a row per source and atom it
    reaches, so the caller keeps the sources few.
    """
    key = ["mol_id", "source", "atom_idx"]
    previous = None
    frontier = cut_lineage(sources.select("mol_id", "source", F.col("source").alias("atom_idx"), F.lit(0).alias("depth")))
    levels, depth = [frontier], 0
    while True:
        depth += 1
        reached = frontier.join(steps, ["mol_id", "atom_idx"]).select("mol_id", "source", F.col("partner").alias("atom_idx"))
        seen = [frontier] if previous is None else [frontier, previous]
        new = cut_lineage(_unseen(reached, seen, key).withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        levels.append(new)
        previous, frontier = frontier, new
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _far_sources(steps: DataFrame) -> DataFrame:
    """Atoms one of which ends every longest shortest path of each component: mol_id, source.

    Two sweeps give a long path a..b of length L; u is its middle. Two atoms nearer than L / 2 to u are
    less than L apart, so every path of length L or more ends in an atom at least L / 2 from u. Those
    are enough, also for ties, and in molecule-like graphs they are few.
    """
    def ends(hops: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("depth")).alias("d"), F.col("atom_idx").alias("end")))
        return hops.groupBy("mol_id", "source").agg(best.alias("b")).select(
            "mol_id", "source", F.col("b.end").alias("end"), (-F.col("b.d")).alias("length"))

    first = cut_lineage(ends(hop_distances(steps, components(steps.select("mol_id", F.col("atom_idx").alias("a"), F.col("partner").alias("b"))).select("mol_id", F.col("component").alias("source")).distinct())))
    from_a = hop_distances(steps, first.select("mol_id", F.col("end").alias("source")))
    second = cut_lineage(ends(from_a))
    from_b = hop_distances(steps, second.select("mol_id", F.col("end").alias("source")))
    both = from_a.select("mol_id", F.col("source").alias("a"), "atom_idx", F.col("depth").alias("da")).join(
        from_b.select("mol_id", "atom_idx", F.col("depth").alias("db")), ["mol_id", "atom_idx"])
    middle = both.groupBy("mol_id", "a").agg(
        F.min(F.struct(F.greatest("da", "db").alias("r"), F.col("atom_idx").alias("u"))).alias("m")
    ).join(second.select("mol_id", F.col("source").alias("a"), "length"), ["mol_id", "a"])
    middle = cut_lineage(middle.select("mol_id", "a", "length", F.col("m.u").alias("source")))
    levels = hop_distances(steps, middle.select("mol_id", "source"))
    outer = levels.join(middle, ["mol_id", "source"]).where(2 * F.col("depth") >= F.col("length")).select("mol_id", F.col("atom_idx").alias("source"))
    return outer.unionByName(middle.select("mol_id", F.col("a").alias("source"))).distinct()


def graph_diameters(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Longest shortest path per molecule: mol_id, diameter and an end pair.

    In molecules of at most SMALL atoms walks start at every atom, all of them in the task that gathers the molecule; in larger ones
    they start only at the atoms one of which ends every longest path, so all of them are met either way. The lowest end pair is reported.
    """
    # Atoms count as ends (i, i); `loose` says that an atom has no number.
    marks = atoms.select("mol_id", F.lit(1).alias("atoms"), F.lit(0).alias("bonds"), F.col("atom_idx").isNull().alias("loose")).unionByName(
        bonds.select("mol_id", F.lit(0).alias("atoms"), F.lit(1).alias("bonds"), F.lit(False).alias("loose")))
    sizes = marks.where("mol_id IS NOT NULL").groupBy("mol_id").agg(F.sum("atoms").alias("atoms"), F.sum("bonds").alias("bonds"), F.max("loose").alias("loose"))
    large = cut_lineage(sizes.where((F.col("atoms") > SMALL) | (F.col("bonds") > SMALL * SMALL) | F.col("loose")).select("mol_id"))
    if large.isEmpty():
        return _small_diameters(bonds, atoms)
    small = _small_diameters(bonds.join(large, "mol_id", "left_anti"), atoms.join(large, "mol_id", "left_anti"))
    big = _large_diameters(bonds.join(large, "mol_id", "left_semi"), atoms.join(large, "mol_id", "left_semi"))
    return small.unionByName(big.select(*[F.col(c).cast(t).alias(c) for c, t in small.dtypes]))


def _longest(batches):
    """Diameter and lowest end pair of molecules, from their bonds and atoms (i, i); molecules of like size are walked together."""
    for batch in batches:
        ends = batch.column("ends")
        a, b = (c.to_numpy(zero_copy_only=False) for c in ends.flatten().flatten())
        row = np.repeat(np.arange(len(batch)), ends.value_lengths().to_numpy(zero_copy_only=False))
        # Number the atoms of every molecule in order.
        rows, ids = np.tile(row, 2), np.concatenate([a, b])
        order = np.lexsort((ids, rows))
        rows, ids = rows[order], ids[order]
        new = np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        rows, ids = rows[new], ids[new]
        count = np.bincount(rows, minlength=len(batch))
        start = np.cumsum(count) - count
        u, v = place[: len(a)] - start[row], place[len(a):] - start[row]
        found = {c: np.zeros(len(batch), np.int64) for c in ("diameter", "first", "last")}
        size = 1 << np.ceil(np.log2(np.maximum(count, 1))).astype(int)
        for n in np.unique(size).tolist():
            here = np.flatnonzero(size == n)
            step = max(1, WALK_CELLS // (n * n))
            for at in range(0, len(here), step):
                some = here[at: at + step]
                slot = np.full(len(batch), -1)
                slot[some] = np.arange(len(some))
                mine = slot[row] >= 0
                s, x, y = slot[row[mine]], u[mine], v[mine]
                near = np.zeros((len(some), n, n), np.float32)
                near[s, x, y] = near[s, y, x] = 1
                front = np.zeros((len(some), n, n), bool)  # from the atoms of the molecule; bonds may name others
                own = x == y
                front[s[own], x[own], x[own]] = True
                depth, level = np.where(front, 0, -1), 0
                while front.any():
                    level += 1
                    front = (np.matmul(front.astype(np.float32), near) > 0) & (depth < 0)
                    depth[front] = level
                best = depth.max(axis=(1, 2))
                top = depth == best[:, None, None]
                flat = np.triu(top | top.transpose(0, 2, 1)).reshape(len(some), -1).argmax(axis=1)
                found["diameter"][some] = best
                found["first"][some], found["last"][some] = ids[start[some] + flat // n], ids[start[some] + flat % n]
        yield pa.RecordBatch.from_arrays([batch.column("mol_id"), *[pa.array(found[c]) for c in found]], names=["mol_id", *found])


def _small_diameters(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Diameters of molecules that a task can gather."""
    number = atoms.select("atom_idx").union(bonds.select("a")).union(bonds.select("b")).dtypes[0][1]
    end = lambda p, q: F.struct(F.col(p).cast("long").alias("a"), F.col(q).cast("long").alias("b")).alias("end")
    ends = atoms.select("mol_id", end("atom_idx", "atom_idx")).unionByName(bonds.where("a <> b").select("mol_id", end("a", "b")))
    # A molecule needs an atom; bonds alone give no row.
    whole = ends.where("mol_id IS NOT NULL").groupBy("mol_id").agg(F.collect_set("end").alias("ends")).where(F.exists("ends", lambda e: e["a"] == e["b"]))
    kind = dict(whole.dtypes)["mol_id"]
    walked = whole.mapInArrow(_longest, f"mol_id {kind}, diameter long, first long, last long")
    return walked.select("mol_id", F.col("diameter").cast("int").alias("diameter"), F.col("first").cast(number).alias("first"), F.col("last").cast(number).alias("last"))


def _large_diameters(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Diameters of molecules of any size, all walks advancing together."""
    steps = cut_lineage(both_ways(bonds))
    sizes = cut_lineage(atoms.groupBy("mol_id").agg(F.count("*").alias("n")))
    small, large = sizes.where(F.col("n") <= SMALL), sizes.where(F.col("n") > SMALL)
    sources = atoms.join(small, "mol_id", "left_semi").select("mol_id", F.col("atom_idx").alias("source"))
    if not large.isEmpty():
        far = _far_sources(cut_lineage(steps.join(large, "mol_id", "left_semi")))
        alone = atoms.join(large, "mol_id", "left_semi").groupBy("mol_id").agg(F.min("atom_idx").alias("source"))
        sources = sources.unionByName(far.unionByName(alone).distinct())
    hops = hop_distances(steps, sources)
    low, high = F.least("source", "atom_idx"), F.greatest("source", "atom_idx")
    best = F.min(F.struct((-F.col("depth")).alias("d"), low.alias("s"), high.alias("t")))
    return hops.groupBy("mol_id").agg(best.alias("best")).select(
        "mol_id", (-F.col("best.d")).alias("diameter"), F.col("best.s").alias("first"), F.col("best.t").alias("last")
    )


def longest_paths(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms along a longest shortest path, from its lower end: mol_id, position, atom_idx.

    A breadth-first walk from the lower end notes the lowest parent of every atom; the path is read
    back from the upper end.
    """
    ends = cut_lineage(graph_diameters(bonds, atoms))
    steps = cut_lineage(both_ways(bonds))
    level = ends.select("mol_id", F.col("first").alias("atom_idx"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("depth"))
    levels, previous, depth = [level], None, 0
    while True:
        depth += 1
        seen = level.select("mol_id", "atom_idx")
        seen = seen if previous is None else seen.unionByName(previous.select("mol_id", "atom_idx"))
        new = cut_lineage(
            level.select("mol_id", "atom_idx").join(steps, ["mol_id", "atom_idx"])
            .groupBy("mol_id", F.col("partner").alias("_next")).agg(F.min("atom_idx").alias("parent"))
            .withColumnRenamed("_next", "atom_idx")
            .join(seen, ["mol_id", "atom_idx"], "left_anti")
            .select("mol_id", "atom_idx", "parent", F.lit(depth).alias("depth"))
        )
        if new.isEmpty():
            break
        levels.append(new)
        previous, level = level, new
    at = ends.select("mol_id", F.col("last").alias("atom_idx"), F.col("diameter").alias("position"))
    path = at.where("position = 0")
    for d in range(len(levels) - 1, 0, -1):
        # Paths of length d start here; longer ones arrive from the level above.
        here = at.where(F.col("position") == d)
        if d < len(levels) - 1:
            here = here.unionByName(came)  # noqa: F821
        here = cut_lineage(here)
        path = path.unionByName(here)
        came = here.join(levels[d].drop("depth"), ["mol_id", "atom_idx"]).select(
            "mol_id", F.col("parent").alias("atom_idx"), F.lit(d - 1).alias("position")
        )
    return path.unionByName(came) if len(levels) > 1 else path


def six_rings(bonds: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """The six-membered ring through each seed atom: mol_id, seed, r0..r5 in ring order.

    Of several rings the one with the smallest (r1, r2, r3, r4, r5) is kept, r1 < r5. Three-bond
    walks leave the seed on both sides and meet at the opposite atom.
    """
    rows = [(int(s),) for s in seeds]
    seed = broadcast_rows(bonds.sparkSession.createDataFrame(rows, "atom_idx int"), len(rows))
    step = cut_lineage(both_ways(bonds))
    hop = lambda at, to: step.select("mol_id", F.col("atom_idx").alias(at), F.col("partner").alias(to))
    half = (
        step.join(seed, "atom_idx")
        .select("mol_id", F.col("atom_idx").alias("r0"), F.col("partner").alias("p"))
        .join(hop("p", "q"), ["mol_id", "p"])
        .where(F.col("q") != F.col("r0"))
        .join(hop("q", "r3"), ["mol_id", "q"])
        .where((F.col("r3") != F.col("r0")) & (F.col("r3") != F.col("p")))
    )
    left = half.select("mol_id", "r0", "r3", F.col("p").alias("r1"), F.col("q").alias("r2"))
    right = half.select("mol_id", "r0", "r3", F.col("p").alias("r5"), F.col("q").alias("r4"))
    ring = ["r1", "r2", "r3", "r4", "r5"]
    return (
        left.join(right, ["mol_id", "r0", "r3"])
        .where(F.col("r1") < F.col("r5"))
        .where((F.col("r2") != F.col("r4")) & (F.col("r1") != F.col("r4")) & (F.col("r2") != F.col("r5")))
        .groupBy("mol_id", "r0")
        .agg(F.min(F.struct(*ring)).alias("ring"))
        .select("mol_id", F.col("r0").alias("seed"), "r0", *[f"ring.{r}" for r in ring])
    )


def opposite_pairs(rings: DataFrame) -> DataFrame:
    """Ring as three pairs (r3, r0), (r1, r5), (r2, r4): mol_id, seed, pair_no, a, b."""
    pairs = [("r3", "r0"), ("r1", "r5"), ("r2", "r4")]
    packed = F.array(*[F.struct(F.lit(i).alias("pair_no"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(pairs, 1)])
    return rings.select("mol_id", "seed", F.explode(packed).alias("p")).select("mol_id", "seed", "p.*")


def match_motif(
    atoms: DataFrame, bonds: DataFrame, elements: Sequence[str], edges: Sequence[tuple[int, int]], induced: bool = True
) -> DataFrame:
    """Lowest embedding of a small connected pattern per molecule: mol_id, m1..mk.

    `elements[i]` is the element of pattern atom i + 1 and `edges` lists 1-based pattern bonds,
    ordered so that each bond touches an atom already placed. Each tree edge is one join with the
    bonds; further edges are semi-joins; with `induced`, non-edges are anti-joins.
    """
    step = cut_lineage(both_ways(bonds))
    named = atoms.select("mol_id", "atom_idx", "element")
    out = named.where(F.col("element") == elements[0]).select("mol_id", F.col("atom_idx").alias("m1"))
    placed, used = {1}, set()
    for i, j in edges:
        used.add((min(i, j), max(i, j)))
        if i in placed and j in placed:
            link = step.select("mol_id", F.col("atom_idx").alias(f"m{i}"), F.col("partner").alias(f"m{j}"))
            out = out.join(link, ["mol_id", f"m{i}", f"m{j}"], "left_semi")
            continue
        if j in placed:
            i, j = j, i
        grow = step.join(named.where(F.col("element") == elements[j - 1]).withColumnRenamed("atom_idx", "partner"), ["mol_id", "partner"])
        grow = grow.select("mol_id", F.col("atom_idx").alias(f"m{i}"), F.col("partner").alias(f"m{j}"))
        out = out.join(grow, ["mol_id", f"m{i}"])
        for k in placed:
            out = out.where(F.col(f"m{k}") != F.col(f"m{j}"))
        placed.add(j)
    k = len(elements)
    if induced:
        for i in range(1, k + 1):
            for j in range(i + 1, k + 1):
                if (i, j) not in used:
                    link = step.select("mol_id", F.col("atom_idx").alias(f"m{i}"), F.col("partner").alias(f"m{j}"))
                    out = out.join(link, ["mol_id", f"m{i}", f"m{j}"], "left_anti")
    names = [f"m{i}" for i in range(1, k + 1)]
    return out.groupBy("mol_id").agg(F.min(F.struct(*names)).alias("m")).select("mol_id", *[f"m.{n}" for n in names])


def reorder_by_motif(atoms: DataFrame, embedding: DataFrame, size: int) -> DataFrame:
    """Atoms of the matched motif, numbered in pattern order: mol_id, atom_idx, element, x, y, z."""
    pairs = F.array(*[F.struct(F.lit(i).alias("new"), F.col(f"m{i}").alias("old")) for i in range(1, size + 1)])
    mapping = embedding.select("mol_id", F.explode(pairs).alias("p")).select("mol_id", "p.new", F.col("p.old").alias("atom_idx"))
    return atoms.join(mapping, ["mol_id", "atom_idx"]).select("mol_id", F.col("new").alias("atom_idx"), "element", "x", "y", "z")
