"""Embedding near-dedup by product quantisation.

Vectors of one label and dimension are compared as unit vectors; cosine >= threshold is a distance of at
most t = sqrt(2 - 2 * threshold). Equal vectors are one class beforehand.

*Index.* Coarse lists and the codes of residual subspaces are fitted on SAMPLE classes (chosen by a hash),
but every class is put in its nearest list and coded, with its exact coding error.
*Probes.* A vector in another list than a query lies beyond the plane halfway between the two centres, so a list is
probed unless that plane is farther than t from the query. These probes are sufficient: no link is lost.
A list none of whose vectors reaches within t of the query is left out too.
*Search.* Lists are packed, by size, into cells of one label that a task can hold. A vector goes to its own cell once, and as a query
once to every cell that holds a list it probes; of two cells only one asks the other. So copies follow the cells of a label, not its lists.
A task holds a cell and streams its queries past it, list by list: table lookups give the distance
to the coded vector; less the coding error it is a lower bound, and what it leaves is reranked by the
exact cosine in doubles. Tasks emit link counts and a spanning star per connected piece, never all pairs.
Vectors of single precision are stored and sent as such; equal ones are recognised by the SHA-256 of their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from orbitable.llm.arrays import binaries
from orbitable.llm.components import components
from orbitable.session import broadcast_rows, cut_lineage

SAMPLE = 20_000
LIST_ROWS = 4096
MOST_LISTS = 1024
CODES = 64
SUBSPACE = 8
BLOCK_ROWS = 2048  # least members of a cell
CELL_BYTES = 16 << 20  # unit vectors of a cell
TURN_CELLS = 8  # other cells, half of which ask, whose queries one task takes
MOST_TASKS = 20_000
SLACK = 1e-6


@dataclass
class Index:
    """Coarse centres (lists x width) and codes (subspaces x CODES x SUBSPACE); width is padded to whole subspaces.

    `single` says that vectors come as bytes of single precision.
    """

    centres: np.ndarray
    codes: np.ndarray
    single: bool

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    @cached_property
    def square(self) -> np.ndarray:
        return (self.centres ** 2).sum(axis=1)

    @cached_property
    def gaps(self) -> np.ndarray:
        """Distances between centres."""
        return np.sqrt(np.maximum(self.square[:, None] + self.square[None, :] - 2 * self.centres @ self.centres.T, 0))

    def probes(self, units: np.ndarray, reach: float) -> np.ndarray:
        """Distance of every unit vector from every centre; infinite where the plane halfway to its list is beyond reach."""
        away = self.square[None, :] - 2 * units @ self.centres.T
        home = away.argmin(axis=1)
        beyond = away - away[np.arange(len(units)), home][:, None]
        return np.where(beyond <= 2 * self.gaps[home] * (reach + SLACK) + SLACK, np.sqrt(np.maximum(away + 1, 0)), np.inf)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        part = rows[at: at + 4096]
        out[at: at + 4096] = ((centres ** 2).sum(axis=1)[None, :] - 2 * part @ centres.T).argmin(axis=1)
    return out


def _kmeans(rows: np.ndarray, k: int, rng, passes: int = 8) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(passes):
        near = _nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centres


def fit(sample: np.ndarray, lists: int, single: bool, seed: int = 5) -> Index:
    """Index from unit vectors (rows of one width that is a multiple of SUBSPACE)."""
    rng = np.random.default_rng(seed)
    centres = _kmeans(sample, lists, rng)
    rest = sample - centres[_nearest(sample, centres)]
    codes = np.zeros((sample.shape[1] // SUBSPACE, CODES, SUBSPACE))
    for s in range(len(codes)):
        found = _kmeans(rest[:, s * SUBSPACE: (s + 1) * SUBSPACE], CODES, rng)
        codes[s] = np.resize(found, codes[s].shape) if len(found) < CODES else found
        codes[s, : len(found)] = found
        codes[s, len(found):] = found[0]
    return Index(centres, codes, single)


def _units(raw: pa.ChunkedArray | pa.Array, width: int, single: bool) -> np.ndarray:
    """Unit vectors in doubles from the bytes of vectors, padded with zeros."""
    raw, kind = raw.to_pylist(), np.dtype(np.float32 if single else np.float64)
    flat = np.frombuffer(b"".join(raw), kind)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize
    row = np.repeat(np.arange(len(raw)), size)
    out = np.zeros((len(raw), width))
    out[row, np.arange(len(flat)) - (np.cumsum(size) - size)[row]] = flat
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)
    return out / np.sqrt((out ** 2).sum(axis=1, keepdims=True))


def _pack(single: bool):
    """Vectors as bytes of numbers, with whether they are usable."""
    kind = np.float32 if single else np.float64

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no null: NaN; no -0
            ends = np.concatenate([[0], np.cumsum(size)])
            among = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[ends])  # noqa: B023, E731
            fine = (among(~np.isfinite(values)) == 0) & (among(values != 0) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), binaries(values, ends), pa.array(fine)],
                                             names=["vec_id", "label", "raw", "fine"])
    return run


def _place(index: Index):
    """List, distance from its centre, codes and coding error of every class."""
    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                units = _units(batch.column("raw"), index.width, index.single)
                away = index.square[None, :] - 2 * units @ index.centres.T
                home = away.argmin(axis=1)
                rest = units - index.centres[home]
                codes, error = np.zeros((len(units), len(index.codes)), np.uint8), np.zeros(len(units))
                for s, book in enumerate(index.codes):
                    part = rest[:, s * SUBSPACE: (s + 1) * SUBSPACE]
                    codes[:, s] = _nearest(part, book)
                    error += ((part - book[codes[:, s]]) ** 2).sum(axis=1)
                own = np.sqrt(np.maximum(away[np.arange(len(units)), home] + 1, 0))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("node", "label", "dim", "size", "raw")], pa.array(home, pa.int32()), pa.array(own),
                     binaries(codes.ravel(), np.arange(len(units) + 1) * codes.shape[1]), pa.array(np.sqrt(error))],
                    names=["node", "label", "dim", "size", "raw", "home", "own", "codes", "error"])
    return run


def _ask(index: Index, reach: float):
    """Adds the distances from all centres, infinite where a list need not be probed; rounded to single precision, never up."""
    def run(batches):
        lists = len(index.centres)
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                far = (index.probes(_units(batch.column("raw"), index.width, index.single), reach) - SLACK).astype(np.float32)
                ends = pa.array(np.arange(len(batch) + 1) * lists, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))],
                                                 names=[*batch.schema.names, "far"])
    return run


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable over the links (a, b), for n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class _Cell:
    """The members of a cell, list by list, past which queries stream."""

    def __init__(self, members: pa.Table, index: Index, threshold: float, reach: float):
        self.index, self.threshold, self.reach = index, threshold, reach
        self.first = members["turn"][0].as_py() == 0
        home = members["home"].to_numpy()
        order = np.argsort(home, kind="stable")
        self.ids, self.sizes, self.error, own = (members[c].to_numpy()[order] for c in ("node", "size", "error", "own"))
        self.units = _units(members["raw"], index.width, index.single)[order]
        self.codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(members), -1)[order]
        self.homes, starts = np.unique(home[order], return_index=True)
        self.radius, self.bounds = np.maximum.reduceat(own, starts), np.append(starts, len(order))

    def near(self, k: int, units: np.ndarray):
        """Places (of queries, of members) of the links to the members of the cell's k-th list, some at a time."""
        lo, hi = self.bounds[k], self.bounds[k + 1]
        step = max(16, (1 << 20) // (hi - lo))
        for at in range(0, len(units), step):
            rest = units[at: at + step] - self.index.centres[self.homes[k]]
            square = np.zeros((len(rest), hi - lo))
            for s, book in enumerate(self.index.codes):
                q = rest[:, s * SUBSPACE: (s + 1) * SUBSPACE]
                lookup = (q ** 2).sum(axis=1)[:, None] - 2 * q @ book.T + (book ** 2).sum(axis=1)[None, :]
                square += lookup[:, self.codes[lo: hi, s]]
            i, j = np.nonzero(np.sqrt(np.maximum(square, 0)) - self.error[None, lo: hi] <= self.reach + SLACK)
            for start in range(0, len(i), 65536):
                x, y = i[start: start + 65536] + at, j[start: start + 65536] + lo
                hit = np.einsum("ij,ij->i", units[x], self.units[y]) >= self.threshold
                yield x[hit], y[hit]

    def meet(self, ids: np.ndarray, sizes: np.ndarray, units: np.ndarray, own: bool = False):
        """Link counts of members and of queries (`own`: of the members among themselves), and a star per connected piece."""
        # Places are the members, then the queries.
        shift = 0 if own else len(self.ids)
        nodes, weights = (self.ids, self.sizes) if own else (np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes]))
        asks = np.concatenate([self.index.probes(units[at: at + 2048], self.reach)[:, self.homes] <= self.radius + self.reach + 2 * SLACK
                               for at in range(0, len(units), 2048)])
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for k in range(len(self.homes)):
            asked = np.flatnonzero(asks[: self.bounds[k + 1], k] if own else asks[:, k])
            for x, y in self.near(k, units[asked]):
                x = asked[x] + shift
                keep = (nodes[x] != nodes[y]) & ((x < y) | (not own))
                x, y = x[keep], y[keep]
                if len(x):
                    np.add.at(links, x, weights[y])
                    np.add.at(links, y, weights[x])
                    root = _stars(root[x], root[y], len(root))[root]
        hit = np.flatnonzero(links)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(nodes[root[hit]])], names=["node", "links", "root"])

    def inside(self):
        """Links among the members, found by the first of the tasks that hold the cell."""
        if self.first:
            yield from self.meet(self.ids, self.sizes, self.units, own=True)

    def ask(self, queries: pa.RecordBatch):
        for at in range(0, len(queries), 2048):
            part = queries.slice(at, 2048)
            yield from self.meet(part.column("node").to_numpy(), part.column("size").to_numpy(), _units(part.column("raw"), self.index.width, self.index.single))


def _search(index: Index, threshold: float, reach: float):
    """Rows come sorted by cell, the members of a cell before its queries."""
    def run(batches):
        cell, parts, held = None, [], None
        hold = lambda: _Cell(pa.Table.from_batches(parts), index, threshold, reach)
        for batch in batches:
            at, kind = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
            edges = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])))
            for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
                rows = batch.slice(start, stop - start)
                if at[start] != cell:
                    if parts:
                        yield from hold().inside()
                    cell, parts, held = at[start], [], None
                if kind[start] == 0:
                    parts.append(rows)
                elif parts or held:
                    if held is None:
                        held, parts = hold(), []
                        yield from held.inside()
                    yield from held.ask(rows)
        if parts:
            yield from hold().inside()
    return run


def near_vectors(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `embeddings`.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; so do vectors of different dimension. Rows that share a vec_id are one vector (they do
    not count as links of each other); a null vec_id has no component and is kept.
    """
    reach = float(np.sqrt(2 - 2 * threshold))
    given = embeddings.schema["embedding"].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                             F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    packed = rows.mapInArrow(_pack(single), "vec_id long, label string, raw binary, fine boolean")
    packed = packed.withColumn("key", F.when(F.expr("fine and label is not null and vec_id is not null"), F.unhex(F.sha2("raw", 256))))
    dim = (F.octet_length("raw") / (4 if single else 8)).cast("int").alias("dim")
    known = cut_lineage(packed.select("vec_id", "label", "key", dim))
    real = known.filter("key is not null").distinct()
    classes = cut_lineage(real.groupBy("label", "key", "dim").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")))
    stats = classes.agg(F.count("*"), F.max("dim")).first()
    everyone = known.select("vec_id").withColumn("row_links", F.lit(0))
    if not stats[0]:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = -(-stats[1] // SUBSPACE) * SUBSPACE

    def vectors(some: DataFrame) -> DataFrame:
        """Classes with the bytes of their vector, taken from the row that names the class."""
        named = ["vec_id", "label", "key"]
        return packed.select(*named, "raw").join(some.withColumnRenamed("node", "vec_id"), named).dropDuplicates(named).withColumnRenamed("vec_id", "node")

    chosen = classes.orderBy(F.xxhash64("node", "label"), "node").limit(SAMPLE)
    sample = vectors(broadcast_rows(chosen, SAMPLE)).orderBy("label", "key").select("raw").toArrow()["raw"]
    index = fit(_units(sample, width, single), int(min(MOST_LISTS, max(1, stats[0] // LIST_ROWS))), single)

    placed = cut_lineage(vectors(classes).select("node", "label", "dim", "size", "raw").mapInArrow(
        _place(index), "node long, label string, dim int, size long, raw binary, home int, own double, codes binary, error double"))
    # The lists of a label lie one after the other; cells are equal shares of its vectors, so a list lies in one cell or several.
    keys = ["label", "dim", "home"]
    group = W.partitionBy("label", "dim")
    before = F.coalesce(F.sum("n").over(group.orderBy("home").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lists = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.max("own").alias("radius"))
    lists = lists.withColumns({"before": before, "total": F.sum("n").over(group)})
    lists = lists.withColumn("cells", F.ceil(F.col("total") / max(BLOCK_ROWS, CELL_BYTES // (8 * width))).cast("long"))
    at = lambda place: F.floor(place * F.col("cells") / F.col("total")).cast("long")
    lists = cut_lineage(lists.withColumns({
        "low": at(F.col("before")), "high": at(F.col("before") + F.col("n") - 1), "turns": 1 + F.floor((F.col("cells") - 1) / TURN_CELLS).cast("long")}))
    tasks = lists.groupBy("label", "dim").agg(F.max(F.col("cells") * F.col("turns")).alias("n")).agg(F.sum("n")).first()[0]
    spans = lists.filter("cells > 1").groupBy("label", "dim").agg(F.collect_list(F.struct("home", "radius", "low", "high")).alias("spans"))

    dealt = placed.join(lists.select(*keys, "n", "before", "total", "cells", "turns"), keys).withColumn("own_cell", at(
        F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))))
    cell = lambda c: F.xxhash64("label", "dim", c, "turn").alias("cell")
    members = dealt.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select(
        cell("own_cell"), F.lit(0).alias("part"), "turn", "node", "size", "raw", "home", "own", "codes", "error")
    asking = dealt.filter("cells > 1").select("node", "label", "dim", "size", "raw", "own_cell", "cells", "turns")
    asking = asking.mapInArrow(_ask(index, reach), "node long, label string, dim int, size long, raw binary, own_cell long, cells long, turns long, far array<float>")
    hit = F.filter("spans", lambda s: F.get("far", s["home"]) <= s["radius"] + reach + 2 * SLACK)
    others = F.array_distinct(F.flatten(F.transform(hit, lambda s: F.sequence(s["low"], s["high"]))))
    # Of two cells the one that follows the other by less than half the round asks it.
    ahead = lambda c: 2 * F.pmod(F.col("own_cell") - c, F.col("cells"))
    turn = F.filter(others, lambda c: (c != F.col("own_cell")) & (
        (ahead(c) < F.col("cells")) | ((ahead(c) == F.col("cells")) & (F.col("own_cell") < c))))
    queries = asking.join(spans, ["label", "dim"]).select("*", F.explode(turn).alias("to")).withColumn(
        "turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")))
    queries = queries.select(cell("to"), F.lit(1).alias("part"), "turn", "node", "size", "raw", F.lit(0).alias("home"), F.lit(0.0).alias("own"),
                             F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))
    met = members.unionByName(queries).repartition(int(min(tasks, MOST_TASKS)), "cell").sortWithinPartitions("cell", "part").mapInArrow(
        _search(index, threshold, reach), "node long, links long, root long")
    met = cut_lineage(met)
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))

    same = real.join(classes.select("label", "key", "node", "size"), ["label", "key"]).select("vec_id", "node", "size")
    found = same.join(counts, "node", "left").join(comps, "node", "left").select(
        "vec_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    found = found.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = everyone.join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", "row_links").cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL),
good AS (
    SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(node, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN comp ON vec_id = node LEFT JOIN n ON vec_id = a
"""
