"""Meet all rows of a table with all models of another without holding either in one place.

Rows and models are dealt to a grid of cells: every row goes to one row group and is copied once per model block, every
model goes to one block and is copied once per row group. A task sorts its cells so that the
models of a cell come before its rows, takes the models in and streams the rows past them, so it holds one model
block and one Arrow batch of rows at a time. What a cell yields is one partial sum per model, added up by the caller.
Copies cost rows x model blocks + models x row groups; both counts follow from the sizes below.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

MODEL_BLOCK = 1 << 16  # models a task holds
GROUP_VALUES = 1 << 27  # numbers in the rows of one group: 1 GB
PACK_BYTES = 1 << 12  # rows are stored and shuffled some at a time, so a record does not cost more than its numbers
ROWS_AT_ONCE = 8192  # rows a kernel is given


def row_groups(rows: int, width: int, partitions: int) -> int:
    """Enough groups to keep every partition busy and none larger than GROUP_VALUES."""
    return max(1, min(rows, partitions), math.ceil(rows * width / GROUP_VALUES))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equally long lists as a 2-d array."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Rows x (array<double>), s (array<int>) as packs of some rows: x and s as bytes, and n, the number of rows."""
    size = max(1, min(PACK_BYTES // (8 * max(width, 1)), GROUP_VALUES // (2 * max(width, 1))))

    def run(batches):
        for batch in batches:
            x, s = matrix(batch.column("x")), matrix(batch.column("s"), np.int64).astype(np.int32)
            cuts = [slice(at, min(at + size, len(batch))) for at in range(0, len(batch), size)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c].tobytes() for c in cuts], pa.binary()), pa.array([s[c].tobytes() for c in cuts], pa.binary()),
                                              pa.array([c.stop - c.start for c in cuts], pa.int32())], names=["x", "s", "n"])
    return rows.select("x", "s").mapInArrow(run, "x binary, s binary, n int")


def unpacked(packs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Batches of rows x, s (lists) from packs."""
    n = int(np.sum(packs.column("n").to_numpy()))
    lists = []
    for column, kind in (("x", np.float64), ("s", np.int32)):
        flat = np.frombuffer(b"".join(packs.column(column).to_pylist()), kind)
        lists.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(flat) // max(n, 1)), pa.int32()), pa.array(flat)))
    whole = pa.RecordBatch.from_arrays(lists, names=["x", "s"])
    for at in range(0, n, ROWS_AT_ONCE):
        yield whole.slice(at, ROWS_AT_ONCE)


def _cells(kernel: Callable[[pa.Table], object], names: list[str]) -> Callable[[Iterator], Iterator]:
    """Feed the rows of each cell to kernel(models).add(rows) and yield its result()."""
    def run(batches):
        cell, parts, active = None, [], None
        for batch in batches:
            at = batch.column("_cell").to_numpy()
            kind = batch.column("_kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])))
            for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                if at[start] != cell:
                    if active is not None:
                        yield from active.result()
                    cell, parts, active = at[start], [], None
                part = batch.slice(start, stop - start)
                if kind[start] == 0:
                    parts.append(part.column("_model"))
                elif parts or active is not None:
                    if active is None:
                        models = pa.chunked_array(parts).combine_chunks()
                        active, parts = kernel(pa.Table.from_arrays(models.flatten(), names=names)), []
                    for some in unpacked(part):
                        active.add(some)
        if active is not None:
            yield from active.result()
    return run


def meet(rows: DataFrame, n_rows: int, width: int, models: DataFrame, n_models: int, block_key: Column,
         kernel: Callable[[pa.Table], object], schema: str, block: int | None = None) -> DataFrame:
    """What kernel(models).result() yields for every cell, as rows of `schema`.

    `rows` are packs (see packed) of x and s, `width` numbers each. `kernel` is built in the task from
    the models of a block and gets the rows in Arrow batches. Packs are dealt by their place, so `rows` must read a stored
    table: a task that runs again then deals them the same way. `block` is a smaller number of models per block for large ones.
    """
    blocks = max(1, math.ceil(n_models / min(MODEL_BLOCK, block or MODEL_BLOCK)))
    groups = row_groups(n_rows, width, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model_type = models.schema.simpleString()
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = rows.select("x", "s", "n", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("_g"))
    left = dealt.select("x", "s", "n", "_g", spread(blocks).alias("_b")).select(
        (F.col("_g") * blocks + F.col("_b")).alias("_cell"), F.lit(1).alias("_kind"), "x", "s", "n", F.lit(None).cast(model_type).alias("_model"))
    kept = models.select(F.struct(*models.columns).alias("_model"), F.pmod(F.xxhash64(block_key), F.lit(blocks)).alias("_b"))
    right = kept.select("_model", "_b", spread(groups).alias("_g")).select(
        (F.col("_g") * blocks + F.col("_b")).alias("_cell"), F.lit(0).alias("_kind"), F.lit(None).cast("binary").alias("x"),
        F.lit(None).cast("binary").alias("s"), F.lit(0).alias("n"), "_model")
    met = left.unionByName(right).repartition(groups * blocks, "_cell").sortWithinPartitions("_cell", "_kind")
    return met.mapInArrow(_cells(kernel, models.columns), schema)


def summed_into(models: DataFrame, parts: DataFrame, key: str, fn: Callable[[dict, np.ndarray | None], dict], schema: str) -> DataFrame:
    """fn(model, sum of its packed double vectors `v`, or None) per model, as rows of `schema`.

    Models and parts meet by key in one shuffle. Parts are added up as they stream by, so a key may have any number of them;
    a task holds one vector per model.
    """
    def run(batches):
        found, total = {}, {}
        for batch in batches:
            for name, model, raw in zip(*(batch.column(c).to_pylist() for c in (key, "_model", "v")), strict=True):
                if model is not None:
                    found[name] = model
                else:
                    v = np.frombuffer(raw)
                    total[name] = total[name] + v if name in total else v
        rows = [fn(model, total.get(name)) for name, model in found.items()]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows[at: at + 10_000]],
                                             schema=arrow)

    arrow = to_arrow_schema(DataType.fromDDL(schema))
    inner = models.schema.simpleString()
    left = models.select(key, F.struct(*models.columns).alias("_model"), F.lit(None).cast("binary").alias("v"))
    right = parts.select(key, F.lit(None).cast(inner).alias("_model"), "v")
    return left.unionByName(right).repartition(key).mapInArrow(run, schema)
