"""Matrix products over cells or tiles, with the number formats of operands, sums and results as parameters.

Strategies give the same product:

* ``cells``: join on the inner index, one sum for each result cell; for sparse operands, whose absent cells are
  exact zeros: a zero that is there meets infinities as numbers do.
* ``tiles``: join of tiles on the inner index, products in numpy, tile sums in a stream sorted by tile. The rows and
  columns of the result are dealt into groups, so a task has the products of one inner index and one pair
  of groups; an operand tile is sent once for each group of the other side.
* ``split_k``: a task has a slice of the inner index and a pair of groups and adds up its products, so a result
  tile moves once for each slice rather than for each product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions.numeric import CASTS
from lattice.operators.layout import to_cells, to_tiles
from lattice.plans.meta import ArrayMeta

_KINDS = {"f64": np.float64, "f32": np.float32, "f16": np.float16}


def matmul(a: DataFrame, b: DataFrame, a_meta: ArrayMeta, b_meta: ArrayMeta, in_type: str = "f64", acc_type: str = "f64", out_type: str = "f64", strategy: str = "tiles", slices: int = 8, groups: int = 4) -> DataFrame:
    """Cells of A B, zeros too. a and b are cells; v of the result is a double that ``out_type`` can hold."""
    if a_meta.shape[1] != b_meta.shape[0]:
        raise ValueError(f"{a_meta.shape} by {b_meta.shape}")
    if strategy == "cells":
        if acc_type != "f64":
            raise ValueError("sums over cells are in f64")
        return matmul_cells(a, b, in_type, out_type, (a_meta.shape[0], b_meta.shape[1]))
    if a_meta.tile[1] != b_meta.tile[0]:
        raise ValueError("tiles do not agree on the inner axis")
    out = ArrayMeta((a_meta.shape[0], b_meta.shape[1]), (a_meta.tile[0], b_meta.tile[1]))
    tiles = matmul_tiles(to_tiles(a, a_meta), to_tiles(b, b_meta), a_meta, b_meta, in_type, acc_type, slices if strategy == "split_k" else None, groups)
    cells = to_cells(tiles, out)
    return cells.withColumn("v", CASTS[out_type](F.col("v")))


def matmul_cells(a: DataFrame, b: DataFrame, in_type: str = "f64", out_type: str = "f64", shape: tuple[int, int] | None = None) -> DataFrame:
    """Sums over the join on the inner index; with ``shape`` cells without products are there as 0."""
    cast = CASTS[in_type]
    left = a.select("i", F.col("j").alias("k"), cast(F.col("v")).alias("x"))
    right = b.select(F.col("i").alias("k"), "j", cast(F.col("v")).alias("y"))
    out = left.join(right, "k").groupBy("i", "j").agg(CASTS[out_type](F.sum(F.col("x") * F.col("y"))).alias("v"))
    if shape is None:
        return out
    from lattice.operators.layout import densify

    return densify(out, *shape)


def matmul_tiles(a: DataFrame, b: DataFrame, a_meta: ArrayMeta, b_meta: ArrayMeta, in_type: str = "f64", acc_type: str = "f64", slices: int | None = None, groups: int = 4) -> DataFrame:
    """Tiles of A B. ``groups``: of tile rows and of tile columns of the result, each. With ``slices`` a task holds the operand tiles of its slice and groups."""
    inner, depth = a_meta.tile[1], a_meta.shape[1]
    kind, acc = _KINDS[in_type], _KINDS[acc_type]

    def product(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        n = min(inner, depth - k * inner)
        return x.astype(kind).astype(acc).reshape(-1, n) @ y.astype(kind).astype(acc).reshape(n, -1)

    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = a.select("ti", F.col("tj").alias("tk"), F.col("data").alias("x"), (F.col("ti") % groups).cast("int").alias("rows"), every.alias("cols"))
    right = b.select(F.col("ti").alias("tk"), "tj", F.col("data").alias("y"), (F.col("tj") % groups).cast("int").alias("cols"), every.alias("rows"))
    schema = "ti long, tj long, data array<double>"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ti, tj, tk = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ti", "tj", "tk"))
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))
            for n in range(batch.num_rows):
                yield _tile(ti[n], tj[n], product(x[n].values.to_numpy(), y[n].values.to_numpy(), tk[n]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                key = (batch.column(0)[n].as_py(), batch.column(1)[n].as_py())
                z = batch.column(2)[n].values.to_numpy().astype(acc)
                if key == name:
                    total = total + z
                    continue
                if name is not None:
                    yield _tile(*name, total)
                name, total = key, z
        if name is not None:
            yield _tile(*name, total)

    def slice_sums(x: pa.Table, y: pa.Table) -> pa.Table:
        by_inner: dict[int, list] = {}
        for tk, tj, data in zip(y["tk"].to_pylist(), y["tj"].to_pylist(), y["y"], strict=True):
            by_inner.setdefault(tk, []).append((tj, data.values.to_numpy()))
        total: dict[tuple, np.ndarray] = {}
        for ti, tk, data in zip(x["ti"].to_pylist(), x["tk"].to_pylist(), x["x"], strict=True):
            for tj, other in by_inner.get(tk, ()):
                z = product(data.values.to_numpy(), other, tk)
                total[ti, tj] = total[ti, tj] + z if (ti, tj) in total else z
        return pa.Table.from_batches([_tile(*k, z) for k, z in total.items()], schema=_TILE)

    if slices:
        keys = ("slice", "rows", "cols")
        slice_ = (F.col("tk") % slices).alias("slice")
        parts = left.select("*", slice_).groupBy(*keys).cogroup(right.select("*", slice_).groupBy(*keys)).applyInArrow(slice_sums, schema)
    else:
        parts = left.join(right, ["tk", "rows", "cols"]).mapInArrow(multiply, schema)
    # All parts of a tile come one after another in one task, which holds one sum.
    return parts.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(add, schema)


_TILE = pa.schema([("ti", pa.int64()), ("tj", pa.int64()), ("data", pa.list_(pa.float64()))])


def _tile(ti: int, tj: int, z: np.ndarray) -> pa.RecordBatch:
    flat = np.asarray(z, np.float64).reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array([ti], pa.int64()), pa.array([tj], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], names=["ti", "tj", "data"])


def scaled_gram(queries: DataFrame, refs: DataFrame, scale: float = -2.0, block_bytes: int = 64 << 20) -> DataFrame:
    """(q, ref, v): scale times the product of each query with each reference; (id, features) rows.

    The queries are a stated set, taken to the tasks in blocks of so many bytes; each task's rows meet a block as
    one matrix product. The references are read once for each block.
    """
    from lattice.operators.cluster import query_blocks

    out = None
    for names, x in query_blocks(queries, block_bytes):
        part = _dots(refs, names, x, scale)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else _dots(refs, np.zeros(0, np.int64), np.zeros((0, 0)), scale)


def _dots(refs: DataFrame, names: np.ndarray, x: np.ndarray, scale: float) -> DataFrame:
    shared = refs.sparkSession.sparkContext.broadcast((names, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(names) and len(ids):
                y = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
                for s in range(0, len(ids), step := max(1, (1 << 20) // len(names))):
                    v = scale * (x @ y[s : s + step].T)
                    yield pa.RecordBatch.from_pydict({"q": np.repeat(names, v.shape[1]), "ref": np.tile(ids[s : s + step], len(names)), "v": v.ravel()})

    return refs.select("id", F.col("features").cast("array<double>").alias("features")).mapInArrow(run, "q long, ref long, v double")
