"""Cells, tiles and stripes: access paths, layout conversion, transposes.

A matrix is cells (i, j, v), one row each, or tiles (ti, tj, data), ``data`` row-major within the tile. A
3-D tensor is cells (n, m, k, v) or tiles (tn, tm, tk, data). Absent cells are 0. Filters on tile
coordinates reach the scan, so tiles written with ``partitionBy`` are pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.plans.meta import ArrayMeta


def tile_2d(cells: DataFrame, x: int, y: int, tile: int) -> DataFrame:
    """Cells of the tile in row block y and column block x. The ranges are on i and j, so they are pushed down."""
    return cells.where(F.col("i").between(y * tile, y * tile + tile - 1) & F.col("j").between(x * tile, x * tile + tile - 1))


def row_stripe(cells: DataFrame, stripe: int, rows: int) -> DataFrame:
    return cells.where(F.col("i").between(stripe * rows, stripe * rows + rows - 1))


def col_stripe(cells: DataFrame, stripe: int, cols: int) -> DataFrame:
    return cells.where(F.col("j").between(stripe * cols, stripe * cols + cols - 1))


def tile_3d(cells: DataFrame, n: int, m: int, k: int, block: int) -> DataFrame:
    return cells.where(" and ".join(f"{c} between {b * block} and {b * block + block - 1}" for c, b in (("n", n), ("m", m), ("k", k))))


def stored_tile(tiles: DataFrame, x: int, y: int) -> DataFrame:
    """The tile (y, x) of tiled storage."""
    return tiles.where((F.col("ti") == y) & (F.col("tj") == x))


def _edges(meta: ArrayMeta, axis: int, at) -> F.Column:
    """Length of the tile on an axis: shorter at the far edge."""
    t, n = meta.tile[axis], meta.shape[axis]
    return F.least(F.lit(t).cast("long"), F.lit(n).cast("long") - at * t)


def _fill(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (*keys, length, at, v), a tile's one after another, to (*keys, data): one dense array at a time, each cell written once."""
    name, out = None, np.zeros(0)

    def tile() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in name), pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))], names=[*keys, "data"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(len(keys))])
        length, at, v = (batch.column(k).to_numpy() for k in range(len(keys), len(keys) + 3))
        bound = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            now = tuple(key[:, a].tolist())
            if now != name:
                if name is not None:
                    yield tile()
                name, out = now, np.zeros(int(length[a]))
            there = at[a:b] >= 0
            out[at[a:b][there]] = v[a:b][there]
    if name is not None:
        yield tile()


def _filled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles of rows (*keys, length, at, v): rows of a tile meet in one task, which streams through them."""
    schema = ", ".join(f"{k} long" for k in keys) + ", data array<double>"
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "length", "at", "v")
    return dealt.mapInArrow(lambda batches: _fill(batches, keys), schema)


def to_tiles(cells: DataFrame, meta: ArrayMeta) -> DataFrame:
    """Tiles of a matrix; every tile is there and full, absent cells are 0. Of several cells at one place any one stands. A task holds one tile."""
    th, tw = meta.tile
    ti, tj = F.expr(f"i div {th}"), F.expr(f"j div {tw}")
    length = _edges(meta, 0, F.col("ti")) * _edges(meta, 1, F.col("tj"))
    own = cells.where(F.col("v") != 0).select(ti.alias("ti"), tj.alias("tj"), (F.col("i") % th).alias("r"), (F.col("j") % tw).alias("c"), F.col("v").cast("double").alias("v"))
    own = own.select("ti", "tj", (F.col("r") * _edges(meta, 1, F.col("tj")) + F.col("c")).alias("at"), "v")
    grid = cells.sparkSession.range(meta.tiles[0] * meta.tiles[1]).select(F.expr(f"id div {meta.tiles[1]}").alias("ti"), (F.col("id") % meta.tiles[1]).alias("tj"), F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("v"))
    return _filled(own.unionAll(grid).withColumn("length", length), ["ti", "tj"])


def to_cells(tiles: DataFrame, meta: ArrayMeta) -> DataFrame:
    """Cells of a tiled matrix, zeros too."""
    th, tw = meta.tile
    width = _edges(meta, 1, F.col("tj"))
    spread = tiles.select("ti", "tj", width.alias("w"), F.posexplode("data").alias("at", "v"))
    return spread.select((F.col("ti") * th + F.expr("at div w")).alias("i"), (F.col("tj") * tw + F.col("at") % F.col("w")).alias("j"), "v")


def to_tiles_3d(cells: DataFrame, block: int) -> DataFrame:
    """Cubic tiles (tn, tm, tk, data) of a tensor whose sides ``block`` divides; ``data`` has k fastest; tiles without cells are absent."""
    keys = [F.expr(f"{c} div {block}").alias(f"t{c}") for c in "nmk"]
    at = ((F.col("n") % block) * block + F.col("m") % block) * block + F.col("k") % block
    own = cells.where("v <> 0").select(*keys, at.alias("at"), F.col("v").cast("double").alias("v")).withColumn("length", F.lit(block**3).cast("long"))
    return _filled(own, ["tn", "tm", "tk"])


def to_cells_3d(tiles: DataFrame, block: int) -> DataFrame:
    spread = tiles.select("tn", "tm", "tk", F.posexplode("data").alias("at", "v"))
    place = {"n": f"at div {block * block}", "m": f"at div {block} % {block}", "k": f"at % {block}"}
    return spread.select(*((F.col(f"t{c}") * block + F.expr(e)).alias(c) for c, e in place.items()), "v")


def block_transpose(tiles: DataFrame) -> DataFrame:
    """Tile (i, j) becomes tile (j, i); what is inside a tile stays as it is."""
    return tiles.select(F.col("tj").alias("ti"), F.col("ti").alias("tj"), "data")


def block_transpose_cells(cells: DataFrame, tile: int) -> DataFrame:
    """The same on cells."""
    return cells.select(F.expr(f"(j div {tile}) * {tile} + i % {tile}").alias("i"), F.expr(f"(i div {tile}) * {tile} + j % {tile}").alias("j"), "v")


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def densify(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """All rows x cols cells; absent ones are 0."""
    grid = cells.sparkSession.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"))
    return grid.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiled storage: one folder for each row of tiles, sorted by column within, so tile and stripe reads are pruned."""
    tiles.repartition("ti").sortWithinPartitions("tj").write.partitionBy("ti").parquet(path)
