"""Separable convolution and the thermal step on cells (dense) or tiles.

``tile`` limits a stencil to its tile: beyond its edge there is 0 (convolution), or the edge cell again (heat). With
``tile=None`` the whole matrix is one tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lattice.plans.meta import ArrayMeta


def _along(axis: str, tile: int | None) -> WindowSpec:
    """Lines of the axis ('i': along columns of one row), by tile."""
    across = "j" if axis == "i" else "i"
    keys = [F.col(axis), *([F.expr(f"{across} div {tile}")] if tile else [])]
    return Window.partitionBy(*keys).orderBy(across)


def _convolve(cells: DataFrame, taps: list[float], axis: str, tile: int | None) -> DataFrame:
    """out(x) = sum over t of taps[radius - t] in(x + t), 0 beyond the edge."""
    radius, window = len(taps) // 2, _along(axis, tile)

    def at(t: int) -> Column:
        return F.col("v") if t == 0 else F.lead("v", t, 0.0).over(window) if t > 0 else F.lag("v", -t, 0.0).over(window)

    total = sum((F.lit(float(taps[radius - t])) * at(t) for t in range(-radius, radius + 1)), F.lit(0.0))
    return cells.select("i", "j", total.alias("v"))


def conv_rows(cells: DataFrame, taps: list[float], tile: int | None = None) -> DataFrame:
    return _convolve(cells, taps, "i", tile)


def conv_cols(cells: DataFrame, taps: list[float], tile: int | None = None) -> DataFrame:
    return _convolve(cells, taps, "j", tile)


def conv_separable(cells: DataFrame, taps: list[float], tile: int | None = None) -> DataFrame:
    """Rows, then columns."""
    return conv_cols(conv_rows(cells, taps, tile), taps, tile)


def conv_tiles(tiles: DataFrame, meta: ArrayMeta, taps: list[float], halo: str = "tile") -> DataFrame:
    """The same on tiles (ti, tj, data), in numpy. halo ``global``: strips of neighbours' cells are sent to each tile.

    Strips are of the taps' radius, so what moves besides the tiles is their edges. The radius must not
    pass the tile's side.
    """
    radius, weights = len(taps) // 2, np.array(taps, float)[::-1]
    th, tw = meta.tile
    if halo == "global" and radius > min(th, tw):
        raise ValueError("a tile must be as wide as the taps' radius")

    def shape(ti: int, tj: int) -> tuple[int, int]:
        return min(th, meta.shape[0] - ti * th), min(tw, meta.shape[1] - tj * tw)

    def filtered(padded: np.ndarray) -> np.ndarray:
        """Valid part of rows, then columns, of an array padded by the radius."""
        h, w = padded.shape[0] - 2 * radius, padded.shape[1] - 2 * radius
        rows = sum(weights[t] * padded[:, t : t + w] for t in range(2 * radius + 1))
        return sum(weights[t] * rows[t : t + h] for t in range(2 * radius + 1))

    schema = "ti long, tj long, data array<double>"
    if halo == "tile":

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for ti, tj, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    x = data.values.to_numpy().reshape(shape(ti, tj))
                    out.append(filtered(np.pad(x, radius)).ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["ti", "tj", "data"])

        return tiles.select("ti", "tj", "data").mapInArrow(run, schema)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each tile, itself and the parts of it that each neighbour needs: (ti, tj, di, dj, rows, data)."""
        for batch in batches:
            rows: list[tuple] = []
            for ti, tj, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = data.values.to_numpy().reshape(shape(ti, tj))
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        to = (ti + di, tj + dj)
                        if 0 <= to[0] < meta.tiles[0] and 0 <= to[1] < meta.tiles[1]:
                            part = x[{-1: slice(0, radius), 0: slice(None), 1: slice(-radius, None)}[di], {-1: slice(0, radius), 0: slice(None), 1: slice(-radius, None)}[dj]]
                            rows.append((*to, -di, -dj, part.shape[0], part.ravel()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.float64()))], names=["ti", "tj", "di", "dj", "rows", "data"])

    def gather(group: pa.Table) -> pa.Table:
        ti, tj = group["ti"][0].as_py(), group["tj"][0].as_py()
        h, w = shape(ti, tj)
        padded = np.zeros((h + 2 * radius, w + 2 * radius))
        for di, dj, rows, data in zip(group["di"].to_pylist(), group["dj"].to_pylist(), group["rows"].to_pylist(), group["data"], strict=True):
            part = data.values.to_numpy().reshape(rows, -1)
            top = {-1: radius - part.shape[0], 0: radius, 1: radius + h}[di]
            left = {-1: radius - part.shape[1], 0: radius, 1: radius + w}[dj]
            padded[top : top + part.shape[0], left : left + part.shape[1]] = part
        return pa.table({"ti": [ti], "tj": [tj], "data": pa.array([filtered(padded).ravel()], pa.list_(pa.float64()))})

    sent = tiles.select("ti", "tj", "data").mapInArrow(strips, "ti long, tj long, di long, dj long, rows long, data array<double>")
    return sent.groupBy("ti", "tj").applyInArrow(gather, schema)


# The chip of the thermal model (metres, kelvin, watts), and the step that its largest slope allows.
CHIP = {"height": 0.016, "width": 0.016, "thickness": 0.0005, "conductivity": 100.0, "specific_heat": 1.75e6, "capacity_share": 0.5, "max_power_density": 3.0e6, "precision": 0.001}
AMBIENT = 80.0


@dataclass(frozen=True)
class HeatConstants:
    """step over capacity, and the resistances along columns of a row (x), along rows (y) and upwards."""

    step_over_cap: float
    rx: float
    ry: float
    rz: float

    @staticmethod
    def of_chip(rows: int, cols: int, chip: dict[str, float] = CHIP) -> HeatConstants:
        """Constants of a grid that covers the chip: cells of equal size, conduction through their faces."""
        dy, dx = chip["height"] / rows, chip["width"] / cols
        cap = chip["capacity_share"] * chip["specific_heat"] * chip["thickness"] * dx * dy
        rx = dx / (2.0 * chip["conductivity"] * chip["thickness"] * dy)
        ry = dy / (2.0 * chip["conductivity"] * chip["thickness"] * dx)
        rz = chip["thickness"] / (chip["conductivity"] * dx * dy)
        slope = chip["max_power_density"] / (chip["capacity_share"] * chip["thickness"] * chip["specific_heat"])
        return HeatConstants(chip["precision"] / slope / cap, rx, ry, rz)


def heat_step(cells: DataFrame, power: DataFrame, constants: HeatConstants, tile: int | None = None) -> DataFrame:
    """One step of T + step/cap (P + vertical/ry + horizontal/rx + (ambient - T)/rz); beyond an edge stands the edge cell."""
    row, col = _along("i", tile), _along("j", tile)
    t, c = F.col("v"), constants
    near = {k: F.coalesce(f("v").over(w), t) for k, f, w in (("e", F.lead, row), ("w", F.lag, row), ("s", F.lead, col), ("n", F.lag, col))}
    sides = cells.select("i", "j", "v", *(x.alias(k) for k, x in near.items()))
    both = sides.join(power.select("i", "j", F.col("v").alias("p")), ["i", "j"])
    change = F.col("p") + (F.col("s") + F.col("n") - 2.0 * t) / c.ry + (F.col("e") + F.col("w") - 2.0 * t) / c.rx + (F.lit(AMBIENT) - t) / c.rz
    return both.select("i", "j", (t + c.step_over_cap * change).alias("v"))


def heat(cells: DataFrame, power: DataFrame, constants: HeatConstants, steps: int, tile: int | None = None) -> DataFrame:
    """Several steps; each one's grid is a table in the shared folder."""
    from lattice.plans.storage import drop_table, table

    last = None
    for _ in range(steps):
        cells = table(heat_step(cells, power, constants, tile), "grid")
        if last is not None:
            drop_table(last)
        last = cells
    return cells
