"""Comparison of arrays: scans for what is no number, and cells in which two arrays differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bad_cells(cells: DataFrame) -> DataFrame:
    """Cells that are NaN or infinite."""
    return cells.where(F.isnan("v") | (F.abs("v") == float("inf")))


def is_sound(cells: DataFrame) -> bool:
    """Whether no cell is NaN or infinite; the scan stops at the first."""
    return bad_cells(cells).limit(1).isEmpty()


def _both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of either, absent ones 0, and whether they differ. NaN and infinity differ from everything."""
    joined = a.select(*keys, F.col("v").alias("a")).join(b.select(*keys, F.col("v").alias("b")), keys, "full")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    wrong = (x != y) | F.isnan(x) | (F.abs(x) == float("inf"))
    return joined.select(*keys, x.alias("a"), y.alias("b"), wrong.cast("long").alias("wrong"))


def tile_mismatches(a: DataFrame, b: DataFrame, tile: int) -> DataFrame:
    """(ti, tj, mismatches) of every tile."""
    return _both(a, b, ["i", "j"]).groupBy(F.expr(f"i div {tile}").alias("ti"), F.expr(f"j div {tile}").alias("tj")).agg(F.sum("wrong").alias("mismatches"))


def stripe_mismatches(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """(stripe, mismatches) of every row stripe."""
    return _both(a, b, ["i", "j"]).groupBy(F.expr(f"i div {rows}").alias("stripe")).agg(F.sum("wrong").alias("mismatches"))


def first_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, m, k, a, b) of the first cell, k fastest, in which two tensors differ; no row if there is none."""
    return _both(a, b, ["n", "m", "k"]).where("wrong = 1").orderBy("n", "m", "k").limit(1).drop("wrong")
