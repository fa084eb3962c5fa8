"""Products of a 3-D tensor with a vector or a matrix along its last axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ttv(tensor: DataFrame, vector: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(n, m, v): sums over k of B[n,m,k] A[k]; cells without products are 0. The vector is a side of the join of one row for each k."""
    made = tensor.join(vector.select("k", F.col("v").alias("a")), "k").groupBy("n", "m").agg(F.sum(F.col("v") * F.col("a")).alias("v"))
    grid = tensor.sparkSession.range(shape[0] * shape[1]).select(F.expr(f"id div {shape[1]}").alias("n"), (F.col("id") % shape[1]).alias("m"))
    return grid.join(made, ["n", "m"], "left").select("n", "m", F.coalesce("v", F.lit(0.0)).alias("v"))


def contract(tensor: DataFrame, matrix: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(p, n, m, v): sums over k of B[n,m,k] A[p,k] for every p."""
    made = tensor.join(matrix.select("p", "k", F.col("v").alias("a")), "k").groupBy("p", "n", "m").agg(F.sum(F.col("v") * F.col("a")).alias("v"))
    ps, ns, ms = shape
    grid = tensor.sparkSession.range(ps * ns * ms).select(F.expr(f"id div {ns * ms}").alias("p"), F.expr(f"id div {ms} % {ns}").alias("n"), (F.col("id") % ms).alias("m"))
    return grid.join(made, ["p", "n", "m"], "left").select("p", "n", "m", F.coalesce("v", F.lit(0.0)).alias("v"))
