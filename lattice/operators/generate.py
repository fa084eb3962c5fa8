"""Synthetic arrays and graphs from a portable integer hash: the same rows in any engine with 64-bit integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.numeric import hashed, uniform


def index_matrix(spark: SparkSession, n: int, cols: int | None = None) -> DataFrame:
    """Cells with v = i * cols + j."""
    cols = cols or n
    return spark.range(n * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"), F.col("id").alias("v"))


def uniform_matrix(spark: SparkSession, rows: int, cols: int, low: float = 0.0, high: float = 1.0, seed: int = 5) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"), uniform(F.col("id"), low, high, seed).alias("v"))


def points(spark: SparkSession, n: int, dims: int, seed: int = 5) -> DataFrame:
    """(id, features) uniform in 0..10."""
    own = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: uniform(F.col("id") * dims + d, 0.0, 10.0, seed))
    return spark.range(n).select("id", own.alias("features"))


def uniform_tensor(spark: SparkSession, side: int, seed: int = 5) -> DataFrame:
    """Cells (n, m, k, v) uniform in -50..50."""
    place = (F.expr(f"id div {side * side}").alias("n"), F.expr(f"id div {side} % {side}").alias("m"), (F.col("id") % side).alias("k"))
    return spark.range(side**3).select(*place, uniform(F.col("id"), -50.0, 50.0, seed).alias("v"))


def random_graph(spark: SparkSession, vertices: int, seed: int = 5) -> DataFrame:
    """Edges (src, dst, w): 2 to 4 from each vertex, weights 1 to 10, mirrored; of several between two vertices the one made last."""
    out = spark.range(vertices).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), (hashed(F.col("id"), seed) % 3 + 1).cast("int"))).alias("e"))
    out = out.withColumn("seq", F.col("src") * 4 + F.col("e"))
    out = out.select("src", (hashed(F.col("seq"), seed + 1) % vertices).alias("dst"), (hashed(F.col("seq"), seed + 2) % 10 + 1).alias("w"), (F.col("seq") * 2).alias("seq"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", (F.col("seq") + 1).alias("seq"))
    return out.unionAll(back).groupBy("src", "dst").agg(F.max_by("w", "seq").alias("w"))
