"""Arrays and graphs derived from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.operators.layout import densify
from lattice.plans.meta import ArrayMeta

SIDE, TILE = 128, 32
GRID = ArrayMeta((SIDE, SIDE), (TILE, TILE))
CUBE, BLOCK = 16, 4
VERTICES = 1000
QUERY_STEP = 20
DIMS = 64
TAPS = [float((t * 7 + 3) % 16) for t in range(17)]
CONFIGS = ["baseline", "software", "hardware"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features)."""
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that searches look for: every row whose id is divisible by QUERY_STEP."""
    return points(spark, sf_dir).where(F.col("id") % QUERY_STEP == 0)


def point_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v) of the points."""
    return points(spark, sf_dir).select(F.col("id").alias("i"), F.posexplode("features").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


def _grid(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    sums = _read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % SIDE).alias("i"), (F.col("l_partkey") % SIDE).alias("j")).agg(F.sum(value).cast("double").alias("v"))
    return densify(sums, SIDE, SIDE)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 128 x 128 matrix of whole numbers."""
    return _grid(spark, sf_dir, "l_quantity")


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "l_linenumber")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a 16 x 16 x 16 tensor of whole numbers; empty ones are absent."""
    keys = [(F.col(c) % CUBE).alias(a) for a, c in (("n", "l_orderkey"), ("m", "l_partkey"), ("k", "l_suppkey"))]
    return _read(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").alias("v"))


def vector(spark: SparkSession) -> DataFrame:
    return spark.range(CUBE).select(F.col("id").alias("k"), (F.col("id") * 7 % 11 - 5).cast("double").alias("v"))


def matrix(spark: SparkSession) -> DataFrame:
    own = spark.range(CUBE * CUBE).select(F.expr(f"id div {CUBE}").alias("p"), (F.col("id") % CUBE).alias("k"))
    return own.select("p", "k", ((F.col("p") * 3 + F.col("k") * 7) % 11 - 5).cast("double").alias("v"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed weighted graph of 1000 vertices, from every line of every order."""
    lines = _read(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_orderkey") % VERTICES).alias("src"), (F.col("l_partkey") % VERTICES).alias("dst")).agg(F.min("l_quantity").cast("long").alias("w"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, seq, start_us, end_us). Numbers within a stage follow time."""
    from pyspark.sql import Window

    own = _read(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    seq = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    return own.select(F.col("event_type").alias("stage"), seq.alias("seq"), start.alias("start_us"), (start + F.floor(F.col("value") * 1000)).cast("long").alias("end_us"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app, config, seconds)."""
    config = F.element_at(F.array(*map(F.lit, CONFIGS)), (F.col("user_id") % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("app"), config.alias("config"), F.col("value").alias("seconds"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, event_id, line): a duration line for every third event, other text between."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("End-to-end duration: "), (F.floor(F.col("value") * 1000) / 1000).cast("decimal(20,3)").cast("string"), F.lit(" ms"))).otherwise(F.col("props"))
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("log"), "event_id", line.alias("line"))


#: The fixtures as common table expressions, in order of use.
SQL = {
    "cells1": "SELECT vec_id AS i, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "grid": f"SELECT g.i, g.j, coalesce(s.v, 0)::DOUBLE AS v FROM (SELECT a.r AS i, b.r AS j FROM range({SIDE}) a(r), range({SIDE}) b(r)) g LEFT JOIN (SELECT l_orderkey % {SIDE} AS i, l_partkey % {SIDE} AS j, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) s USING (i, j)",
    "power": f"SELECT g.i, g.j, coalesce(s.v, 0)::DOUBLE AS v FROM (SELECT a.r AS i, b.r AS j FROM range({SIDE}) a(r), range({SIDE}) b(r)) g LEFT JOIN (SELECT l_orderkey % {SIDE} AS i, l_partkey % {SIDE} AS j, sum(l_linenumber)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) s USING (i, j)",
    "cube": f"SELECT l_orderkey % {CUBE} AS n, l_partkey % {CUBE} AS m, l_suppkey % {CUBE} AS k, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3",
    "vec": f"SELECT r AS k, (r * 7 % 11 - 5)::DOUBLE AS a FROM range({CUBE}) t(r)",
    "mat": f"SELECT a.r AS p, b.r AS k, ((a.r * 3 + b.r * 7) % 11 - 5)::DOUBLE AS a FROM range({CUBE}) a(r), range({CUBE}) b(r)",
    "edges": f"SELECT l_orderkey % {VERTICES} AS src, l_partkey % {VERTICES} AS dst, min(l_quantity)::BIGINT AS w FROM lineitem GROUP BY 1, 2",
    "taps": "SELECT t, ((t * 7 + 3) % 16)::DOUBLE AS tap FROM range(17) x(t)",
    "intervals": "SELECT event_type AS stage, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, epoch_us(ts) AS start_us, epoch_us(ts) + floor(value * 1000)::BIGINT AS end_us FROM events",
    "runs": "SELECT event_type AS app, ['baseline', 'software', 'hardware'][user_id % 3 + 1] AS config, value AS seconds FROM events",
    "loglines": "SELECT event_type AS log, event_id, CASE WHEN event_id % 3 = 0 THEN 'End-to-end duration: ' || (floor(value * 1000) / 1000)::DECIMAL(20,3)::VARCHAR || ' ms' ELSE props END AS line FROM events",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A query over some of the fixtures."""
    own = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{own}{', ' if own and body.startswith('+') else ' ' if own else ''}{body.lstrip('+')}" if own else body
