"""Queries that write an array, a graph or a log by a sink of the library and return what its source reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.numeric import rounded
from lattice.operators import cluster, graph, telemetry, tensor
from lattice.plans import fixtures as fx
from lattice.plans import oracle
from lattice.plans.fixtures import sql
from lattice.plans.meta import ArrayMeta
from lattice.plans.storage import fresh_path
from lattice.sources import binary, intervals, text, traces

STRIPE = 48  # rows of a part, so that matrices have several and the last is shorter


def matrix_file(spark: SparkSession, d: str) -> DataFrame:
    parts = binary.write_matrix(fx.grid(spark, d), fx.GRID, fresh_path(spark, "matrix"), stripe=STRIPE)
    return binary.read_matrix(spark, parts, fx.SIDE)


def points_file(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.point_cells(spark, d)
    n = (cells.agg(F.max("i")).first()[0] or 0) + 1
    parts = binary.write_matrix(cells, ArrayMeta((n, fx.DIMS), (n, fx.DIMS)), fresh_path(spark, "points"))
    found = binary.read_points(spark, parts, fx.DIMS)
    return found.select("id", F.posexplode("features").alias("dim", "v")).select("id", F.col("dim").cast("long").alias("dim"), "v")


def tensor_file(spark: SparkSession, d: str) -> DataFrame:
    n = fx.CUBE
    cells = fx.cube(spark, d).select((F.col("n") * n + F.col("m")).alias("i"), F.col("k").alias("j"), F.col("v").cast("double").alias("v"))
    return binary.read_tensor(spark, binary.write_matrix(cells, ArrayMeta((n * n, n), (n * n, n)), fresh_path(spark, "tensor"), stripe=STRIPE), n)


def answer_file(spark: SparkSession, d: str) -> DataFrame:
    n = fx.CUBE
    found = tensor.ttv(fx.cube(spark, d), fx.vector(spark), (n, n)).select(F.col("n").alias("i"), F.col("m").alias("j"), "v")
    return binary.read_matrix(spark, binary.write_matrix(found, ArrayMeta((n, n), (n, n)), fresh_path(spark, "answer"), stripe=5), n)


def knn_files(spark: SparkSession, d: str) -> DataFrame:
    k, own = 4, fx.query_points(spark, d)
    queries = own.count()
    dist, ref = binary.write_knn(cluster.knn(fx.points(spark, d), own, k), k, queries, fresh_path(spark, "knn"))
    far = binary.read_matrix(spark, dist, queries).withColumnRenamed("v", "dist")
    near = binary.read_matrix(spark, ref, queries, "long").withColumnRenamed("v", "ref")
    return far.join(near, ["i", "j"]).select(F.col("i").alias("rk"), F.col("j").alias("query"), "ref", rounded(F.col("dist")).alias("dist"))


def _lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    folder = fresh_path(spark, "text")
    text.write_text(lines, folder)
    return spark.read.text(folder)


def costs_text(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, text.costs_text(graph.bfs(fx.edges(spark, d), fx.VERTICES)))


def distances_text(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, text.distances_text(*graph.shortest_paths(fx.edges(spark, d), fx.VERTICES)))


def ranks_text(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, text.ranks_text(graph.pagerank(fx.edges(spark, d), fx.VERTICES)))
    both = F.split("value", " ")
    return lines.select(both[0].cast("long").alias("v"), rounded(both[1].cast("double"), 10).alias("rank"))


def membership_text(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return _lines(spark, text.membership_text(cluster.assign(p, cluster.seeds(p, 4))))


def centroids_text(spark: SparkSession, d: str) -> DataFrame:
    lines = text.centroids_text(cluster.seeds(fx.points(spark, d), 4))
    return _lines(spark, spark.createDataFrame([(x,) for x in lines], "value string"))


def interval_log(spark: SparkSession, d: str) -> DataFrame:
    own, out = fx.intervals(spark, d), None
    for stage in sorted(r[0] for r in own.select("stage").distinct().collect()):
        parts = intervals.write_intervals(own.where(F.col("stage") == stage), fresh_path(spark, "log"))
        found = intervals.read_intervals(spark, parts, stage)
        out = found if out is None else out.unionAll(found)
    return own if out is None else out


def trace_json(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "trace") + ".json"
    traces.write_trace_array(telemetry.trace_events(fx.intervals(spark, d)), path)
    return traces.read_trace(spark, path)


def graph_text(spark: SparkSession, d: str) -> DataFrame:
    folder = fresh_path(spark, "graph")
    text.write_graph(fx.edges(spark, d), fx.VERTICES, folder)
    return text.read_graph(spark, folder)[0]


_SQL = oracle.ORACLE_SQL
_N = fx.CUBE

FILE_SQL = {
    "matrix_file": _SQL["tile_flatten"],
    "points_file": sql("SELECT i AS id, j AS dim, v FROM cells1", "cells1"),
    "tensor_file": sql(f"SELECT x.r AS n, y.r AS m, z.r AS k, coalesce(v, 0)::DOUBLE AS v FROM range({_N}) x(r) CROSS JOIN range({_N}) y(r) CROSS JOIN range({_N}) z(r) LEFT JOIN cube c ON c.n = x.r AND c.m = y.r AND c.k = z.r", "cube"),
    "answer_file": f"SELECT n AS i, m AS j, v FROM ({_SQL['ttv']})",
    "knn_files": f"SELECT rk, dense_rank() OVER (ORDER BY q) - 1 AS query, ref, dist FROM ({_SQL['knn_topk']})",
    "costs_text": f"SELECT v || ') cost:' || cost AS value FROM ({_SQL['bfs']})",
    "distances_text": f"SELECT v || ' ' || dist AS value FROM ({_SQL['bellman_ford']})",
    "ranks_text": _SQL["pagerank"],
    "membership_text": f"SELECT id || ' ' || cid AS value FROM ({_SQL['kmeans_assign']})",
    "centroids_text": sql("SELECT i || ' ' || string_agg(format('{:.6f}', v), ' ' ORDER BY j) AS value FROM cells1 WHERE i < 4 GROUP BY i", "cells1"),
    "interval_log": sql("SELECT stage, seq, start_us, end_us FROM intervals", "intervals"),
    "trace_json": _SQL["trace_events"],
    "graph_text": sql("SELECT src, dst, 1::BIGINT AS w FROM edges", "edges"),
}
