"""The named queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.numeric import clamp, fp16, fp32, in_range, rounded, squared_norm
from lattice.operators import cluster, generate, graph, layout, linalg, stencil, telemetry, tensor, verify
from lattice.plans import fixtures as fx
from lattice.plans.meta import ArrayMeta

GRAM_ROWS = 256  # points in a tile of the product over all points
HEAT = stencil.HeatConstants(0.125, 1.0, 1.0, 8.0)  # powers of two, so sums are exact in any order


def tile_partition(spark: SparkSession, d: str) -> DataFrame:
    tiles = layout.to_tiles(fx.grid(spark, d), fx.GRID)
    total = F.aggregate(F.transform("data", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return tiles.select("ti", "tj", F.size("data").cast("long").alias("n"), total.alias("checksum"))


def tile_flatten(spark: SparkSession, d: str) -> DataFrame:
    return layout.to_cells(layout.to_tiles(fx.grid(spark, d), fx.GRID), fx.GRID)


def tile_fetch_2d(spark: SparkSession, d: str) -> DataFrame:
    return layout.tile_2d(fx.grid(spark, d), x=1, y=2, tile=fx.TILE)


def row_stripe(spark: SparkSession, d: str) -> DataFrame:
    return layout.row_stripe(fx.grid(spark, d), 1, fx.TILE)


def col_stripe(spark: SparkSession, d: str) -> DataFrame:
    return layout.col_stripe(fx.grid(spark, d), 2, fx.TILE)


def tile_fetch_3d(spark: SparkSession, d: str) -> DataFrame:
    return layout.tile_3d(fx.cube(spark, d), 1, 2, 0, fx.BLOCK)


def tile_roundtrip_3d(spark: SparkSession, d: str) -> DataFrame:
    return layout.to_cells_3d(layout.to_tiles_3d(fx.cube(spark, d), fx.BLOCK), fx.BLOCK).where("v <> 0")


def element_filters(spark: SparkSession, d: str) -> DataFrame:
    return fx.edges(spark, d).where("w <> 0 and w > 0 and src <> dst").select("src", "dst", "w")


def scalar_clamps(spark: SparkSession, d: str) -> DataFrame:
    return fx.grid(spark, d).select("i", "j", clamp(F.col("v"), 10.0, 90.0).alias("v"), in_range(F.col("v"), 10.0, 90.0).cast("long").alias("inside"))


def block_transpose(spark: SparkSession, d: str) -> DataFrame:
    return layout.to_cells(layout.block_transpose(layout.to_tiles(fx.grid(spark, d), fx.GRID)), fx.GRID)


def block_transpose_seq(spark: SparkSession, d: str) -> DataFrame:
    return layout.block_transpose_cells(fx.grid(spark, d), fx.TILE)


def transpose(spark: SparkSession, d: str) -> DataFrame:
    return layout.transpose(fx.grid(spark, d))


def cast_f32(spark: SparkSession, d: str) -> DataFrame:
    return fx.point_cells(spark, d).select("i", "j", fp32(F.col("v") / 3.0).alias("v"))


def cast_f16(spark: SparkSession, d: str) -> DataFrame:
    return fx.point_cells(spark, d).select("i", "j", fp16(F.col("v")).alias("v"))


def _product(spark: SparkSession, d: str, **how) -> DataFrame:
    a = fx.grid(spark, d)
    return linalg.matmul(a, a, fx.GRID, fx.GRID, **how)


def gemm_f64(spark: SparkSession, d: str) -> DataFrame:
    return _product(spark, d, strategy="tiles")


def gemm_seq(spark: SparkSession, d: str) -> DataFrame:
    return _product(spark, d, strategy="cells")


def gemm_split_k(spark: SparkSession, d: str) -> DataFrame:
    return _product(spark, d, strategy="split_k", slices=2)


def gemm_whole(spark: SparkSession, d: str) -> DataFrame:
    a, whole = fx.grid(spark, d), ArrayMeta((fx.SIDE, fx.SIDE), (fx.SIDE, fx.SIDE))
    return linalg.matmul(a, a, whole, whole)


def gemm_ragged(spark: SparkSession, d: str) -> DataFrame:
    a, ragged = fx.grid(spark, d), ArrayMeta((fx.SIDE, fx.SIDE), (48, 48))
    return linalg.matmul(a, a, ragged, ragged)


def _typed(spark: SparkSession, d: str, in_type: str, acc_type: str, out_type: str) -> DataFrame:
    """Product of the grid's remainders by 16, whole numbers whose sums every format holds."""
    a = fx.grid(spark, d).withColumn("v", F.col("v") % 16)
    return linalg.matmul(a, a, fx.GRID, fx.GRID, in_type=in_type, acc_type=acc_type, out_type=out_type)


def gemm_f16_f32(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, "f16", "f32", "f32")


def gemm_f32_f32(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, "f32", "f32", "f32")


def gemm_f64_f32(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, "f64", "f64", "f32")


def _gram(spark: SparkSession, d: str, in_type: str) -> DataFrame:
    """The points, transposed, times the points: 64 x 64 sums over every row."""
    p = fx.point_cells(spark, d)
    n = (p.agg(F.max("i")).first()[0] or 0) + 1
    rows = ArrayMeta((n, fx.DIMS), (GRAM_ROWS, 16))
    across = ArrayMeta((fx.DIMS, n), (16, GRAM_ROWS))
    return linalg.matmul(layout.transpose(p), p, across, rows, in_type=in_type, acc_type="f64").select("i", "j", rounded(F.col("v")).alias("v"))


def gemm_f32(spark: SparkSession, d: str) -> DataFrame:
    return _gram(spark, d, "f32")


def gemm_f16(spark: SparkSession, d: str) -> DataFrame:
    return _gram(spark, d, "f16")


def squared_norms(spark: SparkSession, d: str) -> DataFrame:
    return fx.points(spark, d).select("id", rounded(squared_norm(F.col("features"))).alias("v"))


def neg2_dot(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return linalg.scaled_gram(fx.query_points(spark, d), p).select("q", "ref", rounded(F.col("v")).alias("v"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.knn(fx.points(spark, d), fx.query_points(spark, d), 4)
    return found.select("q", F.col("rk").cast("long").alias("rk"), "ref", rounded(F.col("dist")).alias("dist"))


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return cluster.assign(p, cluster.seeds(p, 4)).select("id", F.col("cid").cast("long").alias("cid"))


def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return cluster.step(p, cluster.seeds(p, 4)).select(F.col("cid").cast("long").alias("cid"), F.col("dim").cast("long").alias("dim"), rounded(F.col("v")).alias("v"))


def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    found, _, _ = cluster.fit(fx.points(spark, d), 4)
    return found.select("id", F.col("cid").cast("long").alias("cid"))


def kmeans_delta(spark: SparkSession, d: str) -> DataFrame:
    _, _, changes = cluster.fit(fx.points(spark, d), 4)
    return spark.createDataFrame(list(enumerate(changes)), "round long, changed long")


def bfs(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(fx.edges(spark, d), fx.VERTICES)


def negative_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Whether distances still fell in the last round: with positive weights never."""
    return spark.createDataFrame([(graph.shortest_paths(fx.edges(spark, d), fx.VERTICES)[1],)], "negative boolean")


def bellman_ford(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(fx.edges(spark, d), fx.VERTICES)[0]


def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degree(fx.edges(spark, d), fx.VERTICES)


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(fx.edges(spark, d), fx.VERTICES).select("v", rounded(F.col("rank"), 10).alias("rank"))


def graph_csr(spark: SparkSession, d: str) -> DataFrame:
    e = fx.edges(spark, d)
    return graph.csr_rows(e, fx.VERTICES)


def graph_csr_targets(spark: SparkSession, d: str) -> DataFrame:
    return graph.csr_targets(fx.edges(spark, d)).select("src", F.col("place").cast("long").alias("place"), "dst")


def graph_adjlist(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency_lines(fx.edges(spark, d), fx.VERTICES)


def graph_dense_row(spark: SparkSession, d: str) -> DataFrame:
    return graph.dense_rows(fx.edges(spark, d), fx.VERTICES, fx.VERTICES)


def graph_edge_check(spark: SparkSession, d: str) -> DataFrame:
    e = fx.edges(spark, d)
    return graph.edge_check(graph.mirrored(e), e.count())


def graph_differences(spark: SparkSession, d: str) -> DataFrame:
    e = fx.edges(spark, d)
    return graph.differences(e.where("w > 5"), e.where("w < 40"))


def conv_rows(spark: SparkSession, d: str) -> DataFrame:
    return stencil.conv_rows(fx.grid(spark, d), fx.TAPS, fx.TILE)


def conv_cols(spark: SparkSession, d: str) -> DataFrame:
    return stencil.conv_cols(fx.grid(spark, d), fx.TAPS, fx.TILE)


def conv_separable_tile(spark: SparkSession, d: str) -> DataFrame:
    return layout.to_cells(stencil.conv_tiles(layout.to_tiles(fx.grid(spark, d), fx.GRID), fx.GRID, fx.TAPS), fx.GRID)


def conv_separable_global(spark: SparkSession, d: str) -> DataFrame:
    return layout.to_cells(stencil.conv_tiles(layout.to_tiles(fx.grid(spark, d), fx.GRID), fx.GRID, fx.TAPS, "global"), fx.GRID)


def conv_separable_cells(spark: SparkSession, d: str) -> DataFrame:
    return stencil.conv_separable(fx.grid(spark, d), fx.TAPS)


def heat_step_tile(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid(spark, d)
    return stencil.heat_step(g, g, HEAT, fx.TILE)


def heat_step_global(spark: SparkSession, d: str) -> DataFrame:
    return stencil.heat_step(fx.grid(spark, d), fx.power(spark, d), HEAT)


def heat_two_steps(spark: SparkSession, d: str) -> DataFrame:
    return stencil.heat(fx.grid(spark, d), fx.power(spark, d), HEAT, 2)


def ttv(spark: SparkSession, d: str) -> DataFrame:
    return tensor.ttv(fx.cube(spark, d), fx.vector(spark), (fx.CUBE, fx.CUBE))


def tensor_contract(spark: SparkSession, d: str) -> DataFrame:
    return tensor.contract(fx.cube(spark, d), fx.matrix(spark), (fx.CUBE, fx.CUBE, fx.CUBE))


def _spoilt(cells: DataFrame) -> DataFrame:
    return cells.withColumn("v", F.when((F.col("i") * 7 + F.col("j")) % 97 == 0, F.lit(float("nan"))).when((F.col("i") + F.col("j") * 5) % 89 == 0, F.lit(float("inf"))).otherwise(F.col("v")))


def nan_inf_scan(spark: SparkSession, d: str) -> DataFrame:
    return verify.bad_cells(_spoilt(fx.grid(spark, d))).select("i", "j")


def _changed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("v", F.when((F.col("i") * 7 + F.col("j")) % 97 == 0, F.col("v") + 1).otherwise(F.col("v")))


def tile_mismatch(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid(spark, d)
    return verify.tile_mismatches(_changed(g), g, fx.TILE)


def stripe_mismatch(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid(spark, d)
    return verify.stripe_mismatches(_changed(g), g, fx.TILE)


def tensor_first_mismatch(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cube(spark, d)
    return verify.first_mismatch(c.withColumn("v", F.when(F.col("n") + F.col("m") + F.col("k") == 11, F.col("v") + 1).otherwise(F.col("v"))), c)


def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.stage_durations(fx.intervals(spark, d))


def stage_rebased(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.rebased(fx.intervals(spark, d), 1_600_000_000_000_000).select("stage", "seq", F.col("place").cast("long").alias("place"), "at_us")


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.trace_events(fx.intervals(spark, d)).select("name", "ph", F.col("pid").cast("long").alias("pid"), F.col("tid").cast("long").alias("tid"), "ts")


def trace_merge(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 intervals of each stage and all others are the two traces."""
    own = fx.intervals(spark, d)
    events = telemetry.merged([telemetry.trace_events(own.where("seq <= 100")), telemetry.trace_events(own.where("seq > 100"))])
    return events.select("name", "ph", F.col("tid").cast("long").alias("tid"), "ts")


def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.parse_log(fx.log_lines(spark, d), "event_id", group="log").select("log", F.col("ordinal").cast("long").alias("ordinal"), rounded(F.col("seconds"), 6).alias("seconds"))


def config_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = telemetry.config_matrix(fx.runs(spark, d), fx.CONFIGS)
    return m.select("app", *(rounded(F.col(c)).alias(c) for c in fx.CONFIGS))


def speedups(spark: SparkSession, d: str) -> DataFrame:
    m = telemetry.config_matrix(fx.runs(spark, d), fx.CONFIGS)
    return telemetry.speedups(m, fx.CONFIGS, "baseline").select("app", "config", rounded(F.col("speedup")).alias("speedup"))


def speedup_report(spark: SparkSession, d: str) -> DataFrame:
    m = telemetry.config_matrix(fx.runs(spark, d), fx.CONFIGS)
    r = telemetry.speedup_report(m, fx.CONFIGS, "baseline")
    return r.select("config", rounded(F.col("mean")).alias("mean"), rounded(F.col("geomean")).alias("geomean"))


def gen_index_matrix(spark: SparkSession, d: str) -> DataFrame:
    return generate.index_matrix(spark, 64)


def gen_uniform(spark: SparkSession, d: str) -> DataFrame:
    return generate.uniform_matrix(spark, 64, 64)


def gen_points(spark: SparkSession, d: str) -> DataFrame:
    return generate.points(spark, 64, 8).select("id", F.posexplode("features").alias("dim", "v")).select("id", F.col("dim").cast("long").alias("dim"), "v")


def gen_tensor(spark: SparkSession, d: str) -> DataFrame:
    return generate.uniform_tensor(spark, 16)


def gen_graph(spark: SparkSession, d: str) -> DataFrame:
    return generate.random_graph(spark, 500)
