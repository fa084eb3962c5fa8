"""Hand-checked cases and numpy counterparts of the array operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.functions.numeric import fp16
from lattice.operators import cluster, generate, graph, layout, linalg, stencil, telemetry, tensor, verify
from lattice.plans.meta import ArrayMeta

FOUR = ArrayMeta((4, 4), (2, 2))


def cells(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(np.asarray(a))], "i long, j long, v double")


def array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def index(spark):
    return generate.index_matrix(spark, 4).withColumn("v", F.col("v").cast("double"))


def test_tiles_of_index_matrix(spark):
    got = {(r.ti, r.tj): r.data for r in layout.to_tiles(index(spark), FOUR).collect()}
    assert got == {(0, 0): [0, 1, 4, 5], (0, 1): [2, 3, 6, 7], (1, 0): [8, 9, 12, 13], (1, 1): [10, 11, 14, 15]}


@pytest.mark.parametrize("shape,tile", [((5, 7), (2, 3)), ((1, 1), (4, 4)), ((6, 6), (6, 6))])
def test_tiles_and_back_with_ragged_edges(spark, shape, tile):
    a = np.arange(1, shape[0] * shape[1] + 1).reshape(shape)
    meta = ArrayMeta(shape, tile)
    assert (array(layout.to_cells(layout.to_tiles(cells(spark, a), meta), meta), shape) == a).all()


def test_block_transpose_leaves_tiles_inside_as_they_are(spark):
    want = [[0, 1, 8, 9], [4, 5, 12, 13], [2, 3, 10, 11], [6, 7, 14, 15]]
    assert array(layout.block_transpose_cells(index(spark), 2), (4, 4)).tolist() == want
    tiles = layout.to_tiles(index(spark), FOUR)
    assert array(layout.to_cells(layout.block_transpose(tiles), FOUR), (4, 4)).tolist() == want
    twice = layout.block_transpose(layout.block_transpose(tiles))
    assert array(layout.to_cells(twice, FOUR), (4, 4)).tolist() == np.arange(16).reshape(4, 4).tolist()


def test_access_paths(spark):
    at = lambda df: sorted(r.v for r in df.collect())
    assert at(layout.tile_2d(index(spark), x=1, y=0, tile=2)) == [2, 3, 6, 7]
    assert at(layout.col_stripe(index(spark), 1, 2)) == [2, 3, 6, 7, 10, 11, 14, 15]
    assert at(layout.row_stripe(index(spark), 1, 2)) == list(range(8, 16))
    assert layout.stored_tile(layout.to_tiles(index(spark), FOUR), x=1, y=0).first().data == [2, 3, 6, 7]


def test_storage_is_pruned_by_tile(spark, tmp_path):
    layout.write_tiles(layout.to_tiles(index(spark), FOUR), str(tmp_path / "t"))
    got = layout.stored_tile(spark.read.parquet(str(tmp_path / "t")), x=0, y=1)
    assert got.first().data == [8, 9, 12, 13]
    assert "PartitionFilters: [isnotnull(ti" in got._jdf.queryExecution().toString()


def test_tiles_3d_roundtrip(spark):
    t = generate.uniform_tensor(spark, 4)
    back = layout.to_cells_3d(layout.to_tiles_3d(t, 2), 2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))


@pytest.mark.parametrize("strategy", ["tiles", "split_k", "cells"])
@pytest.mark.parametrize("tile", [(2, 2), (3, 3)])
def test_matmul_strategies_agree(spark, strategy, tile):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (5, 7)), rng.integers(-3, 4, (7, 4))
    got = linalg.matmul(cells(spark, a), cells(spark, b), ArrayMeta((5, 7), tile), ArrayMeta((7, 4), tile), strategy=strategy, slices=2)
    assert got.count() == 20
    assert (array(got, (5, 4)) == a @ b).all()


def test_matmul_in_half_precision(spark):
    a = np.array([[0.1, 2049.0], [1.0, 3.0]])
    got = array(linalg.matmul(cells(spark, a), cells(spark, np.eye(2)), ArrayMeta((2, 2), (2, 2)), ArrayMeta((2, 2), (2, 2)), in_type="f16"), (2, 2))
    assert (got == a.astype(np.float16).astype(float)).all()


def test_fp16_edges(spark):
    x = [0.1, 2049.0, 65520.0, -65520.0, 2.0**-25, 0.0, -0.0, 65519.0, 6e-8, 1e-4, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(fp16(F.col("x"))).collect()]
    want = np.array(x).astype(np.float16).astype(float)
    assert all(g == w or math.isnan(g) and math.isnan(w) for g, w in zip(got, want, strict=True))


def test_ttv_and_contract(spark):
    b = spark.createDataFrame([(n, m, k, float(4 * n + 2 * m + k)) for n in (0, 1) for m in (0, 1) for k in (0, 1)], "n long, m long, k long, v double")
    a = spark.createDataFrame([(0, 1.0), (1, 10.0)], "k long, v double")
    assert {(r.n, r.m): r.v for r in tensor.ttv(b, a, (2, 2)).collect()} == {(0, 0): 10, (0, 1): 32, (1, 0): 54, (1, 1): 76}
    p = spark.createDataFrame([(0, 0, 1.0), (0, 1, 10.0), (1, 0, 1.0)], "p long, k long, v double")
    got = {(r.p, r.n, r.m): r.v for r in tensor.contract(b, p, (2, 2, 2)).collect()}
    assert got[0, 1, 1] == 76 and got[1, 1, 1] == 6 and len(got) == 8


EDGES = [(0, 1, 2), (0, 2, 5), (1, 2, 1), (2, 0, 3), (2, 2, 7), (3, 2, 1)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src long, dst long, w long")


def by_v(df, c):
    return [r[c] for r in df.orderBy("v").collect()]


def test_searches(spark):
    assert by_v(graph.bfs(edges(spark), 5), "cost") == [0, 1, 1, -1, -1]
    found, negative = graph.shortest_paths(edges(spark), 5)
    assert by_v(found, "dist") == [0, 2, 3, graph.INFINITE, graph.INFINITE] and not negative
    same, _ = graph.shortest_paths(edges(spark, [(a, b, 1) for a, b, _ in EDGES]), 5)
    assert by_v(same, "dist")[:3] == by_v(graph.bfs(edges(spark), 5), "cost")[:3]


def test_search_that_ends_in_the_last_round(spark):
    chain = edges(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 9), (0, 0, 0)])
    found, negative = graph.shortest_paths(chain, 4)
    assert by_v(found, "dist") == [0, 1, 2, 3] and negative is False


def test_pagerank(spark):
    assert by_v(graph.pagerank(edges(spark), 5), "rank") == pytest.approx([1.1625625, 1.03559375, 1.65184375, 0.15, 0.15])
    doubled = edges(spark, EDGES + EDGES)
    assert by_v(graph.pagerank(doubled, 5), "rank") == pytest.approx(by_v(graph.pagerank(edges(spark), 5), "rank"))


def test_graph_forms(spark):
    assert by_v(graph.csr_rows(edges(spark), 5), "first") == [0, 2, 3, 5, 6, 6]
    assert by_v(graph.adjacency_lines(edges(spark), 5), "line") == ["0 2 1 2", "1 1 2", "2 2 0 2", "3 1 2", "4 0"]
    assert graph.differences(edges(spark), edges(spark)).isEmpty()
    assert graph.differences(edges(spark), edges(spark, EDGES[1:])).collect()[0].asDict() == {"src": 0, "dst": 1, "side": "left"}
    assert graph.edge_check(graph.mirrored(edges(spark)), 6).first().ok
    assert array(graph.dense_rows(edges(spark), 2, 3), (2, 3)).tolist() == [[0, 2, 5], [0, 0, 1]]


def points(spark, rows):
    return spark.createDataFrame([(n, [float(x) for x in np.atleast_1d(r)]) for n, r in enumerate(rows)], "id long, features array<double>")


def test_kmeans(spark):
    found, centroids, changes = cluster.fit(points(spark, [0, 1, 10, 11]), 2)
    assert [r.cid for r in found.orderBy("id").collect()] == [0, 0, 1, 1]
    assert centroids == [[0.5], [10.5]] and changes == [4, 1, 0]


def test_kmeans_empty_cluster_keeps_its_seed(spark):
    p = points(spark, [0, 0, 5])
    got = {r.cid: r.v for r in cluster.step(p, cluster.seeds(p, 2)).collect()}
    assert got == {0: pytest.approx(5 / 3), 1: 0.0}


def test_knn_ties_and_blocks(spark):
    refs, queries = points(spark, [1, -1, 1, 2]), points(spark, [0, 2])
    for block_bytes in (1, 1024):
        got = {(r.q, r.rk): (r.ref, r.dist) for r in cluster.knn(refs, queries, 2, block_bytes).collect()}
        assert got == {(0, 0): (0, 1.0), (0, 1): (1, 1.0), (1, 0): (3, 0.0), (1, 1): (0, 1.0)}


TAPS = [float((t * 7 + 3) % 16) for t in range(17)]


def conv(a, taps):
    r = len(taps) // 2
    k = np.array(taps)[::-1]
    p = np.pad(a, r)
    rows = sum(k[t] * p[:, t : t + a.shape[1]] for t in range(2 * r + 1))
    return sum(k[t] * rows[t : t + a.shape[0]] for t in range(2 * r + 1))


def test_convolution_of_an_impulse(spark):
    a = np.zeros((1, 40))
    a[0, 15] = 1
    whole = array(stencil.conv_rows(cells(spark, a), TAPS), (1, 40))[0]
    assert [whole[x] for x in range(7, 24)] == [TAPS[8 + x - 15] for x in range(7, 24)]
    tiled = array(stencil.conv_rows(cells(spark, a), TAPS, 16), (1, 40))[0]
    assert tiled[16:].tolist() == [0] * 24 and tiled[:16].tolist() == whole[:16].tolist()


@pytest.mark.parametrize("shape,tile", [((20, 24), (10, 12)), ((21, 19), (8, 8))])
def test_convolution_of_tiles(spark, shape, tile):
    a = np.random.default_rng(2).integers(0, 9, shape).astype(float)
    meta = ArrayMeta(shape, tile)
    tiles = layout.to_tiles(cells(spark, a), meta)
    assert np.allclose(array(layout.to_cells(stencil.conv_tiles(tiles, meta, TAPS, "global"), meta), shape), conv(a, TAPS))
    want = np.zeros(shape)
    for i in range(0, shape[0], tile[0]):
        for j in range(0, shape[1], tile[1]):
            want[i : i + tile[0], j : j + tile[1]] = conv(a[i : i + tile[0], j : j + tile[1]], TAPS)
    assert np.allclose(array(layout.to_cells(stencil.conv_tiles(tiles, meta, TAPS), meta), shape), want)


def test_heat_step(spark):
    a = np.zeros((3, 3))
    a[1, 1] = 10
    got = array(stencil.heat_step(cells(spark, a), cells(spark, np.zeros((3, 3))), stencil.HeatConstants(0.1, 1, 1, 10)), (3, 3))
    assert np.allclose(got, [[0.8, 1.8, 0.8], [1.8, 6.7, 1.8], [0.8, 1.8, 0.8]])
    two = stencil.heat(cells(spark, a), cells(spark, np.zeros((3, 3))), stencil.HeatConstants(0.1, 1, 1, 10), 2)
    assert array(two, (3, 3))[1, 1] == pytest.approx(6.7 + 0.1 * (4 * (1.8 - 6.7) + (80 - 6.7) / 10))


def test_heat_constants_of_the_chip():
    c = stencil.HeatConstants.of_chip(64, 64)
    assert c.rx == pytest.approx(10.0) and c.ry == pytest.approx(10.0) and c.rz == pytest.approx(0.0005 / (100 * 0.00025**2))
    assert c.step_over_cap * 0.5 * 1.75e6 * 0.0005 * 0.00025**2 == pytest.approx(0.001 / (3.0e6 / (0.5 * 0.0005 * 1.75e6)))


def test_verification(spark):
    a = np.zeros((4, 4))
    b = a.copy()
    b[3, 0] = 1
    got = {(r.ti, r.tj): r.mismatches for r in verify.tile_mismatches(cells(spark, b), cells(spark, a), 2).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    assert {r.stripe: r.mismatches for r in verify.stripe_mismatches(cells(spark, b), cells(spark, a), 2).collect()} == {0: 0, 1: 1}
    a[0, 1], b[2, 2] = np.nan, -np.inf
    assert [(r.i, r.j) for r in verify.bad_cells(cells(spark, a)).collect()] == [(0, 1)]
    assert not verify.is_sound(cells(spark, b)) and verify.is_sound(cells(spark, np.zeros((1, 1))))


def test_first_mismatch(spark):
    t = generate.uniform_tensor(spark, 3)
    u = t.withColumn("v", F.when(F.expr("n = 1 and (m = 2 or k = 2)"), 0.0).otherwise(F.col("v")))
    assert verify.first_mismatch(t, u).first()[:3] == (1, 0, 2)
    assert verify.first_mismatch(t, t).isEmpty()


def test_speedups(spark):
    m = spark.createDataFrame([("x", 4.0, 4.0), ("y", 4.0, 1.0)], "app string, base double, fast double")
    got = {r["config"]: (r["mean"], r["geomean"]) for r in telemetry.speedup_report(m, ["base", "fast"], "base").collect()}
    assert got["base"] == (1.0, 1.0) and got["fast"] == (2.5, pytest.approx(2.0))


def test_trace_of_an_interval(spark):
    own = spark.createDataFrame([("read", 1, 10, 14)], "stage string, seq long, start_us long, end_us long")
    events = telemetry.merged([telemetry.trace_events(own), telemetry.trace_events(own)])
    assert sorted((r.name, r.ph, r.tid, r.ts) for r in events.collect()) == [("read", "B", 0, 10), ("read", "B", 1, 10), ("read", "E", 0, 14), ("read", "E", 1, 14)]
    assert telemetry.event_json(telemetry.trace_events(own)).first().value == '{"name":"read","ph":"B","pid":0,"tid":0,"ts":10}'
    assert [r.at_us for r in telemetry.rebased(own, 4).orderBy("place").collect()] == [6, 10]


def test_random_graph_is_mirrored(spark):
    got = {(r.src, r.dst): r.w for r in generate.random_graph(spark, 40).collect()}
    assert all(got[b, a] is not None for a, b in got) and all(1 <= w <= 10 for w in got.values())


def test_large_tiles_are_filled_in_one_pass(spark):
    side = 512
    a = spark.range(side * side).select(F.expr(f"id div {side}").alias("i"), (F.col("id") % side).alias("j"), F.col("id").cast("double").alias("v"))
    meta = ArrayMeta((side, side), (side, side))
    assert layout.to_tiles(a, meta).first().data == [float(x) for x in range(side * side)]


def test_zeros_meet_infinities_alike(spark):
    a, b = np.array([[np.inf, 1.0], [0.0, np.nan]]), np.array([[0.0, 2.0], [1.0, 0.0]])
    with np.errstate(invalid="ignore"):
        want = a @ b
    meta = ArrayMeta((2, 2), (2, 2))
    for strategy in ("cells", "tiles", "split_k"):
        got = array(linalg.matmul(cells(spark, a), cells(spark, b), meta, meta, strategy=strategy), (2, 2))
        assert np.array_equal(got, want, equal_nan=True), strategy


def test_sums_in_single_precision(spark):
    a, b = np.full((1, 4), 1 / 3), np.full((4, 1), 1e4)
    got = array(linalg.matmul(cells(spark, a), cells(spark, b), ArrayMeta((1, 4), (1, 2)), ArrayMeta((4, 1), (2, 1)), in_type="f32", acc_type="f32", out_type="f32"), (1, 1))
    x, y = a.astype(np.float32), b.astype(np.float32)
    assert got[0, 0] == float((x[:, :2] @ y[:2] + x[:, 2:] @ y[2:])[0, 0])
    with pytest.raises(ValueError):
        linalg.matmul(cells(spark, a), cells(spark, b), ArrayMeta((1, 4), (1, 2)), ArrayMeta((4, 1), (2, 1)), acc_type="f32", strategy="cells")


def test_clusters_and_neighbours_of_wide_points(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 20_000))
    p = points(spark, x)
    found, centroids, _ = cluster.fit(p, 3)
    now = x[:3]
    for _ in range(500):
        cid = ((x[:, None] - now[None]) ** 2).sum(2).argmin(1)
        after = np.array([x[cid == c].mean(0) for c in range(3)])
        if np.allclose(after, now):
            break
        now = after
    assert [r.cid for r in found.orderBy("id").collect()] == cid.tolist() and np.allclose(centroids, now)
    near = cluster.knn(p, p.where("id < 5"), 3, 400_000)
    for q in range(5):
        d = ((x - x[q]) ** 2).sum(1)
        assert [r.ref for r in near.where(f"q = {q}").orderBy("rk").collect()] == np.argsort(d)[:3].tolist()
