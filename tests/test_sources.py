"""Files written and read again."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.operators import cluster, graph
from lattice.plans.meta import ArrayMeta
from lattice.sources import binary, intervals, text, traces
from lattice.streaming.ingest import ingest_cells, stored_cells


def test_matrix_file(spark, tmp_path):
    a = np.arange(35, dtype="<f8").reshape(7, 5)
    path = str(tmp_path / "a.bin")
    a.tofile(path)
    df = binary.read_matrix(spark, path, 5, stripe=2)
    assert df.rdd.getNumPartitions() == 4
    assert {(r.i, r.j): r.v for r in df.collect()} == {k: v for k, v in np.ndenumerate(a)}
    parts = binary.write_matrix(df, ArrayMeta((7, 5), (7, 5)), str(tmp_path / "out"), stripe=3)
    assert b"".join(open(p, "rb").read() for p in parts) == a.tobytes()
    assert {(r.i, r.j): r.v for r in binary.read_matrix(spark, parts, 5, rows=6).collect()} == {k: v for k, v in np.ndenumerate(a[:6])}


def test_long_matrix_points_and_tensor(spark, tmp_path):
    np.arange(8, dtype="<i8").tofile(str(tmp_path / "l.bin"))
    assert binary.read_matrix(spark, str(tmp_path / "l.bin"), 4, "long").dtypes[2] == ("v", "bigint")
    np.arange(8, dtype="<f8").tofile(str(tmp_path / "t.bin"))
    assert {(r.n, r.m, r.k): r.v for r in binary.read_tensor(spark, str(tmp_path / "t.bin"), 2).collect()}[1, 0, 1] == 5
    got = {r.id: r.features for r in binary.read_points(spark, str(tmp_path / "t.bin"), 4).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7]}


def test_knn_files(spark, tmp_path):
    p = spark.createDataFrame([(n, [float(n * n)]) for n in range(5)], "id long, features array<double>")
    dist, ref = binary.write_knn(cluster.knn(p, p.where("id > 2"), 2), 2, 2, str(tmp_path))
    assert np.fromfile(ref[0], "<i8").tolist() == [3, 4, 2, 3]
    assert np.fromfile(dist[0], "<f8").tolist() == [0, 0, 5, 7]


def test_interval_log(spark, tmp_path):
    rows = spark.createDataFrame([("x", n, 5 * n, 5 * n + 2) for n in range(1, 40)], "stage string, seq long, start_us long, end_us long").repartition(3)
    parts = intervals.write_intervals(rows, str(tmp_path / "log"))
    whole = np.concatenate([np.fromfile(p, "<u8") for p in parts])
    assert whole.tolist() == [39, *(x for n in range(1, 40) for x in (5 * n, 5 * n + 2))]
    assert sorted(map(tuple, intervals.read_intervals(spark, parts, "x").collect())) == sorted(map(tuple, rows.collect()))
    whole.tofile(str(tmp_path / "x_ts.bin"))
    assert intervals.read_intervals(spark, str(tmp_path / "x_ts.bin"), "x").count() == 39
    whole[:-1].tofile(str(tmp_path / "cut.bin"))
    with pytest.raises(ValueError, match="cut off"):
        intervals.read_intervals(spark, str(tmp_path / "cut.bin"), "x")


def test_interval_log_without_rows_and_with_nulls(spark, tmp_path):
    schema = "stage string, seq long, start_us long, end_us long"
    parts = intervals.write_intervals(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert intervals.read_intervals(spark, parts, "x").collect() == []
    parts = intervals.write_intervals(spark.createDataFrame([("x", None, None, 3), ("x", 1, 4, None)], schema), str(tmp_path / "nulls"))
    assert sorted(map(tuple, intervals.read_intervals(spark, parts, "x").collect())) == [("x", 1, 0, 3), ("x", 2, 4, 0)]


def test_trace_of_log_folders(spark, tmp_path):
    for folder, shift in (("a", 0), ("b", 100)):
        (tmp_path / folder).mkdir()
        np.array([1, 5 + shift, 9 + shift], "<u8").tofile(str(tmp_path / folder / "load_ts.bin"))
    path = str(tmp_path / "trace.json")
    traces.write_trace_array(traces.trace_of_logs(spark, [str(tmp_path / "a"), str(tmp_path / "b")]), path)
    found = json.load(open(path))
    assert sorted((e["name"], e["ph"], e["tid"], e["ts"]) for e in found) == [("load", "B", 0, 5), ("load", "B", 1, 105), ("load", "E", 0, 9), ("load", "E", 1, 109)]
    assert open(path).read() == json.dumps(found, indent=4)
    traces.write_trace_array(spark.createDataFrame([], traces.EVENT), path)
    assert json.load(open(path)) == []


def test_graph_through_several_files(spark, tmp_path):
    e = spark.range(300).select((F.col("id") % 50).alias("src"), (F.col("id") * 7 % 60).alias("dst"), F.lit(1).cast("long").alias("w")).distinct()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 20)
    text.write_graph(e, 60, str(tmp_path / "g"))
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "g").glob("part-*"))) > 1
    found, vertices, stated = text.read_graph(spark, str(tmp_path / "g"))
    assert (vertices, stated) == (60, e.count())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, e.collect()))


def test_graph_text(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("3 2\n2 3\n1\n1\n")
    e, vertices, stated = text.read_graph(spark, str(path))
    assert (vertices, stated) == (3, 2)
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert graph.edge_check(e, stated).first().ok


def test_text_sinks(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 2)], "src long, dst long, w long")
    lines = lambda df: sorted(r.value for r in df.collect())
    assert lines(text.costs_text(graph.bfs(e, 2))) == ["0) cost:0", "1) cost:1"]
    found, negative = graph.shortest_paths(e, 2)
    assert lines(text.distances_text(found, negative)) == ["0 0", "1 2"]
    assert lines(text.distances_text(found, True)) == [text.NEGATIVE]
    assert lines(text.ranks_text(graph.pagerank(e, 2)))[0].startswith("0 0.15")
    text.write_text(text.costs_text(graph.bfs(e, 2)), str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["0) cost:0", "1) cost:1"]


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    cells = spark.range(16).select(F.expr("id div 4").alias("i"), (F.col("id") % 4).alias("j"), F.col("id").cast("double").alias("v"))
    cells.where("i < 2").write.parquet(source)
    ingest_cells(spark, source, target, check, 2).awaitTermination()
    cells.where("i >= 2").write.mode("append").parquet(source)
    ingest_cells(spark, source, target, check, 2).awaitTermination()
    assert sorted(r.v for r in stored_cells(spark, target).collect()) == list(range(16))
    assert sorted(r.v for r in stored_cells(spark, target, ti=1, tj=0).collect()) == [8, 9, 12, 13]
