"""Programs over files: ``python -m lattice PROGRAM INPUT ... OUTPUT``. Arrays are headerless binary files, graphs such a file of weights or a text that ends in .txt."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.operators import cluster, graph, layout, linalg, stencil, tensor, verify
from lattice.plans.meta import ArrayMeta
from lattice.plans.storage import ship
from lattice.sources import binary, text, traces


def block_gemm(spark: SparkSession, a: argparse.Namespace) -> None:
    """The matrix times itself."""
    meta, cells = ArrayMeta((a.n, a.n), (a.tile, a.tile)), binary.read_matrix(spark, a.input, a.n)
    out = linalg.matmul(cells, cells, meta, meta, in_type=a.in_type, acc_type=a.acc_type, out_type=a.out_type)
    binary.write_matrix(out, meta, a.output, stripe=a.tile)


def kmeans(spark: SparkSession, a: argparse.Namespace) -> None:
    """Centroids and memberships as text."""
    found, centroids, _ = cluster.fit(binary.read_points(spark, a.input, a.dims, rows=a.n), a.k, a.threshold)
    text.write_text(spark.createDataFrame([(x,) for x in text.centroids_text(centroids)], "value string"), f"{a.output}/cluster_centres")
    text.write_text(text.membership_text(found), f"{a.output}/membership")


def knn(spark: SparkSession, a: argparse.Namespace) -> None:
    """Distances and indices of the k nearest, a column for each query."""
    queries = binary.read_points(spark, a.queries, a.dims)
    found = cluster.knn(binary.read_points(spark, a.input, a.dims, rows=a.n), queries, a.k)
    binary.write_knn(found, a.k, queries.count(), a.output)


def _edges(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.input.endswith(".txt"):
        return text.read_graph(spark, a.input)[0]
    cells = binary.read_matrix(spark, a.input, a.n, "long", rows=a.n)
    return cells.where("v <> 0").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w"))


def bfs(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_text(text.costs_text(graph.bfs(_edges(spark, a), a.n, a.source)), a.output)


def bellmanford(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_text(text.distances_text(*graph.shortest_paths(_edges(spark, a), a.n, a.source)), a.output)


def pagerank(spark: SparkSession, a: argparse.Namespace) -> None:
    text.write_text(text.ranks_text(graph.pagerank(_edges(spark, a), a.n, a.iterations)), a.output)


def convolution(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows, then columns, by one set of taps."""
    meta = ArrayMeta((a.n, a.n), (a.tile, a.tile))
    tiles = layout.to_tiles(binary.read_matrix(spark, a.input, a.n), meta)
    binary.write_matrix(layout.to_cells(stencil.conv_tiles(tiles, meta, a.taps, a.halo), meta), meta, a.output, stripe=a.tile)


def hotspot(spark: SparkSession, a: argparse.Namespace) -> None:
    """Steps of the heat of a chip that the grid covers."""
    meta = ArrayMeta((a.n, a.n), (a.tile, a.tile))
    grids = (binary.read_matrix(spark, p, a.n) for p in (a.input, a.power))
    out = stencil.heat(*grids, stencil.HeatConstants.of_chip(a.n, a.n), a.steps, a.tile if a.halo == "tile" else None)
    binary.write_matrix(out, meta, a.output, stripe=a.tile)


def ttv(spark: SparkSession, a: argparse.Namespace) -> None:
    """A cube times a vector along its fastest axis."""
    vector = binary.read_matrix(spark, a.other, 1).select(F.col("i").alias("k"), "v")
    out = tensor.ttv(binary.read_tensor(spark, a.input, a.n), vector, (a.n, a.n))
    binary.write_matrix(out.select(F.col("n").alias("i"), F.col("m").alias("j"), "v"), ArrayMeta((a.n, a.n), (a.n, a.n)), a.output)


def tc(spark: SparkSession, a: argparse.Namespace) -> None:
    """A cube times a matrix of p rows along its fastest axis; rows of the answer are (p, n), columns m."""
    matrix = binary.read_matrix(spark, a.other, a.n, rows=a.p).select(F.col("i").alias("p"), F.col("j").alias("k"), "v")
    out = tensor.contract(binary.read_tensor(spark, a.input, a.n), matrix, (a.p, a.n, a.n))
    shape = (a.p * a.n, a.n)
    binary.write_matrix(out.select((F.col("p") * a.n + F.col("n")).alias("i"), F.col("m").alias("j"), "v"), ArrayMeta(shape, shape), a.output)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """How many cells of each tile differ between two matrices: ``ti tj mismatches``."""
    found = verify.tile_mismatches(binary.read_matrix(spark, a.input, a.n), binary.read_matrix(spark, a.other, a.n), a.tile)
    text.write_text(found.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("ti", "tj", "mismatches"))).alias("value")), a.output)


def trace(spark: SparkSession, a: argparse.Namespace) -> None:
    """Folders of interval logs as one file of trace events."""
    traces.write_trace_array(traces.trace_of_logs(spark, a.input), a.output)


#: Of each program: what it takes between its input and its output, in order, and its options.
PROGRAMS = {
    block_gemm: ("n tile", "in_type acc_type out_type"),
    kmeans: ("n dims k", "threshold"),
    knn: ("queries n dims k", ""),
    bfs: ("n", "source"),
    bellmanford: ("n", "source"),
    pagerank: ("n", "iterations"),
    convolution: ("n tile", "taps halo"),
    hotspot: ("power n tile", "steps halo"),
    ttv: ("other n", ""),
    tc: ("other n p", ""),
    compare: ("other n tile", ""),
}
PATHS = {"queries", "power", "other"}
_FORMAT = {"choices": ["f64", "f32", "f16"]}
OPTIONS = {
    "in_type": _FORMAT | {"default": "f16"},
    "acc_type": {"choices": ["f64", "f32"], "default": "f32"},
    "out_type": _FORMAT | {"default": "f32"},
    "threshold": {"type": float, "default": 0.001},
    "source": {"type": int, "default": 0},
    "iterations": {"type": int, "default": 4},
    "taps": {"type": float, "nargs": "+", "required": True},
    "halo": {"choices": ["tile", "global"], "default": "tile"},
    "steps": {"type": int, "default": 1},
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lattice", description=__doc__)
    each = out.add_subparsers(dest="program", required=True)
    for run, (places, options) in PROGRAMS.items():
        own = each.add_parser(run.__name__, help=run.__doc__)
        own.set_defaults(run=run)
        own.add_argument("input")
        for name in places.split():
            own.add_argument(name, type=str if name in PATHS else int)
        own.add_argument("output")
        for name in options.split():
            own.add_argument(f"--{name.replace('_', '-')}", **OPTIONS[name])
    own = each.add_parser("trace", help=trace.__doc__)
    own.set_defaults(run=trace)
    own.add_argument("output")
    own.add_argument("input", nargs="+")
    return out


def main(arguments: list[str], spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"lattice {a.program}").getOrCreate()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
