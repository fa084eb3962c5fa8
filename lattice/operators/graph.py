"""Searches, ranks and conversions over edges (src, dst, w). An edge is there if w is not 0; of several, they are one.

Each round of a search is a join of the edges, hashed by source once and kept, with the vertices that the
round before changed; what a round finds is a table in the shared folder. The side that changed is
broadcast while its known number of rows is within bounds.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.plans.storage import drop_table, small, table

INFINITE = 2147483647


def _kept(edges: DataFrame) -> DataFrame:
    return edges.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)


def bfs(edges: DataFrame, vertices: int, source: int = 0) -> DataFrame:
    """(v, cost): the fewest edges from the source to each vertex 0..vertices-1; -1 where none lead."""
    spark = edges.sparkSession
    kept = _kept(edges.where("w <> 0").select("src", "dst").distinct())
    frontier = spark.range(source, source + 1).select(F.col("id").alias("v"), F.lit(0).alias("cost"))
    seen, rows, level, levels = frontier, 1, 0, []
    while rows:
        level += 1
        reached = kept.join(small(frontier.select(F.col("v").alias("src")), rows), "src").select(F.col("dst").alias("v")).distinct()
        fresh = reached.join(seen.select("v"), "v", "left_anti").select("v", F.lit(level).alias("cost"))
        frontier = table(fresh, "frontier")
        levels.append(frontier)
        rows = frontier.count()
        seen = seen.unionAll(frontier)
    kept.unpersist()
    return spark.range(vertices).select(F.col("id").alias("v")).join(seen, "v", "left").select("v", F.coalesce("cost", F.lit(-1)).alias("cost"))


def shortest_paths(edges: DataFrame, vertices: int, source: int = 0) -> tuple[DataFrame, bool]:
    """((v, dist), negative): least sums of weights from the source; INFINITE where none lead. Edges need w > 0.

    Only vertices that the round before improved send on. negative: distances still fell after
    vertices - 1 rounds, which with such weights they cannot.
    """
    spark = edges.sparkSession
    kept = _kept(edges.where("w > 0").groupBy("src", "dst").agg(F.min("w").cast("long").alias("w")))
    dist = table(spark.range(vertices).select(F.col("id").alias("v"), F.when(F.col("id") == source, 0).otherwise(INFINITE).cast("long").alias("dist"), (F.col("id") == source).alias("fresh")), "dist")
    rounds, rows = 0, 1
    while rows and rounds < vertices:
        fresh = dist.where("fresh").select(F.col("v").alias("src"), F.col("dist").alias("d"))
        best = kept.join(small(fresh, rows), "src").groupBy("dst").agg(F.min(F.col("d") + F.col("w")).alias("d"))
        better = F.coalesce(F.col("d") < F.col("dist"), F.lit(False))
        after = dist.join(best, dist.v == best.dst, "left").select("v", F.when(better, F.col("d")).otherwise(F.col("dist")).alias("dist"), better.alias("fresh"))
        after = table(after, "dist")
        drop_table(dist)
        dist, rounds = after, rounds + 1
        rows = dist.where("fresh").count()
    kept.unpersist()
    return dist.select("v", "dist"), rows > 0


def out_degree(edges: DataFrame, vertices: int) -> DataFrame:
    """(v, degree): distinct other vertices that each leads to."""
    count = edges.where("w <> 0 and src <> dst").select("src", "dst").distinct().groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return edges.sparkSession.range(vertices).select(F.col("id").alias("v")).join(count, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def pagerank(edges: DataFrame, vertices: int, iterations: int = 4, damping: float = 0.85) -> DataFrame:
    """(v, rank): ``iterations`` - 1 rounds of 1 - damping + damping * sum of rank / out-degree; not normalised, self-loops left out.

    A vertex begins by giving 1 / out-degree; one without out-edges gives nothing at first. The number of
    rounds is fixed and small, so the plan is a chain of joins on one hashing of the edges.
    """
    own = edges.where("w <> 0 and src <> dst").select("src", "dst").distinct().repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    degree = out_degree(own.withColumn("w", F.lit(1)), vertices)
    state = degree.select("v", "degree", F.when(F.col("degree") > 0, 1.0 / F.col("degree")).otherwise(0.0).alias("given"))
    for _ in range(iterations - 1):
        sums = own.join(state.select(F.col("v").alias("src"), "given"), "src").groupBy(F.col("dst").alias("u")).agg(F.sum("given").alias("got"))
        rank = F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        state = degree.join(sums, F.col("v") == F.col("u"), "left").select("v", "degree", rank.alias("rank"))
        state = state.withColumn("given", F.col("rank") / F.greatest("degree", F.lit(1)))
    return state.select("v", "rank") if iterations > 1 else state.select("v", F.col("given").alias("rank"))


def csr_rows(edges: DataFrame, vertices: int) -> DataFrame:
    """(v, first): where each vertex's targets begin, 0..vertices (the last is their number).

    The running sum goes over blocks of vertices: sums of blocks first, then within each block.
    """
    count = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"))
    block = 65536
    dense = edges.sparkSession.range(vertices + 1).select(F.col("id").alias("v")).join(count, "v", "left").select("v", F.expr(f"v div {block}").alias("b"), F.coalesce("n", F.lit(0)).alias("n"))
    sums = dense.groupBy("b").agg(F.sum("n").alias("s"))  # a row for each block
    before = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dense.withColumn("within", within).join(before, "b").select("v", (F.col("before") + F.col("within")).alias("first"))


def csr_targets(edges: DataFrame) -> DataFrame:
    """(src, place, dst): targets of each vertex, numbered from 0 in ascending order."""
    return edges.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("place"), "dst")


def adjacency_lines(edges: DataFrame, vertices: int) -> DataFrame:
    """(v, line): ``v degree n1 n2 ...``, neighbours ascending."""
    near = edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
    every = edges.sparkSession.range(vertices).select(F.col("id").alias("v")).join(near, "v", "left")
    words = F.concat(F.array("v", F.coalesce(F.size("near"), F.lit(0)).cast("long")), F.coalesce("near", F.array().cast("array<long>")))
    return every.select("v", F.array_join(words.cast("array<string>"), " ").alias("line"))


def dense_rows(edges: DataFrame, rows: int, vertices: int) -> DataFrame:
    """(i, j, v): the first rows of the adjacency matrix, weights or 0; the last of several edges in ``w`` order stands."""
    own = edges.where(F.col("src") < rows).groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.max("w").cast("double").alias("v"))
    from lattice.operators.layout import densify

    return densify(own, rows, vertices)


def edge_check(edges: DataFrame, stated: int) -> DataFrame:
    """(entries, stated, ok): whether the entries are twice the stated number of undirected edges."""
    return edges.agg(F.count("*").alias("entries")).select("entries", F.lit(stated).cast("long").alias("stated"), (F.col("entries") == 2 * stated).alias("ok"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, side): rows that only one of two graphs has."""
    a, b = a.select("src", "dst").distinct(), b.select("src", "dst").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge both ways."""
    return edges.select("src", "dst", "w").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
