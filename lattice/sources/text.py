"""Graphs as text, and results as text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEGATIVE = "FOUND NEGATIVE CYCLE!"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) from 0, through files in order of their names. Numbers come from the count of lines of each block of a file; nothing is sorted or gathered but those counts."""
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(F.col("value").alias("line"), *block, F.monotonically_increasing_id().alias("m"))
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("c"), F.min("m").alias("least")).collect()  # one for each block
    before, rows = 0, []
    for r in sorted(counts):
        rows.append((r["file"], r["start"], before - r["least"]))
        before += r["c"]
    offsets = spark.createDataFrame(rows, "file string, start long, shift long")
    return lines.join(F.broadcast(offsets), ["file", "start"]).select((F.col("shift") + F.col("m")).alias("n"), "line")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((src, dst, w), vertices, edges) of ``V E`` and then the neighbours of each vertex from 1, a line each. Repeated neighbours are one."""
    lines = numbered_lines(spark, path)
    head = lines.where("n = 0").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    vertices, stated = (int(x) for x in head["line"].split()[:2])
    near = F.explode(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")).alias("to")
    own = lines.where((F.col("n") > 0) & (F.col("n") <= vertices)).select((F.col("n") - 1).alias("src"), near)
    return own.select("src", (F.col("to").cast("long") - 1).alias("dst"), F.lit(1).cast("long").alias("w")).distinct(), vertices, stated


def write_graph(edges: DataFrame, vertices: int, folder: str) -> None:
    """Such a text, in files whose names follow its order: the header, then each vertex' neighbours from 1. A vertex' neighbours are one line, so one row."""
    near = edges.groupBy(F.col("src").alias("v")).agg(F.array_join(F.sort_array(F.collect_set(F.col("dst") + 1)), " ").alias("line"))
    every = edges.sparkSession.range(vertices).select(F.col("id").alias("v")).join(near, "v", "left").select((F.col("v") + 1).alias("n"), F.coalesce("line", F.lit("")).alias("value"))
    entries = edges.select("src", "dst").distinct().agg(F.count("*").alias("c"))
    head = entries.select(F.lit(0).cast("long").alias("n"), F.concat_ws(" ", F.lit(vertices).cast("string"), F.col("c").cast("string")).alias("value"))
    head.unionAll(every).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(folder)


def costs_text(found: DataFrame) -> DataFrame:
    """(value): ``v) cost:n`` of a breadth-first search."""
    return found.select(F.format_string("%d) cost:%d", "v", "cost").alias("value"))


def distances_text(found: DataFrame, negative: bool) -> DataFrame:
    """(value): ``v dist``, or one line that says there is a negative cycle."""
    if negative:
        return found.sparkSession.createDataFrame([(NEGATIVE,)], "value string")
    return found.select(F.format_string("%d %d", "v", "dist").alias("value"))


def ranks_text(found: DataFrame) -> DataFrame:
    """(value): ``v rank``."""
    return found.select(F.concat_ws(" ", F.col("v").cast("string"), F.col("rank").cast("string")).alias("value"))


def centroids_text(centroids: list[list[float]]) -> list[str]:
    """A line for each centroid: its number and coordinates."""
    return [" ".join([str(n), *(f"{x:f}" for x in c)]) for n, c in enumerate(centroids)]


def membership_text(found: DataFrame) -> DataFrame:
    """(value): ``id cid``."""
    return found.select(F.format_string("%d %d", "id", "cid").alias("value"))


def write_text(lines: DataFrame, folder: str) -> None:
    lines.write.text(folder)


def write_trace(events: DataFrame, folder: str) -> None:
    """Trace events as lines of JSON."""
    events.write.json(folder)
