"""What the operators share: batches, linked components, held-out rows; tables in the shared folder from the array side."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.plans.storage import drop_table, fresh_path, ship, table

__all__ = ["Task", "LOWER_SQL", "components", "components_sql", "drop_table", "fresh_path", "held_out", "small_batches", "table"]


class Task:
    """A function of batches for mapInArrow. At its end the worker, which outlives the task, gives freed memory back to the system."""

    def __init__(self, function: Callable, **options):
        self.function, self.options = function, options

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from self.function(batches, **self.options)
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: texts are long, and a batch is held whole. A smaller setting of the user's stays. Ships the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if not 0 < have <= rows:
        spark.conf.set(key, str(rows))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): component is the smallest node it is joined to.

    Alternates the large-star and small-star steps, each a grouped minimum and a join, so no node's
    neighbours are ever gathered in one row. Each round is a table in the shared folder.
    """
    work = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    work = table(work, "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(work)
    for _ in range(rounds):
        both = work.select("u", "v").unionAll(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large.u == low.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = table(small.unionAll(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = mark(after)
        drop_table(work)
        work = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = work.groupBy("u").agg(F.min("v").alias("component"))
    roots = work.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.select(F.col("u").alias("node"), "component").unionAll(roots)


#: A text in DuckDB with A-Z lower-cased; null is empty.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def components_sql(nodes: str, links: str) -> str:
    """DuckDB: expressions ``both_`` and ``reach`` of a recursive WITH, then ``top`` (node, component), of nodes (id) and links (a, b)."""
    return f"""both_ AS MATERIALIZED (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
        reach(node, other) AS (SELECT a, b FROM both_ UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON e.a = r.other),
        top AS (SELECT n.id AS node, least(n.id, coalesce(min(r.other), n.id)) AS component FROM {nodes} n LEFT JOIN reach r ON r.node = n.id GROUP BY n.id)"""
