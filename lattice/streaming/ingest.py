"""Append-only ingestion of cells into tiled storage."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CELLS = "i long, j long, v double"


def ingest_cells(spark: SparkSession, source: str, target: str, checkpoint: str, tile: int) -> StreamingQuery:
    """Starts a query that appends Parquet cells arriving in ``source`` to ``target``, a folder for each row of tiles.

    It takes what is there and ends; started again with the same checkpoint it takes what is new, each file once. Reads of
    the target by ``ti`` are pruned to the folders of those tiles.
    """
    cells = spark.readStream.schema(CELLS).parquet(source)
    placed = cells.withColumn("ti", F.expr(f"i div {tile}")).withColumn("tj", F.expr(f"j div {tile}"))
    return placed.writeStream.format("parquet").partitionBy("ti").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_cells(spark: SparkSession, target: str, ti: int | None = None, tj: int | None = None):
    """Cells of the storage, of a row or column of tiles, or of one tile."""
    rows = spark.read.parquet(target)
    for name, at in (("ti", ti), ("tj", tj)):
        if at is not None:
            rows = rows.where(F.col(name) == at)
    return rows.select("i", "j", "v")
