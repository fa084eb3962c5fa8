"""Tables in the shared folder: they cut lineage, survive lost executors and let sizes be known."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='lattice-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattice-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table() that no later result reads."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lattice-" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a few numbers each up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, marked for broadcast if its known number of rows is within the limit."""
    return F.broadcast(df) if rows <= limit else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of a session whose Python path does not have it."""
    root = Path(__file__).resolve().parents[2]
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    context = spark.sparkContext
    if context.applicationId in _shipped or any(p and Path(p).resolve() == root for p in paths) or not (root / "lattice").is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="lattice-")) / "lattice.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((root / "lattice").rglob("*.py")):
            out.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
