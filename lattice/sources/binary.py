"""Headerless little-endian arrays: a data source that reads row ranges, and writers of numbered parts.

Files are opened through ``pyarrow.fs``, so a path may be a local one or a URI of a store that all executors
reach. A matrix is written as parts of whole rows in order; one after another they are the row-major file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattice.plans.meta import ArrayMeta
from lattice.plans.storage import table

DTYPES = {"double": ("<f8", "double"), "float": ("<f4", "double"), "long": ("<i8", "long")}


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


class _Rows(InputPartition):
    def __init__(self, path: str, before: int, first: int, stop: int):
        super().__init__((path, first, stop))
        self.path, self.before, self.first, self.stop = path, before, first, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.cols = int(options["cols"])
        self.kind, _ = DTYPES[options.get("dtype", "double")]
        self.width = np.dtype(self.kind).itemsize
        self.files, rows = [], 0  # (path, rows in the files before, rows)
        for path in options["path"].split("\n"):
            fs, at = open_store(path)
            held = fs.get_file_info(at).size // (self.width * self.cols)
            self.files.append((path, rows, held))
            rows += held
        self.rows = int(options.get("rows", rows))
        if rows < self.rows:
            raise ValueError(f"{options['path']} has {rows} rows of {self.cols}, fewer than {self.rows}")
        self.stripe = int(options.get("stripe", max(1, (1 << 24) // (self.cols * self.width))))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, before, held in self.files:
            held = min(held, self.rows - before)
            out += [_Rows(path, before, r, min(r + self.stripe, held)) for r in range(0, held, self.stripe)]
        return out

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        fs, at = open_store(partition.path)
        with fs.open_input_file(at) as file:
            step = max(1, (1 << 20) // (self.cols * self.width))
            for r in range(partition.first, partition.stop, step):
                stop = min(r + step, partition.stop)
                data = np.frombuffer(file.read_at((stop - r) * self.cols * self.width, r * self.cols * self.width), self.kind)
                v = data.astype(np.int64 if self.kind == "<i8" else np.float64)
                yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(partition.before + r, partition.before + stop), self.cols), "j": np.tile(np.arange(self.cols), stop - r), "v": v})


class MatrixSource(DataSource):
    """``lattice_matrix``: options path (of parts in order: one a line), cols, dtype (double, float, long), rows, stripe (rows of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "lattice_matrix"

    def schema(self) -> str:
        return f"i long, j long, v {DTYPES[self.options.get('dtype', 'double')][1]}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_matrix(spark: SparkSession, path: str | list[str], cols: int, dtype: str = "double", **options) -> DataFrame:
    """Cells (i, j, v) of a row-major file or of its parts in order; every stripe of rows is a partition that reads only its bytes."""
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("lattice_matrix").option("path", path if isinstance(path, str) else "\n".join(path)).option("cols", cols).option("dtype", dtype)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_points(spark: SparkSession, path: str | list[str], dims: int, **options) -> DataFrame:
    """(id, features) of a file of points, one after another."""
    cells = read_matrix(spark, path, dims, **options)
    return cells.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x.v).alias("features"))


def read_tensor(spark: SparkSession, path: str | list[str], side: int, **options) -> DataFrame:
    """Cells (n, m, k, v) of a cube with k fastest."""
    cells = read_matrix(spark, path, side, **options)
    return cells.select(F.expr(f"i div {side}").alias("n"), (F.col("i") % side).alias("m"), F.col("j").alias("k"), "v")


def write_matrix(cells: DataFrame, meta: ArrayMeta, folder: str, dtype: str = "double", stripe: int = 1024) -> list[str]:
    """Writes dense cells as parts of ``stripe`` rows; their paths in order. A part is whole or, after a lost task, an orphan that is not listed."""
    kind, cols, rows = DTYPES[dtype][0], meta.shape[1], meta.shape[0]

    def write(group: pa.Table) -> pa.Table:
        s = group["s"][0].as_py()
        out = np.zeros((min(stripe, rows - s * stripe), cols), kind)
        out[group["i"].to_numpy() - s * stripe, group["j"].to_numpy()] = group["v"].to_numpy()
        path = f"{folder}/part-{s:08d}-{uuid.uuid4().hex}.bin"
        fs, at = open_store(path)
        fs.create_dir(at.rsplit("/", 1)[0])
        with fs.open_output_stream(at) as file:
            file.write(out.tobytes())
        return pa.table({"s": [s], "path": [path]})

    parts = table(cells.withColumn("s", F.expr(f"i div {stripe}")).groupBy("s").applyInArrow(write, "s long, path string"), "parts")
    return [r["path"] for r in parts.orderBy("s").collect()]  # one for each stripe


def write_knn(found: DataFrame, k: int, queries: int, folder: str) -> tuple[list[str], list[str]]:
    """Distances and indices of (q, rk, ref, dist) as two matrices of k rows and a column for each query, numbered in order of id."""
    meta = ArrayMeta((k, queries), (k, queries))
    ids = found.select("q").distinct()
    cells = found.join(_numbered(ids), "q").select(F.col("rk").cast("long").alias("i"), "j", "ref", "dist")
    return (
        write_matrix(cells.select("i", "j", F.col("dist").alias("v")), meta, f"{folder}/knn_dist"),
        write_matrix(cells.select("i", "j", F.col("ref").alias("v")), meta, f"{folder}/knn_index", "long"),
    )


def _numbered(ids: DataFrame) -> DataFrame:
    """(q, j): ids numbered in order. The queries are a stated set of bounded size."""
    rows = sorted(r[0] for r in ids.collect())
    return ids.sparkSession.createDataFrame([(q, n) for n, q in enumerate(rows)], "q long, j long")
