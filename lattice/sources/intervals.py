"""Binary logs of a stage's intervals: a 64-bit count, then that many pairs of start and end in microseconds.

A log may be one file or several that are it one after another, the count first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.plans.storage import drop_table, table
from lattice.sources.binary import open_store

PAIR = 16  # bytes
PIECE = 1 << 20  # pairs that one row of the reader's plan stands for


def read_intervals(spark: SparkSession, path: str | list[str], stage: str) -> DataFrame:
    """(stage, seq, start_us, end_us), seq from 1. Tasks read only the bytes of their pieces."""
    pieces, seq, count = [], 0, 0
    for n, p in enumerate([path] if isinstance(path, str) else path):
        fs, at = open_store(p)
        head = 0 if n else 8
        if not n:
            with fs.open_input_file(at) as file:
                count = int(np.frombuffer(file.read_at(8, 0), "<u8")[0])
        held = min((fs.get_file_info(at).size - head) // PAIR, count - seq)
        pieces += [(p, head + PAIR * k, seq + k, min(PIECE, held - k)) for k in range(0, held, PIECE)]
        seq += held
    if seq < count:
        raise ValueError(f"{path} is cut off")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, start, before, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_store(p)
                with fs.open_input_file(at) as file:
                    pairs = np.frombuffer(file.read_at(PAIR * n, start), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"seq": np.arange(before + 1, before + n + 1), "start_us": pairs[:, 0], "end_us": pairs[:, 1]})

    rows = spark.createDataFrame(pieces, "path string, start long, before long, n long").repartition(max(1, len(pieces)))
    return rows.mapInArrow(read, "seq long, start_us long, end_us long").select(F.lit(stage).alias("stage"), "seq", "start_us", "end_us")


def write_intervals(intervals: DataFrame, folder: str) -> list[str]:
    """One stage's intervals in order of seq as the files of such a log: the count, then a file for each task's range of seq.

    Null times are written as 0. What a lost task left is not listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, first, n = f"{folder}/part-{uuid.uuid4().hex}.bin", None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                fs, at = open_store(path)
                fs.create_dir(at.rsplit("/", 1)[0])
                file, first = fs.open_output_stream(at), batch.column(0)[0].as_py()
            file.write(np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).astype("<i8").tobytes())
            n += batch.num_rows
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "n": pa.array([n], pa.int64()), "path": [path]})

    own = intervals.select("seq", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("start_us", "end_us")))
    parts = table(own.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(write, "first long, n long, path string"), "parts")
    listed = parts.orderBy(F.asc_nulls_first("first")).collect()  # one for each task
    drop_table(parts)
    head = f"{folder}/count-{uuid.uuid4().hex}.bin"
    fs, at = open_store(head)
    fs.create_dir(at.rsplit("/", 1)[0])
    with fs.open_output_stream(at) as file:
        file.write(np.array([sum(r["n"] for r in listed)], "<u8").tobytes())
    return [head, *(r["path"] for r in listed)]
