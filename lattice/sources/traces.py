"""Trace events as one JSON array, the form that trace viewers open, and from folders of interval logs to such a file."""

from __future__ import annotations

import json

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from lattice.operators.telemetry import merged, trace_events
from lattice.sources.binary import open_store
from lattice.sources.intervals import read_intervals

EVENT = "name string, ph string, pid long, tid long, ts long"
SUFFIX = "_ts.bin"


def write_trace_array(events: DataFrame, path: str) -> None:
    """All events as one array indented by four; they come to the writer partition by partition, not all at once."""
    fs, at = open_store(path)
    with fs.open_output_stream(at) as file:
        between = "[\n"
        for row in events.toLocalIterator():
            event = json.dumps(row.asDict(), indent=4).replace("\n", "\n    ")
            file.write(f"{between}    {event}".encode())
            between = ",\n"
        file.write(b"[]" if between == "[\n" else b"\n]")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of such a file."""
    return spark.read.schema(EVENT).json(path, multiLine=True)


def trace_of_logs(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Events of every ``<stage>_ts.bin`` in the folders; tid is the folder's place in the list."""
    traces = []
    for folder in folders:
        fs, at = open_store(folder)
        names = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if f.path.endswith(SUFFIX))
        own = None
        for name in names:
            last = name.rsplit("/", 1)[1]
            events = trace_events(read_intervals(spark, f"{folder.rstrip('/')}/{last}", last.removesuffix(SUFFIX)))
            own = events if own is None else own.unionAll(events)
        traces.append(spark.createDataFrame([], EVENT) if own is None else own)
    return merged(traces)
