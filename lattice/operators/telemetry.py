"""Stage intervals (stage, seq, start_us, end_us), trace events, run logs and speed-up reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DURATION = r"End-to-end duration: ([0-9.]+) ms"


def stage_durations(intervals: DataFrame) -> DataFrame:
    """(stage, intervals, total_us)."""
    return intervals.groupBy("stage").agg(F.count("*").alias("intervals"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


def rebased(intervals: DataFrame, origin_us: int) -> DataFrame:
    """(stage, seq, place, at_us): start and end of each interval one after the other, from a common origin."""
    both = F.posexplode(F.array(F.col("start_us") - origin_us, F.col("end_us") - origin_us)).alias("place", "at_us")
    return intervals.select("stage", "seq", both)


def trace_events(intervals: DataFrame, pid: int = 0, tid: int = 0) -> DataFrame:
    """(name, ph, pid, tid, ts): a begin and an end event for each interval, as trace viewers read them."""
    both = F.explode(F.array(F.struct(F.lit("B").alias("ph"), F.col("start_us").alias("ts")), F.struct(F.lit("E").alias("ph"), F.col("end_us").alias("ts")))).alias("e")
    return intervals.select(F.col("stage").alias("name"), both).select("name", "e.ph", F.lit(pid).alias("pid"), F.lit(tid).alias("tid"), "e.ts")


def merged(traces: list[DataFrame]) -> DataFrame:
    """Events of several traces; tid is the trace's place in the list."""
    out = None
    for n, t in enumerate(traces):
        own = t.withColumn("tid", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def event_json(events: DataFrame) -> DataFrame:
    """(value): each event as JSON."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def parse_log(lines: DataFrame, order: str, line: str = "line", group: str | None = None) -> DataFrame:
    """(ordinal, seconds), with ``group`` before: durations of the matching lines, numbered from 0 in their order.

    Numbers need all of a log's lines in order; a log is one run's output, and logs are told apart by ``group``.
    """
    found = lines.withColumn("ms", F.regexp_extract(line, DURATION, 1)).where("ms <> ''")
    window = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(order)
    return found.select(*([group] if group else []), (F.row_number().over(window) - 1).alias("ordinal"), (F.col("ms").cast("double") / 1000).alias("seconds"))


def config_matrix(runs: DataFrame, configs: list[str]) -> DataFrame:
    """(app, one column for each config): the mean of ``seconds``."""
    return runs.groupBy("app").pivot("config", configs).agg(F.avg("seconds"))


def speedups(matrix: DataFrame, configs: list[str], baseline: str) -> DataFrame:
    """(app, config, speedup): the baseline's time over the config's."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("config"), F.try_divide(F.col(baseline), F.col(c)).alias("speedup")) for c in configs))).alias("s")
    return matrix.select("app", each).select("app", "s.config", "s.speedup")


def speedup_report(matrix: DataFrame, configs: list[str], baseline: str) -> DataFrame:
    """(config, mean, geomean) of the speed-ups over all apps."""
    own = speedups(matrix, configs, baseline)
    return own.groupBy("config").agg(F.avg("speedup").alias("mean"), F.exp(F.avg(F.ln("speedup"))).alias("geomean"))
