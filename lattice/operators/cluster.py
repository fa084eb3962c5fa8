"""k-means and exact nearest neighbours over points (id, features)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Centroids = list[list[float]]

CHUNK = 1 << 20  # numbers of a matrix that a task makes at once


def seeds(points: DataFrame, k: int) -> Centroids:
    """Features of the points with ids 0..k-1."""
    return [r[0] for r in points.where(F.col("id") < k).orderBy("id").select("features").collect()]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row by squared distance; the lower number wins a tie."""
    out = np.zeros(len(x), np.int64)
    step = max(1, CHUNK // max(1, x.shape[1]))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        out[s : s + step] = np.argmin(np.stack([((part - c) ** 2).sum(1) for c in centroids]), axis=0)
    return out


def _rows(points: DataFrame) -> DataFrame:
    return points.select("id", F.col("features").cast("array<double>").alias("features"))


def assign(points: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cid). The centroids, k times the dimension, are broadcast."""
    shared = points.sparkSession.sparkContext.broadcast(np.array(centroids, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "cid": pa.array(nearest(_matrix(batch.column(1)), shared.value), pa.int32())})

    return _rows(points).mapInArrow(run, "id long, cid int")


def _sums(points: DataFrame, now: Centroids, before: Centroids | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums and counts of the centroids' points, and how many points are not where ``before`` had them: one pass, one array for each task."""
    shared = points.sparkSession.sparkContext.broadcast((np.array(now, float), None if before is None else np.array(before, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = shared.value
        total, count, moved = np.zeros(now.shape), np.zeros(len(now), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cid = nearest(x, now)
                moved += len(x) if before is None else int((cid != nearest(x, before)).sum())
                count += np.bincount(cid, minlength=len(now))
                for c in np.unique(cid).tolist():
                    total[c] += x[cid == c].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary()), pa.array([moved], pa.int64())], names=["total", "count", "moved"])

    total, count, moved = np.zeros((len(now), len(now[0]))), np.zeros(len(now), np.int64), 0
    parts = _rows(points).mapInArrow(run, "total binary, count binary, moved long")
    for r in parts.toLocalIterator():  # an array for each task, one task's at a time
        total += np.frombuffer(r["total"]).reshape(total.shape)
        count += np.frombuffer(r["count"], np.int64)
        moved += r["moved"]
    return total, count, moved


def _means(now: Centroids, total: np.ndarray, count: np.ndarray) -> Centroids:
    return [(total[c] / count[c]).tolist() if count[c] else list(now[c]) for c in range(len(now))]


def step(points: DataFrame, centroids: Centroids) -> DataFrame:
    """(cid, dim, v): the means of the centroids' points; one without points stays where it is."""
    total, count, _ = _sums(points, centroids, None)
    rows = [(c, d, float(v)) for c, row in enumerate(_means(centroids, total, count)) for d, v in enumerate(row)]
    return points.sparkSession.createDataFrame(rows, "cid int, dim int, v double")


def fit(points: DataFrame, k: int, threshold: float = 0.001, limit: int = 500) -> tuple[DataFrame, Centroids, list[int]]:
    """(assignments, centroids, points that changed their centroid in each round).

    Starts from the first k points, for whom no point had a centroid, and goes on while the share of points that changed is
    above the threshold, ``limit`` rounds beyond the first at most. The assignments are those of the last
    round, to the centroids before its update. A round is one pass over the points: each task gives one
    array of sums, so neither the plan nor the rows that move grow with the dimension.
    """
    points = points.persist()
    total = points.count()
    before, now, changes = None, seeds(points, k), []
    while True:
        sums, count, moved = _sums(points, now, before)
        changes.append(moved)
        before, now = now, _means(now, sums, count)
        if moved / max(total, 1) <= threshold or len(changes) > limit:
            break
    points.unpersist()
    return assign(points, before), now, changes


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of the queries in blocks of about so many bytes; the driver holds one."""
    names, rows, size = [], [], 0
    for r in queries.select("id", "features").toLocalIterator():
        names.append(r[0])
        rows.append(np.array(r[1], float))
        size += rows[-1].nbytes + 8
        if size >= block_bytes:
            yield np.array(names, np.int64), np.stack(rows)
            names, rows, size = [], [], 0
    if rows:
        yield np.array(names, np.int64), np.stack(rows)


def knn(refs: DataFrame, queries: DataFrame, k: int, block_bytes: int = 64 << 20) -> DataFrame:
    """(q, rk, ref, dist): the k nearest references of each query by Euclidean distance, rk from 0; ties go to the smaller reference.

    Queries, a stated set, are broadcast in blocks of so many bytes, with one pass over the references for each. A
    matrix product bounds the distances; those that may be among the k least are then taken exactly. Each task keeps its own k
    best for each query, so k rows for each task and query are moved, not all distances.
    """
    near = None
    for names, x in query_blocks(queries, block_bytes):
        part = _nearest_rows(refs, names, x, k)
        near = part if near is None else near.unionAll(part)
    if near is None:
        return refs.sparkSession.createDataFrame([], "q long, rk int, ref long, dist double")
    ranked = near.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("d", "ref")) - 1).where(F.col("rk") < k)
    return ranked.select("q", "rk", "ref", F.sqrt("d").alias("dist"))


def _nearest_rows(refs: DataFrame, names: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    shared = refs.sparkSession.sparkContext.broadcast((names, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = shared.value
        norm = (x * x).sum(1)
        best_d, best_r = np.full((len(names), k), np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, y = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for s in range(0, len(ids), step := max(1, CHUNK // max(len(names), y.shape[1]))):
                part = y[s : s + step]
                size = (part * part).sum(1)
                about = norm[:, None] + size[None] - 2 * (x @ part.T)
                slack = 1e-9 * (norm[:, None] + size[None]) + 1e-300
                bound = np.minimum(best_d[:, -1], np.partition(about + slack, min(k, len(part)) - 1, axis=1)[:, min(k, len(part)) - 1] if len(part) >= k else np.inf)
                q, r = np.nonzero(about - slack <= bound[:, None])
                for a in range(0, len(q), wide := max(1, CHUNK // x.shape[1])):
                    about[q[a : a + wide], r[a : a + wide]] = ((x[q[a : a + wide]] - part[r[a : a + wide]]) ** 2).sum(1)
                for n in np.unique(q).tolist():
                    own = r[q == n] if len(names) < 64 else r[np.searchsorted(q, n) : np.searchsorted(q, n, side="right")]
                    d, i = np.concatenate((best_d[n], about[n, own])), np.concatenate((best_r[n], ids[s : s + step][own]))
                    order = np.lexsort((i, d))[:k]
                    best_d[n], best_r[n] = d[order], i[order]
        found = np.isfinite(best_d)
        yield pa.RecordBatch.from_pydict({"q": np.repeat(names, found.sum(1)), "ref": best_r[found], "d": best_d[found]})

    return _rows(refs).mapInArrow(run, "q long, ref long, d double")
