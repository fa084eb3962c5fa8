"""Quality by a generalised additive model with pairwise interactions, fitted by cyclic boosting.

Each text gives a few counts and shares. Every feature is cut into bins, and a shape function, a number
for each bin, is grown by adding small trees to one feature after another in turns. The pairs whose grids
take most from what is left get a table of their own in the same way. Scoring is a bin look-up and an
addition for each table. The labelled rows that it learns from are a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.shared import Task, held_out, small_batches
from lattice.llm.text import GRAPH, blocks, span_hashes, spans

_b = np.arange(256)
_KINDS = {
    "letters": ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128),
    "capitals": (_b >= 65) & (_b <= 90),
    "digits": (_b >= 48) & (_b <= 57),
    "stops": np.isin(_b, [33, 44, 46, 58, 59, 63]),
    "marks": np.isin(_b, [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]),
    "bars": _b == 124,
    "shouts": _b == 33,
    "lines": _b == 10,
}
FEATURES = ("words", "word_length", *_KINDS, "bare_marks", "odd_ends", "distinct_words", "distinct_lines", "top_word")


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flag)))[offsets])


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block; zeros for an empty text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, at = spans(buf, offsets, GRAPH)
    count = np.diff(at)
    words = np.maximum(count, 1)
    out = {"words": np.log1p(count), "word_length": _per_text(GRAPH[buf], offsets) / words}
    out |= {k: _per_text(v[buf], offsets) / (words if k == "lines" else size) for k, v in _KINDS.items()}
    letters = np.concatenate(([0], np.cumsum(_KINDS["letters"][buf])))
    out["bare_marks"] = _per_text(letters[ends] == letters[starts], at) / words
    marks = _KINDS["marks"] | _KINDS["shouts"]
    out["odd_ends"] = _per_text(marks[buf[ends - 1]], at) / words if len(ends) else np.zeros(n)
    h = span_hashes(buf, starts, ends)
    l_starts, l_ends, l_at = spans(buf, offsets, _b != 10)
    lines = span_hashes(buf, l_starts, l_ends)
    distinct, top, distinct_lines = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        if count[k]:
            _, c = np.unique(h[at[k] : at[k + 1]], return_counts=True)
            distinct[k], top[k] = len(c) / count[k], c.max() / count[k]
        if l_at[k + 1] > l_at[k]:
            distinct_lines[k] = len(np.unique(lines[l_at[k] : l_at[k + 1]])) / (l_at[k + 1] - l_at[k])
    out |= {"distinct_words": distinct, "distinct_lines": distinct_lines, "top_word": top}
    return np.column_stack([out[k] for k in FEATURES])


@dataclass(frozen=True)
class Model:
    """Bin edges by feature, the tables' values by bin, pair tables by (feature, feature), and the intercept."""

    edges: list
    shapes: list
    pairs: list  # ((i, j), edges of i, edges of j, grid)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, shape) in enumerate(zip(self.edges, self.shapes, strict=True)):
            total += shape[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), a, b, grid in self.pairs:
            total += grid[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The split of ordered bins that gains most: (gain, first bin of the right side)."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * a / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """Values by bin of a tree over ordered bins."""
    gain, k = _cut(g, h, ridge)
    if depth == 0 or gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate((_tree(g[:k], h[:k], ridge, depth - 1), _tree(g[k:], h[k:], ridge, depth - 1)))


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values of a tree that cuts one feature and then the other on each side, by the better order; its gain."""
    best, most = np.zeros_like(g), -1.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, k = _cut(a.sum(1), b.sum(1), ridge)
        out, gain = np.zeros_like(a), 0.0
        for side in (slice(0, k), slice(k, len(a))):
            own_g, own_h = a[side].sum(0), b[side].sum(0)
            if len(a[side]):
                out[side] = _tree(own_g, own_h, ridge, 1)
                gain += float((2 * own_g * out[side][0] - own_h * out[side][0] ** 2).sum())
        if gain > most:
            best, most = (out.T if turned else out), gain
    return best, most


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, grid: int = 8, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, ridge: float = 5.0) -> Model:
    """Fits the shapes, then the pairs, by boosting on the logistic loss. Without rows the score is 1/2; with one class, its smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    k = x.shape[1]
    edges = [_edges(x[:, i], bins) for i in range(k)]
    shapes = [np.zeros(len(e) + 1) for e in edges]
    if not len(y) or y.min() == y.max():
        return Model(edges, shapes, [], base)
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i in range(k):
            g, h = slopes()
            n = len(shapes[i])
            step = rate * _tree(np.bincount(at[i], g, n), np.bincount(at[i], h, n), ridge, 2)
            shapes[i] += step
            total += step[at[i]]
    coarse = [_edges(x[:, i], grid) for i in range(k)]
    cell = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cell[i] * shape[1] + cell[j]
        g, h = slopes()
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape), flat

    ranked = sorted(combinations(range(k), 2), key=lambda ij: -_grid_tree(*sums(*ij)[:2], ridge)[1])[:n_pairs]
    grids = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in ranked}
    for _ in range(rounds // 3):
        for ij in ranked:
            g, h, flat = sums(*ij)
            step = rate * _grid_tree(g, h, ridge)[0]
            grids[ij] += step
            total += step.ravel()[flat]
    return Model(edges, shapes, [(ij, coarse[ij[0]], coarse[ij[1]], grids[ij]) for ij in ranked], base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            x = features(buf, offsets)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows], names=["y", "x"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc_id, y, text) of labelled rows that are not held out, ``max_rows`` of them at most, picked by a hash of the id.

    Several labels of one id count as their majority; of several texts of one id one is taken, the smallest by
    hash. Null ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    picked = known.select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most max_rows rows of 12 bytes
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t"))
    return one.select("doc_id", "y", F.col("t.text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Fits a model on the sample of ``labelled``; the driver holds its features, 17 numbers a row."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, "quality", max_rows).select("y", "text").mapInArrow(Task(_features), "y int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy()))  # the same sums however the rows arrive
    return fit(x[order], rows["y"].to_numpy(float)[order])


def _score(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        for i, j, buf, offsets in blocks(batch):
            score = model.score(features(buf, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null and empty texts get the score of an empty text."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return own.mapInArrow(Task(_score, shared=spark.sparkContext.broadcast(model), threshold=threshold), "doc_id long, held_out boolean, score double, predicted int")
