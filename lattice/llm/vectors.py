"""Exact near-duplicates of vectors by cosine, with PCA-ordered, tiled comparison.

Unit vectors are turned onto the principal axes of the whole table, leading axes first, and dealt into
tiles by ranges of the first. Of each tile the ranges on LEAD axes and of the rest's norm are known; two tiles
whose ranges bound every product below the threshold never meet. Other pairs of tiles are compared a
block at a time: products of the leading dimensions are accumulated, the rest is bounded by the product
of the suffixes' norms, and a pair is dropped as soon as it cannot reach the threshold. All bounds leave
SLACK for rounding; what is left is decided by the cosine of the vectors as they came, by one formula in
double precision, so neither the axes nor the tiles have a say in it.

Equal vectors are one node with a count. A tile pair returns for each node with links their number and a
root that stands for those it is joined to there, never the pairs. A node is sent to each tile pair that it
is in, so the rows moved are nodes times tiles near them; ``tile`` sets that against a task's memory
(two tiles of doubles and a block of products). Where no axis parts the vectors, all tiles meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.shared import Task, components, components_sql, drop_table, table

BLOCK = 512  # rows of a block of products
STAGES = (16, 32, 48)  # dimensions after which pairs are dropped
LEAD = 4  # axes whose ranges part tiles
SLACK = 1e-9  # for rounding, in bounds


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, k1, k2, e): 128 bits of the vector's values and the vector, scaled by a power of two; nulls if it links with nothing."""
    for batch in batches:
        rows, keys = [], []
        for v in batch.column(1):
            x = np.array([np.nan if y is None else y for y in v.as_py()], float) if v.is_valid else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                rows.append(None)
                keys.append((None, None))
                continue
            x = np.ldexp(x, -np.frexp(top)[1]) + 0.0  # exact, and squares neither overflow nor vanish; no -0
            rows.append(x)
            keys.append(tuple(np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64).tolist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[n] for k in keys], pa.int64()) for n in (0, 1)), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "k1", "k2", "e"])


def _unit(e: np.ndarray) -> np.ndarray:
    return e / np.sqrt((e * e).sum(1))[:, None]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moments(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dims, dims))
    for batch in batches:
        x = _unit(_matrix(batch.column(0), dims))
        total += x.T @ x
    yield pa.RecordBatch.from_pydict({"place": np.arange(dims * dims), "v": total.ravel()})


def _turn(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(e, more) to (more, e, lead): the places on the leading axes, and last the norm of the rest."""
    for batch in batches:
        z = _unit(_matrix(batch.column(0), len(axes))) @ axes
        lead = np.column_stack((z[:, :LEAD], np.sqrt((z[:, LEAD:] ** 2).sum(1))))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], batch.column(0), pa.array(list(lead), pa.list_(pa.float64()))], names=[*batch.schema.names[1:], "e", "lead"])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows, pair by pair."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two blocks of turned unit vectors whose product may be the threshold, by leading dimensions first."""
    cuts = [k for k in STAGES if k < a.shape[1]]
    slack = threshold - SLACK
    if not cuts:
        return np.nonzero(a @ b.T >= slack)
    tails = [tuple(np.sqrt((x[:, k:] ** 2).sum(1)) for x in (a, b)) for k in cuts]
    part = a[:, : cuts[0]] @ b[:, : cuts[0]].T
    ta, tb = tails[0]
    i, j = np.nonzero(part + np.outer(ta, tb) >= slack)
    if len(i) > 0.02 * part.size:  # most of the block is alike: a whole product costs less than gathering
        return np.nonzero(a @ b.T >= slack)
    value = part[i, j]
    for n, k in enumerate(cuts):
        to = cuts[n + 1] if n + 1 < len(cuts) else a.shape[1]
        value = value + np.einsum("ij,ij->i", a[i, k:to], b[j, k:to])
        tail = tails[n + 1][0][i] * tails[n + 1][1][j] if n + 1 < len(cuts) else 0.0
        live = value + tail >= slack
        i, j, value = i[live], j[live], value[live]
    return i, j


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (each node's smallest known fellow) after joining the pairs."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _compare(pair: pa.Table, threshold: float, axes: np.ndarray) -> pa.Table:
    """Rows (p, q, tile, node, copies, e) of two tiles, or one with itself: (node, links, root) of nodes with links."""
    p, q = pair["p"][0].as_py(), pair["q"][0].as_py()
    pair = pair.sort_by([("tile", "ascending"), ("node", "ascending")]).combine_chunks()
    e = _matrix(pair["e"].chunk(0), len(axes))
    z = _unit(e) @ axes
    copies, node, tile = (pair[c].to_numpy() for c in ("copies", "node", "tile"))
    cut = int((tile == p).sum())
    links, root = np.zeros(len(z), np.int64), np.arange(len(z))
    for s in range(0, cut, BLOCK):
        for t in range(s if p == q else cut, len(z), BLOCK):
            i, j = near_pairs(z[s : min(s + BLOCK, cut)], z[t : t + BLOCK], threshold)
            i, j = i + s, j + t
            if p == q:
                i, j = i[i < j], j[i < j]
            real = cosines(e[i], e[j]) >= threshold
            i, j = i[real], j[real]
            links += np.bincount(i, copies[j], len(z)).astype(np.int64) + np.bincount(j, copies[i], len(z)).astype(np.int64)
            root = join_roots(root, i, j)
    at = np.flatnonzero(links)
    return pa.table({"node": node[at], "links": links[at], "root": node[root[at]]})


def meeting(low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """For each tile the tiles that a product of the threshold may be with, from the ranges of all (tiles x LEAD + 1, the norm of the rest last)."""
    out = np.zeros((len(low), len(low)), bool)
    for t in range(len(low)):
        ends = [low[t, :-1] * low[:, :-1], low[t, :-1] * high[:, :-1], high[t, :-1] * low[:, :-1], high[t, :-1] * high[:, :-1]]
        out[t] = np.max(ends, axis=0).sum(1) + high[t, -1] * high[:, -1] >= threshold - SLACK
    return out


def _linked(nodes: DataFrame, dims: int, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(node, links, root) by tile pair, of nodes (e, node, copies) of one dimension, and a table that it reads."""
    spark = nodes.sparkSession
    rows = nodes.select("e").mapInArrow(Task(_moments, dims=dims), "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros(dims * dims)
    for place, v in rows:
        moments[place] = v
    axes = np.ascontiguousarray(np.linalg.eigh(moments.reshape(dims, dims))[1][:, ::-1])
    turned = table(nodes.select("e", "node", "copies").mapInArrow(Task(_turn, axes=axes), "node long, copies long, e array<double>, lead array<double>"), "turned")
    n = turned.count()
    tiles = max(1, -(-n // tile))
    first = F.col("lead")[0]
    cuts = sorted(set(turned.select(first.alias("x")).approxQuantile("x", [k / tiles for k in range(1, tiles)], 0.2 / tiles))) if tiles > 1 else []
    edges = F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>")
    # Ties on the first axis make a range too full: it is dealt out by a hash into tiles of its own.
    placed = turned.withColumn("range", F.size(F.filter(edges, lambda c: c <= first)))
    full = {r["range"]: max(1, -(-r["n"] // (2 * tile))) for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row for each range
    base = np.cumsum([0, *(full.get(k, 1) for k in range(len(cuts) + 1))]).tolist()
    of = spark.createDataFrame([(k, base[k], full.get(k, 1)) for k in range(len(cuts) + 1)], "range int, base int, parts int")
    placed = placed.join(F.broadcast(of), "range").withColumn("tile", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    bounds = placed.groupBy("tile").agg(*(f(F.col("lead")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(min(LEAD, dims) + 1))).orderBy("tile").collect()  # a row for each tile
    low, high = (np.array([[r[f"{name}{k}"] for k in range(min(LEAD, dims) + 1)] for r in bounds]).reshape(len(bounds), -1) for name in ("low", "high"))
    name = [r["tile"] for r in bounds]
    near = meeting(low, high, threshold) if len(bounds) else np.zeros((0, 0), bool)
    ranges = spark.createDataFrame([(name[t], [name[u] for u in np.flatnonzero(near[t]).tolist()]) for t in range(len(name))], "tile int, others array<int>")
    sent = placed.join(F.broadcast(ranges), "tile")  # a row for each tile, made from the driver's own bounds
    sent = sent.select("tile", "node", "copies", "e", F.explode("others").alias("other"))
    sent = sent.select(F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", "copies", "e")
    return sent.groupBy("p", "q").applyInArrow(lambda pair: _compare(pair, threshold, axes), "node long, links long, root long"), turned


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two vectors link when their cosine is at least ``threshold``; equal ones do. Null and zero vectors and
    those with null or non-finite components link with nothing and are their own component. Vectors of
    different lengths do not link. A null vec_id is larger than any other; such a row is kept if nothing
    else is in its component. Rows of one vec_id are vectors of their own.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = table(own.mapInArrow(Task(_named), "vec_id long, k1 long, k2 long, e array<double>"), "vectors")
    groups = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("e").alias("e"))
    once = table(groups, "groups")
    nodes = table(once.withColumn("node", F.monotonically_increasing_id()), "nodes")
    drop_table(once)
    found, read = None, []
    for (dims,) in sorted(nodes.select(F.size("e")).distinct().collect()):  # lengths of vectors: one, as a rule
        part, turned = _linked(nodes.where(F.size("e") == dims), dims, threshold, tile)
        read.append(turned)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = table(found, "linked")
    for t in read:
        drop_table(t)
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "k1", "k2", "least", "copies").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "k1", "k2").join(labels, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def oracle_sql(threshold: float = 0.9) -> str:
    """The same in DuckDB, every pair compared; for tables whose vec_id is a key."""
    return f"""WITH RECURSIVE own AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        fit AS MATERIALIZED (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM own
            WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM fit a JOIN fit b ON a.id < b.id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {threshold}),
        {components_sql("own", "links")},
        counted AS (SELECT a, count(*) AS n FROM both_ GROUP BY 1)
        SELECT t.node AS vec_id, coalesce(c.n, 0) AS n_links, t.component AS component_id, t.node = t.component AS kept
        FROM top t LEFT JOIN counted c ON c.a = t.node"""
