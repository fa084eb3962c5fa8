"""Queries over every row, against brute force."""

import os

import duckdb
import numpy as np
import pytest

from lattice.plans.registry import BRUTE_FORCE, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def read(query):
    return duckdb.execute(query).fetchall()


@pytest.fixture(scope="module")
def features():
    return np.array([r[0] for r in read(f"select embedding from '{SF}/embeddings.parquet' order by vec_id")], np.float64)


def test_searches_take_every_query_row(spark, features):
    wanted = set(range(0, len(features), 20))
    assert len(wanted) == 25
    got = QUERIES["knn_topk"](spark, SF).collect()
    assert {r.q for r in got} == wanted and len(got) == 4 * len(wanted)
    for q in wanted:
        d = ((features - features[q]) ** 2).sum(1)
        near = sorted((r.rk, r.ref) for r in got if r.q == q)
        assert [ref for _, ref in near] == np.lexsort((np.arange(len(d)), d))[:4].tolist()
    dots = {(r.q, r.ref): r.v for r in QUERIES["neg2_dot"](spark, SF).collect()}
    assert dots.keys() == {(q, ref) for q in wanted for ref in range(len(features))}
    assert all(abs(v + 2 * features[q] @ features[ref]) < 1e-4 for (q, ref), v in dots.items())


def test_merged_trace_has_every_interval(spark):
    (n,), = read(f"select count(*) from '{SF}/events.parquet'")
    got = QUERIES["trace_merge"](spark, SF).collect()
    assert len(got) == 2 * n
    starts = read(f"select event_type, epoch_us(ts) from '{SF}/events.parquet'")
    assert sorted((r.name, r.ts) for r in got if r.ph == "B") == sorted(starts)


@pytest.mark.parametrize("kind", [np.float32, np.float16])
def test_reduced_products_are_over_every_row(spark, features, kind):
    name = {np.float32: "gemm_f32", np.float16: "gemm_f16"}[kind]
    x = features.astype(kind).astype(float)
    got = np.full((64, 64), np.nan)
    for r in QUERIES[name](spark, SF).collect():
        got[r.i, r.j] = r.v
    assert len(x) > 64 and np.abs(got - x.T @ x).max() < 1e-4


@pytest.fixture(scope="module")
def edges():
    out = {}
    for src, dst, w in read(f"select l_orderkey % 1000, l_partkey % 1000, l_quantity from '{SF}/lineitem.parquet'"):
        out[src, dst] = min(int(w), out.get((src, dst), 1 << 30))
    return out


def test_graphs_have_every_line(spark, edges):
    got = {(r.src, r.dst): r.w for r in QUERIES["element_filters"](spark, SF).collect()}
    assert got == {(a, b): w for (a, b), w in edges.items() if a != b}
    dense = QUERIES["graph_dense_row"](spark, SF)
    assert dense.count() == 1000 * 1000
    assert {(r.i, r.j): r.v for r in dense.where("v <> 0").collect()} == edges


def test_paths_over_every_line(spark, edges):
    near, far = {}, {0: 0}
    for (a, b), w in edges.items():
        near.setdefault(a, []).append((b, w))
    hops, front = {0: 0}, [0]
    while front:
        found = {b for a in front for b, _ in near.get(a, ())} - hops.keys()
        hops |= dict.fromkeys(found, max(hops.values()) + 1)
        front = found
    fell = True
    while fell:
        fell = False
        for (a, b), w in edges.items():
            if a in far and far[a] + w < far.get(b, 1 << 30):
                far[b], fell = far[a] + w, True
    assert {r.v: r.dist for r in QUERIES["bellman_ford"](spark, SF).collect()} == {v: far.get(v, 2147483647) for v in range(1000)}
    assert {r.v: r.cost for r in QUERIES["bfs"](spark, SF).collect()} == {v: hops.get(v, -1) for v in range(1000)}


def test_kmeans_runs_to_its_stop(spark, features):
    now, before, changes = features[:4], None, []
    while not changes or changes[-1] / len(features) > 0.001:
        cid = ((features[:, None] - now[None]) ** 2).sum(2).argmin(1)
        changes.append(len(cid) if before is None else int((cid != before).sum()))
        now = np.array([features[cid == c].mean(0) if (cid == c).any() else now[c] for c in range(4)])
        before = cid
    assert len(changes) > 5
    assert [r.changed for r in BRUTE_FORCE["kmeans_delta"](spark, SF).orderBy("round").collect()] == changes
    assert {r.id: r.cid for r in BRUTE_FORCE["kmeans_fit"](spark, SF).collect()} == dict(enumerate(before.tolist()))
