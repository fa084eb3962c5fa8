"""Similarity joins of texts and vectors."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lattice.llm import ngramjoin, vectors
from lattice.llm.shared import components
from lattice.llm.text import GRAPH, words_of
from tests.llm import brute
from tests.llm.conftest import ODD, prose


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-40, 120), rng.randrange(-40, 120)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in brute.roots(range(-50, 300), edges).items() if n in linked}


def copies(seed=0):
    """Texts with exact copies, copies a few words away from one another, chains of them, and passages that many share."""
    rng = random.Random(seed)
    passage, texts = prose(60, 999, 5000), []
    for k in range(12):
        base = prose(rng.randrange(1, 160), k, 5000)
        texts.append(base)
        for _ in range(rng.randrange(6)):
            base = list(base)
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = f"new{rng.randrange(10**6)}"
            texts.append(base)
    for k in range(12):
        own = prose(rng.randrange(5, 40), 500 + k, 5000)
        texts.append(own + passage + own[:3])
    rng.shuffle(texts)
    return {n: " ".join(t) for n, t in enumerate(texts)}


def test_jaccard_classes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FIRST", 1)  # fewer comparisons before tiles and whole classes
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.classes(docs).collect()}
    assert got == brute.jaccard_classes(texts)
    assert len({c for _, c in got.values()}) < len(texts)


def test_near_copies_without_ids_link(spark):
    base = prose(120, 4)
    near = [" ".join([*base[:k], f"other{k}", *base[k + 1 :]]) for k in (30, 60)]
    far = " ".join(prose(120, 5))
    docs = spark.createDataFrame([(7, " ".join(base)), (None, near[0]), (None, near[1]), (None, far)], "doc_id long, text string")
    got = ngramjoin.classes(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 7), (0, 7), (7, 7)]


def test_classes_of_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.classes(odd).collect()), key=repr)
    want = [(d, len(brute.shingles(t)), 1 if d == 5 else d) for d, t in ODD]
    assert got == sorted(want, key=repr)
    kept = ngramjoin.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [-9, 1, 2, 3, 6, 7, 8] and kept.where("doc_id is null").count() == 1
    assert ngramjoin.classes(none).collect() == []
    assert ngramjoin.keep_one(none).collect() == []


def sets_of(*texts):
    out = []
    for t in texts:
        w = words_of(t, GRAPH)
        out += ngramjoin.shingle_sets(w, np.array([0, len(w)]))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_signatures_bound_overlaps_from_above(seed):
    texts = list(copies(seed).values())
    sets = sets_of(*texts)
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    found = ngramjoin.Signatures(pa.array([ngramjoin.signature(s) for s in sets], pa.binary()), np.array([len(s) for s in sets]))
    i, j = np.triu_indices(len(sets), 1)
    bound = found.most_shared(i, j)
    exact = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (bound >= exact).all()


def test_a_class_against_a_set():
    base = prose(100, 1, 5000)
    near = base[:50] + ["x"] + base[51:]
    far = prose(100, 2, 5000)
    a, b, c = sets_of(*(" ".join(t) for t in (base, far, near)))
    members = ngramjoin.Members(80)
    members.add(b, 2)
    members.add(a, 1)
    assert members.linked(c) == 1
    assert members.linked(sets_of(" ".join(prose(100, 3, 5000)))[0]) is None


def brute_vectors(rows, threshold=0.9):
    unit = {}
    for n, v in rows:
        x = np.array([np.nan if y is None else y for y in v], float) if v else np.zeros(1)
        if np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            unit[n] = x / np.linalg.norm(x)
    ids = sorted(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    top = brute.roots([n for n, _ in rows], links)
    count = dict.fromkeys(top, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {n: (count[n], top[n], n == top[n]) for n in top}


@pytest.mark.parametrize("tile", [4096, 16])
def test_near_vectors_against_brute_force(spark, tile):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 5)):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.uniform(0, 0.6)).tolist()))
    rows += [(1000 + k, rows[3][1]) for k in range(5)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23), (2004, [float("inf")] * 24), (2005, [1e200] * 24), (2006, [1e-200] * 24), (2007, [1.0, 2.0]), (2008, [2.0, 4.0]), (2009, [])]
    df = spark.createDataFrame([(n, v, "x") for n, v in rows], "vec_id long, embedding array<double>, component_id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, tile=tile).collect()}
    assert got == brute_vectors(rows)
    assert sum(c[0] > 0 for c in got.values()) > 20


def test_vectors_with_odd_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 1, None, True), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, True)], key=repr)
    assert vectors.near_duplicates(df.where("false")).collect() == []


def test_blocks_of_products():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 64))
    x[100:] = x[:100] + rng.normal(size=(100, 64)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    for a, b in ((x, x), (x[:5], x[:5]), (x[:3, :8], x[:3, :8])):
        i, j = vectors.near_pairs(a, b, 0.9)
        assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(k.tolist() for k in np.nonzero(a @ b.T >= 0.9)), strict=True)}


def test_pairs_at_the_threshold_link_whatever_the_axes(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0, 0.0, 0.0, 0.0]), (1, [9.0, 4.0, 1.0, 1.0, 1.0])]  # 9 / 10
    rows += [(2 + k, rng.normal(size=5).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, tile=16).collect()}
    assert got[0] >= 1 and got[1] >= 1


def test_ties_on_all_axes_are_split(spark):
    rows = [(k, [1.0 if c == k % 40 else 0.0 for c in range(40)]) for k in range(40)] + [(100 + k, [0.0] * 39 + [1.0 + k]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, tile=8).collect()}
    assert got[39] == (50, 39) and got[120] == (50, 39) and got[0] == (0, 0)


def test_tiles_that_meet_have_all_near_pairs():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(30, 12)) * 0.1 + rng.normal(size=12) for _ in range(6)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x @ np.linalg.eigh(x.T @ x)[1][:, ::-1]
    lead = np.column_stack((x[:, : vectors.LEAD], np.sqrt((x[:, vectors.LEAD :] ** 2).sum(1))))
    tile = np.argsort(np.argsort(x[:, 0])) // 20
    low, high = (np.array([f(lead[tile == t], axis=0) for t in range(9)]) for f in (np.min, np.max))
    met = vectors.meeting(low, high, 0.9)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert met[tile[i], tile[j]].all() and not met.all()


def test_words_made_to_collide_are_different_sets(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngramjoin.classes(docs).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_kept_rows_whatever_the_columns_are_called(spark, odd):
    own = odd.withColumn("_kept", odd.n).withColumn("rep", odd.n)
    assert ngramjoin.keep_one(own).columns == own.columns and ngramjoin.keep_one(own).count() == ngramjoin.keep_one(odd).count()
