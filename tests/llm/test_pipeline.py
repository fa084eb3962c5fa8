"""The stages of the corpus pipeline on a small corpus with planted cases."""

import os

import numpy as np
import pytest

import corpus_pipeline
from lattice.llm import pii
from lattice.llm.queries import byte_vocabulary
from lattice.llm.tokens import Encoder
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.table(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic, near, cut, clean = (seen[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert 100 < len(toxic) < 200
    classes = brute.jaccard_classes({n: r.text for n, r in toxic.items()})
    assert set(near) == {n for n, (_, c) in classes.items() if c == n}
    assert set(cut) == set(near) and set(clean) == set(near)
    assert all(n == 0 for _, n, _ in brute.hits({n: r.text for n, r in cut.items()}, bench).values())
    assert all(r.n_chars == len(r.text) for r in clean.values())
    changed = [n for n in cut if cut[n].text != clean[n].text]
    assert changed and all(bool(pii.mentions(cut[n].text)) == (n in changed) for n in cut)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    encoder = Encoder(byte_vocabulary())
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    for n, r in clean.items():
        data = np.frombuffer(r.text.encode(), np.uint8)
        assert length[n] == len(encoder(data, np.array([0, len(data)]))[0])
