"""Tokenising, packing and files of token ids."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattice.llm import idfiles, packing, tokens
from lattice.llm.queries import byte_vocabulary, word_vocabulary
from lattice.llm.tokens import Encoder
from tests.llm.conftest import ODD

ODD_TEXTS = ["", "  a  b", "a b c d", "it's  'tis don't\n\n x\n y \n", "x\r\ny\tz  ", "Ünï—,a — b×3÷2 ñ1é,É", "Ελλάς, ΣΑΣ. a", "é ́x á,", "<|endoftext|> a<|endoftext|>", "\n", "a\n　b 　", "日本語 テスト,", "a\x1cb \x1c c", "İI ſK", "１２ ²a½", "a\u0085 b"]


@pytest.fixture(scope="module", params=[byte_vocabulary, word_vocabulary])
def encoder(request):
    return Encoder(request.param())


def encode(encoder, text):
    data = np.frombuffer(text.encode(), np.uint8)
    ids, at = encoder(data, np.array([0, len(data)]))
    return ids.tolist()


def plain(encoder, text):
    return [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, encoder.vocabulary.end_id]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_are_the_tokenizers_own(encoder, text):
    assert encode(encoder, text) == plain(encoder, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z'sé,.\n\t 1 —日İΣ!|#"), max_size=24))
def test_ids_of_any_text(text):
    for v in (byte_vocabulary(), word_vocabulary()):
        e = _shared.setdefault(v, Encoder(v))
        assert encode(e, text) == plain(e, text)


_shared: dict = {}


def test_a_full_memo_starts_anew():
    e = Encoder(byte_vocabulary(), keep=3)
    for text in ODD_TEXTS * 2:
        assert encode(e, text) == plain(e, text)


def naive_best_fit(lengths, size):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(size - n)
    return len(left)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_packs_as_the_plain_one(lengths):
    bins, offsets = packing.best_fit_decreasing(np.array(lengths, np.int64), 16)
    used = {}
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths, strict=True)):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert all(x <= 16 for x in used.values())
    assert len(used) == naive_best_fit(lengths, 16)


def test_pieces_and_sequences(odd, encoder, none):
    size = 64
    got = packing.pack(odd, encoder.vocabulary, size, per_shard=5).collect()
    texts = [(d, plain(encoder, t or "")) for d, t in ODD]
    want = []
    for d, ids in texts:
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids), size), len(ids)]
        want += [(d, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= size
    assert packing.pack(none, encoder.vocabulary).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40), st.sampled_from(["bit", "byte"]))
def test_planes(ids, width):
    x = np.array(ids, np.uint32)
    assert idfiles.join_planes(idfiles.split_planes(x, width), len(x), width).tolist() == ids


@pytest.mark.parametrize("width", ["bit", "byte"])
def test_file_of_documents(width):
    rng = np.random.default_rng(4)
    docs = [(int(d), rng.integers(0, 50_000, n).astype(np.uint32)) for d, n in enumerate([3, 0, 700, 64, 64, 1])]
    out = io.BytesIO()
    w = idfiles.Writer(out, block_ids=64, width=width)
    for d, ids in docs:
        w.add(np.array([d]), np.array([len(ids)]), ids)
    assert w.close() == (6, 832)
    reader = idfiles.Reader(pa.BufferReader(out.getvalue()))
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(d, x.tolist()) for d, x in docs]
    assert reader.block(3).tolist() == np.concatenate([x for _, x in docs])[192:256].tolist()
    with pytest.raises(ValueError):
        idfiles.Reader(pa.BufferReader(out.getvalue()[:-1]))


def test_files_round_trip(spark, odd, none, tmp_path, encoder):
    files = idfiles.write_ids(odd, encoder.vocabulary, str(tmp_path / "ids"), parts=3, block_ids=100)
    got = sorted(idfiles.read_digest(files).collect(), key=lambda r: r.start)
    texts = sorted(((d, t or "") for d, t in ODD), key=lambda x: (x[0] is None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in texts]  # the row without an id is last
    start = 0
    for (d, t), r in zip(texts, got, strict=True):
        ids = np.array(plain(encoder, t), "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: r.ids for r in idfiles.read_ids(spark, files).collect()}[-9] == plain(encoder, "x")
    assert idfiles.read_digest(idfiles.write_ids(none, encoder.vocabulary)).collect() == []


def thue_morse(n):
    """A word over two letters whose polynomial sums meet those of its complement, and that complement."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_texts_made_to_collide_have_their_own_ids(encoder, n):
    for w in thue_morse(n):
        data = np.frombuffer(w.encode(), np.uint8)
        assert encoder(data, np.array([0, n]))[0].tolist() == plain(encoder, w)


def test_a_memo_whose_hashes_all_meet_is_still_exact(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda buf, starts, ends: np.ones(len(starts), np.uint64))
    own = tokens.Encoder(encoder.vocabulary)
    for text in ("some words here, others there", "words some, there", "x " * 40 + "long" * 30):
        data = np.frombuffer(text.encode(), np.uint8)
        assert own(data, np.array([0, len(data)]))[0].tolist() == plain(encoder, text)
