"""Licence scans, decontamination, personal data."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattice.llm import decontam, licenses, pii
from lattice.llm.text import ALNUM, words_of
from tests.llm import brute
from tests.llm.conftest import ODD, prose


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def test_license_places_against_brute_force(spark, odd):
    rng = random.Random(3)
    parts = ["mit license", "Apache License", "general public license", "MIT", "license", "public", "the", "GNU General-Public License", "word\n"]
    texts = {n: " ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for n in range(60)}
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for r in got:
        want = brute.phrase_places(texts[r.doc_id], licenses.PHRASES)
        starts = [k for k, _ in want]
        assert (r.n_base, r.first_word, r.last_word) == (len(want), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in want}))
        assert r.n_words == len(brute.WORD.findall(brute.low(texts[r.doc_id])))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(odd).count() == len(ODD)


def test_license_templates_in_pieces(spark):
    whole = dict(licenses.TEMPLATES)["mit-text"]
    w = whole.split()
    broken = " ".join([*w[:20], "hereby", "inserted", *w[20:]])
    half = " ".join(w[:15])
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, f"x {whole} y"), (2, broken), (3, half)], "doc_id long, text string")).collect()}
    assert got[1].labels == "mit-text" and got[1].spans[0].start == 1 and got[1].score == 1.0
    assert got[2].labels == "mit-text" and got[2].score > 0.9
    assert got[3].labels == "" and 0.2 < got[3].score < 0.5


def test_license_scan_of_nothing(none):
    assert licenses.scan(none).collect() == []


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def planted(seed=1):
    """Benchmark items, some short, and texts with whole items, parts of them, and none."""
    rng = random.Random(seed)
    items = [(n, " ".join(prose(rng.randrange(1, 30), 100 + n))) for n in range(20)] + [(90, ""), (91, None), (92, "w1x, W2X!"), (None, "w3x w4x w5x")]
    texts = {}
    for n in range(60):
        w = prose(rng.randrange(0, 200), n)
        for _ in range(rng.randrange(3)):
            piece = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(piece) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece[a : a + rng.randrange(12, 40)] if rng.random() < 0.5 else piece
        texts[n] = " ".join(w)
    return items, texts


@pytest.mark.parametrize("block_chars", [4_000_000, 500])
def test_hits_against_brute_force(spark, block_chars):
    items, texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.hits(texts, [i for i in items if i[0] is not None])
    got = decontam.digest(decontam.find(docs, bench(spark, items), block_chars=block_chars)).collect()
    assert len(got) == len(texts) and sum(r.n_hit > 0 for r in got) > 10
    for r in got:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), len(found) >= 2)


@pytest.mark.parametrize("block_chars", [4_000_000, 500])
def test_removal_leaves_no_window(spark, odd, block_chars):
    items, texts = planted(2)
    items = [i for i in items if i[1] and len(i[1].split()) >= 8]
    docs = spark.createDataFrame([(n, t, len(t), "k") for n, t in texts.items()], "doc_id long, text string, n_chars long, spans string")
    out = decontam.remove(docs, bench(spark, items), block_chars=block_chars)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    before, after = brute.hits(texts, items), brute.hits(got, items)
    assert all(after[n][0] == before[n][0] - before[n][1] for n in texts)
    assert all(got[n] == texts[n] for n in texts if not before[n][1])
    same = decontam.remove(odd, bench(spark, [(1, "nothing of this is in those eight texts at all")]))
    assert rows(same, "doc_id", "text", "score") == rows(odd, "doc_id", "text", "score")


def test_hits_with_nothing(spark, odd, none):
    empty = bench(spark, [])
    assert decontam.find(none, bench(spark, [(1, "a b")])).collect() == []
    got = decontam.digest(decontam.find(odd, empty)).collect()
    assert len(got) == len(ODD) and all(r.n_hit == 0 and not r.contaminated for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index(text, pattern):
    text = np.array([*text, 0])
    index = decontam.FMIndex(text, 3, sample=4)
    order = decontam.suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    row, low, high = index.search(np.array([pattern]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(row) else []
    assert found == [k for k in range(len(text)) if text[k : k + len(pattern)].tolist() == pattern]


KEY = b"test"
SAMPLES = ["a.b@c.de", "x@y.example.com", "192.168.1.7", "8.8.8.8", "4111111111111111", "1234567812345678", "+1 (017) 555-7713", "123-45-6789", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "DE89 3704 0044 0532 0130 00"]


@pytest.mark.parametrize("value", SAMPLES)
def test_surrogates_keep_type_and_form(value):
    text = f"see {value} now"
    (m,) = pii.mentions(text)
    out = pii.Surrogates(KEY).replace(text, [m])
    (n,) = pii.mentions(out)
    assert n.kind == m.kind and n.value != m.value
    if m.kind in ("card", "phone", "ssn", "iban"):
        assert re.sub(r"\d", "0", re.sub("[A-Z]", "A", out)) == re.sub(r"\d", "0", re.sub("[A-Z]", "A", text))
    if m.kind == "card":
        assert pii._luhn(n.value) == pii._luhn(m.value)
    if value.startswith("192.168."):
        assert n.value.startswith("192.168.")


def test_surrogates_are_distinct():
    s = pii.Surrogates(KEY)
    values = [f"{a:03d}-12-34{b:02d}" for a in range(100) for b in range(20)]
    assert len({s.of("ssn", v.replace("-", "")) for v in values}) == len(values)
    assert len({s.of("ip", f"10.0.{a}.{b}") for a in range(30) for b in range(1, 30)}) == 30 * 29
    assert pii.Surrogates(b"other").of("ssn", "123456789") != s.of("ssn", "123456789")


def test_names_keep_gender_and_identity():
    text = "Mr. John Smith met Mrs. Smith and Mrs Anna Jones; Herr Иванов. MR SMITH"
    out = pii.Surrogates(KEY).replace(text, pii.mentions(text))
    w = out.replace(".", "").replace(";", "").split()
    assert w[2] == w[5] and w[1].endswith("n") and w[8].endswith("na") and w[-1] == w[2].upper()
    assert re.fullmatch("[А-Яа-я]+", w[11])


def test_names_that_meet_draw_again(spark):
    names = spark.createDataFrame([("family", f"n{k}") for k in range(300)], "kind string, value string")
    found = pii.checked(names, KEY)
    s = pii.Surrogates(KEY, *found)
    assert len({s.of("family", f"n{k}") for k in range(300)}) == 300
    narrow = [pii.Surrogates(KEY, 0).of("family", f"n{k}") for k in range(300)]
    assert len(set(narrow)) < 300


def test_short_addresses_of_all_forms_stay_apart(spark):
    signs = "0189abfgxz"
    values = [f"{p}{q}@d.de" for p in signs for q in ("", *signs)] + [f"u@{p}{q}.com" for p in signs for q in signs]
    s = pii.Surrogates(KEY)
    assert len({s.of("email", v) for v in values}) == len(values)
    for hexed in ("a1", "0f", "deb", "abc123", "456789"):
        assert pii._hexed(s.spelled(hexed, "x")) == pii._hexed(hexed)
    entities = spark.createDataFrame([("email", v) for v in values], "kind string, value string")
    assert pii.checked(entities, KEY, rounds=2)[1] == {}


def test_documents_keep_rows_and_columns(spark, odd, none):
    out = pii.replaced(odd, KEY)
    assert out.columns == [*odd.columns, "_entities"]
    assert rows(out, "doc_id", "text", "score") == rows(odd, "doc_id", "text", "score")
    assert pii.replaced(none, KEY).collect() == []
    own = spark.createDataFrame([(1, "mail me@x.org or +1 (843) 555-7672 170.106.47.218", 0), (2, "ME@X.ORG", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.replaced(own, KEY).collect()}
    assert got[1]._entities == 3 and "555-7672" not in got[1].text and "170.106" not in got[1].text
    assert got[2].text.lower() in got[1].text and got[1].n_chars == len(got[1].text)


def replaced_words(text, key=KEY):
    return pii.Surrogates(key).replace(text, pii.mentions(text))


def test_people_keep_one_name_whatever_the_title():
    out = replaced_words("Mr John Smith came. Dr John Smith left; Smith said, and John Smith too. SMITH").replace(",", "").replace(".", "").replace(";", "").split()
    assert out[1:3] == out[5:7] == out[11:13] and out[8] == out[2] and out[-1] == out[2].upper()
    assert replaced_words("Smith said nothing") == "Smith said nothing"  # no title tells of a name


@pytest.mark.parametrize("text", ["Mr O'Brien", "Sr. de la Cruz", "г-н Иванов", "2001:db8:85a3::8a2e:370:7334", "06 12 34 56 78", "password: hunter2", "password=5f3c9a1b2d4e6f7081", "api_key=abcdefghijklmnop", f"{'a' * 90}@x.org", "0a" * 80])
def test_more_kinds_are_found(text):
    found = pii.mentions(f"see {text} now")
    out = replaced_words(f"see {text} now")
    assert found and all(f"see {text} now"[m.start : m.stop] not in out for m in found)


@pytest.mark.parametrize("text", ["version 1.2.3.4 is out", "isbn 978-316-1484", "at 1700000000000 ms", "12:30:45", "std::vector<int>", "Password: required"])
def test_what_only_looks_like_personal_data_stays(text):
    assert replaced_words(text) == text


@pytest.mark.parametrize("value", [f"{c}@e.com" for c in "abmz"] + ["5@e.com"])
def test_nothing_is_its_own_surrogate(value):
    assert all(pii.Surrogates(bytes([k])).of("email", value) != value for k in range(1, 60))


def test_surrogates_are_no_entity_of_the_corpus(spark):
    own = pii.Surrogates(KEY)
    meant = [own.of("ssn", f"{k:09d}") for k in range(20)]  # what the first draws would give
    entities = spark.createDataFrame([("ssn", v) for v in [f"{k:09d}" for k in range(20)] + meant], "kind string, value string").distinct()
    found = pii.Surrogates(KEY, *pii.checked(entities, KEY))
    values = {r.value for r in entities.collect()}
    given = [found.of("ssn", v) for v in values]
    assert len(set(given)) == len(values) and not values & set(given)


def test_a_half_of_the_corpus_has_the_same_surrogates(spark):
    docs = spark.createDataFrame([(k, f"Mr John{k} Smith{k} wrote to u{k}@mail.org") for k in range(40)], "doc_id long, text string")
    whole = {r.doc_id: r.text for r in pii.replaced(docs, KEY).collect()}
    half = {r.doc_id: r.text for r in pii.replaced(docs.where("doc_id < 20"), KEY).collect()}
    assert all(whole[k] == t for k, t in half.items()) and len({t for t in whole.values()}) == 40


def test_replacing_by_hand(spark):
    """Every text against its mentions replaced one by one, from the pieces between them."""
    texts = ["a b", "mail x@y.org, 8.8.8.8 and x@y.org", "Mrs Ann Lee; Lee (+1 (843) 555-7672) 4111111111111111", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = pii.Surrogates(KEY)
    for r in pii.replaced(docs.withColumn("_entities", docs.doc_id), KEY).collect():
        text = texts[r.doc_id]
        found = pii.mentions(text)
        assert r._entities == len(found)
        rest = r.text
        at = 0
        for m in found:
            assert rest.startswith(text[at : m.start])
            rest = rest[m.start - at :]
            want = pii._poured(own.of(m.kind, m.value), text[m.start : m.stop], m.kind)
            assert rest.startswith(want)
            rest, at = rest[len(want) :], m.stop
        assert rest == text[at:]


def test_a_passage_that_a_template_has_twice_counts_twice():
    a, b = "one two three four", "five six seven eight"
    scanner = licenses.Scanner((("zz yy", "z"),), (("t", f"{a} {b} {a} nine ten"),))
    ids = lambda text: np.array([np.searchsorted(scanner.vocabulary, w) for w in words_of(text, ALNUM)])
    text = f"{a} {b} {a}"
    score, labels = (lambda r: (r[5], r[4]))(scanner.scan(ids(text), [0, 4, 8], [4, 8, 12]))
    assert labels == "t" and score == pytest.approx(12 / 14)


def test_a_secret_is_one_mention():
    (m,) = pii.mentions("see password=5f3c9a1b2d4e6f7081 now")
    assert (m.kind, m.value) == ("secret", "5f3c9a1b2d4e6f7081")
