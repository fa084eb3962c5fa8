"""Toxicity, quality and url rules."""

import random
import re

import numpy as np
import pytest

from lattice.llm import quality, toxicity, urls
from tests.llm.conftest import ODD, prose


def corpus(spark, n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        w = prose(rng.randrange(20, 80), k, 200)
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scoundrel", "nitwit"]))
        junk = k % 4 == 1
        docs.append((k, " ".join(f"{x}###" if junk else x for x in w), "x"))
        labels.append((k, int(not junk), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def char_model(text):
    codes = toxicity._CLASS[np.frombuffer(text.encode(), np.uint8)]
    counts = np.zeros(toxicity.N_CLASS**3, np.int64)
    np.add.at(counts, codes[:-2] * toxicity.N_CLASS**2 + codes[1:-1] * toxicity.N_CLASS + codes[2:], 1)
    return toxicity.CharModel.of(counts)


@pytest.mark.parametrize("word,meant", [("n1tw1t", "nitwit"), ("n.i.t.w.i.t", "nitwit"), ("n i t w i t", "nitwit"), ("niiiitwit", "nitwit"), ("sc0undr3l", "scoundrel"), ("$coundrel", "scoundrel"), ("plain", "plain")])
def test_disguised_words(word, meant):
    model = char_model("a nitwit and a scoundrel met a plain nitwit on the plain with a scoundrel " * 20)
    assert toxicity.restore(word, model) == meant


def test_texts_with_disguised_words():
    model = char_model("a nitwit and a scoundrel met " * 20)
    got = toxicity.restore_texts(["You N1TW1T, met n i t w i t at 10:30 in 2024!", "", None, "all is plain here"], model)
    assert got == ["You nitwit, met nitwit at 10:30 in 2024!", "", "", "all is plain here"]


@pytest.mark.parametrize("text", ["a n i t w i t met", "p l a i n n i t w i t", "x y.o.u.n.i.t.w.i.t", "ni" + "i" * 60 + "twit", "p l a i n  s c o u n d r e l " * 8, "ni7wi7", "nitw!+", "a nitwi+", "n" + "." * 50 + "i.t.w.i.t"])
def test_forms_of_disguised_words(text):
    model = char_model("you met a nitwit and a scoundrel on the plain, plain nitwit, a plain scoundrel, you nitwit " * 20)
    data = np.frombuffer(text.encode(), np.uint8)
    known = {w: toxicity.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in ("nitwit", "scoundrel")}
    _, got = toxicity.forms(data, np.array([0, len(data)]), toxicity.Restorer(model))
    want = "scoundrel" if "d r e l" in text else "nitwit"
    assert known[want] in got, toxicity.restore_texts([text], model)


def least_cost(word, model):
    """Cost of the best path, by trying every one."""
    def go(rest, a, b, before, started):
        if not rest:
            return -model.log[a, b, 0] if b else 0.0
        ch, found = rest[0], []
        options = toxicity.steps(ch)
        for c, extra in options:
            k = ord(c) - 96 if "a" <= c <= "z" else 27
            found.append(extra - model.log[a, b, k] + go(rest[1:], b, k, ch, True))
        if ch in toxicity.SEPARATORS or not options:
            found.append(toxicity.COST_DROP + go(rest[1:], a, b, before, started))
            if started and b:
                found.append(-model.log[a, b, 0] + go(rest[1:], b, 0, ch, True))
        if started and ch == before:
            found.append(toxicity.COST_REPEAT + go(rest[1:], a, b, before, started))
        return min(found)

    return go(word, 0, 0, "", False)


def cost_of(word, meant, model):
    """Least cost of the paths that give the restored word."""
    def go(rest, want, a, b, before, started):
        if not rest:
            return (-model.log[a, b, 0] if b else 0.0) if not want.strip(" ") else float("inf")
        ch, found = rest[0], [float("inf")]
        options = toxicity.steps(ch)
        for c, extra in options:
            if want[:1] == c:
                k = ord(c) - 96 if "a" <= c <= "z" else 27
                found.append(extra - model.log[a, b, k] + go(rest[1:], want[1:], b, k, ch, True))
        if ch in toxicity.SEPARATORS or not options:
            found.append(toxicity.COST_DROP + go(rest[1:], want, a, b, before, started))
            if started and b and want[:1] in (" ", ""):
                found.append(-model.log[a, b, 0] + go(rest[1:], want[1:], b, 0, ch, True))
        if started and ch == before:
            found.append(toxicity.COST_REPEAT + go(rest[1:], want, a, b, before, started))
        return min(found)

    return go(word, meant, 0, 0, "", False)


@pytest.mark.parametrize("seed", range(6))
def test_restoring_is_the_best_of_all_paths(seed):
    model, rng = char_model("a nitwit and a scoundrel met a plain nitwit on the plain with a scoundrel " * 20), random.Random(seed)
    for _ in range(40):
        word = "".join(rng.choice("nit1w.*3 -s$aa") for _ in range(rng.randrange(1, 8)))
        assert cost_of(word, toxicity.restore(word, model), model) == pytest.approx(least_cost(word, model)), word


def test_two_models_in_one_worker(spark):
    first, second = char_model("nitwit " * 50), char_model("nltwlt " * 50)
    assert [toxicity.restore_texts(["n1tw1t"], m) for m in (first, second, first)] == [["nitwit"], ["nltwlt"], ["nitwit"]]


def test_spaced_sentences_and_long_words():
    model = char_model("you are a nitwit and a scoundrel met a plain nitwit on the plain with a scoundrel " * 20)
    assert "nitwit" in toxicity.restore_texts(["y o u  n i t w i t, all"], model)[0]
    assert "nitwit" in toxicity.restore_texts(["(n i t w i t)"], model)[0]
    assert toxicity.restore_texts(["n.i.t.w.i.t." + "i" * 10_000], model)[0].startswith("nitwit")


def test_scores_stand_whatever_the_columns_are_called(spark, odd):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    own = odd.withColumn("_score", odd.n).withColumn("_predicted", odd.n).withColumn("_0", odd.n)
    assert toxicity.keep_clean(own, model).columns == own.columns
    assert toxicity.scored(own, model).columns == [c for c in own.columns if c not in ("_score", "_predicted")] + ["_score", "_predicted"]
    assert toxicity.scored(own, model).count() == len(ODD)


def test_labels_of_repeated_ids_are_bounded(spark):
    docs = spark.createDataFrame([(k % 20, f"text {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    got = quality.labelled(docs, labels, "toxic", 10).collect()
    assert len(got) == 10 == len({r.doc_id for r in got})


def test_toxicity_learns_and_sees_through_disguise(spark, odd, none):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.toxic).all()
    hard = spark.createDataFrame([(1, "w1x sc0undr3l w2x n1tw1t"), (2, "w1x w2x"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(hard, model).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.scored(odd, model).columns == [*odd.columns, "_score", "_predicted"]
    assert toxicity.score(none, model).collect() == []


def test_toxicity_without_labels(spark, odd, none):
    no = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.train(odd, no)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (1, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    assert all(0 < r.score < 0.5 for r in toxicity.score(odd, toxicity.train(odd, one)).collect())
    assert toxicity.train(none, no).known.tolist() == []


def test_quality_learns(spark, odd, none):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels)
    got = quality.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).all()
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality.score(none, model).collect() == []
    no = quality.train(none, labels)
    assert {r.score for r in quality.score(odd, no).collect()} == {0.5}


def test_pairs_catch_what_shapes_cannot():
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, rounds=60)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert (0, 1) in [p[0] for p in model.pairs]
    flat = quality.fit(x, y, rounds=60, n_pairs=0)
    assert ((flat.score(x) >= 0.5) == y).mean() < 0.7


URLS = [
    "https://Example.COM/en/1", "http://www.example.com/en/x?y", "http://a.b.example.com/en/", "http://example.com/EN/1", "http://example.com", "http://example.com?/en/", "http://notexample.com/en/1", "http://x.net/es/", "http://net/fr/a", "http://x.net/de/",
    "http://x.org/casino/", "ftp://spam-farm.org", "://com/", "no scheme.com/en/", "", None, "http://x.org/a://b.com/en/", "http://x.com:80/en/", "HTTP://X.Org/POKER#a", "http://x.org/pokers", "http://wp-login.php.com/", "http://x.org/wp-login.php",
]


def plain_verdict(url):
    """Host, path, rule, verdict of a url with every rule tried."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for name, verdict in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")):
        h, p = name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    if best:
        return host, path, *best
    block = any(re.search(r.pattern, (url or "").lower()) for r in urls.PATTERN_RULES)
    return host, path, None, "block" if block else "allow"


@pytest.mark.parametrize("index_limit", [urls.INDEX_LIMIT, 0])
def test_url_rules(spark, index_limit):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS * 2)], "page_id long, url string, fit string")
    got = urls.judge(pages, index_limit=index_limit).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict((URLS * 2)[r.page_id])
    assert urls.judge(pages.where("false"), index_limit=index_limit).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(f"http://a{k}.example.com/de/",) for k in range(5)], "url string")
    index = urls.filed_under(pages, urls.SITE_RULES)
    assert "example.com/en/" in [r.name for r in index["en"]] and "com/" in [r.name for r in index["com"]]
    plan = urls.judge(pages.selectExpr("1 as page_id", "url"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
