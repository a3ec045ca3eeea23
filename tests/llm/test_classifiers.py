import zlib

import numpy as np
import pytest

from fluvial.llm.langid import UNDETERMINED, ByteConvNet, LanguageParameters, fit_network, predict_languages, train_languages, windows_of
from fluvial.llm.quality import QualityModel, QualityParameters, score_quality, train_quality


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    good, langs = [], {"xx": "then with hand stone river light".split(), "yy": "über straße haus nicht wäre für".split()}
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        words = rng.choice(langs[lang], rng.integers(20, 60)).tolist()
        junk = i % 3 == 0
        good.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words) + ".", lang, 0 if junk else 1))
    return good


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark):
    rows = corpus(240, 0)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_quality(docs, train_quality(docs, labels)).collect()}
    assert len(got) == 242 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got.values())
    ok = [(got[i].score >= 0.5) == bool(q) for i, _, _, q in rows if held(i)]
    assert np.mean(ok) > 0.95


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_quality(docs, train_quality(docs, empty)).first().score == 0.5
    assert score_quality(docs.limit(0), train_quality(docs, empty)).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    texts = ["aa bb" if i % 2 else "cc dd" for i in range(400)]
    labels = [int(rng.random() < (0.8 if i % 2 else 0.2)) for i in range(400)]
    score = QualityModel(texts, labels, QualityParameters(epochs=20)).score(["aa bb", "cc dd"])
    assert abs(score[0] - 0.8) < 0.12 and abs(score[1] - 0.2) < 0.12


def test_language_on_held_out_rows(spark):
    rows = corpus(240, 2)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(1000, None, "xx"), (1001, "12 !?", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in predict_languages(docs, train_languages(docs)).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows if held(i)]) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == UNDETERMINED
    assert len(got) == 242


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert predict_languages(docs, train_languages(docs)).first().lang_pred == UNDETERMINED


def test_pair_tables_equal_plain_convolution():
    net = ByteConvNet(["a", "b"], LanguageParameters())
    windows = windows_of("Grüße über alles, then a long line of text " * 20, 128)
    plain = np.maximum(net._pool(windows)[0], 0) @ net.weight + net.bias
    assert np.allclose(plain, net.logits(windows), atol=1e-4)


def test_gradient_step_learns():
    net = fit_network(["aaaa bbbb"] * 40 + ["cccc dddd"] * 40, ["u"] * 40 + ["v"] * 40, LanguageParameters(epochs=15))
    assert net.predict(["aaaa bbbb", "cccc dddd"])[0] == ["u", "v"]


@pytest.fixture
def small_results(spark):
    """Jobs may send a megabyte to the driver, no more."""
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before = conf.get(key, "1g")
    conf.set(key, "1m")
    yield
    conf.set(key, before)


def test_training_leaves_whole_texts_on_the_executors(spark, small_results):
    rng, rows = np.random.default_rng(3), corpus(40, 2)
    texts = [" ".join(rng.permutation(t.split() * 400)) for _, t, _, _ in rows] + [None, "12 34"]
    langs, quality = [lang for _, _, lang, _ in rows] + ["xx", "yy"], [q for *_, q in rows] + [1, 0]
    data = list(zip(range(42), texts, langs, strict=True))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame(list(zip(range(42), quality, strict=True)), "doc_id long, quality int")
    learned = [i for i in range(42) if not held(i)]
    told = [i for i in learned if texts[i] is not None]
    model, whole = train_quality(docs, labels), QualityModel([texts[i] for i in learned], [quality[i] for i in learned], QualityParameters())
    assert (model.index.words == whole.index.words).all() and (model.score(texts) == whole.score(texts)).all()
    net, plain = train_languages(docs), fit_network([texts[i] for i in told], [langs[i] for i in told], LanguageParameters())
    assert net.predict(texts)[0] == plain.predict(texts)[0] and (net.predict(texts)[1] == plain.predict(texts)[1]).all()


def test_repeats_beyond_the_sample_leave_others_in(spark):
    """One id repeated more often than the sample is large is one row of it."""
    rows = [r for r in corpus(80, 4) if not held(r[0])]
    first = rows[0]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(first[0], first[1], first[2])] * 200, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows] + [(first[0], first[3], 0)] * 200, "doc_id long, quality int, toxic int")
    model = train_quality(docs, labels, QualityParameters(sample=40, epochs=20))
    assert model.net is not None and ((model.score([t for _, t, _, _ in rows]) > 0.5) == [q == 1 for *_, q in rows]).mean() > 0.95
    assert train_languages(docs, LanguageParameters(sample=40, epochs=2)).languages == ["xx", "yy"]


def test_context_sums_and_pools_by_parts():
    from fluvial.llm.quality import RandomIndex, _index_vectors, codes_of, context_sums

    p = QualityParameters(buckets=64, dims=8)
    docs = [codes_of(t, p.buckets) for t in ("a b c a b WIN!! d e f g", "", "one", "x y x y x y x")]
    index, want = _index_vectors(p, np.random.default_rng(p.seed)), np.zeros((64, 8), int)
    for c in docs:
        for i in range(len(c)):
            for k in range(max(0, i - p.window), min(len(c), i + p.window + 1)):
                for mine in c[i] if k != i else []:
                    want[mine] += index[c[k]].sum(0)
    for step in (1, 3, 100):
        assert (context_sums(p, docs, step) == want).all()
    pooled = RandomIndex(p, want)
    for c in docs:
        assert all(np.allclose(pooled.pool(c, step), pooled.pool(c), atol=1e-6) for step in (1, 2, 5))
