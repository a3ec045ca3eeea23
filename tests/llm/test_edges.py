"""Edge cases that every operator must handle: clashing columns, repeats, nulls, very long texts, empty tables."""

import hashlib
import math

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fluvial.llm.bpe import round_trip_digests
from fluvial.llm.langid import UNDETERMINED, keep_determined, predict_languages, train_languages, windows_of
from fluvial.llm.packing import pack_documents
from fluvial.llm.quality import codes_of, score_quality, train_quality
from fluvial.llm.sharding import shard_documents
from fluvial.llm.tokens import default_vocabulary
from fluvial.llm.unigram import count_tokens
from fluvial.llm.warc import archive_round_trip, assemble, read_warc, refer_to_first, write_warc

#: Names that operators use inside or return.
CLASH = "doc_id long, text string, lang string, n long, sig long, rid long, shard int, size long, slot long, length long, score double, h1 long, g_key string, _n long, sequence_id long, n_tokens long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def clashing(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, 5, 6, 7, 0.5, 8, "g", 9, 10, 11) for i, t, lang in rows], CLASH)

    return make


def odd_rows():
    long = "river stone light " * 40_000
    return [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (None, "a b c d e f", "en"), (None, None, None), (2, "", None), (3, long, "en"), (4, "x" * 200_000, None)]


def test_sharding(spark, clashing):
    for law in ("bytes", "rows", "key"):
        out = shard_documents(clashing(odd_rows()), 3, law).toPandas()
        assert len(out) == 7 and list(out.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        assert sorted(out["size"]) == [1, 1, 12, 12, 12, 200_001, 720_001]
        assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    out = shard_documents(clashing([(5, "same", "en")] * 500 + [(None, "same", "en")] * 300), 4).toPandas()
    assert len(out) == 800 and out["shard"].nunique() == 1 and sorted(out["slot"]) == list(range(800))


def test_packing(clashing):
    out = pack_documents(clashing(odd_rows())).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert not out.duplicated(["sequence_id", "offset"]).any()
    one = len(Tokenizer.from_file(default_vocabulary()).encode("a b c d e f", add_special_tokens=False).ids) + 1
    assert out[out["doc_id"] == 1]["length"].sum() == 2 * one and out[out["doc_id"].isna()]["length"].sum() == one + 1
    ends = out[out["doc_id"] == 3].sort_values("start")
    assert (ends["start"].to_numpy()[1:] == np.cumsum(ends["length"])[:-1]).all() and ends["doc_tokens"].nunique() == 1


def test_codec(clashing):
    library = Tokenizer.from_file(default_vocabulary())
    got = round_trip_digests(clashing(odd_rows())).collect()
    assert len(got) == 7 and sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 1 for r in got) == 2
    for r in got:
        if r.doc_id == 3:
            ids = library.encode(odd_rows()[5][1], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_token_counts(clashing):
    got = count_tokens(clashing(odd_rows())).collect()
    assert len(got) == 7 and {r.doc_id: r.n_words for r in got if r.doc_id} == {1: 6, 2: 0, 3: 120_000, 4: 1}
    assert len({(r.n_words, r.n_tokens) for r in got if r.doc_id == 1}) == 1
    assert sorted(r.n_words for r in got if r.doc_id is None) == [0, 6]
    assert count_tokens(clashing([])).count() == 0


def plain_quality(model, text):
    """A score from the fitted numbers alone, word by word."""
    rows, dims = codes_of(text, model.buckets).tolist(), model.index.words.shape[1]
    n, x = len(rows), [0.0] * (3 * dims)
    v = lambda b, d: float(model.index.words[b][d])
    for d in range(dims):
        if n:
            x[d] = math.fsum(v(r[0], d) for r in rows) / n
            x[dims + d] = math.fsum(v(r[1], d) + v(r[2], d) for r in rows) / (2 * n)
        if n > 1:
            x[2 * dims + d] = math.fsum(v(a[0], d) * v(b[0], d) for a, b in zip(rows, rows[1:])) / (n - 1)
    z = [min(8.0, max(-8.0, (v - m) / sd)) for v, m, sd in zip(x, model.net.mean, model.net.scale)]
    a, b, c, d = model.net.p
    hidden = [math.tanh(sum(z[i] * a[i][j] for i in range(len(z))) + b[j]) for j in range(len(b))]
    logit = (sum(h * v for h, v in zip(hidden, c)) + d[0]) / model.net.temperature
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))


def test_quality(spark, clashing):
    rows = [(i, "calm river stone light over water" if i % 2 else "WIN!! WIN!! BUY!! NOW!!", "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 0, 0)] * 5, LABELS)
    model = train_quality(clashing(rows + rows[:9] * 50), labels)
    got = score_quality(clashing(odd_rows() + rows[:4]), model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    texts = ["calm river stone light over water", "WIN!! WIN!! BUY!! NOW!!", "", "one", "stone stone stone river"]
    for text, score in zip(texts, model.score(texts)):
        assert abs(score - plain_quality(model, text)) < 1e-4
    assert score_quality(clashing([]), model).count() == 0


def plain_language(net, text):
    """Language of a text by a loop over windows, filters and positions."""
    total = np.zeros(len(net.languages))
    windows = windows_of(text, net.p.window)
    for window in windows:
        pooled = []
        for width, f in zip(net.p.widths, net.filters):
            for j in range(f.shape[2]):
                pooled.append(max(0.0, max(sum(float(f[k][window[at + k]][j]) for k in range(width)) for at in range(len(window) - width + 1))))
        total += np.array(pooled) @ net.weight + net.bias
    q = np.exp(total / len(windows) - (total / len(windows)).max())
    return net.languages[int(q.argmax())], float(q.max() / q.sum())


def test_language(spark, clashing):
    rows = [(i, "calm river stone light" if i % 2 else "über straße wäre nicht", "en" if i % 2 else "de") for i in range(60)]
    net = train_languages(clashing(rows + rows[:9] * 50))
    got = predict_languages(clashing(odd_rows()), net).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id == 2} == {UNDETERMINED} and all(r.lang_pred in ("de", "en", UNDETERMINED) for r in got)
    texts = ["calm river", "straße", "stone wäre 12 " * 30]
    names, scores = net.predict(texts)
    for text, name, score in zip(texts, names, scores):
        want, p = plain_language(net, text)
        assert name == want and abs(score - p) < 1e-4
    assert predict_languages(clashing([]), net).count() == 0 and keep_determined(clashing([]), net).count() == 0
    nothing = train_languages(clashing([(1, "a", None)]))
    assert keep_determined(clashing(odd_rows()), nothing).count() == 7


PAGE = "page_id long, url string, html string, payload_digest string, record_id string, n long, refers_to long"


def test_warc(spark, tmp_path):
    copy, huge = "<p>" + "y" * 200, "z" * 5_000_000
    rows = [(1, "http://a", copy), (1, "http://b", copy), (None, "http://c", copy), (None, "http://d", copy), (2, "http://e", huge), (3, "http://f", "w" * 100_000), (3, "http://f", "w" * 100_000)]
    pages = spark.createDataFrame([(*r, "d", "r", 1, 2) for r in rows], PAGE)
    got = sorted(archive_round_trip(pages, str(tmp_path / "w")).collect(), key=lambda r: (r.page_id or 0, r.url))
    assert [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [
        (None, "http://c", "revisit", 1, 203), (None, "http://d", "revisit", 1, 203), (1, "http://a", "response", None, 203), (1, "http://b", "response", None, 203),
        (2, "http://e", "response", None, 5_000_000), (3, "http://f", "response", None, 100_000), (3, "http://f", "response", None, 100_000),
    ]
    assert archive_round_trip(pages).count() == 7


def test_revisits_name_the_first_record(spark, tmp_path):
    copy = "<p>" + "y" * 200
    pages = spark.createDataFrame([(4, "http://b", copy, "d", "r", 1, 2), (2, "http://a", copy, "d", "r", 1, 2)], PAGE)
    write_warc(refer_to_first(pages), str(tmp_path / "w"))
    records = assemble(read_warc(spark, str(tmp_path / "w"))).collect()
    by_kind = {r.capture.record_type: r.capture for r in records}
    assert by_kind["revisit"].refers_to == by_kind["response"].record_id and bytes(by_kind["response"].payload).decode() == copy


def test_pipeline_on_empty_unlabelled_and_clashing_tables(spark, clashing, prose, tmp_path):
    texts = prose(4, 9, 30, 40)
    labels = spark.createDataFrame([], LABELS)
    plain = spark.createDataFrame([(1, texts[0], None, "s", 1), (1, texts[1], None, "s", 1), (2, texts[0], None, "s", 1), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    cases = {"empty": (plain.limit(0), []), "plain": (plain, [1, 1, 3]), "clash": (clashing([(5, texts[2], "en"), (6, texts[3], "en")]), [5, 6])}
    for name, (docs, want) in cases.items():
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").toPandas()
        assert sorted(out[out["start"] == 0]["doc_id"]) == want
