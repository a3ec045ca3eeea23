import numpy as np

import corpus_pipeline
from fluvial.llm.common import gapless_index
from fluvial.llm.langid import ByteConvNet, LanguageParameters, predict_languages, train_languages
from fluvial.llm.quality import QualityModel, QualityParameters, score_quality, train_quality
from fluvial.llm.shingles import shingle_set


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = {"en": "then with hand stone river light water over".split(), "de": "über straße haus nicht wäre für wald".split()}
    docs, labels = [], []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang], 40)) + "."
        junk = i % 5 == 0
        docs.append((i, text.upper().replace(" ", "!! ") if junk else text, lang, "s", len(text)))
        labels.append((i, int(not junk), 0))
    docs += [(1000, docs[1][1], "en", "s", 1), (1001, None, "en", "s", 0), (1002, "1234 567", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(out["doc_id"])
    clean = {i for i, q, _ in labels if q}
    assert len(clean - kept) <= 2 and not kept & {i for i, q, _ in labels if not q}
    assert not kept & {1000, 1001, 1002}
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_duplicates", "packing"]


def test_filters_keep_what_their_operators_accept(spark, documents, monkeypatch):
    docs = documents([(i, t) for i, t in enumerate(["then with hand", "stone river", "12 34", None])])
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    model, net = QualityModel([], [], QualityParameters()), ByteConvNet(["a", "b", "c", "d"], LanguageParameters())
    net.weight, net.bias = net.weight * 0, net.bias * 0
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline, "train_quality", lambda *_: model)
    monkeypatch.setattr(corpus_pipeline, "train_languages", lambda *_: net)
    assert ids(corpus_pipeline.quality_classifier(spark, docs, "")) == [0, 1, 2, 3]
    model.learned = True
    for model.constant, want in ((0.5, []), (0.69, []), (0.7, [0, 1, 2, 3])):
        assert ids(corpus_pipeline.quality_classifier(spark, docs, "")) == want == ids(score_quality(docs, model).filter("predicted = 1"))
    assert ids(corpus_pipeline.language_id(spark, docs, "")) == [0, 1] == ids(predict_languages(docs, net).filter("lang_pred != 'und'"))


def test_trained_stages_equal_brute_force(spark, documents, prose, tmp_path):
    texts = [t.upper() + "!!" if i % 3 == 0 else t for i, t in enumerate(prose(150, 3, 5, 30))] + [None, "", "12 34"]
    docs = documents(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, model, net = docs.cache(), train_quality(docs, labels), train_languages(docs)
    good = {i for i, t in enumerate(texts) if model.score([t])[0] >= 0.7}
    told = {i for i, t in enumerate(texts) if net.predict([t])[0] != ["und"]}
    assert 0 < len(good) < len(texts) and len(told) == 150
    assert {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).collect()} == good
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()} == told


def test_near_duplicates_are_judged_row_by_row(spark, documents, prose):
    a, b, c, d = prose(4, 5, 30, 40)
    rows = [(5, a), (5, b), (3, b), (6, c), (6, c), (7, None), (7, None), (None, d), (9, d), (8, d)]
    got = corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, a), (3, b), (6, c), (7, None), (7, None), (None, d), (8, d)], key=str)


def test_near_duplicates_equal_brute_force(spark, documents, prose):
    rng, base = np.random.default_rng(4), prose(40, 6, 20, 60)
    near = [" ".join(w for w in t.split() if rng.random() > 0.02) for t in base]
    rows = [(int(i), t) for i, t in zip(rng.integers(0, 60, 80), base + near)]
    sets = [set(shingle_set(t).tolist()) for _, t in rows]
    group = list(range(80))
    for i in range(80):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(rows[i][0] for i in range(80) if group[i] == g) for g in set(group)}
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()]
    assert len(least) < 80 and sorted(got) == sorted(least.values())


def test_gapless_numbers(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)] + [(None, 5), (None, 6)], "g int, v long")
    got = gapless_index(df, ["g"], ["v"], "n", 4).toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("g", dropna=False)["n"])
