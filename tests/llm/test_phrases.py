import os
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from fluvial.llm.phrases import OP13_SQL, PhraseParameters, WordIds, collocations, text_ids

CLASH = "doc_id long, text string, lang string, a long, l long, r long, n long, score double, phrase string, block int"


def plain(rows, support=10, top=2000, longest=3):
    """The rules word by word."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= support}
    out = []
    for (lang, w), a in cand.items():
        inside = any(lang == lo and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 50 * a for (lo, v), b in cand.items() if len(v) > len(w))
        if not inside:
            score, k = min((Fraction(1000000 * a * a, f[lang, w[:k]] * f[lang, w[k:]]).__floor__(), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    rows = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        rows += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(rows)


def got(spark, rows, **params):
    df = spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, 0.5, "x", 6) for i, (t, lang) in enumerate(rows)], CLASH)
    return sorted(tuple(r) for r in collocations(df, PhraseParameters(**params) if params else None).collect())


@pytest.fixture
def texts():
    rng = np.random.default_rng(3)
    words = np.array(["the", "of", "River", "STONE", "É", "é", "new", "york", "a\x00b", "x_y", "🌊", "\x1c"])
    weights = np.array([30, 20, 5, 5, 3, 3, 4, 4, 1, 1, 1, 1]) / 78
    gaps = [" ", " ", " ", "\t ", ". ", ",", "\n", "! ", " New York City "]
    out = [("".join(w + gaps[rng.integers(len(gaps))] for w in rng.choice(words, rng.integers(0, 60), p=weights)), [None, "en", "de", "und"][rng.integers(4)]) for _ in range(120)]
    return out + [(None, "en"), ("", None), ("one", "fr"), *[("same words in every copy", "en")] * 40, ("long run " * 30_000, "en")]


def test_equals_plain_rules(spark, texts):
    want = plain(texts)
    assert got(spark, texts) == want and len(want) > 50
    # Few buckets, so that most of them are full, and chunks of a few texts.
    assert got(spark, texts, bits=6, chunk=200) == want


def test_other_bounds(spark, texts):
    assert got(spark, texts, support=3, top=7, longest=3) == plain(texts, 3, 7)
    assert got(spark, texts, longest=4, support=12) == plain(texts, 12, longest=4)
    assert got(spark, texts, longest=2) == plain(texts, longest=2)


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(None, None), ("", "en")]) == []


def test_segments_of_long_texts():
    text = "Ab cd. ef\tgh,ij " * 50 + "x" * 300 + " end"
    ids = WordIds()
    whole = text_ids(text, ids)
    for segment in (1, 7, 64, 1000):
        assert text_ids(text, ids, segment).tolist() == whole.tolist()


def test_buckets_leave_rare_grams_out(spark, texts):
    """Rare pairs whose words are frequent are counted only where a bucket admits them."""
    import fluvial.llm.phrases as m

    maps = []
    rows = [(f"w{i % 40} w{i * 7 % 39}", "en") for i in range(2000)] + [("w1 w2", "en")] * 50
    df = spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string")
    plain_map = m._bitmap
    try:
        m._bitmap = lambda *a: maps.append(plain_map(*a)) or maps[-1]
        grams, _ = m.count_phrases(df, PhraseParameters(bits=16))
    finally:
        m._bitmap = plain_map
    pairs = {tuple(t.split()) for t, _ in rows}
    hashes = m.gram_hashes([m.word_hash("en", [p[i].encode() for p in sorted(pairs)]) for i in (0, 1)])
    often = {tuple(r.phrase.decode().split()) for r in grams[1].collect()}
    assert len(pairs) > 1000 and maps[0](hashes).sum() < 60 and often == {p for p in pairs if [t for t, _ in rows].count(" ".join(p)) >= 10}


def test_sql_gives_the_same_rows(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(data, 'documents.parquet')}')")
    want = sorted(tuple(r) for r in con.execute(OP13_SQL).fetchall())
    have = sorted(tuple(r) for r in collocations(spark.read.parquet(f"{data}/documents.parquet")).collect())
    assert have == want and want


def test_blocks_reach_python_in_small_batches(spark, monkeypatch):
    """A row of bucket counts is a whole block, so batches are bounded by bytes."""
    import fluvial.llm.phrases as m

    real, bits, blocks = m._full_blocks, 25, 1200

    def watched(support):
        def run(batches):
            def seen():
                for batch in batches:
                    if batch.nbytes > 8 << 20:
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    yield batch

            return real(support)(seen())

        return run

    monkeypatch.setattr(m, "_full_blocks", watched)
    rows = spark.range(blocks, numPartitions=1).selectExpr("CAST(id AS INT) AS block", f"CAST(repeat(chr(10), {1 << 14}) AS BINARY) AS counts")
    found = m._bitmap(rows, bits, 10)
    assert np.unpackbits(found._packed).sum() == blocks << 14
