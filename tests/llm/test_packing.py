import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fluvial.llm.packing import harmonic_cuts, pack_documents, pack_leftovers
from fluvial.llm.tokens import FastEncoder, default_vocabulary


@given(st.integers(0, 5000))
def test_cuts_are_class_ceilings(n):
    cuts = harmonic_cuts(n, 1024)
    assert sum(cuts) == n and all(c == 1024 // (1024 // c) for c in cuts)


@given(st.dictionaries(st.sampled_from([512, 341, 256, 204, 170, 18, 1]), st.integers(1, 10)))
def test_leftovers_fit(counts):
    bins = pack_leftovers(counts, 1024)
    assert all(sum(s for s, _ in b) <= 1024 for b in bins)
    assert sorted(x for b in bins for x in b) == sorted((s, i) for s, n in counts.items() for i in range(n))


def test_encoder_equals_library():
    library, own = Tokenizer.from_file(default_vocabulary()), FastEncoder(default_vocabulary())
    for text in ["", "Über Straße, l'été  \n\n x", "a<|endoftext|>b", "日本語 テスト ١٢٣", "don't  \t stop!!", "̀e 🙂"]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_cover_every_id_once(spark, documents, prose):
    texts = [*prose(80, 4, 0, 900), None, "", "word " * 3000]
    out = pack_documents(documents(list(enumerate(texts)))).toPandas()
    own = FastEncoder(default_vocabulary())
    for doc, g in out.sort_values("start").groupby("doc_id"):
        raw = np.append(own.encode(texts[doc] or ""), 0).astype("<u4").tobytes()
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens * 4 == len(raw)
            assert r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at * 4 == len(raw)
    assert out["doc_id"].nunique() == len(texts)
    fill = out.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 1024 and fill.sum() / (1024 * len(fill)) > 0.97
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()


def test_empty_and_null_ids(spark, documents):
    assert pack_documents(documents([])).count() == 0
    rows = pack_documents(documents([(None, "a"), (5, None), (5, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows) == [(False, 1), (False, 1), (True, 2)]
