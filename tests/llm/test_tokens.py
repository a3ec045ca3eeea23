import hashlib
import math
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fluvial.llm.bpe import ByteBpe, decode_ids, encode_documents, merge_long, merge_short, round_trip_digests
from fluvial.llm.tokens import default_vocabulary, load_vocabulary
from fluvial.llm.unigram import PrefixTrie, count_tokens, default_pieces, load_pieces

LIBRARY = Tokenizer.from_file(default_vocabulary())
OWN = ByteBpe(default_vocabulary(), cache=50)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_and_round_trip(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abetinghr é", max_size=60))
def test_both_merges_agree(text):
    ranks = load_vocabulary(default_vocabulary())[0]
    assert merge_short(text.encode(), ranks) == merge_long(text.encode(), ranks)


@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_of_any_ids(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_digests(spark, documents, prose):
    texts = [*prose(40, 5), None, "", "x<|endoftext|>y", "a" * 5000]
    for r in round_trip_digests(documents(list(enumerate(texts)))).collect():
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert round_trip_digests(documents([])).count() == 0


def test_text_comes_back(spark, documents, prose):
    texts = prose(20, 6)
    back = decode_ids(encode_documents(documents(list(enumerate(texts))))).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))


def plain_viterbi(word, pieces, unknown):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            p = pieces.get(word[start:end])
            if p is not None and best[start][0] + p > best[end][0]:
                best[end] = (best[start][0] + p, best[start][1] + 1)
        if word[end - 1] not in pieces:
            n = len(word[end - 1].encode())
            if best[end - 1][0] + n * unknown > best[end][0]:
                best[end] = (best[end - 1][0] + n * unknown, best[end - 1][1] + n)
    return best[-1][1]


def test_trie_equals_viterbi(prose):
    pieces = load_pieces(default_pieces())
    unknown = min(pieces.values()) - 10.0
    trie = PrefixTrie(pieces, limit=500)
    words = {w for t in prose(30, 7) for w in t.split()} | {"international", "überaus", "日本", "🙂🙂", "the"}
    for w in sorted(words):
        assert trie.count("▁" + w) == plain_viterbi("▁" + w, pieces, unknown)


def test_prefixes_are_shared():
    trie = PrefixTrie({"a": -1.0, "b": -2.0, "ab": -2.5})
    trie.count("abab")
    grown = trie.nodes
    trie.count("abaa")
    assert trie.nodes == grown + 1


def test_counts(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in count_tokens(documents([(1, "the the"), (2, None), (3, " \n"), (4, "x" * 3000)])).collect()}
    pieces = load_pieces(default_pieces())
    assert got[1] == (2, 2 * plain_viterbi("▁the", pieces, min(pieces.values()) - 10.0)) and got[2] == got[3] == (0, 0) and got[4][0] == 1
