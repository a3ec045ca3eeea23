"""Token counts under a unigram piece model, by dynamic programming shared in a trie (operator 5)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, calm_collector, table, sliced, worker_cache

_MARK = "▁"


def default_pieces() -> str:
    """Path of the 32k piece vocabulary that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def load_pieces(path: str) -> dict[str, float]:
    """Log scores by piece.

    The file holds merge ranks, not probabilities, so a piece's log probability
    follows Zipf's law over its place among the normal pieces.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [
        sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]
    total = math.log(sum(1 / (i + 1) for i in range(len(normal))))
    return {p: -math.log(i + 1) - total for i, p in enumerate(normal)}


def _piece_trie(pieces: dict[str, float]) -> tuple[dict, float | None]:
    """Trie over the pieces; a node is ``[children, score or None]``."""
    root: list = [{}, None]
    for piece, score in pieces.items():
        node = root
        for c in piece:
            node = node[0].setdefault(c, [{}, None])
        node[1] = score
    return root


class PrefixTrie:
    """Trie of pre-tokens whose nodes keep the best score and token count of their prefix.

    A node also keeps the piece matches that may still grow across it, so its
    forward values come from its parent alone, once; pre-tokens with a common
    prefix share that part of the dynamic program. A character that no piece
    covers costs its UTF-8 bytes in tokens (byte fallback) and ``unknown`` in
    score for each. Equal scores keep the segmentation whose last piece is
    longer. At ``limit`` nodes the trie starts anew.
    """

    def __init__(self, pieces: dict[str, float], limit: int = 150_000) -> None:
        self._pieces, self._limit = _piece_trie(pieces), limit
        self._unknown = min(pieces.values(), default=0.0) - 10.0
        self._clear()

    def _clear(self) -> None:
        # children, best score, tokens, open matches as (piece node, score, tokens) before the match
        self.nodes, self._root = 0, ({}, 0.0, 0, [])

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of one pre-token."""
        if self.nodes >= self._limit:
            self._clear()
        node = self._root
        for c in word:
            child = node[0].get(c)
            if child is None:
                child = node[0][c] = self._grow(node, c)
            node = child
        return node[2]

    def _grow(self, parent: tuple, c: str) -> tuple:
        self.nodes += 1
        best, tokens, still = -math.inf, 0, []
        # Matches stand in the order of their starts, so the longest piece comes first.
        for match, score, before in [*parent[3], (self._pieces, parent[1], parent[2])]:
            match = match[0].get(c)
            if match is not None:
                if match[0]:
                    still.append((match, score, before))
                if match[1] is not None and score + match[1] > best:
                    best, tokens = score + match[1], before + 1
        single = self._pieces[0].get(c)
        if single is None or single[1] is None:
            n = len(c.encode())
            if parent[1] + n * self._unknown > best:
                best, tokens = parent[1] + n * self._unknown, parent[2] + n
        return ({}, best, tokens, still)


def worker_counts(path: str, cache: int) -> BoundedCache:
    """Counts by pre-token of this Python worker, shared by its tasks."""

    def build() -> BoundedCache:
        calm_collector()
        trie = PrefixTrie(load_pieces(path))
        return BoundedCache(lambda word: trie.count(_MARK + word), cache)

    return worker_cache(("unigram", path, cache), build)


def count_tokens(docs: DataFrame, pieces: str | None = None, cache: int = 600_000) -> DataFrame:
    """Unigram token counts of whole texts.

    Pre-tokens are the runs without white space, each with the word mark in
    front. Every worker keeps the counts of up to ``2 * cache`` distinct pre-tokens
    (the terminals) and a trie of bounded size; both only save work. Output:
    ``doc_id, n_words, n_tokens``, a row for each input row. Null or blank
    texts have 0 of both; a null id is kept; other columns are ignored; no
    shuffle.
    """
    path = pieces or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_counts(path, cache)
        for batch in sliced(batches):
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum([counts[w] for w in words]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
