"""Byte-level BPE encoding and decoding over a contiguous rank array (operator 7)."""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, calm_collector, table, sliced, worker_cache
from .tokens import PATTERN, default_vocabulary, load_vocabulary

_NEVER = 1 << 30
_SHORT = 256


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: boundaries and adjacent ranks in two flat arrays.

    The least rank is found by a scan; its inner boundary is deleted and the
    ranks of the two neighbouring pairs are refreshed.
    """
    bounds = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == _NEVER:
            break
        i = rank.index(least)
        del bounds[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NEVER)
        if i:
            rank[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NEVER)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long run without blanks, by a heap over linked parts."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop or end[i] == stop:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids of up to ``2 * cache`` recent words are kept."""

    def __init__(self, path: str, cache: int = 300_000) -> None:
        self._ranks, self._special, self._table = load_vocabulary(path)
        self._words = regex.compile(PATTERN).findall
        self._ids = BoundedCache(self._word, cache)
        self._splits = regex.compile("|".join(map(regex.escape, sorted(self._special, key=len, reverse=True)))) if self._special else None

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        ids = merge_short(raw, self._ranks) if len(raw) <= _SHORT else merge_long(raw, self._ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        ids, words = self._ids, self._words
        if self._splits is None or not self._splits.search(text):
            return b"".join([ids[w] for w in words(text)])
        out, at = [], 0
        for m in self._splits.finditer(text):
            out += [ids[w] for w in words(text[at : m.start()])]
            out.append(struct.pack("<I", self._special[m[0]]))
            at = m.end()
        return b"".join(out + [ids[w] for w in words(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        token = self._table.__getitem__
        return b"".join(map(token, ids)).decode("utf-8", "replace")


def worker_codec(path: str) -> ByteBpe:
    """The codec of this Python worker, shared by its tasks."""

    def build() -> ByteBpe:
        calm_collector()
        return ByteBpe(path)

    return worker_cache(("bpe", path), build)


def _digest_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_codec(path)
        for batch in sliced(batches):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                raw = bpe.encode_bytes(text.as_py() or "")
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int) of every whole text; a null text has no ids."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_codec(path)
        for batch in sliced(batches):
            ids = pa.array([bpe.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_codec(path)
        for batch in sliced(batches):
            text = pa.array([bpe.decode(i.as_py() or []) for i in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every whole text and return digests of both results.

    Output: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, a row for each
    input row, repeated ones too. Null text counts as empty (no ids, digests of
    nothing); a null id is kept; an empty table gives no rows; other columns of
    ``docs`` are ignored. Runs without blanks of any length are merged by a
    heap, so a very long text costs no more per byte. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _digest_batches(vocabulary or default_vocabulary()),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Round trip of all documents."""
    return round_trip_digests(table(spark, sf_dir, "documents"))
