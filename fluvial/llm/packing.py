"""Harmonic sequence packing (operator 2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextWorkspace, gapless_index, shuffle_width, sliced, table, worker_cache
from .sharding import CapacityTree
from .tokens import FastEncoder, default_vocabulary

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def harmonic_cuts(n: int, capacity: int) -> list[int]:
    """Lengths into which ``n`` ids are cut: whole sequences, then class ceilings.

    Class k holds lengths in (capacity/(k+1), capacity/k]; each cut takes the
    largest ceiling floor(capacity/k) that still fits, so k pieces of a class
    fill a sequence up to less than k ids.
    """
    cuts = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = -(-capacity // rest)
        size = capacity // k
        cuts.append(size)
        rest -= size
    return cuts


def _cut_batches(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cut_cache = worker_cache(("encoder", path), lambda: FastEncoder(path)), {}
        for batch in sliced(batches):
            ids_in = batch.column(0).to_pylist()
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(ids_in, batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "")
                raw = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                n, start = len(raw) // 4, 0
                rest = n % capacity
                cuts = cut_cache.get(rest)
                if cuts is None:
                    cuts = cut_cache[rest] = harmonic_cuts(rest, capacity)
                for size in [capacity] * (n // capacity) + cuts:
                    for c, v in zip(cols, (doc_id, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n), strict=True):
                        c.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024) -> DataFrame:
    """Tokenise every whole text, append id 0 and cut it at harmonic ceilings."""
    path = vocabulary or default_vocabulary()
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_cut_batches(path, capacity), _PIECES)


def pack_leftovers(counts: dict[int, int], capacity: int) -> list[list[tuple[int, int]]]:
    """Sequences for the pieces that fill no whole sequence of their class.

    ``counts`` maps a length to its number of such pieces, fewer than
    ``capacity // length``; items are ``(length, ordinal)``. Longest first into
    the tightest sequence.
    """
    tree, bins = CapacityTree(), []
    for size in sorted(counts, reverse=True):
        for ordinal in range(counts[size]):
            found = tree.pop_tightest(size)
            if found is None:
                bins.append([])
                found = (capacity, len(bins) - 1)
            bins[found[1]].append((size, ordinal))
            tree.add(found[0] - size, found[1])
    return bins


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece a sequence and an offset.

    The pieces of one length form a class; ``capacity // length`` of them fill a
    sequence. Pieces are numbered within their class by hash buckets, so every
    worker fills its bins without any other's rows: the sequence is a division
    of the number. The driver sees only one count a class (below
    ``2 * sqrt(capacity)`` classes) and deals out the remainders, fewer than
    ``capacity // length`` pieces a class, by best fit.
    """
    spark = pieces.sparkSession
    kept = TextWorkspace(spark, "pack").keep(pieces, "pieces")
    per_class = {int(r[0]): int(r[1]) for r in kept.groupBy("length").count().collect()}
    first, class_rows, rest = 0, [], {}
    for size in sorted(per_class, reverse=True):
        per = capacity // size
        full = per_class[size] // per
        class_rows.append((size, per, full * per, first))
        first += full
        if per_class[size] % per:
            rest[size] = per_class[size] % per
    left_rows = []
    for seq, members in enumerate(pack_leftovers(rest, capacity)):
        offset = 0
        for size, ordinal in members:
            left_rows.append((size, ordinal, first + seq, offset))
            offset += size
    classes = spark.createDataFrame(class_rows, "c_length long, c_per long, c_whole long, c_first long")
    left = spark.createDataFrame(left_rows, "l_length long, l_ordinal long, l_sequence long, l_offset long")
    numbered = gapless_index(
        kept, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "_n", max(16, shuffle_width(spark))
    )
    # Both tables are bounded by the capacity alone.
    out = numbered.join(F.broadcast(classes), F.col("length") == F.col("c_length")).join(
        F.broadcast(left),
        (F.col("length") == F.col("l_length")) & (F.col("_n") - F.col("c_whole") == F.col("l_ordinal")),
        "left",
    )
    quotient = F.floor(F.col("_n") / F.col("c_per"))
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("l_sequence", F.col("c_first") + quotient).cast("long").alias("sequence_id"),
        F.coalesce("l_offset", (F.col("_n") - quotient * F.col("c_per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids by harmonic classes.

    Output per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. A null or empty text is the single id 0. A null
    ``doc_id`` is kept. Repeated rows are packed each for itself. An empty
    table gives no pieces. Other columns of ``docs`` are ignored. A text of any
    length is cut whole; every id lies in exactly one piece.
    """
    return pack_pieces(token_pieces(docs, vocabulary, capacity), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
