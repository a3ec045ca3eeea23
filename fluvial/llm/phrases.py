"""Phrases by hashed bucket counts and Apriori pruning (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TextWorkspace, calm_collector, join_hot, small_batches, table
from .shingles import mix64


@dataclass(frozen=True)
class PhraseParameters:
    """Phrases of 2 to ``longest`` words that occur ``support`` times or more in a language.

    A pass over the texts counts the next longer n-grams in 2**``bits`` hash
    buckets; buckets below the support go into no later count. ``bits`` bounds
    what is broadcast: two maps of 2**bits bits a pass. A task counts
    ``chunk`` words at a time. A candidate within a longer one that has
    ``inner`` percent of its occurrences or more is dropped.
    """

    longest: int = 3
    support: int = 10
    top: int = 2000
    inner: int = 50
    bits: int = 25
    chunk: int = 1_000_000


#: Bytes of a bucket block that a task sends: one row of the shuffle.
_BLOCK = 1 << 14
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: A-Z become a-z, the marks that end a piece a full stop, the tab a space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


class WordIds(dict):
    """Number of each word in the order of first sight; 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__()
        self.words = [b"."]
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def text_ids(text: str | None, ids: WordIds, segment: int = 1 << 20) -> np.ndarray:
    """Word numbers of a whole text, its pieces parted by 0 and ended by one.

    A long text is split at blanks into segments, so that only its numbers are held at once.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    parts, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= segment else raw.rfind(b" ", at, at + segment) + 1
        if end <= at:
            end = raw.find(b" ", at + segment) + 1 or len(raw)
        words = raw[at:end].replace(b".", b" . ").split()
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate([*parts, np.zeros(1, np.int64)])


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams from the hashes of their words, first words first."""
    total = np.zeros(len(columns[0]), np.uint64)
    for i, c in enumerate(columns):
        total = mix64(total + c * _SEED[i % len(_SEED)])
    return total


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of a language's words."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


class BitMap:
    """Set of buckets as packed bits."""

    def __init__(self, packed: np.ndarray, bits: int) -> None:
        self._packed, self._bits = packed, bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = bucket_of(hashes, self._bits)
        return (self._packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


_ROWS = "lang string, phrase binary, n long, block int, counts binary"


def _emit(lang=(), phrase=(), n=(), block=(), counts=()) -> pa.RecordBatch:
    size = max(len(phrase), len(block))
    pad = lambda x: list(x) or [None] * size
    return pa.RecordBatch.from_arrays(
        [pa.array(pad(lang), pa.string()), pa.array(pad(phrase), pa.binary()), pa.array(pad(n), pa.int64()), pa.array(pad(block), pa.int32()), pa.array(pad(counts), pa.binary())],
        ["lang", "phrase", "n", "block", "counts"],
    )


def _starts(ids: np.ndarray, size: int) -> np.ndarray:
    """Where an n-gram within a piece starts. The numbers end with one that ends a piece."""
    inside = ids > 0
    for i in range(1, min(size, len(ids))):
        inside[: len(ids) - i] &= ids[i:] > 0
    return np.flatnonzero(inside)


def _columns(ids: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of the n-grams at ``starts``, a column a word."""
    return [ids[starts + i] for i in range(size)]


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, a row each, and how often they occur; compared number by number, not by hash."""
    if not len(columns[0]):
        return np.zeros((0, len(columns)), np.int64), np.zeros(0, np.int64)
    key = columns[0]
    for c in columns[1:]:
        # Numbers of at most the chunk's n-grams again, so that a pair fits 64 bits.
        key = np.unique(key, return_inverse=True)[1] * (int(c.max()) + 1) + c
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return np.stack([c[first] for c in columns], 1), counts


def _count(p: PhraseParameters, size: int, shared, final: bool):
    """Counts n-grams of ``size`` words that both maps admit, and buckets of those a word longer.

    ``shared`` holds the map of buckets with enough n-grams and that of
    frequent shorter n-grams, of which every part of an n-gram must be one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm_collector()
        buckets = None if final else np.zeros(1 << p.bits, np.uint8)
        maps = shared.value if shared else None
        held: dict[str, tuple[WordIds, list[np.ndarray]]] = {}
        waiting = 0

        def flush():
            while held:
                # What is counted is let go at once, a language after the other.
                lang, (ids, parts) = held.popitem()
                seq, hashes = np.concatenate(parts), word_hash(lang, ids.words)
                parts.clear()
                starts = _starts(seq, size)
                if maps:
                    by_word = [hashes[c] for c in _columns(seq, starts, size)]
                    # Apriori first, then the bucket.
                    keep = maps[1](gram_hashes(by_word[:-1])) & maps[1](gram_hashes(by_word[1:]))
                    keep[keep] = maps[0](gram_hashes([c[keep] for c in by_word]))
                    starts = starts[keep]
                    del by_word, keep
                grams, counts = _distinct(_columns(seq, starts, size))
                for at in range(0, len(grams), 10_000):
                    names = [b" ".join([ids.words[w] for w in row]) for row in grams[at : at + 10_000].tolist()]
                    yield _emit([lang] * len(names), names, counts[at : at + 10_000])
                del grams, counts
                if not final:
                    # Only where both n-grams of this size are counted can the longer one be frequent.
                    counted = np.zeros(len(seq) + 1, bool)
                    counted[starts] = True
                    longer = _columns(seq, np.flatnonzero(counted[:-1] & counted[1:]), size + 1)
                    at = bucket_of(gram_hashes([hashes[c] for c in longer]), p.bits)
                    # A count at the support is enough, so a byte holds it.
                    slot, more = np.unique(at, return_counts=True)
                    buckets[slot] = np.minimum(buckets[slot].astype(np.int64) + more, p.support)

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                ids, parts = held.setdefault(lang.as_py(), (WordIds(), []))
                parts.append(text_ids(text.as_py(), ids))
                waiting += len(parts[-1])
                if waiting >= p.chunk:
                    yield from flush()
                    waiting = 0
        yield from flush()
        if not final:
            blocks = buckets.reshape(-1, min(_BLOCK, len(buckets)))
            used = np.flatnonzero(blocks.any(1))
            for at in range(0, len(used), 64):
                part = used[at : at + 64]
                yield _emit(block=part.tolist(), counts=[blocks[b].tobytes() for b in part])

    return run


def _full_blocks(support: int):
    """Packed bits of the buckets whose counts reach the support; rows of one block must follow each other in one task."""

    def done(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= support, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                add = np.frombuffer(raw.as_buffer(), np.uint8)
                if block != now:
                    if now is not None:
                        yield done(now, total)
                    now, total = block, add.astype(np.uint16)
                else:
                    total = np.minimum(total + add, support).astype(np.uint16)
        if now is not None:
            yield done(now, total)

    return run


def _gram_blocks(bits: int):
    """Blocks of buckets that hold the phrases of a task, each bucket counted as frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            words: dict[tuple[str, bytes], int] = {}
            rows = [(lang, w) for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True) for w in [phrase.split(b" ")]]
            by_size: dict[int, list] = {}
            for lang, w in rows:
                by_size.setdefault(len(w), []).append([words.setdefault((lang, x), len(words)) for x in w])
            seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) for lang, _ in rows}
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(x, seeds[lang]) for lang, x in words), np.uint64, len(words))
            for found in by_size.values():
                at = np.array(found)
                flags[bucket_of(gram_hashes([hashes[at[:, i]] for i in range(at.shape[1])]), bits)] = 1
        blocks = flags.reshape(-1, min(_BLOCK, len(flags)))
        used = np.flatnonzero(blocks.any(1))
        for at in range(0, len(used), 64):
            part = used[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([blocks[b].tobytes() for b in part], pa.binary())], ["block", "counts"])

    return run


def _bitmap(counts: DataFrame, bits: int, support: int) -> BitMap:
    """Buckets of ``block, counts`` whose sums reach the support, as 2**bits bits on the driver."""
    size = min(_BLOCK, 1 << bits) // 8
    packed = np.zeros((1 << bits) // 8, np.uint8)
    rows = counts.repartition("block").sortWithinPartitions("block").mapInArrow(_full_blocks(support), "block int, bits binary")
    # A row is a block of _BLOCK bytes, so a batch of the usual number of rows would be 160 MB.
    with small_batches(counts.sparkSession):
        found = rows.collect()
    for block, raw in found:
        packed[block * size : (block + 1) * size] = np.frombuffer(raw, np.uint8)
    return BitMap(packed, bits)


def count_phrases(docs: DataFrame, p: PhraseParameters) -> tuple[list[DataFrame], DataFrame]:
    """Exact counts ``lang, phrase, n`` of the frequent n-grams of 1, 2, ... words, and all words a language ``lang, n``.

    Each pass reads the texts once: it counts the n-grams of one length and
    hashes those of the next into buckets. Maps only leave out n-grams that
    cannot be frequent; what they let through is counted by its words.
    """
    spark = docs.sparkSession
    ws = TextWorkspace(spark, "phrases")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), "text")
    frequent, maps, words = [], None, None
    for size in range(1, p.longest + 1):
        final = size == p.longest
        shared = spark.sparkContext.broadcast(maps) if maps else None
        part = ws.keep(texts.mapInArrow(_count(p, size, shared, final), _ROWS), f"pass{size}")
        counted = part.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if size == 1:
            words = ws.keep(part.filter("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        found = ws.keep(counted.filter(F.col("n") >= p.support), f"grams{size}")
        frequent.append(found)
        if not final:
            # The parts that a longer n-gram must have: its two n-grams of this size.
            shorter = found.select("lang", "phrase").mapInArrow(_gram_blocks(p.bits), "block int, counts binary")
            maps = (_bitmap(part.filter("block is not null").select("block", "counts"), p.bits, p.support), _bitmap(shorter, p.bits, 1))
        ws.drop(part)
    return frequent, words


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    whole = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({whole(a)} * {whole(a)})) div ({whole(left)} * {whole(right)})")


def collocations(docs: DataFrame, params: PhraseParameters | None = None) -> DataFrame:
    """The ``top`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``.

    Texts and languages are columns ``text`` and ``lang``; others are ignored.
    A null text has no words, a null language is ``und``. Equal rows count as
    often as they occur. Words with a third of all occurrences are counted
    within tasks first, and phrases that share such a word meet its count
    without moving. Counts up to 10**15 have exact scores. An empty table gives
    no rows.
    """
    p = params or PhraseParameters()
    spark = docs.sparkSession
    grams, words = count_phrases(docs, p)
    ws = TextWorkspace(spark, "cuts")
    text = [g.select("lang", F.decode("phrase", "UTF-8").alias("phrase"), "n") for g in grams]
    best = []
    for size in range(2, p.longest + 1):
        rows = text[size - 1].withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
        for k in range(1, size):
            for side, part, of in (("l", F.slice("w", 1, k), k), ("r", F.slice("w", k + 1, size - k), size - k)):
                key = f"{side}{k}_part"
                rows = ws.keep(rows.withColumn(key, F.array_join(part, " ")), f"{size}-{side}{k}")
                met = rows.groupBy("lang", key).agg(F.count(F.lit(1)).alias("rows"))
                known = text[of - 1].withColumnsRenamed({"phrase": key, "n": f"{side}{k}"})
                rows = join_hot(rows, known.join(met, ["lang", key]), ["lang", key], "rows")
        cuts = [F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        least = F.array_min(F.array(*cuts))
        best.append(ws.keep(rows.select("lang", "phrase", "a", least.alias("cut"), "w"), f"scored{size}"))
    kept = []
    for i, rows in enumerate(best):
        inner = []
        for longer in best[i + 1 :]:
            size = i + 2
            places = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))  # noqa: B023
            inner.append(longer.select("lang", F.explode(places).alias("phrase"), F.col("a").alias("whole")))
        if inner:
            most = reduce(DataFrame.union, inner).groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
            rows = rows.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("whole") < p.inner * F.col("a"), F.lit(True)))
        kept.append(rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked in parts first, so that no task sorts all phrases of a language.
    parts = reduce(DataFrame.union, kept).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= p.top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= p.top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """Phrases of all documents by language."""
    return collocations(table(spark, sf_dir, "documents"))


#: Every n-gram of 1 to 3 words counted plainly, scored in 128 bits.
OP13_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
word AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
    FROM word CROSS JOIN range(1, 4) AS s(size) WHERE len(w) >= size) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE size > 1 AND f >= 10),
cut AS (SELECT c.lang, c.size, c.phrase, c.a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp FROM cand c CROSS JOIN range(1, 3) AS t(k) WHERE k < size),
scored AS (SELECT cut.lang, cut.phrase, cut.a, l.f AS l, r.f AS r, k,
    CAST((CAST(1000000 AS HUGEINT) * cut.a * cut.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cut JOIN gram l ON l.lang = cut.lang AND l.phrase = lp AND l.size = k JOIN gram r ON r.lang = cut.lang AND r.phrase = rp AND r.size = cut.size - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_gram AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS whole FROM cand CROSS JOIN range(1, 3) AS t(i) WHERE size = 3 GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_gram i ON i.lang = b.lang AND i.phrase = b.phrase WHERE coalesce(100 * whole < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
