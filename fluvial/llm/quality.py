"""Quality classifier: random-indexing word vectors and a two-layer network (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, TextWorkspace, calm_collector, is_held_out, small_batches, table, sliced, worker_cache


@dataclass(frozen=True)
class QualityParameters:
    """``sample`` labelled documents at most train the model, chosen by a hash of the id."""

    sample: int = 6000
    buckets: int = 1 << 14
    dims: int = 64
    nonzero: int = 6
    window: int = 2
    hidden: int = 32
    epochs: int = 60
    seed: int = 11


def _word_code(buckets: int):
    """Buckets of the written word, its beginning and its end, in one number."""

    def compute(word: str) -> int:
        code = 0
        for piece in (word[-3:] + ">", "<" + word[:2], word):
            code = code * buckets + zlib.crc32(piece.encode("utf-8", "surrogatepass")) % buckets
        return code

    return compute


def word_codes(buckets: int) -> BoundedCache:
    """Codes of words, kept for this Python worker."""

    def build() -> BoundedCache:
        calm_collector()
        return BoundedCache(_word_code(buckets), 200_000)

    return worker_cache(("quality", buckets), build)


def codes_of(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of a text's words, a row a word: the word as written, its beginning, its end."""
    words = (text or "").split()
    code = np.fromiter(map(word_codes(buckets).__getitem__, words), np.int64, len(words))
    return np.stack([code % buckets, code // buckets % buckets, code // buckets**2], 1)


def _index_vectors(p: QualityParameters, rng: np.random.Generator) -> np.ndarray:
    """The buckets' sparse random index vectors."""
    index = np.zeros((p.buckets, p.dims), np.int64)
    place = rng.integers(0, p.dims, (p.buckets, p.nonzero))
    np.add.at(index, (np.arange(p.buckets)[:, None], place), rng.choice(np.array([-1, 1]), (p.buckets, p.nonzero)))
    return index


def context_sums(p: QualityParameters, docs: Iterable[np.ndarray], step: int = 16384) -> np.ndarray:
    """For each bucket the sum of its neighbours' index vectors over these documents.

    A neighbour counts with all its buckets. Whole numbers, so sums over parts
    of the documents add up exactly.
    """
    index = _index_vectors(p, np.random.default_rng(p.seed))
    context = np.zeros((p.buckets, p.dims), np.int64)
    for codes in docs:
        for at in range(0, len(codes), step):
            low = max(0, at - p.window)
            near = index[codes[low : at + step + p.window]].sum(1)
            total = np.zeros_like(near)
            for shift in range(1, p.window + 1):
                total[:-shift] += near[shift:]
                total[shift:] += near[:-shift]
            mine, total = codes[at : at + step], total[at - low : at - low + step]
            for column in mine.T:
                order = np.argsort(column, kind="stable")
                starts = np.flatnonzero(np.diff(column[order], prepend=-1))
                context[column[order][starts]] += np.add.reduceat(total[order], starts, axis=0)
    return context


class RandomIndex:
    """Context vectors: each bucket sums the sparse random index vectors of its neighbours."""

    def __init__(self, p: QualityParameters, sums: np.ndarray) -> None:
        # A word that the sample lacks stands for itself.
        context = sums.astype(np.float64) + _index_vectors(p, np.random.default_rng(p.seed))
        self.words = (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def pool(self, codes: np.ndarray, step: int = 16384) -> np.ndarray:
        """Pooled vector of one document: means of its word vectors, of its beginnings' and ends' vectors, and of bound neighbours.

        Two neighbours are bound by the product of their word vectors, so the
        mean of these tells how words follow each other.
        """
        dims, n = self.words.shape[1], len(codes)
        word, part, bound = (np.zeros(dims) for _ in range(3))
        for at in range(0, n, step):
            vectors = self.words[codes[at : at + step + 1, 0]]
            word += vectors[:step].sum(0, dtype=np.float64)
            bound += np.einsum("ij,ij->j", vectors[1:], vectors[:-1], dtype=np.float64)
            part += self.words[codes[at : at + step, 1:].ravel()].sum(0, dtype=np.float64)
        return np.concatenate([word / max(n, 1), part / max(2 * n, 1), bound / max(n - 1, 1)]).astype(np.float32)


class TwoLayer:
    """Tanh layer and logistic output on standardised inputs, trained by Adam, with a calibrated temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: QualityParameters) -> None:
        rng = np.random.default_rng(p.seed + 1)
        order = rng.permutation(len(y))
        held = order[: max(1, len(y) // 5)] if len(y) >= 20 else order
        fit = order[len(y) // 5 :] if len(y) >= 20 else order
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        self.temperature = 1.0
        n_in = x.shape[1]
        self.p = [
            rng.standard_normal((n_in, p.hidden)) / n_in**0.5, np.zeros(p.hidden),
            rng.standard_normal(p.hidden) / p.hidden**0.5, np.zeros(1),
        ]
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        share = y.mean().clip(0.02, 0.98)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        for _ in range(p.epochs):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(z[part] @ self.p[0] + self.p[1])
                out = 1 / (1 + np.exp(-(h @ self.p[2] + self.p[3][0])))
                d = (out - y[part]) * weight[part] / len(part)
                dh = np.outer(d, self.p[2]) * (1 - h * h)
                grads = [z[part].T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        logit = self.logits(x[held])
        grid = np.geomspace(0.3, 8, 60)
        loss = [np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logit / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-30, 30)))


class QualityModel:
    def __init__(self, texts: list[str | None], labels: list[int], p: QualityParameters) -> None:
        codes = [codes_of(t, p.buckets) for t in texts]
        index = RandomIndex(p, context_sums(p, codes))
        self._learn(index, [index.pool(c) for c in codes], labels, p)

    @classmethod
    def of_pooled(cls, index: RandomIndex, pooled: list[np.ndarray], labels: list[int], p: QualityParameters) -> QualityModel:
        """The model of documents that are pooled already."""
        model = cls.__new__(cls)
        model._learn(index, pooled, labels, p)
        return model

    def _learn(self, index: RandomIndex, pooled: list[np.ndarray], labels: list[int], p: QualityParameters) -> None:
        self.buckets, self.index = p.buckets, index
        self.constant, self.learned = float(np.mean(labels)) if labels else 0.5, bool(labels)
        x = np.stack(pooled).astype(np.float64) if pooled else np.zeros((0, 1))
        self.net = TwoLayer(x, np.array(labels, float), p) if len(set(labels)) > 1 else None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), self.constant)
        return self.net.score(np.stack([self.index.pool(codes_of(t, self.buckets)) for t in texts]).astype(np.float64))


def _sum_parts(p: QualityParameters):
    """The context sums of a task's documents, a row for each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = context_sums(p, (codes_of(text.as_py(), p.buckets) for batch in sliced(batches) for text in batch.column("text")))
        held = np.flatnonzero(sums.any(1))
        for at in range(0, len(held), 1000):
            part = held[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([r.tobytes() for r in sums[part]], pa.binary())], ["bucket", "sums"])

    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket; all rows of a bucket must be in one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            part = np.frombuffer(raw, np.int64)
            total[bucket] = total[bucket] + part if bucket in total else part
    yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["bucket", "sums"])


def _pool(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shared.value.pool(codes_of(text.as_py(), buckets)).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())], ["doc_id", "quality", "pooled"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParameters | None = None) -> QualityModel:
    """Fit on at most ``params.sample`` rows that carry a 0/1 quality and are not held out.

    Labels are made distinct before the sample is drawn, so repeated ones do
    not crowd others out; null labels and null texts do no harm. Of rows that
    repeat an id the one with the least text counts. Without two classes the model scores the share of label 1 (0.5 without any label).
    Texts stay on the executors: the driver gets one vector a bucket and one a document.
    """
    p, spark = params or QualityParameters(), docs.sparkSession
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(p.sample)
    )
    # One row a picked label, so ``sample`` bounds the broadcast and the rows.
    ws = TextWorkspace(spark, "quality")
    rows = ws.keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text")),
        "sample",
    )
    with small_batches(spark):
        parts = rows.select("text").mapInArrow(_sum_parts(p), "bucket long, sums binary")
        sums = np.zeros((p.buckets, p.dims), np.int64)
        for r in parts.repartition("bucket").mapInArrow(_add_parts, "bucket long, sums binary").collect():
            sums[r[0]] = np.frombuffer(r[1], np.int64)
        index = RandomIndex(p, sums)
        shared = spark.sparkContext.broadcast(index)
        pooled = rows.mapInArrow(_pool(shared, p.buckets), "doc_id long, quality int, pooled binary").collect()
    ws.clear()
    pooled = sorted(pooled, key=lambda r: (r[0], r[1]))
    return QualityModel.of_pooled(index, [np.frombuffer(r[2], np.float32) for r in pooled], [r[1] for r in pooled], p)


#: A document is predicted to be of good quality from this score on.
ACCEPTED = 0.7


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = ACCEPTED) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` for every whole text.

    Only the text enters a score; null and empty texts are scored too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                score = shared.value.score(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = ACCEPTED) -> DataFrame:
    """The rows of ``docs``, with their columns, for which :func:`score_quality` predicts 1.

    All rows if the model has seen no label at all.
    """
    if not model.learned:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                score = shared.value.score(batch.column("text").to_pylist())
                yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
