"""Language identification by a byte convolutional network (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextWorkspace, is_held_out, small_batches, table, sliced

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageParameters:
    """``sample`` documents at most train the network, chosen by a hash of the id; each gives at most ``windows`` windows."""

    sample: int = 6000
    windows: int = 4
    window: int = 128
    widths: tuple[int, ...] = field(default=(2, 3, 4))
    filters: int = 16
    epochs: int = 6
    seed: int = 5


class ByteConvNet:
    """Filters of several widths over one-hot bytes, max pooling over the window, softmax.

    A filter of width w is w tables of 256 rows, so a convolution is a sum of
    gathered rows. Padding bytes are blanks.
    """

    def __init__(self, languages: list[str], p: LanguageParameters) -> None:
        rng = np.random.default_rng(p.seed)
        self.p, self.languages = p, languages
        self.filters = [rng.standard_normal((w, 256, p.filters)).astype(np.float32) * 0.3 for w in p.widths]
        n = len(p.widths) * p.filters
        self.weight = (rng.standard_normal((n, len(languages))) / n**0.5).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self._pairs: tuple[np.ndarray, np.ndarray] | None = None

    def _pool(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, places = [], []
        for w, f in zip(self.p.widths, self.filters, strict=True):
            length = windows.shape[1] - w + 1
            z = f[0][windows[:, :length]]
            for k in range(1, w):
                z += f[k][windows[:, k : k + length]]
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0, :])
            places.append(at)
        return np.concatenate(pooled, 1), places

    def fit(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the cross entropy; max pooling sends each gradient to one position."""
        p, rng = self.p, np.random.default_rng(self.p.seed + 1)
        params = [*self.filters, self.weight, self.bias]
        m, v, t = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], 0
        share = np.bincount(labels, minlength=len(self.languages)) / max(1, len(labels))
        balance = (1 / np.maximum(share, 1e-3)) ** 0.5
        balance /= (balance * share).sum()
        for _ in range(p.epochs):
            for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 128)):
                x, y = windows[part], labels[part]
                pooled, places = self._pool(x)
                h = np.maximum(pooled, 0)
                logit = h @ self.weight + self.bias
                q = np.exp(logit - logit.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(y)), y] -= 1
                q *= (balance[y] / len(y))[:, None].astype(np.float32)
                back = (q @ self.weight.T) * (pooled > 0)
                grads = []
                for i, (w, f) in enumerate(zip(p.widths, self.filters, strict=True)):
                    g, part_back = np.zeros_like(f), back[:, i * p.filters : (i + 1) * p.filters]
                    for k in range(w):
                        bytes_at = np.take_along_axis(x, places[i] + k, 1)
                        np.add.at(g[k], (bytes_at, np.arange(p.filters)[None, :]), part_back)
                    grads.append(g)
                grads += [h.T @ q, q.sum(0)]
                t += 1
                for i, (a, g) in enumerate(zip(params, grads, strict=True)):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    a -= (0.01 / (1 - 0.9**t)) * m[i] / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filters of widths 2, 3 and 4 as two tables over byte pairs, at a position and two further on."""
        if self._pairs is None:
            pair = lambda f, k: (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1)
            f2, f3, f4 = self.filters
            single = np.repeat(f3[2], 256, axis=0)
            self._pairs = (
                np.concatenate([pair(f2, 0), pair(f3, 0), pair(f4, 0)], 1).astype(np.float32),
                np.concatenate([single, pair(f4, 2)], 1).astype(np.float32),
            )
        return self._pairs

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Logits of windows (uint8, rows of one length), in batches."""
        if self.p.widths != (2, 3, 4):
            pooled = self._pool(windows)[0]
        else:
            head, tail = self._tables()
            n, f = self.p.filters, windows.shape[1]
            pooled = np.empty((len(windows), 3 * n), np.float32)
            for at in range(0, len(windows), 256):
                x = windows[at : at + 256].astype(np.int32)
                code = x[:, :-1] * 256 + x[:, 1:]
                z = np.take(head, code[:, : f - 3], axis=0)
                z[:, :, n:] += np.take(tail, code[:, 2:], axis=0)
                out = z.max(1)
                # The last positions that only the narrow filters reach.
                last = np.take(head, code[:, f - 3 :], axis=0)
                np.maximum(out[:, :n], last[:, :, :n].max(1), out=out[:, :n])
                np.maximum(out[:, n : 2 * n], last[:, 0, n : 2 * n] + self.filters[1][2][x[:, f - 1]], out=out[:, n : 2 * n])
                pooled[at : at + 256] = out
        return np.maximum(pooled, 0) @ self.weight + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of whole texts: the mean logits of all windows, then softmax."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        at, cut = [], []
        pending = 0
        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            at.append(i)
            cut.append(windows_of(text, self.p.window))
            pending += len(cut[-1])
            if pending >= 4096:
                self._settle(at, cut, names, scores)
                at, cut, pending = [], [], 0
        self._settle(at, cut, names, scores)
        return names, scores

    def _settle(self, at: list[int], cut: list[np.ndarray], names: list[str], scores: np.ndarray) -> None:
        if not at:
            return
        logits = self.logits(np.concatenate(cut))
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        mean = np.add.reduceat(logits, starts, axis=0) / np.array([len(c) for c in cut])[:, None]
        q = np.exp(mean - mean.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        for i, row in zip(at, q, strict=True):
            names[i], scores[i] = self.languages[int(row.argmax())], float(row.max())


def windows_of(text: str, length: int) -> np.ndarray:
    """All UTF-8 bytes of a text in rows of ``length``; the last one is filled with blanks."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // length))
    out = np.full(n * length, 32, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, length)


def window_count(text: str | None, length: int) -> int:
    """Number of windows of a text, 0 if it has no letter."""
    if not text or not _LETTER.search(text):
        return 0
    return max(1, -(-len(text.encode("utf-8", "surrogatepass")) // length))


def drawn_windows(counts: list[int], p: LanguageParameters) -> list[list[int]]:
    """Numbers of the windows that train the network, for texts that have ``counts`` windows."""
    rng = np.random.default_rng(p.seed)
    return [rng.permutation(n)[: p.windows].tolist() if n else [] for n in counts]


def fit_windows(windows: list[np.ndarray], langs: list[str], p: LanguageParameters) -> ByteConvNet:
    """Network learned from each text's drawn windows (rows of uint8, none for a text without a letter)."""
    languages = sorted(set(langs))
    net = ByteConvNet(languages, p)
    if len(languages) > 1 and any(map(len, windows)):
        labels = [languages.index(lang) for lang, w in zip(langs, windows, strict=True) for _ in range(len(w))]
        net.fit(np.concatenate([w for w in windows if len(w)]), np.array(labels))
    return net


def fit_network(texts: list[str], langs: list[str], p: LanguageParameters) -> ByteConvNet:
    drawn = drawn_windows([window_count(text, p.window) for text in texts], p)
    return fit_windows([windows_of(text or "", p.window)[d] for text, d in zip(texts, drawn, strict=True)], langs, p)


def _counts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [window_count(text.as_py(), length) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.int64())], ["doc_id", "lang", "n"])

    return run


def _cut(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                drawn = shared.value[doc_id]
                found.append(windows_of(text.as_py(), length)[drawn].tobytes() if drawn else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "windows"])

    return run


def train_languages(docs: DataFrame, params: LanguageParameters | None = None) -> ByteConvNet:
    """Fit on at most ``params.sample`` documents with text and language that are not held out.

    Ids are made distinct before the sample is drawn. Of rows that repeat an id the one with the least language and text counts.
    Texts stay on the executors: the driver gets the number of windows of each
    and then the drawn windows, at most ``params.windows`` a document.
    """
    p, spark = params or LanguageParameters(), docs.sparkSession
    ids = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(p.sample)
    )
    # The ids first, so that whole texts are not sorted; then one row an id.
    ws = TextWorkspace(spark, "languages")
    rows = ws.keep(
        docs.select("doc_id", "text", "lang")
        .filter("lang is not null and text is not null")
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct("lang", "text")).alias("row"))
        .select("doc_id", "row.lang", "row.text"),
        "sample",
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    with small_batches(spark):
        counts = sorted(rows.mapInArrow(_counts(p.window), f"doc_id {kind}, lang string, n long").collect(), key=lambda r: r[0])
        drawn = spark.sparkContext.broadcast({r[0]: w for r, w in zip(counts, drawn_windows([r[2] for r in counts], p), strict=True)})
        cut = {r[0]: r[1] for r in rows.mapInArrow(_cut(drawn, p.window), f"doc_id {kind}, windows binary").collect()}
    ws.clear()
    return fit_windows([np.frombuffer(cut[r[0]], np.uint8).reshape(-1, p.window) for r in counts], [r[1] for r in counts], p)


def predict_languages(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    ``und`` with score 0 for a null text or one without a letter, or if nothing
    was learned. A very long text is cut into windows of fixed length, all of
    which count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                texts = batch.column(1).to_pylist()
                names, scores = shared.value.predict(texts) if shared.value.languages else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_determined(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """The rows of ``docs``, with their columns, for which :func:`predict_languages` gives a language, not ``und``.

    All rows if the network has learned no language.
    """
    if not net.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                names, _ = shared.value.predict(batch.column("text").to_pylist())
                yield batch.filter(pa.array([n != UNDETERMINED for n in names]))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, train_languages(docs))
