"""Vector codes by parts, nearest entries found in annuli of the norm (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot, sliced, table


@dataclass(frozen=True)
class CodeParameters:
    """``parts`` codebooks of at most ``entries`` entries, fitted in ``rounds``; components are floor(``scale`` * x)."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


#: Squared distances of whole numbers below this stay exact in 64 bits, times the entries of a codebook.
_NARROW = 1 << 24


def whole_parts(rows: list, p: CodeParameters) -> np.ndarray:
    """Whole components of vectors of one length, as (row, part, place).

    A length that the number of parts does not divide is filled up with zeros.
    Components beyond 2**24 make the array one of Python's whole numbers, so
    that no sum overflows.
    """
    x = np.asarray(rows, np.float64)
    n, dims = len(rows), x.shape[1] if x.ndim == 2 else 0
    x = np.floor(x.reshape(n, dims) * p.scale)
    wide = bool(np.abs(x).max(initial=0) >= _NARROW)
    whole = np.array([[int(c) for c in row] for row in x], object).reshape(n, dims) if wide else x.astype(np.int64)
    width = -(-dims // p.parts)
    out = np.zeros((n, p.parts * width), whole.dtype)
    out[:, :dims] = whole
    return out.reshape(n, p.parts, width)


class AnnularCodebook:
    """Entries of one part sorted by norm.

    By the triangle inequality an entry at least as near as ``d`` has a norm
    within ``d`` of the norm of the part. Entries of nearby norms give a first
    distance; binary searches for the ends of the interval that it allows then
    leave an annulus, both ends included, of which every entry is measured
    exactly. The interval is widened by more than norms in floating point err.
    """

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def nearest(self, x: np.ndarray, seeds: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry and squared distance of every row, ties to the lower index, and the entries measured."""
        n, k = len(x), len(self.entries)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        first = np.clip(np.searchsorted(self.norms, norm) - seeds // 2, 0, max(0, k - seeds))
        best = None
        for s in range(min(seeds, k)):
            diff = x - self.entries[first + s]
            d = (diff * diff).sum(1)
            best = d if best is None else np.minimum(best, d)
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (1.0 + norm + reach)
        low = np.searchsorted(self.norms, norm - reach - slack, "left")
        high = np.searchsorted(self.norms, norm + reach + slack, "right")
        size = high - low
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        row = np.repeat(np.arange(n), size)
        at = np.arange(int(size.sum())) - np.repeat(starts - low, size)
        diff = x[row] - self.entries[at]
        # One number that orders by distance, then by index.
        ranked = (diff * diff).sum(1) * k + self.order[at]
        least = np.minimum.reduceat(ranked, starts) if n else ranked
        return (least % k).astype(np.int64), least // k, int(size.sum()) + n * min(seeds, k)


def encode(x: np.ndarray, books: list[AnnularCodebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and the error of every row."""
    found = [book.nearest(x[:, j]) for j, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), sum(f[1] for f in found)


def _partial_sums(p: CodeParameters, shared):
    """A task's count and sum of the parts that each entry has, as decimal text, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total = [AnnularCodebook(b) for b in shared.value], {}
        for batch in sliced(batches):
            x = whole_parts(batch.column("v").to_pylist(), p)
            code, _ = encode(x, books)
            for j in range(p.parts):
                for e in np.unique(code[:, j]):
                    mine = x[code[:, j] == e, j]
                    add = [len(mine), *(int(s) for s in mine.sum(0))]
                    old = total.get((j, int(e)))
                    total[j, int(e)] = [a + b for a, b in zip(old, add, strict=True)] if old else add
        keys = [*total]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([[str(s) for s in total[k]] for k in keys], pa.list_(pa.string()))],
            ["part", "entry", "sums"],
        )

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an entry; all rows of an entry must be in one task."""
    total: dict = {}
    for batch in batches:
        for part, entry, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            add, old = [int(s) for s in sums], total.get((part, entry))
            total[part, entry] = [a + b for a, b in zip(old, add, strict=True)] if old else add
    keys = [*total]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([[str(s) for s in total[k]] for k in keys], pa.list_(pa.string()))],
        ["part", "entry", "sums"],
    )


_SUMS = "part int, entry int, sums array<string>"


def fit_codebooks(base: DataFrame, p: CodeParameters) -> list[np.ndarray]:
    """Codebooks (entry, place) of the rows ``vec_id, v`` of one length, after ``p.rounds`` rounds.

    They start as the parts of the rows with the ``p.entries`` smallest ids
    (null ids last; rows of one id in the order of their vectors). An entry
    becomes the componentwise floor of the mean of the parts nearest to it.
    The driver holds the codebooks, whose size the parameters bound.
    """
    spark = base.sparkSession
    first = base.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(p.entries).select("v").collect()
    start = whole_parts([r[0] for r in first], p)
    books = [start[:, j].copy() for j in range(p.parts)]
    for _ in range(p.rounds):
        shared = spark.sparkContext.broadcast(books)
        parts = base.select("v").mapInArrow(_partial_sums(p, shared), _SUMS)
        # At most parts * entries rows, one for each entry that is used.
        means = {(r[0], r[1]): [int(s) for s in r[2]] for r in parts.repartition("part", "entry").mapInArrow(_add_sums, _SUMS).collect()}
        grown = []
        for j, book in enumerate(books):
            rows = [[s // means[j, e][0] for s in means[j, e][1:]] if (j, e) in means else [int(c) for c in book[e]] for e in range(len(book))]
            wide = any(abs(c) >= _NARROW for row in rows for c in row)
            grown.append(np.array(rows, object if wide else np.int64).reshape(book.shape))
        books = grown
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for book in books for row in book for c in row).encode()).hexdigest()


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, v, label`` without vectors that are null or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).alias("label")).filter(F.col("v").isNotNull() & ok)


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: CodeParameters | None = None
) -> DataFrame:
    """Codes of all vectors: ``vec_id, code, error, label_error, codebooks_sha256``.

    ``code`` has two hex digits a part, ``error`` is the squared distance to
    the coded vector, ``label_error`` its sum over the rows of the label (null
    labels are one label); sums beyond 64 bits are null. Vectors that are null
    or hold null or non-finite components are dropped; zero vectors stay.
    Vectors of each length have codebooks of their own; a length that the
    parts do not divide is filled up with zeros, and an empty vector has error
    0. Fewer rows than entries make smaller codebooks. Rows that repeat an id
    are rows each; null ids are kept. An empty table gives no rows. Other
    columns are ignored.
    """
    p = params or CodeParameters()
    if not 1 <= p.entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    base = finite_vectors(vectors, id_col, vector_col, label_col)
    spark = base.sparkSession
    lengths = sorted(r[0] for r in base.select(F.size("v").alias("dims")).distinct().collect())
    label_type = base.schema["label"].dataType.simpleString()
    if not lengths:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = reduce(DataFrame.unionByName, [_code_length(base.filter(F.size("v") == dims), p, label_type) for dims in lengths])
    rows = Workspace(spark, "codes").keep(coded, "rows")
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error"))
    whole = lambda c: F.col(c).try_cast("long").alias(c)
    return join_hot(rows, sums, ["label"], "rows").select("vec_id", "code", whole("error"), whole("label_error"), "codebooks_sha256")


def _code_length(base: DataFrame, p: CodeParameters, label_type: str) -> DataFrame:
    """Codes of vectors of one length, with the error as a decimal."""
    books = fit_codebooks(base, p)
    shared = base.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [AnnularCodebook(b) for b in shared.value]
        for batch in sliced(batches):
            if batch.num_rows:
                code, error = encode(whole_parts(batch.column("v").to_pylist(), p), held)
                hexes = [bytes(row).hex() for row in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(hexes), pa.array([str(e) for e in error.tolist()])], ["vec_id", "label", "code", "error"]
                )

    coded = base.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label_type}, code string, error string")
    return coded.select("vec_id", "label", "code", F.col("error").try_cast("decimal(38,0)").alias("error"), F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The whole computation for DuckDB: every part against every entry, two rounds."""
    nearest = """
a{r} AS (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, e.entry, CAST(list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM part p JOIN e{r} e ON p.part = e.part) GROUP BY ALL)"""
    mean = """
e{n} AS (SELECT o.part, o.entry, coalesce(m.x, o.x) AS x FROM e{r} o LEFT JOIN (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) - CASE WHEN CAST(floor(s / n) AS BIGINT) * n > s THEN 1 ELSE 0 END ORDER BY place) AS x FROM (
    SELECT part, entry, place, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (
      SELECT a.part, a.entry, unnest(range(1, len(p.x) + 1)) AS place, unnest(p.x) AS c FROM a{r} a JOIN part p ON p.vec_id = a.vec_id AND p.part = a.part) GROUP BY ALL) GROUP BY ALL) m
  ON m.part = o.part AND m.entry = o.entry)"""
    rounds = ",".join(nearest.format(r=r) + ("," + mean.format(r=r, n=r + 1) if r < 2 else "") for r in range(3))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, j AS part, x[j * len(x) // 16 + 1 : (j + 1) * len(x) // 16] AS x FROM v CROSS JOIN range(16) AS t(j)),
e0 AS (SELECT part, rank - 1 AS entry, x FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM v) f USING (vec_id) WHERE rank <= 64),
{rounds},
book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (
  SELECT part, entry, unnest(range(1, len(x) + 1)) AS place, unnest(x) AS c FROM e2)),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id) CROSS JOIN book
"""


OP11_SQL = _sql()
