"""Exact top-k inner products by the threshold algorithm over sorted lists (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table


class Products:
    """Exact integer inner products with the rows of a matrix, in floating point where every sum stays below 2**53."""

    def __init__(self, rows: np.ndarray) -> None:
        self._rows = rows.astype(np.int64)
        self._floats = self._rows.astype(np.float64)
        self._most = float(np.abs(self._floats).max(initial=0)) * rows.shape[1]

    def __call__(self, weights: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        if self._most * float(np.abs(weights.astype(np.float64)).max(initial=0)) < 2**53:
            return (self._floats[at] @ weights.astype(np.float64)).astype(np.int64)
        return self._rows[at] @ weights


class SortedLists:
    """One ascending list of rows for every dimension of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order].astype(np.int64)
        self.products = Products(values)
        lists = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, lists, 0)
        # A row of this matrix is one list, so sorted access reads memory in order.
        self.lists = np.ascontiguousarray(lists.T.astype(np.int32))

    def top(
        self, query: np.ndarray, k: int, exclude: int | None = None, floor: int | None = None, step: int = 8
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest inner products with ``query``, ties to the smaller id.

        Sorted access goes down the lists together, from the high end where
        the weight is positive and from the low end where it is negative, in
        rounds that double; every row met is scored in full at once. The bound
        on rows not met is the product of the weights with the values at the
        current depth. It stops when the k-th score is above that bound; at an
        equal score a row not met could still win by its id. ``floor`` is a
        score that k rows are known to reach, wherever they are: rows below it
        are left out, and it also stops when the bound falls below it.
        """
        n = len(self.ids)
        weights = query.astype(np.int64)
        dims = np.flatnonzero(weights)
        up = weights[dims] > 0
        highs, lows = dims[up], dims[~up]
        met = np.zeros(n, bool)
        if exclude is not None:
            met[self.ids == exclude] = True
        rows, scores, depth = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while depth < n:
            upto = min(n, depth + step)
            seen = met.copy()
            seen[self.lists[highs, n - upto : n - depth]] = True
            seen[self.lists[lows, depth:upto]] = True
            if not len(dims):
                seen[depth:upto] = True
            new = np.flatnonzero(seen & ~met)
            met = seen
            if len(new):
                score = self.products(weights, new)
                least = scores[-1] if len(rows) == k else floor
                if least is not None:
                    fit = score >= least
                    new, score = new[fit], score[fit]
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, score])
                best = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            depth, step = upto, step * 2
            if depth < n and (len(rows) == k or floor is not None):
                edge = int((np.where(up, self.sorted[n - 1 - depth, dims], self.sorted[depth, dims]) * weights[dims]).sum())
                if len(rows) == k and scores[-1] > edge or floor is not None and floor > edge:
                    break
        return self.ids[rows], scores


def _search(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "asked": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            values = rows["x"]
            for width, part in rows.groupby(values.map(len), sort=True):
                lists = SortedLists(part["vec_id"].to_numpy(), np.stack(part["x"].to_numpy()))
                for query_id, asked, q, floor in zip(queries["query_id"], queries["asked"], queries["x"], queries["floor"], strict=True):
                    if len(q) != width:
                        continue
                    found, scores = lists.top(np.asarray(q), k, query_id, floor[0] if len(floor) else None)
                    out["query_id"] += [query_id] * len(found)
                    out["asked"] += [asked] * len(found)
                    out["vec_id"] += found.tolist()
                    out["score"] += scores.tolist()
        return pd.DataFrame(out)

    return run


def _floors(k: int, shared):
    """Adds to each query the k-th best score among the anchors with other ids (an empty list if there are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = {}
        for batch in batches:
            floors = []
            for query_id, x in zip(batch.column("query_id").to_pylist(), batch.column("x"), strict=True):
                q = x.values.to_numpy()
                ids, anchors = shared.value.get(len(q), (np.empty(0, np.int64), None))
                others = ids != query_id
                if others.sum() < k:
                    floors.append([])
                    continue
                if len(q) not in products:
                    products[len(q)] = Products(anchors)
                floors.append([int(np.partition(products[len(q)](q)[others], -k)[-k])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.list_(pa.int64()))], [*batch.schema.names, "floor"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, x`` with ``floor(scale * component)``; null, null-holding and non-finite vectors are left out."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.col("bad"), F.lit(False)))
        .select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))
    )


def top_inner_products(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    k: int = 10,
    query_modulus: int = 100,
    row_block: int = 8192,
    query_block: int = 8192,
    anchors: int = 2048,
) -> DataFrame:
    """Exact highest integer inner products of every row whose id is divisible by ``query_modulus``.

    Output: ``query_id, rank, vec_id, score``, ties to the smaller id, a
    query's own id left out. Rows and queries are dealt into blocks by a hash
    of the id and every block of queries meets every block of rows; a task
    builds the sorted lists of its rows once and runs the threshold algorithm
    for each query; the k best of every block are then ranked together. The
    k-th best score among ``anchors`` rows, the first by a hash of the id, is a
    floor for all blocks, so a block without better rows stops early.

    Null vectors and ids, and vectors with null or non-finite components, take
    no part; vectors score only against vectors of their length; zero vectors
    score 0. Sums are those of 64-bit integers. Different vectors of one query
    id are queries each, equal ones are one query; rows that repeat an id are
    candidates each, and not of a query with their id. An empty table gives no
    rows; other columns are ignored.
    """
    base = integer_vectors(vectors, id_col, vector_col, scale)
    asked = base.filter(F.col("vec_id") % query_modulus == 0).dropDuplicates(["vec_id", "x"])
    n_rows, n_queries = base.count(), asked.count()
    cuts, parts = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    # Bounded by ``anchors``.
    held: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(anchors).collect():
        held.setdefault(len(r[1]), []).append(r)
    shared = vectors.sparkSession.sparkContext.broadcast(
        {w: (np.array([r[0] for r in rs]), np.array([r[1] for r in rs], np.int64).reshape(len(rs), w)) for w, rs in held.items()}
    )
    rows = base.withColumn("rb", F.pmod(F.xxhash64("vec_id", "x"), F.lit(cuts)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    queries = (
        asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("asked"), "x")
        .mapInArrow(_floors(k, shared), "query_id long, asked long, x array<long>, floor array<long>")
        .withColumn("qb", F.pmod(F.xxhash64("query_id", "asked", F.lit(1)), F.lit(parts)).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    )
    found = (
        queries.groupBy("rb", "qb")
        .cogroup(rows.groupBy("rb", "qb"))
        .applyInPandas(_search(k), "query_id long, asked long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op4_top_inner_products(spark, sf_dir: str) -> DataFrame:
    """Ten highest integer inner products of every hundredth embedding."""
    return top_inner_products(table(spark, sf_dir, "embeddings"))


#: Integer inner products of all query-candidate pairs, ranked.
OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
