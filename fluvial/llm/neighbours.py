"""Approximate nearest neighbours by adaptive dimension scan in probed lists (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, sliced, table


@dataclass(frozen=True)
class AnnParameters:
    """Parameters of the index and of the search.

    ``sample`` vectors at most fit the centroids (chosen by hash of the id);
    every vector is indexed. The number of lists grows with the square root of
    the rows: at most ``max_centres`` coarse centroids, each with as many
    residual centroids as it takes. The number of probed lists, at least
    ``min_probes``, is the least that finds a share of ``target`` of the
    neighbours which ``trials`` sample vectors have in the sample. ``anchors``
    sample vectors at most give every query a first bound on its k-th distance.
    ``block`` rows and ``block`` queries of a list at most meet in a task. ``epsilon``
    is the width of the hypothesis test: a candidate is abandoned after d of D
    dimensions when its scaled partial distance exceeds
    (1 + epsilon / sqrt(d)) times the k-th distance so far.
    """

    k: int = 10
    sample: int = 20_000
    max_centres: int = 2048
    target: float = 0.97
    trials: int = 256
    min_probes: int = 4
    anchors: int = 512
    block: int = 8192
    columns: int = 16
    epsilon: float = 2.1
    seed: int = 7


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` without vectors that are null, empty, zero or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.aggregate(
        v,
        F.lit(0.0).cast("double"),
        lambda s, x: s + F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float("nan"))).otherwise(F.abs(x)),
    )
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.isnan(ok) & (ok > 0)
    )


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Lloyd centroids of a bounded sample; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_lists(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of every row, nearest first."""
    d = (centres * centres).sum(1) - 2 * (x @ centres.T)
    if n == 1:
        return d.argmin(1)[:, None]
    part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


class CellIndex:
    """Lists in two levels: a coarse centroid and, within it, a centroid of the residuals that all coarse ones share.

    One residual centroid, the null vector, makes it an index of one level.
    """

    def __init__(self, x: np.ndarray, lists: int, max_centres: int, seed: int) -> None:
        most = max(1, len(x) // 8)
        coarse = min(lists, max_centres, most)
        self.coarse = kmeans(x, coarse, seed)
        fine = min(-(-lists // coarse), max_centres, most)
        rest = x - self.coarse[nearest_lists(x, self.coarse, 1)[:, 0]]
        self.fine = kmeans(rest, fine, seed + 1) if fine > 1 else np.zeros((1, x.shape[1]))
        self.cells = len(self.coarse) * len(self.fine)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The list of every row."""
        near = nearest_lists(x, self.coarse, 1)[:, 0]
        return near * len(self.fine) + nearest_lists(x - self.coarse[near], self.fine, 1)[:, 0]

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of every row, nearest first, among those of its ``n`` nearest coarse centroids."""
        n = min(n, self.cells)
        near = nearest_lists(x, self.coarse, min(n, len(self.coarse)))
        if len(self.fine) == 1:
            return near
        out = np.empty((len(x), n), np.int64)
        for i, row in enumerate(x):
            centres = self.coarse[near[i]]
            d = ((row - centres) ** 2).sum(1)[:, None] - 2 * (row - centres) @ self.fine.T + (self.fine**2).sum(1)
            cells = (near[i][:, None] * len(self.fine) + np.arange(len(self.fine))).ravel()
            best = np.argsort(d.ravel(), kind="stable")[:n]
            out[i] = cells[best]
        return out


def probes_for(x: np.ndarray, index: CellIndex, k: int, trials: int, target: float) -> int:
    """Lists to probe for a recall of ``target`` among the vectors of ``x`` themselves."""
    home, asked = index.home(x), x[:trials]
    d = (x * x).sum(1) - 2 * (asked @ x.T)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    if not near.size:
        return 1
    places = []
    for at in range(0, len(asked), 16):
        place = np.argsort(index.ranked(asked[at : at + 16], index.cells), axis=1)
        places.append(np.take_along_axis(place, home[near[at : at + 16]], 1))
    return int(np.quantile(np.concatenate(places), target)) + 1


def adaptive_scan(
    query: np.ndarray, rotated: np.ndarray, k: int, columns: int, epsilon: float, bound: float = np.inf, chunk: int = 1024
) -> np.ndarray:
    """Positions of the rows that were not abandoned, in a list scanned in chunks.

    Both arguments are rotated. Each chunk adds column blocks to the partial
    squared distances of the rows still alive; a row leaves as soon as the
    test says that its distance is beyond ``bound``, a squared distance that
    the k-th nearest cannot exceed, and that the earlier chunks tighten.
    """
    dims, kept, best = rotated.shape[1], [], np.empty(0)
    for at in range(0, len(rotated), chunk):
        alive = np.arange(at, min(at + chunk, len(rotated)))
        partial = np.zeros(len(alive))
        for d in range(0, dims, columns):
            diff = rotated[alive, d : d + columns] - query[d : d + columns]
            partial += np.einsum("ij,ij->i", diff, diff)
            seen = min(d + columns, dims)
            factor = 1.0 + (epsilon / np.sqrt(seen) if seen < dims else 1e-9)
            stay = partial * (dims / seen) <= factor * factor * bound
            alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        kept.append(alive)
        best = np.sort(np.concatenate([best, partial]))[:k]
        if len(best) == k:
            bound = min(bound, best[-1])
    return np.concatenate(kept) if kept else np.empty(0, int)


def _search_block(p: AnnParameters):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "asked": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, original, rotated = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()), np.stack(rows["r"].to_numpy())
            for query_id, asked, q, qr, bound in zip(queries["query_id"], queries["asked"], queries["v"], queries["r"], queries["bound"], strict=True):
                # Rows with the query's id are left out first, so that they do not tighten the bound.
                others = np.flatnonzero(ids != query_id)
                kept = others[adaptive_scan(qr, rotated if len(others) == len(ids) else rotated[others], p.k, p.columns, p.epsilon, bound)]
                diff = original[kept] - q
                score = np.sqrt((diff * diff).sum(1))
                top = np.lexsort((ids[kept], score))[: p.k]
                out["query_id"] += [query_id] * len(top)
                out["asked"] += [asked] * len(top)
                out["vec_id"] += ids[kept][top].tolist()
                out["score"] += score[top].tolist()
        return pd.DataFrame(out)

    return run


def nearest_neighbours(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_modulus: int = 100,
    params: AnnParameters | None = None,
) -> DataFrame:
    """Nearest rows by Euclidean distance of every row whose id is divisible by ``query_modulus``.

    Output: ``query_id, rank, vec_id, score``, ranked from 1, ties to the
    smaller id; all candidates if there are fewer than k. A query probes its
    nearest lists; the distance of its k-th anchor bounds the scan from the
    start. Anchors themselves are candidates only of a query to which the lists
    leave fewer than k. A list with more than ``block``
    rows or asked by more than ``block`` queries is dealt to several tasks by
    hashes of the ids, so a list with a third of all rows is no single task's
    work. Distances of candidates that survive the scan are those of the
    original vectors.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do null ids. Vectors meet only vectors of their length,
    each length with an index of its own. Rows that repeat an id are candidates
    each, and not of a query with their id; different vectors of one query id
    are queries each, equal ones are one query. An empty table gives no rows.
    Other columns are ignored.
    """
    p = params or AnnParameters()
    base = usable(vectors, id_col, vector_col)
    # One row a length.
    lengths = sorted((r[0], r[1]) for r in base.groupBy(F.size("v")).count().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search_length(base.filter(F.size("v") == dims), dims, total, query_modulus, p) for dims, total in lengths]
    return reduce(DataFrame.unionByName, found)


def _search_length(base: DataFrame, dims: int, total: int, query_modulus: int, p: AnnParameters) -> DataFrame:
    """:func:`nearest_neighbours` among the ``total`` rows ``vec_id, v`` of length ``dims``."""
    spark = base.sparkSession
    # Bounded by ``sample``.
    sampled = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("vec_id", "v").collect()
    x = np.stack([np.asarray(r[1]) for r in sampled])
    rotation = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((dims, dims)))[0]
    index = CellIndex(x @ rotation, int(max(1, total**0.5 / 2)), p.max_centres, p.seed)
    probes = min(index.cells, max(p.min_probes, probes_for(x @ rotation, index, p.k, p.trials, p.target)))
    anchors = x[: p.anchors]
    shared = spark.sparkContext.broadcast((rotation, index, anchors, anchors @ rotation, np.array([r[0] for r in sampled[: p.anchors]])))

    def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def lists_of(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot, cells, *_ = shared.value
        for batch in batches:
            if batch.num_rows:
                turned = vectors_of(batch) @ rot
                yield pa.RecordBatch.from_arrays([*batch.columns, lists_of(turned), pa.array(cells.home(turned))], ["vec_id", "v", "r", "list"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot, cells, original, rotated, anchor_ids = shared.value
        for batch in sliced(batches):
            flat, own = vectors_of(batch), batch.column(0).to_numpy()
            turned, bound, near = flat @ rot, np.full(len(flat), np.inf), []
            for i, q in enumerate(turned):
                # The k nearest of the anchors with other ids, with room for rounding in the rotation.
                others = np.flatnonzero(anchor_ids != own[i])
                d = ((rotated[others] - q) ** 2).sum(1)
                best = np.argpartition(d, p.k - 1)[: p.k] if len(d) > p.k else np.arange(len(d))
                if len(best) == p.k:
                    bound[i] = d[best].max() * (1 + 1e-9) + 1e-24 * (q @ q)
                diff = original[others[best]] - flat[i]
                score = np.sqrt((diff * diff).sum(1))
                near.append([{"vec_id": int(a), "score": float(b)} for a, b in zip(anchor_ids[others[best]], score, strict=True)])
            lists = cells.ranked(turned, probes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists_of(turned), lists_of(lists), pa.array(bound), pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))],
                ["vec_id", "v", "r", "lists", "bound", "near"],
            )

    ws = Workspace(spark, "ann")
    indexed = ws.keep(base.mapInArrow(place, "vec_id long, v array<double>, r array<double>, list long"), "index")
    queries = base.filter(F.col("vec_id") % query_modulus == 0).dropDuplicates(["vec_id", "v"])
    queries = queries.mapInArrow(ask, "vec_id long, v array<double>, r array<double>, lists array<long>, bound double, near array<struct<vec_id: long, score: double>>")
    queries = ws.keep(queries.withColumnRenamed("vec_id", "query_id").withColumn("asked", F.xxhash64("v")), "queries")
    # One row a list; written, so that its size is known where it is joined.
    asking = queries.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("parts"))
    sizes = ws.keep(indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks")).join(asking, "list"), "sizes")
    rows = indexed.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "r"
    )
    asked = (
        queries.select("query_id", "asked", "v", "r", "bound", F.explode("lists").alias("list"))
        .join(sizes, "list")
        .select("query_id", "asked", "v", "r", "bound", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id", "asked"), F.col("parts")).cast("int").alias("part"))
    )
    found = (
        asked.groupBy("list", "block", "part")
        .cogroup(rows.groupBy("list", "block", "part"))
        .applyInPandas(_search_block(p), "query_id long, asked long, vec_id long, score double")
    )
    key = ["query_id", "asked", "vec_id", "score"]
    firsts = queries.select("query_id", "asked", F.explode("near").alias("a")).select("query_id", "asked", "a.vec_id", "a.score", F.lit(1).alias("first"))
    # An anchor that the scan has found as well is one candidate; rows that repeat an id stay as many as there are.
    both = found.withColumn("first", F.lit(0)).union(firsts).groupBy(*key).agg(F.sum("first").alias("a"), F.sum(1 - F.col("first")).alias("b"))
    listed = F.sum("b").over(Window.partitionBy("query_id", "asked"))
    both = both.withColumn("n", F.when(listed >= p.k, F.col("b")).otherwise(F.greatest("a", "b"))).filter("n > 0")
    both = both.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    order = Window.partitionBy("query_id", "asked").orderBy("score", "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """Ten nearest embeddings of every hundredth one."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
