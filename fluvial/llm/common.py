"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Workspace, scratch_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory through Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Configured number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(text: Column) -> Column:
    """UTF-8 length of a text, null counting as empty."""
    return F.octet_length(F.coalesce(text, F.lit("")))


def is_held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gapless_index(
    df: DataFrame, within: Sequence[str], order: Sequence[str], out: str, buckets: int
) -> DataFrame:
    """Number the rows of each ``within`` group from 0 without sorting a whole group in one task.

    Equal rows are counted first, since their numbers are interchangeable, so
    they need not meet in one task. Rows then fall into ``buckets`` hash buckets, each
    bucket is numbered by a window, and the bucket's start is a prefix sum over
    at most ``buckets`` counts a group. ``df`` is evaluated twice, so pass a
    materialised one. The prefix table has ``groups * buckets`` rows;
    broadcasting is left to the optimizer, which checks its size.
    """
    bucket, base, local = "_gl_bucket", "_gl_base", "_gl_local"
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_gl_c"))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*within, bucket).agg(F.sum("_gl_c").alias("_gl_n"))
    prefix = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_gl_{c}") for c in within],
        F.col(bucket).alias("_gl_b"),
        F.coalesce(F.sum("_gl_n").over(prefix), F.lit(0)).alias(base),
    )
    inner = Window.partitionBy(*within, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn(local, F.coalesce(F.sum("_gl_c").over(inner), F.lit(0)))
    match = [F.col(c).eqNullSafe(F.col(f"_gl_{c}")) for c in within] + [F.col(bucket) == F.col("_gl_b")]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return (
        numbered.join(starts, cond)
        .withColumn("_gl_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_gl_c") - 1)))
        .withColumn(out, F.col(base) + F.col(local) + F.col("_gl_i"))
        .select(*df.columns, out)
    )


def join_hot(rows: DataFrame, values: DataFrame, keys: Sequence[str], count: str, floor: int = 10_000, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with one row of ``values`` a key (nulls are equal), where a key may hold most of the rows.

    ``count`` is a column of ``values``, dropped here, that says how many rows
    have the key. Keys with more than ``floor`` rows and more than a
    ``share``-th of all are fewer than ``share``; their values are broadcast
    and their rows do not move. The others are joined by key, so no task gets
    more of one key than that. Both tables are evaluated twice: pass ``rows``
    written.
    """
    spark = rows.sparkSession
    values = Workspace(spark, "values").keep(values, "counted")
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(floor, total // share)
    names = [f"_jh_{k}" for k in keys]
    side = values.drop(count).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    found = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    few = values.filter(hot).drop(count).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    if not few.head(1):
        return rows.join(side, found, "left").drop(*names)
    near = rows.join(F.broadcast(few), found).drop(*names)
    rest = rows.join(F.broadcast(few.select(*names)), found, "left_anti").join(side, found, "left").drop(*names)
    return near.unionByName(rest)


def calm_collector() -> None:
    """Let a Python worker look for cycles rarely, since its large caches hold none; other processes are left alone."""
    import gc

    from pyspark import TaskContext

    if TaskContext.get() is not None:
        gc.set_threshold(500_000, 100, 1000)


_held: dict = {}


def worker_cache(owner: tuple, build):
    """What an operator keeps in this Python worker between tasks; the next operator's replaces it."""
    if owner not in _held:
        _held.clear()
        _held[owner] = build()
    return _held[owner]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, nbytes: int = 4 << 20) -> Iterator[None]:
    """Bounds the Arrow batches, by rows and bytes, of what is executed inside; the session's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": nbytes}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, most in wanted.items():
            now = int(before[key]) if before[key] and before[key].lstrip("-").isdigit() else 0
            if now <= 0 or now > most:
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class TextWorkspace(Workspace):
    """A workspace whose tables are made from texts in Python: small Arrow batches while they are written."""

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        with small_batches(df.sparkSession):
            return super().keep(df, label)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``rows``, so that what Python makes of long texts does not add up.

    Spark itself bounds a batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class BoundedCache(dict):
    """Dictionary that computes absent entries and keeps at most two generations of ``limit`` of them.

    Only keys of up to 64 characters are kept, so its memory is bounded.
    """

    def __init__(self, compute, limit: int) -> None:
        super().__init__()
        self._compute, self._limit, self._old = compute, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
            if len(key) > 64:
                return value
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value
