"""Sharding by best-fit-decreasing bin packing of indivisible groups (operator 1)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, gapless_index, shuffle_width, table, text_bytes


class CapacityTree:
    """Balanced two-level tree over ``(remaining, bin)``: leaves of bounded size, one root.

    Leaves split at ``2 * leaf`` entries and vanish when empty, so a search,
    an insertion and a deletion touch one root position and one leaf.
    """

    def __init__(self, leaf: int = 256) -> None:
        self._leaf, self._leaves, self._max = leaf, [], []

    def add(self, remaining: int, bin_id: int) -> None:
        item = (remaining, bin_id)
        if not self._leaves:
            self._leaves, self._max = [[item]], [item]
            return
        i = min(bisect_left(self._max, item), len(self._leaves) - 1)
        insort(self._leaves[i], item)
        if len(self._leaves[i]) > 2 * self._leaf:
            tail = self._leaves[i][self._leaf :]
            del self._leaves[i][self._leaf :]
            self._leaves.insert(i + 1, tail)
            self._max.insert(i + 1, tail[-1])
        self._max[i] = self._leaves[i][-1]

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least remaining capacity of at least ``size``."""
        i = bisect_left(self._max, (size, -1))
        if i == len(self._leaves):
            return None
        j = bisect_left(self._leaves[i], (size, -1))
        item = self._leaves[i].pop(j)
        if self._leaves[i]:
            self._max[i] = self._leaves[i][-1]
        else:
            del self._leaves[i], self._max[i]
        return item


def best_fit_decreasing(sizes: list[int], capacity: int, bins: CapacityTree | None = None) -> tuple[list[int], int]:
    """Bin of every item (given in descending size) and the number of bins opened.

    An item above ``capacity`` gets a bin of its own.
    """
    tree, out, n = bins or CapacityTree(), [], 0
    for size in sizes:
        found = tree.pop_tightest(size)
        if found is None:
            found, n = (max(capacity, size), n), n + 1
        out.append(found[1])
        tree.add(found[0] - size, found[1])
    return out, n


def balanced_bins(sizes: list[int], n_bins: int, rounds: int = 40) -> list[int]:
    """Bins 0..n_bins-1 for items in descending size, with the smallest capacity that best fit can keep.

    The capacity is found by bisection between the mean and a capacity that
    surely suffices, each trial being one best-fit-decreasing run.
    """
    if not sizes:
        return []
    low = max(-(-sum(sizes) // n_bins), sizes[0])
    high = low + sizes[0]
    best, used = best_fit_decreasing(sizes, low)
    if used <= n_bins:
        return best
    best, used = best_fit_decreasing(sizes, high)
    while used > n_bins:
        high *= 2
        best, used = best_fit_decreasing(sizes, high)
    for _ in range(rounds):
        if high - low <= 1:
            break
        mid = (low + high) // 2
        trial, used = best_fit_decreasing(sizes, mid)
        if used <= n_bins:
            best, high = trial, mid
        else:
            low = mid
    return best


def _pack_partition(capacity: int):
    """mapInPandas body: best fit over rows that arrive in descending size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, tree, opened = TaskContext.get().partitionId(), CapacityTree(), 0
        for batch in batches:
            out = []
            for size in batch["g_bytes"].tolist():
                found = tree.pop_tightest(size)
                if found is None:
                    found, opened = (max(capacity, size), opened), opened + 1
                out.append((part << 32) | found[1])
                tree.add(found[0] - size, found[1])
            yield pd.DataFrame({"g_key": batch["g_key"], "g_bytes": batch["g_bytes"], "g_bin": out})

    return run


def shard_documents(
    docs: DataFrame,
    n_shards: int = 16,
    law: str = "bytes",
    id_col: str = "doc_id",
    text_col: str = "text",
    fanout: int = 64,
) -> DataFrame:
    """Deal documents to ``n_shards`` shards under one law.

    * ``bytes``: documents of equal text form an indivisible group; groups are
      packed by best-fit-decreasing so that the shards' byte sums are near
      equal. Packing has two levels: every worker packs its own groups,
      largest first, into bins of ``total / (n_shards * fanout)`` bytes, and
      these bins, with the groups that are larger than such a bin, are packed
      again into the shards. The second level sees at most
      ``n_shards * fanout + 2 * partitions`` items plus at most
      ``n_shards * fanout`` large groups, however many documents there are.
    * ``rows``: row counts at most one apart.
    * ``key``: the id and the shard count decide (highest random weight), so a
      further shard takes rows only into itself; ``grown_shard`` is the shard
      with one more.

    Output: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Size
    is the text's UTF-8 bytes plus 1. A null text counts as empty and shares
    the group of empty texts; a null id is an ordinary key; repeated rows each
    get a slot; an empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    ws = Workspace(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (text_bytes(F.col(text_col)).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("g_key"),
    )
    if law == "bytes":
        placed = _by_bytes(base, n_shards, fanout, ws)
    elif law == "key":
        placed = base.withColumn("shard", _heaviest(n_shards)).withColumn("grown_shard", _heaviest(n_shards + 1))
    else:
        ranked = gapless_index(
            ws.keep(base.select("doc_id", "size", "text_crc32", F.lit(0).alias("_all")), "rows"),
            ["_all"], ["doc_id", "text_crc32", "size"], "_rank", max(16, shuffle_width(spark)),
        )
        placed = ranked.withColumn("shard", (F.col("_rank") % n_shards).cast("int"))
    if "grown_shard" not in placed.columns:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    narrow = ws.keep(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard"), "placed")
    ws.clear(narrow)
    slotted = gapless_index(narrow, ["shard"], ["doc_id", "text_crc32", "size"], "slot", max(16, shuffle_width(spark)))
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard"
    )


def _heaviest(n: int):
    weights = F.array(*[F.struct(F.xxhash64(F.col("doc_id"), F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(n)])
    return F.array_max(weights)["s"].cast("int")


def _by_bytes(base: DataFrame, n_shards: int, fanout: int, ws: Workspace) -> DataFrame:
    spark = base.sparkSession
    width = shuffle_width(spark)
    groups = ws.keep(base.groupBy("g_key").agg(F.sum("size").alias("g_bytes")), "groups")
    total = groups.agg(F.sum("g_bytes")).first()[0] or 0
    fan = max(fanout, -(-4 * width // n_shards))
    capacity = max(1, -(-total // (n_shards * fan)))
    small = (
        groups.filter(F.col("g_bytes") <= capacity)
        .repartition(width, "g_key")
        .sortWithinPartitions(F.desc("g_bytes"), "g_key")
        .mapInPandas(_pack_partition(capacity), "g_key binary, g_bytes long, g_bin long")
    )
    binned = ws.keep(small, "bins")
    # Bounded: at most n_shards * fan large groups, and the workers' bins.
    bins = [(int(r[0]), int(r[1])) for r in binned.groupBy("g_bin").agg(F.sum("g_bytes")).collect()]
    large = [(bytes(r[0]), int(r[1])) for r in groups.filter(F.col("g_bytes") > capacity).collect()]
    items = sorted([(s, 0, k) for k, s in bins] + [(s, 1, k) for k, s in large], key=lambda x: (-x[0], x[1], x[2]))
    shard_of = balanced_bins([s for s, _, _ in items], n_shards)
    bin_rows = [(k, sh) for (_, kind, k), sh in zip(items, shard_of, strict=True) if kind == 0]
    large_rows = [(k, sh) for (_, kind, k), sh in zip(items, shard_of, strict=True) if kind == 1]
    bin_map = spark.createDataFrame(bin_rows, "g_bin long, bin_shard int")
    large_map = spark.createDataFrame(large_rows, "l_key binary, l_shard int")
    by_key = binned.join(F.broadcast(bin_map), "g_bin").select(F.col("g_key").alias("k_key"), "bin_shard")
    # Copies of a large group, the only keys with many rows, are settled by the
    # bounded broadcast; they then scatter instead of meeting in one task.
    marked = base.join(F.broadcast(large_map), F.col("g_key") == F.col("l_key"), "left")
    marked = marked.withColumn(
        "j_key",
        F.when(F.col("l_shard").isNull(), F.col("g_key")).otherwise(F.unhex(F.sha2(F.monotonically_increasing_id().cast("string"), 256))),
    )
    return marked.join(by_key, F.col("j_key") == F.col("k_key"), "left").withColumn(
        "shard", F.coalesce("l_shard", "bin_shard")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 with near-equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), 16, "bytes")
