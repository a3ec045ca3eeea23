"""Tile arrival as a stream: recompute a tile and its neighbours when it lands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import d8_directions


def touched_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """``ty, tx`` of the tiles that hold the given cells, and of their eight neighbours."""
    own = cells.select(F.floor(F.col("iy") / tile).alias("ty"), F.floor(F.col("ix") / tile).alias("tx")).distinct()
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return own.withColumn("s", step).select((F.col("ty") + F.col("s.a")).alias("ty"), (F.col("tx") + F.col("s.b")).alias("tx")).distinct()


def refresh_directions(store: DataFrame, arrived: DataFrame, tile: int) -> DataFrame:
    """Directions of the cells whose tile or a neighbouring one has arrived; ``store`` already holds the new cells."""
    around = touched_tiles(arrived, tile)
    near = store.withColumns({"ty": F.floor(F.col("iy") / tile), "tx": F.floor(F.col("ix") / tile)})
    wider = touched_tiles(around.select((F.col("ty") * tile).alias("iy"), (F.col("tx") * tile).alias("ix")), tile)
    part = near.join(wider, ["ty", "tx"], "left_semi").select("sind", "iy", "ix", "z")
    d8 = d8_directions(part, tile=tile).withColumns({"ty": F.floor(F.col("iy") / tile), "tx": F.floor(F.col("ix") / tile)})
    return d8.join(around, ["ty", "tx"], "left_semi").drop("ty", "tx")


def ingest(spark: SparkSession, incoming: str, store: str, output: str, checkpoint: str, tile: int, on_batch: Callable[[DataFrame], None] | None = None):
    """Start a stream over Parquet tiles (``sind, iy, ix, z``) that land in ``incoming``.

    Each micro-batch is added to ``store`` under its number, so that a repeated
    batch replaces itself, and the refreshed directions go to ``output`` in the
    same way. Later rows of a cell win by batch number when they are read.
    """
    stream = spark.readStream.schema("sind long, iy long, ix long, z double").parquet(incoming)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        known = spark.read.parquet(store)
        newest = known.groupBy("sind", "iy", "ix").agg(F.max_by("z", "batch").alias("z"))
        fresh = refresh_directions(newest, spark.read.parquet(f"{store}/batch={number}"), tile)
        fresh.write.mode("overwrite").parquet(f"{output}/batch={number}")
        if on_batch:
            on_batch(fresh)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_directions(spark: SparkSession, output: str) -> DataFrame:
    """The newest direction of every cell."""
    rows = spark.read.parquet(output)
    top = F.max_by(F.struct("z", "dir", "nxt"), F.col("batch"))
    return rows.groupBy("sind", "iy", "ix").agg(top.alias("v")).select("sind", "iy", "ix", "v.*")
