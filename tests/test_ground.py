"""The ground under the river queries."""

from pyspark.sql import functions as F

from fluvial.plans import pipeline_queries
from fluvial.storage import cut


def test_ground_holds_only_cells_that_a_place_can_ask_for(spark, tmp_path, monkeypatch):
    spark.range(15_000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 0.37).alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    held = []
    monkeypatch.setattr(pipeline_queries, "cut", lambda df, label: held.append(df.count()) or cut(df, label))
    sample = pipeline_queries._ground(spark, str(tmp_path))
    rows = spark.range(3000).select((F.col("id") * 7.3 - 900).alias("x"), (F.col("id") * 1.9 - 2000).alias("y"))
    z = pipeline_queries.cell(spark, str(tmp_path)).select(F.col("ix").alias("gx"), F.col("iy").alias("gy"), (F.col("z_noise") % 7).alias("dz"))
    keyed = rows.withColumns({"gx": F.rint(F.col("x") / 10).cast("long") % 100, "gy": F.abs(F.rint(F.col("y") / 60)).cast("long") % 10})
    want = keyed.join(z, ["gx", "gy"], "left").select("x", "y", (F.coalesce("dz", F.lit(3)) + F.pmod(F.floor(F.col("y") / 25), F.lit(4)) * 2).cast("double").alias("z"))
    assert sorted(map(tuple, sample(rows).select("x", "y", "z").collect())) == sorted(map(tuple, want.collect()))
    assert held == [1000]
