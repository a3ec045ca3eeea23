"""What joins send through the driver."""

from pyspark.sql import functions as F

from fluvial.storage import Workspace, cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_in_few_bytes_are_merged(spark):
    rows = spark.range(0, 400_000, 1, 2).withColumn("v", F.lit(1))
    for back in (cut(rows), Workspace(spark, "t").keep(rows, "rows")):
        plan = _plan(spark.range(5_000_000).withColumn("w", F.rand(1)).join(back, "id"))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert "BroadcastHashJoin" in _plan(back.join(F.broadcast(spark.range(3)), "id"))
    assert "BroadcastHashJoin" in _plan(spark.range(5_000_000).join(cut(spark.range(10)), "id"))
