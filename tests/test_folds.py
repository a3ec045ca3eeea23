"""Folds over many small groups."""

import numpy as np
from pyspark.sql import functions as F

from fluvial.operators import arcs as ar
from fluvial.operators.folds import fold_groups
from fluvial.operators.linework import merge_lines


def test_groups_are_whole_in_order_and_share_batches(spark):
    k = F.col("id")
    rows = spark.range(2000).select(F.when(k % 37 > 0, F.when(k % 3 == 0, k % 5).otherwise(k % 37)).alias("g"), (k * 7919 % 2003).alias("v"))
    want = {r.g: sorted(r.v) for r in rows.groupBy("g").agg(F.collect_list("v").alias("v")).collect()}

    def run(group):
        return {"n": np.full(1, len(group["v"])), "up": np.full(1, bool((np.diff(group["v"]) > 0).all())), "first": group["v"][:1], "total": group["v"].sum(keepdims=True)}

    schema = "n long, up boolean, first long, total long"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 100, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            found = sorted(map(tuple, fold_groups(rows, "g", "v", run, schema).collect()))
            assert found == sorted((len(v), True, v[0], sum(v)) for v in want.values())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert fold_groups(rows.limit(0), "g", "v", run, schema).collect() == []


def test_small_groups_do_not_go_to_python_one_by_one(spark):
    rows = spark.range(40).select("id", (F.col("id") % 9).alias("line_id"), F.col("id").alias("vid"), *[(F.col("id") * m % 11).cast("double").alias(c) for m, c in ((1, "x"), (2, "y"), (3, "bx"), (5, "by"))])
    plan = ar.smooth_bank(rows.select("line_id", "vid", "x", "y", "bx", "by"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_chains_do_not_go_to_python_one_by_one(spark):
    segs = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 2.0, 0.0), (5.0, 5.0, 6.0, 5.0)], "ax double, ay double, bx double, by double")
    merged = merge_lines(segs)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted((r.vid, r.x, r.y) for r in merged.collect()) == [(0, 0.0, 0.0), (0, 5.0, 5.0), (1, 1.0, 0.0), (1, 6.0, 5.0), (2, 2.0, 0.0)]
