import numpy as np
from pyspark.sql import functions as F
from test_rivers import thalweg, valley

from fluvial import config, storage
from fluvial.operators import arcs as ar
from fluvial.operators import rivers

CFG = config.RiverConfig(river_threshold=(5.0, 100.0))


def counted(monkeypatch):
    """Rows of every table that the pipeline writes from now on."""
    rows = []

    def cut(df, label="step"):
        back = storage.cut(df, label)
        rows.append(back.count())
        return back

    monkeypatch.setattr(rivers, "cut", cut)
    return rows


def test_bank_search_writes_no_samples(spark, monkeypatch):
    rows = counted(monkeypatch)
    out = rivers.dry_run(thalweg(spark, 20), valley(spark), CFG, 1.0).toPandas()
    assert out["valid"].all() and max(rows) <= 20


def test_correction_writes_no_samples(spark, monkeypatch):
    rows = counted(monkeypatch)
    out = rivers._correct(thalweg(spark, 20).withColumn("width", F.lit(40.0)), valley(spark), CFG, 1.0).toPandas()
    assert len(out) == 20 and max(rows) <= 20


def test_steps_of_samples_equal_the_former_form(spark):
    rng = np.random.default_rng(2)
    rows = [(1, v, s, float(z), 1.0) for v in range(30) for s, z in enumerate(rng.integers(0, 4, 6 + v))]
    samples = spark.createDataFrame(rows, "line_id long, vid long, step int, z double, eta double")
    key = ["line_id", "vid", "step"]
    plain = lambda df: sorted(map(tuple, df.select(key).collect()))
    got = ar.sampled_lowest_steps(samples)
    assert plain(got) == plain(ar.lowest_steps(samples))
    assert sorted(map(tuple, got.select(*key, "z").collect())) == sorted(map(tuple, got.select(key).join(samples, key).select(*key, "z").collect()))
    level = samples.select("line_id", "vid", "eta").distinct()
    assert plain(ar.sampled_bank_steps(samples)) == plain(ar.bank_steps(samples.drop("eta"), level))
    holes = samples.withColumn("z", F.when((F.col("vid") != 3) | (F.col("step") != 2), F.col("z")))
    for table in (ar.sampled_lowest_steps(holes), ar.sampled_bank_steps(holes)):
        assert [r.vid for r in table.filter("whole is null").collect()] == [3]
