import numpy as np
from pyspark.sql import functions as F

from fluvial import config
from fluvial.functions import exprs as ex
from fluvial.operators import rivers
from fluvial.streaming import tiles


def valley(spark):
    """A straight channel 40 wide along y = 0 with its bed at -2 in land at 5."""

    def sample(rows):
        z = F.when(F.abs("y") < 20.5, F.lit(-2.0)).otherwise(F.lit(5.0))
        return rows.withColumn("z", F.when(F.col("x").between(-500, 3000), z))

    return sample


def thalweg(spark, n=60):
    return spark.createDataFrame([(1, i, 20.0 * i, float(3 * (-1) ** i), 0) for i in range(n)], "line_id long, vid long, x double, y double, pin int")


def test_banks_of_a_valley(spark):
    out = rivers.dry_run(thalweg(spark), valley(spark), config.RiverConfig(river_threshold=(5.0, 100.0)), 1.0).toPandas()
    assert out["valid"].all() and out["width"].median() > 35


def test_arcs_of_a_valley(spark):
    out = rivers.river_arcs(thalweg(spark), valley(spark), config.RiverConfig(river_threshold=(5.0, 100.0)), 1.0).toPandas()
    assert set(out["case"]) == {3} and out["n_arcs"].iloc[0] == 4
    assert set(out.loc[out["is_outer"], "arc_pos"]) == {0, 3}
    edge = out[out["is_outer"]]["y"].abs()
    assert abs(edge.median() - 20.5) < 3
    assert set(out["info"]) == {2.0400, 2.0401}


def test_artificial_channel_and_fallback(spark):
    cfg = config.levees()
    out = rivers.river_arcs(thalweg(spark), valley(spark), cfg, 1.0).toPandas()
    assert set(out["case"]) == {1} and out["arc_pos"].nunique() == 4
    dry = lambda rows: rows.withColumn("z", F.lit(5.0))
    keep = thalweg(spark).withColumn("keep", F.lit(1))
    out = rivers.river_arcs(keep, dry, config.RiverConfig(river_threshold=(5.0, 50.0)), 1.0).toPandas()
    assert len(out) == 0 or set(out["case"]) <= {2, 4}


def test_lines_without_elevations_are_not_valid(spark):
    far = thalweg(spark).withColumn("x", F.col("x") + 5000)
    out = rivers.dry_run(far, valley(spark), config.RiverConfig(river_threshold=(5.0, 100.0)), 1.0).toPandas()
    assert not out["valid"].any()


def test_drainage_of_a_bowl(spark):
    y, x = np.indices((30, 30))
    z = (y * 10 + np.abs(x - 15) * 3).astype(float)
    z[10, 15] = 0
    cells = spark.createDataFrame([(int(i * 30 + j), int(i), int(j), float(z[i, j])) for i in range(30) for j in range(30)], "sind long, iy long, ix long, z double")
    out = rivers.drainage(cells, 20, tile=16)
    flow = out["flow"].toPandas()
    assert flow[flow["sind"] == flow["outlet"]]["acc"].sum() == 900
    assert out["lines"].count() > 20


def test_flowlines(spark):
    lines = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, "a"), (1, 1, 0.001, 0.0, "a"), (2, 0, 0.001, 0.0, "a"), (2, 1, 0.002, 0.0, "a"), (3, 0, 5.0, 5.0, None), (3, 1, 6.0, 5.0, None)],
        "line_id long, vid long, x double, y double, gnis_id string",
    )
    area = spark.createDataFrame([(0, 0, 0.0015, -1.0), (0, 1, 9.0, -1.0), (0, 2, 9.0, 1.0), (0, 3, 0.0015, 1.0)], "poly_id long, vid long, x double, y double")
    out = rivers.prepare_flowlines(lines, area).toPandas()
    # The part inside the area is a line of its own.
    ends = sorted((round(g["x"].min(), 9), round(g["x"].max(), 9)) for _, g in out.groupby("line_id"))
    assert ends == [(0.0, 0.0015), (0.0015, 0.002)]
    assert all(g.sort_values("vid")["x"].diff().max() <= 0.0002 + 1e-12 for _, g in out.groupby("line_id"))


def test_flowlines_merge_within_names(spark):
    """Names that touch stay apart; a name goes on through nodes that it shares; a line through a polygon is three."""
    rows = [
        (1, 0, 0.0, 0.0, "a"), (1, 1, 1.0, 0.0, "a"), (2, 0, 1.0, 0.0, "b"), (2, 1, 2.0, 0.0, "b"),
        (3, 0, 1.0, 0.0, "c"), (3, 1, 1.0, 3.0, "c"), (4, 0, 1.0, 3.0, "c"), (4, 1, 1.0, 6.0, "c"), (5, 0, 1.0, 6.0, "c"), (5, 1, 1.0, 3.0, "c"),
        (6, 0, 7.0, 7.0, ""), (6, 1, 8.0, 7.0, ""),
    ]
    lines = spark.createDataFrame(rows, "line_id long, vid long, x double, y double, gnis_id string")
    area = spark.createDataFrame([(0, 0, 0.5, 2.0), (0, 1, 1.5, 2.0), (0, 2, 1.5, 4.0), (0, 3, 0.5, 4.0)], "poly_id long, vid long, x double, y double")
    out = rivers.prepare_flowlines(lines, area, split=1e9, densify=1e8).toPandas()
    ends = sorted(tuple(g.sort_values("vid")[["x", "y"]].iloc[[0, -1]].to_numpy().round(6).ravel()) for _, g in out.groupby("line_id"))
    assert ends == [(0, 0, 1, 0), (1, 0, 1, 2), (1, 0, 2, 0), (1, 2, 1, 4), (1, 4, 1, 6)]


def test_codecs(spark):
    row = spark.range(1).select(
        ex.encode_pieces([F.lit(4), F.lit(1)]).alias("z"), ex.decode_pieces(F.lit(2.0401)).alias("d"), ex.decode_tiles(F.lit(101100), 1000).alias("t"),
        ex.encode_pieces([F.lit(100)]).alias("bad"), ex.decode_pieces(F.lit(7.01)).alias("bad2"),
    ).first()
    assert row.z == 2.0401 and row.d == [4, 1] and row.t == [99, 100] and row.bad is None and row.bad2 is None


def test_tiles_arrive(spark, tmp_path):
    from fluvial.operators.raster import d8_directions

    rng = np.random.default_rng(0)
    z = rng.integers(0, 99, (12, 16)).astype(float)
    rows = [(i * 16 + j, i, j, float(z[i, j])) for i in range(12) for j in range(16)]
    schema = "sind long, iy long, ix long, z double"
    for k, part in enumerate((lambda r: r[2] < 8, lambda r: r[2] >= 8)):
        spark.createDataFrame([r for r in rows if part(r)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        tiles.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck"), 4).awaitTermination()
    got = {r.sind: r.dir for r in tiles.latest_directions(spark, str(tmp_path / "out")).collect()}
    want = {r.sind: r.dir for r in d8_directions(spark.createDataFrame(rows, schema), tile=4).collect()}
    assert got == want
