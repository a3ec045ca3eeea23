"""Queries on tables that repeat places many times, against their SQL."""

import duckdb
import pytest

from fluvial.operators import spatial, tiles
from fluvial.operators.spatial import nearest
from fluvial.plans import ORACLE_SQL, QUERIES


def differences(spark, folder, name, **tables):
    """Rows that only the query or only its SQL returns on the given tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = QUERIES[name](spark, str(folder)).toPandas()
    con.register("found", found)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    con.execute(f"CREATE TABLE wanted AS SELECT {columns} FROM ({ORACLE_SQL[name]})")
    less = lambda a, b: con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall()
    assert len(found)
    return less("found", "wanted") + less("wanted", "found")


def test_points_on_the_line_of_the_other_segment(spark, tmp_path):
    keys = spark.createDataFrame([(k,) for k in (0, 1, 74946, 134953, 288108, 408122, 561277, 774439, 834446)], "c_custkey long")
    assert differences(spark, tmp_path, "p7_segments_cross", customer=keys) == []


@pytest.mark.parametrize("k, nonzero", [(1, False), (5, False), (3, True)])
def test_nearest_of_far_queries_and_crowded_places(spark, k, nonzero):
    """Two crowds far apart in small bins: a ring of bins around a query between them would have billions."""
    import numpy as np

    rng = np.random.default_rng(4)
    spots = np.concatenate([rng.integers(0, 9, (60, 2)) / 300 - 900.0, rng.integers(0, 9, (60, 2)) / 300 + 700.0])
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)]
    asked = [(i, float(x), float(y)) for i, (x, y) in enumerate([*rng.uniform(-1500, 1500, (20, 2)), *spots[::30], (-100.0, -100.0)])] + [(99, None, 1.0)]
    found = nearest(spark.createDataFrame(asked, "qid long, x double, y double"), spark.createDataFrame(pts, "pt_id long, x double, y double"), k, 0.01, pid="pt_id", nonzero=nonzero)
    want = []
    for q, x, y in asked[:-1]:
        d2 = sorted(((px - x) * (px - x) + (py - y) * (py - y), i) for i, px, py in pts)
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate([v for v in d2 if v[0] > 0 or not nonzero][:k])]
    assert sorted((r.qid, r["rank"], r.pid, r.d2) for r in found.collect()) == want


def test_wide_boxes_in_few_places(spark, tmp_path, monkeypatch):
    """Boxes that repeat places, in chunks of few keys: joined once a place, written out for every box."""
    monkeypatch.setattr(spatial.box_shapes, "__defaults__", (16,))
    tables = {"customer": spark.range(40).selectExpr("id * 37 AS c_custkey"), "supplier": spark.range(330).selectExpr("id AS s_suppkey")}
    assert differences(spark, tmp_path, "j8_point_in_box", **tables) == []
    boxes = [(k, 0, 0, 4, 4) for k in range(300)]
    made = spark.createDataFrame(boxes, "tile_ord long, x0 long, y0 long, x1 long, y1 long")
    assert max(len(r["_ids"]) for r in spatial.box_shapes(made, "tile_ord").collect()) < 100
    assert spatial.overlapping_boxes(made, made, "tile_ord", "tile_ord").distinct().count() == 300 * 300


def test_exploded_points_are_not_broadcast(spark, data):
    """The estimated size of a table leaves out what explodes."""
    plan = QUERIES["m16_feeder_extensions"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2


def test_first_valid_cell_of_equal_grids(spark, monkeypatch):
    """Of many tiles of one grid, the first with a valid value at the point's own cell counts; points meet the grid once."""
    met = []
    monkeypatch.setattr(tiles, "points_in_boxes", lambda p, b: met.append(b.count()) or spatial.points_in_boxes(p, b))
    tile = spark.range(50).selectExpr("id AS tile_ord", "0.0D AS x0", "0.0D AS y0", "1.0D AS dx", "1.0D AS dy", "2 AS nx", "1 AS ny")
    cells = spark.range(50).selectExpr("id AS tile_ord", "0L AS iy", "explode(array(0L, 1L)) AS ix", "id * 1.0D AS z")
    points = spark.createDataFrame([(1, 0.2, 0.1), (2, 0.9, 0.0), (3, 9.0, 0.0)], "pt_id long, x double, y double")
    got = {r.pt_id: r.z for r in tiles.elevations_by_priority(points, tile, cells, (7, 90)).collect()}
    assert got == {1: 7.0, 2: 7.0, 3: None}
    assert met == [1]
