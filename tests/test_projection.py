"""Transverse Mercator against the length of the meridian, a known place and its own inverse."""

import math

import pytest
from pyspark.sql import functions as F

from fluvial.functions import exprs as ex


def meridian(lat, steps=20000):
    a, f = ex.WGS84
    e2 = f * (2 - f)
    g = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    h = math.radians(lat) / steps
    return h / 6 * sum(g(i * h) + 4 * g((i + 0.5) * h) + g((i + 1) * h) for i in range(steps))


def test_transverse_mercator(spark):
    rows = [(0, 9.0, 0.0), (1, 9.0, 45.0), (2, 9.0, -70.0), (3, 12.0, 52.5), (4, 6.1, -33.25), (5, None, 1.0), (6, 7.0, None)]
    x, y = ex.lonlat_to_tm(F.col("lon"), F.col("lat"), 9.0)
    placed = spark.createDataFrame(rows, "id int, lon double, lat double").select("*", x.alias("x"), y.alias("y"))
    lon, lat = ex.tm_to_lonlat(F.col("x"), F.col("y"), 9.0)
    got = placed.select("*", lon.alias("lon2"), lat.alias("lat2")).orderBy("id").collect()
    for r, k in ((got[0], 0.0), (got[1], 45.0), (got[2], -70.0)):
        assert r.x == pytest.approx(500000.0, abs=1e-6) and r.y == pytest.approx(math.copysign(0.9996 * meridian(abs(k)), k), abs=1e-3)
    for r in got[:5]:
        assert (r.lon2, r.lat2) == (pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8))
    assert all(v is None for r in got[5:] for v in (r.x, r.y, r.lon2, r.lat2))


def test_a_known_place_and_zones(spark):
    x, y = ex.lonlat_to_tm(F.lit(-79.387139), F.lit(43.642567), -81.0)
    row = spark.range(1).select(x.alias("x"), y.alias("y"), *[ex.utm_zone(F.lit(v)).alias(f"z{i}") for i, v in enumerate((-79.387139, -180.0, 179.9, 180.0, 9.0))]).first()
    assert (row.x, row.y) == (pytest.approx(630084, abs=1.5), pytest.approx(4833438, abs=1.5))
    assert tuple(row)[2:] == (17, 1, 60, 1, 32)
