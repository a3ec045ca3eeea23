"""Bins along segments and the crossings found through them."""

import numpy as np
import pytest

from fluvial.operators import spatial as sp

SEGS = "line_id long, seg long, ax double, ay double, bx double, by double"


def test_bins_grow_with_the_length_of_a_diagonal(spark):
    segs = spark.createDataFrame([(0, 0, 0.0, 0.0, 1000.0, 1000.0), (1, 0, 5.0, 0.0, 5.0, 1000.0), (2, 0, 3.0, 7.5, 3.0, 7.5)], SEGS)
    bins = {r.l_line_id: r["count"] for r in sp._seg_bins(segs, 1.0, "l").groupBy("l_line_id").count().collect()}
    assert bins[0] <= 3 * 1003 and bins[1] <= 2 * 1003 and bins[2] <= 4


@pytest.mark.parametrize("grow", [0.0, 0.3])
def test_every_point_of_a_segment_has_its_bin(spark, grow):
    rng = np.random.default_rng(4)
    ends = np.round(rng.uniform(-8, 8, (60, 4)), 1)
    ends[:10, 2] = ends[:10, 0]
    ends[10:20, 3] = ends[10:20, 1]
    segs = spark.createDataFrame([(i, 0, *map(float, e)) for i, e in enumerate(ends)], SEGS)
    have = {(r.l_line_id, r.gx, r.gy) for r in sp._seg_bins(segs, 0.7, "l", grow).collect()}
    for i, (ax, ay, bx, by) in enumerate(ends):
        for t in np.linspace(0, 1, 300):
            for dx, dy in ((0, 0), (grow, 0), (-grow, 0), (0, grow), (0, -grow)):
                x, y = ax + t * (bx - ax) + dx, ay + t * (by - ay) + dy
                assert (i, int(np.floor(x / 0.7)), int(np.floor(y / 0.7))) in have


def test_crossings_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    start = rng.uniform(0, 100, (150, 2))
    ends = np.hstack([start, start + rng.normal(size=(150, 2)) * rng.choice([1, 10, 80], (150, 1))])
    left = lambda p, q, r: (r[1] - p[1]) * (q[0] - p[0]) > (q[1] - p[1]) * (r[0] - p[0])
    want = set()
    for i, e in enumerate(ends):
        for j, f in enumerate(ends):
            a, b, c, d = e[:2], e[2:], f[:2], f[2:]
            if left(a, c, d) != left(b, c, d) and left(a, b, c) != left(a, b, d):
                want.add((i, j))
    segs = spark.createDataFrame([(i, 0, *map(float, e)) for i, e in enumerate(ends)], SEGS)
    for size in (None, 0.9, 40.0):
        got = [(r.l_line, r.r_line) for r in sp.crossing_segments(segs, segs, size=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
