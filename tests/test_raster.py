import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.operators import fill, flow, raster


def grid(spark, z):
    rows = [(int(i * z.shape[1] + j), int(i), int(j), None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])]
    return spark.createDataFrame(rows, "sind long, iy long, ix long, z double")


def directions(spark, z, **kw):
    return {r.sind: r.dir for r in raster.d8_directions(grid(spark, np.array(z, float)), tile=2, **kw).collect()}


def test_lowest_neighbour_wins_over_steepest(spark):
    z = [[20, 20, 20], [20, 10, 9.0], [20, 20, 8.9]]
    assert directions(spark, z)[4] == 2
    assert directions(spark, z, steepest=True)[4] == 1


def test_tie_takes_first_in_order(spark):
    assert directions(spark, [[9, 3, 9], [9, 5, 3], [9, 9, 9]])[4] == 1


def test_pit_and_nodata(spark):
    d = directions(spark, [[9, 9, 9], [9, 1, 9], [9, np.nan, 9]])
    assert d[4] == 0 and d[7] == -1


def test_accumulation_of_a_row(spark):
    d8 = raster.d8_directions(grid(spark, np.array([[4.0, 3, 2, 1]])))
    acc = {r.sind: (r.acc, r.outlet, r.depth) for r in flow.accumulate(d8).collect()}
    assert acc == {0: (1, 3, 3), 1: (2, 3, 2), 2: (3, 3, 1), 3: (4, 3, 0)}


def test_single_cell_and_empty_grid(spark):
    assert directions(spark, [[5.0]]) == {0: 0}
    empty = grid(spark, np.zeros((0, 3)))
    assert raster.d8_directions(empty).count() == 0
    assert fill.fill_depressions(empty).count() == 0


def test_outlets_sum_to_cells(spark, data):
    from fluvial.adapters import cell

    cells = cell(spark, data)
    d8 = raster.d8_directions(cells, "z_tilt", tile=32)
    flown = flow.accumulate(d8)
    assert flown.filter("sind = outlet").agg(F.sum("acc")).first()[0] == cells.count()


def reference_fill(z):
    ny, nx = z.shape
    out, seen, heap = z.copy(), np.isnan(z), []
    for i in range(ny):
        for j in range(nx):
            edge = i in (0, ny - 1) or j in (0, nx - 1) or np.isnan(z[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]).any()
            if edge and not seen[i, j]:
                heapq.heappush(heap, (z[i, j], i, j))
                seen[i, j] = True
    while heap:
        h, i, j = heapq.heappop(heap)
        for a in range(max(0, i - 1), min(ny, i + 2)):
            for b in range(max(0, j - 1), min(nx, j + 2)):
                if not seen[a, b]:
                    seen[a, b] = True
                    out[a, b] = max(z[a, b], h)
                    heapq.heappush(heap, (out[a, b], a, b))
    return out


@pytest.mark.parametrize("nodata", [False, True])
def test_fill_equals_flood_of_the_whole(spark, nodata):
    z = np.random.default_rng(3).integers(0, 40, (23, 19)).astype(float)
    if nodata:
        z[5:7, 8] = np.nan
    want = reference_fill(z)
    got = np.full(z.shape, np.nan)
    for r in fill.fill_depressions(grid(spark, z), tile=6).collect():
        got[r.iy, r.ix] = np.nan if r.z is None else r.z
    assert np.array_equal(got, want, equal_nan=True)


def test_relaxation_equals_tiles_without_slope(spark):
    z = np.random.default_rng(4).integers(0, 30, (9, 8)).astype(float)
    got = {(r.iy, r.ix): r.z for r in fill.fill_by_relaxation(grid(spark, z)).collect()}
    want = reference_fill(z)
    assert all(got[i, j] == want[i, j] for i in range(9) for j in range(8))


def test_relaxation_with_slope_settles_or_raises(spark):
    z = np.full((5, 5), 9.0)
    z[1:4, 1:4], z[2, 4] = 1.0, 5.0
    got = {r.sind: r.z for r in fill.fill_by_relaxation(grid(spark, z), epsilon=0.5, tile=4).collect()}
    assert [got[10 + j] for j in range(5)] == [9.0, 6.5, 6.0, 5.5, 5.0]
    with pytest.raises(RuntimeError, match="2 rounds"):
        fill.fill_by_relaxation(grid(spark, z), epsilon=0.5, max_rounds=2, tile=4)


def test_draining_leaves_no_inner_pit_and_no_loop(spark):
    z = np.random.default_rng(5).permutation(15 * 14).reshape(15, 14).astype(float)
    out = {r.sind: r for r in fill.drain_depressions(raster.d8_directions(grid(spark, z)), tile=8).collect()}
    assert len(out) == 15 * 14
    for r in out.values():
        steps, at = 0, r
        while at.nxt is not None:
            at, steps = out[at.nxt], steps + 1
            assert steps <= len(out)
        assert at.iy in (0, 14) or at.ix in (0, 13)


def test_breaching_lowers_to_the_lowest_cell_upstream(spark):
    z = np.random.default_rng(6).permutation(13 * 14).reshape(13, 14).astype(float)
    z[4, 5] = np.nan
    d8 = raster.d8_directions(grid(spark, z))
    drained = {r.sind: r for r in fill.drain_depressions(d8, tile=8).collect()}
    want = {s: r.z for s, r in drained.items()}
    for s in drained:
        at = drained[s]
        while at.nxt is not None:
            want[at.nxt] = min(want[at.nxt], drained[s].z)
            at = drained[at.nxt]
    got = {r.sind: r for r in fill.breach_depressions(d8, tile=8).collect()}
    assert {s: r.z for s, r in got.items()} == want and any(want[s] < drained[s].z for s in want)
    assert all(r.nxt is None or got[r.nxt].z <= r.z for r in got.values())
    assert fill.breach_depressions(d8.limit(0)).count() == 0


def test_paths_have_no_longest_length(spark):
    n = 140_000
    chain = spark.range(n).select(F.col("id").alias("sind"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("nxt"))
    got = flow.downstream_paths(chain, spark.createDataFrame([(0,)], "sind long"))
    assert got.agg(F.count("*"), F.max("step"), F.count_if(F.col("step") == F.col("sind"))).first() == (n, n - 1, n)


def test_path_into_a_loop_is_refused(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5), (5, None)], "sind long, nxt long")
    got = flow.downstream_paths(edges, spark.createDataFrame([(4,), (5,)], "sind long"))
    assert sorted((r.start, r.step, r.sind) for r in got.collect()) == [(4, 0, 4), (4, 1, 5), (5, 0, 5)]
    with pytest.raises(ValueError, match="loop"):
        flow.downstream_paths(edges, spark.createDataFrame([(1,)], "sind long"))


def test_flats_drain(spark):
    z = np.array([[9, 9, 9, 9, 9, 9], [9, 5, 5, 5, 5, 4], [9, 5, 5, 5, 5, 9], [9, 9, 9, 9, 9, 9]], float)
    d8 = raster.d8_directions(grid(spark, z))
    out = {r.sind: r for r in fill.resolve_flats(d8).collect()}
    for s in (7, 8, 9, 13, 14, 15):
        at, steps = out[s], 0
        while at.nxt is not None:
            at, steps = out[at.nxt], steps + 1
            assert steps < 30
        assert at.sind == 11


def test_subdomains_cover(spark):
    blocks = raster.subdomains(37, 53, 300, 2)
    seen = np.zeros((37, 53), int)
    for b in blocks:
        seen[b["y0"] : b["y1"], b["x0"] : b["x1"]] += 1
        assert b["hy0"] <= b["y0"] and b["hx1"] >= b["x1"]
    assert (seen == 1).all()
