"""Results that must not depend on tiles, bins, ties or path lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.adapters import cell
from fluvial.operators import fill, flow, raster, tiles
from fluvial.operators.components import components


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def noisy(spark, data):
    """Elevations in steps with gaps: flats, pits, several watersheds."""
    z = F.when(~F.col("is_nodata"), F.floor(F.col("z_tilt") / 15_000) + F.floor(F.col("z_noise") / 9_000_000))
    return cell(spark, data).select("sind", "iy", "ix", z.cast("double").alias("z")).cache()


@pytest.fixture(scope="module")
def flowing(noisy):
    d8 = raster.d8_directions(noisy).cache()
    return d8, flow.accumulate(d8.filter("dir >= 0")).cache()


@pytest.mark.parametrize("tile", [7, 16])
def test_stencils_do_not_depend_on_tiles(noisy, flowing, tile):
    d8, acc = flowing
    joined = d8.join(acc.select("sind", "acc", F.col("outlet").alias("seg")), "sind").cache()
    ups = lambda **k: raster.upstream_neighbours(d8, **k).select("sind", F.transform("ups", lambda u: u["sind"]).alias("ups"))
    pairs = [
        (raster.d8_directions(noisy, tile=tile), d8), (raster.d8_directions(noisy, flats_by_index=True, tile=tile), raster.d8_directions(noisy, flats_by_index=True)),
        (ups(tile=tile), ups()), (raster.inflow_counts(d8, tile=tile), raster.inflow_counts(d8)),
        (raster.main_upstream(joined, "acc", 3, tile), raster.main_upstream(joined, "acc", 3)),
        (raster.same_segment_neighbours(joined, tile=tile), raster.same_segment_neighbours(joined)),
        (raster.segment_border(joined, tile=tile), raster.segment_border(joined)),
        (raster.flat_neighbours(d8, tile=tile), raster.flat_neighbours(d8)), (raster.nodata_border(noisy, tile=tile), raster.nodata_border(noisy)),
    ]
    for got, want in pairs:
        assert rows(got.select(want.columns)) == rows(want)


def test_rivers_and_filling_do_not_depend_on_tiles(noisy, flowing):
    d8, acc = flowing
    assert rows(flow.stems(d8, acc, 5, tile=16)) == rows(flow.stems(d8, acc, 5))
    assert rows(flow.river_network(d8, acc, 5, tile=16)) == rows(flow.river_network(d8, acc, 5))
    assert rows(fill.fill_depressions(noisy, tile=16)) == rows(fill.fill_depressions(noisy, tile=512))
    assert rows(fill.resolve_flats(d8, tile=16)) == rows(fill.resolve_flats(d8))


def test_accumulation_ends_on_loops(spark):
    ring = [(i, i + 1) for i in range(300)] + [(300, 0), (400, 5), (500, 501), (501, None)]
    got = {r.sind: (r.acc, r.outlet, r.depth) for r in flow.accumulate(spark.createDataFrame(ring, "sind long, nxt long")).collect()}
    assert got[500] == (1, 501, 1) and got[501] == (2, 501, 0)
    assert all(got[i] == (None, None, None) for i in [*range(301), 400])
    flags = {r.sind: r.flag for r in flow.loop_flags(spark.createDataFrame(ring, "sind long, nxt long")).collect()}
    assert flags[500] == flags[501] == 0 and flags[400] == 2 and all(flags[i] == 1 for i in range(301))


@pytest.mark.parametrize("levels", [1, 3])
def test_draining_with_ties(spark, levels):
    z = np.random.default_rng(levels).integers(0, levels, (14, 14)).astype(float)
    cells = [(i * 14 + j, i, j, float(z[i, j])) for i in range(14) for j in range(14)]
    d8 = raster.d8_directions(spark.createDataFrame(cells, "sind long, iy long, ix long, z double"))
    out = {r.sind: r for r in fill.drain_depressions(d8, tile=5).collect()}
    assert len(out) == 196
    for r in out.values():
        steps, at = 0, r
        while at.nxt is not None:
            at, steps = out[at.nxt], steps + 1
            assert steps <= 196
        assert at.iy in (0, 13) or at.ix in (0, 13)


def test_lowest_ways_out_equal_relaxation(spark):
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (40, 60), (40, 300)):
        ocean = fill._OCEAN
        edges = {(int(a), int(b)): int(rng.integers(0, 9)) for a, b in rng.integers(1, n + 1, (m, 2)) if a != b}
        edges |= {(1, ocean): 4} | {(int(a), ocean): int(rng.integers(3, 9)) for a in rng.integers(1, n + 1, max(1, n // 8))}
        sym = {}
        for (a, b), h in edges.items():
            sym[a, b] = min(h, sym.get((a, b), 99))
            if b != ocean:
                sym[b, a] = min(h, sym.get((b, a), 99))
        level = {a: float("inf") for a, _ in sym} | {ocean: float("-inf")}
        for _ in range(n + 1):
            for (a, b), h in sym.items():
                level[a] = min(level[a], max(h, level[b]))
        links = spark.createDataFrame([(a, b, float(h)) for (a, b), h in sym.items()], "a long, b long, h double")
        got = {r.a: r.w for r in fill.lowest_ways_out(links).collect()}
        assert got == {a: w for a, w in level.items() if a != ocean}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(500, 560)] + [(7, 7), (3000, 3000), (None, 4), (900, 901), (901, 900)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in [*range(500, 560), 1000]} | {900: 900, 901: 900}


def test_priority_and_overlaps_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    boxes = [(k, float(x), float(y), 1.0, 1.0, int(nx), int(ny)) for k, (x, y, nx, ny) in enumerate(zip(rng.integers(0, 30, 12), rng.integers(0, 30, 12), rng.integers(2, 12, 12), rng.integers(2, 12, 12)))]
    tile = spark.createDataFrame(boxes, "tile_ord long, x0 double, y0 double, dx double, dy double, nx long, ny long")
    z = {(k, i, j): float(rng.integers(0, 100)) for k, _, _, _, _, nx, ny in boxes for i in range(ny) for j in range(nx)}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()], "tile_ord long, iy long, ix long, z double")
    pts = [(p, float(x), float(y)) for p, (x, y) in enumerate(rng.uniform(-3, 40, (200, 2)))]
    got = {r.pt_id: r.z for r in tiles.elevations_by_priority(spark.createDataFrame(pts, "pt_id long, x double, y double"), tile, cells, (10, 90)).collect()}
    for p, x, y in pts:
        want = None
        for k, x0, y0, _, _, nx, ny in boxes:
            i, j = round(y0 - y), round(x - x0)
            if 0 <= i < ny and 0 <= j < nx and 10 <= z[k, i, j] <= 90:
                want = z[k, i, j]
                break
        assert got[p] == want
    square = tile.select(F.col("tile_ord").alias("tile_id"), "x0", "y0", "nx", "ny", F.col("dx").alias("dxy"))
    out = {r.tile_id: r for r in tiles.trim_overlaps(square).collect()}
    for k, x0, y0, _, _, nx, ny in boxes:
        x1, y1 = x0 + nx - 1, y0 - ny + 1
        near, left, right, top, low = [], [], [], [], []
        for j, a0, b0, _, _, mx, my in boxes:
            a1, b1 = a0 + mx - 1, b0 - my + 1
            if j == k or not (a0 <= x1 + 1.5 and a1 >= x0 - 1.5 and b1 <= y0 + 1.5 and b0 >= y1 - 1.5):
                continue
            near.append(j)
            if j < k:
                continue
            if b0 >= y0 and b1 <= y1:
                left += [a1] if a0 <= x0 <= a1 else []
                right += [a0] if a0 <= x1 <= a1 else []
            if a0 <= x0 and a1 >= x1:
                top += [b1] if b0 >= y0 >= b1 else []
                low += [b0] if b1 <= y1 <= b0 else []
        skip_c, skip_r = (int(max(left) - x0) + 1 if left else 0), (int(y0 - min(top)) + 1 if top else 0)
        end_c, end_r = (int(min(right) - x0) if right else nx), (int(y0 - max(low)) if low else ny)
        r = out[k]
        assert (r.neighbours, r.skip_rows, r.skip_cols, r.rows, r.cols) == (near, skip_r, skip_c, max(0, end_r - skip_r), max(0, end_c - skip_c))
