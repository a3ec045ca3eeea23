import heapq

import numpy as np
import pytest

from fluvial.operators import fill, flow
from fluvial.operators.geodesic import plateau_distance, spread_in_tile

FAR = np.iinfo(np.int64).max // 2


def around(i, j, ny, nx):
    return [(a, b) for a in range(max(0, i - 1), min(ny, i + 2)) for b in range(max(0, j - 1), min(nx, j + 2)) if (a, b) != (i, j)]


def plain_steps(level, source):
    """A queue over the whole grid."""
    ny, nx = level.shape
    dist = {tuple(p): 0 for p in np.argwhere(source & ~np.isnan(level))}
    queue = sorted(dist)
    for i, j in queue:
        for a, b in around(i, j, ny, nx):
            if level[a, b] == level[i, j] and (a, b) not in dist:
                dist[a, b] = dist[i, j] + 1
                queue.append((a, b))
    return dist


def plain_flood(z):
    """Priority flood of the whole grid by (level, steps)."""
    ny, nx = z.shape
    done, heap = {}, []
    for i in range(ny):
        for j in range(nx):
            if not np.isnan(z[i, j]) and (i in (0, ny - 1) or j in (0, nx - 1) or any(np.isnan(z[p]) for p in around(i, j, ny, nx))):
                heapq.heappush(heap, ((z[i, j], 0), i, j))
    while heap:
        w, i, j = heapq.heappop(heap)
        if (i, j) in done:
            continue
        done[i, j] = w
        for a, b in around(i, j, ny, nx):
            if (a, b) not in done and not np.isnan(z[a, b]):
                heapq.heappush(heap, (max((z[a, b], 0), (w[0], w[1] + 1)), a, b))
    return done


def table(spark, z, **more):
    ny, nx = z.shape
    return spark.createDataFrame(
        [(i * nx + j, i, j, None if np.isnan(z[i, j]) else float(z[i, j]), *[bool(m[i, j]) for m in more.values()]) for i in range(ny) for j in range(nx)],
        "sind long, iy long, ix long, z double" + "".join(f", {k} boolean" for k in more),
    )


def grid(seed, ny=37, nx=29, levels=4):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, levels, (ny // 3 + 1, nx // 3 + 1)).repeat(3, 0).repeat(3, 1)[:ny, :nx].astype(float)
    z[rng.random(z.shape) < 0.03] = np.nan
    return z, rng.random(z.shape) < 0.02


def test_spread_in_tile():
    for seed in range(5):
        z, source = grid(seed)
        steps = np.where(source & ~np.isnan(z), 0, FAR)
        spread_in_tile(z, steps)
        assert {tuple(p): int(steps[tuple(p)]) for p in np.argwhere(steps < FAR)} == plain_steps(z, source)


@pytest.mark.parametrize("tile", [5, 16, 64])
def test_distances_do_not_depend_on_tiles(spark, tile):
    z, source = grid(11)
    # A winding corridor that crosses tiles many times.
    z[20:36, 1:28] = np.nan
    for k, row in enumerate(range(20, 36, 2)):
        z[row, 1:28] = 7
        if row + 1 < 36:
            z[row + 1, 27 if k % 2 == 0 else 1] = 7
    source[20:36] = False
    source[20, 1] = True
    want = {i * 29 + j: d for (i, j), d in plain_steps(z, source).items()}
    cells = table(spark, z, source=source).withColumnRenamed("z", "level")
    assert {r.sind: r.dist for r in plateau_distance(cells, tile).collect()} == want and max(want.values()) > 150


@pytest.mark.parametrize("tile", [16, 64])
def test_least_slope_equals_a_flood_of_the_whole(spark, tile):
    rng = np.random.default_rng(tile)
    z = np.floor(rng.random((40, 33)) * 6)
    z[rng.random(z.shape) < 0.01] = np.nan
    z[10:22, 8:20] = -3
    z[10, 8:20] = z[21, 8:20] = z[10:22, 8] = z[10:22, 19] = 9
    filled = fill.fill_with_slope(table(spark, z), tile=tile)
    got = {r.sind: (r.z, r.steps) for r in filled.collect()}
    want = {i * 33 + j: w for (i, j), w in plain_flood(z).items()}
    assert {k: v for k, v in got.items() if v[0] is not None} == want and max(s for _, s in want.values()) > 3
    # Water leaves every cell: only the edge and cells beside no data have no direction.
    d8 = {r.sind: r for r in fill.slope_directions(filled, tile).collect()}
    open_ = {i * 33 + j for i in range(40) for j in range(33) if i in (0, 39) or j in (0, 32) or any(np.isnan(z[p]) for p in around(i, j, 40, 33))}
    assert all(r.dir != 0 or k in open_ for k, r in d8.items())
    assert all(r.nxt is None or got[r.nxt] < got[k] for k, r in d8.items())


def test_empty_grid_and_no_source(spark):
    empty = table(spark, np.zeros((0, 0)), source=np.zeros((0, 0), bool)).withColumnRenamed("z", "level")
    assert plateau_distance(empty).count() == 0
    z = np.zeros((4, 4))
    assert plateau_distance(table(spark, z, source=z > 1).withColumnRenamed("z", "level"), 2).count() == 0


def test_loops_with_a_long_tail(spark):
    """A tail of 3000 cells into a loop of 7, a loop of one, and paths that end."""
    nxt = {i: i + 1 for i in range(3000)} | {3000 + i: 3000 + (i + 1) % 7 for i in range(7)} | {5000: 5000, 6001: 6000, 6000: None, 6002: 3003}
    got = {r.sind: r.flag for r in flow.loop_flags(spark.createDataFrame(list(nxt.items()), "sind long, nxt long")).collect()}
    want = {i: 2 for i in range(3000)} | {3000 + i: 1 for i in range(7)} | {5000: 1, 6001: 0, 6000: 0, 6002: 2}
    assert got == want
