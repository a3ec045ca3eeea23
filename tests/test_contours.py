"""Outlines and climbs against plain walks."""

import numpy as np
import pytest

from fluvial.operators.contours import climbed_cells, first_cells, segment_outlines

CLOCK = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def trace(mask):
    """A clockwise walk around the part of a mask that holds its first cell, one look at a time."""
    cells = np.argwhere(mask)
    if not len(cells):
        return []
    padded, at, empty = np.pad(mask, 1), (int(cells[0][0]), int(cells[0][1])), 0
    path, seen = [], set()
    while (at, empty) not in seen:
        seen.add((at, empty))
        path.append(at)
        for k in range(1, 9):
            d = (empty + k) % 8
            to = (at[0] + CLOCK[d][0], at[1] + CLOCK[d][1])
            if padded[to[0] + 1, to[1] + 1]:
                last = (at[0] + CLOCK[(d - 1) % 8][0], at[1] + CLOCK[(d - 1) % 8][1])
                empty = CLOCK.index((last[0] - to[0], last[1] - to[1]))
                at = to
                break
        else:
            break
    # The first cell may come again under another look before the walk repeats itself.
    return path[:-1] if len(path) > 1 and path[-1] == path[0] else path


def walks(spark, masks, tile):
    cells = [(s, int(i) - 3, int(j) + 4) for s, m in masks.items() for i, j in np.argwhere(m)]
    found = {}
    for r in segment_outlines(spark.createDataFrame(cells, "seg long, iy long, ix long"), tile=tile).orderBy("seg", "pos").collect():
        assert r.pos == len(found.setdefault(r.seg, []))
        found[r.seg].append((r.iy + 3, r.ix - 4))
    return found


@pytest.mark.parametrize("tile", [5, 64])
def test_outlines_equal_a_plain_walk(spark, tile):
    rng, masks = np.random.default_rng(5), {}
    for seg in range(30):
        mask, at = np.zeros((13, 17), bool), [6, 8]
        for _ in range(int(rng.integers(1, 120))):
            mask[at[0], at[1]] = True
            at = [int(np.clip(v + d, 0, n)) for v, d, n in zip(at, rng.integers(-1, 2, 2), (12, 16), strict=True)]
        masks[seg] = mask
    masks[30] = np.ones((1, 1), bool)
    ring = np.ones((9, 9), bool)
    ring[3:6, 2:7] = False
    masks[31] = ring
    block = np.zeros((5, 6), bool)
    block[1:4, 1:5] = True
    masks[32] = block
    assert walks(spark, masks, tile) == {s: trace(m) for s, m in masks.items()}


def test_outlines_of_nothing_and_of_rows_with_nulls(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 0, "a"), (1, 0, 1, "b"), (None, 0, 2, "c"), (1, None, 2, "d"), (1, 2, None, "e")]
    cells = spark.createDataFrame(rows, "seg long, iy long, ix long, id string")
    assert [tuple(r) for r in segment_outlines(cells).orderBy("pos").collect()] == [(1, 0, 0, 0), (1, 1, 0, 1)]
    assert segment_outlines(cells.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [6, 512])
def test_climb_equals_a_plain_loop(spark, tile):
    rng = np.random.default_rng(8)
    seg = np.kron(rng.integers(0, 4, (4, 5)), np.ones((4, 4), int))
    seg[rng.random(seg.shape) < 0.15] = 4
    ny, nx = seg.shape
    sinks = [int(s) for s in rng.choice(ny * nx, 40, replace=False)]
    want = set()
    for s in sinks:
        while True:
            i, j = divmod(s, nx)
            if i in (0, ny - 1) or j in (0, nx - 1):
                break
            up = [t for t in (s - nx - 1, s - nx, s - 1) if seg.flat[t] == seg.flat[s]]
            if not up:
                break
            s = min(up)
        want.add((int(seg.flat[s]), *divmod(s, nx)))
    cells = spark.createDataFrame([(i * nx + j, i, j, int(seg[i, j])) for i in range(ny) for j in range(nx)], "sind long, iy long, ix long, seg long")
    got = climbed_cells(cells, spark.createDataFrame([(s,) for s in sinks], "sind long"), tile=tile)
    assert {tuple(r) for r in got.collect()} == want


def test_a_walk_may_begin_at_any_border_cell(spark):
    cells = spark.createDataFrame([(7, i, j) for i in range(3) for j in range(4)], "seg long, iy long, ix long")
    assert [tuple(r) for r in first_cells(cells).collect()] == [(7, 0, 0)]
    start = spark.createDataFrame([(7, 2, 2)], "seg long, iy long, ix long")
    ring = [(r.iy, r.ix) for r in segment_outlines(cells, starts=start).orderBy("pos").collect()]
    assert ring == [(2, 2), (2, 1), (2, 0), (1, 0), (0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3)]
