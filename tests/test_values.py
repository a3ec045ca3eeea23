"""Iterative operators against plain versions or what they must keep."""

import numpy as np
import pytest

from fluvial.adapters import elem, node
from fluvial.operators import mesh
from fluvial.operators.contours import segment_outlines
from fluvial.operators.rivers import outline_polygons
from fluvial.operators.sequence import smooth_between_nodes
from fluvial.plans import QUERIES


def area(p, t):
    (ax, ay), (bx, by), (cx, cy) = (p[v] for v in t)
    return ((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2


def test_relaxation_equals_a_plain_loop(spark, data):
    elems, place = elem(spark, data).collect(), {r.node_id: (r.x, r.y) for r in node(spark, data).collect()}
    tri, fixed, sides = [(e.n1, e.n2, e.n3) for e in elems if e.n4 < 0], set(), {}
    for e in elems:
        ring = [e.n1, e.n2, e.n3] + ([e.n4] if e.n4 >= 0 else [])
        fixed |= set(ring) if len(ring) == 4 else set()
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            sides.setdefault(frozenset((a, b)), []).append(e.elem_id)
    for s, owners in sides.items():
        fixed |= s if len(owners) == 1 else set()
    near = {}
    for t in tri:
        for v in t:
            near.setdefault(v, set()).update(w for w in t if w != v)
    for _ in range(5):
        goal = {v: place[v] if v in fixed or v not in near else tuple(np.mean([place[w] for w in near[v]], 0)) for v in place}
        while True:
            back = {v for t in tri if area(goal, t) <= 0 for v in t if goal[v] != place[v]}
            if not back:
                break
            goal.update({v: place[v] for v in back})
        place = goal
    got = {r.node_id: (r.x, r.y) for r in QUERIES["m12_relax"](spark, data).collect()}
    assert got.keys() == place.keys()
    assert max(abs(got[v][k] - place[v][k]) for v in got for k in (0, 1)) < 1e-5


def test_mesh_repair_keeps_the_covered_area(spark):
    rng, n = np.random.default_rng(5), 7
    spots = [(i * n + j, j + (float(rng.uniform(-0.55, 0.55)) if 0 < j < n - 1 else 0.0), i + (float(rng.uniform(-0.35, 0.35)) if 0 < i < n - 1 and 0 < j < n - 1 else 0.0), 1.0) for i in range(n) for j in range(n)]
    tris = []
    for i in range(n - 1):
        for j in range(n - 1):
            a = i * n + j
            tris += [(a, a + 1, a + n + 1), (a, a + n + 1, a + n)]
    place = {s[0]: s[1:3] for s in spots}
    rows = [(k, 3, *t, -2) for k, t in enumerate(tris) if area(place, t) > 0]
    whole = sum(area(place, r[2:5]) for r in rows)
    nodes = spark.createDataFrame(spots, "node_id long, x double, y double, dp double")
    elems = spark.createDataFrame(rows, "elem_id long, i34 int, n1 long, n2 long, n3 long, n4 long")
    before = mesh.quality_report(mesh.element_shapes(elems, nodes), 0.25, 3.5).count()
    edge = {r.node_id for r in mesh.boundary_nodes(elems).collect()}
    out_n, out_e = mesh.improve_mesh(nodes, elems, 0.25, 3.5, rounds=1)
    shapes, after = mesh.element_shapes(out_e, out_n).collect(), {r.node_id: (r.x, r.y) for r in out_n.collect()}
    assert sum(r.area for r in shapes) == pytest.approx(whole) and min(r.area for r in shapes) > 0
    assert all(after[v] == pytest.approx(place[v]) for v in edge)
    assert before > mesh.quality_report(mesh.element_shapes(out_e, out_n), 0.25, 3.5).count()


def outside(mask):
    """Cells of the frame around a mask from which its outside is reached over sides."""
    m = np.pad(mask, 1)
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and not m[a, b] and (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return seen


def test_outlines_hold_every_cell_beside_the_outside(spark):
    rng, masks = np.random.default_rng(2), {}
    for seg in range(25):
        mask, at = np.zeros((14, 14), bool), [7, 7]
        for _ in range(90):
            mask[at[0], at[1]] = True
            at = [int(np.clip(v + d, 0, 13)) for v, d in zip(at, rng.integers(-1, 2, 2), strict=True)]
        masks[seg] = mask
    masks[25] = np.ones((1, 1), bool)
    cells = [(s, int(i) + 3, int(j) - 4) for s, m in masks.items() for i, j in np.argwhere(m)]
    found = {}
    for r in segment_outlines(spark.createDataFrame(cells, "seg long, iy long, ix long")).orderBy("seg", "pos").collect():
        found.setdefault(r.seg, []).append((r.iy - 3, r.ix + 4))
    for seg, mask in masks.items():
        out = outside(mask)
        want = {(int(i), int(j)) for i, j in np.argwhere(mask) if any((i + 1 + a, j + 1 + b) in out for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        path = found[seg]
        assert set(path) == want
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 for a, b in zip(path, path[1:], strict=False))


def test_polygons_of_crossing_rivers(spark):
    arcs = [(0, p, v, float(x), float(y)) for p, y in enumerate((0, 2)) for v, x in enumerate((0, 5, 10))]
    arcs += [(1, p, v, float(x), float(y)) for p, x in enumerate((6, 4)) for v, y in enumerate((-4, 1, 6))]
    _, faces = outline_polygons(spark.createDataFrame(arcs, "river_id long, arc_pos int, vid long, x double, y double"))
    rings = {}
    for r in faces.orderBy("poly_id", "vid").collect():
        rings.setdefault(r.poly_id, []).append((r.x, r.y))
    sizes = sorted(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:] + q[:1], strict=True))) / 2 for q in rings.values())
    assert sizes == pytest.approx([4, 8, 8, 8, 8])


def test_sections_end_at_nodes_and_short_ones_take_a_shorter_window(spark):
    y = [0.0, 4.0, 1.0, 7.0, 2.0, 5.0, 3.0, 9.0]
    lines = [(1, v, float(v), q) for v, q in enumerate(y)] + [(2, 0, 4.0, 2.0), (2, 1, 4.0, 9.0)]
    got = {(r.line_id, r.vid): r.y for r in smooth_between_nodes(spark.createDataFrame(lines, "line_id long, vid long, x double, y double"), 3).collect()}
    assert [got[1, v] for v in (0, 4, 7)] == [0.0, 2.0, 9.0] and (got[2, 0], got[2, 1]) == (2.0, 9.0)
    # Vertices 0 to 4 are five: a window of three. Vertices 4 to 7 are four: a window of two, which reaches forwards.
    assert [got[1, v] for v in (1, 2, 3)] == pytest.approx([5 / 3, 4.0, 10 / 3])
    assert [got[1, v] for v in (5, 6)] == pytest.approx([4.0, 6.0])
