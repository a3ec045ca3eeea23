"""Depressions and flats: filling by tiles, draining by path reversal, flat resolution."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Workspace, cut
from .components import components
from .flow import accumulate, downstream_paths
from .geodesic import plateau_distance
from .raster import NEIGHBOURS, stencil

_OCEAN = -1


def flood_tile(z: np.ndarray, on_edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Priority flood of one tile from its border.

    ``z`` holds NaN without data; ``on_edge`` marks cells on the edge of the
    whole grid. Returns filled elevations, basin labels from 1, and the lowest
    pass between two labels; label 0 is the outside.
    """
    ny, nx = z.shape
    filled, label, closed = z.copy(), np.zeros(z.shape, np.int64), np.zeros(z.shape, bool)
    passes: dict[tuple[int, int], float] = {}
    border = np.zeros(z.shape, bool)
    border[[0, -1], :] = True
    border[:, [0, -1]] = True
    heap = [(z[i, j], i, j) for i, j in zip(*np.nonzero(border & ~np.isnan(z)))]
    inner = ~border & ~np.isnan(z)
    for i, j in zip(*np.nonzero(inner)):
        if np.isnan(z[i - 1 : i + 2, j - 1 : j + 2]).any():
            heap.append((z[i, j], i, j))
    heapq.heapify(heap)
    count = 0

    def meet(a: int, b: int, height: float) -> None:
        key = (min(a, b), max(a, b))
        if height < passes.get(key, np.inf):
            passes[key] = height

    while heap:
        h, i, j = heapq.heappop(heap)
        if closed[i, j]:
            continue
        closed[i, j] = True
        if not label[i, j]:
            count += 1
            label[i, j] = count
        own = label[i, j]
        if on_edge[i, j]:
            meet(0, own, filled[i, j])
        for n in NEIGHBOURS:
            a, b = i + n.dy, j + n.dx
            if not (0 <= a < ny and 0 <= b < nx):
                continue
            if np.isnan(z[a, b]):
                meet(0, own, filled[i, j])
            elif label[a, b]:
                if label[a, b] != own:
                    meet(own, label[a, b], max(filled[i, j], filled[a, b]))
            else:
                label[a, b] = own
                if filled[a, b] <= filled[i, j]:
                    filled[a, b] = filled[i, j]
                heapq.heappush(heap, (filled[a, b], a, b))
    return filled, label, passes


def lowest_ways_out(links: DataFrame) -> DataFrame:
    """``a, w``: for every basin the lowest height of all its ways to the ocean, a way being as high as its highest pass.

    ``links``: ``a, b, h`` in both directions, the ocean only as ``b``.
    Contraction along minimum spanning trees: every basin points over its
    lowest pass (ties by the two basins in either order, so only two basins can
    point at each other, and the smaller of these is then a root); pointers
    double, keeping the highest pass on the way; basins with one root become
    one. Basins at least halve each round. A root's level, known once later
    rounds are, bounds that of its basins from below.
    """
    rounds, left = [], links
    while left.limit(1).count():
        order = F.struct("h", F.least("a", "b"), F.greatest("a", "b"))
        best = cut(left.groupBy("a").agg(F.min_by(F.struct(F.col("b").alias("p"), "h"), order).alias("e")).select("a", "e.p", F.col("e.h").alias("w")), "ways")
        mutual = best.select(F.col("a").alias("p"), F.col("p").alias("a")).filter("a < p")
        ptr = cut(best.join(mutual, ["a", "p"], "left_anti"), "ways")
        while True:
            far = ptr.select(F.col("a").alias("p"), F.col("p").alias("q"), F.col("w").alias("v"))
            if ptr.join(far, "p", "left_semi").limit(1).count() == 0:
                break
            ptr = cut(ptr.join(far, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.greatest("w", F.coalesce("v", "w")).alias("w")), "ways")
        rounds.append(ptr)
        to_a, to_b = ptr.select("a", F.col("p").alias("pa")), ptr.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"), "h")
        left = cut(moved.filter((F.col("a") != F.col("b")) & (F.col("a") != _OCEAN)).groupBy("a", "b").agg(F.min("h").alias("h")), "ways")
    level = None
    for ptr in reversed(rounds):
        if level is None:
            level = ptr.select("a", F.when(F.col("p") == _OCEAN, F.col("w")).otherwise(float("inf")).alias("w"))
        else:
            above = level.select(F.col("a").alias("p"), F.col("w").alias("v"))
            here = ptr.join(above, "p", "left").select(
                "a", F.when(F.col("p") == _OCEAN, F.col("w")).otherwise(F.greatest("w", F.coalesce("v", F.lit(float("inf"))))).alias("w")
            )
            level = here.unionByName(level)
        level = cut(level, "ways")
    return level if level is not None else links.select("a", F.col("h").alias("w"))


def fill_depressions(cells: DataFrame, z: str = "z", tile: int = 256) -> DataFrame:
    """``sind, iy, ix, z``: elevations raised to the lowest level from which water leaves the grid.

    Water leaves over the grid's edge and into cells without data. Every tile
    is flooded by itself; its basins, the passes between them, and the passes
    to the basins of neighbouring tiles form a small graph that gives every
    basin its lowest way out; a cell then rises to its basin's level. Cells
    shuffle once, the graph has one node per tile basin.
    """
    base = cells.select("sind", "iy", "ix", F.col(z).cast("double").alias("z"))
    ext = base.agg(F.min("iy"), F.max("iy"), F.min("ix"), F.max("ix")).first()
    if ext[0] is None:
        return base
    y0, y1, x0, x1 = ext

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = pdf["iy"].to_numpy(), pdf["ix"].to_numpy()
        top, left = iy.min(), ix.min()
        grid = np.full((iy.max() - top + 1, ix.max() - left + 1), np.nan)
        grid[iy - top, ix - left] = pdf["z"].to_numpy(float)
        edge = np.zeros(grid.shape, bool)
        edge[iy - top, ix - left] = (iy == y0) | (iy == y1) | (ix == x0) | (ix == x1)
        filled, label, passes = flood_tile(grid, edge)
        base_id = (int(key[0]) << 40) + (int(key[1]) << 20)
        own = label[iy - top, ix - left]
        border = (iy == top) | (iy == iy.max()) | (ix == left) | (ix == ix.max())
        out = pd.DataFrame(
            {"kind": 0, "sind": pdf["sind"], "iy": iy, "ix": ix, "z": filled[iy - top, ix - left], "a": np.where(own > 0, base_id + own, _OCEAN), "b": border.astype(np.int64)}
        )
        links = [(1, 0, 0, 0, h, base_id + p[1], base_id + p[0] if p[0] else _OCEAN) for p, h in passes.items()]
        return pd.concat([out, pd.DataFrame(links, columns=out.columns)]) if links else out

    tiled = base.withColumns({"ty": F.floor(F.col("iy") / tile), "tx": F.floor(F.col("ix") / tile)})
    schema = "kind int, sind long, iy long, ix long, z double, a long, b long"
    parts = cut(tiled.groupBy("ty", "tx").applyInPandas(run, schema), "fill")
    inside = parts.filter("kind = 1").select("a", "b", F.col("z").alias("h"))
    # Rim cells without data belong to the ocean, so that water also leaves into those of neighbouring tiles.
    rim = cut(parts.filter("kind = 0 and b = 1").select("iy", "ix", F.when(~F.isnan("z"), F.col("z")).alias("z"), "a"), "fill-rim")
    shift = F.explode(F.array(*[F.struct(F.lit(n.dy).alias("dy"), F.lit(n.dx).alias("dx")) for n in NEIGHBOURS if (n.dy, n.dx) > (0, 0)]))
    moved = rim.withColumn("s", shift).select((F.col("iy") + F.col("s.dy")).alias("iy"), (F.col("ix") + F.col("s.dx")).alias("ix"), F.col("z").alias("z2"), F.col("a").alias("b"))
    across = rim.join(moved, ["iy", "ix"]).filter("a != b").select(
        F.when(F.col("a") == _OCEAN, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == _OCEAN, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.greatest("z", "z2").alias("h"),
    )
    links = inside.unionByName(across)
    links = links.unionByName(links.filter(F.col("b") != _OCEAN).select(F.col("b").alias("a"), F.col("a").alias("b"), "h"))
    links = cut(links.groupBy("a", "b").agg(F.min("h").alias("h")), "fill-links")
    level = lowest_ways_out(links)
    done = parts.filter("kind = 0").join(level, "a", "left")
    risen = F.when(F.isnan("z"), F.lit(None)).otherwise(F.greatest(F.col("z"), F.coalesce("w", F.col("z"))))
    return done.select("sind", "iy", "ix", risen.alias("z"))


def fill_with_slope(cells: DataFrame, z: str = "z", tile: int = 256) -> DataFrame:
    """``sind, iy, ix, z, steps``: filled elevations, and the steps of least slope on top of them.

    What a flood from the grid's edge gives that raises every cell above the
    one it comes from by a slope too small to reach the next elevation:
    ``z`` is the level of :func:`fill_depressions`, and ``steps`` counts the
    cells from where the level is left, 0 where the ground itself falls. So
    (z, steps) falls from every cell that is not on the grid's edge or beside
    one without data; z + steps * epsilon is the surface for a given slope.
    """
    ground = cells.select("sind", F.col(z).cast("double").alias("ground"))
    filled = fill_depressions(cells, z, tile).withColumnRenamed("z", "level").join(ground, "sind")
    wide = cut(stencil(cut(filled, "slope"), ["level"], tile).select(
        "sind", "iy", "ix", "level",
        ((F.size("nb") < 8) | F.exists("nb", lambda x: x["level"].isNull())
         | ((F.col("level") == F.col("ground")) & F.exists("nb", lambda x: x["level"] < F.col("level")))).alias("source"),
    ), "slope")
    dist = plateau_distance(wide, tile)
    return wide.join(dist, "sind", "left").select("sind", "iy", "ix", F.col("level").alias("z"), F.when(F.col("level").isNotNull(), F.coalesce("dist", F.lit(0))).alias("steps"))


def slope_directions(filled: DataFrame, tile: int = 512) -> DataFrame:
    """``sind, iy, ix, z, dir, nxt`` of :func:`fill_with_slope`'s rows: each cell to its lowest neighbour by (z, steps).

    Ties go to the first in the order of choice. The direction is 0 only on the
    grid's edge or beside cells without data, -1 without data.
    """
    wide = stencil(filled, ["z", "steps"], tile)
    rank = lambda x: F.struct(x["z"].alias("z"), x["steps"].alias("steps"), x["o"].alias("o"), x["code"].alias("code"), x["sind"].alias("sind"))
    best = F.array_min(F.transform(F.filter("nb", lambda x: x["z"].isNotNull()), rank))
    found = wide.withColumn("b", best)
    down = F.coalesce(F.struct("b.z", "b.steps") < F.struct("z", "steps"), F.lit(False)) & F.col("b").isNotNull()
    return found.select(
        "sind", "iy", "ix", "z",
        F.when(F.col("z").isNull(), F.lit(-1)).when(down, F.col("b.code")).otherwise(F.lit(0)).alias("dir"),
        F.when(F.col("z").isNotNull() & down, F.col("b.sind")).alias("nxt"),
    )


def fill_by_relaxation(cells: DataFrame, z: str = "z", epsilon: float = 0.0, max_rounds: int = 10_000, tile: int = 512) -> DataFrame:
    """Filling with a least slope of ``epsilon`` per cell: w = max(z, lowest neighbour's w + epsilon), from above.

    Rounds grow with the length of the longest way out, so this suits grids
    with small depressions; see :func:`fill_depressions` for others.
    """
    base = cells.select("sind", "iy", "ix", F.col(z).cast("double").alias("z"))
    first = stencil(base, ["z"], tile)
    free = (F.size("nb") < 8) | F.exists("nb", lambda x: x["z"].isNull())
    state = cut(first.select("sind", "iy", "ix", "z", F.when(F.col("z").isNull(), F.lit(None)).when(free, F.col("z")).otherwise(F.lit(float("inf"))).alias("w")), "relax-fill")
    for _ in range(max_rounds):
        wide = stencil(state, ["w"], tile)
        low = F.array_min(F.transform("nb", lambda x: x["w"])) + epsilon
        new = F.when((F.col("w") > F.col("z")) & (low < F.col("w")), F.greatest(F.col("z"), low)).otherwise(F.col("w"))
        nxt = cut(wide.select("sind", "iy", "ix", "z", new.alias("w"), F.col("w").alias("was")), "relax-fill")
        if nxt.filter("w < was").limit(1).count() == 0:
            break
        state = nxt.drop("was")
    else:
        raise RuntimeError(f"filling has not settled after {max_rounds} rounds")
    return state.select("sind", "iy", "ix", F.col("w").alias("z"))


def settle_groups(edges: list[tuple], pit: dict[int, tuple[float, bool]]) -> list[tuple]:
    """The rounds of :func:`exits_of_catchments` on a small graph: ``(group, a, b, cell, out)`` of every group that leaves.

    ``edges`` has ``(order, group, other, a, b, cell, out)`` both ways, ``pit``
    each group's pit and whether it is open.
    """
    ways: dict[int, tuple | None] = dict.fromkeys(pit)
    while True:
        root: dict[int, int] = {}
        for g in ways:
            path = []
            while g not in root and ways[g]:
                path.append(g)
                g = ways[g][0]
            root.update(dict.fromkeys(path, root.setdefault(g, g)))
        best: dict[int, tuple] = {}
        for e in edges:
            own = root[e[1]]
            if own != root[e[2]] and not pit[own][1] and (own not in best or e[0] < best[own][0]):
                best[own] = e
        moves = {}
        for own, e in best.items():
            other = root[e[2]]
            back = other in best and root[best[other][2]] == own
            z, z2 = pit[own][0], pit[other][0]
            if not (back and (z < z2 or (z == z2 and own > other))):
                moves[own] = e
        if not moves:
            return [(g, *w[1:]) for g, w in ways.items() if w]
        for _, g, other, *way in moves.values():
            turned = (other, *way)
            while turned:
                old, ways[g] = ways[g], turned
                # The way that was taken so far, walked from its other end.
                turned, g = ((g, old[2], old[1], old[4], old[3]), old[0]) if old else (None, g)


def exits_of_catchments(passes: DataFrame, pits: DataFrame, settle: int = 20_000) -> DataFrame:
    """``seg, cell, out``: the pass by which every catchment with an inner pit leaves towards an open one.

    ``passes`` has ``a, cell, b, out, z``: neighbouring cells of catchments
    ``a`` and ``b``, both ways, with the height of the pass. ``pits`` has
    ``seg, pit_z, open``. Passes rank by height, then by their two cells in
    either order, so all catchments rank them alike: those over which water
    leaves are the minimum spanning forest of the catchments, each of its trees
    with one that is open. Each round every group of catchments without an open
    pit takes its lowest pass to another group (of two that take the same pass,
    the one with the lower pit waits) and turns its ways round towards it; so
    groups at least halve. Only this graph is rewritten, not the grid. What is
    left at ``settle`` groups and ten times as many passes, or fewer, is
    settled in the same rounds by one task.
    """
    ws = Workspace(passes.sparkSession, "exits")
    order = F.struct("z", F.least("cell", "out"), F.greatest("cell", "out"))
    left = ws.keep(passes.groupBy("a", "b").agg(F.min(F.struct(order.alias("o"), "cell", "out")).alias("e")).select("a", "b", "e.o", "e.cell", "e.out"), "passes")
    ways = ws.keep(pits.select("seg", F.lit(None).cast("long").alias("to"), F.lit(None).cast("long").alias("cell"), F.lit(None).cast("long").alias("out")), "ways")
    groups = ws.keep(pits.select("seg", F.col("seg").alias("g")), "groups")
    roots = ws.keep(pits.select(F.col("seg").alias("g"), "pit_z", F.coalesce("open", F.lit(False)).alias("open")), "roots")
    while True:
        inner = roots.filter("NOT open").select(F.col("g").alias("ga"), "pit_z")
        with_groups = left.join(groups.select(F.col("seg").alias("a"), F.col("g").alias("ga")), "a").join(groups.select(F.col("seg").alias("b"), F.col("g").alias("gb")), "b")
        # Passes inside a group are gone for good.
        across = ws.keep(with_groups.filter("ga <> gb"), "across")
        last = roots.count() <= settle and across.count() <= 20 * settle
        if last:
            moves = ws.keep(_settled(across, roots), "moves")
            ways, _ = _turn(ws, ways, moves)
            break
        best = across.join(inner, "ga").groupBy("ga").agg(F.min(F.struct("o", "a", "b", "cell", "out", "gb")).alias("e"), F.first("pit_z").alias("pit_z"))
        chosen = ws.keep(best.select("ga", "pit_z", "e.a", "e.b", "e.cell", "e.out", "e.gb"), "chosen")
        back = chosen.select(F.col("ga").alias("gb"), F.col("gb").alias("back"), F.col("pit_z").alias("other_z"))
        wait = chosen.join(back, "gb").filter((F.col("back") == F.col("ga")) & ((F.col("pit_z") < F.col("other_z")) | ((F.col("pit_z") == F.col("other_z")) & (F.col("ga") > F.col("gb")))))
        moves = ws.keep(chosen.join(wait.select("ga"), "ga", "left_anti"), "moves")
        if not moves.head(1):
            break
        next_ways, used = _turn(ws, ways, moves)
        # Groups that moved take the name of the one they end in.
        ends = accumulate(roots.join(moves.select(F.col("ga").alias("g"), "gb"), "g", "left").select(F.col("g").alias("sind"), F.col("gb").alias("nxt"))).select(F.col("sind").alias("g"), "outlet")
        next_groups = ws.keep(groups.join(ends, "g").select("seg", F.col("outlet").alias("g")), "groups")
        next_roots = ws.keep(roots.join(moves.select(F.col("ga").alias("g")), "g", "left_anti"), "roots")
        rest = ws.keep(across.select("a", "b", "o", "cell", "out"), "passes")
        ws.drop(left, ways, groups, roots, across, chosen, moves, *used)
        left, ways, groups, roots = rest, next_ways, next_groups, next_roots
    ws.clear(ways)
    return ways.filter("to is not null").select("seg", "cell", "out")


def _turn(ws: Workspace, ways: DataFrame, moves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``ways`` with those of the groups that move turned round, from where they now leave to where they ended; tables used on the way."""
    path = ws.keep(downstream_paths(ways.select(F.col("seg").alias("sind"), F.col("to").alias("nxt")), moves.select(F.col("a").alias("sind"))), "path")
    before = path.select("start", (F.col("step") + 1).alias("step"), F.col("sind").alias("prior"))
    first = moves.select(F.col("a").alias("seg"), F.col("b").alias("to"), "cell", "out")
    old = ways.select(F.col("seg").alias("prior"), F.col("cell").alias("was_cell"), F.col("out").alias("was_out"))
    later = path.filter("step > 0").join(before, ["start", "step"]).join(old, "prior").select(F.col("sind").alias("seg"), F.col("prior").alias("to"), F.col("was_out").alias("cell"), F.col("was_cell").alias("out"))
    turned = ws.keep(first.unionByName(later), "turned")
    return ws.keep(ways.join(turned.select("seg"), "seg", "left_anti").unionByName(turned), "ways"), [path, turned]


def _settled(across: DataFrame, roots: DataFrame) -> DataFrame:
    """``ga, a, b, cell, out`` of the groups of a small graph that leave."""
    rows = across.select("ga", "gb", "a", "b", "cell", "out", F.col("o.z").cast("double").alias("z"), F.lit(False).alias("open"), F.lit(False).alias("is_pit")).unionByName(
        roots.select(F.col("g").alias("ga"), *[F.lit(0).cast("long").alias(c) for c in ("gb", "a", "b", "cell", "out")], F.col("pit_z").cast("double").alias("z"), "open", F.lit(True).alias("is_pit"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_pit = pdf["is_pit"]
        pit = {int(g): (z, bool(o)) for g, z, o in pdf.loc[is_pit, ["ga", "z", "open"]].itertuples(index=False)}
        edges = [
            ((z, min(c, o), max(c, o)), int(ga), int(gb), int(a), int(b), int(c), int(o))
            for ga, gb, a, b, c, o, z in pdf.loc[~is_pit, ["ga", "gb", "a", "b", "cell", "out", "z"]].itertuples(index=False)
        ]
        return pd.DataFrame(settle_groups(edges, pit), columns=["ga", "a", "b", "cell", "out"], dtype="int64")

    return rows.groupBy().applyInPandas(run, "ga long, a long, b long, cell long, out long")


def drain_depressions(d8: DataFrame, tile: int = 512) -> DataFrame:
    """``sind, iy, ix, z, nxt``: inner pits drained by reversing the path from the lowest pass to the pit.

    The graph of catchments and passes gives each catchment with an inner pit
    its way out (:func:`exits_of_catchments`); then the paths from all exits to
    their pits turn round in one pass over the grid. Pits on the grid's edge or
    beside cells without data stay, as does a pit without a way to any of these.
    """
    cells = cut(d8.filter("z is not null").select("sind", "iy", "ix", "z", "nxt"), "drain")
    flow = cut(accumulate(cells).select("sind", F.col("outlet").alias("seg")), "drain-flow")
    wide = stencil(d8.select("sind", "iy", "ix", "z").join(flow, "sind", "left"), ["z", "seg"], tile)
    near = cut(wide.filter("z is not null").select(
        "sind", "z", "seg", ((F.size("nb") < 8) | F.exists("nb", lambda x: x["z"].isNull())).alias("open"),
        F.transform(F.filter("nb", lambda x: x["seg"] != F.col("seg")), lambda x: F.struct(x["sind"].alias("sind"), x["z"].alias("z"), x["seg"].alias("seg"))).alias("n"),
    ), "drain-near")
    passes = near.select(F.col("seg").alias("a"), F.col("sind").alias("cell"), "z", F.explode("n").alias("n")).select("a", "cell", F.col("n.seg").alias("b"), F.col("n.sind").alias("out"), F.greatest("z", "n.z").alias("z"))
    pits = near.filter("sind = seg").select("seg", F.col("z").alias("pit_z"), "open")
    exits = exits_of_catchments(passes, pits)
    paths = downstream_paths(cells, exits.select(F.col("cell").alias("sind")))
    prior = paths.select("start", (F.col("step") + 1).alias("step"), F.col("sind").alias("up"))
    first = exits.select(F.col("cell").alias("sind"), F.col("out").alias("new"))
    turned = first.unionByName(paths.filter("step > 0").join(prior, ["start", "step"]).select("sind", F.col("up").alias("new")))
    return cut(cells.join(turned, "sind", "left").select("sind", "iy", "ix", "z", F.coalesce("new", "nxt").alias("nxt")), "drain")


def carve(flow: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``flow`` with ``z`` lowered to the lowest elevation of all cells that drain through a cell.

    Elevations then never rise along ``nxt``. Round k takes in the cells within
    2**k steps upstream, pre-aggregated before the shuffle.
    """
    low = cut(flow.filter("z is not null").select("sind", F.col("nxt").alias("to"), F.col("z").alias("low")), "carve")
    for _ in range(max_rounds):
        inflow = low.filter("to is not null").groupBy(F.col("to").alias("sind")).agg(F.min("low").alias("above"))
        if inflow.limit(1).count() == 0:
            break
        jump = low.select(F.col("sind").alias("to"), F.col("to").alias("_to"))
        wide = low.join(inflow, "sind", "left").withColumn("low", F.least("low", "above"))
        low = cut(wide.join(jump, "to", "left").select("sind", F.col("_to").alias("to"), "low"), "carve")
    out = flow.join(low.select("sind", "low"), "sind", "left").withColumn("z", F.coalesce("low", "z"))
    return out.select(flow.columns)


def breach_depressions(d8: DataFrame, tile: int = 512) -> DataFrame:
    """``sind, iy, ix, z, nxt``: inner pits opened by carving down the way over their lowest passes.

    Ways are those of :func:`drain_depressions`. Cells off these ways, cells
    without data, and pits at the grid's edge or beside such cells keep ``z``.
    """
    drained = cut(drain_depressions(d8, tile), "breach")
    return carve(drained)


def resolve_flats(d8: DataFrame, tile: int = 512) -> DataFrame:
    """Directions on flats that can drain: ``sind, iy, ix, z, dir, nxt``.

    A flat is drawn towards its low edges (twice the distance) and away from its
    high edges; each cell then takes its lowest flat neighbour in that gradient,
    or a low edge. Flats without a low edge keep direction 0.
    """
    wide = cut(stencil(d8, ["z", "dir"], tile), "flats")
    equal = F.filter("nb", lambda x: x["z"] == F.col("z"))
    links = cut(wide.filter("dir = 0").select(F.col("sind").alias("a"), F.explode(F.transform(F.filter(equal, lambda x: x["dir"] == 0), lambda x: x["sind"])).alias("b")), "flat-links")
    # Low edges drain; the flat cells beside them are one step away.
    flat = wide.select(
        "sind", "iy", "ix", F.when(F.col("dir") == 0, F.col("z")).alias("level"),
        F.exists(equal, lambda x: x["dir"] > 0).alias("by_low"), F.exists("nb", lambda x: x["z"] > F.col("z")).alias("by_high"),
    )
    low = plateau_distance(flat.withColumnRenamed("by_low", "source"), tile).select("sind", (F.col("dist") + 1).alias("dl"))
    high = plateau_distance(flat.withColumnRenamed("by_high", "source"), tile).select("sind", (F.col("dist") + 1).alias("dh"))
    names = components(links, "a", "b").select(F.col("id").alias("sind"), F.col("component").alias("flat"))
    flats = cut(low.join(high, "sind", "left").join(names, "sind", "left").withColumn("flat", F.coalesce("flat", "sind")), "flats")
    # One row a flat, so that no flat is a task of its own.
    tops = flats.groupBy("flat").agg(F.coalesce(F.max("dh"), F.lit(0)).alias("top"))
    g = F.col("dl") * 2 + F.coalesce(F.col("top") - F.col("dh") + 1, F.col("top") + 1)
    grad = cut(flats.join(tops, "flat").select("sind", g.alias("g")), "flat-grad")
    graded = d8.select("sind", "iy", "ix", "z", "dir", "nxt").join(grad, "sind", "left")
    w = stencil(graded, ["z", "dir", "g"], tile)
    able = F.filter("nb", lambda x: (x["z"] == F.col("z")) & ((x["dir"] > 0) | (x["g"] < F.col("g"))))
    pick = F.array_min(F.transform(able, lambda x: F.struct(F.coalesce(F.when(x["dir"] > 0, F.lit(0)).otherwise(x["g"]), F.lit(0)).alias("k"), x["o"].alias("o"), x["code"].alias("code"), x["sind"].alias("sind"))))
    take = (F.col("dir") == 0) & F.col("g").isNotNull() & pick.isNotNull()
    return w.select("sind", "iy", "ix", "z", F.when(take, pick["code"]).otherwise(F.col("dir")).alias("dir"), F.when(take, pick["sind"]).otherwise(F.col("nxt")).alias("nxt"))
