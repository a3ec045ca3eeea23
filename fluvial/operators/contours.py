"""Ordered outlines of segments on a grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .flow import accumulate
from .raster import stencil, with_halo

#: Neighbours in clockwise order from the west (fixed order).
_CLOCK = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def _last_empty(mask: int, d: int) -> int:
    """Last direction of the run of empty neighbours that begins at ``d``; bit k of ``mask`` is set where neighbour k is filled."""
    while not mask >> (d + 1) % 8 & 1:
        d = (d + 1) % 8
    return d


#: By mask and first empty direction: where the run of empty neighbours ends.
_RUN = np.array([[_last_empty(m, d) if m else 0 for d in range(8)] for m in range(256)])
#: By mask: the run that a walk begins at, that of the first empty side in the order W, N, E, S; -1 where all sides are filled.
_ENTRY = np.array([next((int(_RUN[m][d]) for d in (0, 2, 4, 6) if not m >> d & 1), -1) for m in range(256)])


def _tile_states(iy: np.ndarray, ix: np.ndarray, home: np.ndarray) -> dict[str, np.ndarray]:
    """Border states of a tile's own cells: a filled cell with a run of empty neighbours, and the state that a clockwise walk goes to.

    The cells reach two beyond the tile, since the next state is judged by the
    neighbours of the next cell.
    """
    y0, x0 = iy.min() - 2, ix.min() - 2
    filled = np.zeros((iy.max() - y0 + 3, ix.max() - x0 + 3), bool)
    filled[iy - y0, ix - x0] = True
    masks = np.zeros(filled.shape, np.int64)
    for k, (dy, dx) in enumerate(_CLOCK):
        masks[1:-1, 1:-1] |= filled[1 + dy : filled.shape[0] - 1 + dy, 1 + dx : filled.shape[1] - 1 + dx].astype(np.int64) << k
    mine = np.zeros_like(filled)
    mine[iy[home] - y0, ix[home] - x0] = True
    y, x = np.nonzero(mine)
    own = masks[y, x]
    out = []
    for d, (ey, ex) in enumerate(_CLOCK):
        step = _CLOCK[(d + 1) % 8]
        at = (own >> d & 1 == 0) & (own >> (d + 1) % 8 & 1 == 1)
        if d % 2:
            # A lone empty corner between two filled sides is passed over: the walk takes the diagonal.
            at &= own >> d - 1 & 1 == 0
        ny, nx = y[at] + step[0], x[at] + step[1]
        # The empty cell looked at last, as the next cell sees it.
        back = _CLOCK.index((ey - step[0], ex - step[1]))
        out.append((y[at], x[at], np.full(at.sum(), d), ny, nx, _RUN[masks[ny, nx], back], _ENTRY[own[at]] == d))
    alone = own == 0
    zero = np.zeros(alone.sum(), np.int64)
    out.append((y[alone], x[alone], zero, y[alone], x[alone], zero, zero == 0))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return dict(zip(("iy", "ix", "d", "niy", "nix", "nd", "entry"), (cols[0] + y0, cols[1] + x0, cols[2], cols[3] + y0, cols[4] + x0, cols[5], cols[6]), strict=True))


def border_states(cells: DataFrame, seg: str = "seg", tile: int = 512) -> DataFrame:
    """``seg, iy, ix, d, niy, nix, nd, entry``: linked border states of every segment.

    A state is a cell and the last of a run of empty neighbours (direction
    ``d``, clockwise from the west); ``n*`` is the state a clockwise walk goes
    to, which makes the states of a segment a permutation: its outline and its
    holes are cycles of their own. ``entry`` marks the state that a walk from
    the cell begins with. Segments may overlap. A task sees one tile of one
    segment; rows with nulls are left out and repeated rows count once.
    """
    if tile < 5:
        raise ValueError("tile must be at least 5")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _tile_states(pdf["iy"].to_numpy(), pdf["ix"].to_numpy(), pdf["home"].to_numpy())
        return pd.DataFrame({"seg": pdf["seg"].iloc[0], **found})

    rows = cells.select(F.col(seg).cast("long").alias("seg"), F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix")).dropna()
    kind = "seg long, iy long, ix long, d long, niy long, nix long, nd long, entry boolean"
    return with_halo(rows, tile, 2).groupBy("seg", "ty", "tx").applyInPandas(run, kind)


def first_cells(cells: DataFrame, seg: str = "seg") -> DataFrame:
    """``seg, iy, ix``: the first cell of every segment, by row and then by column."""
    first = cells.groupBy(F.col(seg).cast("long").alias("seg")).agg(F.min(F.struct(F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"))).alias("c"))
    return first.select("seg", "c.iy", "c.ix")


def climbed_cells(cells: DataFrame, starts: DataFrame, seg: str = "seg", tile: int = 512) -> DataFrame:
    """``seg, iy, ix``: where a climb from each of ``starts`` (``sind``) ends.

    A climb goes to the least index among the cells in the north-west, north
    and west that belong to the same segment, and ends where there is none or
    at the edge of the grid. ``cells`` is a dense grid with ``sind, iy, ix``
    and the segment; ends are found by pointer doubling.
    """
    wide = stencil(cells.select("sind", "iy", "ix", F.col(seg).alias("seg")), ["seg"], tile)
    same = F.filter("nb", lambda n: (n["seg"] == F.col("seg")) & (n["dy"] <= 0) & (n["dx"] <= 0))
    up = F.when(F.size("nb") == 8, F.array_min(F.transform(same, lambda n: n["sind"])))
    edges = cut(wide.filter("seg is not null").select("sind", "iy", "ix", "seg", up.alias("nxt")), "climb")
    ends = accumulate(edges).select("sind", "outlet").join(starts.select("sind").distinct(), "sind").select(F.col("outlet").alias("sind")).distinct()
    return edges.join(ends, "sind").select(F.col("seg").cast("long").alias("seg"), F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"))


def segment_outlines(cells: DataFrame, seg: str = "seg", starts: DataFrame | None = None, tile: int = 512) -> DataFrame:
    """``seg, pos, iy, ix``: cells of the outline of every segment in clockwise order from its start, each visit once.

    ``starts`` (``seg, iy, ix``, at most one a segment) names border cells to
    begin at, by default the first one of each segment; the outline is the
    cycle of border states that holds the start, so other parts and holes are
    left out. The order comes from list ranking: pointers to the previous
    state double, and within a chain no two states share a pointer, so a long outline makes no hot key.
    """
    states = cut(border_states(cells, seg, tile).withColumn("id", F.monotonically_increasing_id()), "outline")
    begin = (first_cells(cells.dropna(subset=[seg, "iy", "ix"]), seg) if starts is None else starts.select("seg", "iy", "ix")).withColumn("begins", F.lit(True))
    first = states.filter("entry").join(begin, ["seg", "iy", "ix"]).select("id", "begins")
    before = states.select("seg", F.col("niy").alias("iy"), F.col("nix").alias("ix"), F.col("nd").alias("d"), F.col("id").alias("prev"))
    linked = states.join(before, ["seg", "iy", "ix", "d"]).join(first, "id", "left")
    links = cut(linked.select(F.col("id").alias("sind"), F.when(F.col("begins").isNull(), F.col("prev")).alias("nxt")), "outline-links")
    ranked = accumulate(links).filter("outlet is not null").select(F.col("sind").alias("id"), F.col("depth").alias("pos"))
    return states.join(ranked, "id").select("seg", "pos", "iy", "ix")
