"""Grid operators: stencils over tiles with a halo, D8 directions, neighbour queries, flats."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Neighbour:
    """One of the eight neighbours: order of choice, offsets, code of the direction, its reverse, order of searches."""

    o: int
    dy: int
    dx: int
    code: int
    inverse: int
    search: int


#: Directions in their order of choice E, N, W, S, NE, NW, SW, SE (fixed values).
NEIGHBOURS = tuple(
    Neighbour(*v)
    for v in [
        (0, 0, 1, 1, 16, 7), (1, -1, 0, 64, 4, 1), (2, 0, -1, 16, 1, 3), (3, 1, 0, 4, 64, 5),
        (4, -1, 1, 128, 8, 0), (5, -1, -1, 32, 2, 2), (6, 1, -1, 8, 128, 4), (7, 1, 1, 2, 32, 6),
    ]
)


def flat_index(iy: Column, ix: Column, width: int | Column) -> Column:
    return iy * width + ix


def split_index(sind: Column, width: int | Column) -> tuple[Column, Column]:
    return F.floor(sind / width), sind % width


def cell_coordinates(iy: Column, ix: Column, xll: float, yll: float, dxy: float) -> tuple[Column, Column]:
    """Centre of a cell; ``yll`` is the y of the first row, which lies in the north."""
    return F.lit(xll) + ix * dxy, F.lit(yll) - iy * dxy


def mask_nodata(z: Column, nodata: float | None = None, limits: tuple[float, float] | None = None) -> Column:
    """Elevation, null where it is NaN, equals ``nodata`` or lies outside ``limits``."""
    bad = F.isnan(z.cast("double"))
    if nodata is not None:
        bad = bad | (z == nodata)
    if limits is not None:
        bad = bad | ~z.between(*limits)
    return F.when(~bad, z)


def subdomains(ny: int, nx: int, size: int, offset: int = 0) -> list[dict]:
    """Windows that cut a grid into about ``ny * nx / size`` blocks; the last row and column take the rest.

    Each has its own window and one widened by ``offset`` cells, as half-open ranges.
    """
    n = max(round(ny * nx / size), 1)
    cols = max(round(n**0.5), 1)
    rows = max(n // cols, 1)
    dy, dx = ny // rows, nx // cols
    out = []
    for i in range(rows):
        for k in range(cols):
            y0, x0 = i * dy, k * dx
            y1, x1 = (ny if i == rows - 1 else y0 + dy), (nx if k == cols - 1 else x0 + dx)
            out.append(
                {
                    "block": i * cols + k, "y0": y0, "y1": y1, "x0": x0, "x1": x1,
                    "hy0": max(0, y0 - offset), "hy1": min(ny, y1 + offset),
                    "hx0": max(0, x0 - offset), "hx1": min(nx, x1 + offset),
                }
            )
    return out


def with_halo(cells: DataFrame, tile: int, reach: int = 1) -> DataFrame:
    """Cells keyed by square tiles (``ty, tx``), border cells also in the tiles they touch; ``home`` marks the own tile.

    Only cells within ``reach`` of a border are copied, so a shuffle by tile
    moves little more than each cell once.
    """
    ys = F.array_distinct(F.array(F.floor((F.col("iy") - reach) / tile), F.floor((F.col("iy") + reach) / tile)))
    xs = F.array_distinct(F.array(F.floor((F.col("ix") - reach) / tile), F.floor((F.col("ix") + reach) / tile)))
    return (
        cells.withColumn("ty", F.explode(ys))
        .withColumn("tx", F.explode(xs))
        .withColumn("home", (F.floor(F.col("iy") / tile) == F.col("ty")) & (F.floor(F.col("ix") / tile) == F.col("tx")))
    )


def stencil(cells: DataFrame, values: Sequence[str], tile: int = 512) -> DataFrame:
    """Every cell with ``nb``: its existing neighbours as structs of place and values.

    One shuffle by tile; neighbours come from windows along rows and then
    along columns of the tile, both of which the tile's partitioning serves.
    The grid must be dense: nodata cells are rows with null values. A struct
    has ``o, dy, dx, code, inv, os, sind`` and the named values.
    """
    names = ["sind", *values]
    tiled = with_halo(cells, tile).repartition("ty", "tx")
    row = Window.partitionBy("ty", "tx", "iy").orderBy("ix")
    col = Window.partitionBy("ty", "tx", "ix").orderBy("iy")
    here = F.struct(*names)
    west = F.when(F.lag("ix").over(row) == F.col("ix") - 1, F.lag(here).over(row))
    east = F.when(F.lead("ix").over(row) == F.col("ix") + 1, F.lead(here).over(row))
    triple = tiled.withColumn("_t", F.struct(west.alias("m"), here.alias("c"), east.alias("p")))
    above = F.when(F.lag("iy").over(col) == F.col("iy") - 1, F.lag("_t").over(col))
    below = F.when(F.lead("iy").over(col) == F.col("iy") + 1, F.lead("_t").over(col))
    full = triple.withColumns({"_n": above, "_s": below}).filter("home")
    place = {-1: "m", 0: "c", 1: "p"}
    slots = []
    for n in NEIGHBOURS:
        side = f"{ {-1: '_n', 0: '_t', 1: '_s'}[n.dy] }.{place[n.dx]}"
        slots.append(
            F.when(
                F.col(side).isNotNull(),
                F.struct(
                    F.lit(n.o).alias("o"), F.lit(n.dy).alias("dy"), F.lit(n.dx).alias("dx"), F.lit(n.code).alias("code"),
                    F.lit(n.inverse).alias("inv"), F.lit(n.search).alias("os"), *[F.col(f"{side}.{c}").alias(c) for c in names],
                ),
            )
        )
    return full.withColumn("nb", F.array_compact(F.array(*slots))).drop("_t", "_n", "_s", "ty", "tx", "home")


def d8_directions(
    cells: DataFrame,
    z: str = "z",
    zlimit: float = 0.0,
    flats_by_index: bool = False,
    interior_only: bool = False,
    steepest: bool = False,
    tile: int = 512,
) -> DataFrame:
    """``sind, iy, ix, dir, nxt`` and ``z``: direction to the lowest neighbour.

    The lowest existing neighbour with data wins, at equal elevation the first
    in the order of choice. The direction is 0 unless the cell lies more than
    ``zlimit`` above it, -1 without data. ``flats_by_index`` lets cells within
    ``zlimit`` flow to that neighbour if their index is smaller.
    ``interior_only`` leaves the outermost cells at 0. ``steepest`` compares
    slopes, with diagonals longer, instead of elevations.
    """
    wide = stencil(cells.select("sind", "iy", "ix", F.col(z).alias("z")), ["z"], tile)
    run = lambda x: F.when(x["code"].isin(1, 4, 16, 64), F.lit(1.0)).otherwise(F.lit(2.0**0.5))
    rank = lambda x: F.struct(
        ((x["z"] - F.col("z")) / run(x) if steepest else x["z"]).alias("k"), x["o"].alias("o"), x["code"].alias("code"),
        x["sind"].alias("sind"), x["z"].alias("z"),
    )
    best = F.array_min(F.transform(F.filter("nb", lambda x: x["z"].isNotNull()), rank))
    found = wide.withColumn("b", best)
    down = F.col("z") > F.col("b.z") + zlimit
    if flats_by_index:
        down = down | ((F.abs(F.col("z") - F.col("b.z")) <= zlimit) & (F.col("sind") < F.col("b.sind")))
    if interior_only:
        # On a full rectangle exactly the outermost cells have fewer than eight neighbours.
        down = down & (F.size("nb") == 8)
    down = F.coalesce(down, F.lit(False))
    return found.select(
        "sind", "iy", "ix", "z",
        F.when(F.col("z").isNull(), F.lit(-1)).when(down, F.col("b.code")).otherwise(F.lit(0)).alias("dir"),
        F.when(F.col("z").isNotNull() & down, F.col("b.sind")).alias("nxt"),
    )


def close_borders(d8: DataFrame, ny: int, nx: int) -> DataFrame:
    """Directions that leave the grid become 0; at a corner only inward ones stay."""
    y, x, d = F.col("iy"), F.col("ix"), F.col("dir")
    top, bottom, left, right = y == 0, y == ny - 1, x == 0, x == nx - 1
    out = (
        (top & d.isin(32, 64, 128)) | (bottom & d.isin(2, 4, 8)) | (left & d.isin(8, 16, 32)) | (right & d.isin(1, 2, 128))
    )
    return d8.withColumn("dir", F.when(out & (d > 0), F.lit(0)).otherwise(d))


def downstream_cell(d8: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """``nxt``: index of the cell that a direction points to, -1 for none or outside the grid."""
    dy = F.lit(None).cast("int")
    dx = F.lit(None).cast("int")
    for n in NEIGHBOURS:
        dy = F.when(F.col("dir") == n.code, F.lit(n.dy)).otherwise(dy)
        dx = F.when(F.col("dir") == n.code, F.lit(n.dx)).otherwise(dx)
    ny, nx = F.col("iy") + dy, F.col("ix") + dx
    inside = (ny >= 0) & (nx >= 0) & (nx < width)
    if height is not None:
        inside = inside & (ny < height)
    return d8.withColumn("nxt", F.coalesce(F.when(inside, ny * width + nx), F.lit(-1)).cast("long"))


def upstream_neighbours(d8: DataFrame, values: Sequence[str] = (), tile: int = 512) -> DataFrame:
    """``sind, ups``: the neighbours whose direction points to the cell, as structs in search order."""
    wide = stencil(d8, ["dir", *values], tile)
    ups = F.filter("nb", lambda x: x["dir"] == x["inv"])
    order = lambda a, b: F.when(a["os"] < b["os"], F.lit(-1)).otherwise(F.lit(1))
    return wide.withColumn("ups", F.array_sort(ups, order))


def inflow_counts(d8: DataFrame, tile: int = 512) -> DataFrame:
    """Number of neighbours that flow into each cell."""
    return upstream_neighbours(d8, tile=tile).select("sind", F.size("ups").cast("long").alias("n_in"))


def main_upstream(d8: DataFrame, acc: str = "acc", limit: int = 0, tile: int = 512) -> DataFrame:
    """``sind, up_main, up_rest``: the inflowing neighbour with the largest accumulation, and the others.

    Neighbours below ``limit`` are left out; ties go to the first in search
    order; ``up_main`` is -1 if none is left.
    """
    wide = upstream_neighbours(d8, [acc], tile)
    able = F.filter("ups", lambda x: x[acc] >= limit)
    best = F.array_max(F.transform(able, lambda x: F.struct(x[acc].alias("acc"), (-x["os"]).alias("o"), x["sind"].alias("sind"))))
    return wide.withColumn("_b", best["sind"]).select(
        "sind",
        F.coalesce("_b", F.lit(-1)).alias("up_main"),
        F.transform(F.filter(able, lambda x: x["sind"] != F.col("_b")), lambda x: x["sind"]).alias("up_rest"),
    )


def same_segment_neighbours(cells: DataFrame, seg: str = "seg", tile: int = 512) -> DataFrame:
    """Number of neighbours in the cell's own segment."""
    wide = stencil(cells, [seg], tile)
    return wide.select("sind", F.size(F.filter("nb", lambda x: x[seg] == F.col(seg))).cast("long").alias("n_same"))


def nodata_border(cells: DataFrame, z: str = "z", tile: int = 512) -> DataFrame:
    """Cells with data that touch a cell without."""
    wide = stencil(cells.select("sind", "iy", "ix", F.col(z).alias("z")), ["z"], tile)
    return wide.filter(F.col("z").isNotNull() & F.exists("nb", lambda x: x["z"].isNull())).select("sind")


def flat_neighbours(d8: DataFrame, tile: int = 512) -> DataFrame:
    """Neighbour facts behind the flat searches, for cells with data.

    ``n_equal`` equal neighbours; ``high_edge``: a cell of a flat (direction 0)
    beside a higher one; ``low_edge``: a cell with a direction beside a
    flat one of equal elevation; ``lowest`` neighbour with its index.
    """
    wide = stencil(d8, ["z", "dir"], tile)
    equal = F.filter("nb", lambda x: x["z"] == F.col("z"))
    low = F.array_min(
        F.transform(
            F.filter("nb", lambda x: x["z"].isNotNull()),
            lambda x: F.struct(x["z"].alias("z"), x["o"].alias("o"), x["sind"].alias("sind")),
        )
    )
    return wide.filter("z is not null").select(
        "sind",
        F.size(equal).cast("long").alias("n_equal"),
        ((F.col("dir") == 0) & F.exists("nb", lambda x: x["z"] > F.col("z"))).alias("high_edge"),
        ((F.col("dir") > 0) & F.exists(equal, lambda x: x["dir"] == 0)).alias("low_edge"),
        low["z"].alias("z_low"),
        low["sind"].alias("sind_low"),
    )


def segment_border(cells: DataFrame, seg: str = "seg", tile: int = 512) -> DataFrame:
    """Cells of a segment that touch another one or the edge of the grid, and the lowest neighbour in another segment."""
    wide = stencil(cells, [seg, "z"], tile)
    other = F.filter("nb", lambda x: (x[seg] != F.col(seg)) & x["z"].isNotNull())
    low = F.array_min(F.transform(other, lambda x: F.struct(x["z"].alias("z"), x["o"].alias("o"), x["sind"].alias("sind"))))
    edge = (F.size("nb") < 8) | F.exists("nb", lambda x: F.coalesce(x[seg] != F.col(seg), F.lit(True)))
    return wide.select("sind", seg, edge.alias("on_border"), low["sind"].alias("out_sind"), low["z"].alias("out_z"))


def mosaic(cells: DataFrame, priority: str, values: Sequence[str]) -> DataFrame:
    """One row per cell from overlapping tiles, the tile with the highest ``priority`` on top."""
    top = F.max_by(F.struct(*values), F.col(priority))
    return cells.groupBy("iy", "ix").agg(top.alias("_v")).select("iy", "ix", *[F.col(f"_v.{c}").alias(c) for c in values])


def drop_halo(cells: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Cells of a window, re-indexed from its corner."""
    return cells.filter(F.col("iy").between(y0, y1 - 1) & F.col("ix").between(x0, x1 - 1)).withColumns(
        {"iy": F.col("iy") - y0, "ix": F.col("ix") - x0}
    ).withColumn("sind", F.col("iy") * (x1 - x0) + F.col("ix"))
