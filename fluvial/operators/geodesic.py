"""Distances within plateaus, from tile to tile."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .raster import NEIGHBOURS

#: Steps of a cell that no source reaches.
_FAR = np.iinfo(np.int64).max // 2
_RIM = "ty long, tx long, iy long, ix long, level double, steps long"


def spread_in_tile(level: np.ndarray, steps: np.ndarray) -> None:
    """Lower ``steps`` to one more than the least of the neighbours of equal level, in place.

    Goes by distance, all cells of one distance at once.
    """
    ny, nx = level.shape
    wide, dist = np.full((ny + 2, nx + 2), np.nan), np.full((ny + 2, nx + 2), _FAR)
    wide[1:-1, 1:-1], dist[1:-1, 1:-1] = level, steps
    flat, dist = wide.ravel(), dist.ravel()
    jumps = [n.dy * (nx + 2) + n.dx for n in NEIGHBOURS]
    known = np.flatnonzero(dist < _FAR)
    known = known[np.argsort(dist[known], kind="stable")]
    starts = np.flatnonzero(np.diff(dist[known], prepend=-1))
    fronts = {int(dist[part[0]]): [part] for part in np.split(known, starts[1:]) if len(part)}
    order = sorted(fronts)
    while order:
        d = heapq.heappop(order)
        front = np.concatenate(fronts.pop(d))
        front = front[dist[front] == d]
        grown = []
        for j in jumps:
            to = front + j
            to = to[(flat[to] == flat[front]) & (dist[to] > d + 1)]
            dist[to] = d + 1
            grown.append(to)
        grown = np.concatenate(grown)
        if len(grown):
            if d + 1 not in fronts:
                heapq.heappush(order, d + 1)
            fronts.setdefault(d + 1, []).append(grown)
    steps[:] = dist.reshape(ny + 2, nx + 2)[1:-1, 1:-1]


def _pack(tile: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = pdf["iy"].to_numpy() - key[0] * tile, pdf["ix"].to_numpy() - key[1] * tile
        level, sind, steps = np.full((tile, tile), np.nan), np.full((tile, tile), -1), np.full((tile, tile), _FAR)
        level[iy, ix], sind[iy, ix] = pdf["level"].to_numpy(float), pdf["sind"]
        steps[iy, ix] = np.where(pdf["source"], 0, _FAR)
        steps[np.isnan(level)] = _FAR
        return pd.DataFrame({"ty": [key[0]], "tx": [key[1]], "level": [level.tobytes()], "sind": [sind.tobytes()], "steps": [steps.tobytes()]})

    return run


def _settled(tile: int, row, inputs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Levels and steps of a tile with what comes in over its rim."""
    level = np.frombuffer(row["level"]).reshape(tile, tile)
    steps = np.frombuffer(row["steps"], np.int64).reshape(tile, tile).copy()
    if len(inputs):
        iy, ix = inputs["iy"].to_numpy() - row["ty"] * tile, inputs["ix"].to_numpy() - row["tx"] * tile
        same = level[iy, ix] == inputs["level"].to_numpy(float)
        np.minimum.at(steps, (iy[same], ix[same]), inputs["steps"].to_numpy()[same])
    spread_in_tile(level, steps)
    return level, steps


def _rim(tile: int):
    def run(key, tiles: pd.DataFrame, inputs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in tiles.iterrows():
            level, steps = _settled(tile, row, inputs)
            edge = np.zeros(level.shape, bool)
            edge[[0, -1]] = edge[:, [0, -1]] = True
            y, x = np.nonzero(edge & (steps < _FAR))
            out.append(pd.DataFrame({"ty": key[0], "tx": key[1], "iy": y + key[0] * tile, "ix": x + key[1] * tile, "level": level[y, x], "steps": steps[y, x]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["ty", "tx", "iy", "ix", "level", "steps"])

    return run


def _cells(tile: int):
    def run(key, tiles: pd.DataFrame, inputs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in tiles.iterrows():
            _, steps = _settled(tile, row, inputs)
            found = steps < _FAR
            out.append(pd.DataFrame({"sind": np.frombuffer(row["sind"], np.int64).reshape(tile, tile)[found], "dist": steps[found]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["sind", "dist"])

    return run


def plateau_distance(cells: DataFrame, tile: int = 256) -> DataFrame:
    """``sind, dist``: steps from the nearest source over neighbours of equal ``level``, for the cells that a source reaches.

    ``cells`` has ``sind, iy, ix, level, source``; a null level is a barrier.
    Cells shuffle once, into one row a tile. A round spreads distances inside
    each tile whose inputs have changed and hands those of its rim to the
    neighbouring tiles; so rounds grow with the tiles that a way crosses, and
    what moves in a round is rims only.
    """
    ws = Workspace(cells.sparkSession, "geodesic")
    base = cells.select("sind", "iy", "ix", F.col("level").cast("double").alias("level"), F.coalesce("source", F.lit(False)).alias("source"))
    tiled = base.withColumns({"ty": F.floor(F.col("iy") / tile), "tx": F.floor(F.col("ix") / tile)})
    packed = ws.keep(tiled.groupBy("ty", "tx").applyInPandas(_pack(tile), "ty long, tx long, level binary, sind binary, steps binary"), "tiles")
    shift = F.explode(F.array(*[F.struct(F.lit(n.dy).alias("dy"), F.lit(n.dx).alias("dx")) for n in NEIGHBOURS]))
    key = ["ty", "tx", "iy", "ix", "level"]
    known = ws.keep(cells.sparkSession.createDataFrame([], _RIM), "known")
    active = packed
    while True:
        rim = active.groupBy("ty", "tx").cogroup(known.groupBy("ty", "tx")).applyInPandas(_rim(tile), _RIM)
        moved = rim.withColumn("s", shift).select(
            F.floor((F.col("iy") + F.col("s.dy")) / tile).alias("ty"), F.floor((F.col("ix") + F.col("s.dx")) / tile).alias("tx"), F.col("ty").alias("ty0"), F.col("tx").alias("tx0"),
            (F.col("iy") + F.col("s.dy")).alias("iy"), (F.col("ix") + F.col("s.dx")).alias("ix"), "level", (F.col("steps") + 1).alias("steps"),
        )
        sent = moved.filter("ty <> ty0 OR tx <> tx0").groupBy(*key).agg(F.min("steps").alias("steps"))
        better = ws.keep(sent.join(known.withColumnRenamed("steps", "old"), key, "left").filter("old IS NULL OR steps < old").drop("old"), "better")
        if not better.head(1):
            break
        merged = ws.keep(known.unionByName(better).groupBy(*key).agg(F.min("steps").alias("steps")), "known")
        active = packed.join(better.select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")
        ws.drop(known)
        known = merged
    found = ws.keep(packed.groupBy("ty", "tx").cogroup(known.groupBy("ty", "tx")).applyInPandas(_cells(tile), "sind long, dist long"), "cells")
    ws.clear(found)
    return found

