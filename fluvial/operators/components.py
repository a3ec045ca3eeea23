"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component`` (the least id reachable) of every id that has an edge to another.

    Contraction: every vertex points to its least neighbour; pointers double
    until they reach vertices below all their neighbours; edges are rewritten
    to these, loops and repeats go, and the next round sees only what is left,
    at most half the vertices. So the edges shrink from round to round instead
    of being joined again in full. The maps of the rounds, which shrink
    likewise, are composed backwards. Rounds are written to the shared folder
    and deleted when done; the driver sees one row a round. Edges with a null end, loops and repeated edges do no harm.
    """
    ws = Workspace(edges.sparkSession, "cc")

    def canonical(u: str, v: str):
        return F.greatest(u, v).alias("u"), F.least(u, v).alias("v")

    left = ws.keep(edges.filter(F.col(a) != F.col(b)).select(*canonical(a, b)).distinct(), "edges")
    maps = []
    while left.limit(1).count():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = ws.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "near")
        while True:
            far = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
            nxt = ws.keep(near.join(far, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "near")
            ws.drop(near)
            near = nxt
            if not near.filter("moved").limit(1).count():
                break
        maps.append(near)
        to_u, to_v = near.select("u", F.col("p").alias("pu")), near.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = left.join(to_u, "u").join(to_v, "v").filter("pu != pv").select(*canonical("pu", "pv")).distinct()
        moved = ws.keep(moved, "edges")
        ws.drop(left)
        left = moved
    if not maps:
        ws.clear()
        return edges.sparkSession.createDataFrame([], "id long, component long")
    found = maps[-1]
    for m in reversed(maps[:-1]):
        later = found.select(F.col("u").alias("p"), F.col("p").alias("last"))
        found = ws.keep(m.join(later, "p", "left").select("u", F.coalesce("last", "p").alias("p")), "map")
    ws.clear(found)
    return found.select(F.col("u").alias("id"), F.col("p").alias("component"))
