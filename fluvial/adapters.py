"""Grids, polylines, boxes, points, rings, meshes and river arcs from the test tables.

Each adapter has a DataFrame form and the same rows as SQL (``*_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRID_WIDTH = 100

CELL_SQL = """SELECT o_orderkey AS sind, CAST(floor(o_orderkey/100) AS BIGINT) AS iy, o_orderkey % 100 AS ix,
 CAST(round(o_totalprice*100) AS BIGINT) AS z_noise,
 CAST(floor(CAST(round(o_totalprice*100) AS BIGINT)/1000) AS BIGINT) + CAST(floor(o_orderkey/100) AS BIGINT)*20000 AS z_tilt,
 o_orderkey % 41 = 0 AS is_nodata FROM orders"""
NBR_SQL = """SELECT * FROM (VALUES (0,0,1,1,16,7),(1,-1,0,64,4,1),(2,0,-1,16,1,3),(3,1,0,4,64,5),(4,-1,1,128,8,0),(5,-1,-1,32,2,2),(6,1,-1,8,128,4),(7,1,1,2,32,6)) AS t(o,dy,dx,code,inv_code,o_search)"""
VERTEX_SQL = """SELECT user_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS vid,
 (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)*10.0E0 + event_id % 7 AS x, value AS y,
 CASE WHEN event_type='signup' THEN 1 ELSE 0 END AS pin FROM events"""
BOX_SQL = """SELECT s_suppkey AS tile_ord, (s_suppkey*37) % 100 - 15 AS x0, (s_suppkey*53) % 100 - 15 AS y0,
 (s_suppkey*37) % 100 + 15 AS x1, (s_suppkey*53) % 100 + 15 AS y1 FROM supplier"""
PT_SQL = """SELECT c_custkey AS pt_id, ((c_custkey*7919) % 10007)/100.0E0 AS x, ((c_custkey*104729) % 10009)/100.0E0 AS y, 0.5E0 + (c_custkey % 5)/10.0E0 AS thr FROM customer"""
RING_SQL = """SELECT n_nationkey AS poly_id, vid, (n_nationkey % 5)*20 + 10 + dx AS x, CAST(floor(n_nationkey/5) AS BIGINT)*20 + 10 + dy AS y
 FROM nation CROSS JOIN (VALUES (0,8,0),(1,5,6),(2,0,9),(3,-6,5),(4,-8,-1),(5,-2,-3),(6,1,-9),(7,6,-6)) AS t(vid,dx,dy)"""
ELEM_SQL = """SELECT sind*2 + k AS elem_id, CASE WHEN sind % 7 = 0 THEN 4 ELSE 3 END AS i34,
 CASE WHEN k=0 THEN sind ELSE sind+1 END AS n1, CASE WHEN k=0 THEN sind+1 ELSE sind+101 END AS n2,
 CASE WHEN k=0 AND sind % 7 = 0 THEN sind+101 ELSE sind+100 END AS n3, CASE WHEN sind % 7 = 0 THEN sind+100 ELSE -2 END AS n4
 FROM (SELECT o_orderkey AS sind FROM orders) q CROSS JOIN (VALUES (0),(1)) AS t(k)
 WHERE sind % 100 < 99 AND sind + 101 <= (SELECT max(o_orderkey) FROM orders) AND NOT (sind % 7 = 0 AND k = 1)"""
NODE_SQL = """SELECT sind AS node_id, ix + (sind % 5)*0.15E0 AS x, iy + (sind % 3)*0.2E0 AS y, CAST(z_tilt AS DOUBLE) AS dp FROM cell"""
ARC_SQL = """SELECT v.line_id AS river_id, CAST(a.pos AS INTEGER) AS arc_pos, v.vid, v.x, v.y + a.pos*5.0E0 AS y,
 3 + v.line_id % 3 AS nrow, a.pos = 0 OR a.pos = 2 + v.line_id % 3 AS is_outer
 FROM vertex v JOIN (VALUES (0),(1),(2),(3),(4)) AS a(pos) ON a.pos < 3 + v.line_id % 3"""

#: Common table expressions by name, each after those it uses.
CTE = {
    "cell": CELL_SQL, "nbr": NBR_SQL, "vertex": VERTEX_SQL, "box": BOX_SQL, "pt": PT_SQL, "ring": RING_SQL,
    "elem": ELEM_SQL, "node": NODE_SQL, "arc": ARC_SQL,
}
_USES = {"node": ["cell"], "arc": ["vertex"]}


def with_tables(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named adapter tables."""
    order = []
    for name in names:
        order += [u for u in _USES.get(name, []) if u not in order] + ([name] if name not in order else [])
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({CTE[n]})" for n in order)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster cells: ``sind, iy, ix, z_noise, z_tilt, is_nodata``."""
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    iy = F.floor(key / GRID_WIDTH)
    return read(spark, sf_dir, "orders").select(
        key.alias("sind"), iy.alias("iy"), (key % GRID_WIDTH).alias("ix"), cents.alias("z_noise"),
        (F.floor(cents / 1000) + iy * 20000).alias("z_tilt"), (key % 41 == 0).alias("is_nodata"),
    )


def vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polyline vertices: ``line_id, vid, x, y, pin``."""
    vid = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("line_id"), vid.cast("long").alias("vid"),
        (vid * 10.0 + F.col("event_id") % 7).alias("x"), F.col("value").alias("y"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("pin"),
    )


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("tile_ord"), (k * 37 % 100 - 15).alias("x0"), (k * 53 % 100 - 15).alias("y0"),
        (k * 37 % 100 + 15).alias("x1"), (k * 53 % 100 + 15).alias("y1"),
    )


def pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("pt_id"), (k * 7919 % 10007 / 100.0).alias("x"), (k * 104729 % 10009 / 100.0).alias("y"),
        (F.lit(0.5) + k % 5 / 10.0).alias("thr"),
    )


_OCTAGON = [(0, 8, 0), (1, 5, 6), (2, 0, 9), (3, -6, 5), (4, -8, -1), (5, -2, -3), (6, 1, -9), (7, 6, -6)]


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.explode(F.array(*[F.struct(F.lit(v).alias("vid"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for v, a, b in _OCTAGON]))
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(k, shape.alias("s")).select(
        k.alias("poly_id"), F.col("s.vid").alias("vid"), (k % 5 * 20 + 10 + F.col("s.dx")).alias("x"),
        (F.floor(k / 5) * 20 + 10 + F.col("s.dy")).alias("y"),
    )


def elem(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sind"))
    top = orders.agg(F.max("sind").alias("top"))
    quad, k, s = F.col("sind") % 7 == 0, F.col("k"), F.col("sind")
    return (
        orders.crossJoin(F.broadcast(top))
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        .filter((s % 100 < 99) & (s + 101 <= F.col("top")) & ~(quad & (k == 1)))
        .select(
            (s * 2 + k).alias("elem_id"), F.when(quad, 4).otherwise(3).alias("i34"),
            F.when(k == 0, s).otherwise(s + 1).alias("n1"), F.when(k == 0, s + 1).otherwise(s + 101).alias("n2"),
            F.when((k == 0) & quad, s + 101).otherwise(s + 100).alias("n3"),
            F.when(quad, s + 100).otherwise(F.lit(-2).cast("long")).alias("n4"),
        )
    )


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sind")
    return cell(spark, sf_dir).select(
        s.alias("node_id"), (F.col("ix") + s % 5 * 0.15).alias("x"), (F.col("iy") + s % 3 * 0.2).alias("y"),
        F.col("z_tilt").cast("double").alias("dp"),
    )


def river_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of grouped parallel arcs: ``river_id, arc_pos, vid, x, y, nrow, is_outer``."""
    last = F.col("line_id") % 3 + 2
    return (
        vertex(spark, sf_dir)
        .withColumn("pos", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        .select(
            F.col("line_id").alias("river_id"), F.col("pos").alias("arc_pos"), "vid", "x",
            (F.col("y") + F.col("pos") * 5.0).alias("y"), (F.col("line_id") % 3 + 3).alias("nrow"),
            ((F.col("pos") == 0) | (F.col("pos") == last)).alias("is_outer"),
        )
    )
