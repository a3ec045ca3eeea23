"""Round trips through the file formats: adapters' tables written, read back, and held against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import cell, elem, node, vertex, with_tables
from ..sources import files as fs
from ..sources import rasters as rs
from ..storage import cut, scratch_path
from .registry import query

C = with_tables("cell")
L = with_tables("vertex")
M = with_tables("elem", "node")
Z = "CAST(CASE WHEN NOT is_nodata THEN z_tilt END AS DOUBLE)"


def _ascii(spark, sf_dir) -> str:
    """The whole grid as one ASCII file; its path."""
    cells = cell(spark, sf_dir).select("iy", "ix", F.when(~F.col("is_nodata"), F.col("z_tilt")).cast("double").alias("z"))
    path = scratch_path(spark, "ascii")
    ny = (cells.agg(F.max("iy")).first()[0] or 0) + 1
    fs.write_asc(cells, path, ny, 100, -90.0, 30.0, 0.5)
    return path


@query("s1_ascii_header", f"{C} SELECT CAST(max(iy) + 1 AS BIGINT) AS ny, CAST(100 AS BIGINT) AS nx, -90.0E0 AS x0, 30.0E0 AS y0, 0.5E0 AS dxy FROM cell")
def s1(spark, sf_dir):
    h = fs.read_asc_headers(spark, _ascii(spark, sf_dir))
    return h.select(F.col("ny").cast("long").alias("ny"), F.col("nx").cast("long").alias("nx"), "x0", "y0", "dxy")


@query("s2_ascii_grid", f"{C} SELECT sind, iy, ix, {Z} AS z FROM cell")
def s2(spark, sf_dir):
    return fs.read_asc(spark, _ascii(spark, sf_dir)).select("sind", "iy", "ix", "z")


@query("s5_ascii_window", f"{C} SELECT sind, iy, ix, {Z} AS z FROM cell WHERE iy BETWEEN 3 AND 12 AND ix BETWEEN 20 AND 69")
def s5w(spark, sf_dir):
    return fs.read_asc(spark, _ascii(spark, sf_dir), rows=(3, 13), cols=(20, 70)).select("sind", "iy", "ix", "z")


def _rasters(spark, sf_dir) -> str:
    """The whole grid as TIFF files of 64 by 64 cells; their folder."""
    cells = cell(spark, sf_dir).select("iy", "ix", F.when(~F.col("is_nodata"), F.col("z_tilt")).cast("double").alias("z"))
    folder = scratch_path(spark, "rasters")
    cut(rs.write_rasters(cells, folder, 64, -90.0, 30.0, 0.5, strip=16), "written")
    return folder + "/*.tif"


#: The tiles of 64 by 64 cells as the writer makes them.
TIFF = """t AS (SELECT CAST(floor(iy / 64) AS BIGINT) AS ty, CAST(floor(ix / 64) AS BIGINT) AS tx, max(iy) % 64 + 1 AS ny, max(ix) % 64 + 1 AS nx FROM cell GROUP BY 1, 2)"""


@query("s3_raster_header", f"""{C}, {TIFF} SELECT -90 + (tx * 64 - 0.5E0) * 0.5E0 AS ulx, 30 - (ty * 64 - 0.5E0) * 0.5E0 AS uly, 0.5E0 AS dx, 0.5E0 AS dy, -9999.0E0 AS nodata,
CAST(ny AS BIGINT) AS ny, CAST(nx AS BIGINT) AS nx, CAST(ceil(ny / 16.0E0) AS BIGINT) AS blocks FROM t""")
def s3h(spark, sf_dir):
    return rs.read_headers(spark, _rasters(spark, sf_dir)).select("ulx", "uly", "dx", "dy", "nodata", "ny", "nx", "blocks")


@query("s3_raster_cells", f"{C} SELECT iy % 64 AS iy, ix % 64 AS ix, -90 + ix * 0.5E0 AS x, 30 - iy * 0.5E0 AS y, {Z} AS z FROM cell")
def s3(spark, sf_dir):
    # Cells that the table lacks, in the last row of files, have no data either.
    return rs.read_raster(spark, _rasters(spark, sf_dir)).join(_places(spark, sf_dir), ["x", "y"], "left_semi").select("iy", "ix", "x", "y", "z")


def _places(spark, sf_dir):
    return cell(spark, sf_dir).select((F.col("ix") * 0.5 - 90).alias("x"), (30 - F.col("iy") * 0.5).alias("y"))


@query("s5_raster_window", f"{C} SELECT iy % 64 AS iy, ix % 64 AS ix, {Z} AS z FROM cell WHERE iy % 64 BETWEEN 20 AND 33 AND ix % 64 BETWEEN 5 AND 24")
def s5r(spark, sf_dir):
    found = rs.read_raster(spark, _rasters(spark, sf_dir), rows=(20, 34), cols=(5, 25))
    return found.join(_places(spark, sf_dir), ["x", "y"], "left_semi").select("iy", "ix", "z")


@query("s6_raster_points", f"{C} SELECT -90 + ix * 0.5E0 AS x, 30 - iy * 0.5E0 AS y, {Z} AS z FROM cell WHERE NOT is_nodata")
def s6(spark, sf_dir):
    return rs.read_raster(spark, _rasters(spark, sf_dir)).filter("z is not null").select("x", "y", "z")


@query("s7_raster_boxes", f"""{C}, {TIFF} SELECT -90 + (tx * 64 - 0.5E0) * 0.5E0 AS x0, 30 - (ty * 64 - 0.5E0) * 0.5E0 - ny * 0.5E0 AS y0,
-90 + (tx * 64 - 0.5E0) * 0.5E0 + nx * 0.5E0 AS x1, 30 - (ty * 64 - 0.5E0) * 0.5E0 AS y1 FROM t""")
def s7(spark, sf_dir):
    return rs.raster_boxes(spark, _rasters(spark, sf_dir)).drop("path")


def _shapes(spark, sf_dir) -> str:
    """All lines in four shape files; their folder."""
    folder = scratch_path(spark, "shapes")
    lines = vertex(spark, sf_dir).select("line_id", "vid", "x", "y", F.col("pin").cast("double").alias("z"))
    cut(rs.write_shapes(lines, folder, 4), "written")
    return folder + "/*.shp"


@query("s15_merge_shapes", f"{L} SELECT vid, x, y, CAST(pin AS DOUBLE) AS z FROM vertex")
def s15(spark, sf_dir):
    return fs.read_shp(spark, _shapes(spark, sf_dir)).select(F.col("vid").cast("long").alias("vid"), "x", "y", "z")


@query("s9_shape_points", f"{L} SELECT x, y, count(*) AS n FROM vertex GROUP BY x, y")
def s9(spark, sf_dir):
    return fs.read_shp(spark, _shapes(spark, sf_dir)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("s4_variables", f"{C} SELECT sind, z_tilt AS z, is_nodata FROM cell")
def s4(spark, sf_dir):
    c, path = cell(spark, sf_dir), scratch_path(spark, "variables")
    fs.save_variables(path, elevation=c.select("sind", F.col("z_tilt").alias("z")), mask=c.select("sind", "is_nodata"))
    got = fs.load_variables(spark, path, "elevation", "mask")
    return got["elevation"].join(got["mask"], "sind")


@query("s10_map_round_trip", f"""{L}, k AS (SELECT line_id, CAST(row_number() OVER (ORDER BY line_id) - 1 AS BIGINT) AS n FROM vertex GROUP BY line_id HAVING count(*) >= 2)
SELECT k.n AS line_id, v.vid, v.x, v.y, CAST(v.pin AS DOUBLE) AS z FROM vertex v JOIN k USING (line_id)""")
def s10(spark, sf_dir):
    path = scratch_path(spark, "map")
    lines = vertex(spark, sf_dir)
    fs.write_map(lines.select("line_id", "vid", F.col("x").cast("double"), F.col("y").cast("double"), F.col("pin").cast("double").alias("z")), path)
    return fs.read_map(spark, path).filter("kind = 'arc'").select("line_id", "vid", "x", "y", "z")


@query("s14_merge_maps", f"""{L} SELECT line_id % 2 AS half, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT line_id) AS BIGINT) AS n_lines FROM vertex GROUP BY 1""")
def s14(spark, sf_dir):
    lines = vertex(spark, sf_dir).select("line_id", "vid", "x", "y")
    both = fs.merge_maps(lines.filter("line_id % 2 = 0"), lines.filter("line_id % 2 = 1"))
    return both.groupBy("map_id").agg(
        F.first(F.col("line_id") % 2).alias("half"), F.count(F.lit(1)).alias("n"), F.count_distinct("line_id").alias("n_lines")
    ).drop("map_id")


def _gr3(spark, sf_dir):
    path = scratch_path(spark, "gr3")
    fs.write_gr3(node(spark, sf_dir), elem(spark, sf_dir), path)
    return fs.read_gr3(spark, path)


@query("s23_gr3_nodes", f"{M} SELECT node_id, x, y, dp FROM node")
def s23n(spark, sf_dir):
    return _gr3(spark, sf_dir)[0]


@query("s23_gr3_elements", f"{M} SELECT elem_id, i34, n1, n2, n3, CAST(n4 AS BIGINT) AS n4 FROM elem")
def s23e(spark, sf_dir):
    return _gr3(spark, sf_dir)[1]


@query("s23_2dm_elements", f"{M} SELECT elem_id, i34, n1, n2, n3, CAST(n4 AS BIGINT) AS n4 FROM elem")
def s23d(spark, sf_dir):
    path = scratch_path(spark, "2dm")
    e, n = elem(spark, sf_dir), node(spark, sf_dir)
    corners = F.concat_ws(" ", F.filter(F.array("n1", "n2", "n3", "n4"), lambda v: v >= 0))
    rows = e.select(F.concat_ws(" ", F.when(F.col("i34") == 4, "E4Q").otherwise("E3T"), F.col("elem_id").cast("string"), corners, F.lit("1")).alias("value"))
    spots = n.select(F.concat_ws(" ", F.lit("ND"), *[F.col(c).cast("string") for c in ("node_id", "x", "y", "dp")]).alias("value"))
    rows.unionByName(spots).write.text(path)
    return fs.read_2dm(spark, path)[1]


@query("s13_quad_polygons", """SELECT n_nationkey AS block, CAST(count(*) AS BIGINT) AS n_lines FROM nation CROSS JOIN (VALUES (0),(1),(2),(3)) t(k) WHERE n_nationkey % 2 = 0 GROUP BY 1""")
def s13(spark, sf_dir):
    path = scratch_path(spark, "quads")
    key = F.col("n_nationkey")
    inner = F.when(key % 2 == 0, F.lit("\nPATCH 2")).otherwise("")
    text = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select(F.concat(F.lit("POLYGON\nID "), key.cast("string"), inner, F.lit("\nEND")).alias("value"))
    text.coalesce(1).write.text(path)
    blocks = fs.read_quad_polygons(spark, path)
    ids = blocks.filter("value like 'ID %'").select("block", F.split("value", " ")[1].cast("int").alias("id"))
    return blocks.join(ids, "block").groupBy(F.col("id").alias("block")).agg(F.count(F.lit(1)).alias("n_lines"))
