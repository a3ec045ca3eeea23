"""Queries over spatial joins, tiles, arcs, meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import box, cell, elem, node, pt, read, ring, river_arc, vertex, with_tables
from ..operators import arcs as ar
from ..operators import mesh as me
from ..operators import sequence as se
from ..operators import spatial as sp
from ..operators import tiles as ti
from ..storage import cut
from .registry import query, r6

P = with_tables("pt")
PI = "3.141592653589793E0"
Q = "q AS (SELECT s_suppkey AS qid, CAST((s_suppkey * 7) % 97 AS DOUBLE) AS x, CAST((s_suppkey * 13) % 89 AS DOUBLE) AS y FROM supplier)"


def _q(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("qid"), (k * 7 % 97).cast("double").alias("x"), (k * 13 % 89).cast("double").alias("y"))


def _knn_sql(k: int) -> str:
    return f"""{P}, {Q}, d AS (SELECT q.qid, pt.pt_id AS pid, (pt.x - q.x) * (pt.x - q.x) + (pt.y - q.y) * (pt.y - q.y) AS d2 FROM q CROSS JOIN pt),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM d)
SELECT qid, CAST(rank AS INTEGER) AS rank, pid, round(d2, 6) + 0.0E0 AS d2 FROM r WHERE rank <= {k}"""


@query("j6_nearest", _knn_sql(1))
def j6(spark, sf_dir):
    return sp.nearest(_q(spark, sf_dir), pt(spark, sf_dir), 1, pid="pt_id").withColumn("d2", r6("d2"))


@query("j7_knn", _knn_sql(5))
def j7(spark, sf_dir):
    return sp.nearest(_q(spark, sf_dir), pt(spark, sf_dir), 5, pid="pt_id").withColumn("d2", r6("d2"))


@query("j7_duplicate_places", f"{with_tables('vertex')} SELECT line_id, vid, CASE WHEN count(*) OVER (PARTITION BY x) > 1 THEN 1 ELSE 0 END AS dup FROM vertex")
def j7d(spark, sf_dir):
    rows = vertex(spark, sf_dir).select("line_id", "vid", "x", F.lit(0.0).alias("y"), F.lit(0).alias("z"))
    return ar.pin_shared_vertices(rows).select("line_id", "vid", F.col("z").alias("dup"))


@query("j8_point_in_box", f"{with_tables('pt', 'box')} SELECT p.pt_id, b.tile_ord FROM pt p JOIN box b ON p.x > b.x0 AND p.x <= b.x1 AND p.y > b.y0 AND p.y <= b.y1")
def j8(spark, sf_dir):
    return sp.points_in_boxes(pt(spark, sf_dir), box(spark, sf_dir)).select("pt_id", "tile_ord")


@query("j8_tile_code", f"""{with_tables('pt', 'box')}, h AS (SELECT p.pt_id, b.tile_ord, row_number() OVER (PARTITION BY p.pt_id ORDER BY b.tile_ord) AS i FROM pt p
 JOIN box b ON p.x > b.x0 AND p.x <= b.x1 AND p.y > b.y0 AND p.y <= b.y1)
SELECT pt_id, CASE WHEN count(*) <= 4 THEN CAST(sum((tile_ord + 1) * pow(1000, i - 1)) FILTER (WHERE i <= 4) AS BIGINT) END AS code, array_to_string(list(tile_ord ORDER BY i), ',') AS tiles FROM h GROUP BY pt_id""")
def j8c(spark, sf_dir):
    return ti.box_codes(pt(spark, sf_dir), box(spark, sf_dir), 1000).select("pt_id", "code", F.array_join("tiles", ",").alias("tiles"))


@query("j9_box_overlap", f"{with_tables('box')} SELECT a.tile_ord AS left_id, b.tile_ord AS right_id FROM box a JOIN box b ON a.x0 - 1 <= b.x1 AND b.x0 <= a.x1 + 1 AND a.y0 - 1 <= b.y1 AND b.y0 <= a.y1 + 1")
def j9(spark, sf_dir):
    b = box(spark, sf_dir)
    return sp.overlapping_boxes(b, b, "tile_ord", "tile_ord", margin=1.0)


@query("j10_priority_lookup", f"""{with_tables('cell', 'pt')}, tl AS (SELECT s_suppkey AS tile_ord, s_suppkey % 5 * 15 AS x0, s_suppkey % 3 * 3 AS yr FROM supplier),
tc AS (SELECT t.tile_ord, c.iy - t.yr AS iy, c.ix - t.x0 AS ix, (c.z_tilt + t.tile_ord) * 1.0E0 AS z FROM tl t JOIN cell c ON c.ix BETWEEN t.x0 AND t.x0 + 29 AND c.iy BETWEEN t.yr AND t.yr + 9),
h AS (SELECT p.pt_id, t.tile_ord, CAST(round_even(p.x - t.x0, 0) AS BIGINT) AS ix, CAST(round_even(p.y / 8 - t.yr, 0) AS BIGINT) AS iy FROM pt p CROSS JOIN tl t),
b AS (SELECT h.pt_id, arg_min(tc.z, h.tile_ord) AS z FROM h JOIN tc USING (tile_ord, iy, ix) WHERE tc.z BETWEEN 20000 AND 300000 GROUP BY h.pt_id)
SELECT p.pt_id, b.z FROM pt p LEFT JOIN b USING (pt_id)""")
def j10(spark, sf_dir):
    k = F.col("s_suppkey")
    tl = read(spark, sf_dir, "supplier").select(
        k.alias("tile_ord"), (k % 5 * 15).alias("x0"), (-(k % 3 * 3)).alias("y0"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"), F.lit(30).alias("nx"), F.lit(10).alias("ny")
    )
    window = tl.withColumn("ix", F.explode(F.sequence("x0", F.col("x0") + 29))).withColumn("iy", F.explode(F.sequence(-F.col("y0"), -F.col("y0") + 9)))
    tc = window.hint("merge").join(cell(spark, sf_dir).select("iy", "ix", "z_tilt"), ["iy", "ix"]).select(
        "tile_ord", (F.col("iy") + F.col("y0")).alias("iy"), (F.col("ix") - F.col("x0")).alias("ix"), ((F.col("z_tilt") + F.col("tile_ord")) * 1.0).cast("double").alias("z")
    )
    points = pt(spark, sf_dir).select("pt_id", "x", (-F.col("y") / 8).alias("y"))
    return ti.elevations_by_priority(points, tl, tc, (20000, 300000)).select("pt_id", "z")


PIP = """sd AS (SELECT poly_id, vid, CAST(x AS DOUBLE) AS ax, CAST(y AS DOUBLE) AS ay, CAST(coalesce(lead(x) OVER w, first_value(x) OVER f) AS DOUBLE) AS bx, CAST(coalesce(lead(y) OVER w, first_value(y) OVER f) AS DOUBLE) AS b_y FROM ring
 WINDOW w AS (PARTITION BY poly_id ORDER BY vid), f AS (PARTITION BY poly_id ORDER BY vid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("j11_point_in_polygon", f"""{with_tables('pt', 'ring')}, {PIP} SELECT p.pt_id, s.poly_id FROM pt p JOIN sd s ON (s.ay > p.y) <> (s.b_y > p.y) AND p.x < (s.bx - s.ax) * (p.y - s.ay) / (s.b_y - s.ay) + s.ax
GROUP BY p.pt_id, s.poly_id HAVING count(*) % 2 = 1""")
def j11(spark, sf_dir):
    return sp.points_in_polygons(pt(spark, sf_dir), ring(spark, sf_dir)).select("pt_id", "poly_id")


def _poly_lines(spark, sf_dir):
    return vertex(spark, sf_dir).select("line_id", "vid", (F.col("x") / 10).alias("x"), (F.col("y") % 100).alias("y"))


VL = "vl AS (SELECT line_id, vid, x / 10 AS x, y % 100 AS y FROM vertex), vs AS (SELECT line_id, vid AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM vl WINDOW w AS (PARTITION BY line_id ORDER BY vid))"


def _spread_lines(spark, sf_dir):
    """Lines beside each other, each crossing only those near it."""
    return vertex(spark, sf_dir).select("line_id", "vid", "x", (F.col("y") + F.col("line_id") * 97).alias("y"))


XL = VL.replace("x / 10 AS x, y % 100 AS y", "x, y + line_id * 97 AS y")


def ccw(a, b, c):
    return f"(({c[1]} - {a[1]}) * ({b[0]} - {a[0]}) > ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def cross_sql(l, r):
    a, b, c, d = (f"{l}.ax", f"{l}.ay"), (f"{l}.bx", f"{l}.b_y"), (f"{r}.ax", f"{r}.ay"), (f"{r}.bx", f"{r}.b_y")
    return f"{ccw(a, c, d)} <> {ccw(b, c, d)} AND {ccw(a, b, c)} <> {ccw(a, b, d)}"


@query("j12_line_meets_polygon", f"""{with_tables('vertex', 'ring')}, {PIP}, {VL},
x1 AS (SELECT DISTINCT v.line_id, s.poly_id FROM vs v JOIN sd s ON v.bx IS NOT NULL AND {cross_sql('v', 's')}),
x2 AS (SELECT p.line_id, s.poly_id FROM vl p JOIN sd s ON (s.ay > p.y) <> (s.b_y > p.y) AND p.x < (s.bx - s.ax) * (p.y - s.ay) / (s.b_y - s.ay) + s.ax GROUP BY p.line_id, p.vid, s.poly_id HAVING count(*) % 2 = 1)
SELECT line_id, poly_id FROM x1 UNION SELECT line_id, poly_id FROM x2""")
def j12(spark, sf_dir):
    return sp.lines_meeting_polygons(_poly_lines(spark, sf_dir), ring(spark, sf_dir))


@query("j15_crossing_segments", f"""{with_tables('vertex')}, {XL} SELECT a.line_id AS l_line, a.seg AS l_seg, b.line_id AS r_line, b.seg AS r_seg FROM vs a JOIN vs b ON a.bx IS NOT NULL AND b.bx IS NOT NULL AND {cross_sql('a', 'b')}""")
def j15(spark, sf_dir):
    segs = cut(sp.segments(_spread_lines(spark, sf_dir)), "segs")
    return sp.crossing_segments(segs, segs).select("l_line", "l_seg", "r_line", "r_seg")


@query("j13_difference")
def j13(spark, sf_dir):
    return sp.cut_by_polygons(_poly_lines(spark, sf_dir), ring(spark, sf_dir), "outside")


@query("j14_clip")
def j14(spark, sf_dir):
    return sp.cut_by_polygons(_poly_lines(spark, sf_dir), ring(spark, sf_dir), "inside")


@query("j15_noding")
def j15n(spark, sf_dir):
    return sp.node_lines(_spread_lines(spark, sf_dir))


@query("s22_clip_to_tiles", f"""{with_tables('vertex', 'box')}, {VL}, p AS (SELECT v.*, b.*, v.bx - v.ax AS dx, v.b_y - v.ay AS dy FROM vs v JOIN box b ON v.bx IS NOT NULL
 AND least(v.ax, v.bx) <= b.x1 AND greatest(v.ax, v.bx) >= b.x0 AND least(v.ay, v.b_y) <= b.y1 AND greatest(v.ay, v.b_y) >= b.y0),
t AS (SELECT *, greatest(0, CASE WHEN dx <> 0 THEN least((x0 - ax) / dx, (x1 - ax) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((y0 - ay) / dy, (y1 - ay) / dy) ELSE 0 END) AS t0,
 least(1, CASE WHEN dx <> 0 THEN greatest((x0 - ax) / dx, (x1 - ax) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((y0 - ay) / dy, (y1 - ay) / dy) ELSE 1 END) AS t1 FROM p)
SELECT line_id, seg, tile_ord, round(ax + t0 * dx, 6) + 0.0E0 AS ax, round(ay + t0 * dy, 6) + 0.0E0 AS ay, round(ax + t1 * dx, 6) + 0.0E0 AS bx, round(ay + t1 * dy, 6) + 0.0E0 AS "by" FROM t WHERE t0 < t1""")
def s22(spark, sf_dir):
    return sp.clip_segments_to_boxes(sp.segments(_poly_lines(spark, sf_dir)), box(spark, sf_dir), digits=6)


@query("s20_rasterize", f"""{with_tables('ring')}, {PIP}, c AS (SELECT CAST(floor(i / 50) AS BIGINT) AS iy, i % 50 AS ix, (i % 50) * 2 + 0.3E0 AS x, floor(i / 50) * 2 + 0.7E0 AS y FROM range(2500) t(i)),
h AS (SELECT DISTINCT iy, ix FROM (SELECT p.iy, p.ix FROM c p JOIN sd s ON (s.ay > p.y) <> (s.b_y > p.y) AND p.x < (s.bx - s.ax) * (p.y - s.ay) / (s.b_y - s.ay) + s.ax GROUP BY p.iy, p.ix, s.poly_id HAVING count(*) % 2 = 1))
SELECT c.iy, c.ix, CASE WHEN h.iy IS NULL THEN 0 ELSE -1 END AS v FROM c LEFT JOIN h ON h.iy = c.iy AND h.ix = c.ix""")
def s20(spark, sf_dir):
    cells = spark.range(2500).select(
        F.floor(F.col("id") / 50).alias("iy"), (F.col("id") % 50).alias("ix"), (F.col("id") % 50 * 2 + F.lit(0.3)).alias("x"), (F.floor(F.col("id") / 50) * 2 + F.lit(0.7)).alias("y")
    )
    return ti.rasterize(ring(spark, sf_dir), cells)


SETS = "ts AS (SELECT c_custkey AS line_id, list_sort(list_distinct([c_custkey % 7, c_custkey % 11, (c_custkey * 3) % 5 + 20, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 ELSE c_custkey % 13 END])) AS s FROM customer)"


@query("a12_group_containment", f"""WITH {SETS}, g AS (SELECT s, min(line_id) AS g, len(s) AS n FROM ts GROUP BY s),
o AS (SELECT a.g, b.g AS p, row_number() OVER (PARTITION BY a.g ORDER BY b.n DESC, b.g) AS rn FROM g a JOIN g b ON b.n > a.n AND list_has_all(b.s, a.s))
SELECT ts.line_id, coalesce(o.p, g.g) AS group_id FROM ts JOIN g ON g.s = ts.s LEFT JOIN o ON o.g = g.g AND o.rn = 1""")
def a12(spark, sf_dir):
    k = F.col("c_custkey")
    sets = read(spark, sf_dir, "customer").select(
        k.alias("line_id"), F.array(k % 7, k % 11, k * 3 % 5 + 20, F.when(k % 3 == 0, k % 7).otherwise(k % 13)).alias("tiles")
    )
    return ti.group_by_containment(sets)


@query("m17_missing_tiles", f"{P}, a AS (SELECT DISTINCT floor(s_suppkey % 97 * 4) / 4 AS cx, ceil(s_suppkey % 89 * 4) / 4 AS cy FROM supplier), t AS (SELECT DISTINCT floor(floor(x) * 4) / 4 AS cx, ceil(floor(y) * 4) / 4 AS cy FROM pt) SELECT t.cx, t.cy FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.cx = t.cx AND a.cy = t.cy)")
def m17(spark, sf_dir):
    have = read(spark, sf_dir, "supplier").select((F.floor(F.col("s_suppkey") % 97 * 4) / 4).alias("cx"), (F.ceil(F.col("s_suppkey") % 89 * 4) / 4).alias("cy")).distinct()
    return ti.missing_tiles(pt(spark, sf_dir).withColumns({"x": F.floor("x"), "y": F.floor("y")}), have)


@query("h2_trim_overlaps", """WITH t AS (SELECT s_suppkey AS tile_id, s_suppkey % 10 * 90.0E0 AS x0, -floor(s_suppkey / 10) * 90.0E0 AS y0, s_suppkey % 10 * 90.0E0 + 100 AS x1, -floor(s_suppkey / 10) * 90.0E0 - 100 AS y1 FROM supplier),
n AS (SELECT a.tile_id, b.tile_id AS o, a.x0, a.y0, a.x1, a.y1, b.x0 AS p0, b.y0 AS q0, b.x1 AS p1, b.y1 AS q1, b.tile_id > a.tile_id AND b.y0 >= a.y0 AND b.y1 <= a.y1 AS tall, b.tile_id > a.tile_id AND b.x0 <= a.x0 AND b.x1 >= a.x1 AS wide
 FROM t a JOIN t b ON a.tile_id <> b.tile_id AND b.x0 <= a.x1 + 1.5E0 AND b.x1 >= a.x0 - 1.5E0 AND b.y1 <= a.y0 + 1.5E0 AND b.y0 >= a.y1 - 1.5E0),
f AS (SELECT tile_id, max(p1) FILTER (WHERE tall AND x0 BETWEEN p0 AND p1) AS l, min(p0) FILTER (WHERE tall AND x1 BETWEEN p0 AND p1) AS r,
 min(q1) FILTER (WHERE wide AND y0 BETWEEN q1 AND q0) AS u, max(q0) FILTER (WHERE wide AND y1 BETWEEN q1 AND q0) AS b, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS neighbours FROM n GROUP BY tile_id),
g AS (SELECT t.tile_id, CAST(coalesce(floor(t.y0 - u) + 1, 0) AS BIGINT) AS r0, CAST(coalesce(floor(l - t.x0) + 1, 0) AS BIGINT) AS c0, CAST(coalesce(ceil(t.y0 - b), 101) AS BIGINT) AS r1, CAST(coalesce(ceil(r - t.x0), 101) AS BIGINT) AS c1, neighbours FROM t LEFT JOIN f USING (tile_id))
SELECT tile_id, r0 AS skip_rows, c0 AS skip_cols, greatest(r1 - r0, 0) AS "rows", greatest(c1 - c0, 0) AS cols, coalesce(neighbours, '') AS neighbours FROM g""")
def h2(spark, sf_dir):
    k = F.col("s_suppkey")
    tiles = read(spark, sf_dir, "supplier").select(
        k.alias("tile_id"), (k % 10 * 90).cast("double").alias("x0"), (-(F.floor(k / 10) * 90)).cast("double").alias("y0"), F.lit(101).alias("nx"), F.lit(101).alias("ny"), F.lit(1.0).alias("dxy")
    )
    return ti.trim_overlaps(tiles).withColumn("neighbours", F.array_join("neighbours", ","))


ANG = f"""va AS (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS ao FROM vertex WINDOW w AS (PARTITION BY line_id ORDER BY vid)),
vb AS (SELECT *, lag(ao) OVER w AS ai FROM va WINDOW w AS (PARTITION BY line_id ORDER BY vid)),
vt AS (SELECT *, CASE WHEN ao - ai > {PI} THEN ao - ai - 2 * {PI} WHEN ao - ai < -{PI} THEN ao - ai + 2 * {PI} ELSE ao - ai END AS dt FROM vb),
vp AS (SELECT line_id, vid, x, y, coalesce(ai + dt / 2, ao, ai) - {PI} / 2 AS perp FROM vt)"""
V = with_tables("vertex")


@query("r1_transects", f"{V}, {ANG}, s AS (SELECT *, unnest(range(8)) AS step FROM vp) SELECT line_id, vid, CAST(step AS INTEGER) AS step, round(x + cos(perp) * step / 7 * 60, 5) + 0.0E0 AS x, round(y + sin(perp) * step / 7 * 60, 5) + 0.0E0 AS y FROM s")
def r1(spark, sf_dir):
    t = ar.transects(vertex(spark, sf_dir), 8, 60.0)
    return t.select("line_id", "vid", "step", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


BK = "sm AS (SELECT line_id, vid, step, ((vid * 31 + step * 17 + line_id) % 23) - 14 + step AS z FROM (SELECT line_id, vid, CAST(unnest(range(12)) AS INTEGER) AS step FROM vertex)), dd AS (SELECT *, z - (vid % 3) AS d FROM sm)"


@query("r2_bank_steps", f"""{V}, {BK}, g AS (SELECT line_id, vid, min(step) FILTER (WHERE d >= 0) AS f, arg_min(step, struct_pack(a := abs(d), s := step)) AS c, max(step) AS l FROM dd GROUP BY ALL)
SELECT line_id, vid, CASE WHEN f IS NULL THEN l WHEN f = 0 THEN c ELSE f END AS step FROM g""")
def r2(spark, sf_dir):
    s = vertex(spark, sf_dir).select("line_id", "vid", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step")).withColumn(
        "z", (F.col("vid") * 31 + F.col("step") * 17 + F.col("line_id")) % 23 - 14 + F.col("step")
    )
    level = vertex(spark, sf_dir).select("line_id", "vid", (F.col("vid") % 3).alias("eta"))
    return ar.bank_steps(s, level)


@query("r3_two_banks", f"""{V}, {ANG}, bk AS (SELECT *, x + cos(perp + {PI}) * (vid % 11) AS xl, y + sin(perp + {PI}) * (vid % 11) AS yl, x + cos(perp) * (vid % 5) AS xr, y + sin(perp) * (vid % 5) AS yr FROM vp),
st AS (SELECT *, sqrt((xl - xr) * (xl - xr) + (yl - yr) * (yl - yr)) < 5.5 AS nw FROM bk), sh AS (SELECT *, avg(nw::INT) OVER (PARTITION BY line_id) AS f FROM st),
fx AS (SELECT line_id, vid, f, CASE WHEN nw THEN x + cos(perp) * 2.75 ELSE xr END AS xr, CASE WHEN nw THEN y + sin(perp) * 2.75 ELSE yr END AS yr, CASE WHEN nw THEN x + cos(perp + {PI}) * 2.75 ELSE xl END AS xl, CASE WHEN nw THEN y + sin(perp + {PI}) * 2.75 ELSE yl END AS yl FROM sh)
SELECT line_id, vid, CASE WHEN f > 0.3 THEN -1 ELSE 0 END AS status, round(sqrt((xl - xr) * (xl - xr) + (yl - yr) * (yl - yr)), 5) + 0.0E0 AS width FROM fx""")
def r3(spark, sf_dir):
    lines = se.normals(vertex(spark, sf_dir))
    side = lambda turn, m: lines.select("line_id", "vid", (F.col("x") + F.cos(F.col("perp") + turn) * (F.col("vid") % m)).alias("x"), (F.col("y") + F.sin(F.col("perp") + turn) * (F.col("vid") % m)).alias("y"))
    out = ar.two_banks(lines, side(se.PI, 11), side(0.0, 5), 5.5)
    return out.select("line_id", "vid", "status", (F.round("width", 5) + 0.0).alias("width"))


@query("r5_lowest_step", f"""{V}, {BK}, r AS (SELECT *, row_number() OVER (PARTITION BY line_id, vid ORDER BY z, step) AS rn FROM sm) SELECT line_id, vid, CAST(floor(quantile_cont(step, 0.5)) AS INTEGER) AS step FROM r WHERE rn <= 10 GROUP BY line_id, vid""")
def r5(spark, sf_dir):
    s = vertex(spark, sf_dir).select("line_id", "vid", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step")).withColumn(
        "z", (F.col("vid") * 31 + F.col("step") * 17 + F.col("line_id")) % 23 - 14 + F.col("step")
    )
    return ar.lowest_steps(s)


@query("p22_artificial_banks", f"{V}, {ANG} SELECT line_id, vid, round(x + cos(perp) * 9, 5) + 0.0E0 AS xr, round(y + sin(perp) * 9, 5) + 0.0E0 AS yr, round(x + cos(perp + {PI}) * 9, 5) + 0.0E0 AS xl, round(y + sin(perp + {PI}) * 9, 5) + 0.0E0 AS yl FROM vp")
def p22(spark, sf_dir):
    b = ar.artificial_banks(vertex(spark, sf_dir), 18.0)
    return b.select("line_id", "vid", *[(F.round(c, 5) + 0.0).alias(c) for c in ("xr", "yr", "xl", "yl")])


@query("p23_nudge_bank", f"""{V}, {ANG}, b AS (SELECT *, x + cos(perp) * (vid % 50 + 0.5) AS bx, y + sin(perp) * (vid % 50 + 0.5) AS bb, vid % 50 + 0.5E0 AS d FROM vp)
SELECT line_id, vid, round(x + cos(perp) * CASE WHEN d < 10 THEN 10 WHEN d > 30 THEN 30 ELSE d END, 4) + 0.0E0 AS bx FROM b""")
def p23(spark, sf_dir):
    rows = se.normals(vertex(spark, sf_dir)).withColumns(
        {"bx": F.col("x") + F.cos("perp") * (F.col("vid") % 50 + 0.5), "by": F.col("y") + F.sin("perp") * (F.col("vid") % 50 + 0.5)}
    )
    return ar.nudge_bank(rows, "bx", "by", 10.0, 30.0).select("line_id", "vid", (F.round("bx", 4) + 0.0).alias("bx"))


def _turns(x: str, y: str, more: str = "") -> str:
    """Rows of the working table ``f`` with their turn and place, in order of ``vid``."""
    return f"""SELECT *, atan2(y1 - {y}, x1 - {x}) AS ao, atan2({y} - y0, {x} - x0) AS ai FROM (SELECT *, lag({x}) OVER w AS x0, lag({y}) OVER w AS y0, lead({x}) OVER w AS x1, lead({y}) OVER w AS y1{more}
 FROM f WHERE NOT done WINDOW w AS (PARTITION BY line_id ORDER BY vid))"""


SHARP = f"coalesce(abs(CASE WHEN ao - ai > {PI} THEN ao - ai - 2 * {PI} WHEN ao - ai < -{PI} THEN ao - ai + 2 * {PI} ELSE ao - ai END) > {PI} / 2.4E0, false)"


@query("r6_drop_sharp_turns", f"""{with_tables('vertex', recursive=True)}, f AS (SELECT 0 AS rnd, false AS done, line_id, vid, x, y, pin FROM vertex
 UNION ALL SELECT rnd + 1, NOT bool_or(gone) OVER (PARTITION BY line_id), line_id, vid, x, y, pin FROM (SELECT *, {SHARP} AND pin = 0 AS gone FROM ({_turns('x', 'y')})) QUALIFY NOT gone)
SELECT line_id, vid, x, y, pin FROM f WHERE done""")
def r6_(spark, sf_dir):
    return ar.drop_sharp_turns(vertex(spark, sf_dir), pin="pin")


def _crosses(a, b, c, d):
    return f"({ccw(a, c, d)} <> {ccw(b, c, d)} AND {ccw(a, b, c)} <> {ccw(a, b, d)})"


def _mid(c: str, before: str, after: str) -> str:
    return f"CASE part WHEN 0 THEN {c} WHEN 1 THEN ({c} + {before}) / 2 ELSE ({c} + {after}) / 2 END"


_NEAR = ", lag(x) OVER w AS tx0, lag(y) OVER w AS ty0, lead(x) OVER w AS tx1, lead(y) OVER w AS ty1"
_OVER = [_crosses(("bx", "b_y"), ("gx", "gy"), ("x", "y"), d) for d in (("tx0", "ty0"), ("tx1", "ty1"))]


@query("r7_smooth_bank", f"""{with_tables('vertex', recursive=True)}, {ANG}, f AS (SELECT 0 AS rnd, false AS done, line_id, vid, x, y, x + cos(perp) * 9 AS bx, y + sin(perp) * 9 AS b_y FROM vp
 UNION ALL SELECT rnd + 1, fin, line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY vid, part) - 1 AS BIGINT), {_mid('x', 'tx0', 'tx1')}, {_mid('y', 'ty0', 'ty1')}, {_mid('ex', 'ex0', 'ex1')}, {_mid('ey', 'ey0', 'ey1')}
 FROM (SELECT *, unnest(CASE WHEN bad THEN [1, 2] ELSE [0] END) AS part FROM (
 SELECT *, lag(ex) OVER v AS ex0, lag(ey) OVER v AS ey0, lead(ex) OVER v AS ex1, lead(ey) OVER v AS ey1, NOT bool_or(sharp) OVER (PARTITION BY line_id) AS fin FROM (
 SELECT *, CASE WHEN sharp AND NOT bad THEN gx ELSE bx END AS ex, CASE WHEN sharp AND NOT bad THEN gy ELSE b_y END AS ey FROM (
 SELECT *, coalesce(sharp AND ({_OVER[0]} OR {_OVER[1]}), false) AS bad FROM (
 SELECT *, {SHARP} AS sharp, (x0 + x1) / 2 * 0.2E0 + bx * 0.8E0 AS gx, (y0 + y1) / 2 * 0.2E0 + b_y * 0.8E0 AS gy FROM ({_turns('bx', 'b_y', _NEAR)})))) WINDOW v AS (PARTITION BY line_id ORDER BY vid))) WHERE rnd < 100)
SELECT line_id, vid, round(x, 6) + 0.0E0 AS x, round(y, 6) + 0.0E0 AS y, round(bx, 6) + 0.0E0 AS bx, round(b_y, 6) + 0.0E0 AS "by" FROM f WHERE done OR rnd = 100""")
def r7(spark, sf_dir):
    rows = ar.artificial_banks(vertex(spark, sf_dir), 18.0).select("line_id", "vid", "x", "y", F.col("xr").alias("bx"), F.col("yr").alias("by"))
    return ar.smooth_bank(rows).select("line_id", "vid", *[r6(c).alias(c) for c in ("x", "y", "bx", "by")])


@query("r8_assemble_arcs", f"""{V}, b AS (SELECT line_id, vid, x AS xl, y AS yl, x + 3 AS xr, y - 20 AS yr FROM vertex), p AS (SELECT i AS arc_pos, [-0.2, -0.1, 0, 0.5, 1, 1.1, 1.2][i + 1]::DOUBLE AS f FROM range(7) t(i))
SELECT line_id, CAST(arc_pos AS INTEGER) AS arc_pos, vid, round(xl * (1 - f) + xr * f, 6) + 0.0E0 AS x, round(yl * (1 - f) + yr * f, 6) + 0.0E0 AS y FROM b CROSS JOIN p""")
def r8(spark, sf_dir):
    from ..functions.exprs import inner_arc_positions

    b = vertex(spark, sf_dir).select("line_id", "vid", F.col("x").alias("xl"), F.col("y").alias("yl"), (F.col("x") + 3).alias("xr"), (F.col("y") - 20).alias("yr"))
    out = ar.assemble_arcs(b, ar.arc_positions(inner_arc_positions(F.lit(3)), (0.1, 0.2)))
    return out.select("line_id", "arc_pos", "vid", r6("x").alias("x"), r6("y").alias("y"))


A = with_tables("arc")


@query("r10_centreline", f"{A} SELECT river_id, vid, round(avg(x), 6) + 0.0E0 AS x, round(avg(y), 6) + 0.0E0 AS y FROM arc GROUP BY river_id, vid")
def r10(spark, sf_dir):
    return ar.centrelines(river_arc(spark, sf_dir)).select("river_id", "vid", r6("x").alias("x"), r6("y").alias("y"))


@query("r10_middle_arc", f"{A}, n AS (SELECT *, max(arc_pos) OVER (PARTITION BY river_id) + 1 AS n FROM arc) SELECT river_id, vid, round(avg(x), 6) + 0.0E0 AS x, round(avg(y), 6) + 0.0E0 AS y FROM n WHERE arc_pos = floor((n - 1) / 2) OR arc_pos = floor(n / 2) GROUP BY river_id, vid")
def r10m(spark, sf_dir):
    return ar.middle_arcs(river_arc(spark, sf_dir)).select("river_id", "vid", r6("x").alias("x"), r6("y").alias("y"))


@query("r10_cross_channel", f"{A} SELECT river_id, arc_pos, vid FROM (SELECT *, min(vid) OVER (PARTITION BY river_id) AS a, max(vid) OVER (PARTITION BY river_id) AS b FROM arc) q WHERE vid = a OR vid = b")
def r10c(spark, sf_dir):
    return ar.cross_channel_arcs(river_arc(spark, sf_dir)).select("river_id", "arc_pos", "vid")


@query("r25_outline", f"""{A}, m AS (SELECT *, max(arc_pos) OVER (PARTITION BY river_id) AS mp, max(vid) OVER (PARTITION BY river_id) AS mv FROM arc)
SELECT river_id, vid AS pos, x, y FROM m WHERE arc_pos = 0 UNION ALL SELECT river_id, 2 * mv + 1 - vid, x, y FROM m WHERE arc_pos = mp UNION ALL SELECT river_id, 2 * mv + 2, x, y FROM m WHERE arc_pos = 0 AND vid = 0""")
def r25(spark, sf_dir):
    return ar.outline_rings(river_arc(spark, sf_dir))


@query("a14_river_quality", f"""{A}, a1 AS (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS ao FROM arc WINDOW w AS (PARTITION BY river_id, arc_pos ORDER BY vid)),
a2 AS (SELECT *, lag(ao) OVER w AS ai FROM a1 WINDOW w AS (PARTITION BY river_id, arc_pos ORDER BY vid)),
a3 AS (SELECT *, coalesce(CASE WHEN ao - ai > {PI} THEN ao - ai - 2 * {PI} WHEN ao - ai < -{PI} THEN ao - ai + 2 * {PI} ELSE ao - ai END, 0) AS t FROM a2),
a4 AS (SELECT river_id, arc_pos, avg(abs(t)) AS m, count(*) AS n FROM a3 GROUP BY ALL) SELECT river_id, bool_and(m <= 1.8 AND n >= 2) AS ok FROM a4 GROUP BY river_id""")
def a14(spark, sf_dir):
    return ar.line_quality(river_arc(spark, sf_dir))


@query("m1_transect_order", f"{A} SELECT river_id, vid, CAST(row_number() OVER (PARTITION BY river_id, vid ORDER BY arc_pos) - 1 AS BIGINT) AS pos, x, y FROM arc")
def m1(spark, sf_dir):
    return ar.transect_order(river_arc(spark, sf_dir))


@query("m4_dredge", f"""{A}, d AS (SELECT *, 1.0E0 + (vid * 7 + arc_pos * 3) % 11 AS dp, max(arc_pos) OVER (PARTITION BY river_id) AS m FROM arc),
g AS (SELECT river_id, vid, min(dp) FILTER (WHERE arc_pos = 0 OR arc_pos = m) + 2 AS goal FROM d GROUP BY ALL)
SELECT d.river_id, d.arc_pos, d.vid, CASE WHEN d.arc_pos = 0 OR d.arc_pos = d.m THEN d.dp ELSE greatest(d.dp, g.goal) END AS dp2 FROM d JOIN g ON g.river_id = d.river_id AND g.vid = d.vid""")
def m4(spark, sf_dir):
    arcs = river_arc(spark, sf_dir).withColumn("dp", F.lit(1.0) + (F.col("vid") * 7 + F.col("arc_pos") * 3) % 11)
    return ar.dredge(arcs, 2.0).select("river_id", "arc_pos", "vid", "dp2")


@query("w13_inlet_outlet", f"""{V}, i AS (SELECT line_id, vid, y > 100 AS s, lead(y > 100) OVER (PARTITION BY line_id ORDER BY vid) AS n FROM vertex)
SELECT line_id, coalesce(min(vid) FILTER (WHERE s), -1) AS inlet, coalesce(min(vid) FILTER (WHERE s AND NOT n), -1) AS outlet FROM i GROUP BY line_id""")
def w13(spark, sf_dir):
    return ar.crossing_places(vertex(spark, sf_dir).withColumn("inside", F.col("y") > 100))


@query("m16_feeder_extensions", f"""{with_tables('pt', 'ring')}, {PIP}, e AS (SELECT pt_id AS feeder_id, ord, off, k, x + (len - off) * 0.8E0 * cos(pt_id) AS x, y + (len - off) * 0.8E0 * sin(pt_id) AS y
 FROM pt CROSS JOIN (VALUES (0, 2), (1, 1), (2, 0)) o(ord, off) CROSS JOIN (VALUES (0, -10.0E0), (1, -5.0E0), (2, 0.0E0)) l(k, len)),
i AS (SELECT e.feeder_id, e.ord FROM e JOIN sd s ON (s.ay > e.y) <> (s.b_y > e.y) AND e.x < (s.bx - s.ax) * (e.y - s.ay) / (s.b_y - s.ay) + s.ax GROUP BY e.feeder_id, e.ord, e.k, s.poly_id HAVING count(*) % 2 = 1),
g AS (SELECT feeder_id, min(ord) AS ord FROM (SELECT DISTINCT feeder_id, ord FROM e EXCEPT SELECT feeder_id, ord FROM i) GROUP BY feeder_id)
SELECT feeder_id, off, k, round(x, 6) + 0.0E0 AS x, round(y, 6) + 0.0E0 AS y FROM e JOIN g USING (feeder_id, ord)""")
def m16(spark, sf_dir):
    heads = pt(spark, sf_dir).select(
        F.col("pt_id").alias("feeder_id"), "x", "y", F.cos(F.col("pt_id").cast("double")).alias("nx"), F.sin(F.col("pt_id").cast("double")).alias("ny"), F.lit(0.8).alias("width")
    )
    out = ar.feeder_extensions(heads, lambda p: sp.points_in_polygons(p, ring(spark, sf_dir)))
    return out.select("feeder_id", "off", "k", r6("x").alias("x"), r6("y").alias("y"))


M = with_tables("node", "elem")
EN = "en AS (SELECT elem_id, pos, node_id FROM (SELECT elem_id, unnest([0, 1, 2, 3]) AS pos, unnest([n1, n2, n3, n4]) AS node_id FROM elem) u WHERE node_id >= 0)"
SHAPE = f"""{EN}, ex AS (SELECT e.elem_id, e.pos, n.x, n.y, count(*) OVER (PARTITION BY e.elem_id) AS k FROM en e JOIN node n ON n.node_id = e.node_id),
ey AS (SELECT a.*, b.x AS bx, b.y AS b_y FROM ex a JOIN ex b ON b.elem_id = a.elem_id AND b.pos = (a.pos + 1) % a.k),
es AS (SELECT elem_id, CAST(any_value(k) AS INTEGER) AS i34, sum(x * b_y - bx * y) / 2 AS area, max(sqrt((bx - x) * (bx - x) + (b_y - y) * (b_y - y))) AS side, avg(x) AS cx, avg(y) AS cy FROM ey GROUP BY elem_id),
sh AS (SELECT elem_id, i34, area, side / sqrt(greatest(area / {PI}, 1e-20)) AS skew, cx, cy FROM es)"""


@query("p16_elem_area", f"{M}, {SHAPE} SELECT elem_id, i34, round(area, 6) + 0.0E0 AS area FROM sh")
def p16(spark, sf_dir):
    return me.element_shapes(elem(spark, sf_dir), node(spark, sf_dir)).select("elem_id", "i34", r6("area").alias("area"))


@query("p17_skewness", f"{M}, {SHAPE} SELECT elem_id, round(skew, 5) + 0.0E0 AS skew FROM sh")
def p17(spark, sf_dir):
    return me.element_shapes(elem(spark, sf_dir), node(spark, sf_dir)).select("elem_id", (F.round("skew", 5) + 0.0).alias("skew"))


@query("m15_centroids", f"{M}, {SHAPE} SELECT elem_id, round(cx, 6) + 0.0E0 AS cx, round(cy, 6) + 0.0E0 AS cy FROM sh WHERE skew >= 3.9")
def m15(spark, sf_dir):
    return me.element_shapes(elem(spark, sf_dir), node(spark, sf_dir)).filter("skew >= 3.9").select("elem_id", r6("cx").alias("cx"), r6("cy").alias("cy"))


@query("m10_quality_counts", f"{M}, {SHAPE} SELECT CASE WHEN area <= 0 THEN 'inverted' WHEN area < 0.3 THEN 'small' ELSE 'skewed' END AS why, CAST(count(*) AS BIGINT) AS n FROM sh WHERE area <= 0 OR area < 0.3 OR skew >= 3.9 GROUP BY ALL")
def m10(spark, sf_dir):
    shapes = me.element_shapes(elem(spark, sf_dir), node(spark, sf_dir))
    return me.quality_report(shapes, 0.3, 3.9).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query("m7_node_ring", f"{with_tables('elem')}, {EN} SELECT DISTINCT a.node_id, b.node_id AS other FROM en a JOIN en b ON a.elem_id = b.elem_id")
def m7(spark, sf_dir):
    return me.node_rings(elem(spark, sf_dir))


def _skewed_nodes(spark, sf_dir):
    e = elem(spark, sf_dir)
    bad = me.element_shapes(e, node(spark, sf_dir)).filter("skew >= 3.9").select("elem_id")
    return me.element_nodes(e).join(bad, "elem_id", "left_semi").select("node_id")


@query("m7_two_rings", f"{M}, {SHAPE}, bad AS (SELECT DISTINCT e.node_id FROM en e JOIN sh ON sh.elem_id = e.elem_id WHERE sh.skew >= 3.9), r AS (SELECT DISTINCT a.node_id, b.node_id AS other FROM en a JOIN en b ON a.elem_id = b.elem_id) SELECT DISTINCT a.node_id, b.other FROM r a JOIN r b ON b.node_id = a.other WHERE a.node_id IN (SELECT node_id FROM bad)")
def m7b(spark, sf_dir):
    e = elem(spark, sf_dir)
    return me.node_rings(e, _skewed_nodes(spark, sf_dir), 2)


@query("m8_grow_nodes", f"{M}, {SHAPE}, bad AS (SELECT DISTINCT e.node_id FROM en e JOIN sh ON sh.elem_id = e.elem_id WHERE sh.skew >= 3.9), r AS (SELECT DISTINCT a.node_id, b.node_id AS other FROM en a JOIN en b ON a.elem_id = b.elem_id) SELECT DISTINCT b.other AS node_id FROM r a JOIN r b ON b.node_id = a.other WHERE a.node_id IN (SELECT node_id FROM bad)")
def m8(spark, sf_dir):
    return me.grow_nodes(elem(spark, sf_dir), _skewed_nodes(spark, sf_dir), 2)


@query("m9_boundary_nodes", f"""{with_tables('elem')}, {EN}, k AS (SELECT *, count(*) OVER (PARTITION BY elem_id) AS k FROM en), s AS (SELECT least(a.node_id, b.node_id) AS p, greatest(a.node_id, b.node_id) AS q FROM k a JOIN k b ON b.elem_id = a.elem_id AND b.pos = (a.pos + 1) % a.k),
l AS (SELECT p, q FROM s GROUP BY p, q HAVING count(*) = 1) SELECT p AS node_id FROM l UNION SELECT q FROM l""")
def m9(spark, sf_dir):
    return me.boundary_nodes(elem(spark, sf_dir))


@query("a16_coincident_nodes", f"{with_tables('node')} SELECT node_id, CAST(n AS BIGINT) AS n FROM (SELECT node_id, count(*) OVER (PARTITION BY floor(x / 3), floor(y / 3)) AS n FROM node) q WHERE n > 1")
def a16(spark, sf_dir):
    rounded = node(spark, sf_dir).withColumns({"x": F.floor(F.col("x") / 3), "y": F.floor(F.col("y") / 3)})
    return me.coincident_nodes(rounded).select("node_id", "n")


@query("m6_raise_depth", f"""{with_tables('node', 'pt')}, c AS (SELECT pt_id, x, y / 8 AS y, pt_id % 100 * 5000.0E0 AS dp FROM pt),
d AS (SELECT c.pt_id, c.dp, n.node_id, row_number() OVER (PARTITION BY c.pt_id ORDER BY (n.x - c.x) * (n.x - c.x) + (n.y - c.y) * (n.y - c.y), n.node_id) AS rn FROM c CROSS JOIN node n),
g AS (SELECT node_id, max(dp) AS m FROM d WHERE rn = 1 GROUP BY node_id) SELECT node.node_id, greatest(node.dp, coalesce(g.m, node.dp)) AS dp2 FROM node LEFT JOIN g ON g.node_id = node.node_id""")
def m6(spark, sf_dir):
    c = pt(spark, sf_dir).select(F.col("pt_id").alias("pid"), "x", (F.col("y") / 8).alias("y"), (F.col("pt_id") % 100 * 5000.0).alias("dp"))
    return me.raise_node_depth(node(spark, sf_dir), c).select("node_id", "dp2")


@query("m12_relax")
def m12(spark, sf_dir):
    e, n = elem(spark, sf_dir), node(spark, sf_dir)
    free = me.element_nodes(e).select("node_id").distinct().join(me.boundary_nodes(e), "node_id", "left_anti")
    return me.relax_nodes(n, e, free).select("node_id", r6("x").alias("x"), r6("y").alias("y"))


@query("m14_improve_mesh")
def m14(spark, sf_dir):
    nodes, elems = me.improve_mesh(node(spark, sf_dir), elem(spark, sf_dir), 0.3, 3.9)
    return me.quality_report(me.element_shapes(elems, nodes), 0.3, 3.9).select("elem_id", "why")
