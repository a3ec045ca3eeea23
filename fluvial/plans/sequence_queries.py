"""Queries along polylines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..adapters import ring, river_arc, vertex, with_tables
from ..operators import sequence as se
from .registry import query, r6

T = with_tables("vertex")
R = with_tables("vertex", recursive=True)
WIN = "WINDOW w AS (PARTITION BY line_id ORDER BY vid)"
PI = "3.141592653589793E0"
ANG = f"""a AS (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS ao FROM vertex {WIN}),
b AS (SELECT *, lag(ao) OVER w AS ai FROM a {WIN}),
t AS (SELECT *, CASE WHEN ao - ai > {PI} THEN ao - ai - 2 * {PI} WHEN ao - ai < -{PI} THEN ao - ai + 2 * {PI} ELSE ao - ai END AS dt FROM b)"""


def grad(c: str, w: str = "w") -> str:
    return f"coalesce((lead({c}) OVER {w} - lag({c}) OVER {w}) / 2, lead({c}) OVER {w} - {c}, {c} - lag({c}) OVER {w})"


CURV = f"""g1 AS (SELECT *, {grad('x')} AS dx, {grad('y')} AS dy, count(*) OVER (PARTITION BY line_id) AS n FROM vertex {WIN}),
g2 AS (SELECT *, {grad('dx')} AS d2x, {grad('dy')} AS d2y FROM g1 {WIN}),
cv AS (SELECT line_id, vid, x, y, pin, CASE WHEN n < 3 THEN 0 ELSE abs(dx * d2y - d2x * dy) / (pow(dx * dx + dy * dy, 1.5E0) + 1e-20) END AS curv FROM g2)"""
CURV2 = f"""h0 AS (SELECT *, vid % 2 AS s FROM vertex),
h1 AS (SELECT *, {grad('x')} AS dx, {grad('y')} AS dy, count(*) OVER (PARTITION BY line_id, s) AS n FROM h0 WINDOW w AS (PARTITION BY line_id, s ORDER BY vid)),
h2 AS (SELECT *, {grad('dx')} AS d2x, {grad('dy')} AS d2y FROM h1 WINDOW w AS (PARTITION BY line_id, s ORDER BY vid)),
cv2 AS (SELECT line_id, vid, CASE WHEN n < 3 THEN 0 ELSE abs(dx * d2y - d2x * dy) / (pow(dx * dx + dy * dy, 1.5E0) + 1e-20) END AS curv2 FROM h2)"""
LEN = f"""l0 AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d FROM vertex {WIN}),
ln AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY vid) AS s_from, sum(d) OVER (PARTITION BY line_id) AS total, count(*) OVER (PARTITION BY line_id) AS n, row_number() OVER (PARTITION BY line_id ORDER BY vid) - 1 AS p FROM l0)"""


@query("w1_dist_increment", f"{T} SELECT line_id, vid, round(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 6) + 0.0E0 AS d FROM vertex {WIN}")
def w1(spark, sf_dir):
    return se.distance_increments(vertex(spark, sf_dir)).select("line_id", "vid", r6("d").alias("d"))


@query("w2_turn_angle", f"{T}, {ANG} SELECT line_id, vid, round(coalesce(dt, 0), 6) + 0.0E0 AS turn FROM t")
def w2(spark, sf_dir):
    return se.turn_angles(vertex(spark, sf_dir)).select("line_id", "vid", r6("turn").alias("turn"))


@query("w3_curvature", f"{T}, {CURV} SELECT line_id, vid, round(curv, 6) + 0.0E0 AS curv FROM cv")
def w3(spark, sf_dir):
    return se.curvature(vertex(spark, sf_dir)).select("line_id", "vid", r6("curv").alias("curv"))


@query("w3_curvature_stride2", f"{T}, {CURV2} SELECT line_id, vid, round(curv2, 6) + 0.0E0 AS curv FROM cv2")
def w3s(spark, sf_dir):
    return se.curvature(vertex(spark, sf_dir), stride=2).select("line_id", "vid", r6("curv").alias("curv"))


@query("w4_normal", f"{T}, {ANG} SELECT line_id, vid, round(coalesce(ai + dt / 2, ao, ai) - {PI} / 2, 6) + 0.0E0 AS perp FROM t")
def w4(spark, sf_dir):
    return se.normals(vertex(spark, sf_dir)).select("line_id", "vid", r6("perp").alias("perp"))


def ma_sql(n: int, weight: float) -> str:
    m, back = n // 2, (n // 2 if n % 2 else n // 2 - 1)
    return f"""{T}, a AS (SELECT *, avg(y) OVER (PARTITION BY line_id ORDER BY vid ROWS BETWEEN {back} PRECEDING AND {m} FOLLOWING) AS av,
 row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY line_id) AS n, first_value(y) OVER (PARTITION BY line_id ORDER BY vid) AS ya, first_value(y) OVER (PARTITION BY line_id ORDER BY vid DESC) AS yb FROM vertex {WIN}),
e AS (SELECT line_id, max(av) FILTER (WHERE p = {m}) AS h, max(av) FILTER (WHERE p = n - {m} - 1) AS t FROM a GROUP BY line_id)
SELECT a.line_id, a.vid, round(CASE WHEN n <= {n} THEN ya + (yb - ya) * CASE WHEN n > 1 THEN p / (n - 1) ELSE 0 END
 ELSE (CASE WHEN p < {m} THEN h WHEN p >= n - {m} THEN t ELSE av END + {weight}E0 * y) / (1 + {weight}E0) END, 9) + 0.0E0 AS y FROM a JOIN e ON a.line_id = e.line_id"""


@query("w5_moving_average_even", ma_sql(10, 0))
def w5(spark, sf_dir):
    return se.moving_average(vertex(spark, sf_dir), "y", 10).select("line_id", "vid", (F.round("y", 9) + 0.0).alias("y"))


@query("w5_moving_average_odd", ma_sql(7, 2))
def w5o(spark, sf_dir):
    return se.moving_average(vertex(spark, sf_dir), "y", 7, 2.0).select("line_id", "vid", (F.round("y", 9) + 0.0).alias("y"))


@query("w5_moving_average_short", ma_sql(70, 0))
def w5s(spark, sf_dir):
    return se.moving_average(vertex(spark, sf_dir), "y", 70).select("line_id", "vid", (F.round("y", 9) + 0.0).alias("y"))


@query("w6_cumulative_length", f"{T}, {LEN} SELECT line_id, vid, round(s_from, 6) + 0.0E0 AS s_from, round(total - s_from, 6) + 0.0E0 AS s_to FROM ln")
def w6(spark, sf_dir):
    return se.cumulative_lengths(vertex(spark, sf_dir)).select("line_id", "vid", r6("s_from").alias("s_from"), r6("s_to").alias("s_to"))


@query("w7_fill_missing", f"""{T}, g AS (SELECT line_id, vid, y FROM vertex WHERE pin = 0),
n AS (SELECT v.line_id, v.vid, v.y, (SELECT max(vid) FROM g WHERE g.line_id = v.line_id AND g.vid <= v.vid) AS a, (SELECT min(vid) FROM g WHERE g.line_id = v.line_id AND g.vid >= v.vid) AS b FROM vertex v)
SELECT n.line_id, n.vid, round(CASE WHEN ga.vid IS NULL AND gb.vid IS NULL THEN n.y WHEN ga.vid IS NULL THEN gb.y WHEN gb.vid IS NULL OR ga.vid = gb.vid THEN ga.y
 ELSE ga.y + (gb.y - ga.y) * (n.vid - ga.vid) / (gb.vid - ga.vid) END, 6) + 0.0E0 AS y
FROM n LEFT JOIN g ga ON ga.line_id = n.line_id AND ga.vid = n.a LEFT JOIN g gb ON gb.line_id = n.line_id AND gb.vid = n.b""")
def w7(spark, sf_dir):
    return se.fill_missing(vertex(spark, sf_dir), "y", F.col("pin") == 1, "f").select("line_id", "vid", r6("f").alias("y"))


@query("w8_resolution", f"""{T}, {CURV}, {CURV2}, {LEN},
r0 AS (SELECT cv.line_id, cv.vid, least(greatest(5E0, least(0.4E0 / (greatest(curv, curv2) + 1e-10), 6E0 * (20 + cv.vid % 9) / 2)), 300E0) AS r, s_from, total - s_from AS s_to,
 avg(20 + cv.vid % 9) OVER (PARTITION BY cv.line_id) AS w FROM cv JOIN cv2 ON cv.line_id = cv2.line_id AND cv.vid = cv2.vid JOIN ln ON ln.line_id = cv.line_id AND ln.vid = cv.vid)
SELECT line_id, vid, round(r / pow(1.3E0, (s_from < 0.5 * w)::INT + (s_to < 0.5 * w)::INT + (s_from < w)::INT + (s_to < w)::INT + (s_from < 2 * w)::INT + (s_to < 2 * w)::INT), 6) + 0.0E0 AS reso FROM r0""")
def w8(spark, sf_dir):
    lines = vertex(spark, sf_dir).withColumn("wd", (F.col("vid") % 9 + 20).cast("double"))
    return se.resolution(lines, "wd", F.lit(3), ends=1.3).select("line_id", "vid", r6("reso").alias("reso"))


THIN = f"""d AS (SELECT line_id, vid, x, y, pin, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY line_id) AS n,
 sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d, 150 + (vid % 5) * 60.0E0 AS r, (150 + (vid % 5) * 60.0E0 + 150 + ((vid - 1) % 5) * 60.0E0) / 2 AS rs FROM vertex {WIN})"""


@query("w9_thin", f"""{R}, {THIN},
f AS (SELECT line_id, p, 0.0E0 AS run, true AS k FROM d WHERE p = 0
 UNION ALL SELECT d.line_id, d.p, CASE WHEN f.run + d.d < d.rs AND d.pin = 0 THEN f.run + d.d ELSE 0 END, NOT (f.run + d.d < d.rs AND d.pin = 0) FROM f JOIN d ON d.line_id = f.line_id AND d.p = f.p + 1)
SELECT d.line_id, d.vid, f.k OR d.p = d.n - 1 AS kept FROM f JOIN d ON d.line_id = f.line_id AND d.p = f.p""")
def w9(spark, sf_dir):
    lines = vertex(spark, sf_dir).withColumn("r", F.lit(150) + F.col("vid") % 5 * 60.0)
    return se.thin(lines, "r", "pin")


@query("r9_snap_to_previous", f"""{R}, {THIN},
f AS (SELECT line_id, p, 0.0E0 AS run, true AS k, x, y FROM d WHERE p = 0
 UNION ALL SELECT d.line_id, d.p, CASE WHEN f.run + d.d < e.r THEN f.run + d.d ELSE 0 END, NOT (f.run + d.d < e.r),
  CASE WHEN f.run + d.d < e.r AND d.p < d.n - 1 THEN f.x ELSE d.x END, CASE WHEN f.run + d.d < e.r AND d.p < d.n - 1 THEN f.y ELSE d.y END
  FROM f JOIN d ON d.line_id = f.line_id AND d.p = f.p + 1 JOIN d e ON e.line_id = f.line_id AND e.p = f.p)
SELECT d.line_id, d.vid, round(f.x, 6) + 0.0E0 AS x, round(f.y, 6) + 0.0E0 AS y FROM f JOIN d ON d.line_id = f.line_id AND d.p = f.p""")
def r9(spark, sf_dir):
    lines = vertex(spark, sf_dir).withColumn("r", F.lit(150) + F.col("vid") % 5 * 60.0)
    return se.snap_to_previous(lines, "r").select("line_id", "vid", r6("x").alias("x"), r6("y").alias("y"))


@query("w10_first_crossing", f"{T} SELECT line_id, min(vid) FILTER (WHERE y >= 100) AS first_high, arg_min(vid, struct_pack(a := abs(y - 100), b := vid)) AS closest FROM vertex GROUP BY line_id")
def w10(spark, sf_dir):
    return vertex(spark, sf_dir).groupBy("line_id").agg(
        F.min(F.when(F.col("y") >= 100, F.col("vid"))).alias("first_high"), F.min_by("vid", F.struct(F.abs(F.col("y") - 100), "vid")).alias("closest")
    )


@query("w11_rank", f"{T}, m AS (SELECT line_id, max(y) AS top FROM vertex GROUP BY line_id) SELECT line_id, round(top, 6) + 0.0E0 AS top, CAST(row_number() OVER (ORDER BY top DESC, line_id DESC) AS BIGINT) AS rk FROM m")
def w11(spark, sf_dir):
    tops = vertex(spark, sf_dir).groupBy("line_id").agg(F.max("y").alias("top"))
    from ..operators.flow import rank_watersheds

    ranked = rank_watersheds(tops.select(F.col("line_id").alias("sind"), F.col("line_id").alias("outlet"), F.col("top").alias("acc")))
    return ranked.select(F.col("outlet").alias("line_id"), r6("acc").alias("top"), F.col("seg").alias("rk"))


ARCS = "a AS (SELECT s_suppkey % 3 AS map_id, s_suppkey AS arc_id, s_suppkey % 4 + 1 AS n, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS i FROM supplier)"


@query("w12_group_by_count", f"""WITH RECURSIVE {ARCS}, f AS (SELECT map_id, i, arc_id, n - 1 AS lft, CAST(0 AS BIGINT) AS group_id, CAST(0 AS BIGINT) AS pos FROM a WHERE i = 1
 UNION ALL SELECT a.map_id, a.i, a.arc_id, CASE WHEN f.lft <= 0 THEN a.n ELSE f.lft END - 1, f.group_id + CASE WHEN f.lft <= 0 THEN 1 ELSE 0 END, CASE WHEN f.lft <= 0 THEN 0 ELSE f.pos + 1 END FROM f JOIN a ON a.map_id = f.map_id AND a.i = f.i + 1)
SELECT map_id, arc_id, group_id, pos FROM f""")
def w12(spark, sf_dir):
    k = F.col("s_suppkey")
    arcs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((k % 3).alias("map_id"), k.alias("arc_id"), (k % 4 + 1).alias("n"))
    return se.group_by_count(arcs)


@query("w14_subsample", f"""{T}, a AS (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY line_id) AS n FROM vertex {WIN}),
k AS (SELECT DISTINCT line_id, n, CAST(floor(n / 6) AS BIGINT) AS k FROM a WHERE n >= 12), i AS (SELECT line_id, n, k, unnest(range(k)) AS i FROM k)
SELECT a.line_id, a.vid FROM i JOIN a ON a.line_id = i.line_id AND a.p = CAST(floor(i.i * (i.n - 1) / (i.k - 1)) AS BIGINT)""")
def w14(spark, sf_dir):
    return se.subsample(vertex(spark, sf_dir), 6).select("line_id", "vid")


@query("w15_drop_repeated", f"{T}, a AS (SELECT *, lag(pin) OVER w AS b FROM vertex {WIN}) SELECT line_id, vid, pin FROM a WHERE NOT (pin = 0 AND coalesce(b = 0, false))")
def w15(spark, sf_dir):
    return se.drop_repeated_separators(vertex(spark, sf_dir), "pin", 0).select("line_id", "vid", "pin")


@query("w16_redistribute", f"""{T}, {LEN}, tt AS (SELECT DISTINCT line_id, total FROM ln), k AS (SELECT line_id, total, unnest(range(9)) AS k FROM tt),
s AS (SELECT line_id, s_from AS s0, lead(s_from) OVER w AS s1, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ln {WIN}),
j AS (SELECT k.line_id, k.k, k.total * k.k / 8 AS place, s.*, row_number() OVER (PARTITION BY k.line_id, k.k ORDER BY s.s0) AS rn FROM k JOIN s ON s.line_id = k.line_id AND s.s1 IS NOT NULL AND s.s0 - 1e-7 <= k.total * k.k / 8 AND k.total * k.k / 8 <= s.s1 + 1e-7)
SELECT line_id, CAST(k AS INTEGER) AS k, round(x + (place - s0) / (s1 - s0) * (x1 - x), 4) + 0.0E0 AS x, round(y + (place - s0) / (s1 - s0) * (y1 - y), 4) + 0.0E0 AS y FROM j WHERE rn = 1""")
def w16(spark, sf_dir):
    out = se.redistribute(vertex(spark, sf_dir), count=9)
    return out.select("line_id", "k", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query("w17_densify", f"""{T}, a AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vertex {WIN}), b AS (SELECT *, coalesce(CAST(floor(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / 100) AS INTEGER), 0) AS n FROM a),
c AS (SELECT *, unnest(range(n + 1)) AS sub FROM b)
SELECT line_id, vid, CAST(sub AS INTEGER) AS sub, round(coalesce(x + sub / (n + 1) * (x1 - x), x), 6) + 0.0E0 AS x, round(coalesce(y + sub / (n + 1) * (y1 - y), y), 6) + 0.0E0 AS y FROM c""")
def w17(spark, sf_dir):
    return se.densify(vertex(spark, sf_dir), 100.0).select("line_id", "vid", "sub", r6("x").alias("x"), r6("y").alias("y"))


@query("w18_split_by_length", f"""{T}, {LEN}, k AS (SELECT *, CAST(greatest(floor(total / 3000), 1) AS BIGINT) AS k FROM ln), q AS (SELECT *, CAST(floor(n / k) AS BIGINT) AS q, n % k AS r FROM k)
SELECT line_id, vid, CAST(CASE WHEN p < r * (q + 1) THEN floor(p / (q + 1)) ELSE r + floor((p - r * (q + 1)) / greatest(q, 1)) END AS BIGINT) AS part FROM q""")
def w18(spark, sf_dir):
    return se.split_by_length(vertex(spark, sf_dir), 3000.0).select("line_id", "vid", "part")


RING = with_tables("ring")


@query("w19_offset_ring", f"""{RING}, a AS (SELECT poly_id, vid, x, y, coalesce(lag(x) OVER w, last_value(x) OVER f) AS px, coalesce(lag(y) OVER w, last_value(y) OVER f) AS py,
 coalesce(lead(x) OVER w, first_value(x) OVER f) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS ny FROM ring
 WINDOW w AS (PARTITION BY poly_id ORDER BY vid), f AS (PARTITION BY poly_id ORDER BY vid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS nl, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS pl FROM a),
c AS (SELECT *, (ny - y) / nl AS ax, -(nx - x) / nl AS ay, (y - py) / pl AS bx, -(x - px) / pl AS bb FROM b)
SELECT poly_id AS line_id, vid, round(x + 0.5E0 / sqrt(1 + ax * bx + ay * bb) * (ax + bx) / sqrt((ax + bx) * (ax + bx) + (ay + bb) * (ay + bb)), 6) + 0.0E0 AS x,
 round(y + 0.5E0 / sqrt(1 + ax * bx + ay * bb) * (ay + bb) / sqrt((ax + bx) * (ax + bx) + (ay + bb) * (ay + bb)), 6) + 0.0E0 AS y FROM c""")
def w19(spark, sf_dir):
    rings = ring(spark, sf_dir).withColumnRenamed("poly_id", "line_id")
    return se.offset_ring(rings, 0.5).select("line_id", "vid", r6("x").alias("x"), r6("y").alias("y"))


@query("w20_lift_smallest", f"""{T}, a AS (SELECT line_id, vid, 1.0E0 + (vid % 7) * 30 AS w FROM vertex), b AS (SELECT *, round(w, 3) AS r, min(round(w, 3)) OVER (PARTITION BY line_id) AS m FROM a),
c AS (SELECT line_id, min(r) FILTER (WHERE r > m) AS s, avg(w) FILTER (WHERE r > m) AS o FROM b GROUP BY line_id)
SELECT b.line_id, b.vid, round(CASE WHEN r = m AND s > 10 * m THEN o ELSE w END, 6) + 0.0E0 AS width2 FROM b JOIN c USING (line_id)""")
def w20(spark, sf_dir):
    lines = vertex(spark, sf_dir).withColumn("w", F.col("vid") % 7 * 30 + F.lit(1.0))
    return se.lift_smallest_width(lines, "w").select("line_id", "vid", r6("width2").alias("width2"))


@query("r4_thalweg_level", f"""{T}, {LEN}, z0 AS (SELECT line_id, vid, y / 100 - 1 AS z, avg(d) FILTER (WHERE p > 0) OVER (PARTITION BY line_id) AS md FROM ln),
z1 AS (SELECT *, coalesce((z - avg(z) OVER (PARTITION BY line_id)) / nullif(stddev_pop(z) OVER (PARTITION BY line_id), 0) > 2, false) AS bad FROM z0),
g AS (SELECT * FROM z1 WHERE NOT bad), nb AS (SELECT v.*, (SELECT max(vid) FROM g WHERE g.line_id = v.line_id AND g.vid <= v.vid) AS a, (SELECT min(vid) FROM g WHERE g.line_id = v.line_id AND g.vid >= v.vid) AS b FROM z1 v),
zf AS (SELECT nb.line_id, nb.vid, CAST(greatest(floor(100 / (nb.md + 1e-6)), 10) AS BIGINT) AS n, CASE WHEN ga.vid IS NULL THEN gb.z WHEN gb.vid IS NULL OR ga.vid = gb.vid THEN ga.z ELSE ga.z + (gb.z - ga.z) * (nb.vid - ga.vid) / (gb.vid - ga.vid) END AS z
 FROM nb LEFT JOIN g ga ON ga.line_id = nb.line_id AND ga.vid = nb.a LEFT JOIN g gb ON gb.line_id = nb.line_id AND gb.vid = nb.b),
pp AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY vid) - 1 AS p, count(*) OVER (PARTITION BY line_id) AS c, CAST(floor(n / 2) AS BIGINT) AS m FROM zf),
av AS (SELECT a.line_id, a.vid, avg(b.z) AS zs FROM pp a JOIN pp b ON b.line_id = a.line_id AND b.p <= greatest(a.m, least(a.p, a.c - 1 - a.m)) + a.m AND b.p > greatest(a.m, least(a.p, a.c - 1 - a.m)) + a.m - a.n GROUP BY ALL)
SELECT line_id, vid, round(greatest(CASE WHEN zs >= 3 THEN zs + 1 WHEN zs > 0 THEN (zs + 1) * zs / 3 ELSE 0 END, zs + 1), 8) + 0.0E0 AS eta FROM av""")
def r4(spark, sf_dir):
    lines = vertex(spark, sf_dir).withColumn("z", F.col("y") / 100 - 1)
    return se.thalweg_level(lines).select("line_id", "vid", (F.round("eta", 8) + 0.0).alias("eta"))


@query("s12_river_arc_index", f"""{with_tables('arc')}, f AS (SELECT river_id, arc_pos, min(nrow) AS n, any_value(is_outer) AS o FROM arc GROUP BY ALL)
SELECT CAST(dense_rank() OVER (ORDER BY river_id) - 1 AS BIGINT) AS river_idx, CAST(row_number() OVER (PARTITION BY river_id ORDER BY arc_pos) - 1 AS BIGINT) AS local_arc_idx, river_id, CAST(n AS BIGINT) AS n, o AS is_outer FROM f""")
def s12(spark, sf_dir):
    arcs = river_arc(spark, sf_dir).groupBy("river_id", "arc_pos").agg(F.min("nrow").alias("n"), F.bool_or("is_outer").alias("is_outer"))
    ids = arcs.select("river_id").distinct().select(F.col("river_id").alias("sind"), F.col("river_id").alias("outlet"), (-F.col("river_id")).alias("acc"))
    from ..operators.flow import rank_watersheds

    order = rank_watersheds(ids).select(F.col("outlet").alias("river_id"), (F.col("seg") - 1).alias("river_idx"))
    pos = F.row_number().over(Window.partitionBy("river_id").orderBy("arc_pos")) - 1
    return arcs.withColumn("local_arc_idx", pos.cast("long")).join(order, "river_id").select("river_idx", "local_arc_idx", "river_id", "n", "is_outer")
