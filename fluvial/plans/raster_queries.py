"""Queries over the raster tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import cell, with_tables
from ..operators import flow as fl
from ..operators import raster as ra
from ..storage import cut
from .registry import query, r6

T = with_tables("cell", "nbr")
W = with_tables("cell", "nbr", recursive=True)
PAIRS = "cell c CROSS JOIN nbr n JOIN cell m ON m.iy = c.iy + n.dy AND m.ix = c.ix + n.dx"


def stored(sql: str) -> str:
    """The statement with its tables computed once, where a later one reads them many times."""
    for name in ("cell", "nbr", "d8", "flow"):
        sql = sql.replace(f"{name} AS (", f"{name} AS MATERIALIZED (", 1)
    return sql


def d8_sql(z: str = "z_tilt", cond: str = "z > zb") -> str:
    return f"""d8 AS (SELECT sind, iy, ix, z, CASE WHEN {cond} THEN code ELSE 0 END AS dir, CASE WHEN {cond} THEN nsind END AS nxt
 FROM (SELECT c.sind, c.iy, c.ix, c.{z} AS z, n.code, m.sind AS nsind, m.{z} AS zb,
  row_number() OVER (PARTITION BY c.sind ORDER BY m.{z}, n.o) AS rn FROM {PAIRS}) q WHERE rn = 1)"""


PATH = """path AS (SELECT sind AS src, sind AS cur, CAST(0 AS BIGINT) AS step FROM d8
 UNION ALL SELECT p.src, d.nxt, p.step + 1 FROM path p JOIN d8 d ON p.cur = d.sind WHERE d.nxt IS NOT NULL),
acc AS (SELECT cur AS sind, CAST(count(*) AS BIGINT) AS acc FROM path GROUP BY cur),
term AS (SELECT p.src AS sind, p.cur AS outlet, p.step AS depth FROM path p JOIN d8 d ON p.cur = d.sind WHERE d.nxt IS NULL),
flow AS (SELECT sind, acc, outlet, depth FROM acc JOIN term USING (sind))"""


def tilted(spark, sf_dir):
    return ra.d8_directions(cell(spark, sf_dir), "z_tilt")


@query("h1_subdomains", f"""{T}, s AS (SELECT max(iy) + 1 AS ny FROM cell),
b AS (SELECT ny, greatest(CAST(round_even(ny * 100 / 5000, 0) AS BIGINT), 1) AS n FROM s),
k AS (SELECT ny, n, greatest(CAST(round_even(sqrt(n), 0) AS BIGINT), 1) AS cols FROM b),
g AS (SELECT ny, cols, greatest(CAST(floor(n / cols) AS BIGINT), 1) AS rws FROM k)
SELECT block, CAST(count(*) AS BIGINT) AS cells, CAST(min(sind) AS BIGINT) AS first_cell FROM (
 SELECT sind, CAST(least(floor(iy / floor(ny / rws)), rws - 1) * cols + least(floor(ix / floor(100 / cols)), cols - 1) AS BIGINT) AS block FROM cell, g) q
GROUP BY block""")
def h1(spark, sf_dir):
    cells = cell(spark, sf_dir)
    ny = (cells.agg(F.max("iy")).first()[0] or 0) + 1
    blocks = spark.createDataFrame(ra.subdomains(ny, 100, 5000))
    hit = cells.join(F.broadcast(blocks), (F.col("iy") >= F.col("y0")) & (F.col("iy") < F.col("y1")) & (F.col("ix") >= F.col("x0")) & (F.col("ix") < F.col("x1")))
    return hit.groupBy("block").agg(F.count(F.lit(1)).alias("cells"), F.min("sind").alias("first_cell"))


@query("s5_nodata_border", f"""{T} SELECT DISTINCT c.sind FROM {PAIRS} WHERE NOT c.is_nodata AND m.is_nodata""")
def s5(spark, sf_dir):
    cells = cell(spark, sf_dir).withColumn("z", F.when(~F.col("is_nodata"), F.col("z_tilt")))
    return ra.nodata_border(cells)


@query("h5_mask_nodata", f"""{T} SELECT sind, CASE WHEN z_tilt <> 20000 AND z_tilt BETWEEN 1000 AND 2000000 THEN z_tilt END AS z FROM cell""")
def h5(spark, sf_dir):
    return cell(spark, sf_dir).select("sind", ra.mask_nodata(F.col("z_tilt"), 20000, (1000, 2000000)).alias("z"))


@query("h6_coordinates", f"""{T} SELECT sind, round(-90 + ix * 0.001E0, 6) + 0.0E0 AS x, round(30 - iy * 0.001E0, 6) + 0.0E0 AS y FROM cell""")
def h6(spark, sf_dir):
    x, y = ra.cell_coordinates(F.col("iy"), F.col("ix"), -90.0, 30.0, 0.001)
    return cell(spark, sf_dir).select("sind", r6(x).alias("x"), r6(y).alias("y"))


@query("h7_d8_direction", f"{T}, {d8_sql()} SELECT sind, dir FROM d8")
def h7(spark, sf_dir):
    return tilted(spark, sf_dir).select("sind", "dir")


@query("h7_d8_noise", f"{T}, {d8_sql('z_noise')} SELECT sind, dir, nxt FROM d8")
def h7n(spark, sf_dir):
    return ra.d8_directions(cell(spark, sf_dir), "z_noise").select("sind", "dir", "nxt")


@query("h7_d8_nodata", f"""{T}, v AS (SELECT *, CASE WHEN NOT is_nodata THEN z_tilt END AS zz FROM cell),
b AS (SELECT c.sind, n.code, m.zz AS zb, row_number() OVER (PARTITION BY c.sind ORDER BY m.zz, n.o) AS rn
 FROM v c CROSS JOIN nbr n JOIN v m ON m.iy = c.iy + n.dy AND m.ix = c.ix + n.dx WHERE m.zz IS NOT NULL)
SELECT v.sind, CASE WHEN v.zz IS NULL THEN -1 WHEN v.zz > b.zb THEN b.code ELSE 0 END AS dir FROM v LEFT JOIN b ON v.sind = b.sind AND b.rn = 1""")
def h7d(spark, sf_dir):
    cells = cell(spark, sf_dir).withColumn("z", F.when(~F.col("is_nodata"), F.col("z_tilt")))
    return ra.d8_directions(cells).select("sind", "dir")


@query("h7a_flats_by_index", f"{T}, {d8_sql('z_tilt', 'z > zb + 5000 OR (abs(z - zb) <= 5000 AND sind < nsind)')} SELECT sind, dir FROM d8")
def h7a(spark, sf_dir):
    return ra.d8_directions(cell(spark, sf_dir), "z_tilt", zlimit=5000, flats_by_index=True).select("sind", "dir")


@query("h7b_interior_only", f"""{T}, {d8_sql('z_tilt')}, h AS (SELECT max(iy) AS my FROM cell)
SELECT sind, CASE WHEN iy > 0 AND iy < my AND ix > 0 AND ix < 99 THEN dir ELSE 0 END AS dir FROM d8, h""")
def h7b(spark, sf_dir):
    return ra.d8_directions(cell(spark, sf_dir), "z_tilt", interior_only=True).select("sind", "dir")


@query("h8_close_borders", f"""{T}, h AS (SELECT max(iy) AS my FROM cell), d AS (SELECT sind, iy, ix, [1, 2, 4, 8, 16, 32, 64, 128][CAST(z_noise % 8 AS INTEGER) + 1] AS dir FROM cell)
SELECT sind, CAST(CASE WHEN (iy = 0 AND dir IN (32,64,128)) OR (iy = my AND dir IN (2,4,8)) OR (ix = 0 AND dir IN (8,16,32)) OR (ix = 99 AND dir IN (1,2,128)) THEN 0 ELSE dir END AS INTEGER) AS dir FROM d, h""")
def h8(spark, sf_dir):
    codes = F.array(*[F.lit(1 << i) for i in range(8)])
    d8 = cell(spark, sf_dir).select("sind", "iy", "ix", codes[(F.col("z_noise") % 8).cast("int")].alias("dir"))
    ny = (d8.agg(F.max("iy")).first()[0] or 0) + 1
    return ra.close_borders(d8, ny, 100).select("sind", "dir")


@query("h9_0_upstream", stored(f"{T}, {d8_sql()} SELECT d.nxt AS sind, d.sind AS up, k.o_search AS slot FROM d8 d JOIN nbr k ON k.inv_code = d.dir"))
def h9_0(spark, sf_dir):
    ups = ra.upstream_neighbours(tilted(spark, sf_dir)).select("sind", F.explode("ups").alias("u"))
    return ups.select("sind", F.col("u.sind").alias("up"), F.col("u.os").alias("slot"))


@query("h9_2_inflow_count", f"{T}, {d8_sql()} SELECT c.sind, CAST(count(d.sind) AS BIGINT) AS n_in FROM cell c LEFT JOIN d8 d ON d.nxt = c.sind GROUP BY c.sind")
def h9_2(spark, sf_dir):
    return ra.inflow_counts(tilted(spark, sf_dir))


@query("h9_3_accumulation", f"{W}, {d8_sql()}, {PATH} SELECT sind, acc, outlet FROM flow")
def h9_3(spark, sf_dir):
    return fl.accumulate(tilted(spark, sf_dir)).select("sind", "acc", "outlet")


MAIN = """up AS (SELECT d.nxt AS sind, d.sind AS u, f.acc, k.o_search AS os FROM d8 d JOIN flow f ON f.sind = d.sind JOIN nbr k ON k.inv_code = d.dir),
mx AS (SELECT *, row_number() OVER (PARTITION BY sind ORDER BY acc DESC, os) AS rn FROM up WHERE acc >= 5)"""


def _with_acc(spark, sf_dir):
    d8 = cut(tilted(spark, sf_dir), "d8")
    flow = cut(fl.accumulate(d8), "flow")
    return d8, flow


@query("h9_4_main_upstream", f"{W}, {d8_sql()}, {PATH}, {MAIN} SELECT d8.sind, coalesce(mx.u, -1) AS up_main FROM d8 LEFT JOIN mx ON mx.sind = d8.sind AND mx.rn = 1")
def h9_4(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return ra.main_upstream(d8.join(flow.select("sind", "acc"), "sind"), "acc", 5).select("sind", "up_main")


@query("h9_5_other_upstream", f"{W}, {d8_sql()}, {PATH}, {MAIN} SELECT sind, u AS up FROM mx WHERE rn > 1")
def h9_5(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return ra.main_upstream(d8.join(flow.select("sind", "acc"), "sind"), "acc", 5).select("sind", F.explode("up_rest").alias("up"))


@query("h9_6_stem_top", f"""{W}, {d8_sql()}, {PATH}, {MAIN}, climb AS (SELECT sind AS start, sind AS cur, CAST(0 AS BIGINT) AS step FROM d8 WHERE nxt IS NULL
 UNION ALL SELECT c.start, m.u, c.step + 1 FROM climb c JOIN mx m ON m.sind = c.cur AND m.rn = 1)
SELECT start AS outlet, arg_max(cur, step) AS top, max(step) AS length FROM climb GROUP BY start""")
def h9_6(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    up = ra.main_upstream(d8.join(flow.select("sind", "acc"), "sind"), "acc", 5).filter("up_main >= 0").select("sind", F.col("up_main").alias("nxt"))
    paths = fl.downstream_paths(up, d8.filter("nxt is null").select("sind"))
    return paths.groupBy(F.col("start").alias("outlet")).agg(F.max_by("sind", "step").alias("top"), F.max("step").alias("length"))


@query("h9_8_same_segment", f"""{W}, {d8_sql()}, {PATH} SELECT c.sind, CAST(count(*) FILTER (WHERE g.outlet = f.outlet) AS BIGINT) AS n_same
FROM {PAIRS} JOIN flow f ON f.sind = c.sind JOIN flow g ON g.sind = m.sind GROUP BY c.sind""")
def h9_8(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return ra.same_segment_neighbours(d8.join(flow.select("sind", F.col("outlet").alias("seg")), "sind"))


@query("h9_9_cells_by_segment", f"""{W}, {d8_sql()}, {PATH} SELECT outlet, array_to_string(list_sort(list(sind)), ',') AS cells FROM flow GROUP BY outlet""")
def h9_9(spark, sf_dir):
    _, flow = _with_acc(spark, sf_dir)
    return flow.groupBy("outlet").agg(F.sort_array(F.collect_list("sind")).alias("c")).select(
        "outlet", F.array_join("c", ",").alias("cells")
    )


@query("h10_downstream_cell", f"""{T}, {d8_sql()} SELECT d.sind, CASE WHEN d.dir > 0 THEN (d.iy + n.dy) * 100 + d.ix + n.dx ELSE -1 END AS nxt FROM d8 d LEFT JOIN nbr n ON n.code = d.dir""")
def h10(spark, sf_dir):
    return ra.downstream_cell(tilted(spark, sf_dir), 100).select("sind", "nxt")


@query("h10_1_outlet", f"{W}, {d8_sql()}, {PATH} SELECT sind, outlet FROM flow")
def h10_1(spark, sf_dir):
    return fl.accumulate(tilted(spark, sf_dir)).select("sind", "outlet")


@query("h10_2_path", f"{W}, {d8_sql()}, {PATH} SELECT src AS start, step, cur AS sind FROM path")
def h10_2(spark, sf_dir):
    d8 = cut(tilted(spark, sf_dir), "d8")
    return fl.downstream_paths(d8, d8.select("sind"))


LOOPS = """e AS (SELECT c_custkey AS sind, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 3 THEN c_custkey - 2 WHEN c_custkey % 10 = 7 THEN c_custkey - 5 ELSE c_custkey - 1 END AS nxt0 FROM customer),
g AS (SELECT sind, CASE WHEN sind % 10 = 1 THEN sind + 2 ELSE nxt0 END AS nxt FROM e),
ids AS (SELECT sind, CASE WHEN nxt IN (SELECT sind FROM g) THEN nxt END AS nxt FROM g),
walk AS (SELECT sind AS src, nxt AS cur, 1 AS step FROM ids WHERE nxt IS NOT NULL UNION ALL SELECT w.src, i.nxt, w.step + 1 FROM walk w JOIN ids i ON i.sind = w.cur WHERE i.nxt IS NOT NULL AND w.step < 25)"""


@query("h10_3_loops", f"""WITH RECURSIVE {LOOPS} SELECT i.sind, CASE WHEN max(w.step) IS NULL OR max(w.step) < 25 THEN 0 WHEN count(*) FILTER (WHERE w.cur = i.sind) > 0 THEN 1 ELSE 2 END AS flag
FROM ids i LEFT JOIN walk w ON w.src = i.sind GROUP BY i.sind""")
def h10_3(spark, sf_dir):
    k = F.col("c_custkey")
    last = k % 10
    nxt = F.when(last == 0, F.lit(None)).when(last == 1, k + 2).when(last == 3, k - 2).when(last == 7, k - 5).otherwise(k - 1)
    e = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("sind"), nxt.cast("long").alias("nxt"))
    known = e.select(F.col("sind").alias("nxt"), F.lit(True).alias("ok"))
    e = e.join(known, "nxt", "left").select("sind", F.when(F.col("ok"), F.col("nxt")).alias("nxt"))
    return fl.loop_flags(cut(e, "loops"))


@query("h10_4_path_length", f"{W}, {d8_sql()}, {PATH} SELECT sind, depth + 1 AS n_cells FROM flow")
def h10_4(spark, sf_dir):
    return fl.accumulate(tilted(spark, sf_dir)).select("sind", (F.col("depth") + 1).alias("n_cells"))


@query("h11_watersheds", f"""{W}, {d8_sql()}, {PATH}, rk AS (SELECT outlet, CAST(row_number() OVER (ORDER BY acc DESC, sind DESC) AS BIGINT) AS seg FROM flow WHERE sind = outlet)
SELECT f.sind, f.acc, f.outlet, rk.seg FROM flow f JOIN rk USING (outlet)""")
def h11(spark, sf_dir):
    return fl.watersheds(tilted(spark, sf_dir))


@query("h11_external_inflow", f"""{W}, {d8_sql()}, {PATH} SELECT p.cur AS sind, CAST(sum(p.src % 7 + 1) AS BIGINT) AS acc_ext FROM path p GROUP BY p.cur""")
def h11x(spark, sf_dir):
    d8 = cut(tilted(spark, sf_dir), "d8")
    ext = d8.select("sind", (F.col("sind") % 7 + 1).alias("acc"))
    return fl.add_external(d8, ext)


@query("h11b_boundary_outlets", f"""{W}, {d8_sql()}, {PATH}, h AS (SELECT max(iy) AS my FROM cell)
SELECT d.sind, f.acc, d.z FROM d8 d JOIN flow f USING (sind), h WHERE d.dir = 0 AND (d.iy = 0 OR d.iy = my OR d.ix = 0 OR d.ix = 99)""")
def h11b(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    my = d8.agg(F.max("iy")).first()[0]
    return d8.filter((F.col("dir") == 0) & ((F.col("iy") == 0) | (F.col("iy") == my) | F.col("ix").isin(0, 99))).join(
        flow.select("sind", "acc"), "sind"
    ).select("sind", "acc", "z")


@query("entry", f"""{W}, {d8_sql()}, {PATH}, rk AS (SELECT outlet, acc AS total, CAST(row_number() OVER (ORDER BY acc DESC, sind DESC) AS BIGINT) AS seg FROM flow WHERE sind = outlet)
SELECT rk.seg, rk.outlet, rk.total, CAST(count(*) FILTER (WHERE f.acc >= 50) AS BIGINT) AS channel_cells FROM rk JOIN flow f USING (outlet) WHERE rk.seg <= 10 GROUP BY ALL""")
def flagship(spark, sf_dir):
    """The ten largest watersheds and how many of their cells drain at least 50 cells."""
    sheds = fl.watersheds(tilted(spark, sf_dir)).filter("seg <= 10")
    return sheds.groupBy("seg", "outlet").agg(F.max("acc").alias("total"), F.count_if(F.col("acc") >= 50).alias("channel_cells"))


STEMS = """up2 AS (SELECT d.nxt AS sind, d.sind AS u, f.acc, k.o_search AS os FROM d8 d JOIN flow f ON f.sind = d.sind JOIN nbr k ON k.inv_code = d.dir WHERE f.acc >= 20),
mx2 AS (SELECT *, row_number() OVER (PARTITION BY sind ORDER BY acc DESC, os) AS rn FROM up2),
cand AS (SELECT d.sind, d.nxt, f.outlet FROM d8 d JOIN flow f USING (sind) WHERE f.acc >= 20 OR d.nxt IS NULL),
heads AS (SELECT c.sind, c.nxt, c.outlet FROM cand c LEFT JOIN mx2 m ON m.u = c.sind AND m.rn = 1 WHERE m.u IS NULL OR c.nxt IS NULL),
grow AS (SELECT outlet, sind AS stem, CAST(CASE WHEN nxt IS NULL THEN 0 ELSE 1 END AS BIGINT) AS vid, sind FROM heads
 UNION ALL SELECT g.outlet, g.stem, g.vid + 1, m.u FROM grow g JOIN mx2 m ON m.sind = g.sind AND m.rn = 1),
lines AS (SELECT outlet AS river, stem, vid, sind FROM grow UNION ALL SELECT outlet, sind, CAST(0 AS BIGINT), nxt FROM heads WHERE nxt IS NOT NULL)"""


@query("h12_stems", f"{W}, {d8_sql()}, {PATH}, {STEMS} SELECT river, stem, vid, sind FROM lines")
def h12(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return fl.stems(d8, flow, 20)


@query("h12_river_network", f"""{W}, {d8_sql()}, {PATH}, {STEMS}, sz AS (SELECT river, stem, count(*) AS n FROM lines GROUP BY ALL),
ok AS (SELECT river FROM sz WHERE n > 1 GROUP BY river HAVING sum(n + 1) > 3)
SELECT l.river, l.stem, l.vid, l.sind FROM lines l JOIN sz USING (river, stem) JOIN ok USING (river) WHERE sz.n > 1""")
def h12n(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return fl.river_network(d8, flow, 20)


@query("h12_river_network_parity", f"""{W}, {d8_sql()}, {PATH}, {STEMS}, sz AS (SELECT river, stem, count(*) AS n, max(vid) AS v, arg_max(sind, vid) AS s FROM lines GROUP BY ALL),
ok AS (SELECT river FROM sz GROUP BY river HAVING sum(n + 2) > 3), al AS (SELECT * FROM lines UNION ALL SELECT river, stem, v + 1, s FROM sz)
SELECT al.river, al.stem, al.vid, al.sind FROM al JOIN ok USING (river)""")
def h12p(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return fl.river_network(d8, flow, 20, parity=True)


@query("s16_split_at_junctions", f"""{W}, {d8_sql()}, {PATH}, {STEMS}, j AS (SELECT DISTINCT sind FROM lines WHERE vid = 0 AND stem <> sind),
mk AS (SELECT l.*, CASE WHEN l.vid > 0 AND l.vid < max(l.vid) OVER (PARTITION BY l.stem) AND j.sind IS NOT NULL THEN 1 ELSE 0 END AS cp FROM lines l LEFT JOIN j ON j.sind = l.sind),
se AS (SELECT *, coalesce(sum(cp) OVER (PARTITION BY stem ORDER BY vid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM mk),
bo AS (SELECT river, stem, section, vid, sind FROM se UNION ALL SELECT river, stem, section + 1, vid, sind FROM se WHERE cp = 1)
SELECT river, stem, CAST(section AS BIGINT) AS section, CAST(row_number() OVER (PARTITION BY stem, section ORDER BY vid) - 1 AS BIGINT) AS pos, sind FROM bo""")
def s16(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return fl.split_at_junctions(fl.stems(d8, flow, 20))


@query("h14_flat_neighbours", f"""{T}, q AS (SELECT sind, iy, ix, CAST(floor(z_tilt / 30000) AS BIGINT) AS z FROM cell),
b AS (SELECT c.sind, c.z, n.code, n.o, m.sind AS ns, m.z AS zb, row_number() OVER (PARTITION BY c.sind ORDER BY m.z, n.o) AS rn FROM q c CROSS JOIN nbr n JOIN q m ON m.iy = c.iy + n.dy AND m.ix = c.ix + n.dx),
d AS (SELECT sind, z, CASE WHEN z > zb THEN code ELSE 0 END AS dir, zb, ns FROM b WHERE rn = 1)
SELECT d.sind, CAST(count(*) FILTER (WHERE b.zb = d.z) AS BIGINT) AS n_equal, d.dir = 0 AND bool_or(b.zb > d.z) AS high_edge,
 d.dir > 0 AND bool_or(b.zb = d.z AND e.dir = 0) AS low_edge, any_value(d.zb) AS z_low, any_value(d.ns) AS sind_low
FROM d JOIN b ON b.sind = d.sind JOIN d e ON e.sind = b.ns GROUP BY d.sind, d.dir, d.z""")
def h14(spark, sf_dir):
    cells = cell(spark, sf_dir).withColumn("z", F.floor(F.col("z_tilt") / 30000))
    return ra.flat_neighbours(cut(ra.d8_directions(cells), "d8"))


#: Outlets handed upstream, a row a cell.
OUTLETS = """flow AS (SELECT sind, sind AS outlet FROM d8 WHERE nxt IS NULL UNION ALL SELECT d.sind, f.outlet FROM flow f JOIN d8 d ON d.nxt = f.sind)"""


@query("h15_segment_border", stored(f"""{W}, {d8_sql()}, {OUTLETS}, h AS (SELECT max(iy) AS my FROM cell),
o AS (SELECT c.sind, m.sind AS ns, m.z_tilt AS z, row_number() OVER (PARTITION BY c.sind ORDER BY m.z_tilt, n.o) AS rn
 FROM {PAIRS} JOIN flow f ON f.sind = c.sind JOIN flow g ON g.sind = m.sind WHERE g.outlet <> f.outlet)
SELECT c.sind, f.outlet AS seg, o.sind IS NOT NULL OR c.iy = 0 OR c.iy = my OR c.ix = 0 OR c.ix = 99 AS on_border, o.ns AS out_sind, o.z AS out_z
FROM cell c JOIN flow f USING (sind) CROSS JOIN h LEFT JOIN o ON o.sind = c.sind AND o.rn = 1"""))
def h15(spark, sf_dir):
    d8, flow = _with_acc(spark, sf_dir)
    return ra.segment_border(d8.join(flow.select("sind", F.col("outlet").alias("seg")), "sind"))


@query("h3_mosaic", f"""{T}, t AS (SELECT iy, ix, z_tilt AS z, 0 AS ord FROM cell WHERE ix < 60 UNION ALL SELECT iy, ix, z_noise, 1 FROM cell WHERE ix >= 40)
SELECT iy, ix, arg_max(z, ord) AS z FROM t GROUP BY iy, ix""")
def h3(spark, sf_dir):
    c = cell(spark, sf_dir)
    a = c.filter("ix < 60").select("iy", "ix", F.col("z_tilt").alias("z"), F.lit(0).alias("ord"))
    b = c.filter("ix >= 40").select("iy", "ix", F.col("z_noise").alias("z"), F.lit(1).alias("ord"))
    return ra.mosaic(a.unionByName(b), "ord", ["z"])


@query("h4_drop_halo", f"""{T} SELECT (iy - 2) * 50 + ix - 10 AS sind, iy - 2 AS iy, ix - 10 AS ix, z_tilt FROM cell WHERE iy BETWEEN 2 AND 11 AND ix BETWEEN 10 AND 59""")
def h4(spark, sf_dir):
    return ra.drop_halo(cell(spark, sf_dir), 2, 12, 10, 60).select("sind", "iy", "ix", "z_tilt")


@query("h24_index_codec", f"""{T} SELECT sind, CAST(floor(sind / 77) AS BIGINT) AS iy2, sind % 77 AS ix2, CAST(floor(sind / 77) AS BIGINT) * 77 + sind % 77 AS back FROM cell""")
def h24(spark, sf_dir):
    iy, ix = ra.split_index(F.col("sind"), 77)
    return cell(spark, sf_dir).select("sind", iy.alias("iy2"), ix.alias("ix2"), ra.flat_index(iy, ix, 77).alias("back"))
