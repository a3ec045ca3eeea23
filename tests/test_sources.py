import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.sources import files as fs


def one_file(folder):
    return [str(p) for p in folder.iterdir() if p.name.startswith("part-")][0]


def test_ascii_grid(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (1, 0, 2.5), (1, 1, 1.0)], "iy long, ix long, z double")
    fs.write_asc(cells, str(tmp_path / "g"), 2, 2, -90.0, 30.0, 0.5)
    path = one_file(tmp_path / "g")
    got = {(r.iy, r.ix): r.z for r in fs.read_asc(spark, path).collect()}
    assert got == {(0, 0): 5.0, (0, 1): None, (1, 0): 2.5, (1, 1): 1.0}
    h = fs.read_asc_headers(spark, path).first()
    assert (h.ny, h.nx, h.x0, h.y0, h.dxy) == (2, 2, -90.0, 30.0, 0.5)
    assert [(r.iy, r.ix) for r in fs.read_asc(spark, path, rows=(1, 2), cols=(1, 9)).collect()] == [(1, 1)]


@pytest.mark.parametrize("deflate", [True, False])
def test_tiff(spark, tmp_path, deflate):
    z = np.arange(12, dtype=float).reshape(3, 4)
    z[1, 1] = -99
    (tmp_path / "a.tif").write_bytes(fs.encode_tiff(z, 10.0, 50.0, 0.25, nodata=-99.0, deflate=deflate))
    got = {(r.iy, r.ix): (r.x, r.y, r.z) for r in fs.read_tiff(spark, str(tmp_path / "a.tif")).collect()}
    assert got[0, 0] == (10.125, 49.875, 0.0) and got[1, 1][2] is None and got[2, 3] == (10.875, 49.375, 11.0)
    b = fs.read_tiff_boxes(spark, str(tmp_path / "a.tif")).first()
    assert (b.x0, b.y0, b.x1, b.y1) == (10.0, 49.25, 11.0, 50.0)


def test_map_round_trip(spark, tmp_path):
    rows = [(4, 0, 0.0, 1.0, 0.5), (4, 1, 1.0, 1.0, 0.5), (4, 2, 2.0, 3.0, 0.5), (9, 0, 5.0, 5.0, 0.0), (9, 1, 6.0, 6.0, 0.0)]
    fs.write_map(spark.createDataFrame(rows, "line_id long, vid long, x double, y double, z double"), str(tmp_path / "m"))
    got = fs.read_map(spark, one_file(tmp_path / "m")).orderBy("line_id", "vid").collect()
    assert [(r.kind, r.line_id, r.vid, r.x, r.y, r.z) for r in got] == [("arc", {4: 0, 9: 1}[r[0]], *r[1:]) for r in rows]


def test_mesh_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 1.0, 0.0, 6.0), (3, 1.0, 1.0, 7.0), (4, 0.0, 1.0, 8.0)], "node_id long, x double, y double, dp double")
    elems = spark.createDataFrame([(1, 4, 1, 2, 3, 4), (2, 3, 1, 2, 3, -2)], "elem_id long, i34 int, n1 long, n2 long, n3 long, n4 long")
    fs.write_gr3(nodes, elems, str(tmp_path / "g"))
    n, e = fs.read_gr3(spark, one_file(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, elems.collect()))
    (tmp_path / "m.2dm").write_text("MESH2D\nE3T 1 1 2 3 1\nE4Q 2 1 2 3 4 1\nND 1 0.0 0.0 5.0\n")
    n2, e2 = fs.read_2dm(spark, str(tmp_path / "m.2dm"))
    assert n2.count() == 1 and {(r.elem_id, r.i34, r.n4) for r in e2.collect()} == {(1, 3, -2), (2, 4, 4)}


def test_shape_file(spark, tmp_path):
    lines = [np.array([[0.0, 0.0, 1.0], [1.0, 2.0, 0.0]]), np.array([[5.0, 5.0, 0.0], [6.0, 5.0, 0.0], [7.0, 5.0, 2.0]])]
    (tmp_path / "a.shp").write_bytes(fs.encode_shp(lines))
    got = fs.read_shp(spark, str(tmp_path / "a.shp")).orderBy("line_id", "vid").collect()
    assert [(r.line_id, r.vid, r.x, r.y, r.z) for r in got] == [(i, k, *p) for i, v in enumerate(lines) for k, p in enumerate(v.tolist())]
    (tmp_path / "n.shp").write_bytes(fs.encode_shp([])[:100] + struct.pack(">II", 1, 2) + struct.pack("<i", 0))
    with pytest.raises(Exception, match="shape type 0"):
        fs.read_shp(spark, str(tmp_path / "n.shp")).collect()


def test_quad_polygons_catalog_and_variables(spark, tmp_path):
    (tmp_path / "q.map").write_text("POLYGON\nID 1\nPATCH 2\nEND\nPOLYGON\nID 2\nEND\n")
    assert [r.value for r in fs.read_quad_polygons(spark, str(tmp_path / "q.map")).orderBy("k").collect()] == ["POLYGON", "ID 1", "PATCH 2", "END"]
    from fluvial.operators.tiles import read_catalog

    (tmp_path / "d.json").write_text('{"B": {"name": "b", "glob_pattern": "*", "file_list": ["y", "x", "x"]},\n "A": {"name": "a", "glob_pattern": "", "file_list": ["z"]}}')
    got = [(r.source_ord, r.source, r.tile_ord, r.path) for r in read_catalog(spark, str(tmp_path / "d.json")).orderBy("source_ord", "tile_ord").collect()]
    assert got == [(0, "B", 0, "x"), (0, "B", 1, "y"), (1, "A", 0, "z")]
    fs.save_variables(str(tmp_path / "v"), dem=spark.range(3))
    assert fs.load_variables(spark, str(tmp_path / "v"), "dem")["dem"].count() == 3


def test_merge_maps(spark):
    a = spark.range(2).select(F.col("id").alias("line_id"))
    assert fs.merge_maps(a, a).groupBy("map_id").count().count() == 2


def test_mesh_file_is_read_by_blocks(spark, tmp_path):
    """Many blocks of one file give the same rows, and no task reads the whole file."""
    n = 3000
    nodes = [f"{i} {i * 0.5} {-i} 1e-3" for i in range(1, n + 1)]
    elems = [f" {i}\t3 {i} {i + 1} {i + 2}" if i % 2 else f"{i} 4 {i} {i + 1} {i + 2} {i + 3}" for i in range(1, 1001)]
    path = str(tmp_path / "big.gr3")
    with open(path, "w") as f:
        f.write("\n".join(["title", f"1000 {n}", *nodes, *elems, "0 = Number of open boundaries", "0 = Total"]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = fs.numbered_lines(spark, path)
        assert [r[0] for r in lines.orderBy("n").select("value").collect()][2:5] == nodes[:3]
        found, e = fs.read_gr3(spark, path)
        assert [tuple(r) for r in found.orderBy("node_id").collect()] == [(i, i * 0.5, float(-i), 1e-3) for i in range(1, n + 1)]
        assert [tuple(r) for r in e.orderBy("elem_id").collect()] == [(i, 3, i, i + 1, i + 2, -2) if i % 2 else (i, 4, i, i + 1, i + 2, i + 3) for i in range(1, 1001)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def old_map(content):
    """Vertices of one map, line after line."""
    nodes, arcs, points, arc, mode, pending, spot = {}, [], [], None, "", 0, None
    for w in (line.split() for line in content.splitlines()):
        if not w:
            continue
        if w[0] in ("NODE", "POINT"):
            mode = w[0]
        elif w[0] == "ARC":
            arc, mode = {"nodes": None, "v": []}, "ARC"
        elif w[0] == "NODES" and arc is not None:
            arc["nodes"] = (int(w[1]), int(w[2]))
        elif w[0] == "ARCVERTICES" and arc is not None:
            pending = int(w[1])
        elif w[0] == "XY":
            spot = tuple(map(float, w[1:4]))
            if mode == "POINT":
                points.append(spot)
        elif w[0] == "ID" and mode == "NODE":
            nodes[int(w[1])] = spot
        elif w[0] == "END":
            if mode == "ARC" and arc is not None:
                arcs.append(arc)
                arc = None
            mode = ""
        elif pending and arc is not None:
            arc["v"].append(tuple(map(float, w[:3])))
            pending -= 1
    rows = [("arc", i, k, *p) for i, a in enumerate(arcs) for k, p in enumerate([nodes[a["nodes"][0]], *a["v"], nodes[a["nodes"][1]]])]
    return sorted(rows + [("point", i, 0, *p) for i, p in enumerate(points)])


def test_map_file_is_read_by_blocks(spark, tmp_path, monkeypatch):
    """Blocks across chunks of lines and of the file give the rows of a plain reader; no task reads the whole file."""
    text = ["MAP VERSION 8", "BEGCOV", "COVELEV 0.0", 'COV_WKT GEOGCS["GCS_WGS_1984"]END_COV_WKT']
    for i in range(1, 301):
        text += ["NODE", f"XY {i * 0.5} {-i} 1e-3", f"ID {i}", "END", ""]
    for i in range(1, 200):
        text += ["POINT", f"XY {i} {i} 0.0", f"ID {i}", "END"] if i % 9 == 0 else []
        text += ["ARC", f"ID {i}", "ARCELEVATION 0.0", f"NODES {i} {i + 100}", *([f"ARCVERTICES {i % 40}", *[f" {k}.5 {i}.0 2.0\t" for k in range(i % 40)]] if i % 40 else []), "DISTNODE 0", "NODETYPE 0", "ARCBIAS 1", "MERGED 0 0 0 0", "END"]
    content = "\r\n".join([*text, "ENDCOV", "BEGTS", "LEND", ""])
    (tmp_path / "a.map").write_bytes(content.encode())
    assert (tmp_path / "b").mkdir() is None
    (tmp_path / "b" / "bad.map").write_text(content.replace("WGS", "NAD"))
    monkeypatch.setattr(fs, "LINE_CHUNK", 16)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = fs.read_map(spark, str(tmp_path / "a.map"))
        assert sorted((r.kind, r.line_id, r.vid, r.x, r.y, r.z) for r in found.collect()) == old_map(content)
        assert "MapInPandas" not in found._jdf.queryExecution().toString() and "binaryFile" not in found._jdf.queryExecution().toString()
        with pytest.raises(Exception, match="only WGS 84"):
            fs.read_map(spark, str(tmp_path / "b" / "bad.map")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shape_files_are_bounded(spark, tmp_path, monkeypatch):
    """More lines make more files, and a file's vertices leave the reader in batches."""
    from fluvial.sources import rasters as rs

    lines = spark.range(300).selectExpr("id AS line_id", "explode(sequence(0L, 4L)) AS vid").selectExpr("*", "line_id * 1.5D AS x", "vid * 1.0D AS y", "0.0D AS z").cache()
    made = rs.write_shapes(lines, str(tmp_path / "s"), 4, 100).collect()
    assert len(made) > 12 and sum(r.n_lines for r in made) == 300 and max(r.n_lines for r in made) < 60
    monkeypatch.setattr(fs, "SHAPE_BATCH", 7)
    found = fs.read_shp(spark, str(tmp_path / "s" / "*.shp"))
    assert sorted(tuple(r) for r in found.select("x", "vid", "y", "z").collect()) == sorted(tuple(r) for r in lines.select("x", "vid", "y", "z").collect())
    ids = found.select("path", "line_id").distinct().groupBy("path").count().collect()
    assert sum(r["count"] for r in ids) == 300
