"""File formats as DataFrames.

Readers take whole files as bytes through Spark's ``binaryFile`` source, so any
file system and glob works and every file is one task's work, but for meshes
and maps, whose lines are read by blocks; writers use the text source. Row numbers come from a row's place in its file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.raster import mask_nodata
from ..storage import cut


def _parse(spark: SparkSession, path: str | list[str], schema: str, parse: Callable[[str, bytes], Iterator[pd.DataFrame]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                yield from parse(name, bytes(content))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


HEADER = "path string, ny long, nx long, x0 double, y0 double, dxy double, nodata double"


def asc_header(content: bytes) -> tuple[int, int, float, float, float, float]:
    """Rows, columns, first column's x, first (northern) row's y, cell size and no-data value of an ASCII grid.

    The six header lines are taken in their order; the corner is moved to the
    centre of the upper left cell where the header names a corner.
    """
    lines = content.split(b"\n", 6)[:6]
    keys = [v.split()[0].decode().lower() for v in lines]
    nx, ny, x, y, size, nodata = (v.split()[1].decode() for v in lines)
    half = 0.5 if "corner" in keys[2] else 0.0
    d = float(size)
    return int(ny), int(nx), float(x) + half * d, float(y) + half * d + (int(ny) - 1) * d, d, float(nodata)


def read_asc_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headers of ASCII grids, one row a file."""

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(name, *asc_header(content))], columns=["path", "ny", "nx", "x0", "y0", "dxy", "nodata"])

    return _parse(spark, path, HEADER, parse)


def read_asc(spark: SparkSession, path: str | list[str], rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Cells ``path, sind, iy, ix, z`` of ASCII grids, null without data; only a window of rows and columns if given."""

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        ny, nx, _, _, _, nodata = asc_header(content)
        r0, r1 = rows or (0, ny)
        c0, c1 = cols or (0, nx)
        r1, c1 = min(r1, ny), min(c1, nx)
        body = content.split(b"\n", 6)[6].split(b"\n")
        for at in range(r0, r1, 1000):
            part = [np.array(body[r].split()[c0:c1], dtype=float) for r in range(at, min(at + 1000, r1))]
            z = np.concatenate(part) if part else np.empty(0)
            iy, ix = np.repeat(np.arange(at, at + len(part)), c1 - c0), np.tile(np.arange(c0, c1), len(part))
            z = np.where(np.isnan(z) | (z == nodata), np.nan, z)
            yield pd.DataFrame({"path": name, "sind": iy * nx + ix, "iy": iy, "ix": ix, "z": z})

    out = _parse(spark, path, "path string, sind long, iy long, ix long, z double", parse)
    return out.withColumn("z", mask_nodata(F.col("z")))


def write_asc(cells: DataFrame, path: str, ny: int, nx: int, x0: float, y0: float, dxy: float, nodata: float = -9999.0) -> None:
    """One ASCII grid; rows are put together as text and written in order."""
    text = cells.groupBy("iy").agg(F.array_sort(F.collect_list(F.struct("ix", "z"))).alias("v")).select(
        "iy", F.array_join(F.transform("v", lambda v: F.coalesce(v["z"].cast("string"), F.lit(str(nodata)))), " ").alias("value")
    )
    head = [f"ncols {nx}", f"nrows {ny}", f"xllcenter {x0}", f"yllcenter {y0 - (ny - 1) * dxy}", f"cellsize {dxy}", f"nodata_value {nodata}"]
    spark = cells.sparkSession
    top = spark.createDataFrame([(i - 6, v) for i, v in enumerate(head)], "iy long, value string")
    top.unionByName(text).orderBy("iy").select("value").coalesce(1).write.mode("overwrite").text(path)


#: TIFF tags and sample types that the reader knows (fixed values).
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strips", 277: "samples", 278: "rows", 279: "counts",
         322: "tile_w", 323: "tile_h", 324: "tiles", 325: "tile_counts", 339: "format", 317: "predictor", 33550: "scale", 33922: "tie", 34264: "matrix", 42113: "nodata"}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def tiff_tags(content: bytes) -> tuple[str, dict]:
    """Byte order and the known tags of the first image."""
    order = "<" if content[:2] == b"II" else ">"
    if struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", content[4:8])[0]
    found = {}
    for i in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * i : at + 10 + 12 * i])
        if tag not in _TAGS or kind not in _TYPES:
            continue
        code = _TYPES[kind]
        size = 1 if kind == 2 else struct.calcsize(code)
        raw = content[at + 10 + 12 * i : at + 14 + 12 * i]
        if size * n > 4:
            start = struct.unpack(order + "I", raw)[0]
            raw = content[start : start + size * n]
        found[_TAGS[tag]] = raw[:n].rstrip(b"\0").decode() if kind == 2 else struct.unpack(order + code * n, raw[: size * n])
    return order, found


def decode_tiff(content: bytes) -> tuple[np.ndarray, dict]:
    """First band and placing of an unrotated TIFF, plain or deflated, in strips or tiles."""
    order, t = tiff_tags(content)
    w, h = t["width"][0], t["height"][0]
    bits, fmt, comp = t.get("bits", (8,))[0], t.get("format", (1,))[0], t.get("compression", (1,))[0]
    if t.get("samples", (1,))[0] != 1 or t.get("predictor", (1,))[0] != 1 or comp not in (1, 8, 32946):
        raise ValueError("this kind of TIFF is not supported")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[fmt] + str(bits // 8))
    unpack = (lambda b: b) if comp == 1 else zlib.decompress
    out = np.empty((h, w), kind)
    if "tiles" in t:
        tw, th = t["tile_w"][0], t["tile_h"][0]
        across = -(-w // tw)
        for k, (start, n) in enumerate(zip(t["tiles"], t["tile_counts"], strict=True)):
            y, x = k // across * th, k % across * tw
            block = np.frombuffer(unpack(content[start : start + n]), kind)[: tw * th].reshape(th, tw)
            out[y : y + th, x : x + tw] = block[: h - y, : w - x]
    else:
        rows = t.get("rows", (h,))[0]
        for k, (start, n) in enumerate(zip(t["strips"], t["counts"], strict=True)):
            y = k * rows
            m = min(rows, h - y)
            out[y : y + m] = np.frombuffer(unpack(content[start : start + n]), kind)[: m * w].reshape(m, w)
    scale, tie = t.get("scale", (1.0, 1.0, 0.0)), t.get("tie", (0.0,) * 6)
    place = {"dx": scale[0], "dy": scale[1], "ulx": tie[3] - tie[0] * scale[0], "uly": tie[4] + tie[1] * scale[1], "nodata": float(t["nodata"]) if "nodata" in t else None}
    return out, place


def encode_tiff(z: np.ndarray, ulx: float, uly: float, dxy: float, nodata: float | None = None, deflate: bool = True, strip: int | None = None) -> bytes:
    """TIFF of doubles with its placing, in strips of ``strip`` rows or in one."""
    rows = strip or max(1, z.shape[0])
    parts = [z[at : at + rows].astype("<f8").tobytes() for at in range(0, max(1, z.shape[0]), rows)]
    parts = [zlib.compress(p) for p in parts] if deflate else parts
    body = b"".join(parts)
    starts = [8 + sum(len(p) for p in parts[:k]) for k in range(len(parts))]
    extra, entries, at = b"", [], 8 + len(body) + (len(body) & 1)

    def entry(tag: int, kind: int, values) -> None:
        nonlocal extra
        raw = values if kind == 2 else struct.pack("<" + _TYPES[kind] * len(values), *values)
        entries.append((tag, kind, len(values), raw))

    entry(256, 4, [z.shape[1]])
    entry(257, 4, [z.shape[0]])
    entry(258, 3, [64])
    entry(259, 3, [8 if deflate else 1])
    entry(273, 4, starts)
    entry(277, 3, [1])
    entry(278, 4, [rows])
    entry(279, 4, [len(p) for p in parts])
    entry(339, 3, [3])
    entry(33550, 12, [dxy, dxy, 0.0])
    entry(33922, 12, [0.0, 0.0, 0.0, ulx, uly, 0.0])
    if nodata is not None:
        entry(42113, 2, str(nodata).encode() + b"\0")
    table, start = struct.pack("<H", len(entries)), at + 2 + 12 * len(entries) + 4
    for tag, kind, n, raw in entries:
        if len(raw) > 4:
            table += struct.pack("<HHII", tag, kind, n, start + len(extra))
            extra += raw + b"\0" * (len(raw) & 1)
        else:
            table += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) & 1) + table + b"\0\0\0\0" + extra


def read_tiff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells ``path, iy, ix, x, y, z`` of TIFF grids with the coordinates of cell centres."""

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        z, p = decode_tiff(content)
        z = z.astype(float)
        if p["nodata"] is not None:
            z = np.where(z == p["nodata"], np.nan, z)
        for at in range(0, z.shape[0], 1000):
            part = z[at : at + 1000]
            iy, ix = np.indices(part.shape)
            iy = iy + at
            yield pd.DataFrame({
                "path": name, "iy": iy.ravel(), "ix": ix.ravel(), "x": p["ulx"] + (ix.ravel() + 0.5) * p["dx"],
                "y": p["uly"] - (iy.ravel() + 0.5) * p["dy"], "z": part.ravel(),
            })

    out = _parse(spark, path, "path string, iy long, ix long, x double, y double, z double", parse)
    return out.withColumn("z", mask_nodata(F.col("z")))


def read_tiff_boxes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Outer edges ``path, x0, y0, x1, y1`` of TIFF grids from their tags alone."""

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        _, t = tiff_tags(content)
        s, tie = t["scale"], t["tie"]
        x0, y1 = tie[3] - tie[0] * s[0], tie[4] + tie[1] * s[1]
        yield pd.DataFrame([(name, x0, y1 - t["height"][0] * s[1], x0 + t["width"][0] * s[0], y1)], columns=["path", "x0", "y0", "x1", "y1"])

    return _parse(spark, path, "path string, x0 double, y0 double, x1 double, y1 double", parse)


#: Lines of a file that are put in order together.
LINE_CHUNK = 8192


def _ranked(rows: DataFrame) -> DataFrame:
    """``line_id``: place from 0 of every row among those of its file by line ``n``; only counts a chunk of lines are put in order."""
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("path", "chunk").agg(F.count(F.lit(1)).alias("size"))
    base = cut(sizes.select("path", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "map-base")
    here = F.row_number().over(Window.partitionBy("path", "chunk").orderBy("n")) - 1
    return rows.withColumn("line_id", here).join(F.broadcast(base), ["path", "chunk"]).withColumn("line_id", F.col("line_id") + F.col("base")).drop("base")


def read_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Vertices ``path, kind, line_id, vid, x, y, z`` of map files: arcs (end nodes included) and detached points.

    A file that states a coordinate system other than WGS 84 is refused. Lines
    are dealt by chunks, each knowing the last block that opened before it; an arc is one row.
    """
    w = F.split(F.btrim("value", F.lit(" \t\r\x0b\x0c")), r"\s+")
    key = F.when(w[0].startswith("COV_WKT") & ~F.contains("value", F.lit("WGS")), F.raise_error(F.lit("only WGS 84 maps are read"))).otherwise(w[0])
    lines = numbered_lines(spark, path).select("path", "n", F.floor(F.col("n") / LINE_CHUNK).alias("chunk"), w.alias("w"), key.alias("key")).filter("key != ''")
    mark = F.when(F.col("key").isin("NODE", "POINT", "ARC", "END"), F.struct("n", "key"))
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = lines.groupBy("path", "chunk").agg(F.max(mark).alias("mark"))
    carried = cut(last.select("path", "chunk", F.max("mark").over(before).alias("carried")), "map-marks")
    earlier = Window.partitionBy("path", "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    within = lines.withColumn("prev", F.last(mark, ignorenulls=True).over(earlier)).join(F.broadcast(carried), ["path", "chunk"])
    # An END line belongs to the block that it closes; lines behind it belong to none.
    opened = F.when(F.col("key") != "END", mark)
    block = F.coalesce(opened, "prev", "carried")
    # Other words than numbers lie between an arc's first line and its vertices.
    num = lambda i: F.get("w", F.lit(i)).try_cast("double")
    known = F.col("key").isin("NODE", "POINT", "ARC", "END", "COORD_SYS", "NODES", "ARCVERTICES", "XY", "ID") | F.col("key").startswith("COV_WKT")
    count = lambda i: F.get("w", F.lit(i)).cast("long")
    spot = lambda at: F.struct("n", *[num(at + i).alias(c) for i, c in enumerate("xyz")])
    rows = within.select("path", "n", "chunk", "w", "key", block.alias("block")).filter("block.key != 'END'").select(
        "path", "n", "chunk", "key", F.col("block.n").alias("open"), F.col("block.key").alias("kind"),
        F.when(F.col("key").isin("NODES", "ARCVERTICES", "ID"), count(1)).alias("one"), F.when(F.col("key") == "NODES", count(2)).alias("two"),
        F.when(F.col("key") == "XY", spot(1)).when((F.col("block.key") == "ARC") & ~known, spot(0)).alias("spot"),
    )
    rows = cut(rows, "map-lines")
    only = lambda key, c: F.max(F.when(F.col("key") == key, F.col(c)))
    nodes = rows.filter("kind = 'NODE'").groupBy("path", "open").agg(only("ID", "one").alias("id"), only("XY", "spot").alias("p"))
    nodes = nodes.filter("id is not null").groupBy("path", "id").agg(F.max_by("p", "open").alias("p"))
    arcs = rows.filter("kind = 'ARC'").groupBy("path", F.col("open").alias("n")).agg(
        only("NODES", "one").alias("from"), only("NODES", "two").alias("to"), only("ARCVERTICES", "n").alias("start"), only("ARCVERTICES", "one").alias("size"),
        F.collect_list(F.when(F.col("key") != "XY", F.col("spot"))).alias("v"), F.max(F.col("key") == "END").alias("closed"),
    ).filter("closed").withColumn("chunk", F.floor(F.col("n") / LINE_CHUNK))
    arcs = _ranked(cut(arcs, "map-arcs"))
    for end in ("from", "to"):
        at = nodes.select("path", F.col("id").alias(end), F.col("p").alias(f"{end}_p"))
        arcs = arcs.join(at, ["path", end], "left")
    given = lambda v: F.coalesce(v, F.raise_error(F.lit("a coordinate is missing or no number")))
    place = lambda v: F.struct(*[given(v[c]).alias(c) for c in "xyz"])
    tip = lambda c: place(F.coalesce(F.col(c), F.raise_error(F.lit("an arc names a node that the map lacks"))))
    inner = F.slice(F.array_sort(F.filter("v", lambda v: v["n"] > F.col("start"))), 1, F.col("size").cast("int"))
    inner = F.coalesce(F.transform(inner, place), F.expr("cast(array() as array<struct<x:double,y:double,z:double>>)"))
    chain = arcs.select("path", "line_id", F.posexplode(F.concat(F.array(tip("from_p")), inner, F.array(tip("to_p")))).alias("vid", "p"))
    points = _ranked(rows.filter("kind = 'POINT' and key = 'XY'").select("path", "n", "chunk", F.col("spot").alias("p"))).withColumn("vid", F.lit(0))
    vertex = lambda df, kind: df.select("path", F.lit(kind).alias("kind"), "line_id", F.col("vid").cast("long").alias("vid"), *[given(F.col(f"p.{c}")).alias(c) for c in "xyz"])
    return vertex(chain, "arc").unionByName(vertex(points, "point"))


#: First lines of a map file (fixed format).
_MAP_HEAD = ["MAP VERSION 8", "BEGCOV", 'COVNAME "default coverage"', "COVELEV 0.0", "COVID 1", 'COVGUID 57a1fdc1-d908-44d3-befe-8785288e69e7', "COVATTS VISIBLE 1",
             'COV_WKT GEOGCS["GCS_WGS_1984",DATUM["WGS_1984",SPHEROID["WGS84",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.01745329251994328]]END_COV_WKT']


def write_map(lines: DataFrame, path: str) -> None:
    """Arcs ``line_id, vid, x, y, z`` as one map file: end nodes numbered from 1, then arcs in order of their id."""
    spark = lines.sparkSession
    arcs = lines.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("v")).filter(F.size("v") >= 2)
    from ..operators.flow import rank_watersheds

    order = rank_watersheds(arcs.select(F.col("line_id").alias("sind"), F.col("line_id").alias("outlet"), (-F.col("line_id")).alias("acc")))
    arcs = cut(arcs.join(order.select(F.col("outlet").alias("line_id"), "seg"), "line_id"), "map")
    spot = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string"))
    node = lambda p, n: F.concat(F.lit("NODE\nXY "), spot(p), F.lit("\nID "), n.cast("string"), F.lit("\nEND"))
    first, last = F.col("v")[0], F.element_at("v", -1)
    nodes = arcs.select(F.lit(1).alias("part"), "seg", F.concat(node(first, F.col("seg") * 2 - 1), F.lit("\n"), node(last, F.col("seg") * 2)).alias("value"))
    inner = F.slice("v", 2, F.greatest(F.size("v") - 2, F.lit(0)))
    body = arcs.select(
        F.lit(2).alias("part"), "seg",
        F.concat(
            F.lit("ARC\nID "), F.col("seg").cast("string"), F.lit("\nARCELEVATION 0.0\nNODES "), (F.col("seg") * 2 - 1).cast("string"), F.lit(" "),
            (F.col("seg") * 2).cast("string"),
            F.when(F.size("v") > 2, F.concat(F.lit("\nARCVERTICES "), (F.size("v") - 2).cast("string"), F.lit("\n"), F.array_join(F.transform(inner, spot), "\n"))).otherwise(""),
            F.lit("\nDISTNODE 0\nNODETYPE 0\nARCBIAS 1\nMERGED 0 0 0 0\nEND"),
        ).alias("value"),
    )
    head = spark.createDataFrame([(0, i, v) for i, v in enumerate(_MAP_HEAD)] + [(3, 0, "ENDCOV"), (3, 1, "BEGTS"), (3, 2, "LEND")], "part int, seg long, value string")
    head.unionByName(nodes).unionByName(body).orderBy("part", "seg").select("value").coalesce(1).write.mode("overwrite").text(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, n, value``: lines of text files with their place from 0; a file is read by blocks in many tasks.

    Lines are counted a block, so only one row a block is put in order.
    """
    lines = cut(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    ), "lines")
    blocks = lines.groupBy("path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("path", "start", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return lines.join(F.broadcast(base), ["path", "start"]).select("path", (F.col("at") + F.col("base")).alias("n"), "value")


def read_gr3(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node_id, x, y, dp`` and elements ``elem_id, i34, n1..n4`` of a mesh file (ids from 1; -2 for no corner)."""
    rows = numbered_lines(spark, path).withColumn("w", F.split(F.btrim("value", F.lit(" \t\r\x0b\x0c")), r"\s+"))
    num = lambda i, t: F.get("w", F.lit(i)).cast(t)
    # One row a file; written, since null checks of the sizes would else be made on every line.
    sizes = cut(rows.filter("n = 1").select("path", num(0, "long").alias("ne"), num(1, "long").alias("np")), "mesh-sizes")
    rows = rows.filter("n > 1").join(F.broadcast(sizes), "path")
    elems = rows.filter((F.col("n") >= F.col("np") + 2) & (F.col("n") < F.col("np") + F.col("ne") + 2))
    corner = lambda k: F.when(num(1, "int") >= k, F.coalesce(num(k + 1, "long"), F.lit(-2))).otherwise(-2).cast("long")
    return (
        rows.filter(F.col("n") < F.col("np") + 2).select(num(0, "long").alias("node_id"), num(1, "double").alias("x"), num(2, "double").alias("y"), num(3, "double").alias("dp")),
        elems.select(num(0, "long").alias("elem_id"), num(1, "int").alias("i34"), *[corner(k).alias(f"n{k}") for k in (1, 2, 3, 4)]),
    )


def write_gr3(nodes: DataFrame, elems: DataFrame, path: str, title: str = "mesh") -> None:
    """One mesh file with nodes and elements in order of their ids."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, 0, title), (0, 1, f"{elems.count()} {nodes.count()}")], "part int, k long, value string")
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("node_id", "x", "y", "dp")]).alias("value"))
    corners = F.filter(F.array("n1", "n2", "n3", "n4"), lambda v: v >= 0)
    e = elems.select(F.lit(2).alias("part"), F.col("elem_id").alias("k"), F.concat_ws(" ", F.col("elem_id").cast("string"), F.col("i34").cast("string"), F.array_join(corners, " ")).alias("value"))
    head.unionByName(n).unionByName(e).orderBy("part", "k").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_2dm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and elements of a 2dm mesh, by its ND, E3T and E4Q lines."""
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(w.alias("w"))
    num = lambda i, t: F.get("w", F.lit(i)).cast(t)
    nodes = rows.filter(F.col("w")[0] == "ND").select(num(1, "long").alias("node_id"), num(2, "double").alias("x"), num(3, "double").alias("y"), num(4, "double").alias("dp"))
    elems = rows.filter(F.col("w")[0].isin("E3T", "E4Q")).select(
        num(1, "long").alias("elem_id"), F.when(F.col("w")[0] == "E4Q", 4).otherwise(3).alias("i34"), *[num(i + 1, "long").alias(f"n{i}") for i in (1, 2, 3)],
        F.when(F.col("w")[0] == "E4Q", num(5, "long")).otherwise(F.lit(-2).cast("long")).alias("n4"),
    )
    return nodes, elems


#: Shape kinds whose vertices are read, with whether z values follow (fixed values).
_SHAPES = {3: False, 5: False, 13: True, 15: True}
#: Vertices of shape files after which a batch of rows goes on to Spark.
SHAPE_BATCH = 1 << 16


def read_shp(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Vertices ``path, line_id, part, vid, x, y, z`` of line and polygon shape files, z 0 where absent.

    Null shapes are refused, as are lines of several parts.
    """

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        at, i, held, found = 100, 0, 0, []

        def frame() -> pd.DataFrame:
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 6
            return pd.DataFrame({"path": name, **dict(zip(("line_id", "part", "vid", "x", "y", "z"), cols, strict=True))})

        while at < len(content):
            size = struct.unpack(">I", content[at + 4 : at + 8])[0] * 2
            rec = content[at + 8 : at + 8 + size]
            kind = struct.unpack("<i", rec[:4])[0]
            if kind not in _SHAPES:
                raise ValueError(f"record {i} has shape type {kind}")
            parts, n = struct.unpack("<ii", rec[36:44])
            if parts > 1 and kind in (3, 13):
                raise ValueError(f"record {i} has several parts")
            starts = np.array([*struct.unpack(f"<{parts}i", rec[44 : 44 + 4 * parts]), n])
            p0 = 44 + 4 * parts
            xy = np.frombuffer(rec[p0 : p0 + 16 * n], "<f8").reshape(n, 2)
            z = np.frombuffer(rec[p0 + 16 * n + 16 : p0 + 24 * n + 16], "<f8") if _SHAPES[kind] else np.zeros(n)
            sizes = np.diff(starts)
            part, first = np.repeat(np.arange(parts), sizes), np.repeat(starts[:-1], sizes)
            mine = np.arange(starts[0], n)
            found.append((np.full(len(mine), i), part, mine - first, xy[mine, 0], xy[mine, 1], z[mine]))
            at, i, held = at + 8 + size, i + 1, held + len(mine)
            if held >= SHAPE_BATCH:
                yield frame()
                held, found = 0, []
        yield frame()

    return _parse(spark, path, "path string, line_id long, part int, vid long, x double, y double, z double", parse)


def encode_shp(lines: list[np.ndarray], kind: int = 13) -> bytes:
    """Shape file bytes of lines with z (kind 13), for exports of a size that one file holds."""
    parts = []
    for i, v in enumerate(lines):
        n = len(v)
        box = struct.pack("<4d", v[:, 0].min(), v[:, 1].min(), v[:, 0].max(), v[:, 1].max())
        body = struct.pack("<i", kind) + box + struct.pack("<iii", 1, n, 0) + v[:, :2].astype("<f8").tobytes()
        body += struct.pack("<2d", v[:, 2].min(), v[:, 2].max()) + v[:, 2].astype("<f8").tobytes()
        parts.append(struct.pack(">II", i + 1, len(body) // 2) + body)
    recs = b"".join(parts)
    every = np.concatenate(lines) if lines else np.zeros((1, 3))
    ext = struct.pack("<8d", every[:, 0].min(), every[:, 1].min(), every[:, 0].max(), every[:, 1].max(), every[:, 2].min(), every[:, 2].max(), 0.0, 0.0)
    return struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(recs)) // 2) + struct.pack("<ii", 1000, kind) + ext + recs


def read_quad_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the POLYGON ... END blocks of a map that hold a PATCH line: ``block, k, value``."""

    def parse(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows, block, count = [], None, 0
        for line in content.decode().splitlines():
            key = line.strip()
            if key == "POLYGON":
                block = []
            if block is not None:
                block.append(line)
                if key == "END":
                    if any(v.startswith("PATCH") for v in block):
                        rows += [(count, k, v) for k, v in enumerate(block)]
                        count += 1
                    block = None
        yield pd.DataFrame(rows, columns=["block", "k", "value"])

    return _parse(spark, path, "block long, k int, value string", parse)


def save_variables(path: str, **tables: DataFrame) -> None:
    """Named tables as Parquet directories below a path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_variables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Named tables that :func:`save_variables` wrote."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def merge_maps(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Arcs of several maps in one table; ``map_id`` tells them apart."""
    out = first.withColumn("map_id", F.lit(0))
    for i, df in enumerate(others):
        out = out.unionByName(df.withColumn("map_id", F.lit(i + 1)))
    return out
