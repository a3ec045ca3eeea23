"""Raster files read by ranges: headers alone, then the strips or tiles that a window needs.

A file is never one value: its blocks become rows, are dealt over the tasks,
and each task reads the bytes of its blocks only. Files are opened through
Arrow's file systems (local, HDFS, S3 and others by URI).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _TAGS, _TYPES, encode_shp, encode_tiff

HEADER = "path string, ny long, nx long, ulx double, uly double, dx double, dy double, nodata double, block_h long, block_w long, blocks long, header_bytes long"
BLOCK = (
    "path string, ny long, nx long, ulx double, uly double, dx double, dy double, nodata double, "
    "iy0 long, ix0 long, h long, w long, at long, size long, kind string, compression int, predictor int"
)
CELL = "path string, iy long, ix long, x double, y double, z double"


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and place of a path as Spark writes it, where local ones are ``file:/x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return arrow_fs.FileSystem.from_uri(path)


class RangedFile:
    """Bytes of a file by place, and how many have been read."""

    def __init__(self, path: str) -> None:
        system, name = open_fs(path)
        self._file, self.read_bytes = system.open_input_file(name), 0

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def read(self, at: int, n: int) -> bytes:
        found = self._file.read_at(n, at)
        self.read_bytes += len(found)
        return found


def read_tags(file: RangedFile) -> tuple[str, dict]:
    """Byte order and known tags of a classic TIFF's first image, from its directory alone."""
    head = file.read(0, 8)
    order = "<" if head[:2] == b"II" else ">"
    if len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", head[4:8])[0]
    count = struct.unpack(order + "H", file.read(at, 2))[0]
    entries, found = file.read(at + 2, 12 * count), {}
    for i in range(count):
        tag, kind, n = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
        if tag not in _TAGS or kind not in _TYPES:
            continue
        code, raw = _TYPES[kind], entries[12 * i + 8 : 12 * i + 12]
        size = n if kind == 2 else struct.calcsize(order + code * n)
        if size > 4:
            raw = file.read(struct.unpack(order + "I", raw)[0], size)
        found[_TAGS[tag]] = raw[:n].rstrip(b"\0").decode() if kind == 2 else struct.unpack(order + code * n, raw[:size])
    return order, found


def placing(t: dict) -> dict:
    """Size and place of the image; rotated ones are refused."""
    if "matrix" in t:
        m = t["matrix"]
        if m[1] or m[4]:
            raise ValueError("a rotated raster has no rows and columns of its own")
        scale, ulx, uly = (m[0], -m[5]), m[3], m[7]
    else:
        scale, tie = t.get("scale", (1.0, 1.0, 0.0)), t.get("tie", (0.0,) * 6)
        ulx, uly = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
    return {"ny": t["height"][0], "nx": t["width"][0], "ulx": float(ulx), "uly": float(uly), "dx": float(scale[0]), "dy": float(scale[1]), "nodata": float(t["nodata"]) if t.get("nodata") else None}


def blocks_of(order: str, t: dict, rows: tuple[int, int] | None, cols: tuple[int, int] | None) -> list[dict]:
    """Place in the image and in the file of each strip or tile that meets the window."""
    ny, nx = t["height"][0], t["width"][0]
    bits, fmt, comp = t.get("bits", (8,))[0], t.get("format", (1,))[0], t.get("compression", (1,))[0]
    if t.get("samples", (1,))[0] != 1 or comp not in (1, 5, 8, 32946) or fmt not in (1, 2, 3):
        raise ValueError("this kind of TIFF is not supported")
    kind = order + {1: "u", 2: "i", 3: "f"}[fmt] + str(bits // 8)
    if "tiles" in t:
        h, w = t["tile_h"][0], t["tile_w"][0]
        starts, sizes, across = t["tiles"], t["tile_counts"], -(-nx // w)
    else:
        h, w = min(t.get("rows", (ny,))[0], ny), nx
        starts, sizes, across = t["strips"], t["counts"], 1
    r0, r1 = rows or (0, ny)
    c0, c1 = cols or (0, nx)
    out = []
    for k, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        y, x = k // across * h, k % across * w
        # A strip's last block is as high as what is left; tiles are whole.
        high = h if "tiles" in t else min(h, ny - y)
        if y < min(r1, ny) and y + high > r0 and x < min(c1, nx) and x + w > c0:
            out.append({"iy0": y, "ix0": x, "h": high, "w": w, "at": at, "size": size, "kind": kind, "compression": comp, "predictor": t.get("predictor", (1,))[0]})
    return out


def unpack_lzw(raw: bytes) -> bytes:
    """Bytes of an LZW stream with codes of 9 to 12 bits, highest bit first, each width left one code early."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        found = table[code] if code < len(table) else last + last[:1]
        out += found
        if last is not None:
            table.append(last + found[:1])
        last = found
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decode_block(raw: bytes, b: dict) -> np.ndarray:
    """Values of one strip or tile."""
    kind, h, w = np.dtype(b["kind"]), b["h"], b["w"]
    raw = raw if b["compression"] == 1 else unpack_lzw(raw) if b["compression"] == 5 else zlib.decompress(raw)
    n = h * w * kind.itemsize
    if b["predictor"] == 3:
        # Differences of the bytes of a row, whose highest bytes come first.
        planes = np.cumsum(np.frombuffer(raw[:n], np.uint8).reshape(h, w * kind.itemsize), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(h, kind.itemsize, w).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, w)
    z = np.frombuffer(raw[:n], kind).reshape(h, w)
    if b["predictor"] == 2:
        whole = kind.newbyteorder("=")
        return np.cumsum(z.astype(whole), axis=1, dtype=whole)
    return z


def _paths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # Without the content column the source lists files and opens none.
    return spark.read.format("binaryFile").load(path).select("path")


def read_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header of every raster: size, outer upper left corner, cell size, no-data value, blocks, and the bytes that were read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            rows = []
            for name in names["path"]:
                with RangedFile(name) as f:
                    order, t = read_tags(f)
                    found = blocks_of(order, t, None, None)
                    rows.append({"path": name, **placing(t), "block_h": found[0]["h"], "block_w": found[0]["w"], "blocks": len(found), "header_bytes": f.read_bytes})
            if rows:
                yield pd.DataFrame(rows)

    return _paths(spark, path).mapInPandas(run, HEADER)


def raster_blocks(spark: SparkSession, path: str | list[str], rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """One row a strip or tile that meets the window of rows and columns (end exclusive) of its file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            for name in names["path"]:
                with RangedFile(name) as f:
                    order, t = read_tags(f)
                    found = [{"path": name, **placing(t), **b} for b in blocks_of(order, t, rows, cols)]
                    if found:
                        yield pd.DataFrame(found)

    return _paths(spark, path).mapInPandas(run, BLOCK)


def read_raster(
    spark: SparkSession, path: str | list[str], rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, spread: int | None = None
) -> DataFrame:
    """Cells ``path, iy, ix, x, y, z`` of TIFF rasters with the coordinates of cell centres, null without data.

    Strips or tiles, plain, deflated or LZW, with or without predictor. Only a
    window of rows and columns of each file if given: then only the blocks that
    meet it are read. Blocks are dealt over ``spread`` tasks (by default the
    session's shuffle partitions), so one large file is many tasks' work.
    """
    blocks = raster_blocks(spark, path, rows, cols)
    # By place as well as by file, so that a file's blocks go to many tasks.
    dealt = blocks.repartition(*([spread] if spread else []), "path", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in batches:
            for name, mine in found.groupby("path"):
                with RangedFile(name) as f:
                    for b in mine.to_dict("records"):
                        z = decode_block(f.read(b["at"], b["size"]), b).astype(float)
                        iy, ix = np.indices(z.shape)
                        iy, ix, z = iy.ravel() + b["iy0"], ix.ravel() + b["ix0"], z.ravel()
                        r1, c1 = min(b["ny"], rows[1]) if rows else b["ny"], min(b["nx"], cols[1]) if cols else b["nx"]
                        keep = (iy >= (rows[0] if rows else 0)) & (iy < r1) & (ix >= (cols[0] if cols else 0)) & (ix < c1)
                        iy, ix, z = iy[keep], ix[keep], z[keep]
                        if not np.isnan(b["nodata"]):
                            z = np.where(z == b["nodata"], np.nan, z)
                        for at in range(0, len(z), 1 << 18):
                            s = slice(at, at + (1 << 18))
                            yield pd.DataFrame({"path": name, "iy": iy[s], "ix": ix[s], "x": b["ulx"] + (ix[s] + 0.5) * b["dx"], "y": b["uly"] - (iy[s] + 0.5) * b["dy"], "z": z[s]})

    cells = dealt.withColumn("nodata", F.coalesce("nodata", F.lit(float("nan")))).mapInPandas(run, CELL)
    return cells.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def raster_boxes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Outer edges ``path, x0, y0, x1, y1`` of rasters from their headers alone."""
    h = read_headers(spark, path)
    return h.select("path", F.col("ulx").alias("x0"), (F.col("uly") - F.col("ny") * F.col("dy")).alias("y0"), (F.col("ulx") + F.col("nx") * F.col("dx")).alias("x1"), F.col("uly").alias("y1"))


def write_rasters(cells: DataFrame, folder: str, tile: int, x0: float, y0: float, dxy: float, nodata: float = -9999.0, strip: int = 64) -> DataFrame:
    """One TIFF of ``tile`` by ``tile`` cells a task; ``name, ny, nx`` of the files.

    ``x0, y0`` is the centre of cell (0, 0), rows go south. A file that a lost
    task has left is written again with the same bytes.
    """
    base = cells.select("iy", "ix", F.col("z").cast("double").alias("z"))
    tiled = base.withColumns({"ty": F.floor(F.col("iy") / tile), "tx": F.floor(F.col("ix") / tile)})

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = pdf["iy"].to_numpy() - key[0] * tile, pdf["ix"].to_numpy() - key[1] * tile
        z = np.full((iy.max() + 1, ix.max() + 1), nodata)
        z[iy, ix] = np.where(pdf["z"].isna(), nodata, pdf["z"])
        name = f"r{key[0]}_{key[1]}.tif"
        system, at = open_fs(folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{name}") as out:
            out.write(encode_tiff(z, x0 + (key[1] * tile - 0.5) * dxy, y0 - (key[0] * tile - 0.5) * dxy, dxy, nodata, strip=strip))
        return pd.DataFrame({"name": [name], "ny": [z.shape[0]], "nx": [z.shape[1]]})

    return tiled.groupBy("ty", "tx").applyInPandas(run, "name string, ny long, nx long")


def write_shapes(lines: DataFrame, folder: str, files: int, most: int = 500_000) -> DataFrame:
    """Lines ``line_id, vid, x, y, z`` as shape files, each written by a task of its own; ``name, n_lines``.

    A line is whole in the file that its id falls to. Each of ``files`` is cut
    into as many as keep about ``most`` vertices in one, so that no task holds
    more; reading the folder merges them.
    """
    files *= max(1, -(-lines.count() // (files * most)))
    dealt = lines.select("line_id", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"]).withColumn("k", F.pmod(F.xxhash64("line_id"), F.lit(files)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_id", "vid"], kind="stable")
        shapes = [g[["x", "y", "z"]].to_numpy() for _, g in pdf.groupby("line_id")]
        name = f"lines{key[0]}.shp"
        system, at = open_fs(folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{name}") as out:
            out.write(encode_shp(shapes))
        return pd.DataFrame({"name": [name], "n_lines": [len(shapes)]})

    return dealt.groupBy("k").applyInPandas(run, "name string, n_lines long")
