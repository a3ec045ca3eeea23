import struct
import zlib

import numpy as np
import pytest

from fluvial.sources import files as fs
from fluvial.sources import rasters as rs


def pack_lzw(data):
    """LZW with codes of 9 to 12 bits, highest bit first."""
    table, codes, width, now = {bytes([i]): i for i in range(256)}, [(256, 9)], 9, b""
    size = 258
    for byte in data:
        more = now + bytes([byte])
        if more in table:
            now = more
            continue
        codes.append((table[now], width))
        table[more], size = size, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            codes.append((256, width))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        now = bytes([byte])
    if now:
        codes.append((table[now], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiff(z, block, tiled=False, compression=8, predictor=1, matrix=None, nodata=None, order="<"):
    """A TIFF of the array's own type, in strips of ``block`` rows or tiles of ``block`` squared."""
    kind = z.dtype.newbyteorder(order)
    h, w = (block, block) if tiled else (block, z.shape[1])
    parts = []
    for y in range(0, z.shape[0], h):
        for x in range(0, z.shape[1], w):
            part = z[y : y + h, x : x + w]
            if tiled:
                whole = np.zeros((h, w), z.dtype)
                whole[: part.shape[0], : part.shape[1]] = part
                part = whole
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), z.dtype))
            raw = part.astype(kind).tobytes()
            if predictor == 3:
                size = z.dtype.itemsize
                planes = np.frombuffer(part.astype(z.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(len(part), part.shape[1], size).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
            parts.append({1: lambda b: b, 5: pack_lzw, 8: zlib.compress}[compression](raw))
    starts = [8 + sum(map(len, parts[:k])) for k in range(len(parts))]
    body = b"".join(parts)
    code = {"u": 1, "i": 2, "f": 3}[z.dtype.kind]
    tags = [(256, 4, [z.shape[1]]), (257, 4, [z.shape[0]]), (258, 3, [8 * z.dtype.itemsize]), (259, 3, [compression])]
    tags += [] if tiled else [(273, 4, starts)]
    tags += [(277, 3, [1])] + ([] if tiled else [(278, 4, [block]), (279, 4, [len(p) for p in parts])]) + [(317, 3, [predictor])]
    tags += [(322, 4, [block]), (323, 4, [block]), (324, 4, starts), (325, 4, [len(p) for p in parts])] if tiled else []
    tags += [(339, 3, [code])] + ([(34264, 12, matrix)] if matrix else [(33550, 12, [0.5, 0.25, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 50.0, 0.0])])
    tags += [(42113, 2, str(nodata).encode() + b"\0")] if nodata is not None else []
    at = 8 + len(body)
    extra, entries, rest = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind_, values in sorted(tags):
        raw = values if kind_ == 2 else struct.pack(order + fs._TYPES[kind_] * len(values), *values)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", rest + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, kind_, len(values)) + field
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + extra


KINDS = [
    dict(), dict(compression=1), dict(compression=5), dict(tiled=True), dict(tiled=True, compression=5, order=">"), dict(predictor=3), dict(predictor=3, tiled=True, compression=1, order=">"),
]


@pytest.mark.parametrize("kind", range(len(KINDS) + 2))
def test_kinds_of_rasters(spark, tmp_path, kind):
    rng = np.random.default_rng(kind)
    z = (rng.integers(-50, 50, (37, 29)) / 4).astype(np.float32) if kind < len(KINDS) else rng.integers(-500, 500, (37, 29)).astype(np.int16)
    z[5, 7] = -99
    more = KINDS[kind] if kind < len(KINDS) else dict(predictor=2, tiled=kind > len(KINDS))
    (tmp_path / "a.tif").write_bytes(tiff(z, 8, nodata=-99, **more))
    got = {(r.iy, r.ix): r for r in rs.read_raster(spark, str(tmp_path / "a.tif")).collect()}
    assert len(got) == 37 * 29 and got[5, 7].z is None
    assert all(r.z == (None if z[k] == -99 else z[k]) for k, r in got.items())
    assert (got[0, 0].x, got[0, 0].y, got[36, 28].x, got[36, 28].y) == (10.25, 49.875, 24.25, 40.875)


def test_a_window_reads_its_blocks_only(spark, tmp_path):
    rng = np.random.default_rng(1)
    z = rng.random((400, 300))
    path = str(tmp_path / "w.tif")
    for tiled, n in ((False, 2), (True, 2 * 3)):
        (tmp_path / "w.tif").write_bytes(tiff(z, 16, tiled=tiled, compression=1))
        blocks = rs.raster_blocks(spark, path, (100, 120), (40, 70)).toPandas()
        assert len(blocks) == n and blocks["size"].sum() < 0.1 * z.nbytes
        got = {(r.iy, r.ix): r.z for r in rs.read_raster(spark, path, (100, 120), (40, 70)).collect()}
        assert got == {(i, j): z[i, j] for i in range(100, 120) for j in range(40, 70)}
        # What a task reads of the file: the directory, then the blocks.
        with rs.RangedFile(path) as f:
            order, t = rs.read_tags(f)
            head = f.read_bytes
            for b in rs.blocks_of(order, t, (100, 120), (40, 70)):
                f.read(b["at"], b["size"])
            assert f.read_bytes == head + blocks["size"].sum() and head < 10_000
        header = rs.read_headers(spark, path).first()
        assert header.header_bytes == head and (header.ny, header.nx, header.blocks) == (400, 300, 25 if not tiled else 25 * 19)
    assert rs.read_raster(spark, path, (390, 500), (290, 999)).count() == 100
    assert rs.read_raster(spark, path, (500, 600)).count() == 0


def test_boxes_matrix_and_refusals(spark, tmp_path):
    z = np.ones((4, 6), np.float32)
    (tmp_path / "m.tif").write_bytes(tiff(z, 4, matrix=[2.0, 0, 0, 7.0, 0, -3.0, 0, 9.0, 0, 0, 1, 0, 0, 0, 0, 1]))
    b = rs.raster_boxes(spark, str(tmp_path / "m.tif")).first()
    assert (b.x0, b.y0, b.x1, b.y1) == (7.0, -3.0, 19.0, 9.0)
    (tmp_path / "r.tif").write_bytes(tiff(z, 4, matrix=[2.0, 1.0, 0, 7.0, 1.0, -3.0, 0, 9.0, 0, 0, 1, 0, 0, 0, 0, 1]))
    with pytest.raises(Exception, match="rotated"):
        rs.read_headers(spark, str(tmp_path / "r.tif")).collect()
    (tmp_path / "n.tif").write_bytes(b"no tiff here")
    with pytest.raises(Exception, match="not a classic TIFF"):
        rs.read_headers(spark, str(tmp_path / "n.tif")).collect()


def test_written_tiles_are_read_back(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, None if (i + j) % 9 == 0 else i * 100.0 + j) for i in range(25) for j in range(18)], "iy long, ix long, z double")
    names = rs.write_rasters(cells, str(tmp_path / "t"), 10, -90.0, 30.0, 0.5, strip=4).collect()
    assert len(names) == 6
    got = {(r.x, r.y): r.z for r in rs.read_raster(spark, str(tmp_path / "t" / "*.tif")).collect()}
    assert got == {(-90 + j * 0.5, 30 - i * 0.5): None if (i + j) % 9 == 0 else i * 100.0 + j for i in range(25) for j in range(18)}
