"""Column functions: projections, codecs, geometry and hydraulic formulas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the work plane's sphere in metres (fixed value).
EARTH_RADIUS = 6378206.4


def lonlat_to_plane(lon: Column, lat: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Plane in metres, longitude counted from ``lon0`` and not scaled by latitude."""
    return F.lit(EARTH_RADIUS) * (F.radians(lon) - F.radians(F.lit(lon0))), F.lit(EARTH_RADIUS) * F.radians(lat)


def plane_to_lonlat(x: Column, y: Column, lon0: float = 0.0, lat0: float = 0.0) -> tuple[Column, Column]:
    """Longitude and latitude of a plane point; ``lat0`` is the latitude of true scale (0 inverts :func:`lonlat_to_plane`)."""
    return (
        F.degrees(F.radians(F.lit(lon0)) + x / F.lit(EARTH_RADIUS) / F.cos(F.radians(F.lit(lat0)))),
        F.degrees(y / F.lit(EARTH_RADIUS)),
    )


def length_to_degrees(d: Column, lat: Column) -> Column:
    """Length on the plane in degrees of longitude at a latitude."""
    return d / F.lit(EARTH_RADIUS) / F.cos(F.radians(lat)) * F.degrees(F.lit(1.0))


def degrees_to_length(d: Column, lat: Column) -> Column:
    """Degrees of longitude at a latitude as length on the plane."""
    return F.radians(d) * F.lit(EARTH_RADIUS) * F.cos(F.radians(lat))


#: Semi-major axis in metres and flattening of the WGS 84 ellipsoid (fixed values).
WGS84 = (6378137.0, 1 / 298.257223563)


def _series(ellipsoid: tuple[float, float]) -> tuple[float, float, tuple, tuple, tuple]:
    """Third flattening, rectifying radius and the coefficients of Krueger's series to its third power: forward, inverse, latitude."""
    a, f = ellipsoid
    n = f / (2 - f)
    return (
        n, a / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240),
        (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480),
        (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15),
    )


def lonlat_to_tm(
    lon: Column, lat: Column, lon0: float, k0: float = 0.9996, east: float = 500000.0, north: float = 0.0, ellipsoid: tuple[float, float] = WGS84,
) -> tuple[Column, Column]:
    """Transverse Mercator coordinates in metres around the meridian ``lon0``; the defaults are those of a UTM zone.

    True to millimetres within a zone. A null in either gives nulls.
    """
    n, radius, alpha, _, _ = _series(ellipsoid)
    e = 2 * n**0.5 / (1 + n)
    sin = F.sin(F.radians(lat))
    dl = F.radians(lon - F.lit(lon0))
    t = F.sinh(F.atanh(sin) - F.lit(e) * F.atanh(F.lit(e) * sin))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x, y = x + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(east) + F.lit(k0 * radius) * x, F.lit(north) + F.lit(k0 * radius) * y


def tm_to_lonlat(
    x: Column, y: Column, lon0: float, k0: float = 0.9996, east: float = 500000.0, north: float = 0.0, ellipsoid: tuple[float, float] = WGS84,
) -> tuple[Column, Column]:
    """Longitude and latitude of transverse Mercator coordinates, the inverse of :func:`lonlat_to_tm`."""
    _, radius, _, beta, delta = _series(ellipsoid)
    xi, eta = (y - F.lit(north)) / F.lit(k0 * radius), (x - F.lit(east)) / F.lit(k0 * radius)
    u, v = xi, eta
    for j, c in enumerate(beta, 1):
        u, v = u - F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta), v - F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + F.lit(c) * F.sin(2 * j * chi)
    return F.lit(lon0) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def utm_zone(lon: Column) -> Column:
    """Zone from 1 to 60 of a longitude; its meridian is ``6 * zone - 183``."""
    return F.pmod(F.floor((lon + 180) / 6), F.lit(60)).cast("int") + 1


def unit_vector(x: Column, y: Column) -> tuple[Column, Column]:
    n = F.sqrt(x * x + y * y)
    return x / n, y / n


def corner_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle abc in degrees, from 0 up to 360."""
    a = F.degrees(F.atan2(cy - by, cx - bx) - F.atan2(ay - by, ax - bx))
    return F.when(a < 0, a + 360.0).otherwise(a)


def turns_left(ax, ay, bx, by, cx, cy) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Strict crossing of ab and cd; touching in a straight line does not count."""
    return (turns_left(ax, ay, cx, cy, dx, dy) != turns_left(bx, by, cx, cy, dx, dy)) & (
        turns_left(ax, ay, bx, by, cx, cy) != turns_left(ax, ay, bx, by, dx, dy)
    )


def arcs_for_width(width: Column, least: int = 3, option: str = "regular", custom: Callable[[Column], Column] | None = None) -> Column:
    """Number of arcs across a channel of a width.

    ``custom`` maps a width column to a number; the result is its whole part,
    at least ``least``.
    """
    if custom is not None:
        return F.greatest(F.lit(least), custom(width).cast("int"))
    if option == "regular":
        return F.when(width < 30, F.lit(least)).otherwise(F.lit(least) + F.ceil(width / 500).cast("int"))
    if option == "insensitive":
        return F.lit(least) + F.floor(F.lit(0.35) * F.pow(width, F.lit(0.25))).cast("int")
    if option == "sensitive":
        return F.lit(least) + F.ceil(width / 100).cast("int")
    raise ValueError(f"unknown option {option!r}")


#: Relative depth positions of an artificial four-arc profile (fixed values).
FAKE_PROFILE = (0.0, 6.75 / 18, 11.25 / 18, 1.0)


def inner_arc_positions(n: Column, kind: str | Callable[[Column], Column] = "regular") -> Column:
    """Positions of ``n`` arcs from bank 0 to bank 1 as an array."""
    if callable(kind):
        return kind(n)
    if kind == "regular":
        return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: i / (n - 1).cast("double"))
    if kind == "fake":
        return F.array(*[F.lit(p) for p in FAKE_PROFILE])
    raise NotImplementedError(kind)


def encode_pieces(pieces: Sequence[Column]) -> Column:
    """Up to six whole numbers from 0 to 99 in one double: their count, then two decimals each.

    A piece out of range gives null.
    """
    if not 1 <= len(pieces) <= 6:
        raise ValueError("one to six pieces")
    ok = pieces[0].between(0, 99)
    for p in pieces[1:]:
        ok = ok & p.between(0, 99)
    digits = F.concat(F.lit(f"{len(pieces)}."), *[F.lpad(p.cast("int").cast("string"), 2, "0") for p in pieces])
    return F.when(ok, digits.cast("double"))


def decode_pieces(z: Column) -> Column:
    """Inverse of :func:`encode_pieces` as an array of int; null unless the count is 1 to 6."""
    n = F.floor(z).cast("int")
    text = F.rint(z * F.pow(F.lit(100.0), n)).cast("decimal(20,0)").cast("string")
    return F.when(n.between(1, 6), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * 2 + 2, F.lit(2)).cast("int")))


def decode_tiles(code: Column, base: int) -> Column:
    """Tile ids packed in one number in base ``base``, first tile lowest; each digit is the id plus 1.

    Code 0 means no tile and gives ``[-1]``; more than four tiles give null.
    """
    size = F.when(code <= 0, F.lit(1)).otherwise(F.floor(F.log(code.cast("double") + 0.5) / F.log(F.lit(float(base)))).cast("int") + 1)
    digit = lambda i: (F.floor(code.cast("decimal(38,0)") / F.pow(F.lit(float(base)), i).cast("decimal(38,0)")) % base).cast("int") - 1
    return F.when(size <= 4, F.transform(F.sequence(F.lit(0), size - 1), digit))


def in_box(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    """Half-open box: above the lower edge, up to and with the upper one."""
    return (x > x0) & (x <= x1) & (y > y0) & (y <= y1)


def nearest_index(v: Column, origin: Column, step: Column) -> Column:
    """Grid index of a coordinate, halves to even."""
    return F.rint((v - origin) / step).cast("long")


def polygon_area(xs: Sequence[Column], ys: Sequence[Column]) -> Column:
    """Signed shoelace area of a ring of given corners."""
    n = len(xs)
    total = F.lit(0.0)
    for i in range(n):
        j = (i + 1) % n
        total = total + (xs[i] * ys[j] - xs[j] * ys[i])
    return total / 2


def skewness(xs: Sequence[Column], ys: Sequence[Column], area: Column) -> Column:
    """Longest side over the radius of the circle of equal area."""
    sides = [F.hypot(xs[i] - xs[i - 1], ys[i] - ys[i - 1]) for i in range(len(xs))]
    return F.greatest(*sides) / F.sqrt(F.greatest(area / F.lit(3.141592653589793), F.lit(1e-20)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment; outside the foot's range, to the nearer end."""
    dx, dy = bx - ax, by - ay
    k = ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy + 1e-20)
    foot = F.hypot(px - (ax + k * dx), py - (ay + k * dy))
    return F.when(k.between(0, 1), foot).otherwise(F.least(F.hypot(px - ax, py - ay), F.hypot(px - bx, py - by)))


def river_cells(area_limit: float, dxy: Column, plane_ratio: float) -> Column:
    """Number of cells that a drainage area takes."""
    return F.lit(area_limit) / F.pow(dxy * plane_ratio, F.lit(2))


def water_level(z: Column, constant: float = 1.0) -> Column:
    """Water level over the thalweg: its elevation plus a constant, not below 0."""
    return F.when(z > 0, z + constant).otherwise(F.greatest(F.lit(0.0), z + constant))


def snap_corner(x: Column, y: Column, per_degree: int = 4) -> tuple[Column, Column]:
    """Upper left corner of the tile that holds a point."""
    return F.floor(x * per_degree) / per_degree, F.ceil(y * per_degree) / per_degree


def offset_point(x: Column, y: Column, angle: Column, distance) -> tuple[Column, Column]:
    """Point at a distance along an angle."""
    return x + F.cos(angle) * distance, y + F.sin(angle) * distance


def nudged_distance(d: Column, low: float, high: float) -> Column:
    """Distance moved into a range."""
    return F.when(d < low, F.lit(float(low))).when(d > high, F.lit(float(high))).otherwise(d)
