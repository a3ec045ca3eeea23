"""Spatial joins as equi-joins on grid bins with an exact residual predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import in_box, segment_distance, segments_cross
from ..storage import cut

#: Most points of a bin that are one array.
POINT_CHUNK = 512

#: Keys over which the boxes of a bin are dealt in a join.
DEALS = 16


def _bin(v: Column, size: float | Column) -> Column:
    return F.floor(v / size).cast("long")


def bin_size(points: DataFrame, per_bin: float = 4.0) -> float:
    """Side of square bins that hold about ``per_bin`` points on average."""
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not r[4]:
        return 1.0
    w, h = max(r[1] - r[0], 1e-9), max(r[3] - r[2], 1e-9)
    # The second bound is that of points on a line.
    return max((w * h * per_bin / r[4]) ** 0.5, max(w, h) * min(1.0, per_bin / r[4]))


def nearest(
    queries: DataFrame, points: DataFrame, k: int = 1, size: float | None = None, qid: str = "qid", pid: str = "pid",
    nonzero: bool = False,
) -> DataFrame:
    """``qid, rank, pid, d2``: the ``k`` nearest points of every query, ties to the smaller id.

    A query looks into the bins around its own; it is settled if its k-th
    distance is within them. The points around each bin that holds queries are
    gathered in arrays of bounded length, so a query is dealt once and not once
    a bin. The others descend a pyramid of bins, each half
    as wide as those above: with the extent of a bin's points and their number,
    only bins that may hold one of the ``k`` go on. So the result is exact, and
    a query far from all points asks for few bins. ``nonzero`` leaves points
    at distance 0 out. A query without a place has no rows.
    """
    q = queries.select(F.col(qid).alias("qid"), F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy")).dropna(subset=["qx", "qy"])
    p = points.select(F.col(pid).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    side = size or bin_size(p, 2.0 * k)
    chunk = F.floor((F.row_number().over(Window.partitionBy("bx", "by").orderBy("pid")) - 1) / POINT_CHUNK).alias("chunk")
    parts = p.withColumns({"bx": _bin(F.col("x"), side), "by": _bin(F.col("y"), side)}).select("*", chunk)
    packed = cut(parts.groupBy("bx", "by", "chunk").agg(F.collect_list(F.struct("pid", "x", "y")).alias("pts")), "knn-points")
    binned = packed.select("bx", "by", F.inline("pts"))
    ext = packed.agg(F.min("bx"), F.max("bx"), F.min("by"), F.max("by"), F.max("chunk")).first()
    if ext[0] is None:
        return q.select("qid", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("pid"), F.lit(0.0).alias("d2")).limit(0)

    def ranked(asked: DataFrame) -> DataFrame:
        # What explodes is no part of an estimated size, so a large table would be broadcast as a small one.
        pairs = asked.hint("merge").join(binned, ["bx", "by"]).withColumn(
            "d2", (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
        )
        if nonzero:
            pairs = pairs.filter("d2 > 0")
        found = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "pid"))).filter(F.col("rank") <= k)
        return cut(found.select("qid", "rank", "pid", "d2"), "knn-found")

    mine = q.withColumns({"bx": _bin(F.col("qx"), side), "by": _bin(F.col("qy"), side)})
    # Bins outside the points' extent are empty and are not asked for.
    held = mine.select(F.col("bx").alias("cx"), F.col("by").alias("cy")).filter(F.col("cx").between(ext[0] - 1, ext[1] + 1) & F.col("cy").between(ext[2] - 1, ext[3] + 1)).distinct()
    for c, low, high in (("x", ext[0], ext[1]), ("y", ext[2], ext[3])):
        held = held.withColumn(f"b{c}", F.explode(F.sequence(F.greatest(F.col(f"c{c}") - 1, F.lit(low)), F.least(F.col(f"c{c}") + 1, F.lit(high)))))
    around = held.hint("merge").join(packed, ["bx", "by"]).groupBy(F.col("cx").alias("bx"), F.col("cy").alias("by"), "chunk").agg(F.flatten(F.collect_list("pts")).alias("pts"))
    dist = lambda v: (v["x"] - F.col("qx")) * (v["x"] - F.col("qx")) + (v["y"] - F.col("qy")) * (v["y"] - F.col("qy"))
    reached = F.transform("pts", lambda v: F.struct(dist(v).alias("d2"), v["pid"].alias("pid")))
    if nonzero:
        reached = F.filter(reached, lambda v: v["d2"] > 0)
    first = lambda c: F.slice(F.sort_array(c), 1, k)
    near = mine.join(around, ["bx", "by"], "left").select("qid", "qx", "qy", first(reached).alias("best"))
    if ext[4]:
        near = near.groupBy("qid").agg(F.first("qx").alias("qx"), F.first("qy").alias("qy"), first(F.flatten(F.collect_list("best"))).alias("best"))
    near = cut(near, "knn-found")
    sure = F.coalesce((F.size("best") >= k) & (F.get("best", F.lit(k - 1))["d2"] <= side**2), F.lit(False))
    ready = near.filter(sure).select("qid", F.posexplode("best").alias("rank", "v")).select("qid", (F.col("rank") + 1).alias("rank"), "v.pid", "v.d2")
    rest = cut(near.filter(~sure).select("qid", "qx", "qy"), "knn-queries")
    if rest.limit(1).count() == 0:
        return ready
    return ready.unionByName(ranked(_descend(rest, binned, ext[:4], k, nonzero)))


def _descend(queries: DataFrame, binned: DataFrame, ext: tuple[int, int, int, int], k: int, nonzero: bool) -> DataFrame:
    """Queries with every bin (``bx, by``) that may hold one of their ``k`` nearest points."""
    leaves = cut(binned.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]), "knn-bins")
    cells = lambda h: ((ext[1] >> h) - (ext[0] >> h) + 1) * ((ext[3] >> h) - (ext[2] >> h) + 1)
    top = next(h for h in range(64) if cells(h) <= 16)
    rest = None
    for h in range(top, -1, -1):
        up = lambda c: F.shiftright(c, h)  # noqa: B023, E731
        level = leaves.groupBy(up("bx").alias("bx"), up("by").alias("by")).agg(F.sum("n").alias("n"), *[f(f"{c}{i}").alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
        if rest is None:
            asked = queries.crossJoin(F.broadcast(level))
        else:
            level = level.withColumns({"ux": F.shiftright("bx", 1), "uy": F.shiftright("by", 1)})
            # A level of few bins has too few keys to deal the queries by.
            asked = rest.join(F.broadcast(level), ["ux", "uy"]) if cells(h) <= 16384 else rest.hint("merge").join(level, ["ux", "uy"])
        gap = lambda c: F.greatest(F.col(f"{c}0") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"{c}1"), F.lit(0.0))
        reach = lambda c: F.greatest(F.abs(F.col(f"{c}0") - F.col(f"q{c}")), F.abs(F.col(f"{c}1") - F.col(f"q{c}")))
        asked = asked.withColumns({"low": gap("x") * gap("x") + gap("y") * gap("y"), "high": reach("x") * reach("x") + reach("y") * reach("y")})
        sure = F.when(F.col("low") > 0, F.col("n")).otherwise(0) if nonzero else F.col("n")
        one = Window.partitionBy("qid")
        asked = asked.withColumn("held", F.sum(sure).over(one.orderBy("high").rowsBetween(Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("held") >= k, F.col("high"))).over(one)
        kept = asked.withColumn("bound", bound).filter("low is not null and (bound is null or low <= bound * (1 + 1e-9))")
        rest = cut(kept.select("qid", "qx", "qy", F.col("bx").alias("ux"), F.col("by").alias("uy")), "knn-down")
    return rest.withColumnsRenamed({"ux": "bx", "uy": "by"})


def box_shapes(boxes: DataFrame, key: str, chunk: int = 4096) -> DataFrame:
    """``x0, y0, x1, y1, _ids``: boxes of one place as one row with their keys, so that a test is made once for all of them.

    Boxes of a place are dealt by a hash of their key over as many rows as all
    boxes fill chunks, so that no array grows with the table.
    """
    part = F.pmod(F.xxhash64(key), F.lit(max(1, -(-boxes.count() // chunk)))).alias("_part")
    return cut(boxes.groupBy("x0", "y0", "x1", "y1", part).agg(F.collect_list(key).alias("_ids")).drop("_part"), "box-shapes")


def _box_side(boxes: DataFrame, size: float | None) -> float:
    return size or max(float(boxes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0), 1e-9)


def _box_bins(boxes: DataFrame, side: float, name: str = "") -> DataFrame:
    return boxes.withColumn("gx", F.explode(F.sequence(_bin(F.col(f"{name}x0"), side), _bin(F.col(f"{name}x1"), side)))).withColumn(
        "gy", F.explode(F.sequence(_bin(F.col(f"{name}y0"), side), _bin(F.col(f"{name}y1"), side)))
    )


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the shuffle partitions: few of them may each be met by very many."""
    return df.repartition(_tasks(df))


def points_in_shapes(points: DataFrame, shapes: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of a point and a row of ``shapes`` (above the lower, up to the upper edge)."""
    side = _box_side(shapes, size)
    p = _dealt(points).withColumns({"gx": _bin(F.col("x"), side), "gy": _bin(F.col("y"), side)})
    return p.join(_box_bins(shapes, side), ["gx", "gy"]).filter(in_box(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).drop("gx", "gy")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of a point and a box that holds it (above the lower, up to the upper edge)."""
    keyed = boxes.select("x0", "y0", "x1", "y1", F.struct(*[c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]).alias("_key"))
    found = points_in_shapes(points, box_shapes(keyed, "_key"), size)
    return found.withColumn("_key", F.explode("_ids")).select(*points.columns, "x0", "y0", "x1", "y1", "_key.*")


def _meeting(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    """Pairs of rows whose boxes (``left_x0`` and so on) meet, each in the bin that holds the lower left corner of the common part only."""
    # Few places fill few bins, and few bytes are merged into one task however many pairs they make, so bins are
    # dealt over more keys and the number of tasks is given.
    tasks, keys = _tasks(left), ["gx", "gy", "_deal"]
    a = _box_bins(left, side, "left_").withColumn("_deal", F.pmod(F.xxhash64(*left.columns), F.lit(DEALS)))
    b = _box_bins(right, side, "right_").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    pairs = a.repartition(tasks, *keys).join(b, keys).drop("_deal")
    x, y = F.greatest("left_x0", "right_x0"), F.greatest("left_y0", "right_y0")
    meets = (x <= F.least("left_x1", "right_x1")) & (y <= F.least("left_y1", "right_y1"))
    return pairs.filter(meets & (_bin(x, side) == F.col("gx")) & (_bin(y, side) == F.col("gy"))).drop("gx", "gy")


def _grown(df: DataFrame, name: str, grow: float = 0.0) -> DataFrame:
    """Box columns renamed ``name_*`` and grown by a margin."""
    return df.withColumns({f"{name}_{c}": F.col(c) + s * grow for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))}).drop("x0", "y0", "x1", "y1")


def overlapping_boxes(left: DataFrame, right: DataFrame, lid: str, rid: str, margin: float = 0.0, size: float | None = None) -> DataFrame:
    """``left_id, right_id`` of boxes that overlap within a margin, each pair once."""
    a = _grown(box_shapes(left, lid), "left", margin).withColumnRenamed("_ids", "left_ids")
    b = _grown(box_shapes(right, rid), "right").withColumnRenamed("_ids", "right_ids")
    found = _meeting(a, b, _box_side(right, size)).select("left_ids", "right_ids")
    return found.withColumn("left_id", F.explode("left_ids")).withColumn("right_id", F.explode("right_ids")).select("left_id", "right_id")


def ring_arrays(rings: DataFrame) -> DataFrame:
    """``poly_id, ring`` (array of x, y in order) with the bounding box of each polygon."""
    return rings.groupBy("poly_id").agg(
        F.array_sort(F.collect_list(F.struct("vid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("ring"),
        F.min("x").cast("double").alias("x0"), F.max("x").cast("double").alias("x1"),
        F.min("y").cast("double").alias("y0"), F.max("y").cast("double").alias("y1"),
    )


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of sides."""
    n = F.size(ring)
    corners = F.transform(
        ring,
        lambda v, i: F.struct(
            v["x"].alias("ax"), v["y"].alias("ay"), ring[F.pmod(i + 1, n)]["x"].alias("bx"), ring[F.pmod(i + 1, n)]["y"].alias("by")
        ),
    )
    crossed = lambda s: ((s["ay"] > y) != (s["by"] > y)) & (
        x < (s["bx"] - s["ax"]) * (y - s["ay"]) / (s["by"] - s["ay"]) + s["ax"]
    )
    return F.size(F.filter(corners, crossed)) % 2 == 1


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float | None = None) -> DataFrame:
    """Points with the ``poly_id`` of every polygon that holds them.

    Candidates share a bin with the polygon's bounding box; a polygon's ring is
    one array, so it must fit a row.
    """
    polys = ring_arrays(rings)
    side = size or max(float(polys.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0), 1e-9)
    b = polys.withColumn("bx", F.explode(F.sequence(_bin(F.col("x0"), side), _bin(F.col("x1"), side)))).withColumn(
        "by", F.explode(F.sequence(_bin(F.col("y0"), side), _bin(F.col("y1"), side)))
    ).withColumnsRenamed({"x0": "_x0", "x1": "_x1", "y0": "_y0", "y1": "_y1"})
    p = points.withColumns({"bx": _bin(F.col("x"), side), "by": _bin(F.col("y"), side)})
    near = p.join(b, ["bx", "by"]).filter(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    return near.filter(inside_ring(F.col("x").cast("double"), F.col("y").cast("double"), F.col("ring"))).select(*points.columns, "poly_id")


def first_polygon(points: DataFrame, rings: DataFrame, pid: str = "pt_id") -> DataFrame:
    """Every point with its first polygon, null outside all."""
    found = points_in_polygons(points, rings).groupBy(pid).agg(F.min("poly_id").alias("poly_id"))
    return points.join(found, pid, "left")


def segments(lines: DataFrame, closed: bool = False, line: str = "line_id") -> DataFrame:
    """``line, seg, ax, ay, bx, by`` of the lines' segments; a closed line also joins its last vertex to its first."""
    w = Window.partitionBy(line).orderBy("vid")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nx, ny = F.coalesce(nx, F.first("x").over(full)), F.coalesce(ny, F.first("y").over(full))
    rows = lines.withColumns({"_bx": nx, "_by": ny}).filter("_bx is not null")
    return rows.select(
        line, F.col("vid").alias("seg"), *[F.col(a).cast("double").alias(b) for a, b in (("x", "ax"), ("y", "ay"), ("_bx", "bx"), ("_by", "by"))]
    )


def _seg_bins(segs: DataFrame, side: float, name: str, grow: float = 0.0) -> DataFrame:
    """Segments with every bin (``gx, gy``) that they pass within ``grow``, columns renamed ``name_*``.

    In each column of bins only the rows that the segment passes there count,
    so bins grow with a segment's length and not with its bounding box. A
    slack far above rounding keeps a point of the segment from missing its bin.
    """
    ax, ay, bx, by = (F.col(f"{name}_{c}") for c in ("ax", "ay", "bx", "by"))
    slack = F.lit(grow + 1e-6 * side) + F.greatest(F.abs(ax), F.abs(ay), F.abs(bx), F.abs(by)) * 1e-14
    x0, x1, y0, y1 = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    within = lambda x: F.least(F.greatest(ay + (x - ax) * ((by - ay) / (bx - ax)), y0), y1)
    ya = within(F.greatest(x0, F.col("gx") * side - slack))
    yb = within(F.least(x1, (F.col("gx") + 1) * side + slack))
    steep = x1 - x0 <= slack
    low, high = F.when(steep, y0).otherwise(F.least(ya, yb)), F.when(steep, y1).otherwise(F.greatest(ya, yb))
    rows = segs.select(*[F.col(c).alias(f"{name}_{c}") for c in segs.columns])
    return rows.withColumn("gx", F.explode(F.sequence(_bin(x0 - slack, side), _bin(x1 + slack, side)))).withColumn(
        "gy", F.explode(F.sequence(_bin(low - slack, side), _bin(high + slack, side)))
    )


def crossing_segments(left: DataFrame, right: DataFrame, lkey: str = "line_id", rkey: str = "line_id", size: float | None = None) -> DataFrame:
    """Pairs of segments (line and ``seg`` name one) that cross strictly, each once, with the crossing's place on the left one (``t``)."""
    side = size or max(float(left.select("ax", "ay", "bx", "by").union(right.select("ax", "ay", "bx", "by")).agg(
        F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1.0) * 2, 1e-9)
    a = _seg_bins(left.withColumnRenamed(lkey, "line"), side, "l")
    b = _seg_bins(right.withColumnRenamed(rkey, "line"), side, "r")
    c = {k: F.col(k) for k in ("l_ax", "l_ay", "l_bx", "l_by", "r_ax", "r_ay", "r_bx", "r_by")}
    hit = segments_cross(*c.values())
    ux, uy = c["l_bx"] - c["l_ax"], c["l_by"] - c["l_ay"]
    vx, vy = c["r_bx"] - c["r_ax"], c["r_by"] - c["r_ay"]
    t = ((c["r_ax"] - c["l_ax"]) * vy - (c["r_ay"] - c["l_ay"]) * vx) / (ux * vy - uy * vx)
    found = a.join(b, ["gx", "gy"]).filter(hit).select("l_line", "l_seg", "r_line", "r_seg", t.alias("t"))
    # The crossing's bin is common to both, and perhaps some beside it.
    return found.dropDuplicates(["l_line", "l_seg", "r_line", "r_seg"])


def lines_meeting_polygons(lines: DataFrame, rings: DataFrame) -> DataFrame:
    """``line_id, poly_id`` where a line crosses a polygon's side or has a vertex inside."""
    sides = segments(rings.withColumnRenamed("poly_id", "line_id"), closed=True)
    crossing = crossing_segments(segments(lines), sides).select(F.col("l_line").alias("line_id"), F.col("r_line").alias("poly_id"))
    within = points_in_polygons(lines.select("line_id", "vid", "x", "y"), rings).select("line_id", "poly_id")
    return crossing.union(within).distinct()


def cut_by_polygons(lines: DataFrame, rings: DataFrame, keep: str = "outside") -> DataFrame:
    """``line_id, piece, vid, x, y``: parts of lines outside (difference) or inside (clip) polygons, or ``both``.

    Lines are split at the polygons' sides; the middle of every small segment
    decides on its side, and neighbouring segments on the same side join again.
    """
    segs = segments(lines)
    sides = segments(rings.withColumnRenamed("poly_id", "line_id"), closed=True)
    cuts = crossing_segments(segs, sides).groupBy(F.col("l_line").alias("line_id"), F.col("l_seg").alias("seg")).agg(
        F.sort_array(F.collect_set("t")).alias("ts")
    )
    stops = F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.expr("cast(array() as array<double>)")), F.array(F.lit(1.0)))
    parts = (
        segs.join(cuts, ["line_id", "seg"], "left")
        .withColumn("s", stops)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.size("s") - 2)))
        .withColumns({"t0": F.col("s")[F.col("k")], "t1": F.col("s")[F.col("k") + 1]})
        .select(
            "line_id", "seg", "k",
            *[(F.col(f"a{c}") + F.col(t) * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(f"{c}{i}") for i, t in ((0, "t0"), (1, "t1")) for c in "xy"],
        )
        .withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})
    )
    parts = cut(parts, "clip-parts")
    inside = points_in_polygons(parts, rings).select("line_id", "seg", "k").distinct().withColumn("in", F.lit(True))
    marked = parts.join(inside, ["line_id", "seg", "k"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    w = Window.partitionBy("line_id").orderBy("seg", "k")
    marked = marked.withColumn("new", F.coalesce((F.lag("in").over(w) != F.col("in")).cast("int"), F.lit(0)))
    marked = marked.withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = marked if keep == "both" else marked.filter(F.col("in") if keep == "inside" else ~F.col("in"))
    order = Window.partitionBy("line_id", "piece").orderBy("seg", "k")
    kept = kept.withColumn("vid", F.row_number().over(order))
    first = kept.filter("vid = 1").select("line_id", "piece", F.lit(0).alias("vid"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return first.unionByName(kept.select("line_id", "piece", "vid", F.col("x1").alias("x"), F.col("y1").alias("y")))


def to_grid(c: Column, snap: float = 1e-9) -> Column:
    """Coordinate on a grid, so that equal places have equal numbers; a second call changes nothing."""
    return F.rint(c / snap) * snap


def node_lines(lines: DataFrame, snap: float = 1e-9) -> DataFrame:
    """``ax, ay, bx, by``: all segments split at their mutual crossings, each once.

    Coordinates are put on a grid of ``snap``; a segment's ends are ordered so
    that both directions count as one. Touching ends are already nodes; an end
    inside another segment splits it as well.
    """
    segs = cut(segments(lines), "node-segs")
    pairs = crossing_segments(segs, segs).select(F.col("l_line").alias("line_id"), F.col("l_seg").alias("seg"), "t")
    ends = segs.select(F.col("ax").alias("x"), F.col("ay").alias("y")).union(segs.select("bx", "by")).distinct()
    side = max(float(segs.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1.0) * 2, 1e-9)
    touch = (
        _seg_bins(segs.withColumnRenamed("line_id", "line"), side, "l", snap)
        .join(ends.withColumns({"gx": _bin(F.col("x"), side), "gy": _bin(F.col("y"), side)}), ["gx", "gy"])
        .withColumns({"ux": F.col("l_bx") - F.col("l_ax"), "uy": F.col("l_by") - F.col("l_ay")})
        .withColumn("t", ((F.col("x") - F.col("l_ax")) * F.col("ux") + (F.col("y") - F.col("l_ay")) * F.col("uy")) / (F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")))
        .filter((F.col("t") > 1e-12) & (F.col("t") < 1 - 1e-12))
        .filter(segment_distance(F.col("x"), F.col("y"), F.col("l_ax"), F.col("l_ay"), F.col("l_bx"), F.col("l_by")) <= snap)
        .select(F.col("l_line").alias("line_id"), F.col("l_seg").alias("seg"), "t")
    )
    cuts = pairs.union(touch).filter((F.col("t") > 0) & (F.col("t") < 1)).groupBy("line_id", "seg").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    stops = F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.expr("cast(array() as array<double>)")), F.array(F.lit(1.0)))
    parts = segs.join(cuts, ["line_id", "seg"], "left").withColumn("s", stops).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("s") - 2)))
    at = lambda c, k: to_grid(F.col(f"a{c}") + F.col("s")[k] * (F.col(f"b{c}") - F.col(f"a{c}")), snap)
    ends2 = parts.select(
        F.struct(at("x", F.col("k")).alias("x"), at("y", F.col("k")).alias("y")).alias("p"),
        F.struct(at("x", F.col("k") + 1).alias("x"), at("y", F.col("k") + 1).alias("y")).alias("q"),
    ).filter("p != q")
    return ends2.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct().select(
        F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by")
    )


def clip_segments_to_boxes(segs: DataFrame, boxes: DataFrame, size: float | None = None, digits: int | None = None) -> DataFrame:
    """Segments cut to every box they meet (Liang-Barsky): ``line_id, seg, tile_ord, ax, ay, bx, by``, rounded to ``digits``."""
    extent = segs.withColumns(
        {"left_x0": F.least("ax", "bx"), "left_x1": F.greatest("ax", "bx"), "left_y0": F.least("ay", "by"), "left_y1": F.greatest("ay", "by")}
    )
    shapes = box_shapes(boxes, "tile_ord")
    pairs = _meeting(extent, _grown(shapes, "right"), _box_side(boxes, size))
    rows = pairs.withColumnsRenamed({f"right_{c}": c for c in ("x0", "y0", "x1", "y1")})
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    lo, hi, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for d, a, low, high in ((dx, F.col("ax"), F.col("x0"), F.col("x1")), (dy, F.col("ay"), F.col("y0"), F.col("y1"))):
        lo.append(F.when(d > 0, (low - a) / d).when(d < 0, (high - a) / d).otherwise(0.0))
        hi.append(F.when(d > 0, (high - a) / d).when(d < 0, (low - a) / d).otherwise(1.0))
        ok = ok & ((d != 0) | a.between(low, high))
    rows = rows.withColumns({"t0": F.greatest(*lo), "t1": F.least(*hi)}).filter(ok & (F.col("t0") < F.col("t1")))
    ends = {"ax": F.col("ax") + F.col("t0") * dx, "ay": F.col("ay") + F.col("t0") * dy, "bx": F.col("ax") + F.col("t1") * dx, "by": F.col("ay") + F.col("t1") * dy}
    if digits is not None:
        ends = {c: F.round(v, digits) + F.lit(0.0) for c, v in ends.items()}
    # Cut once for all boxes of a place, whose keys come last.
    return rows.select("line_id", "seg", "_ids", *[v.alias(c) for c, v in ends.items()]).withColumn("tile_ord", F.explode("_ids")).select(
        "line_id", "seg", "tile_ord", *ends
    )
