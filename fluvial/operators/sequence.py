"""Operators along polylines: rows of ``line_id, vid, x, y`` ordered by ``vid`` within a line.

Windows share the partitioning by line, so a chain of them shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

PI = 3.141592653589793


def along(line: str = "line_id") -> WindowSpec:
    return Window.partitionBy(line).orderBy("vid")


def whole(line: str = "line_id") -> WindowSpec:
    return Window.partitionBy(line)


def wrap_angle(a: Column) -> Column:
    """Difference of two angles back in the range of half a turn."""
    return F.when(a > PI, a - 2 * PI).when(a < -PI, a + 2 * PI).otherwise(a)


def distance_increments(lines: DataFrame, out: str = "d") -> DataFrame:
    """Length of the segment that ends at each vertex; null at the first."""
    w = along()
    return lines.withColumn(out, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))


def _headings(lines: DataFrame) -> DataFrame:
    """Angles of the segments before (``_in``) and after (``_out``) each vertex."""
    w = along()
    after = F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x"))
    return lines.withColumn("_out", after).withColumn("_in", F.lag("_out").over(w))


def turn_angles(lines: DataFrame, out: str = "turn") -> DataFrame:
    """Turn at each vertex in the range of half a turn; 0 at both ends."""
    turn = F.coalesce(wrap_angle(F.col("_out") - F.col("_in")), F.lit(0.0))
    return _headings(lines).withColumn(out, turn).drop("_out", "_in")


def normals(lines: DataFrame, out: str = "perp") -> DataFrame:
    """Angle of the right-hand normal: bisector of both segments less a quarter turn; the ends use their own segment."""
    both = F.col("_in") + wrap_angle(F.col("_out") - F.col("_in")) / 2
    return _headings(lines).withColumn(out, F.coalesce(both, "_out", "_in") - PI / 2).drop("_out", "_in")


def _gradient(c: str, w: WindowSpec) -> Column:
    """Central difference, one-sided at the ends."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before)


def curvature(lines: DataFrame, out: str = "curv", stride: int = 1) -> DataFrame:
    """Curvature by repeated gradients, 0 for lines with fewer than three vertices.

    With a ``stride`` every stride-th vertex forms a line of its own.
    """
    keys = ["line_id"] + (["_s"] if stride > 1 else [])
    rows = lines.withColumn("_s", F.col("vid") % stride) if stride > 1 else lines
    w, n = Window.partitionBy(*keys).orderBy("vid"), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = rows.withColumns({"_dx": _gradient("x", w), "_dy": _gradient("y", w), "_n": n})
    rows = rows.withColumns({"_d2x": _gradient("_dx", w), "_d2y": _gradient("_dy", w)})
    dx, dy = F.col("_dx"), F.col("_dy")
    value = F.abs(dx * F.col("_d2y") - F.col("_d2x") * dy) / (F.pow(dx * dx + dy * dy, F.lit(1.5)) + 1e-20)
    return rows.withColumn(out, F.when(F.col("_n") < 3, F.lit(0.0)).otherwise(value)).drop("_s", "_dx", "_dy", "_n", "_d2x", "_d2y")


def moving_average(lines: DataFrame, column: str, n: int, self_weight: float = 0.0, out: str | None = None) -> DataFrame:
    """Moving average over ``n`` (2 or more) vertices.

    An even ``n`` reaches one vertex less backwards. The first and last n//2
    vertices take the nearest full average. Lines of at most ``n`` vertices
    become straight from their first to their last value.
    """
    if n < 2:
        raise ValueError("n must be 2 or more")
    m = n // 2
    w = along()
    back = m if n % 2 else m - 1
    count = F.count(F.lit(1)).over(whole())
    pos = F.row_number().over(w) - 1
    full = Window.partitionBy("line_id").orderBy("vid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines.withColumns(
        {
            "_avg": F.avg(column).over(w.rowsBetween(-back, m)), "_n": count, "_p": pos,
            "_a": F.first(column).over(full), "_b": F.last(column).over(full),
        }
    )
    head = F.first(F.when(F.col("_p") == m, F.col("_avg")), ignorenulls=True).over(full)
    tail = F.first(F.when(F.col("_p") == F.col("_n") - m - 1, F.col("_avg")), ignorenulls=True).over(full)
    rows = rows.withColumns({"_h": head, "_t": tail})
    mean = F.when(F.col("_p") < m, F.col("_h")).when(F.col("_p") >= F.col("_n") - m, F.col("_t")).otherwise(F.col("_avg"))
    blended = (mean + self_weight * F.col(column)) / (1.0 + self_weight)
    straight = F.col("_a") + (F.col("_b") - F.col("_a")) * F.when(F.col("_n") > 1, F.col("_p") / (F.col("_n") - 1)).otherwise(0.0)
    return rows.withColumn(out or column, F.when(F.col("_n") <= n, straight).otherwise(blended)).drop(
        "_avg", "_n", "_p", "_a", "_b", "_h", "_t"
    )


def moving_average_per_line(lines: DataFrame, column: str, n: str, out: str) -> DataFrame:
    """:func:`moving_average` with a window length that differs by line (column ``n``).

    Frames cannot take their width from a column, so a window mean is the
    difference of two running sums, fetched by a join on the shifted place.
    """
    w = along()
    full = Window.partitionBy("line_id").orderBy("vid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines.withColumns(
        {
            "_p": F.row_number().over(w) - 1, "_cnt": F.count(F.lit(1)).over(whole()), "_c": F.sum(column).over(w),
            "_a": F.first(column).over(full), "_b": F.last(column).over(full),
        }
    )
    m = F.floor(F.col(n) / 2)
    at = F.greatest(m, F.least(F.col("_p"), F.col("_cnt") - 1 - m))
    rows = rows.withColumns({"_hi": at + m, "_lo": at + m - F.col(n)})
    sums = rows.select(F.col("line_id").alias("_l"), F.col("_p").alias("_q"), F.col("_c").alias("_s"))
    hi = sums.select(F.col("_l").alias("line_id"), F.col("_q").alias("_hi"), F.col("_s").alias("_sh"))
    lo = sums.select(F.col("_l").alias("line_id"), F.col("_q").alias("_lo"), F.col("_s").alias("_sl"))
    joined = rows.join(hi, ["line_id", "_hi"], "left").join(lo, ["line_id", "_lo"], "left")
    mean = (F.col("_sh") - F.coalesce("_sl", F.lit(0.0))) / F.col(n)
    straight = F.col("_a") + (F.col("_b") - F.col("_a")) * F.when(F.col("_cnt") > 1, F.col("_p") / (F.col("_cnt") - 1)).otherwise(0.0)
    return joined.withColumn(out, F.when(F.col("_cnt") <= F.col(n), straight).otherwise(mean)).select(*lines.columns, out)


def cumulative_lengths(lines: DataFrame) -> DataFrame:
    """``s_from`` and ``s_to``: length along the line from its start and to its end."""
    w = along()
    rows = distance_increments(lines, "_d").withColumn("_d", F.coalesce("_d", F.lit(0.0)))
    rows = rows.withColumn("s_from", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("s_to", F.sum("_d").over(whole()) - F.col("s_from")).drop("_d")


def fill_missing(lines: DataFrame, column: str, bad: Column, out: str) -> DataFrame:
    """Replace flagged values by interpolation over ``vid``; before the first and after the last good one, by that one.

    A line with only flagged values stays as it is.
    """
    w = along()
    good = F.when(~bad, F.struct("vid", F.col(column).cast("double").alias("v")))
    prev = F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(good, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = lines.withColumns({"_f": prev, "_g": nxt})
    span = F.col("_g.vid") - F.col("_f.vid")
    between = F.col("_f.v") + (F.col("_g.v") - F.col("_f.v")) * (F.col("vid") - F.col("_f.vid")) / span
    value = F.when(span > 0, between)
    return rows.withColumn(out, F.coalesce(value, "_f.v", "_g.v", F.col(column).cast("double"))).drop("_f", "_g")


def outliers(column: str, limit: float = 2.0) -> Column:
    """Values more than ``limit`` population deviations above their line's mean."""
    w = whole()
    return F.coalesce((F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_pop(column).over(w), F.lit(0.0)) > limit, F.lit(False))


def thalweg_level(lines: DataFrame, z: str = "z", constant: float = 1.0, coast: tuple[float, float] = (0.0, 3.0), out: str = "eta") -> DataFrame:
    """Water level along a thalweg from smoothed bed elevations.

    Outliers are interpolated; the smoothing length is the number of vertices
    in about 100 units, ten at least. Below the coast's range the level is 0,
    above it bed plus constant, linear between, never below bed plus constant.
    """
    w = whole()
    rows = distance_increments(lines, "_d").withColumn("_bad", outliers(z))
    rows = fill_missing(rows, z, F.col("_bad"), "_z")
    rows = rows.withColumn("_n", F.greatest(F.floor(100.0 / (F.avg("_d").over(w) + 1e-6)), F.lit(10)).cast("long"))
    rows = moving_average_per_line(rows, "_z", "_n", "_zs")
    s = F.col("_zs")
    level = F.when(s >= coast[1], s + constant).when(s > coast[0], (s + constant) * (s - coast[0]) / (coast[1] - coast[0])).otherwise(0.0)
    return rows.withColumn(out, F.greatest(level, s + constant)).select(*lines.columns, out)


def resolution(
    lines: DataFrame, width: str, rows_of_arcs: Column, r_coef: float = 0.4, length_width: float = 6.0,
    limits: tuple[float, float] = (5.0, 300.0), ends: float = 1.0, out: str = "reso",
) -> DataFrame:
    """Wanted spacing at every vertex from curvature and width, finer near the ends if ``ends`` is not 1."""
    rows = curvature(curvature(lines, "_c1"), "_c2", stride=2)
    radius = 1.0 / (F.greatest("_c1", "_c2") + 1e-10)
    wanted = F.least(F.lit(r_coef) * radius, F.lit(length_width) * F.col(width) / (rows_of_arcs - 1))
    rows = rows.withColumn(out, F.least(F.greatest(F.lit(float(limits[0])), wanted), F.lit(float(limits[1]))))
    if ends != 1.0:
        rows = cumulative_lengths(rows).withColumn("_w", F.avg(width).over(whole()))
        for k in (0.5, 1.0, 2.0):
            for side in ("s_from", "s_to"):
                rows = rows.withColumn(out, F.when(F.col(side) < k * F.col("_w"), F.col(out) / ends).otherwise(F.col(out)))
    return rows.drop("_c1", "_c2", "_w", "s_from", "s_to")


def thin(lines: DataFrame, reso: str, pin: str | None = None) -> DataFrame:
    """``kept``: whether a vertex stays when vertices closer than the spacing go one after the other.

    The length carried along restarts at a kept vertex, so this is a fold over
    the line's vertices as one array; pinned vertices and the last one stay.
    """
    w = along()
    seg = distance_increments(lines, "_d").withColumn("_r", (F.lag(reso).over(w) + F.col(reso)) / 2)
    pinned = F.col(pin) == 1 if pin else F.lit(False)
    item = F.struct("vid", F.col("_d").alias("d"), F.col("_r").alias("r"), pinned.alias("p"))
    packed = seg.groupBy("line_id").agg(F.array_sort(F.collect_list(item)).alias("v"))
    empty = F.struct(F.lit(0.0).alias("run"), F.expr("cast(array() as array<boolean>)").alias("k"))

    def step(acc: Column, v: Column) -> Column:
        run = acc["run"] + F.coalesce(v["d"], F.lit(0.0))
        drop = v["d"].isNotNull() & (run < v["r"]) & ~v["p"]
        return F.struct(F.when(drop, run).otherwise(0.0).alias("run"), F.array_append(acc["k"], ~drop).alias("k"))

    folded = packed.select("line_id", "v", F.aggregate("v", empty, step)["k"].alias("k"))
    return folded.select(
        "line_id", F.posexplode(F.arrays_zip("v", "k")).alias("i", "e"), F.size("v").alias("n")
    ).select("line_id", F.col("e.v.vid").alias("vid"), (F.col("e.k") | (F.col("i") == F.col("n") - 1)).alias("kept"))


def snap_to_previous(lines: DataFrame, reso: str) -> DataFrame:
    """Vertices that are closer than the spacing take the place of the last kept one; the last vertex stays."""
    kept = thin_by_start(lines, reso)
    w = along().rowsBetween(Window.unboundedPreceding, 0)
    place = F.last(F.when(F.col("kept"), F.struct("x", "y")), ignorenulls=True).over(w)
    return lines.join(kept, ["line_id", "vid"]).withColumn("_p", place).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", "kept")


def thin_by_start(lines: DataFrame, reso: str) -> DataFrame:
    """Like :func:`thin` with the spacing of the vertex before."""
    w = along()
    prior = lines.withColumn("_q", F.coalesce(F.lag(reso).over(w), F.col(reso)))
    # Equal halves make the mean of :func:`thin` the earlier vertex's spacing.
    seg = distance_increments(prior, "_d")
    item = F.struct("vid", F.col("_d").alias("d"), F.col("_q").alias("r"))
    packed = seg.groupBy("line_id").agg(F.array_sort(F.collect_list(item)).alias("v"))
    empty = F.struct(F.lit(0.0).alias("run"), F.expr("cast(array() as array<boolean>)").alias("k"))

    def step(acc: Column, v: Column) -> Column:
        run = acc["run"] + F.coalesce(v["d"], F.lit(0.0))
        drop = v["d"].isNotNull() & (run < v["r"])
        return F.struct(F.when(drop, run).otherwise(0.0).alias("run"), F.array_append(acc["k"], ~drop).alias("k"))

    folded = packed.select("line_id", "v", F.aggregate("v", empty, step)["k"].alias("k"))
    return folded.select("line_id", F.posexplode(F.arrays_zip("v", "k")).alias("i", "e"), F.size("v").alias("n")).select(
        "line_id", F.col("e.v.vid").alias("vid"), (F.col("e.k") | (F.col("i") == F.col("n") - 1)).alias("kept")
    )


def group_by_count(arcs: DataFrame) -> DataFrame:
    """``arc_id, group_id, pos`` for arcs in order of ``arc_id``: each group takes as many as its first arc's ``n`` says.

    One fold over the arcs as an array of two numbers each; split the input by
    ``map_id`` so that an array holds one map's arcs.
    """
    packed = arcs.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("arc_id", "n"))).alias("v"))
    start = F.struct(
        F.lit(0).cast("long").alias("left"), F.lit(-1).cast("long").alias("g"), F.lit(-1).cast("long").alias("pos"),
        F.expr("cast(array() as array<struct<arc_id:bigint,group_id:bigint,pos:bigint>>)").alias("out"),
    )

    def step(acc: Column, v: Column) -> Column:
        new = acc["left"] <= 0
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        pos = F.when(new, F.lit(0)).otherwise(acc["pos"] + 1).cast("long")
        left = (F.when(new, v["n"]).otherwise(acc["left"]) - 1).cast("long")
        row = F.struct(v["arc_id"].cast("long").alias("arc_id"), g.alias("group_id"), pos.alias("pos"))
        return F.struct(left.alias("left"), g.alias("g"), pos.alias("pos"), F.array_append(acc["out"], row).alias("out"))

    return packed.select("map_id", F.explode(F.aggregate("v", start, step)["out"]).alias("e")).select("map_id", "e.*")


def subsample(lines: DataFrame, every: int) -> DataFrame:
    """Evenly spaced vertices, about one in ``every``, with first and last; shorter lines than ``2 * every`` go."""
    rows = lines.withColumns({"_p": F.row_number().over(along()) - 1, "_n": F.count(F.lit(1)).over(whole())})
    k = F.floor(F.col("_n") / every)
    rows = rows.filter(F.col("_n") >= 2 * every).withColumn("_k", k)
    # Place i of k takes row floor(i (n-1) / (k-1)).
    i = F.ceil(F.col("_p") * (F.col("_k") - 1) / (F.col("_n") - 1))
    taken = F.floor(i * (F.col("_n") - 1) / (F.col("_k") - 1)) == F.col("_p")
    return rows.filter(taken).drop("_p", "_n", "_k")


def drop_repeated_separators(lines: DataFrame, column: str, separator) -> DataFrame:
    """Keep one of consecutive separators."""
    before = F.lag(column).over(along())
    return lines.withColumn("_b", before).filter(~((F.col(column) == separator) & F.coalesce(F.col("_b") == separator, F.lit(False)))).drop("_b")


def redistribute(lines: DataFrame, length: float | None = None, count: int | None = None) -> DataFrame:
    """``line_id, k, x, y``: points at equal distance along each line, first and last included."""
    rows = cumulative_lengths(lines)
    w = along()
    rows = rows.withColumns(
        {"_x1": F.lead("x").over(w), "_y1": F.lead("y").over(w), "_s1": F.lead("s_from").over(w), "_total": F.sum(F.lit(0.0)).over(whole()) + F.max("s_from").over(whole())}
    ).filter(F.col("_s1").isNotNull())
    n = F.lit(count) if count else F.greatest(F.lit(2), F.floor(F.col("_total") / length).cast("int"))
    rows = rows.withColumn("_n", n).withColumn("_step", F.col("_total") / (F.col("_n") - 1))
    # A segment yields the places within it, the last place belonging to the last segment.
    last = F.col("_s1") >= F.col("_total")
    lo = F.ceil(F.col("s_from") / F.col("_step") - 1e-9).cast("int")
    hi = F.when(last, F.col("_n") - 1).otherwise(F.ceil(F.col("_s1") / F.col("_step") - 1e-9).cast("int") - 1)
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    t = F.when(F.col("_s1") > F.col("s_from"), (F.col("k") * F.col("_step") - F.col("s_from")) / (F.col("_s1") - F.col("s_from"))).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return rows.select("line_id", "k", (F.col("x") + t * (F.col("_x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("_y1") - F.col("y"))).alias("y"))


def densify(lines: DataFrame, longest: float) -> DataFrame:
    """``line_id, vid, sub, x, y``: floor(length / longest) even points inserted in each long segment."""
    w = along()
    rows = lines.withColumns({"_x1": F.lead("x").over(w), "_y1": F.lead("y").over(w)})
    d = F.hypot(F.col("_x1") - F.col("x"), F.col("_y1") - F.col("y"))
    n = F.coalesce(F.floor(d / longest), F.lit(0)).cast("int")
    rows = rows.withColumn("_n", n).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("sub") / (F.col("_n") + 1)
    return rows.select(
        "line_id", "vid", "sub",
        F.coalesce(F.col("x") + t * (F.col("_x1") - F.col("x")), "x").alias("x"),
        F.coalesce(F.col("y") + t * (F.col("_y1") - F.col("y")), "y").alias("y"),
    )


def split_by_length(lines: DataFrame, longest: float) -> DataFrame:
    """``part``: index chunk of each vertex when a line is cut into floor(length / longest) parts; chunks share no vertex."""
    rows = cumulative_lengths(lines).withColumns({"_n": F.count(F.lit(1)).over(whole()), "_p": F.row_number().over(along()) - 1})
    parts = F.greatest(F.floor(F.max("s_from").over(whole()) / longest), F.lit(1))
    rows = rows.withColumn("_k", parts).withColumns({"_q": F.floor(F.col("_n") / F.col("_k")), "_r": F.col("_n") % F.col("_k")})
    big = F.col("_r") * (F.col("_q") + 1)
    part = F.when(F.col("_p") < big, F.floor(F.col("_p") / (F.col("_q") + 1))).otherwise(F.col("_r") + F.floor((F.col("_p") - big) / F.greatest("_q", F.lit(1))))
    return rows.withColumn("part", part.cast("long")).drop("s_from", "s_to", "_n", "_p", "_k", "_q", "_r")


def offset_ring(rings: DataFrame, offset: float, ccw: int = 1) -> DataFrame:
    """Vertices moved along the bisector so that the sides move by ``offset``; the ring closes itself."""
    w = Window.partitionBy("line_id").orderBy("vid")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rings.withColumns(
        {
            "_px": F.coalesce(F.lag("x").over(w), F.last("x").over(full)), "_py": F.coalesce(F.lag("y").over(w), F.last("y").over(full)),
            "_nx": F.coalesce(F.lead("x").over(w), F.first("x").over(full)), "_ny": F.coalesce(F.lead("y").over(w), F.first("y").over(full)),
        }
    )
    nl = F.hypot(F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y"))
    pl = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    ax, ay = (F.col("_ny") - F.col("y")) / nl, -(F.col("_nx") - F.col("x")) / nl
    bx, by = (F.col("y") - F.col("_py")) / pl * ccw, -(F.col("x") - F.col("_px")) / pl * ccw
    sx, sy = (ax + bx) * ccw, (ay + by) * ccw
    size, reach = F.hypot(sx, sy), F.lit(float(offset)) / F.sqrt(1 + ax * bx + ay * by)
    return rows.withColumns({"_ox": F.col("x") + reach * sx / size, "_oy": F.col("y") + reach * sy / size}).withColumns(
        {"x": F.col("_ox"), "y": F.col("_oy")}
    ).select(*rings.columns)


def lift_smallest_width(lines: DataFrame, width: str, factor: float = 10.0, out: str = "width2") -> DataFrame:
    """Where a line's second smallest rounded width is over ``factor`` times its smallest, the smallest become the mean of the others."""
    rows = lines.withColumn("_r", F.round(F.col(width), 3))
    least = F.min("_r").over(whole())
    rows = rows.withColumn("_least", least)
    second = F.min(F.when(F.col("_r") > F.col("_least"), F.col("_r"))).over(whole())
    other = F.avg(F.when(F.col("_r") > F.col("_least"), F.col(width))).over(whole())
    rows = rows.withColumns({"_second": second, "_other": other})
    swap = (F.col("_r") == F.col("_least")) & (F.col("_second") > factor * F.col("_least"))
    return rows.withColumn(out, F.when(swap, F.col("_other")).otherwise(F.col(width))).drop("_r", "_least", "_second", "_other")


def smooth_between_nodes(lines: DataFrame, n: int) -> DataFrame:
    """Moving average over each section between vertices that occur more than once; those and the ends stay.

    A section holds the nodes at both its ends. Its window is ``n``, in a
    section of fewer than ``n + 2`` vertices two less than it has, with edges
    as in :func:`moving_average`.
    """
    w = along()
    shared = (F.count(F.lit(1)).over(Window.partitionBy("x", "y")) > 1).cast("int")
    rows = lines.withColumn("_node", shared).withColumn("_s", F.sum("_node").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A node closes one section and begins the next.
    both = F.when(F.col("_node") == 1, F.array(F.col("_s") - 1, F.col("_s"))).otherwise(F.array("_s"))
    keyed = rows.withColumn("_sec", F.explode(both)).withColumn("_line", F.col("line_id")).withColumn("line_id", F.struct("line_id", "_sec"))
    keyed = keyed.withColumns({"_at": F.row_number().over(w), "_len": F.count(F.lit(1)).over(whole())})
    keyed = keyed.withColumn("_w", F.greatest(F.lit(1), F.least(F.lit(n), F.col("_len") - 2)))
    keyed = moving_average_per_line(moving_average_per_line(keyed, "x", "_w", "_x"), "y", "_w", "_y").filter("_sec = _s")
    inner = (F.col("_node") == 0) & (F.col("_at") > 1) & (F.col("_at") < F.col("_len"))
    moved = {c: F.when(inner, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("x", "y")}
    return keyed.withColumns({"line_id": F.col("_line"), **moved}).select(*lines.columns)


def combine_networks(parts: list[DataFrame], every: int, n: int) -> DataFrame:
    """Lines of several tiles in one table, thinned to about one vertex in ``every`` and smoothed over ``n``."""
    whole_set = parts[0].withColumn("_t", F.lit(0))
    for i, df in enumerate(parts[1:], 1):
        whole_set = whole_set.unionByName(df.withColumn("_t", F.lit(i)))
    keyed = whole_set.withColumn("line_id", F.struct("_t", "line_id")).drop("_t")
    thinned = subsample(keyed, every)
    pos = (F.row_number().over(along()) - 1).cast("long")
    thinned = thinned.withColumn("vid", pos)
    return moving_average(moving_average(thinned, "x", n), "y", n)


def levee_feet(lines: DataFrame, spacing: float = 300.0, offsets: tuple[float, ...] = (-15.0, -5.0, 5.0, 15.0)) -> DataFrame:
    """``line_id, side, vid, x, y``: evenly spaced lines beside a levee at the given distances along its normal."""
    even = redistribute(lines, length=spacing).withColumnRenamed("k", "vid")
    rows = normals(even).withColumn("side", F.explode(F.array(*[F.lit(v) for v in offsets])))
    return rows.select("line_id", "side", "vid", (F.col("x") + F.cos("perp") * F.col("side")).alias("x"), (F.col("y") + F.sin("perp") * F.col("side")).alias("y"))
