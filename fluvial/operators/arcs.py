"""From thalwegs to river arcs: transects, banks, widths, assembly, river groups, dredging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import nudged_distance, offset_point
from .sequence import PI, along, normals, turn_angles, whole


def transects(lines: DataFrame, steps: int, length: float | Column, side: str = "right", keep: tuple[str, ...] = ()) -> DataFrame:
    """``line_id, vid, step, x, y``: ``steps`` even points from each vertex to ``length`` along its normal; columns of the vertex in ``keep`` too."""
    rows = lines if "perp" in lines.columns else normals(lines)
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return at_steps(rows, steps, length, side).select("line_id", "vid", "step", "x", "y", *keep)


def at_steps(rows: DataFrame, steps: int, length: float | Column, side: str = "right") -> DataFrame:
    """Vertices with ``perp`` and a ``step``, their ``x, y`` moved to that step of :func:`transects`."""
    angle = F.col("perp") + (0.0 if side == "right" else PI)
    x, y = offset_point(F.col("x"), F.col("y"), angle, F.col("step") / F.lit(float(steps - 1)) * length)
    return rows.withColumns({"x": x, "y": y})


def bank_steps(samples: DataFrame, level: DataFrame) -> DataFrame:
    """``line_id, vid, step``: step of the bank on a side.

    ``samples``: ``line_id, vid, step, z``; ``level``: ``line_id, vid, eta``.
    The first step not under water; if that is the thalweg itself, the step
    closest to the water level; if all is water, the last step.
    """
    return sampled_bank_steps(samples.join(level.select("line_id", "vid", "eta"), ["line_id", "vid"])).drop("whole")


def sampled_bank_steps(samples: DataFrame) -> DataFrame:
    """:func:`bank_steps` of samples that have their ``eta``; ``whole`` is null where one of a vertex has no ``z``."""
    d = samples.withColumn("d", F.col("z") - F.col("eta"))
    agg = d.groupBy("line_id", "vid").agg(
        F.min(F.when(F.col("d") >= 0, F.col("step"))).alias("first"),
        F.min_by("step", F.struct(F.abs("d"), "step")).alias("close"),
        F.max("step").alias("last"),
        F.every(F.col("z").isNotNull()).alias("every"),
    )
    return agg.select(
        "line_id", "vid", F.when(F.col("first").isNull(), F.col("last")).when(F.col("first") == 0, F.col("close")).otherwise(F.col("first")).alias("step"),
        F.when(F.col("every"), True).alias("whole"),
    )


def two_banks(lines: DataFrame, left: DataFrame, right: DataFrame, min_width: float) -> DataFrame:
    """Banks, width and status of every line.

    ``left`` and ``right`` have ``line_id, vid, x, y``. Where the width is below
    ``min_width`` the banks stand half of it to each side. ``status`` is -1 if
    over 30 % of a line is narrow, -2 if a bank is missing anywhere, else 0.
    """
    rows = lines if "perp" in lines.columns else normals(lines)
    rows = rows.join(left.select("line_id", "vid", F.col("x").alias("xl"), F.col("y").alias("yl")), ["line_id", "vid"], "left")
    rows = rows.join(right.select("line_id", "vid", F.col("x").alias("xr"), F.col("y").alias("yr")), ["line_id", "vid"], "left")
    rows = rows.withColumn("narrow", F.hypot(F.col("xl") - F.col("xr"), F.col("yl") - F.col("yr")) < min_width)
    share, lost = F.avg(F.col("narrow").cast("double")).over(whole()), F.max((F.col("xl").isNull() | F.col("xr").isNull()).cast("int")).over(whole())
    rows = rows.withColumn("status", F.when(lost == 1, -2).when(share > 0.3, -1).otherwise(0))
    rx, ry = offset_point(F.col("x"), F.col("y"), F.col("perp"), min_width / 2)
    lx, ly = offset_point(F.col("x"), F.col("y"), F.col("perp") + PI, min_width / 2)
    pick = lambda a, b: F.when(F.col("narrow"), a).otherwise(F.col(b))
    rows = rows.withColumns({"_rx": pick(rx, "xr"), "_ry": pick(ry, "yr"), "_lx": pick(lx, "xl"), "_ly": pick(ly, "yl")})
    return rows.withColumns({"xr": F.col("_rx"), "yr": F.col("_ry"), "xl": F.col("_lx"), "yl": F.col("_ly")}).drop(
        "_rx", "_ry", "_lx", "_ly", "narrow"
    ).withColumn("width", F.hypot(F.col("xl") - F.col("xr"), F.col("yl") - F.col("yr")))


def artificial_banks(lines: DataFrame, width: float) -> DataFrame:
    """Banks at half of a constant width on both sides."""
    rows = normals(lines)
    rx, ry = offset_point(F.col("x"), F.col("y"), F.col("perp"), width / 2)
    lx, ly = offset_point(F.col("x"), F.col("y"), F.col("perp") + PI, width / 2)
    return rows.withColumns({"xr": rx, "yr": ry, "xl": lx, "yl": ly, "width": F.lit(float(width))})


def nudge_bank(rows: DataFrame, bx: str, by: str, low: float, high: float) -> DataFrame:
    """Banks nearer than ``low`` or farther than ``high`` move along the normal to that distance."""
    d = F.hypot(F.col(bx) - F.col("x"), F.col(by) - F.col("y"))
    nx, ny = offset_point(F.col("x"), F.col("y"), F.col("perp"), nudged_distance(d, low, high))
    out = ~d.between(low, high)
    return rows.withColumns({bx: F.when(out, nx).otherwise(F.col(bx)), by: F.when(out, ny).otherwise(F.col(by))})


def lowest_steps(samples: DataFrame, n_low: int = 10) -> DataFrame:
    """``line_id, vid, step``: whole part of the median place of the ``n_low`` lowest samples, ties to the smaller step."""
    w = Window.partitionBy("line_id", "vid").orderBy("z", "step")
    n = F.count(F.lit(1)).over(Window.partitionBy("line_id", "vid"))
    rows = samples.withColumns({"_r": F.row_number().over(w), "_n": n}).filter(F.col("_r") <= F.least(F.lit(n_low), F.col("_n") - 1))
    return rows.groupBy("line_id", "vid").agg(F.floor(F.expr("percentile(step, 0.5D)")).cast("int").alias("step"))


def sampled_lowest_steps(samples: DataFrame, n_low: int = 10) -> DataFrame:
    """:func:`lowest_steps` with the ``z`` there, and ``whole``, null where a sample of the vertex has no ``z``; a vertex is one row from the start."""
    packed = samples.groupBy("line_id", "vid").agg(F.array_sort(F.collect_list(F.struct("z", "step"))).alias("s"), F.every(F.col("z").isNotNull()).alias("every"))
    low = F.array_sort(F.transform(F.slice("s", 1, F.least(F.lit(n_low), F.size("s") - 1)), lambda v: v["step"]))
    at = lambda n: F.get("low", F.floor(n / 2).cast("int"))
    median = F.floor((at(F.size("low") - 1) + at(F.size("low"))) / 2).cast("int")
    rows = packed.withColumn("low", low).filter("size(low) > 0").withColumn("step", median)
    z = F.filter("s", lambda v: v["step"] == F.col("step"))[0]["z"]
    return rows.select("line_id", "vid", "step", z.alias("z"), F.when(F.col("every"), True).alias("whole"))


def corrected_thalweg(left: DataFrame, right: DataFrame, n_low: int = 10) -> DataFrame:
    """``line_id, vid, x, y``: the lower of both sides' low points; the right one if the left is higher.

    Both inputs are samples with ``line_id, vid, step, x, y, z``.
    """
    low = lambda s: s.join(lowest_steps(s, n_low), ["line_id", "vid", "step"])
    return lower_side(low(left), low(right))


def lower_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """``line_id, vid, x, y`` of the lower of two places (``line_id, vid, x, y, z``) of a vertex; the right one if the left is higher."""

    def named(s: DataFrame, name: str) -> DataFrame:
        return s.select("line_id", "vid", *[F.col(c).alias(name + c) for c in "xyz"])

    both = named(left, "l").join(named(right, "r"), ["line_id", "vid"], "full")
    go_right = F.coalesce(F.col("lz") > F.col("rz"), F.col("lz").isNull())
    return both.select("line_id", "vid", F.when(go_right, F.col("rx")).otherwise(F.col("lx")).alias("x"), F.when(go_right, F.col("ry")).otherwise(F.col("ly")).alias("y"))


def drop_sharp_turns(lines: DataFrame, limit: float = PI / 2.4, rounds: int = 100, pin: str | None = None) -> DataFrame:
    """Delete vertices with a turn above ``limit`` until none is left or ``rounds`` are over; ends and pinned ones stay.

    Every line is folded to its end in a task of its own.
    """
    import numpy as np
    import pandas as pd

    cols = lines.columns

    def run(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("vid", kind="stable").reset_index(drop=True)
        for _ in range(rounds):
            if len(line) < 3:
                break
            heading = np.arctan2(np.diff(line["y"]), np.diff(line["x"]))
            turn = np.diff(heading)
            turn = np.where(turn > np.pi, turn - 2 * np.pi, np.where(turn < -np.pi, turn + 2 * np.pi, turn))
            sharp = np.concatenate([[False], np.abs(turn) > limit, [False]])
            gone = sharp & ~(line[pin].to_numpy() != 0) if pin else sharp
            if not gone.any():
                break
            line = line[~gone].reset_index(drop=True)
        return line[cols]

    return lines.groupBy("line_id").applyInPandas(run, lines.schema)


def smooth_bank(rows: DataFrame, bank: tuple[str, str] = ("bx", "by"), limit: float = PI / 2.4, rounds: int = 100, coef: float = 0.2, move_all: bool = False) -> DataFrame:
    """Move sharp turns of a bank toward their neighbours' mean unless that crosses the thalweg; there, add vertices.

    A vertex whose move crosses the thalweg is replaced by the middles towards
    both neighbours, in every coordinate column. With ``move_all`` one valid
    move moves all sharp turns, as the original does. Each line is folded by one
    task; ``vid`` is numbered anew.
    """
    import numpy as np

    from .folds import Arrays, fold_groups

    cols, numbers = rows.columns, [c for c, t in rows.dtypes if t == "double"]
    b, t = [numbers.index(c) for c in bank], [numbers.index(c) for c in ("x", "y")]

    def left(a, b, c):
        return (c[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])

    def crosses(a, b, c, d):
        return (left(a, c, d) != left(b, c, d)) & (left(a, b, c) != left(a, b, d))

    def run(line: Arrays) -> Arrays:
        # The numbers of all vertices, and the given row that each comes from.
        v, of = np.column_stack([line[c].astype(float) for c in numbers]), np.arange(len(line["vid"]))
        for _ in range(rounds):
            if len(v) < 3:
                break
            p, way = v[:, b], v[:, t]
            heading = np.arctan2(np.diff(p[:, 1]), np.diff(p[:, 0]))
            turn = np.diff(heading)
            turn = np.where(turn > np.pi, turn - 2 * np.pi, np.where(turn < -np.pi, turn + 2 * np.pi, turn))
            sharp = np.flatnonzero(np.abs(turn) > limit) + 1
            if not len(sharp):
                break
            goal = (p[sharp - 1] + p[sharp + 1]) / 2 * coef + p[sharp] * (1 - coef)
            here = way[sharp]
            bad = crosses(p[sharp], goal, here, way[sharp - 1]) | crosses(p[sharp], goal, here, way[sharp + 1])
            move = np.ones(len(sharp), bool) if move_all and (~bad).any() else ~bad
            v[np.ix_(sharp[move], b)] = goal[move]
            if bad.any():
                at = sharp[bad]
                two = np.stack([(v[at] + v[at - 1]) / 2, (v[at] + v[at + 1]) / 2], 1)
                times = np.ones(len(v), np.int64)
                times[at] = 2
                first = (np.cumsum(times) - times)[at]
                v, of = np.repeat(v, times, 0), np.repeat(of, times)
                v[first], v[first + 1] = two[:, 0], two[:, 1]
        return {c: v[:, numbers.index(c)] if c in numbers else np.arange(len(v)) if c == "vid" else line[c][of] for c in cols}

    return fold_groups(rows, "line_id", "vid", run, rows.schema)


def line_quality(arcs: DataFrame, limit: float = 1.8) -> DataFrame:
    """``river_id, ok``: whether the mean absolute turn stays within ``limit`` on every arc; fewer than two vertices fail."""
    key = F.struct("river_id", "arc_pos")
    turned = turn_angles(arcs.withColumn("line_id", key))
    per = turned.groupBy("river_id", "arc_pos").agg(F.avg(F.abs("turn")).alias("m"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("river_id").agg(F.every((F.col("m") <= limit) & (F.col("n") >= 2)).alias("ok"))


def assemble_arcs(banks: DataFrame, positions: Column) -> DataFrame:
    """``line_id, arc_pos, vid, x, y``: arcs at relative positions between the left (0) and the right bank (1)."""
    rows = banks.select("*", F.posexplode(positions).alias("arc_pos", "_f"))
    return rows.select(
        "line_id", "arc_pos", "vid",
        (F.col("xl") * (1 - F.col("_f")) + F.col("xr") * F.col("_f")).alias("x"),
        (F.col("yl") * (1 - F.col("_f")) + F.col("yr") * F.col("_f")).alias("y"),
    )


def arc_positions(inner: Column, outer: tuple[float, ...] = ()) -> Column:
    """Outer arcs on both sides around the inner positions."""
    head = F.array(*[F.lit(-v) for v in sorted(outer, reverse=True)]).cast("array<double>")
    tail = F.array(*[F.lit(1.0 + v) for v in sorted(outer)]).cast("array<double>")
    return F.concat(head, inner, tail)


def cross_channel_arcs(arcs: DataFrame) -> DataFrame:
    """First and last transect of every river as arcs."""
    w = Window.partitionBy("river_id")
    rows = arcs.withColumns({"_a": F.min("vid").over(w), "_b": F.max("vid").over(w)})
    return rows.filter((F.col("vid") == F.col("_a")) | (F.col("vid") == F.col("_b"))).drop("_a", "_b")


def centrelines(arcs: DataFrame) -> DataFrame:
    """Mean of all arcs of a river at each vertex."""
    return arcs.groupBy("river_id", "vid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def middle_arcs(arcs: DataFrame) -> DataFrame:
    """Middle arc of a river, or the mean of the two middle ones."""
    n = F.max("arc_pos").over(Window.partitionBy("river_id")) + 1
    rows = arcs.withColumn("_n", n)
    mid = (F.col("arc_pos") == F.floor((F.col("_n") - 1) / 2)) | (F.col("arc_pos") == F.floor(F.col("_n") / 2))
    return centrelines(rows.filter(mid))


def outline_rings(arcs: DataFrame) -> DataFrame:
    """``river_id, pos, x, y``: first arc forwards, last arc backwards, closed."""
    w = Window.partitionBy("river_id")
    rows = arcs.withColumns({"_m": F.max("arc_pos").over(w), "_v": F.max("vid").over(w)})
    there = rows.filter("arc_pos = 0").select("river_id", F.col("vid").alias("pos"), "x", "y")
    back = rows.filter("arc_pos = _m").select("river_id", (F.col("_v") * 2 + 1 - F.col("vid")).alias("pos"), "x", "y")
    close = rows.filter("arc_pos = 0 and vid = 0").select("river_id", (F.col("_v") * 2 + 2).alias("pos"), "x", "y")
    return there.unionByName(back).unionByName(close)


def pin_shared_vertices(lines: DataFrame) -> DataFrame:
    """``z`` plus 1 where another vertex has the same place."""
    n = F.count(F.lit(1)).over(Window.partitionBy("x", "y"))
    return lines.withColumn("z", F.col("z") + F.when(n > 1, 1).otherwise(0))


def with_flags(lines: DataFrame, defaults: dict[str, int]) -> DataFrame:
    """Optional whole-number columns with defaults where they are absent or null."""
    for name, value in defaults.items():
        have = F.col(name) if name in lines.columns else F.lit(None)
        lines = lines.withColumn(name, F.coalesce(F.nanvl(have.cast("double"), F.lit(None).cast("double")), F.lit(float(value))).cast("int"))
    return lines


def transect_order(arcs: DataFrame) -> DataFrame:
    """``river_id, vid, pos, x, y``: a river's arcs as cross-channel transects."""
    pos = F.row_number().over(Window.partitionBy("river_id", "vid").orderBy("arc_pos")) - 1
    return arcs.select("river_id", "vid", pos.cast("long").alias("pos"), "x", "y")


def dredge(arcs: DataFrame, min_depth: float, all_but_banks: bool = True) -> DataFrame:
    """``dp2``: depth of inner arcs at least ``min_depth`` below the shallower bank of their transect.

    ``arcs`` has ``river_id, arc_pos, vid, dp``. Otherwise only the middle arc
    or arcs are deepened.
    """
    w, r = Window.partitionBy("river_id", "vid"), Window.partitionBy("river_id")
    rows = arcs.withColumn("_m", F.max("arc_pos").over(r))
    bank = (F.col("arc_pos") == 0) | (F.col("arc_pos") == F.col("_m"))
    goal = F.min(F.when(bank, F.col("dp"))).over(w) + min_depth
    inner = ~bank
    if not all_but_banks:
        inner = inner & F.col("arc_pos").between(F.floor(F.col("_m") / 2), F.ceil(F.col("_m") / 2))
    return rows.withColumn("dp2", F.when(inner, F.greatest(F.col("dp"), goal)).otherwise(F.col("dp"))).drop("_m")


def crossing_places(lines: DataFrame, inside: str = "inside") -> DataFrame:
    """``line_id, inlet, outlet``: first vertex inside, and last vertex inside before the line first leaves; -1 if none."""
    w = along()
    rows = lines.withColumn("_next", F.lead(inside).over(w))
    return rows.groupBy("line_id").agg(
        F.coalesce(F.min(F.when(F.col(inside), F.col("vid"))), F.lit(-1)).alias("inlet"),
        F.coalesce(F.min(F.when(F.col(inside) & ~F.col("_next"), F.col("vid"))), F.lit(-1)).alias("outlet"),
    )


def feeder_extensions(heads: DataFrame, rings_test: Callable[[DataFrame], DataFrame], offsets: tuple[int, ...] = (2, 1, 0), lengths: tuple[float, ...] = (-10.0, -5.0, 0.0)) -> DataFrame:
    """Extension points of a feeder channel with the first offset whose points all lie outside.

    ``heads``: ``feeder_id, x, y, nx, ny, width`` with the unit normal;
    ``rings_test`` returns the given points that lie inside a river. An offset
    counts in widths; ``lengths`` are multiples of the width along the normal.
    """
    opts = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(o).alias("off")) for k, o in enumerate(offsets)]))
    ext = F.posexplode(F.array(*[F.lit(v) for v in lengths]))
    pts = heads.withColumn("o", opts).select("*", ext.alias("k", "len")).select(
        "feeder_id", F.col("o.ord").alias("ord"), F.col("o.off").alias("off"), "k",
        (F.col("x") + (F.col("len") - F.col("o.off")) * F.col("width") * F.col("nx")).alias("x"),
        (F.col("y") + (F.col("len") - F.col("o.off")) * F.col("width") * F.col("ny")).alias("y"),
    )
    bad = rings_test(pts).select("feeder_id", "ord").distinct()
    # What explodes is no part of an estimated size, so these tables would be broadcast as small ones.
    good = pts.select("feeder_id", "ord").distinct().join(bad.hint("merge"), ["feeder_id", "ord"], "left_anti")
    best = good.groupBy("feeder_id").agg(F.min("ord").alias("ord"))
    return pts.join(best.hint("merge"), ["feeder_id", "ord"]).select("feeder_id", "off", "k", "x", "y")


def arc_depths(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arc vertices with the depth ``dp`` of their nearest mesh node (``node_id, x, y, dp``)."""
    from .spatial import nearest

    keyed = arcs.withColumn("_q", F.xxhash64("river_id", "arc_pos", "vid"))
    hit = nearest(keyed, nodes, 1, qid="_q", pid="node_id").select(F.col("qid").alias("_q"), F.col("pid").alias("node_id"))
    return keyed.join(hit, "_q").join(nodes.select("node_id", "dp"), "node_id").drop("_q", "node_id")


def arcs_in_region(arcs: DataFrame, rings: DataFrame) -> DataFrame:
    """All arcs of rivers with an arc that meets a region."""
    from .spatial import lines_meeting_polygons

    lines = arcs.withColumn("line_id", F.struct("river_id", "arc_pos")).select("line_id", "vid", "x", "y")
    hit = lines_meeting_polygons(lines, rings).select(F.col("line_id.river_id").alias("river_id")).distinct()
    return arcs.join(hit, "river_id", "left_semi")


def match_centres(arcs: DataFrame, points: DataFrame) -> DataFrame:
    """``pid, river_id, vid, x, y``: nearest centreline vertex of each point (``pid, x, y``), which names its transect."""
    from .spatial import nearest

    centre = centrelines(arcs).withColumn("cid", F.xxhash64("river_id", "vid"))
    hit = nearest(points, centre, 1, qid="pid", pid="cid").select(F.col("qid").alias("pid"), F.col("pid").alias("cid"))
    return hit.join(centre, "cid").select("pid", "river_id", "vid", "x", "y")
