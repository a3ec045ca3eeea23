"""The river-arc pipeline: dry run, wet run with its fallbacks, arcs with their extra information.

Every stage is a table keyed by line; lines take their case as a column, so all
lines go through each stage together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RiverConfig
from ..functions.exprs import arcs_for_width, encode_pieces, inner_arc_positions
from ..storage import cut
from . import arcs as ar
from . import sequence as se
from .tiles import all_or_nothing

#: Adds ``z`` to rows with ``x, y``; null where no tile gives a valid value.
Sampler = Callable[[DataFrame], DataFrame]


def with_levels(lines: DataFrame, sample: Sampler, cfg: RiverConfig) -> DataFrame:
    """Lines whose every vertex has an elevation, with their water level ``eta``."""
    rows = all_or_nothing(sample(lines.drop("z")), "line_id", "z").withColumn("z", F.col("z") * cfg.elev_scale)
    rows = se.thalweg_level(rows, "z")
    flat = (F.col("keep") == 1) | F.lit(cfg.elev_scale < 0)
    return rows.withColumn("eta", F.when(flat, F.lit(0.0)).otherwise(F.col("eta")))


def find_banks(lines: DataFrame, sample: Sampler, cfg: RiverConfig, spacing: float) -> DataFrame:
    """:func:`arcs.two_banks` of lines with ``eta``: first step on both sides that is not under water.

    Samples are not written down: a vertex's are one row again where they were
    made, and the place of a bank follows from its step.
    """
    length, steps = cfg.river_threshold[1] * 1.1, max(2, int(cfg.river_threshold[1] / spacing) * 2)
    rows, sides = se.normals(lines), {}
    for side in ("left", "right"):
        t = sample(ar.transects(rows, steps, length, side, ("eta",))).withColumn("z", F.col("z") * cfg.elev_scale)
        at = all_or_nothing(ar.sampled_bank_steps(t), "line_id", "whole").drop("whole")
        sides[side] = ar.at_steps(rows.join(at, ["line_id", "vid"]), steps, length, side).select("line_id", "vid", "x", "y")
    return cut(ar.two_banks(rows, sides["left"], sides["right"], cfg.river_threshold[0]), "banks")


def dry_run(lines: DataFrame, sample: Sampler, cfg: RiverConfig, spacing: float) -> DataFrame:
    """``line_id, vid, x, y, ..., width, valid``: bank search on the given lines.

    Dummy lines stay valid without a search. Lines without elevations, without
    banks, with a single vertex, or narrower than the least width (unless kept)
    are not valid.
    """
    lines = ar.with_flags(lines, {"dummy": 0, "keep": 0, "pin": 0})
    real, dummy = lines.filter("dummy = 0"), lines.filter("dummy = 1")
    if cfg.pseudo_channel == 1:
        found = ar.artificial_banks(real, cfg.pseudo_width).withColumn("valid", F.lit(True))
    else:
        b = find_banks(cut(with_levels(real, sample, cfg), "levels"), sample, cfg, spacing)
        narrow = F.col("status") == -1
        n = F.count(F.lit(1)).over(se.whole())
        valid = (F.col("status") == 0) & (n >= 2) | narrow & (F.col("keep") == 1)
        found = b.withColumn("width", F.when(narrow, F.lit(cfg.pseudo_width)).otherwise(F.col("width"))).withColumn("valid", valid)
    cols = ["line_id", "vid", "x", "y", "pin", "dummy", "keep", "width", "valid"]
    missing = real.join(found.select("line_id").distinct(), "line_id", "left_anti").withColumns({"width": F.lit(None).cast("double"), "valid": F.lit(False)})
    kept = dummy.withColumns({"width": F.lit(None).cast("double"), "valid": F.lit(True)})
    return found.select(cols).unionByName(missing.select(cols)).unionByName(kept.select(cols))


def _thin(lines: DataFrame, cfg: RiverConfig, rows_of_arcs, length_width: float, limits: tuple[float, float]) -> DataFrame:
    """Redistribute vertices by the curvature of the smoothed line and the width."""
    smooth = se.moving_average(se.moving_average(lines, "x", 100, 2.0), "y", 100, 2.0)
    wanted = se.resolution(smooth, "width", rows_of_arcs, cfg.r_coef, length_width, limits, cfg.endpoints_scale)
    spaced = lines.join(wanted.select("line_id", "vid", "reso"), ["line_id", "vid"])
    kept = se.thin(spaced.withColumn("pinned", (F.col("pin") > 0).cast("int")), "reso", "pinned").filter("kept").select("line_id", "vid")
    out = lines.join(kept, ["line_id", "vid"])
    pos = F.row_number().over(se.along()) - 1
    return cut(out.withColumn("vid", pos.cast("long")), "thinned")


def _correct(lines: DataFrame, sample: Sampler, cfg: RiverConfig, spacing: float) -> DataFrame:
    """Move thalweg vertices to the low of their cross-section, as far as half the smoothed width."""
    rows = se.normals(lines)
    if cfg.elev_scale < 0:
        rows = rows.withColumn("reach", F.lit(cfg.river_threshold[1] * 1.1))
    else:
        rows = se.moving_average(rows, "width", 10, out="reach").withColumn("reach", F.col("reach") * 0.5)
    far = rows.agg(F.max("reach")).first()[0] or 0.0
    steps, both = max(5, int(far / spacing) * 2), []
    for side in ("left", "right"):
        t = sample(ar.transects(rows, steps, F.col("reach"), side)).withColumn("z", F.col("z") * cfg.elev_scale)
        low = all_or_nothing(ar.sampled_lowest_steps(t), "line_id", "whole").drop("whole")
        low = rows.select("line_id", "vid", "x", "y", "perp", "reach").join(low, ["line_id", "vid"])
        both.append(ar.at_steps(low, steps, F.col("reach"), side))
    moved = ar.lower_side(*both).select("line_id", "vid", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return cut(
        lines.join(moved, ["line_id", "vid"], "left").withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).drop("_x", "_y"), "corrected"
    )


def _renumber(lines: DataFrame) -> DataFrame:
    return lines.withColumn("vid", (F.row_number().over(se.along()) - 1).cast("long"))


def river_arcs(lines: DataFrame, sample: Sampler, cfg: RiverConfig, spacing: float, max_arcs: int = 1000) -> DataFrame:
    """``river_id, arc_pos, vid, x, y, reso, n_arcs, is_outer, info, case``: the arcs of every valid line.

    The case tells how a line came by its arcs: 1 artificial channel asked for,
    2 no banks or too narrow, 3 banks found, 4 banks of bad quality. Cases 2
    and 4 fall back to an artificial channel if ``cfg.pseudo_channel`` is 2,
    else such lines are left out.
    """
    tried = cut(dry_run(lines, sample, cfg, spacing), "dry-run").filter("valid and dummy = 0")
    base = se.lift_smallest_width(tried, "width", out="width2").withColumn("width", F.col("width2")).drop("width2", "valid")
    mean_width = F.avg("width").over(se.whole())

    def arcs_of(rows: DataFrame) -> DataFrame:
        n = F.lit(cfg.pseudo_rows) if cfg.pseudo_channel == 1 else None
        if n is None:
            if callable(cfg.width_to_arcs):
                n = arcs_for_width(F.col("_mw"), cfg.min_arcs, custom=cfg.width_to_arcs)
            else:
                n = arcs_for_width(F.col("_mw"), cfg.min_arcs, cfg.width_to_arcs)
        return rows.withColumn("_mw", mean_width).withColumn("n_in", F.least(F.lit(max_arcs), n)).drop("_mw")

    cols = ["line_id", "vid", "x", "y", "pin", "keep", "width"]
    base = _thin(arcs_of(base), cfg, F.col("n_in"), cfg.length_width_ratio, cfg.along_channel_reso).select(cols)
    alone = F.count(F.lit(1)).over(se.whole())
    base = base.withColumn("_n", alone).filter("_n >= 2").drop("_n")
    if cfg.pseudo_channel == 1:
        banks = ar.artificial_banks(base, cfg.pseudo_width).withColumns({"case": F.lit(1), "n_in": F.lit(cfg.pseudo_rows)})
        return _arrange(banks, cfg)

    first = find_banks(cut(with_levels(base, sample, cfg), "levels"), sample, cfg, spacing).filter("status != -2")
    moved = _correct(first.select(cols), sample, cfg, spacing)
    second = find_banks(cut(with_levels(moved, sample, cfg), "levels"), sample, cfg, spacing).filter("status != -2")
    again = _thin(arcs_of(second.select(cols)), cfg, F.col("n_in"), cfg.length_width_ratio, cfg.along_channel_reso).select(cols)
    calm = cut(_renumber(ar.drop_sharp_turns(again, pin="pin")), "calm")
    last = find_banks(cut(with_levels(calm, sample, cfg), "levels"), sample, cfg, spacing)
    good = last.filter("status = 0")
    if cfg.nudge_banks:
        half = F.avg("width").over(se.whole()) * 0.5
        good = good.withColumn("_h", half)
        d = lambda x, y: F.hypot(F.col(x) - F.col("x"), F.col(y) - F.col("y"))
        for side, turn in (("l", se.PI), ("r", 0.0)):
            bx, by = f"x{side}", f"y{side}"
            goal = F.least(F.greatest(d(bx, by), F.col("_h") * 0.3), F.col("_h") * 2.0)
            nx, ny = F.col("x") + F.cos(F.col("perp") + turn) * goal, F.col("y") + F.sin(F.col("perp") + turn) * goal
            out = ~d(bx, by).between(F.col("_h") * 0.3, F.col("_h") * 2.0)
            good = good.withColumns({f"_{bx}": F.when(out, nx).otherwise(F.col(bx)), f"_{by}": F.when(out, ny).otherwise(F.col(by))})
            good = good.withColumns({bx: F.col(f"_{bx}"), by: F.col(f"_{by}")}).drop(f"_{bx}", f"_{by}")
        good = good.drop("_h")
    if cfg.smooth_banks:
        keep = ["line_id", "vid", "x", "y", "xl", "yl", "xr", "yr"]
        good = ar.smooth_bank(ar.smooth_bank(good.select(keep), ("xl", "yl")), ("xr", "yr"))
    good = arcs_of(good.withColumn("width", F.hypot(F.col("xl") - F.col("xr"), F.col("yl") - F.col("yr")))).withColumn("case", F.lit(3))
    banks = ["line_id", "vid", "x", "y", "xl", "yl", "xr", "yr", "width", "n_in", "case"]
    real = cut(_arrange(good.select(banks), cfg), "real-arcs")
    fine = ar.line_quality(real).filter("ok").select("river_id")
    done = real.join(fine, "river_id", "left_semi")
    if cfg.pseudo_channel != 2:
        return done
    poor = calm.join(real.select(F.col("river_id").alias("line_id")).distinct(), "line_id", "left_semi").join(
        fine.select(F.col("river_id").alias("line_id")), "line_id", "left_anti"
    ).withColumn("case", F.lit(4))
    lost = calm.join(real.select(F.col("river_id").alias("line_id")).distinct(), "line_id", "left_anti").withColumn("width", F.lit(cfg.pseudo_width))
    lost = _thin(lost, cfg, F.lit(cfg.pseudo_rows), cfg.length_width_ratio, (0.3 * cfg.pseudo_spacing, 1.1 * cfg.pseudo_spacing)).withColumn("case", F.lit(2))
    fallback = poor.select("line_id", "vid", "x", "y", "case").unionByName(lost.select("line_id", "vid", "x", "y", "case"))
    made = ar.artificial_banks(fallback, cfg.pseudo_width).withColumn("n_in", F.lit(cfg.pseudo_rows))
    return done.unionByName(_arrange(made.select(banks), cfg))


def _arrange(banks: DataFrame, cfg: RiverConfig) -> DataFrame:
    """Arcs between and beyond the banks; close vertices along an arc take the place of the one before."""
    fake = F.col("case") != 3
    inner = F.when(fake, inner_arc_positions(F.col("n_in"), "fake")).otherwise(inner_arc_positions(F.col("n_in"), cfg.position_type))
    pos = ar.arc_positions(inner, cfg.outer_arc_positions)
    rows = banks.withColumns({"reso": F.col("width") / (F.col("n_in") - 1), "n_arcs": F.size(pos)})
    arcs = ar.assemble_arcs(rows, pos)
    arcs = arcs.join(rows.select("line_id", "vid", "reso", "n_arcs", "case"), ["line_id", "vid"])
    keyed = arcs.withColumn("river_id", F.col("line_id")).withColumn("line_id", F.struct("river_id", "arc_pos"))
    snapped = se.snap_to_previous(keyed.withColumn("_r", F.col("reso") * cfg.snap_point_ratio), "_r")
    outer = (F.col("arc_pos") == 0) | (F.col("arc_pos") == F.col("n_arcs") - 1)
    return snapped.select(
        "river_id", "arc_pos", "vid", "x", "y", "reso", "n_arcs", outer.alias("is_outer"), encode_pieces([F.col("n_arcs"), outer.cast("int")]).alias("info"), "case"
    )


def drainage(cells: DataFrame, limit: int, tile: int = 256) -> dict[str, DataFrame]:
    """From elevations to a river network: grid filled with a least slope, directions, watersheds, lines.

    All tiles are processed, each stage being one table over all of them.
    """
    from .fill import fill_with_slope, slope_directions
    from .flow import accumulate, river_network

    filled = cut(fill_with_slope(cells, tile=tile), "filled")
    d8 = cut(slope_directions(filled, tile=tile), "d8")
    flow = cut(accumulate(d8.filter("dir >= 0")), "flow")
    return {"filled": filled, "d8": d8, "flow": flow, "lines": cut(river_network(d8, flow, limit, tile=tile), "lines")}


def prepare_flowlines(lines: DataFrame, area: DataFrame, key: str = "gnis_id", split: float = 15_000.0, densify: float = 20.0) -> DataFrame:
    """``line_id, vid, x, y, keep`` from raw flowlines: merge by name, part at the area's outline, split, densify.

    Lines merge only with lines of their name, also through nodes that they
    share with others. Parts inside and outside the area are both kept, as
    lines of their own. Lengths are metres; coordinates are degrees, a hundred-thousandth of a
    degree being taken for a metre.
    """
    from .linework import merge_lines
    from .spatial import cut_by_polygons, segments

    named = lines.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    segs = segments(named.withColumn("line_id", F.struct(F.col(key).alias("name"), "line_id")))
    merged = cut(merge_lines(segs.withColumn("name", F.col("line_id.name")), "name"), "merged")
    pieces = cut_by_polygons(merged, area, "both").withColumn("line_id", F.xxhash64("line_id", "piece")).drop("piece")
    parts = se.split_by_length(cut(pieces, "pieces"), split * 1e-5).withColumn("line_id", F.xxhash64("line_id", "part")).drop("part")
    dense = se.densify(cut(parts, "parts"), densify * 1e-5)
    pos = F.row_number().over(Window.partitionBy("line_id").orderBy("vid", "sub")) - 1
    return dense.withColumn("_v", pos.cast("long")).select("line_id", F.col("_v").alias("vid"), "x", "y", F.lit(1).alias("keep"))


def outline_polygons(arcs: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Outlines of rivers, and the faces of the noded arcs that lie in them."""
    from .linework import overlapping_polygons, polygonize
    from .spatial import node_lines

    rings = ar.outline_rings(arcs).select(F.col("river_id").alias("poly_id"), F.col("pos").alias("vid"), "x", "y")
    top = Window.partitionBy("poly_id")
    open_rings = rings.withColumn("_m", F.max("vid").over(top)).filter("vid < _m").drop("_m")
    along = arcs.withColumn("line_id", F.xxhash64("river_id", "arc_pos")).select("line_id", "vid", "x", "y")
    ends = ar.cross_channel_arcs(arcs).select(F.xxhash64("river_id", "vid", F.lit(-1)).alias("line_id"), F.col("arc_pos").cast("long").alias("vid"), "x", "y")
    faces = cut(polygonize(cut(node_lines(along.unionByName(ends)), "noded")), "faces")
    return open_rings, faces.join(overlapping_polygons(faces, open_rings, share), "poly_id", "left_semi")
