"""Flow over the D8 graph by pointer doubling: accumulation, outlets, watersheds, stems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Workspace, cut
from .raster import main_upstream


def accumulate(edges: DataFrame, key: str = "sind", nxt: str = "nxt", weight: str | None = None) -> DataFrame:
    """``sind, acc, outlet, depth``: cells upstream with itself, terminal cell and steps to it.

    Round k lets every cell know 2**k steps: values go to the pointed-to cell,
    then pointers double. Each round costs two shuffles of active rows, those that
    have not ended or that a pointer shows; the
    rounds are about log2 of the longest path, not of the table. A path has no
    more steps than there are cells, so a pointer that is left after log2 of
    their number lies on or leads to a loop: outlet, acc and depth are null.
    """
    state = _follow(edges, key, nxt, weight)
    return state.select(
        "sind", F.when(F.col("ptr").isNull(), F.col("acc")).alias("acc"), F.when(F.col("ptr").isNull(), F.col("outlet")).alias("outlet"),
        F.when(F.col("ptr").isNull(), F.col("depth")).alias("depth"),
    )


def _follow(edges: DataFrame, key: str, nxt: str, weight: str | None = None) -> DataFrame:
    """``sind, ptr, acc, outlet, depth``: the state of :func:`accumulate` after its last round; ``ptr`` is set where a path does not end."""
    start = edges.select(
        F.col(key).alias("sind"), F.col(nxt).alias("ptr"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("acc"),
        F.when(F.col(nxt).isNull(), F.col(key)).alias("outlet"), F.when(F.col(nxt).isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"),
    )
    ws = Workspace(edges.sparkSession, "flow")
    table = ws.keep(start.withColumn("asked", F.lit(True)), "state")
    kept = []
    for _ in range(table.count().bit_length() + 1):
        # New pointers show only where pointers have shown, so an ended row that none shows is done and stays in its table.
        state = table.filter("ptr is not null or asked")
        live = state.filter("ptr is not null")
        if live.limit(1).count() == 0:
            break
        got = live.groupBy(F.col("ptr").alias("sind")).agg(F.try_sum("acc").alias("more"), F.lit(True).alias("asked"))
        far = state.select(
            F.col("sind").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("outlet").alias("outlet2"), F.col("depth").alias("depth2")
        )
        moved = live.join(far, "ptr").select(
            "sind", F.col("ptr2").alias("ptr"), "acc",
            F.coalesce("outlet2", F.when(F.col("ptr2").isNull(), F.col("ptr"))).alias("outlet"),
            (F.col("depth") + F.col("depth2")).alias("depth"),
        )
        ended = state.filter("ptr is null").drop("asked")
        after = ws.keep(
            moved.unionByName(ended).join(got, "sind", "left").select(
                # Along a loop the sums double each round and may pass 64 bits; such cells get null in the end.
                "sind", "ptr", F.try_add("acc", F.coalesce("more", F.lit(0))).alias("acc"), "outlet", "depth", F.coalesce("asked", F.lit(False)).alias("asked")
            ),
            "state",
        )
        if table.filter("ptr is null and not asked").limit(1).count():
            kept.append(table)
        else:
            ws.drop(table)
        table = after
    ws.clear(table, *kept)
    for done in kept:
        table = table.unionByName(done.filter("ptr is null and not asked"))
    return table.drop("asked")


def loop_flags(edges: DataFrame, key: str = "sind", nxt: str = "nxt") -> DataFrame:
    """``sind, flag``: 0 the path ends, 1 the cell lies on a loop, 2 its path runs into one.

    After more steps than there are cells every path that does not end is on
    its loop, and going on turns a loop into itself: so the cells that such
    paths then point to are the cells of the loops, in as many rounds as
    doubling takes.
    """
    state = cut(_follow(edges, key, nxt).select("sind", "ptr"), "loop")
    loops = state.filter("ptr is not null").select(F.col("ptr").alias("sind")).distinct().withColumn("on", F.lit(True))
    return state.join(loops, "sind", "left").select("sind", F.when(F.col("ptr").isNull(), 0).when(F.col("on"), 1).otherwise(2).alias("flag"))


def downstream_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, step, sind``: all cells from each start to its terminal cell.

    Paths are built by doubling: from the first 2**k cells of every path and
    the jump of 2**k steps come the next 2**k. A path has no more steps than
    there are edges, so a start with a longer one runs into a loop, which
    raises before any path is built.
    """
    ws = Workspace(edges.sparkSession, "paths")
    jump = ws.keep(edges.select(F.col("sind").alias("a"), F.col("nxt").alias("b")).filter("b is not null"), "jump")
    jumps = []
    for _ in range(jump.count().bit_length() + 1):
        if starts.join(jump, starts["sind"] == jump["a"], "left_semi").limit(1).count() == 0:
            break
        jumps.append(jump)
        nxt = jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        jump = ws.keep(nxt, "jump")
    else:
        raise ValueError("a downstream path does not end: it runs into a loop")
    paths = ws.keep(starts.select(F.col("sind").alias("start"), F.lit(0).cast("long").alias("step"), "sind"), "path")
    for k, jump in enumerate(jumps):
        more = paths.join(jump, paths["sind"] == jump["a"]).select("start", (F.col("step") + (1 << k)).alias("step"), F.col("b").alias("sind"))
        longer = ws.keep(paths.unionByName(more), "path")
        ws.drop(paths, jump)
        paths = longer
    ws.clear(paths)
    return paths


def rank_watersheds(flow: DataFrame) -> DataFrame:
    """Outlets by accumulation: ``outlet, seg, acc``; the largest is 1, ties to the larger index."""
    # Sorting all outlets needs one order over them; range partitioning keeps it distributed.
    outlets = flow.filter("sind = outlet").select("outlet", "acc")
    order = cut(outlets.orderBy(F.desc("acc"), F.desc("outlet")).withColumn("part", F.spark_partition_id()), "rank")
    local = Window.partitionBy("part").orderBy(F.desc("acc"), F.desc("outlet"))
    sizes = order.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return order.join(F.broadcast(base), "part").select(
        "outlet", (F.row_number().over(local) + F.col("base")).cast("long").alias("seg"), "acc"
    )


def watersheds(d8: DataFrame) -> DataFrame:
    """``sind, acc, outlet, seg`` with segments numbered by the outlets' accumulation."""
    flow = cut(accumulate(d8.filter("dir >= 0")), "watershed")
    ranks = rank_watersheds(flow).select("outlet", "seg")
    return flow.join(ranks, "outlet").select("sind", "acc", "outlet", "seg")


def add_external(d8: DataFrame, external: DataFrame) -> DataFrame:
    """``sind, acc_ext``: external inflow (``sind, acc``) summed down each path."""
    weights = external.groupBy("sind").agg(F.sum("acc").alias("w"))
    with_w = d8.filter("dir >= 0").join(weights, "sind", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    return accumulate(with_w, weight="w").select("sind", F.col("acc").alias("acc_ext"))


def stems(d8: DataFrame, flow: DataFrame, limit: int, tile: int = 512) -> DataFrame:
    """``river, stem, vid, sind``: main stems and tributaries of every outlet.

    From each outlet the stem climbs the neighbour with most accumulation; all
    other neighbours of at least ``limit`` start tributaries, which begin with
    their junction. ``stem`` is a stem's lowest own cell, ``vid`` counts
    upstream from 0.
    """
    joined = d8.join(flow.select("sind", "acc", "outlet"), "sind")
    up = cut(main_upstream(joined, "acc", limit, tile).filter("up_main >= 0").select("sind", "up_main"), "stem-up")
    main_of = up.select(F.col("up_main").alias("sind"), F.col("sind").alias("below"))
    cells = joined.join(main_of, "sind", "left").select("sind", "nxt", "acc", "outlet", "below").filter(
        (F.col("acc") >= limit) | F.col("nxt").isNull()
    )
    # ``below`` is set where the cell carries on the stem of its downstream cell.
    traced = accumulate(cells.select("sind", F.col("below").alias("nxt")))
    own = cells.join(traced.select("sind", F.col("outlet").alias("stem"), F.col("depth").alias("vid")), "sind")
    heads = own.filter("stem = sind and nxt is not null").select("outlet", "stem", F.lit(0).cast("long").alias("vid"), F.col("nxt").alias("sind"))
    shift = own.join(heads.select("stem", F.lit(1).alias("one")), "stem", "left").select(
        "outlet", "stem", (F.col("vid") + F.coalesce("one", F.lit(0))).alias("vid"), "sind"
    )
    return shift.unionByName(heads).select(F.col("outlet").alias("river"), "stem", "vid", "sind")


def river_network(d8: DataFrame, flow: DataFrame, limit: int, parity: bool = False, tile: int = 512) -> DataFrame:
    """River lines from :func:`stems`.

    A river is kept if it has more than three entries, a separator for each
    stem counted. ``parity`` repeats each stem's last cell as the original
    format does; otherwise stems of a single cell are dropped.
    """
    lines = cut(stems(d8, flow, limit, tile), "stems")
    top = lines.groupBy("river", "stem").agg(F.max("vid").alias("vid"), F.max_by("sind", "vid").alias("sind"), F.count(F.lit(1)).alias("n"))
    if parity:
        lines = lines.unionByName(top.select("river", "stem", (F.col("vid") + 1).alias("vid"), "sind"))
        size = top.groupBy("river").agg(F.sum(F.col("n") + 2).alias("entries"))
    else:
        lines = lines.join(top.filter("n > 1").select("river", "stem"), ["river", "stem"], "left_semi")
        size = top.filter("n > 1").groupBy("river").agg(F.sum(F.col("n") + 1).alias("entries"))
    return lines.join(size.filter("entries > 3"), "river", "left_semi")


def split_at_junctions(lines: DataFrame) -> DataFrame:
    """``feature, pos, sind``: stems cut at the junctions of their tributaries, with running numbers inside a stem."""
    first = lines.filter("vid = 0").join(lines.groupBy("stem").agg(F.min("sind").alias("_any")), "stem").filter("stem != sind")
    junctions = first.select(F.col("sind").alias("j")).distinct()
    marked = lines.join(junctions, F.col("sind") == F.col("j"), "left").withColumn("is_j", F.col("j").isNotNull().cast("int"))
    w = Window.partitionBy("stem").orderBy("vid")
    last = F.max("vid").over(Window.partitionBy("stem"))
    inner = F.when((F.col("vid") > 0) & (F.col("vid") < last), F.col("is_j")).otherwise(F.lit(0))
    marked = marked.withColumn("cutpoint", inner)
    part = F.sum("cutpoint").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("section", F.coalesce(part, F.lit(0)))
    # A junction ends one section and starts the next.
    again = marked.filter("cutpoint = 1").withColumn("section", F.col("section") + 1)
    both = marked.unionByName(again)
    pos = F.row_number().over(Window.partitionBy("stem", "section").orderBy("vid")) - 1
    return both.select("river", "stem", F.col("section").cast("long").alias("section"), pos.cast("long").alias("pos"), "sind")


def external_inflow(outlets: DataFrame, border: DataFrame, reach: float) -> DataFrame:
    """``sind, acc``: accumulation that outlets of neighbouring tiles hand to a tile's border cells.

    ``outlets``: ``out_id, x, y, z, acc``; ``border``: ``sind, x, y, z``. An
    outlet goes to its nearest border cell if that lies within ``reach`` and
    lower; what a cell gets is summed.
    """
    from .spatial import nearest

    hit = nearest(outlets, border, 1, qid="out_id", pid="sind").select(F.col("qid").alias("out_id"), F.col("pid").alias("sind"), "d2")
    rows = hit.filter(F.col("d2") <= reach * reach).join(outlets.select("out_id", F.col("z").alias("zo"), "acc"), "out_id").join(
        border.select("sind", "z"), "sind"
    )
    return rows.filter("z < zo").groupBy("sind").agg(F.sum("acc").alias("acc"))
