"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from .common import TextWorkspace, Workspace, sliced, table
from .segments import SegmentScheme
from .shingles import mix64, shingle_set

#: Odd constants of the two sums that name a set (fixed values).
_NAMES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_PIVOTS = 4


def set_name(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    first, second = (int(mix64(tokens ^ c).sum(dtype=np.uint64)) for c in _NAMES)
    return first - (first >> 63 << 64), second - (second >> 63 << 64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))


def _sign(scheme: SegmentScheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, sigs = [], []
            for text in batch.column(1):
                tokens = shingle_set(text.as_py())
                found, even, odd = scheme.subsets(tokens)
                rows.append((len(tokens), *set_name(tokens), even, odd))
                sigs.append(found)
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, _lists(sigs)], ["doc_id", "n", "s1", "s2", "even", "odd", "sigs"])

    return run


def _neighbourhoods(scheme: SegmentScheme):
    """Rows of whole subsets and one-deletion neighbourhoods of the named sets, in the bands asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            for rid, s1, s2, even, odd, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = shingle_set(text)
                if set_name(tokens) != (s1, s2):
                    continue
                for parity in [k for k, on in enumerate((even, odd)) if on]:
                    found = scheme.neighbourhood(tokens, parity)
                    if found:
                        sigs, segs, whole, wide, need, units = found
                        k = len(sigs)
                        parts = sigs.view(np.int64), np.full(k, rid), np.full(k, parity, np.int32), segs, whole, wide, np.full(k, need), np.full(k, units)
                        for column, part in zip(out, parts, strict=True):
                            column.append(part)
            if out[0]:
                names = ["sig", "rid", "parity", "seg", "whole", "wide", "need", "units"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        keep, sets = [], []
        for s1, s2, text in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), batch.column("text"), strict=True):
            tokens = shingle_set(text.as_py())
            keep.append(set_name(tokens) == (s1, s2))
            if keep[-1]:
                sets.append(tokens)
        kept = batch.select(["rid", "cluster", "blocks", "block", "pivot"]).filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*kept.columns, _lists(sets)], [*kept.schema.names, "tokens"])


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        r = self.root(i)
        for j in others.tolist():
            s = self.root(j)
            if s != r:
                r, s = min(r, s), max(r, s)
                self.up[s] = r

    def labels(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up


def link_block(flat: np.ndarray, size: np.ndarray, num: int, den: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Component label (least position) of each set under exact Jaccard links.

    The sets lie in ``flat`` one after the other. Intersections come from an
    inverted index. With ``asked``, a mask, only links of these sets with any
    are looked for. Without, a few pivots first gather the largest component;
    as every pair of different components has a member outside it, only the
    sets outside are then held against all.
    """
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    values, holders = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    stops = np.append(starts[1:], len(values))
    token = np.empty(len(flat), np.int64)
    token[order] = np.repeat(np.arange(len(starts)), stops - starts)
    first = np.concatenate(([0], np.cumsum(size)))
    forest = _Forest(n)
    done = np.zeros(n, bool)

    def compare(i: int) -> None:
        done[i] = True
        mine = token[first[i] : first[i + 1]]
        lo, ln = starts[mine], stops[mine] - starts[mine]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(ln)[:-1])), ln) + np.arange(ln.sum())
        both = np.bincount(holders[at], minlength=n)
        linked = np.flatnonzero(both * den >= num * (size[i] + size - both))
        forest.join(i, linked)

    if asked is None:
        for _ in range(min(_PIVOTS, n)):
            labels = forest.labels()
            rest = np.flatnonzero((labels != np.bincount(labels, minlength=n).argmax()) & ~done) if done.any() else np.arange(n)
            if not len(rest):
                break
            compare(int(rest[0]))
        labels = forest.labels()
        asked = (labels != np.bincount(labels, minlength=n).argmax()) & ~done
    for i in np.flatnonzero(asked).tolist():
        compare(i)
    return forest.labels()


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _link_sorted(num: int, den: int, keys: int):
    """Links in runs of equal keys (the first ``keys`` columns); rows must come sorted by them.

    The columns after the keys are ``asked, rid, tokens``. A row with
    ``asked`` null is held against all of its run; else only asked rows are.
    Memory holds one run.
    """

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        run = pa.Table.from_batches(parts).combine_chunks()
        ids = run.column("rid").to_numpy()
        flat, size = _flat(run.column("tokens").chunk(0))
        some = run.column("asked").chunk(0)
        labels = link_block(flat, size, num, den, None if some.null_count else some.to_numpy(zero_copy_only=False))
        moved = ids[labels] != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[labels][moved])], ["rid", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, last = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in range(keys)] + [batch.column("rid").to_numpy()], 1)
            again = np.concatenate(([last is not None and bool((at[0] == last).all())], (at[1:] == at[:-1]).all(1)))
            last = at[-1]
            # A set that comes again, from a repeated row or as asked and not, counts once.
            batch, at = batch.filter(pa.array(~again)), at[~again, :keys]
            if not batch.num_rows:
                continue
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and tuple(at[lo]) != key:
                    yield solve(held)
                    held = []
                key = tuple(at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solve(held)

    return run


def _link(rows: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    dealt = rows.select(*keys, "asked", "rid", "tokens").repartition(*keys).sortWithinPartitions(*keys, "rid", F.desc("asked"))
    return dealt.mapInArrow(_link_sorted(num, den, len(keys)), "rid long, linked long")


def _parity(sig: str):
    return F.col(sig).bitwiseAND(F.lit(1)).cast("int")


def _shared_subsets(spread: DataFrame, total: int, sample: int, ws: Workspace) -> DataFrame:
    """``sig, rid, freq`` of the whole subsets that two sets hold or more, with the number of their holders.

    Signatures that a bounded sample of the sets shows to be frequent are known
    to be shared; they are dealt over 64 buckets each and their number is that
    of the sample, scaled. So no signature gathers more than a small share of
    all rows in one task.
    """
    share = min(1.0, sample / max(1, total))
    often = max(64, int(share * total) // 200)
    hot = ws.keep(
        spread.filter(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int(share * (1 << 20)))
        .groupBy("sig")
        .count()
        .filter(F.col("count") >= often)
        .select("sig", F.ceil(F.col("count") / share).alias("est")),
        "hot",
    )
    # Bounded: by the sample's subsets over ``often``; longest lists first if very long texts make it more.
    marked = spread.join(F.broadcast(hot.orderBy(F.desc("est"), "sig").limit(50_000)), "sig", "left").withColumn(
        "salt", F.when(F.col("est").isNotNull(), F.pmod(F.xxhash64("rid"), F.lit(64))).otherwise(0).cast("int")
    )
    counted = marked.withColumn("freq", F.coalesce("est", F.count(F.lit(1)).over(Window.partitionBy("sig", "salt"))))
    return ws.keep(counted.filter("freq > 1").select("sig", "rid", "freq"), "shared")


def _allocate_subsets(shared: DataFrame, nodes: DataFrame, far_tokens: int) -> DataFrame:
    """``sig, rid, dear``: the cheapest lists that give a set H + 1 units by whole subsets alone.

    A set whose subsets that nobody shares give H + 1 units is out. ``dear``
    marks the sets for which whole subsets give too few units or need a list
    whose sets have more than ``far_tokens`` tokens; these keep all their lists.
    """
    per = Window.partitionBy("rid", "parity")
    slack = F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd"))
    ranked = (
        shared.withColumn("parity", _parity("sig"))
        .join(nodes.select("rid", "n", "even", "odd"), "rid")
        .select("sig", "rid", "freq", "parity", "n", slack.alias("slack"))
        .withColumn("rank", F.row_number().over(per.orderBy("freq", "sig")))
        .withColumn("held", F.count(F.lit(1)).over(per))
        .filter("held >= slack")
        .withColumn("taken", F.col("rank") <= F.col("held") - F.col("slack") + 1)
        .withColumn("longest", F.max(F.when(F.col("taken"), F.col("freq"))).over(per))
        .withColumn("dear", (F.col("slack") <= 0) | (F.col("longest") * F.col("n") > far_tokens))
    )
    return ranked.filter("taken or dear").select("sig", "rid", "dear")


def _allocate_deletions(emitted: DataFrame, ws: Workspace) -> DataFrame:
    """``rid, hub`` edges from the cheapest H + 1 units of whole subsets and one-deletion neighbourhoods.

    The costs are counted: a segment's first unit meets the holders of the
    same subset, its second one those whose subset is one token larger or
    smaller. Units that meet nobody cost nothing and are taken first.
    """
    one = F.col("whole").cast("long")
    totals = (
        emitted.groupBy("sig").agg(F.sum(one).alias("w"), F.sum(1 - one).alias("d"), F.min("rid").alias("hub")).filter("w >= 1 and w + d >= 2")
    )
    totals = ws.keep(totals, "totals")
    met = ws.keep(emitted.join(totals, "sig"), "met")
    first = F.sum(F.when(F.col("whole"), F.col("w") - 1).otherwise(0))
    second = F.sum(F.when(F.col("whole"), F.col("d")).otherwise(F.col("w")))
    segs = met.filter("seg >= 0").groupBy("rid", "parity", "seg").agg(
        first.alias("c0"), second.alias("c1"), F.max("wide").alias("wide"), F.max(F.col("need") - F.col("units")).alias("short")
    )
    both = F.array(F.struct(F.col("c0").alias("cost"), F.lit(1).alias("unit")), F.struct(F.greatest("c0", "c1").alias("cost"), F.lit(2).alias("unit")))
    per = Window.partitionBy("rid", "parity")
    units = (
        segs.select("rid", "parity", "seg", "wide", "short", F.explode(both).alias("u"))
        .select("rid", "parity", "seg", "wide", "short", "u.cost", "u.unit")
        .filter("unit = 1 or wide")
        .withColumn("rank", F.row_number().over(per.orderBy("cost", "unit", "seg")))
        # The units not listed meet nobody and are taken before these.
        .withColumn("listed", F.count(F.lit(1)).over(per))
        .filter("rank <= short + listed")
        .select("rid", "parity", "seg", "unit")
    )
    asked = met.join(units, ["rid", "parity", "seg"]).filter("(whole and unit = 1 and w > 1) or (whole and unit = 2 and d > 0) or (not whole and unit = 2)")
    # The signature that sets with too few units have in common is asked for by all of them.
    lists = asked.select("sig").union(met.filter("seg = -1").select("sig")).distinct()
    return met.join(lists, "sig", "left_semi").select("rid", "hub")


def _candidate_edges(docs: DataFrame, nodes: DataFrame, spread: DataFrame, scheme: SegmentScheme, far_tokens: int, sample: int, ws: Workspace) -> DataFrame:
    """``rid, hub``: for every list that an allocation uses, an edge from each holder to the least one."""
    shared = _shared_subsets(spread, nodes.count(), sample, ws)
    taken = ws.keep(_allocate_subsets(shared, nodes, far_tokens), "taken")
    ws.drop(shared)
    hubs = taken.groupBy("sig").agg(F.min("rid").alias("hub"), F.min("dear").alias("all_dear"), F.count(F.lit(1)).alias("holders"))
    # Tables that carry one row a hot key are written before their joins, so that adaptive execution can split the other side.
    hubs = ws.keep(hubs.filter("holders > 1 and not all_dear").select("sig", "hub"), "hubs")
    edges = taken.join(hubs, "sig").select("rid", "hub")
    dear = taken.filter("dear").select("rid", (_parity("sig") == 0).alias("even"), (_parity("sig") == 1).alias("odd"))
    dear = dear.union(nodes.filter("even <= 0 or odd <= 0").select("rid", F.col("even") <= 0, F.col("odd") <= 0))
    dear = ws.keep(dear.groupBy("rid").agg(F.max("even").alias("even"), F.max("odd").alias("odd")), "dear")
    if dear.limit(1).count():
        named = dear.join(nodes.select("rid", "doc_id", "s1", "s2"), "rid")
        texts = named.join(docs, "doc_id").select("rid", "s1", "s2", "even", "odd", "text")
        schema = "sig long, rid long, parity int, seg int, whole boolean, wide boolean, need long, units long"
        emitted = ws.keep(texts.mapInArrow(_neighbourhoods(scheme), schema).dropDuplicates(["rid", "sig", "seg", "whole"]), "emitted")
        edges = edges.union(_allocate_deletions(emitted, ws))
    return ws.keep(edges.filter("rid != hub").distinct(), "candidates")


def _verified_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, num: int, den: int, block_tokens: int, ws: Workspace) -> DataFrame:
    """``rid, linked``: exact links that give the same components as all links inside the clusters.

    A cluster of up to ``block_tokens`` tokens is one task. A larger one is cut
    into blocks: each block is verified by itself together with a few pivots of
    the cluster, which gathers most of a group of near copies in linear work;
    the sets outside a cluster's largest component are then held against all
    blocks. Two sets of different components cannot both be in the largest one,
    so no link is lost.
    """
    rows = clusters.join(nodes.select("rid", "doc_id", "n", "s1", "s2"), "rid")
    picks = F.array(*[F.min_by("rid", F.xxhash64("rid", F.lit(k))) for k in range(_PIVOTS)])
    heads = ws.keep(rows.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block_tokens)).cast("int").alias("blocks"), picks.alias("pivots")), "heads")
    members = rows.join(heads, "cluster").select(
        "rid", "doc_id", "s1", "s2", "cluster", "blocks",
        F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"),
        ((F.col("blocks") > 1) & F.array_contains("pivots", F.col("rid"))).alias("pivot"),
    )
    members = ws.keep(members, "members")
    texts = docs.join(members, "doc_id").select("rid", "s1", "s2", "cluster", "blocks", "block", "pivot", "text")
    schema = "rid long, cluster long, blocks int, block int, pivot boolean, tokens array<long>"
    sets = ws.keep(texts.mapInArrow(_tokens, schema), "tokens")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = sets.select(
        "cluster", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("block"))).alias("block"), F.lit(None).cast("boolean").alias("asked"), "rid", "tokens"
    )
    links = ws.keep(_link(own, ["cluster", "block"], num, den), "links")
    large = sets.filter("blocks > 1")
    if not large.limit(1).count():
        return links
    named = components(links, "rid", "linked").select(F.col("id").alias("rid"), "component")
    placed = large.select("rid", "cluster").join(named, "rid", "left").select("rid", "cluster", F.coalesce("component", "rid").alias("label"))
    placed = ws.keep(placed, "placed")
    most = placed.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    outside = placed.join(ws.keep(most, "most"), "cluster").filter("label != main").select("rid")
    outside = ws.keep(large.join(outside, "rid", "left_semi"), "outside")
    parts = ws.keep(outside.groupBy("cluster").agg(F.ceil(F.sum(F.size("tokens")) / F.lit(block_tokens)).cast("int").alias("parts")), "parts")
    asked = outside.join(parts, "cluster").select(
        "cluster", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.explode(every).alias("block"), F.lit(True).alias("asked"), "rid", "tokens"
    )
    rest = large.join(parts, "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.lit(False).alias("asked"), "rid", "tokens"
    )
    more = ws.keep(_link(asked.union(rest), ["cluster", "part", "block"], num, den), "more-links")
    return links.union(more)


def jaccard_classes(
    docs: DataFrame,
    num: int = 80,
    den: int = 100,
    block_tokens: int = 100_000,
    far_blocks: int = 16,
    sample: int = 20_000,
    scheme: SegmentScheme | None = None,
) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their five-word shingle sets.

    Two documents link when ``den * intersection >= num * union``. Output:
    ``doc_id, n_shingles, component_id``, a row for each input row; the
    component is the least id reachable by links.

    1. Every text becomes a set, a 128-bit name of it and the signatures of its
       segments' whole subsets (:class:`SegmentScheme`). Equal sets are one
       from here on; membership comes back at the end by a join.
    2. Subset signatures are counted. Subsets that nobody else holds are units
       at no cost, and sets to which they give H + 1 units have no partner.
    3. The others take the cheapest lists by these counts. Where whole subsets
       give too few units, or the cheapest lists include one of more than
       ``far_blocks`` tasks of verification, one-deletion neighbourhoods are
       emitted and counted as well and the cheapest units of both kinds are
       taken. It is enough that one set of a pair looks the other up, so only
       pairs of such sets need them.
    4. Holders of a list in use form candidate clusters by one edge each to
       the list's least holder, never by pairs.
    5. Clusters are verified exactly in tasks of a bounded number of tokens
       (:func:`_verified_links`); components of the links are the classes.

    The check is exact on 64-bit hashes of shingles: two different shingles of
    a pair of documents are taken for one with a chance of 2**-64 each; two
    different sets share a name with a chance of 2**-128.

    Null, empty and blank texts have no shingles and link with nothing. A very
    long text is one set like any other. Rows that repeat an id count as one
    document with the links of any of them. A row without id links with nothing
    and its component is null. An empty table gives no rows. Other columns of
    ``docs`` are ignored.
    """
    scheme = scheme or SegmentScheme(num, den)
    ws = TextWorkspace(docs.sparkSession, "jaccard")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = ws.keep(
        base.mapInArrow(_sign(scheme), "doc_id long, n long, s1 long, s2 long, even long, odd long, sigs array<long>").withColumn("rid", F.monotonically_increasing_id()),
        "signed",
    )
    usable = signed.filter("doc_id is not null and n > 0")
    firsts = ws.keep(usable.groupBy("n", "s1", "s2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least")), "firsts")
    known = usable.select("rid", "doc_id", "n", "s1", "s2", "even", "odd").join(firsts, ["n", "s1", "s2"])
    known = ws.keep(known.select("rid", "doc_id", "n", "s1", "s2", "even", "odd", "rep", "least"), "known")
    nodes = known.filter("rid = rep")
    copies = ws.keep(known.filter("rid != rep").select("rid"), "copies")
    spread = usable.select("rid", "sigs").join(copies, "rid", "left_anti").select("rid", F.explode("sigs").alias("sig"))
    candidates = _candidate_edges(base, nodes, spread, scheme, far_blocks * block_tokens, sample, ws)
    clusters = components(candidates, "rid", "hub").select(F.col("id").alias("rid"), F.col("component").alias("cluster"))
    links = _verified_links(base, nodes, clusters, num, den, block_tokens, ws)

    # Different sets of one id are one document.
    ids = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a != b")
    same = known.join(ids, "doc_id").select("rep", "a").filter("rep != a")
    classes = components(links.union(same), "rid", "linked").select(F.col("id").alias("rep"), "component")
    classes = ws.keep(classes.join(known.groupBy("rep").agg(F.min("doc_id").alias("least")), "rep"), "classes")
    named = ws.keep(classes.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    final = ws.keep(classes.join(named, "component").select("rep", "component_id"), "final")
    found = known.join(final, "rep", "left").select("rid", F.coalesce("component_id", "least").alias("component_id"))
    out = signed.select("rid", "doc_id", "n").join(found, "rid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    out = ws.keep(out, "out")
    ws.clear(out)
    return out


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Similarity classes of all documents."""
    return jaccard_classes(table(spark, sf_dir, "documents"))
