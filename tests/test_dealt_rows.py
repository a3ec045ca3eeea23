"""Rows that operators deal over the tasks."""

import numpy as np

from fluvial.operators import spatial


def shuffled(spark, act):
    """Rows that the stages of ``act`` wrote for other stages."""
    store = spark.sparkContext._jsc.sc().statusStore()
    every = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    rows = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for found in [every()] for i in range(found.size()))}
    seen = set(rows())
    act()
    return sum(n for k, n in rows().items() if k not in seen)


def test_nearest_deals_a_query_once(spark, monkeypatch):
    """Queries are not copied into every bin around them; a crowded bin's points lie in several arrays."""
    rng = np.random.default_rng(7)
    spots = rng.uniform(0, 10, (400, 2)).tolist()
    asked = rng.uniform(0, 10, (5000, 2)).tolist()
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "nid long, x double, y double")
    qs = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "qid long, x double, y double")
    best = lambda p, k: sorted(((x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1]), i) for i, (x, y) in enumerate(spots))[:k]
    found = []
    assert shuffled(spark, lambda: found.extend(spatial.nearest(qs, pts, 1, 1.0, pid="nid").collect())) < 5 * len(asked)
    assert sorted((r.qid, r.pid, r.d2) for r in found) == [(i, *best(p, 1)[0][::-1]) for i, p in enumerate(asked)]
    monkeypatch.setattr(spatial, "POINT_CHUNK", 2)
    few = spatial.nearest(qs.filter("qid < 50"), pts, 3, 1.0, pid="nid").collect()
    assert sorted((r.qid, r["rank"], r.pid) for r in few) == [(i, k + 1, v[1]) for i, p in enumerate(asked[:50]) for k, v in enumerate(best(p, 3))]


def test_ended_paths_are_done(spark, monkeypatch):
    """Rows whose path has ended and that no pointer shows take no part in further rounds; a long path asks for ten."""
    from fluvial.operators import flow

    edges = [(i, i + 1 if i < 600 else None) for i in range(601)] + [(i, i - 1 if i % 2 else None) for i in range(1000, 21000)]
    keep, written = flow.Workspace.keep, []

    def counted(self, df, label):
        back = keep(self, df, label)
        written.append(back.count())
        return back

    monkeypatch.setattr(flow.Workspace, "keep", counted)
    found = flow.accumulate(spark.createDataFrame(edges, "sind long, nxt long")).collect()
    assert sum(written) < 4 * len(edges)
    want = [(i, i + 1, 600, 600 - i) for i in range(601)] + [(i, 1, i - 1, 1) if i % 2 else (i, 2, i, 0) for i in range(1000, 21000)]
    assert sorted((r.sind, r.acc, r.outlet, r.depth) for r in found) == want
