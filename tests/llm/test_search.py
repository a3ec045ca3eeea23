import numpy as np
import pytest

from fluvial.llm.neighbours import AnnParameters, CellIndex, adaptive_scan, nearest_neighbours
from fluvial.llm.topk import SortedLists, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(np.float32(v)) for v in r], 0) for i, r in zip(ids, x)], SCHEMA)


def test_sorted_lists_equal_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, d = int(rng.integers(1, 90)), int(rng.integers(1, 9))
        v, ids = rng.integers(-3, 4, (n, d)), rng.permutation(1000)[:n]
        q = rng.integers(-3, 4, d) if trial % 5 else np.zeros(d, int)
        found, scores = SortedLists(ids, v).top(q, 7, int(ids[0]), step=1)
        s = v @ q
        order = [i for i in np.lexsort((ids, -s)) if i != 0][:7]
        assert found.tolist() == ids[order].tolist() and scores.tolist() == s[order].tolist()


def test_lists_stop_early_on_skewed_scores():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 1000, (5000, 2)), axis=0)
    lists = SortedLists(np.arange(5000), v)
    assert lists.top(np.array([5, 3]), 5)[0].tolist() == list(np.lexsort((np.arange(5000), -(v @ [5, 3])))[:5])


def test_top_inner_products(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((330, 8)).astype(np.float32)
    x[7] = x[8] = x[9]
    got = top_inner_products(table(spark, x), row_block=64, query_block=2).toPandas()
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    for q in range(0, 330, 100):
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(330), -s)) if i != q][:10]
        g = got[got["query_id"] == q].sort_values("rank")
        assert g["vec_id"].tolist() == want and g["score"].tolist() == s[want].tolist() and g["rank"].tolist() == list(range(1, 11))


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal(64)
    d = ((x - q) ** 2).sum(1)
    kept = adaptive_scan(q, x, 10, 16, 2.1, chunk=200)
    assert len(kept) < 1500 and len(set(np.argsort(d)[:10]) - set(kept)) <= 1


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[20] = x[100]
    got = nearest_neighbours(table(spark, x), params=AnnParameters(block=100)).toPandas()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        g = got[got["query_id"] == q].sort_values("rank")
        assert np.allclose(g["score"], d[g["vec_id"]], rtol=1e-12) and g["score"].is_monotonic_increasing
        hits += len(set(want) & set(g["vec_id"]))
    assert hits >= 0.9 * 150
    assert got[got["query_id"] == 100].sort_values("rank")["vec_id"].iloc[0] == 20


@pytest.mark.parametrize("search", [nearest_neighbours, top_inner_products])
def test_odd_vectors_and_few_rows(spark, search):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (None, [1.0, 1.0], 1), (1, [0.5, 0.5], 1)]
    got = search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1), (0, 1)]
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_query_ids_and_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 4)).astype(np.float32).astype(float)
    rows = [(i + 1, list(map(float, r)), 0) for i, r in enumerate(x)] + [(100, [0.5, 0.0, 0.0, 0.0], 0)] * 25
    short = [(200, [1.0, 0.0], 0), (201, [0.0, 1.0], 0), (202, [1.0, 0.5], 0)]
    got = nearest_neighbours(spark.createDataFrame(rows + short, SCHEMA)).collect()
    d = np.sqrt(((x - [0.5, 0.0, 0.0, 0.0]) ** 2).sum(1))
    at = {(r.query_id, r.rank): r.vec_id for r in got}
    assert len(at) == len(got) == 12
    assert [at[100, k] for k in range(1, 11)] == (np.argsort(d)[:10] + 1).tolist()
    assert [at[200, k] for k in (1, 2)] == [202, 201]


def test_every_query_has_k_neighbours_and_two_levels_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    docs = table(spark, x)
    for p, least in ((AnnParameters(), 0.9), (AnnParameters(max_centres=6, anchors=64, block=40), 0.9), (AnnParameters(min_probes=1, target=0.01, anchors=20), 0)):
        got = nearest_neighbours(docs, params=p).toPandas()
        hits = 0
        for q in range(0, 3000, 100):
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
            want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
            g = got[got["query_id"] == q].sort_values("rank")
            assert len(set(g["vec_id"])) == 10 and g["rank"].tolist() == list(range(1, 11))
            hits += len(set(want) & set(g["vec_id"]))
        assert hits >= least * 300


def test_cells_of_two_levels():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 8))
    one, two = CellIndex(x, 40, 64, 0), CellIndex(x, 40, 8, 0)
    assert one.cells == 40 and len(one.fine) == 1 and two.cells == 40 and len(two.fine) == 5
    for index in (one, two):
        home, order = index.home(x), index.ranked(x[:50], index.cells)
        assert home.max() < index.cells and all(sorted(o) == list(range(index.cells)) for o in order)
        assert np.mean([home[i] in order[i][:4] for i in range(50)]) > 0.8


def test_floor_changes_no_result_and_large_components():
    rng = np.random.default_rng(9)
    v, ids = rng.integers(-9, 10, (400, 5)), rng.permutation(1000)[:400]
    lists = SortedLists(ids, v)
    for q in rng.integers(-9, 10, (40, 5)):
        best = lists.top(q, 6)
        for floor in (int(best[1][-1]), int(best[1][-1]) - 3):
            got = lists.top(q, 6, floor=floor)
            assert got[0].tolist() == best[0].tolist() and got[1].tolist() == best[1].tolist()
    big = np.array([[2**40 + 1, 1], [2**40, 3]])
    assert SortedLists(np.array([1, 2]), big).top(np.array([2**20 + 1, 7]), 2)[1].tolist() == sorted((int(a) * (2**20 + 1) + int(b) * 7 for a, b in big), reverse=True)


def test_repeated_queries_of_top_products_and_clashing_columns(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((60, 3)).astype(np.float32)
    rows = [(i + 1, [float(v) for v in r], "a", 1.0, 2, 3) for i, r in enumerate(x)] + [(100, [1.0, 0.5, 0.0], "a", 1.0, 2, 3)] * 12 + [(100, [0.0, -1.0, 0.0], "b", 1.0, 2, 3)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, score double, rank int, asked int")
    got = top_inner_products(docs, row_block=16, query_block=1, anchors=30).collect()
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    assert len(got) == 20
    for q in ([1024, 512, 0], [0, -1024, 0]):
        s = v @ q
        want = [(int(i) + 1, int(s[i])) for i in np.lexsort((np.arange(60), -s))[:10]]
        assert all((i, t) in [(r.vec_id, r.score) for r in got] for i, t in want)
    near = nearest_neighbours(docs).collect()
    assert len(near) == 20 and {r.query_id for r in near} == {100} and 100 not in {r.vec_id for r in near}


def test_anchors_far_below_the_rows_settle_nothing(spark):
    """With the default parameters the lists give the neighbours; anchors only where lists leave too few."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    docs = table(spark, x)

    def recall(**params):
        got, hits = nearest_neighbours(docs, params=AnnParameters(**params)).toPandas(), 0
        assert (got.groupby("query_id").size() == 10).all()
        for q, g in got.groupby("query_id"):
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
            hits += len({i for i in np.lexsort((np.arange(4000), d)) if i != q} & set(g["vec_id"]) & set(np.argsort(d)[:11]))
        return hits / 400

    assert recall(anchors=64) >= 0.9 and recall(anchors=16) >= 0.9
