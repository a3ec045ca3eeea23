import numpy as np

from fluvial.llm.jaccard import jaccard_classes, link_block
from fluvial.llm.segments import SegmentScheme
from fluvial.llm.shingles import shingle_set


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, share):
    out = []
    for w in words:
        u = rng.random()
        if u < share / 3:
            continue
        out.append(w if u > share else str(rng.choice(words)))
    return out


def similar_pairs(trials):
    rng = np.random.default_rng(0)
    for trial in range(trials):
        n = int(rng.integers(1, 130))
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        if trial % 2:  # few segments: one-deletion neighbourhoods and the common signature are needed
            a = (a >> np.uint64(5)) | (np.uint64(trial % 29) << np.uint64(59))
        b = np.delete(a, rng.choice(n, int(rng.integers(0, n // 6 + 1)), replace=False))
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            yield a, b


def test_similar_pairs_share_as_many_subsets_as_their_slack():
    scheme, checked = SegmentScheme(), 0
    for a, b in similar_pairs(6000):
        checked += 1
        (sa, *la), (sb, *lb) = scheme.subsets(a), scheme.subsets(b)
        common = np.intersect1d(sa, sb)
        odd = int((common & np.uint64(1)).sum())
        counts = (len(common) - odd, odd)
        assert any(counts[k] >= max(la[k], lb[k]) and max(la[k], lb[k]) < 1 << 20 for k in (0, 1))
    assert checked > 1500


def test_any_allocation_of_units_meets_a_similar_set():
    rng, scheme, short = np.random.default_rng(5), SegmentScheme(), 0
    for a, b in similar_pairs(3000):
        met = False
        for parity in (0, 1):
            mine, other = scheme.neighbourhood(a, parity), scheme.neighbourhood(b, parity)
            if mine is None or other is None:
                continue
            sigs, segs, whole, wide, need, units = mine
            their_whole, their_less = other[0][other[2]], other[0][~other[2]]
            if units < need:
                short += 1
                common = sigs[segs == -1]
                met |= bool(np.isin(common, their_whole).any()) or other[5] >= other[4]
                continue
            # Units at random: first ones of any segment, second ones after their first.
            options = [(s, 1) for s in np.unique(segs[segs >= 0])] + [(s, 2) for s in np.unique(segs[wide & (segs >= 0)])]
            order = sorted(options, key=lambda o: (rng.random() + (o[1] - 1) * rng.integers(0, 2), o[1]))
            depth = {}
            for s, _ in order[:need]:
                depth[s] = depth.get(s, 0) + 1
            for sig, seg, is_whole in zip(sigs, segs, whole):
                d = depth.get(seg, 0)
                met |= bool(is_whole and d >= 1 and sig in their_whole)
                met |= bool(is_whole and d == 2 and sig in their_less)
                met |= bool(not is_whole and d == 2 and sig in their_whole)
        assert met
    assert short > 20


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.integers(0, 10**9, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 10**9, 60), base)) for _ in range(25)]
        got = link_block(np.concatenate(sets), np.array([len(s) for s in sets]), 80, 100)
        up = list(range(25))
        for i in range(25):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = up[i], up[j]
                    up = [min(a, b) if u in (a, b) else u for u in up]
        assert got.tolist() == up


def test_classes_equal_brute_force(spark, documents, prose):
    rng, rows = np.random.default_rng(2), []
    for text in prose(25, 8, 1, 80):
        words = text.split()
        rows += [" ".join(edited(rng, words, s)) for s in (0, 0, 0.02, 0.05, 0.1)]
    rows += [rows[0].upper()] * 80 + [None, "", " \t ", "one", "ONE", "one two three four", "one two three four five"]
    rows = list(enumerate(rows))
    # One task a cluster; many blocks; all sets through one-deletion neighbourhoods; most subsets taken for frequent ones.
    for options in ({}, {"block_tokens": 300}, {"far_blocks": 0}, {"far_blocks": 0, "block_tokens": 200}):
        got = jaccard_classes(documents(rows), **options).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows)
        assert len(got) == len(rows)


def test_words_and_case():
    assert shingle_set("A b\x0bC d e f").tolist() == shingle_set("a B\tc D  e F").tolist() and len(shingle_set("a b c d e f")) == 2
    assert shingle_set("Éa b").tolist() != shingle_set("éa b").tolist()
    assert shingle_set("a b").tolist() == shingle_set("A b").tolist() and len(shingle_set(" ")) == 0


def test_null_ids_repeats_and_empty(spark, documents):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g")]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in jaccard_classes(documents(rows)).collect())
    assert got == [(-1, 3, None), (3, 3, 3), (5, 3, 3), (5, 3, 3)]
    assert jaccard_classes(documents([])).count() == 0


def test_one_id_with_different_texts_and_clashing_columns(spark):
    a, b = "a b c d e f g h", "q w e r t y u i"
    rows = [(7, a, 1, 1, "x"), (7, b, 1, 1, "x"), (3, b, 2, 2, "y"), (9, a, 3, 3, "z"), (1, "", 3, 3, "z"), (8, None, 0, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long, n long, rid string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect())
    assert got == [(1, 0, 1), (3, 4, 3), (7, 4, 3), (7, 4, 3), (8, 0, 8), (9, 4, 3)]


def test_very_long_texts(documents, prose):
    words = prose(1, 3, 40_000, 40_000)[0].split()
    rows = [(0, " ".join(words)), (1, " ".join(words[:-500])), (2, " ".join(words[:10_000])), (3, "x" * 300_000)]
    got = {r.doc_id: r.component_id for r in jaccard_classes(documents(rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_large_groups_of_near_copies_and_shared_passages(documents, prose):
    rng = np.random.default_rng(4)
    base, passage = prose(1, 5, 120, 120)[0].split(), prose(1, 6, 80, 80)[0]
    rows = [" ".join(edited(rng, base, 0.04)) for _ in range(150)]
    rows += [passage + " " + t for t in prose(150, 7, 10, 60)]
    rows = list(enumerate(rows))
    for options in ({"block_tokens": 2000, "sample": 100}, {"far_blocks": 0, "block_tokens": 5000}):
        got = jaccard_classes(documents(rows), **options).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(rows)
