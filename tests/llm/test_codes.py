import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from fluvial.llm.codes import OP11_SQL, AnnularCodebook, CodeParameters, compress_vectors

CLASH = "vec_id long, embedding array<float>, label string, v int, code string, error long, rows long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], lab, 1, "c", 2, 3) for i, x, lab in rows], CLASH)


def plain(rows, entries=64, parts=16, rounds=2):
    """The rules word by word, for vectors of one length."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in x], lab) for i, x, lab in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    w = -(-len(kept[0][1]) // parts)
    cut = [[(x + [0] * (w * parts - len(x)))[j * w : j * w + w] for j in range(parts)] for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][j] for r in order] for j in range(parts)]

    def near(j, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[j]))

    for _ in range(rounds):
        mine = [{} for _ in range(parts)]
        for c in cut:
            for j in range(parts):
                mine[j].setdefault(near(j, c[j])[1], []).append(c[j])
        for j in range(parts):
            for k, xs in mine[j].items():
                books[j][k] = [sum(col) // len(xs) for col in zip(*xs)]
    out, by_label = [], {}
    for (i, _, lab), c in zip(kept, cut):
        found = [near(j, c[j]) for j in range(parts)]
        err = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + err
        out.append([i, "".join(f"{k:02x}" for _, k in found), err, lab])
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    narrow = lambda s: s if s < 1 << 63 else None
    return sorted(((i, code, narrow(err), narrow(by_label[lab]), digest) for i, code, err, lab in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_annulus_equals_all_entries():
    rng = np.random.default_rng(0)
    for trial in range(80):
        k, w, n = int(rng.integers(1, 65)), int(rng.integers(0, 6)), int(rng.integers(0, 40))
        entries, x = rng.integers(-4, 5, (k, w)), rng.integers(-6, 7, (n, w))
        if trial % 4 == 0:
            entries, x = entries.astype(object) * 10**20, x.astype(object) * 10**20
        at, d, _ = AnnularCodebook(entries).nearest(x)
        all_d = [[sum(int(a - b) ** 2 for a, b in zip(r, e)) for e in entries] for r in x]
        assert at.tolist() == [int(np.argmin(r)) for r in all_d] and [int(v) for v in d] == [min(r) for r in all_d]


def test_annulus_leaves_entries_out():
    rng = np.random.default_rng(1)
    entries = rng.integers(-50, 50, (64, 4)) * np.geomspace(0.1, 20, 64)[:, None].astype(int)
    x = entries[rng.integers(0, 64, 1000)] + rng.integers(-1, 2, (1000, 4))
    assert AnnularCodebook(entries).nearest(x)[2] < 0.5 * 64 * 1000


@pytest.mark.parametrize("dims", [16, 64, 20, 5])
def test_equals_plain_rules(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(i), x.tolist(), "ab"[int(i) % 2] if i % 5 else None) for i, x in zip(rng.permutation(300), rng.standard_normal((300, dims)))]
    rows += [(7, rows[0][1], "a"), (7, rows[1][1], "b"), (None, rows[2][1], "a"), (None, [0.0] * dims, None), (900, None, "a"), (901, [None] * dims, "b"), (902, [float("nan")] * dims, "b"), (903, [float("-inf")] * dims, "a")]
    rows += [(1000 + i, rows[5][1], "hot") for i in range(200)]
    assert got(compress_vectors(table(spark, rows))) == plain(rows)


def test_few_rows_lengths_and_huge_components(spark):
    rows = [(i, [i * 0.25] * 16, "a") for i in range(9)]
    assert got(compress_vectors(table(spark, rows))) == plain(rows)
    huge = [(i, [s * 1e30 * (i + 1)] * 16, "a") for i, s in enumerate([1, -1, 1, 1])]
    assert got(compress_vectors(table(spark, huge), params=CodeParameters(entries=2))) == plain(huge, 2)
    mixed = rows + [(20, [1.0, 2.0], "b"), (21, [], "b")]
    out = {r.vec_id: r for r in compress_vectors(table(spark, mixed)).collect()}
    assert len(out) == 11 and out[21].code == "00" * 16 and out[21].error == 0 and out[20].error == 0
    assert compress_vectors(table(spark, [])).count() == 0 and compress_vectors(table(spark, [(1, None, None)])).count() == 0


def test_sql_gives_the_same_rows(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{os.path.join(data, 'embeddings.parquet')}')")
    want = sorted((tuple(r) for r in con.execute(OP11_SQL).fetchall()), key=str)
    assert got(compress_vectors(spark.read.parquet(f"{data}/embeddings.parquet"))) == want
