import numpy as np
import pytest

from fluvial.operators import fill


@pytest.mark.parametrize("seed", [0, 1])
def test_one_task_and_rounds_give_the_same_exits(spark, seed):
    """Random catchments on a ring of neighbours with ties; the last ones have no open pit within reach."""
    rng = np.random.default_rng(seed)
    n, rows, pairs = 60, [], set()
    for a in range(n):
        for b in {(a + 1) % 50, int(rng.integers(0, 50))} if a < 50 else {50 + (a - 49) % 10}:
            if a != b and frozenset((a, b)) not in pairs:
                pairs.add(frozenset((a, b)))
                z, cell, out = float(rng.integers(0, 6)), 1000 * a + b, 1000 * b + a
                rows += [(a, cell, b, out, z), (b, out, a, cell, z)]
    passes = spark.createDataFrame(rows, "a long, cell long, b long, out long, z double")
    pits = spark.createDataFrame([(a, float(rng.integers(0, 3)), a % 17 == 3 and a < 50) for a in range(n)], "seg long, pit_z double, open boolean")
    exits = [sorted(map(tuple, fill.exits_of_catchments(passes, pits, settle).collect())) for settle in (20_000, 0)]
    assert exits[0] == exits[1]
    # Every catchment but the open ones and one of those out of reach leaves, over a pass of its own, and no way runs in a circle.
    where = {c: (a, b) for a, c, b, o, z in rows}
    to = {seg: where[cell][1] for seg, cell, _ in exits[0]}
    assert all(where[cell][0] == seg for seg, cell, _ in exits[0])
    stay = set(range(n)) - set(to)
    assert {a for a in range(50) if a % 17 == 3} <= stay and len(stay - {a for a in range(50) if a % 17 == 3}) == 1
    for seg in to:
        seen = set()
        while seg in to:
            assert seg not in seen
            seen.add(seg)
            seg = to[seg]
    # Kruskal with open catchments as one gives passes of the same total height.
    leader = {a: "open" if a in stay else a for a in range(n)}

    def find(a):
        while leader.get(a, a) != a:
            a = leader[a]
        return a

    total = 0
    for z, c, a, b in sorted((z, min(c, o), a, b) for a, c, b, o, z in rows):
        if find(a) != find(b):
            total += z
            p, q = find(a), find(b)
            leader[q if p == "open" else p] = p if p == "open" else q
    heights = {c: z for a, c, b, o, z in rows}
    assert total == sum(heights[c] for _, c, _ in exits[0])
