import numpy as np
import pytest


@pytest.fixture
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def prose():
    """Random prose: whole texts of many sizes from a small vocabulary of made-up words."""

    def make(n, seed=0, low=0, high=60):
        rng = np.random.default_rng(seed)
        words = ["".join(rng.choice(list("abcdeé tz")[:8], rng.integers(1, 8))).replace(" ", "q") for _ in range(400)]
        return [" ".join(rng.choice(words, rng.integers(low, high + 1))) for _ in range(n)]

    return make
