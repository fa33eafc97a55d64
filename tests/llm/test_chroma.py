import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import chroma


def brute(items, other):
    """The best offset of a pair, all offsets being tried."""
    votes = Counter(i - j for i in range(len(items)) for j in range(len(other)) if items[i] == other[j])
    passing = []
    for o, v in votes.items():
        bits = [(int(items[i]) ^ int(other[i - o])).bit_count() for i in range(max(o, 0), min(len(items), len(other) + o))]
        error = sum(bits) / (32 * len(bits))
        if v >= min(chroma.LEAST_VOTES, len(items), len(other)) and error <= chroma.MOST_ERROR:
            passing.append((-v, error, o))
    return [(o, -v, error) for v, error, o in sorted(passing)[:1]]


@pytest.mark.parametrize("least, frame, tests", [(4096, 4, 16), (8, 1, 2), (0, 0, 0), (20, 0, 1)])
def test_votes_and_offsets_equal_brute_force(monkeypatch, least, frame, tests):
    """Also with limits so low that integers and tests go through the transform."""
    monkeypatch.setattr(chroma, "PAIRS_LEAST", least)
    monkeypatch.setattr(chroma, "PAIRS_FRAME", frame)
    monkeypatch.setattr(chroma, "TESTS", tests)
    rng = np.random.default_rng(least + tests)
    for trial in range(25):
        values = rng.integers(0, 2**32, 1 + trial % 6, dtype=np.uint32)
        if trial % 2:
            values[:] = values[0]
            values[1:] ^= (1 << rng.integers(0, 32, len(values) - 1)).astype(np.uint32)
        queries = [rng.choice(values, int(rng.integers(1, 60))) for _ in range(4)]
        row = rng.choice(values, int(rng.integers(1, 60)))
        row[rng.random(len(row)) < 0.2] = 5
        held = chroma.Queries([0, 1, 2, 3], [None] * 4, list("abcd"), queries)
        got = {i: (o, v, pytest.approx(e)) for i, _, o, v, e in held.align(9, row)}
        want = {i: brute(row, q)[0] for i, q in enumerate(queries) if brute(row, q)}
        assert want == got


def test_fingerprint_equals_sums_of_regions():
    rng = np.random.default_rng(1)
    c = rng.random((40, 12)).astype(np.float32)
    got = chroma.packed(c)
    assert len(got) == 25
    for t in range(25):
        bits = 0
        for kind, a, k, w in chroma.filters():
            s = lambda f, n, b, m, t=t: float(c[t + f : t + f + n, b : b + m].sum(dtype=float))
            h, q, low = w // 2, w // 4, k // 2
            x, y = [
                lambda: (s(0, h, a, k), s(h, h, a, k)),
                lambda: (s(0, w, a, low), s(0, w, a + low, k - low)),
                lambda: (s(0, h, a, low) + s(h, h, a + low, k - low), s(h, h, a, low) + s(0, h, a + low, k - low)),
                lambda: (s(q, w - 2 * q, a, k), s(0, q, a, k) + s(w - q, q, a, k)),
            ][kind]()
            r = np.log((x + 0.01 * w) / (y + 0.01 * w))
            level = int(r > -chroma.LEVEL) + int(r > 0) + int(r > chroma.LEVEL)
            bits = bits << 2 | (level ^ level >> 1)
        assert bits == got[t]


def test_silence_is_not_quadratic():
    silent = np.zeros(450_000, np.uint32)  # an hour
    steady = np.random.default_rng(3).integers(1, 2**32, 50, dtype=np.uint32)
    held = chroma.Queries([0, 1], [None, None], ["a", "b"], [silent[:-1], np.tile(steady, 4000)])
    began = time.time()
    assert held.align(9, silent) == [(0, "a", 0, 449_999, 0.0)]
    assert held.align(9, np.tile(steady, 5000)[7:]) == [(1, "b", 43, 200_000, 0.0)]
    assert time.time() - began < 60


def test_edges_of_tables(spark):
    df = spark.createDataFrame([], "id long, audio binary, query_id string")
    assert chroma.align_recordings(df, F.col("id") % 10 == 0).count() == 0
    df = spark.createDataFrame([(1, bytes(2000), "x"), (10, None, "x"), (None, b"", None)], "id long, audio binary, query_id string")
    assert {(r.id, r.query_id) for r in chroma.align_recordings(df, F.col("id") % 10 == 0).collect()} == {(1, None), (10, None), (None, None)}
