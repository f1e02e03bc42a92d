import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import hard_negatives as H
from ledgerlake.llm import registry

SF001 = "/root/testdata/sf0.001"


def brute(rows, every=50):
    """The contract over (vec_id, label, embedding) by two loops; rows of one vec_id: the smallest (label, vector)."""
    good = {}
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e])
        good[i] = min(good.get(i, one), one)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in good.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            hits = [(n, -s) for s, n, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out += [(a, p, r, n, -ps, ns) for r, (n, ns) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, data, **limits):
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, label int, embedding array<float>, block int, score int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.mine(H.quantised(df.withColumn("label", label)), F.col("vec_id") % 50 == 0, **limits).collect()))


def floats(a):
    return [float(np.float32(x)) for x in a]


@pytest.mark.parametrize("limits", [{}, {"anchors": 3, "rows": 40}])
def test_against_two_loops(spark, limits, monkeypatch):
    monkeypatch.setattr(H, "CELLS", 200)  # many steps
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 20))
    rows = [(i, int(rng.integers(0, 4)), floats(centres[i % 6] * rng.uniform(0.5, 1) + rng.normal(size=20) * 0.4)) for i in range(700)]
    rows += [(1000 + i, i % 3, rows[50][2]) for i in range(60)]  # a very common vector, ties
    assert run(spark, rows, **limits) == brute(rows)
    assert len(brute(rows)) > 50


def test_odd_rows(spark):
    rows = [(None, 1, [1.0, 2.0]), (0, None, [1.0, 2.0]), (1, 1, None), (2, 1, [1.0, None]), (3, 1, [1.0, float("nan")]),
            (4, 1, [1.0, float("inf")]), (5, 1, []), (100, 2, []), (6, 2, []), (50, 1, [1.0, 0.5]), (50, 1, [1.0, 0.5]),
            (50, 2, [0.0, 0.1]), (8, 1, [1.0, 0.5]), (9, 2, [0.9, 0.1]), (9, 2, [0.9, 0.1]), (10, 2, [0.8, 0.2]), (11, 1, [2.0]),
            (12, 3, [0.7, 0.6]), (13, 3, [0.7, 0.6]), (-50, 3, [0.7, 0.6]), (150, 9, [-1.0, 0.0]), (15, 9, [0.5, 0.0]), (16, 1, [0.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    # Large components: products beyond 2 ** 53 are still exact
    big = [(i, i % 2, [1e6 + i, -3e5 - i, 7.0]) for i in range(0, 60, 2)] + [(50, 0, [2e6, 1.0, 5.0]), (21, 1, [1.9e6, 1.0, 5.0])]
    assert run(spark, big) == brute(big)


def test_table(spark):
    vectors = registry.table(spark, SF001, "embeddings")
    rows = [(r.vec_id, r.label, r.embedding) for r in vectors.collect()]
    assert sorted(map(tuple, registry.op11_hard_negatives(spark, SF001).collect())) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(0, 10**6))
def test_segments_bound_the_score(dim, segments, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, size=(2, dim)).astype(float)
    s = H.summary(x, segments)
    half = s.shape[1] // 2
    mean, spread = s[0, :half] @ s[1, :half], s[0, half:] @ s[1, half:]
    assert mean - spread - 1e-6 <= x[0] @ x[1] <= mean + spread + 1e-6
    assert spread <= 1e-6 or segments < dim


def test_bounds_spare_exact_scoring(spark):
    """On smooth vectors few pairs are scored exactly once the lists are full."""
    rng = np.random.default_rng(3)
    smooth = np.repeat(rng.normal(size=(3000, 4)), 16, axis=1) + rng.normal(size=(3000, 64)) * 0.05
    v = np.floor(256 * smooth)
    import pyarrow as pa

    def batch(a, z):
        s = np.concatenate([H.summary(v[a:z], k) for k in H.LEVELS], 1)
        lists = lambda m, t: pa.array(m.astype(t).tolist())
        return H.Block(pa.RecordBatch.from_arrays([pa.array(range(a, z)), pa.array([0] * (z - a)), lists(v[a:z], np.int64), lists(s, float)],
                                                  ["vec_id", "label", "v", "s"]), H.LEVELS)

    state, counted, plain = H.Positives(batch(0, 50), [], 5), [], H.scores
    try:
        H.scores = lambda a, r, ai, ri=None: counted.append(len(a.ids[ai]) * (len(r.ids) if ri is None else 1)) or plain(a, r, ai, ri)
        for at in range(0, 3000, 500):
            state.add(batch(at, at + 500))
    finally:
        H.scores = plain
    want = np.sort(v[:50] @ v.T - np.where(np.arange(3000)[None] == np.arange(50)[:, None], 1e18, 0), axis=1)[:, :-6:-1]
    assert (state.lists.score == want).all()
    assert sum(counted) < 0.4 * 50 * 3000
