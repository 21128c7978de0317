import math

import numpy as np
import pytest

from quireframe.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label string, score long"


def plain(rows, k=5, every=50):
    kept = []
    for vec_id, x in rows:
        if x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((vec_id, [math.floor(256 * v) for v in x]))
    out = []
    for i, (query, q) in enumerate(kept):
        if query is None or query % every:
            continue
        found = [(-sum(a * b for a, b in zip(q, c, strict=True)), vec_id is None, vec_id or 0) for j, (vec_id, c) in enumerate(kept) if j != i and len(c) == len(q)]
        out += [(query, rank, None if unnamed else vec_id, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for rank, (s, unnamed, vec_id) in enumerate(sorted(found)[:k], 1)]
    return out


def check(spark, rows):
    got = topk.top_k(spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], SCHEMA))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_hard_rows(spark):
    check(spark, [])
    check(spark, [(1, None), (50, [float("nan"), 1.0]), (100, [None, 1.0]), (150, [float("inf")])])
    check(spark, [(0, [1.0, 2.0])])
    rows = [(0, [0.0, 0.0]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (None, [0.5, -0.25]), (3, [0.5, -0.25]), (-50, [-0.001, 0.003]), (100, [1.0]), (101, [2.0]), (150, []), (151, []), (152, None), (153, [1.0, None])]
    check(spark, rows)


def test_numbers_beyond_exact_doubles(spark):
    """Products above 2^53, where doubles round: neighbours differ by one in the last place."""
    rows = [(50 * i, [float(2**22 + i), float(2**23 - i), 3.0]) for i in range(8)] + [(1001 + i, [2.0**20, i / 256, 1.0]) for i in range(6)]
    check(spark, rows)


@pytest.mark.parametrize("kind", ["even", "clusters", "hot"])
def test_many_annuli_and_blocks(spark, monkeypatch, kind):
    """Blocks of 16 rows: hundreds of annuli, several blocks in each, and in "hot" a third of all rows equal, which
    are one annulus of many blocks."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "BATCH", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.2, 2, (1500, 1))
    if kind == "clusters":
        x = rng.normal(size=(20, 12))[rng.integers(0, 20, 1500)] + 0.05 * x
    if kind == "hot":
        x[rng.permutation(1500)[:500]] = x[0]
    rows = list(zip(rng.permutation(1500).tolist(), x.tolist(), strict=True))
    check(spark, rows)


def test_bounds_hold():
    """No point is nearer than its annulus's bound, and an annulus is pruned for clustered vectors."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(8, 6))[rng.integers(0, 8, 400)] + 0.02 * rng.normal(size=(400, 6))))
    norms = (x * x).sum(axis=1)
    p = topk.Pivots(x, norms, norms.max(), 400 * topk.BLOCK_ROWS)
    cell, radius = p.keys(x, norms)
    away = p.from_queries(x[:50])
    true = topk.distances(np.concatenate([x[:50], np.zeros((50, 1))], axis=1), p.lifted(x, norms))
    assert np.allclose((norms[:50, None] + norms.max() - true**2) / 2, x[:50] @ x.T)
    pruned = 0
    for c in np.unique(cell):
        own = cell == c
        bound = topk.beyond(away[:, c // p.rings], radius[own].min(), radius[own].max())
        assert (true[:, own] >= bound[:, None] - 1e-9).all()
        pruned += (bound > np.sort(true, axis=1)[:, 5]).sum()
    assert pruned > 0
