import math
import random

import numpy as np
import pytest

from skein.llm import topk
from skein.llm.topk import BallTree, Best, quantized, search, split_cells, top_k


def brute(rows, queries, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) for x in v])
    out = []
    for q in queries:
        v = min(ints[q]) if q in ints else None
        if v is None:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, ws in ints.items() if i != q for w in ws if len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_equals_brute_force(spark, shard_rows):
    rnd = random.Random(2)
    same = [rnd.gauss(0, 1) for _ in range(8)]
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(1, 700)] + [(1000 + i, same) for i in range(300)]
    rows += [(5000, None), (5100, [1.0, None] + [0.0] * 6), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (None, same), (6000, [1.0, 2.0]), (6001, [1.0, 1.0]), (6100, []), (700, same), (700, same), (7000, [0.0] * 8)]
    vectors = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    got = top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10, shard_rows).collect()
    assert sorted(map(tuple, got)) == brute(rows, [q for q in {r[0] for r in rows} if q is not None and q % 100 == 0], 10)


def test_large_scores_are_exact(spark):
    rows = [(100, [1e5, 3.0]), (1, [1e5, 1.0]), (2, [1e5, 1.001]), (3, [-1e5, 0.0])]
    vectors = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, top_k(vectors, vectors.filter("vec_id = 100")).collect()))
    assert got == brute(rows, [100], 10)


def test_bounds_prune():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(0, 100, (5000, 3)))
    tree, best = BallTree.build(points, np.arange(5000), 64), Best.empty(1, 5)
    opened = search(tree, np.array([[300.0, 300.0, 300.0]]), np.array([-1]), np.array([-np.inf]), best)
    want = np.sort(points @ [300.0, 300.0, 300.0])[::-1][:5]
    assert best.score[0].tolist() == want.tolist() and opened < (tree.left < 0).sum() / 3


def test_empty(spark):
    vectors = quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert top_k(vectors, vectors).collect() == []


def test_cells_hold_near_vectors_and_all_of_them():
    rng = np.random.default_rng(3)
    points = rng.normal(0, 100, (3000, 5))
    tree = split_cells(points, 16)

    def cell(t, p):
        return cell(t[2] if p[t[0]] < t[1] else t[3], p) if isinstance(t, list) else t

    sizes = np.bincount([cell(tree, p) for p in points])
    assert len(sizes) == 16 and sizes.min() > 150
    assert split_cells(np.ones((50, 3)), 8) == 0 and split_cells(np.zeros((0, 3)), 8) == 0


def test_far_stripes_are_not_searched(spark):
    """Clusters far from each other: the bounds leave a query its own cluster's stripes alone."""
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 40, (8, 6))
    rows = [(i, (centers[i % 8] + rng.normal(0, 0.1, 6)).tolist()) for i in range(1600)]
    vectors = quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = vectors.filter("vec_id % 100 = 0")
    seen = []
    from skein.llm import topk

    kept = topk.stored
    topk.stored = lambda df, label: seen.append((label, out := kept(df, label))) or out
    try:
        got = top_k(vectors, asked, 10, 40).collect()
    finally:
        topk.stored = kept
    assert sorted(map(tuple, got)) == brute(rows, range(0, 1600, 100), 10)
    live = [df.count() for label, df in seen if label == "live_stripes"]
    stripes = next(df for label, df in seen if label == "stripes").select("stripe").distinct().count()
    assert live[0] == 16 and live[1] < 16 * (stripes - 1) / 2


def test_long_vectors_get_smaller_cells(spark, monkeypatch):
    """Cells follow bytes: with room for 50 vectors a cell, results stay those of all products."""
    monkeypatch.setattr(topk, "CELL_BYTES", 50 * 8 * 96)
    rnd = np.random.default_rng(5)
    points = rnd.integers(-50, 50, size=(700, 96)).astype(float)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, v array<double>").repartition(3)
    got = {}
    for r in topk.top_k(table, table.filter("vec_id % 100 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 700, 100):
        scores = points @ points[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
