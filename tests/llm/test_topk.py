"""Exact search against brute force."""

import math

import numpy as np
import pytest
from util import store

from ambler.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, block long"


def brute(rows, k=5, step=50):
    held = {}
    listed = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [min(max(math.floor(256 * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in v]
        listed.append((vec_id, q))
        held[vec_id] = min(held.get(vec_id, q), q)
    out = []
    for query, q in held.items():
        if query % step == 0:
            ranked = sorted((-min(max(sum(a * b for a, b in zip(q, c)), -(2**63)), 2**63 - 1), i) for i, c in listed if i != query)[:k]
            out += [(query, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


def search(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    found = topk.op10_cover_tree_topk(spark, store(spark, tmp_path, "embeddings", df))
    return sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))


def vectors(seed, n, d=8, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    return [(int(i), (centres[i % 5] + spread * r.normal(size=d)).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 64])
@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block, spread):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "PLACE_BLOCKS", 3)
    rows = vectors(1, 700, spread=spread)
    assert search(spark, tmp_path, rows) == brute(rows)


def test_odd_vectors(spark, tmp_path):
    rows = [(i, v) for i, v in vectors(2, 60, 4)]
    rows += [(100, None), (150, [1.0, None, 1.0, 1.0]), (200, [1.0, float("nan"), 0.0, 0.0]), (250, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(300, [1.0, 2.0]), (301, []), (302, [0.5] * 9), (350, []), (400, [1e5] * 4), (401, [-1e5] * 4), (402, [3e7] * 4)]
    assert search(spark, tmp_path, rows) == brute(rows)


def test_ties_and_repeated_rows(spark, tmp_path):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(7, [1.0, 0.0])] * 3 + [(200, [2.0, 2.0]), (201, [2.0, 2.0])]
    assert search(spark, tmp_path, rows) == brute(rows)


def test_a_repeated_query_id_answers_with_its_least_vector(spark, tmp_path):
    rows = vectors(5, 120, 3) + [(50, [9.0, 1.0, 1.0]), (50, [-9.0, 1.0, 1.0]), (100, [0.0, 0.0, 0.0])]
    assert search(spark, tmp_path / "a", rows) == search(spark, tmp_path / "b", rows[::-1]) == brute(rows)


def test_numbers_beyond_64_bits(spark, tmp_path):
    rows = [(0, [3e38, 1.0]), (50, [-3e38, 2.0]), (1, [3e38, 3e38]), (2, [-1e30, 1e30]), (3, [1.0, 1.0]), (4, [1e12, -1e12]), (100, [1e15, 1e15])]
    assert search(spark, tmp_path, rows) == brute(rows)


def test_few_rows(spark, tmp_path):
    for n, rows in enumerate(([], [(0, [1.0])], [(0, [1.0]), (50, [2.0]), (3, [0.0])])):
        assert search(spark, tmp_path / str(n), rows) == brute(rows)


def test_tree_covers_its_points():
    points = np.array([v for _, v in vectors(3, 3000, 4, 0.02)])
    tree = topk.CoverTree(np.floor(points * 256), leaf=32)
    assert sorted(tree.order.tolist()) == list(range(3000))
    for node, kids in enumerate(tree.children):
        own = tree.order[tree.begin[node] : tree.end[node]]
        far = np.sqrt(((tree.points[own] - tree.centres[node]) ** 2).sum(axis=1).max())
        assert far <= tree.radius[node]
        if kids:
            assert max(tree.radius[k] for k in kids) <= tree.radius[node] / topk.BASE * (1 + 1e-6)
            assert sum(tree.end[k] - tree.begin[k] for k in kids) == len(own)
    ids = np.arange(3000)
    queries = topk.CoverTree(tree.points[:20], leaf=8)
    best, which = topk.dual_search(queries, tree, ids[:20], ids, 5)
    full = tree.points[:20] @ tree.points.T
    full[np.arange(20), np.arange(20)] = -np.inf
    wanted = -np.sort(-full, axis=1)[:, :5]
    assert np.array_equal(best, wanted) and any(tree.children)
    # Scores below what was reached elsewhere are not looked for; those at it are.
    best, which = topk.dual_search(queries, tree, ids[:20], ids, 5, wanted[:, 2])
    assert np.array_equal(best[:, :3], wanted[:, :3])
