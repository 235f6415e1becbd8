import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from graphs import FORK, KITE, NO_BIAS, SINK, ZERO_EDGE, chi_square, graph, seeds
from pyspark.sql import functions as F

from ambler.functions.rng import Channel, M, draw_numpy
from ambler.operators import sample
from ambler.operators.sample import METHODS, frontier_sizes, neighbor_sample, sample_lengths


def children(samples):
    found = defaultdict(list)
    for r in samples.where("hop > 0").orderBy("slot").collect():
        found[r.instance, r.hop, r.parent_slot].append(r.node)
    return found


@pytest.mark.parametrize("fanout", [5, 3, 2])
def test_take_all_where_the_fanout_reaches_the_degree(spark, fanout):
    for method in ("take_all", "alias", "weighted_distinct", "uniform_distinct"):
        got = children(neighbor_sample(graph(spark, FORK), seeds(spark, 20, name="instance"), (fanout,), method))
        for nodes in got.values():
            assert len(nodes) == min(fanout, 3)
            if fanout >= 3:
                assert sorted(nodes) == [1, 2, 3]
            elif method.endswith("distinct"):
                assert len(set(nodes)) == 2


@pytest.mark.parametrize("method", METHODS)
def test_tree_is_of_edges(spark, method):
    s = seeds(spark, 40, name="instance").withColumn("node", F.col("instance") % 4)
    rows = neighbor_sample(graph(spark, KITE), s, (3, 2), method)
    again = neighbor_sample(graph(spark, KITE).cached(5), s.repartition(6), (3, 2), method)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    at = {(r.instance, r.hop, r.slot): r.node for r in rows.collect()}
    assert len(at) == rows.count()
    edges = {(a, b) for a, b, _ in KITE}
    for r in rows.where("hop > 0").collect():
        assert (at[r.instance, r.hop - 1, r.parent_slot], r.node) in edges
        assert r.slot // (3, 2)[r.hop - 1] == r.parent_slot


def test_sinks_and_rows_without_bias_have_no_children(spark):
    rows = neighbor_sample(graph(spark, SINK), seeds(spark, 1, node=2, name="instance"), (3,))
    assert rows.count() == 1
    for method in ("alias", "weighted_distinct"):
        assert neighbor_sample(graph(spark, NO_BIAS), seeds(spark, 1, name="instance"), (1,), method).count() == 1


def test_weighted_draw_and_distinct_draw_frequencies(spark):
    g = graph(spark, ZERO_EDGE)
    for method in ("alias", "weighted_distinct"):
        rows = neighbor_sample(g, seeds(spark, 20_000, name="instance"), (1,), method)
        counts = Counter(r.node for r in rows.where("hop = 1").collect())
        assert chi_square(counts, {1: 0.25, 2: 0.75}) < 12
    rows = neighbor_sample(graph(spark, FORK), seeds(spark, 9000, name="instance"), (2,), "uniform_distinct")
    counts = Counter(tuple(sorted(v)) for v in children(rows).values())
    assert chi_square(counts, {(1, 2): 1 / 3, (1, 3): 1 / 3, (2, 3): 1 / 3}) < 15


def test_weighted_distinct_reads_rows_of_many_blocks(spark, monkeypatch):
    """The same trees whatever a block holds, as ranked edge by edge; no plan has a row for every edge."""
    edges = [(a, b, ((a * 5 + b * 3) % 7) / 3) for a in range(9) for b in range(30) if (a + b) % 4]
    g, s = graph(spark, edges), seeds(spark, 45, name="instance").withColumn("node", F.col("instance") % 9)
    held, found = {}, []
    for a, b, w in sorted(edges):
        held.setdefault(a, []).append((b, w))
    for size in (1024, 4):
        monkeypatch.setattr(sample, "BLOCK", size)
        for f in (2, 11):
            rows = neighbor_sample(g, s, (f,), "weighted_distinct").where("hop = 1").collect()
            found.append((f, sorted((r.instance, r.slot, r.node) for r in rows)))
    for f, rows in found:
        expected = []
        for i in range(45):
            key = lambda pos, w: -math.log((int(draw_numpy(np.array([i * f]), pos, Channel.KEY + 16)[0]) + 1) / (M + 1)) / w  # noqa: B023, E731
            best = sorted((key(pos, w), pos, b) for pos, (b, w) in enumerate(held[i % 9]) if w > 0)[:f]
            expected += [(i, k, b) for k, (_, _, b) in enumerate(best)]
        assert rows == sorted(expected)


def test_lengths_and_frontiers(spark):
    rows = neighbor_sample(graph(spark, FORK), seeds(spark, 2, name="instance"), (5, 2), "take_all")
    assert [r.len for r in sample_lengths(rows).collect()] == [3, 3]
    assert {r.hop: r.n for r in frontier_sizes(rows).collect()} == {0: 2, 1: 6}


def test_deep_trees_are_not_truncated(spark):
    g = graph(spark, [(0, i, 1.0) for i in range(1, 60)] + [(i, 0, 1.0) for i in range(1, 60)])
    rows = neighbor_sample(g, seeds(spark, 1, name="instance"), (50, 2, 2))
    assert {r.hop: r.n for r in frontier_sizes(rows).collect()} == {0: 1, 1: 50, 2: 100, 3: 200}


def test_wrong_method_is_refused(spark):
    with pytest.raises(ValueError):
        neighbor_sample(graph(spark, FORK), seeds(spark, 1, name="instance"), (1,), "best")
