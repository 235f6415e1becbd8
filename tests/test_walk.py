from collections import Counter

import pytest
from graphs import CYCLE, KITE, NO_BIAS, SINK, STAR, ZERO_EDGE, chi_square, graph, paths, seeds
from pyspark.sql import functions as F

from ambler.operators import metrics, walk
from ambler.operators.walk import WalkSpec, random_walk

BOTH = pytest.mark.parametrize("strategy", ["local", "join"])
BIASES = [
    WalkSpec(4),
    WalkSpec(4, tp=0.3),
    WalkSpec(4, bias="weight"),
    WalkSpec(4, bias="weight", table=True),
    WalkSpec(4, bias="degree"),
    WalkSpec(4, bias="node2vec", p=2.0, q=0.5),
    WalkSpec(4, bias="node2vec_floor", seed=3),
    WalkSpec(4, bias="node2vec", p=3.0, q=0.3, reject=True),
    WalkSpec(4, bias="node2vec", p=3.0, q=0.3, reject=True, table=True, seed=5),
]


@BOTH
def test_cycle_goes_round(spark, strategy):
    for bias in ("uniform", "weight", "node2vec"):
        got = paths(random_walk(graph(spark, CYCLE), seeds(spark, 3), WalkSpec(5, bias=bias), strategy, segment=2))
        assert got == {k: [0, 1, 2, 0, 1, 2] for k in range(3)}


@BOTH
def test_sink_ends_the_walk(spark, strategy):
    walks = random_walk(graph(spark, SINK), seeds(spark, 2), WalkSpec(9), strategy)
    assert {r.walker: r.length for r in walk.lengths(walks).collect()} == {0: 2, 1: 2}


@BOTH
def test_seed_outside_the_graph_and_no_bias(spark, strategy):
    outside = random_walk(graph(spark, SINK), seeds(spark, 1, node=77), WalkSpec(3), strategy)
    assert paths(outside) == {0: [77]}
    for table in (False, True):
        stuck = random_walk(graph(spark, NO_BIAS), seeds(spark, 2), WalkSpec(3, bias="weight", table=table), strategy)
        assert paths(stuck) == {0: [0], 1: [0]}


@BOTH
def test_empty_graph(spark, strategy):
    assert paths(random_walk(graph(spark, []), seeds(spark, 1), WalkSpec(3), strategy)) == {0: [0]}


@pytest.mark.parametrize("spec", BIASES, ids=str)
def test_strategies_and_partitionings_agree(spark, spec):
    g = graph(spark, KITE)
    s = seeds(spark, 200).withColumn("node", F.col("walker") % 4)
    expected = paths(random_walk(g, s, spec, "local"))
    if not isinstance(spec.bias, str) or spec.bias != "uniform":
        g = graph(spark, [(a, b, w * (0.1 + (a * 7 + b * 3) % 5 / 7)) for a, b, w in KITE])
        expected = paths(random_walk(g, s, spec, "local"))
    assert paths(random_walk(g, s.repartition(7), spec, "local")) == expected
    assert paths(random_walk(g.cached(5), s.repartition(3), spec, "join", segment=3)) == expected
    edges = {(a, b) for a, b, _ in KITE}
    assert all((a, b) in edges for p in expected.values() for a, b in zip(p, p[1:]))


@pytest.mark.parametrize("table", [False, True])
def test_weighted_draws_follow_weights(spark, table):
    for edges in (STAR, ZERO_EDGE):
        total = sum(w for _, _, w in edges)
        walks = random_walk(graph(spark, edges), seeds(spark, 20_000), WalkSpec(1, bias="weight", table=table), "local")
        counts = Counter(r.node for r in walks.where("step = 1").collect())
        assert chi_square(counts, {d: w / total for _, d, w in edges}) < 90


@pytest.mark.parametrize("bias, expected", [
    ("node2vec", {0: 1 / 7, 1: 2 / 7, 3: 4 / 7}),
    ("node2vec_floor", {0: 1 / 2, 1: 1 / 4, 3: 1 / 4}),
])
def test_second_order_bias(spark, bias, expected):
    walks = random_walk(graph(spark, KITE), seeds(spark, 30_000), WalkSpec(2, bias=bias, p=2.0, q=0.5), "local")
    found = paths(walks)
    assert chi_square(Counter(p[2] for p in found.values() if p[1] == 2), expected) < 15


@BOTH
@pytest.mark.parametrize("table", [False, True])
def test_rejection_draws_the_second_order_bias(spark, strategy, table):
    edges = [(a, b, 3.0 if (a, b) == (2, 3) else 1.0) for a, b, _ in KITE]
    expected = {0: 1 / 15, 1: 2 / 15, 3: 12 / 15} if table else {0: 1 / 7, 1: 2 / 7, 3: 4 / 7}
    n = 20_000 if strategy == "local" else 3000
    found = paths(random_walk(graph(spark, edges), seeds(spark, n), WalkSpec(2, bias="node2vec", reject=True, table=table), strategy))
    assert chi_square(Counter(p[2] for p in found.values() if p[1] == 2), expected) < 15


@BOTH
def test_refused_walkers_are_drawn_exactly(spark, strategy, monkeypatch):
    monkeypatch.setattr(walk, "ATTEMPTS", 1)
    n = 20_000 if strategy == "local" else 3000
    spec = WalkSpec(2, bias="node2vec", p=20.0, q=1.0, reject=True)
    found = paths(random_walk(graph(spark, KITE), seeds(spark, n), spec, strategy))
    expected = {0: 0.05 / 2.05, 1: 1 / 2.05, 3: 1 / 2.05}
    assert chi_square(Counter(p[2] for p in found.values() if p[1] == 2), expected) < 15


def test_fractional_and_cancelling_weights_walk_alike(spark):
    """Row sums don't depend on the rows before: 1e9 beside 1e-8, and thirds and sevenths."""
    wild = [(0, 1, 1e9), (1, 0, 1e-8), (1, 2, 3e-8), (2, 0, 1.0), (2, 1, 1 / 3)]
    dense = [(a, b, 10.0 ** ((a * 13 + b * 7) % 17 - 8) / 7) for a in range(12) for b in range(12) if (a + b) % 3]
    for edges, n in ((wild, 3), (dense, 12)):
        g = graph(spark, edges)
        s = seeds(spark, 300).withColumn("node", F.col("walker") % n)
        for spec in (WalkSpec(4, bias="weight"), WalkSpec(3, bias="node2vec", p=0.7, q=1.3)):
            local = paths(random_walk(g, s, spec, "local"))
            assert local == paths(random_walk(g, s, spec, "join"))
            assert local == paths(random_walk(g, s.repartition(3), spec, "local"))
    assert all(len(p) == 3 for p in paths(random_walk(graph(spark, wild), seeds(spark, 9, 1), WalkSpec(2, bias="weight"), "local")).values())


def test_hub_rows_of_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("HEAD_EDGES", 16), ("HEAD_COPIES", 3)):
        monkeypatch.setattr(walk, name, value)
    edges = [(0, i + 1, (i % 9) / 7) for i in range(100)] + [(i + 1, 0, 1.0) for i in range(100)]
    g = graph(spark, edges)
    spec = WalkSpec(3, bias="weight")
    assert paths(random_walk(g, seeds(spark, 200), spec, "join")) == paths(random_walk(g, seeds(spark, 200), spec, "local"))


@pytest.mark.parametrize("block", [1024, 3])
def test_second_order_rows_packed_and_by_slot(spark, monkeypatch, block):
    """The same walks from packed rows, by joins around vertices of more than a block, and in one pass."""
    monkeypatch.setattr(walk, "BLOCK", block)
    edges = [(a, b, ((a * 13 + b * 7) % 17 + 1) / 7) for a in range(9) for b in range(9) if a != b and (a * b) % 5 != 1 and (a < 4 or b < 4)] + [(2, 11, 0.5), (10, 0, 1.0)]
    g, s = graph(spark, edges), seeds(spark, 90).withColumn("node", F.col("walker") % 13)
    joins = []
    monkeypatch.setattr(walk._SecondOrder, "joined", lambda self, *a, f=walk._SecondOrder.joined: (joins.append(1), f(self, *a))[1])
    for spec in (WalkSpec(4, bias="node2vec", p=3.0, q=0.3), WalkSpec(4, bias="node2vec", p=9.0, q=1.5, reject=True), WalkSpec(3, bias="node2vec_floor", tp=0.2)):
        assert paths(random_walk(g, s, spec, "join", segment=3)) == paths(random_walk(g, s, spec, "local"))
    assert bool(joins) == (block == 3)
    ups = lambda c: F.coalesce(c.state, F.lit(0)) + F.when(c.dst > c.node, 1).otherwise(0)
    bias = lambda c: F.when(c.connected | (ups(c) > 2), 0.0).otherwise(c.w)
    found = paths(random_walk(g, s, WalkSpec(4, bias=bias, update=ups)))
    links = {(a, b) for a, b, _ in edges}
    assert max(map(len, found.values())) > 2
    for p in found.values():
        assert sum(b > a for a, b in zip(p, p[1:])) <= 2 and all(e in links for e in zip(p, p[1:]))
        assert not any((a, c) in links for a, c in zip(p, p[2:]))


def test_own_bias_reads_the_walkers_state(spark):
    """Never back to the vertex before, and never more than twice upwards."""
    g = graph(spark, [(a, b, 1.0) for a in range(6) for b in range(6) if a != b])
    ups = lambda c: F.coalesce(c.state, F.lit(0)) + F.when(c.dst > c.node, 1).otherwise(0)
    bias = lambda c: F.when(c.prev.eqNullSafe(c.dst) | (ups(c) > 2), 0.0).otherwise(c.w)
    found = paths(random_walk(g, seeds(spark, 60).withColumn("node", F.col("walker") % 6), WalkSpec(6, bias=bias, update=ups), segment=4))
    for p in found.values():
        assert sum(b > a for a, b in zip(p, p[1:])) <= 2
        assert all(a != c for a, c in zip(p, p[2:]))
    assert max(map(len, found.values())) > 3
    with pytest.raises(ValueError):
        random_walk(g, seeds(spark, 1), WalkSpec(1, bias=bias), "local")


def test_walkers_beyond_the_bound_are_refused(spark):
    with pytest.raises(Exception, match="walkers are numbers below"):
        random_walk(graph(spark, CYCLE), seeds(spark, 1).withColumn("walker", F.lit(120_000_000_000)), WalkSpec(1), "local").collect()


def test_termination_is_geometric(spark):
    walks = random_walk(graph(spark, CYCLE), seeds(spark, 5000), walk.ppr(60), "local")
    mean = walk.lengths(walks).agg(F.avg("length")).first()[0]
    assert abs(mean - 0.85 / 0.15) < 0.3


def test_bias_of_an_own_column(spark):
    g = graph(spark, ZERO_EDGE)
    walks = random_walk(g, seeds(spark, 50), WalkSpec(1, bias=F.when(F.col("dst") == 3, 1.0).otherwise(0.0)), "local")
    assert {r.node for r in walks.where("step = 1").collect()} == {3}


def test_wrong_names_are_refused(spark):
    g = graph(spark, CYCLE)
    with pytest.raises(ValueError):
        random_walk(g, seeds(spark, 1), WalkSpec(1, bias="best"))
    with pytest.raises(ValueError):
        random_walk(g, seeds(spark, 1), WalkSpec(1), strategy="fast")


def test_step_join_shuffles_walkers_only(spark):
    """Edges spread by (src, pos) keep their partitioning; only the walkers' side has an exchange."""
    g = graph(spark, KITE).cached()
    g.edges.count()
    state = seeds(spark, 10).withColumn("node", F.col("walker") % 4).withColumn("deg", F.lit(2).cast("long")).withColumn("alive", F.lit(True))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        step = walk._Uniform(g, WalkSpec(3)).step(state, 0)
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    above_cache = plan.split("InMemoryRelation")[0]
    assert "SortMergeJoin" in above_cache or "ShuffledHashJoin" in above_cache
    assert above_cache.count("Exchange hashpartitioning") == 1
    assert step.count() == 10


def test_metrics(spark):
    walks = random_walk(graph(spark, SINK), seeds(spark, 4), WalkSpec(9), "local")
    assert metrics.walked_edges(walks).first()[0] == 8
    assert [(r.walker, r.nodes) for r in metrics.first_walks(walks).orderBy("walker").collect()] == [(k, "0 1") for k in range(3)]
    told = metrics.timed(lambda: walks)
    assert told["sampled_edges"] == 8 and told["mseps"] > 0
