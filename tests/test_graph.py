import pytest
from graphs import FORK, KITE, SINK, graph
from pyspark.sql import functions as F

from ambler.operators import graph as G
from ambler.operators.graph import Graph


def test_edges_are_numbered_by_destination(spark):
    g = graph(spark, [(5, 9, 2.0), (5, 7, 1.0), (9, 5, 4.0)])
    got = sorted(tuple(r) for r in g.edges.select("src", "pos", "dst", "w", "src_deg", "dst_deg").collect())
    assert got == [(5, 0, 7, 1.0, 2, 0), (5, 1, 9, 2.0, 2, 1), (9, 0, 5, 4.0, 1, 2)]


def test_rows_are_numbered_across_blocks(spark, monkeypatch):
    edges = [(7, d, float(d % 3)) for d in (5, 1, 900, 17, 16, 15, 901, 33)] + [(8, 2, 1.0)]
    expected = sorted(map(tuple, graph(spark, edges).edges.collect()))
    monkeypatch.setattr(G, "BLOCK_IDS", 16)
    got = sorted(map(tuple, graph(spark, edges).edges.collect()))
    assert got == expected and [r[1] for r in got[:8]] == list(range(8))


def test_vertices_and_stats(spark):
    g = graph(spark, SINK)
    assert sorted(tuple(r) for r in g.vertices.select("id", "deg", "valid").collect()) == [(0, 1, True), (1, 1, True), (2, 0, False)]
    row = g.stats().first()
    assert (row.vertices, row.edges, row.max_deg, row.max_id, row.avg_deg, row.sinks) == (3, 2, 1, 0, 0, 1)


def test_parallel_edges_nulls_and_missing_weights(spark):
    raw = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (None, 1, 1.0), (0, None, 1.0)], "src long, dst long, w double")
    assert Graph.from_edges(raw).edges.count() == 2
    assert [tuple(r) for r in Graph.from_edges(raw, duplicates="sum").edges.select("src", "dst", "w").collect()] == [(0, 1, 5.0)]
    assert Graph.from_edges(raw.drop("w")).edges.agg(F.sum("w")).first()[0] == 2.0
    with pytest.raises(ValueError):
        Graph.from_edges(raw, duplicates="max")


def test_relabel_is_dense_and_ordered(spark):
    raw = spark.createDataFrame([("b", "a"), ("c", "zz"), ("a", "zz")], "src string, dst string")
    got = sorted((r.src, r.dst) for r in Graph.from_edges(raw, relabel=True).edges.collect())
    assert got == [(0, 3), (1, 0), (2, 3)]


def test_edge_exists_and_degree_lookup(spark):
    g = graph(spark, KITE)
    pairs = spark.createDataFrame([(0, 1), (0, 3), (3, 2)], "a long, b long")
    assert {(r.a, r.b): r.connected for r in g.has_edges(pairs, "a", "b").collect()} == {(0, 1): True, (0, 3): False, (3, 2): True}
    assert {r.id: r.deg for r in g.degree_of(spark.createDataFrame([(2,), (77,)], "id long")).collect()} == {2: 3, 77: 0}


def test_weights(spark):
    g = graph(spark, FORK)
    assert [r.w for r in g.with_weights("src_degree").edges.collect()] == [3.0] * 3
    w = [r.w for r in g.with_weights("random", 10).edges.collect()]
    assert all(0 <= x < 10 for x in w) and len(set(w)) == 3
    by_vertex = graph(spark, [(0, 1, 5.0), (0, 2, 6.0), (1, 0, 7.0)]).with_weights("dst_vertex").edges
    assert sorted((r.src, r.dst, r.w) for r in by_vertex.collect()) == [(0, 1, 6.0), (0, 2, 7.0), (1, 0, 5.0)]
    with pytest.raises(ValueError):
        g.with_weights("other")


def test_cuts_cover_all_vertices(spark):
    g = graph(spark, [(i, (i + 1) % 50, 1.0) for i in range(50)])
    for cut in (G.edge_cut(g, 4), G.vertex_cut(g, 4)):
        rows = sorted(tuple(r) for r in cut.select("first_id", "last_id", "vertices", "edges").collect())
        assert sum(r[2] for r in rows) == 50 and sum(r[3] for r in rows) == 50
        assert all(a[1] < b[0] for a, b in zip(rows, rows[1:]))


def test_high_degree_vertices_end_walks(spark):
    g = graph(spark, [*FORK, (1, 0, 1.0)]).without_high_degree(3)
    assert [(r.src, r.dst, r.dst_deg) for r in g.edges.collect()] == [(1, 0, 0)]


def test_adjacency_and_packed_agree(spark):
    g = graph(spark, KITE)
    packed = g.packed().select("src", F.expr("transform(arrays_zip(dsts, ws), x -> named_struct('dst', x.dsts, 'w', x.ws))").alias("nbrs"))
    again = Graph.from_adjacency(packed)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, g.edges.collect()))
