import struct

import pytest
from graphs import CYCLE, FORK, KITE, graph, seeds

from ambler.operators import metrics
from ambler.operators.walk import WalkSpec
from ambler.sources import gr, text
from ambler.streaming.seeds import walk_batches, walk_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hand_built_bytes_with_padding(spark, tmp_path):
    path = str(tmp_path / "t.gr")
    body = struct.pack("<4Q", 1, 4, 3, 3) + struct.pack("<3Q", 1, 2, 3) + struct.pack("<3I", 1, 2, 0) + b"\xff" * 4 + struct.pack("<3I", 7, 8, 9)
    open(path, "wb").write(body)
    assert rows(gr.read_gr(spark, path)) == [(0, 0, 1, 7.0), (1, 0, 2, 8.0), (2, 0, 0, 9.0)]
    assert rows(gr.read_gr_header(spark, path)) == [(1, 4, 3, 3)]
    cut = spark.read.format("gr").option("edgesPerTask", 2).load(path)
    assert cut.rdd.getNumPartitions() == 2 and rows(cut) == rows(gr.read_gr(spark, path))


def test_round_trip_and_files_without_weights(spark, tmp_path):
    g = graph(spark, KITE)
    for weighted in (True, False):
        path = str(tmp_path / f"{weighted}.gr")
        gr.write_gr(g, path, weighted)
        back = gr.graph_from_gr(spark, path, 5.0)
        assert rows(back.edges.select("src", "pos", "dst")) == rows(g.edges.select("src", "pos", "dst"))
        assert all(w == 1.0 if weighted else 0 <= w < 5 for (w,) in rows(back.edges.select("w")))


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Gaps between ids, sinks and runs that cross tasks; the driver takes no edges."""
    edges = [(a, (a * 37 + k * 11) % 90, float(k + 1)) for a in range(0, 60, 3) for k in range(a % 7)] + [(70, 99, 3.0)]
    monkeypatch.setattr(gr, "_IDS", 8)
    monkeypatch.setattr(gr, "_RUN", 5)
    monkeypatch.setattr(type(spark.range(0)), "toArrow", None)
    g, path = graph(spark, edges), str(tmp_path / "t.gr")
    gr.write_gr(g, path)
    assert gr.read_header(path) == (1, 4, 100, len(edges))
    assert rows(gr.read_gr(spark, path)) == rows(g.edges.select("src", "pos", "dst", "w"))
    gr.write_gr(graph(spark, []), path)
    assert gr.read_header(path) == (1, 4, 0, 0) and rows(gr.read_gr(spark, path)) == []


def test_bad_headers_are_refused(tmp_path):
    path = tmp_path / "bad.gr"
    for held in (b"", struct.pack("<4Q", 2, 0, 0, 0), struct.pack("<4Q", 1, 8, 0, 0)):
        path.write_bytes(held)
        with pytest.raises(ValueError):
            gr.read_header(str(path))


def test_edge_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n0 1 2.5\n\n1  0 1\n")
    g = text.read_edge_list(spark, str(tmp_path / "e.txt"), weighted=True)
    assert rows(g.edges.select("src", "dst", "w")) == [(0, 1, 2.5), (1, 0, 1.0)]
    (tmp_path / "n.csv").write_text("x,y\ny,z\n")
    g = text.read_edge_list(spark, str(tmp_path / "n.csv"), sep=",", relabel=True)
    assert rows(g.edges.select("src", "dst")) == [(0, 1), (1, 2)]


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 2\n2 1 5.0\n3 3 1.5\n")
    g = text.read_matrix_market(spark, str(tmp_path / "m.mtx"))
    assert rows(g.edges.select("src", "dst", "w")) == [(0, 1, 5.0), (1, 0, 5.0), (2, 2, 1.5)]


@pytest.mark.parametrize("split", ["128m", "16"])
def test_matrix_market_keeps_an_entry_that_equals_the_size_line(spark, tmp_path, split):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 3 3\n1 2 5.0\n3 3 3\n2 1 1.5\n")
    (tmp_path / "empty.mtx").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        g = text.read_matrix_market(spark, str(tmp_path / "m.mtx"))
        assert rows(g.edges.select("src", "dst", "w")) == [(0, 1, 5.0), (1, 0, 1.5), (2, 2, 3.0)]
        assert rows(text.read_matrix_market(spark, str(tmp_path / "empty.mtx")).edges) == []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parquet_and_metrics_sinks(spark, tmp_path):
    g = graph(spark, FORK)
    text.write_parquet(g, str(tmp_path / "g"))
    assert rows(text.read_parquet(spark, str(tmp_path / "g")).edges) == rows(g.edges)
    metrics.write_metrics(spark, [{"ms": 1.0, "sampled_edges": 2, "mseps": 0.5}], str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1


def test_streams_of_seeds(spark, tmp_path):
    source = str(tmp_path / "in")
    seeds(spark, 3).write.parquet(source)
    stream = spark.readStream.schema("walker long, node long").parquet(source)
    out = str(tmp_path / "out")
    q = walk_stream(graph(spark, CYCLE), stream, WalkSpec(2)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    expected = [(k, t, t) for k in range(3) for t in range(3)]
    assert rows(spark.read.parquet(out)) == expected
    found = []
    q = walk_batches(graph(spark, CYCLE), stream, WalkSpec(2), lambda df, n: found.extend(rows(df))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(found) == expected
