import pytest
from graphs import KITE, graph

from ambler import cli
from ambler.sources import gr


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    found = str(tmp_path_factory.mktemp("cli") / "kite.gr")
    gr.write_gr(graph(spark, KITE), found)
    return found


@pytest.mark.parametrize("flags, edges", [
    ("--deepwalk --no-bias --d 5", 20),
    ("--deepwalk --d 5 --strategy join", 20),
    ("--node2vec --d 4 --p 4 --q 0.25 --ol", 16),
    ("--node2vec --no-bias --d 3", 12),
    ("--rw --d 3 --dw --ol", 12),
    ("--k 2 --d 2 --ol", None),
    ("--k 2 --d 1 --randomweight", None),
    ("--sage --no-bias", 4 * (25 + 250)),
])
def test_applications(spark, path, tmp_path, flags, edges):
    a = cli.parser().parse_args(["--input", path, "--full", "--output", str(tmp_path / "out"), "--csv", str(tmp_path / "csv"), "--printresult", *flags.split()])
    told = cli.run(spark, a)
    assert told["sampled_edges"] == edges or edges is None and told["sampled_edges"] > 0
    assert ("table_ms" in told) == ("--ol" not in flags and "--no-bias" not in flags)
    assert spark.read.parquet(str(tmp_path / "out")).count() > told["sampled_edges"]


def test_termination_preset(spark, path):
    a = cli.parser().parse_args(["--input", path, "--ppr", "--n", "3"])
    assert cli.spec_of(a).tp == 0.15 and cli.run(spark, a)["sampled_edges"] < 300


def test_defaults(path):
    a = cli.parser().parse_args(["--input", path, "--rw"])
    assert (a.ol, a.n, a.k, cli.spec_of(a).depth) == (False, 4000, 2, 2)
    assert cli.spec_of(cli.parser().parse_args(["--input", path, "--deepwalk"])).depth == 100
