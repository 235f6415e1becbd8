"""Command line: ``python -m ambler --input graph.gr --deepwalk --n 40000``.

Reads a graph, walks or samples it, prints counts and throughput, and writes the rows
where ``--output`` says.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ambler.operators import alias, metrics, sample, walk
from ambler.operators.graph import Graph
from ambler.sources import gr, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ambler", description=__doc__)
    p.add_argument("--input", required=True, help="graph: .gr, .mtx, .parquet folder, or text edge list")
    p.add_argument("--output", help="folder for the walks or samples, as Parquet")
    app = p.add_mutually_exclusive_group()
    for name, told in (
        ("deepwalk", "first-order walks"),
        ("ppr", "walks that end with probability --tp before each move"),
        ("node2vec", "second-order walks with --p and --q"),
        ("sage", "samples of 25 and 10 neighbours"),
    ):
        app.add_argument(f"--{name}", action="store_true", help=told)
    p.add_argument("--rw", action="store_true", help="walk; without it, or an application, sample --d hops of --k")
    p.add_argument("--n", type=int, default=4000, help="seeds: vertices 0 to n - 1")
    p.add_argument("--full", action="store_true", help="one seed for every vertex")
    p.add_argument("--k", type=int, default=2, help="neighbours for each hop")
    p.add_argument("--d", type=int, help="hops, or moves of a walk; 100 for the applications that walk, else 2")
    p.add_argument("--bias", action=argparse.BooleanOptionalAction, default=True, help="draw by weight")
    p.add_argument("--ol", action=argparse.BooleanOptionalAction, default=False, help="draw from running weights, not from alias tables")
    p.add_argument("--tp", type=float, default=0.0)
    p.add_argument("--p", type=float, default=2.0)
    p.add_argument("--q", type=float, default=0.5)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--dw", action="store_true", help="the source's degree as weight")
    p.add_argument("--randomweight", action="store_true", help="random weights below --weightrange")
    p.add_argument("--weightrange", type=float, default=2.0)
    p.add_argument("--weighted", action="store_true", help="text edge lists have a third column")
    p.add_argument("--strategy", choices=("auto", "local", "join"), default="auto")
    p.add_argument("--printresult", action="store_true")
    p.add_argument("--csv", help="folder to append a row of metrics to")
    return p


def load(spark: SparkSession, a: argparse.Namespace) -> Graph:
    if a.input.endswith(".gr"):
        g = gr.graph_from_gr(spark, a.input, a.weightrange)
    elif a.input.endswith(".mtx"):
        g = text.read_matrix_market(spark, a.input)
    elif a.input.rstrip("/").endswith(".parquet"):
        g = text.read_parquet(spark, a.input)
    else:
        g = text.read_edge_list(spark, a.input, weighted=a.weighted)
    if not a.bias:
        return g.with_weights("unit")
    if a.randomweight:
        return g.with_weights("random", a.weightrange)
    return g.with_weights("src_degree") if a.dw else g


def spec_of(a: argparse.Namespace) -> walk.WalkSpec | None:
    """The walk to take, or None for a sample."""
    if a.sage or not (a.rw or a.deepwalk or a.ppr or a.node2vec):
        return None
    depth = a.d if a.d is not None else 100 if a.deepwalk or a.ppr or a.node2vec else 2
    bias = "node2vec" if a.node2vec else "weight" if a.bias else "uniform"
    tp = a.tp or (0.15 if a.ppr else 0.0)
    return walk.WalkSpec(depth, bias, table=not a.ol and bias == "weight", tp=tp, p=a.p, q=a.q, seed=a.seed, reject=a.node2vec and not a.bias)


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    g = load(spark, a).cached()
    g.edges.count()
    spec, step = spec_of(a), "hop"
    told: dict = {}
    if a.bias and not a.ol:
        began = time.perf_counter()
        alias.build_alias_table(g).count()
        told["table_ms"] = 1000 * (time.perf_counter() - began)
    if spec is not None:
        seeds = walk.all_vertices(g) if a.full else walk.first_vertices(g, a.n)
        rows, step = walk.random_walk(g, seeds, spec, a.strategy), "step"
    else:
        seeds = walk.all_vertices(g) if a.full else walk.first_vertices(g, a.n)
        fanouts = sample.SAGE_FANOUTS if a.sage else (a.k,) * (a.d if a.d is not None else 2)
        method = "uniform" if not a.bias else "weighted_distinct" if a.ol else "alias"
        rows = sample.neighbor_sample(g, seeds.withColumnRenamed("walker", "instance"), fanouts, method, a.seed)
    if a.output:
        began = time.perf_counter()
        text.write_walks(rows, a.output)
        seconds = time.perf_counter() - began
        rows = spark.read.parquet(a.output)
        edges = rows.where(F.col(step) > 0).count()
        told |= {"ms": 1000 * seconds, "sampled_edges": edges, "mseps": edges / seconds / 1e6}
    else:
        told |= metrics.timed(lambda: rows, step)
    if a.printresult:
        (metrics.first_walks(rows) if spec is not None else metrics.first_samples(rows)).show(200, truncate=False)
    if a.csv:
        metrics.write_metrics(spark, [told], a.csv)
    return told


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ambler").getOrCreate()
    print("\t".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in run(spark, a).items()))
