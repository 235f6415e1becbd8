"""Small hand-made graphs."""

from ambler.operators.graph import Graph

CYCLE = [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)]
SINK = [(0, 1, 1.0), (1, 2, 1.0)]
STAR = [(0, i + 1, 0.5 if i < 35 else 2.0) for i in range(40)]
ZERO_EDGE = [(0, 1, 1.0), (0, 2, 3.0), (0, 3, 0.0)]
NO_BIAS = [(0, 1, 0.0), (0, 2, 0.0)]
KITE = [e for a, b in ((0, 1), (1, 2), (0, 2), (2, 3)) for e in ((a, b, 1.0), (b, a, 1.0))]
EQUAL = [(0, 1, 1.0), (0, 2, 1.0)]
FORK = [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)]


def graph(spark, edges):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, w double"))


def seeds(spark, n, node=0, name="walker"):
    return spark.range(n).selectExpr(f"id as {name}", f"cast({node} as long) as node")


def paths(walks):
    found = {}
    for r in walks.collect():
        found.setdefault(r.walker, {})[r.step] = r.node
    return {k: [v[i] for i in range(len(v))] for k, v in found.items()}


def chi_square(counts, expected):
    n = sum(counts.values())
    assert set(counts) <= {k for k, p in expected.items() if p > 0}
    return sum((counts.get(k, 0) - n * p) ** 2 / (n * p) for k, p in expected.items() if p > 0)
