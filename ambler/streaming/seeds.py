"""Walks over a stream of seeds.

Each seed's walk depends on the seed alone, so a stream needs no state: with the
local strategy the walk is a projection of the stream; otherwise each micro-batch
is walked by joins and handed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ambler.operators.graph import Graph
from ambler.operators.walk import WalkSpec, random_walk


def walk_stream(graph: Graph, seeds: DataFrame, spec: WalkSpec) -> DataFrame:
    """Streaming walks of streaming seeds(walker, node), for graphs that workers can hold."""
    return random_walk(graph, seeds, spec, strategy="local")


def walk_batches(graph: Graph, seeds: DataFrame, spec: WalkSpec, sink: Callable[[DataFrame, int], None], **options):
    """Writer that walks each micro-batch by joins; call ``start()`` on it."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(random_walk(graph, rows, spec, strategy="join", **options), number)

    return seeds.writeStream.foreachBatch(batch)
