"""Intermediate tables, connected components and Arrow batches shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.plans.tables import discard, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches between the JVM and Python workers: rows and bytes at most (one row at least).
BATCH_ROWS = 512
BATCH_BYTES = "8m"


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with small batches, so that long texts don't pile up beside the heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def carried(docs: DataFrame) -> DataFrame:
    """Whole rows as one column ``__row``, for operators that pass on every column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``__row`` with its doc_id and text beside it, without a copy."""
    for batch in batches:
        row = batch.column("__row")
        names = [row.type.field(i).name for i in range(row.type.num_fields)]
        parts = [row.field(names.index(c)) for c in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([*parts, row], names=["doc_id", "text", "__row"])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``text``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if i > first and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        yield batch.slice(first)


def _state(edges: DataFrame) -> tuple:
    """Count and 128 bits over a set of edges: equal where the edges are the same."""
    return tuple(edges.agg(F.count("*"), *[F.bit_xor(F.xxhash64(F.lit(i), "lo", "hi")) for i in range(2)]).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected edge list: rows (node, label), label the least node.

    Alternates the large-star and small-star steps.  Every step takes each node's
    least neighbour, with partial aggregation, and joins it back to the edges.  The
    minima are written before that join, which then deals both sides anew, so that
    Spark can split a hub's edges over tasks.  Stops when a round changes no edge.
    Loops and nulls are ignored; nodes without edges have no row.
    """
    now = materialize(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .where("lo is not null and hi is not null and lo <> hi")
        .distinct(),
        "cc-edges",
    )
    before = None
    while True:
        state = _state(now)
        if state == before or state[0] == 0:
            break
        before = state
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = materialize(
            both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct(),
            "cc-large",
        )
        # Small star: of the smaller neighbours of hi, the least takes the others.
        least_lo = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "cc-least")
        small = large.join(least_lo, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")),
                    F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")),
                )
            ).alias("e")
        ).select("e.lo", "e.hi")
        after = materialize(small.where("lo <> hi").distinct(), "cc-edges")
        discard(now, least, large, least_lo)
        now = after
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return nodes.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("label"))).distinct()
