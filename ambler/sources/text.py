"""Edge lists as text, and graphs as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.operators.graph import Graph


def read_edge_list(spark: SparkSession, path: str, sep: str = " ", weighted: bool = False, relabel: bool = False) -> Graph:
    """Lines ``src dst [w]``; lines that begin with # or % are comments."""
    schema = "src string, dst string, w double" if weighted else "src string, dst string"
    lines = spark.read.text(path).where("not value rlike '^\\\\s*([#%]|$)'")
    parts = F.split(F.trim("value"), f"{sep}+" if sep == " " else sep)
    cells = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(("src", "dst", "w")[: 3 if weighted else 2])]
    rows = lines.select(*cells)
    rows = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    if not relabel:
        rows = rows.withColumn("src", F.col("src").cast("long")).withColumn("dst", F.col("dst").cast("long"))
    return Graph.from_edges(rows, relabel=relabel)


def read_matrix_market(spark: SparkSession, path: str) -> Graph:
    """Coordinate files, numbered from 1; symmetric ones go both ways.

    The size line is the first one that is no comment, and is left out by its place
    in the file; entries that equal it stay.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("place"))
    head = lines.where("value like '\\%\\%MatrixMarket%'").first()
    kind = head.value.lower() if head else ""
    rows = lines.where("not value rlike '^\\\\s*(%|$)'")
    size = rows.agg(F.min("place").alias("place")).first().place
    if size is not None:
        rows = rows.where((F.col("place.block") != size.block) | (F.col("place.row") != size.row))
    cells = F.split(F.trim("value"), "\\s+")
    edges = rows.select(cells.alias("c")).select(
        (F.get("c", F.lit(0)).cast("long") - 1).alias("src"),
        (F.get("c", F.lit(1)).cast("long") - 1).alias("dst"),
        F.coalesce(F.get("c", F.lit(2)).cast("double"), F.lit(1.0)).alias("w"),
    )
    if "symmetric" in kind:
        edges = edges.unionAll(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return Graph.from_edges(edges)


def write_parquet(graph: Graph, path: str, buckets: int | None = None) -> None:
    """Canonical edges; a later read by :func:`read_parquet` needs no ranking again."""
    rows = graph.edges.repartition(buckets, "src") if buckets else graph.edges
    rows.sortWithinPartitions("src", "pos").write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(path))


def write_edge_list(graph: Graph, path: str, weighted: bool = True) -> None:
    """Lines ``src dst [w]``, as :func:`read_edge_list` takes them."""
    columns = ("src", "dst", "w") if weighted else ("src", "dst")
    graph.edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_walks(walks: DataFrame, path: str) -> None:
    walks.write.mode("overwrite").parquet(path)
