"""Directed, optionally weighted graphs as edge and vertex DataFrames.

``edges(src, pos, dst, w, src_deg, dst_deg)``: pos numbers a row's edges from 0 by
dst.  A uniform step is then one equi-join on (src, pos), and as both columns are
hashed a hub's edges lie in many partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambler.functions import rng


#: Destinations in a block of a row: edges are numbered inside blocks, so a hub's row is many windows.
BLOCK_IDS = 1 << 20


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


@dataclass
class Graph:
    """A graph in canonical form; built by the class methods."""

    edges: DataFrame

    @classmethod
    def from_edges(cls, raw: DataFrame, duplicates: str = "keep", relabel: bool = False) -> Graph:
        """From rows (src, dst[, w]).

        ``duplicates``: keep parallel edges, or sum their weights.  ``relabel``: number
        the vertices densely by their order, for files with sparse or textual ids.
        """
        raw = raw if "w" in raw.columns else raw.withColumn("w", F.lit(1.0))
        raw = raw.where("src is not null and dst is not null")
        if relabel:
            raw = _relabelled(raw)
        raw = raw.select(_long("src"), _long("dst"), F.col("w").cast("double").alias("w"))
        if duplicates == "sum":
            raw = raw.groupBy("src", "dst").agg(F.sum("w").alias("w"))
        elif duplicates != "keep":
            raise ValueError(f"duplicates: {duplicates!r}")
        blocked = raw.withColumn("block", F.floor(F.col("dst") / BLOCK_IDS))
        earlier = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        counts = blocked.groupBy("src", "block").agg(F.count("*").alias("n"))
        bases = counts.select(
            "src",
            "block",
            F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("base"),
            F.sum("n").over(Window.partitionBy("src")).alias("src_deg"),
        )
        inside = F.row_number().over(Window.partitionBy("src", "block").orderBy("dst", "w"))
        numbered = blocked.withColumn("inside", inside.cast("long") - 1).join(bases, ["src", "block"])
        degrees = counts.groupBy(F.col("src").alias("dst")).agg(F.sum("n").alias("dst_deg"))
        return cls(
            numbered.withColumn("pos", F.col("base") + F.col("inside"))
            .join(degrees, "dst", "left")
            .select("src", "pos", "dst", "w", "src_deg", F.coalesce("dst_deg", F.lit(0).cast("long")).alias("dst_deg"))
        )

    @classmethod
    def from_adjacency(cls, rows: DataFrame) -> Graph:
        """From rows (src, nbrs array<struct<dst, w>>)."""
        return cls.from_edges(rows.select("src", F.explode("nbrs").alias("n")).select("src", "n.dst", "n.w"))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def cached(self, partitions: int | None = None) -> Graph:
        """Edges spread by (src, pos) and kept, so that steps shuffle only their walkers."""
        # A stated number, at least that of later shuffles: AQE doesn't merge it, and joins keep it.
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = self.edges.repartition(n, "src", "pos")
        return Graph(spread.persist())

    def written(self) -> Graph:
        """Edges as a table in the shared folder: plans that read them more than once don't make them again."""
        from ambler.plans.tables import materialize

        return Graph(materialize(self.edges, "edges"))

    @cached_property
    def ids(self) -> DataFrame:
        """id of every endpoint: sources by their first edges, and sinks."""
        return self.edges.where("pos = 0").select(F.col("src").alias("id")).unionAll(self.edges.where("dst_deg = 0").select(F.col("dst").alias("id")).distinct())

    @cached_property
    def vertices(self) -> DataFrame:
        """id, deg, total_w, valid of every endpoint; deg 0 for sinks, valid where total_w > 0."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("n"), "w").unionAll(
            self.edges.where("dst_deg = 0").select(F.col("dst").alias("id"), F.lit(0), F.lit(0.0))
        )
        return ends.groupBy("id").agg(F.sum("n").cast("long").alias("deg"), F.sum("w").alias("total_w")).withColumn(
            "valid", F.col("total_w") > 0
        )

    def stats(self) -> DataFrame:
        """One row: vertices, edges, the largest degree and its least vertex, average degree, sinks."""
        return self.vertices.agg(
            F.count("*").alias("vertices"),
            F.sum("deg").alias("edges"),
            F.max("deg").alias("max_deg"),
            F.min_by("id", F.struct(-F.col("deg"), "id")).alias("max_id"),
            F.floor(F.sum("deg") / F.count("*")).alias("avg_deg"),
            F.count_if(F.col("deg") == 0).alias("sinks"),
        )

    def degree_histogram(self) -> DataFrame:
        return self.vertices.groupBy("deg").agg(F.count("*").alias("n"))

    def degree_of(self, ids: DataFrame) -> DataFrame:
        """ids(id) with their degrees, 0 for ids the graph lacks."""
        return ids.join(self.vertices.select("id", "deg"), "id", "left").fillna(0, ["deg"])

    def compressed_offset_bytes(self) -> DataFrame:
        """Bytes of slot numbers at 1, 2 or 4 bytes by a row's degree."""
        width = F.when(F.col("deg") < 256, 1).when(F.col("deg") < 65536, 2).otherwise(4)
        return self.vertices.agg(F.sum(F.col("deg") * width).alias("bytes"))

    def has_edges(self, pairs: DataFrame, src: str, dst: str, flag: str = "connected") -> DataFrame:
        """``pairs`` with whether the edge exists."""
        known = self.edges.select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct().withColumn(flag, F.lit(True))
        return pairs.join(known, [src, dst], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

    def without_high_degree(self, limit: int) -> Graph:
        """Vertices of at least ``limit`` edges end walks instead of going on."""
        kept = self.edges.where(F.col("src_deg") < limit)
        return Graph(kept.withColumn("dst_deg", F.when(F.col("dst_deg") < limit, F.col("dst_deg")).otherwise(F.lit(0).cast("long"))))

    def with_weights(self, kind: str, weight_range: float = 1.0, seed: int = 0) -> Graph:
        """Edge weights replaced: random in [0, range), src_degree, dst_degree, unit or dst_vertex.

        dst_vertex reads the weight at edge number dst, edges being numbered by (src, pos).
        """
        e = self.edges
        if kind == "random":
            u = rng.draw(F.col("src"), F.col("pos"), rng.Channel.WEIGHT, seed) / F.lit(float(rng.M))
            return Graph(e.withColumn("w", u * float(weight_range)))
        if kind in ("src_degree", "dst_degree"):
            return Graph(e.withColumn("w", F.col(kind[:3] + "_deg").cast("double")))
        if kind == "unit":
            return Graph(e.withColumn("w", F.lit(1.0)))
        if kind != "dst_vertex":
            raise ValueError(f"weights: {kind!r}")
        rows = e.where("pos = 0").select("src", "src_deg")
        numbered = rows.join(_row_offsets(rows), "src")
        by_number = e.join(numbered.select("src", "first"), "src").select(
            (F.col("first") + F.col("pos")).alias("dst"), F.col("w").alias("vertex_w")
        )
        return Graph(
            e.join(by_number, "dst", "left")
            .withColumn("w", F.coalesce("vertex_w", F.lit(0.0)))
            .select(*e.columns)
        )

    def packed(self) -> DataFrame:
        """One row per source: dsts, ws, dst_degs in slot order."""
        edge = F.struct("pos", "dst", "w", "dst_deg")
        rows = self.edges.groupBy("src").agg(F.array_sort(F.collect_list(edge)).alias("e"))
        return rows.select("src", F.col("e.dst").alias("dsts"), F.col("e.w").alias("ws"), F.col("e.dst_deg").alias("dst_degs"))


def _relabelled(raw: DataFrame) -> DataFrame:
    """Dense ids by rank; ranks are counted inside hash-free ranges of the ids, not in one task."""
    ids = raw.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    ranged = ids.repartitionByRange("name").withColumn("part", F.spark_partition_id())
    from ambler.plans.tables import materialize

    ranged = materialize(ranged, "labels")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("name")
    numbered = ranged.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(base), "part")
    labels = numbered.select("name", (F.col("base") + F.col("rank")).alias("id"))
    named = raw.join(labels.withColumnRenamed("name", "src").withColumnRenamed("id", "a"), "src")
    named = named.join(labels.withColumnRenamed("name", "dst").withColumnRenamed("id", "b"), "dst")
    return named.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def _row_offsets(rows: DataFrame, width: int = 4096) -> DataFrame:
    """Edges before each source: totals of blocks of ids are summed, then rows inside each block."""
    block = F.floor(F.col("src") / width)
    blocked = rows.withColumn("block", block)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocked.groupBy("block").agg(F.sum("src_deg").alias("n")).select(
        "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("block").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("before", F.coalesce(F.sum("src_deg").over(inside), F.lit(0)))
        .join(bases, "block")
        .select("src", (F.col("base") + F.col("before")).alias("first"))
    )


def edge_cut(graph: Graph, parts: int) -> DataFrame:
    """part, first_id, last_id, vertices, edges of ranges holding about equal numbers of edges."""
    rows = graph.vertices.select(F.col("id").alias("src"), F.col("deg").alias("src_deg"))
    total = rows.agg(F.greatest(F.sum("src_deg"), F.lit(1)).alias("total"))
    placed = rows.join(_row_offsets(rows), "src").crossJoin(F.broadcast(total))
    part = F.least(F.floor(F.col("first") * parts / F.col("total")), F.lit(parts - 1)).cast("int")
    return _ranges(placed.withColumn("part", part))


def vertex_cut(graph: Graph, parts: int) -> DataFrame:
    """As :func:`edge_cut` for ranges of equally many ids."""
    rows = graph.vertices.select(F.col("id").alias("src"), F.col("deg").alias("src_deg"))
    return _ranges(locality_buckets(rows, graph, parts).withColumnRenamed("bucket", "part"))


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").agg(
        F.min("src").alias("first_id"), F.max("src").alias("last_id"), F.count("*").alias("vertices"), F.sum("src_deg").alias("edges")
    )


def locality_buckets(rows: DataFrame, graph: Graph, buckets: int = 10, column: str = "src") -> DataFrame:
    """``rows`` with the bucket src / (V / buckets + 1), V being one above the largest id."""
    size = graph.vertices.agg((F.max("id") + 1).alias("V"))
    width = F.floor(F.col("V") / buckets) + 1
    return rows.crossJoin(F.broadcast(size)).withColumn("bucket", F.floor(F.col(column) / width).cast("int")).drop("V")
