"""Binary adjacency files (version 1, little-endian) as a Spark data source.

Four 64-bit header numbers (version, bytes of an edge weight, V, E), V end offsets
of 64 bits, E destinations of 32 bits, four bytes of padding if E is odd, and E
weights of 32 bits if the header says so.

``spark.read.format("gr").load(path)`` gives (src, pos, dst, w); w is null in files
without weights.  ``option("headerOnly", "true")`` gives one row (version,
edge_bytes, vertices, edges).  A read is cut into ranges of edges, each read by
offset.  ``df.write.format("gr").mode("overwrite").save(path)`` is not offered: files
are written whole, by :func:`write_gr`, each task its ranges.  The path must be one that
every executor can open.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ambler.operators.graph import Graph, _row_offsets
from ambler.plans.tables import discard, materialize

_HEADER = struct.Struct("<4Q")
#: Vertices whose end offsets, and following edges that, write_gr's tasks write together.
_IDS, _RUN = 4096, 1 << 16


def read_header(path: str) -> tuple[int, int, int, int]:
    with open(path, "rb") as f:
        held = f.read(_HEADER.size)
    if len(held) < _HEADER.size:
        raise ValueError(f"{path}: no header")
    version, width, vertices, edges = _HEADER.unpack(held)
    if version != 1:
        raise ValueError(f"{path}: version {version}")
    if width not in (0, 4):
        raise ValueError(f"{path}: weights of {width} bytes")
    return version, width, vertices, edges


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class GrReader(DataSourceReader):
    def __init__(self, path: str, header_only: bool, per_task: int):
        self.path, self.header_only, self.per_task = path, header_only, per_task

    def partitions(self):
        edges = read_header(self.path)[3]
        if self.header_only:
            return [_Range(0, 0)]
        return [_Range(a, min(a + self.per_task, edges)) for a in range(0, max(edges, 1), self.per_task)]

    def read(self, partition):
        version, width, n, m = read_header(self.path)
        if self.header_only:
            yield version, width, n, m
            return
        first, last = partition.first, partition.last
        ends = np.memmap(self.path, "<u8", "r", _HEADER.size, (n,)) if n else np.zeros(0, np.uint64)
        place = _HEADER.size + 8 * n

        def part(start: int, a: int, b: int) -> np.ndarray:
            with open(self.path, "rb") as f:
                f.seek(start + 4 * a)
                return np.frombuffer(f.read(4 * (b - a)), "<u4")

        for a in range(first, last, 1 << 16):
            b = min(a + (1 << 16), last)
            number = np.arange(a, b, dtype=np.uint64)
            src = np.searchsorted(ends, number, side="right")
            begin = np.where(src > 0, ends[np.maximum(src - 1, 0)], 0).astype(np.int64)
            dst = part(place, a, b).astype(np.int64)
            if width:
                w = pa.array(part(place + 4 * (m + m % 2), a, b).astype(np.float64))
            else:
                w = pa.nulls(b - a, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(src.astype(np.int64)), pa.array(number.astype(np.int64) - begin), pa.array(dst), w],
                ["src", "pos", "dst", "w"],
            )


class GrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gr"

    def _header_only(self) -> bool:
        return self.options.get("headerOnly", "false").lower() == "true"

    def schema(self) -> str:
        if self._header_only():
            return "version long, edge_bytes long, vertices long, edges long"
        return "src long, pos long, dst long, w double"

    def reader(self, schema) -> DataSourceReader:
        return GrReader(self.options["path"].removeprefix("file:"), self._header_only(), int(self.options.get("edgesPerTask", 4_000_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrSource)


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("gr").load(path)


def read_gr_header(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("gr").option("headerOnly", "true").load(path)


def graph_from_gr(spark: SparkSession, path: str, weight_range: float = 1.0) -> Graph:
    """Graph of a file; random weights in [0, weight_range) where it has none."""
    rows = read_gr(spark, path)
    unweighted = read_header(path.removeprefix("file:"))[1] == 0
    graph = Graph.from_edges(rows.select("src", "dst", F.coalesce("w", F.lit(1.0)).alias("w")))
    return graph.with_weights("random", weight_range) if unweighted else graph


def write_gr(graph: Graph, path: str, weighted: bool = True) -> None:
    """One file; weights are rounded to whole numbers, as the format holds them.

    The driver writes the header; tasks write offsets and edges to their places in the
    file, which driver and executors must reach by the same path.
    """
    edges = materialize(graph.edges.select("src", "pos", "dst", "w", "src_deg"), "gr")
    last, m = edges.agg(F.max(F.greatest("src", "dst")), F.count("*")).first()
    n = 0 if last is None else last + 1
    if n > 1 << 32:
        raise ValueError(f"destinations have 32 bits: {last}")
    place, many = _HEADER.size + 8 * n, -(-n // _IDS)
    end = place + 4 * m + (4 * (m % 2 + m) if weighted else 4 * (m % 2))
    with open(path, "wb") as f:
        f.write(_HEADER.pack(1, 4 if weighted else 0, n, m))
        f.truncate(end)
    rows = edges.where("pos = 0").select("src", "src_deg", F.floor(F.col("src") / _IDS).alias("chunk"))
    held = rows.groupBy("chunk").agg(F.collect_list("src").alias("ids"), F.collect_list("src_deg").alias("degs"), F.sum("src_deg").alias("n"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = graph.spark.range(many).withColumnRenamed("id", "chunk").join(held.select("chunk", "n"), "chunk", "left")
    bases = totals.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    ends = bases.join(held.drop("n"), "chunk", "left")
    numbered = edges.join(_row_offsets(rows.select("src", "src_deg")), "src").select((F.col("first") + F.col("pos")).alias("number"), "dst", "w")
    shuffles = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = numbered.repartition(shuffles, F.floor(F.col("number") / _RUN)).sortWithinPartitions("number")
    weights = place + 4 * (m + m % 2) if weighted else None
    for df, write, wanted in ((ends, _write_ends(path, n), n), (numbered, _write_edges(path, place, weights), m)):
        written = df.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        if written != wanted:
            raise OSError(f"{path}: {written} of {wanted} written")
    discard(edges)


def _write_ends(path: str, n: int):
    """mapInArrow: end offsets of each chunk of _IDS vertices; gives how many were written."""
    start, width = _HEADER.size, _IDS

    def run(batches):
        with open(path, "r+b") as f:
            for batch in batches:
                for r in batch.to_pylist():
                    a = r["chunk"] * width
                    degs = np.zeros(min(width, n - a), np.int64)
                    degs[np.array(r["ids"] or [], np.int64) - a] = r["degs"] or []
                    f.seek(start + 8 * a)
                    f.write((r["base"] + np.cumsum(degs)).astype("<u8").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([len(degs)], pa.int64())], ["n"])

    return run


def _write_edges(path: str, place: int, weights: int | None):
    """mapInArrow: edges in the order of their numbers, runs of following numbers at once."""

    def run(batches):
        with open(path, "r+b") as f:
            for batch in batches:
                number, dst, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "dst", "w"))
                dst, w = dst.astype("<u4"), np.rint(w).astype("<u4") if weights is not None else None
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(number) != 1) + 1, [len(number)]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    f.seek(place + 4 * int(number[a]))
                    f.write(dst[a:b].tobytes())
                    if weights is not None:
                        f.seek(weights + 4 * int(number[a]))
                        f.write(w[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([len(number)], pa.int64())], ["n"])

    return run
