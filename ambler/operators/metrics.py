"""Counts, throughput and printable excerpts of walks and samples."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walked_edges(walks: DataFrame) -> DataFrame:
    """One row: edges walked, which is the sum of lengths."""
    return walks.where("step > 0").agg(F.count("*").alias("sampled_edges"))


def sampled_edges(samples: DataFrame, with_seeds: bool = False) -> DataFrame:
    """One row: sampled edges; ``with_seeds`` counts hop 0 as well."""
    return samples.where("hop >= 0" if with_seeds else "hop > 0").agg(F.count("*").alias("sampled_edges"))


def timed(build: Callable[[], DataFrame], step: str = "step") -> dict[str, float]:
    """Run a walk or sample plan: milliseconds, edges, and million edges a second."""
    began = time.perf_counter()
    edges = build().where(F.col(step) > 0).count()
    seconds = time.perf_counter() - began
    return {"ms": 1000 * seconds, "sampled_edges": edges, "mseps": edges / seconds / 1e6}


def combined(parts: DataFrame) -> DataFrame:
    """One row of runs side by side, from rows (ms, sampled_edges): the longest time, all edges, and their rate."""
    return parts.agg(F.max("ms").alias("ms"), F.sum("sampled_edges").alias("sampled_edges")).withColumn(
        "mseps", F.col("sampled_edges") / (F.col("ms") / 1000) / 1e6
    )


def write_metrics(spark, rows: list[dict], path: str) -> None:
    spark.createDataFrame(rows).write.mode("append").option("header", True).csv(path)


def first_walks(walks: DataFrame, n: int = 3) -> DataFrame:
    """The walks of the n least walkers, as printed: walker and nodes without the last."""
    few = walks.select("walker").distinct().orderBy("walker").limit(n)
    paths = walks.join(F.broadcast(few), "walker").groupBy("walker").agg(
        F.array_sort(F.collect_list(F.struct("step", "node"))).alias("p")
    )
    shown = F.transform(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["node"])
    return paths.select("walker", F.array_join(shown.cast("array<string>"), " ").alias("nodes"))


def first_samples(samples: DataFrame, instances: int = 4, slots: int = 30) -> DataFrame:
    """The first levels of the first samples, as printed."""
    return samples.where((F.col("instance") < instances) & (F.col("slot") < slots))


def first_slots(table: DataFrame, n: int = 100) -> DataFrame:
    """The first n slots of an alias table, as printed."""
    return table.select("src", "pos", "prob", "alias_pos").orderBy("src", "pos").limit(n)
