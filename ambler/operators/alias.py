"""Alias tables: weighted draws in constant time.

Slot i of a row with biases b has prob b_i n / sum(b), and excess over 1 fills
other slots: a draw takes a uniform slot c and keeps it with prob[c], else takes
alias[c].  Rows are packed arrays and paired off in Arrow batches; a row with no
bias has no table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambler.operators.graph import Graph


def alias_row(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """prob and alias of one row, by pairing slots below the mean with slots above it."""
    n = len(weights)
    prob = weights * (n / weights.sum())
    alias = np.arange(n)
    small, large = np.flatnonzero(prob < 1).tolist(), np.flatnonzero(prob > 1).tolist()
    level = prob.tolist()
    while small and large:
        s, big = small.pop(), large[-1]
        alias[s] = big
        level[big] -= 1 - level[s]
        if level[big] < 1:
            small.append(large.pop())
        elif level[big] == 1:
            large.pop()
    out = np.minimum(np.array(level), 1.0)
    # What rounding leaves unpaired is a full slot.
    out[small + large] = 1.0
    return out, alias


def _tables(batches):
    for batch in batches:
        probs, slots = [], []
        for weights in batch.column("ws"):
            w = weights.values.to_numpy(zero_copy_only=False)
            if w.sum() > 0:
                prob, alias = alias_row(w)
            else:
                prob, alias = np.zeros(len(w)), np.arange(len(w))
            probs.append(prob)
            slots.append(alias)
        rest = [c for c in batch.schema.names if c != "ws"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in rest], batch.column("ws"), pa.array(probs, pa.list_(pa.float64())), pa.array(slots, pa.list_(pa.int64()))],
            names=[*rest, "ws", "probs", "aliases"],
        )


def build_alias_table(graph: Graph, bias: Column | None = None) -> DataFrame:
    """Edges with prob, alias_pos, alias_dst, alias_dst_deg and valid, for ``w`` or another bias column."""
    edges = graph.edges if bias is None else graph.edges.withColumn("w", bias.cast("double"))
    packed = Graph(edges).packed()
    tables = packed.mapInArrow(
        _tables,
        "src long, dsts array<long>, dst_degs array<long>, ws array<double>, probs array<double>, aliases array<long>",
    )
    return tables.select(
        "src",
        F.size("dsts").cast("long").alias("src_deg"),
        (F.aggregate("ws", F.lit(0.0), lambda a, w: a + w) > 0).alias("valid"),
        F.posexplode(
            F.transform(
                F.arrays_zip("dsts", "dst_degs", "ws", "probs", "aliases"),
                lambda z: F.struct(
                    z["dsts"].alias("dst"),
                    z["ws"].alias("w"),
                    z["dst_degs"].alias("dst_deg"),
                    z["probs"].alias("prob"),
                    z["aliases"].alias("alias_pos"),
                    F.get("dsts", z["aliases"].cast("int")).alias("alias_dst"),
                    F.get("dst_degs", z["aliases"].cast("int")).alias("alias_dst_deg"),
                ),
            )
        ).alias("pos", "e"),
    ).select("src", F.col("pos").cast("long").alias("pos"), "src_deg", "valid", "e.*")


def reconstruct(table: DataFrame) -> DataFrame:
    """src, pos, p: the probability with which the table draws each slot."""
    kept = table.where("valid").select("src", "pos", (F.col("prob") / F.col("src_deg")).alias("p"))
    given = table.where("valid and prob < 1").select(
        "src", F.col("alias_pos").alias("pos"), ((1 - F.col("prob")) / F.col("src_deg")).alias("p")
    )
    return kept.unionAll(given).groupBy("src", "pos").agg(F.sum("p").alias("p"))
