"""k-hop neighbour sampling as a tree of slots.

Rows (instance, hop, parent_slot, slot, node): hop 0 is the seed at slot 0, under parent_slot -1; child i
of a parent has slot parent_slot * fanout + i.  Methods:

uniform            fanout draws with replacement
uniform_least      min(fanout, degree) draws with replacement
uniform_distinct   min(fanout, degree) different edges
take_all           all edges in order where degree <= fanout, else as uniform
alias              all edges in order where degree <= fanout, else weighted draws with
                   replacement from alias tables
alias_draws        fanout weighted draws with replacement from alias tables, whatever the degree
weighted_distinct  all edges where degree <= fanout, else fanout different edges, each
                   next one drawn in proportion to weight

A vertex without edges, or for weighted methods without bias, has no children.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambler.functions.rng import MAX_WALKER, Channel, M, draw
from ambler.operators.alias import build_alias_table
from ambler.operators.graph import Graph
from ambler.operators.packed import blocks, heaviest
from ambler.plans.tables import discard, materialize

#: Edges in a block of a vertex's row.
BLOCK = 1024
SAGE_FANOUTS = (25, 10)
METHODS = ("uniform", "uniform_least", "uniform_distinct", "take_all", "alias", "alias_draws", "weighted_distinct")


def _distinct_slots(walker: Column, hop: int, f: int, seed: int) -> Column:
    """min(f, deg) different slots: for each j of the last f slots, a draw below j + 1, or j if that is taken."""
    deg = F.col("deg")
    n = F.least(F.lit(f).cast("long"), deg)

    def add(chosen: Column, i: Column) -> Column:
        j = deg - n + i
        t = draw(walker * f + i, hop, Channel.SLOT, seed) % (j + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), j).otherwise(t)))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.array().cast("array<bigint>"), add)


def _children(state: DataFrame, edges: DataFrame, method: str, hop: int, f: int, stride: int, seed: int) -> DataFrame:
    """instance, parent_slot, slot, node, deg of the next hop."""
    parent = F.col("instance") * stride + F.col("slot")
    held = state.where("deg > 0")
    if method == "weighted_distinct":
        # Edges that a block's least don't hold are left out before rows are ranked.
        key = draw(parent, F.col("pos"), Channel.KEY + 16 * hop, seed)
        order = F.when(F.col("deg") <= f, F.lit(0.0)).otherwise(-F.log((key + 1) / F.lit(float(M + 1))) / F.col("w"))
        rank = F.row_number().over(Window.partitionBy("instance", "slot").orderBy("order", "pos"))
        number = F.explode(F.sequence(F.lit(0), F.floor((F.col("deg") - 1) / BLOCK).cast("int")))
        rows = held.withColumn("parent", parent).withColumn("block", number).join(edges, ["node", "block"])
        return (
            heaviest(rows, f, BLOCK, Channel.KEY + 16 * hop, seed)
            .withColumn("order", order)
            .withColumn("rank", rank)
            .where(F.col("rank") <= f)
            .select(
                "instance",
                F.col("slot").alias("parent_slot"),
                (F.col("slot") * f + F.col("rank") - 1).alias("slot"),
                F.col("to").alias("node"),
                F.col("to_deg").alias("deg"),
            )
        )
    if method == "uniform_distinct":
        drawn = held.select("*", F.posexplode(_distinct_slots(parent, hop, f, seed)).alias("i", "pos"))
    else:
        drawn = held.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(f - 1).cast("long"))))
        h = draw(parent * f + F.col("i"), hop, Channel.SLOT, seed)
        pos = h % F.col("deg")
        if method in ("uniform_least", "take_all", "alias"):
            drawn = drawn.where((F.col("deg") > f) | (F.col("i") < F.col("deg")))
        if method in ("take_all", "alias"):
            pos = F.when(F.col("deg") <= f, F.col("i")).otherwise(pos)
        drawn = drawn.withColumn("pos", pos)
    moved = drawn.join(edges, ["node", "pos"])
    to, to_deg = F.col("to"), F.col("to_deg")
    if method in ("alias", "alias_draws"):
        whole = (F.col("deg") <= f) if method == "alias" else F.lit(False)
        keep = whole | (draw(parent * f + F.col("i"), hop, Channel.COIN, seed) < F.col("prob") * M)
        to, to_deg = F.when(keep, to).otherwise(F.col("alias_dst")), F.when(keep, to_deg).otherwise(F.col("alias_dst_deg"))
    return moved.select(
        "instance",
        F.col("slot").alias("parent_slot"),
        (F.col("slot") * f + F.col("i")).alias("slot"),
        to.alias("node"),
        to_deg.alias("deg"),
    )


def neighbor_sample(graph: Graph, seeds: DataFrame, fanouts=SAGE_FANOUTS, method: str = "uniform", seed: int = 0) -> DataFrame:
    """The tree of every row of seeds(instance, node)."""
    if method not in METHODS:
        raise ValueError(f"method: {method!r}")
    names = {"src": "node", "dst": "to", "dst_deg": "to_deg"}
    made = []
    if method in ("alias", "alias_draws"):
        made.append(materialize(build_alias_table(graph).where("valid"), "alias"))
        table = made[0]
        edges = table.select("src", "pos", "dst", "dst_deg", "prob", "alias_dst", "alias_dst_deg")
        edges = edges.withColumnsRenamed(names)
    elif method == "weighted_distinct":
        edges = blocks(graph.edges, BLOCK).drop("deg")
        edges = edges.repartition(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), "node", "block").sortWithinPartitions("node", "block").persist()
    else:
        edges = graph.edges.select("src", "pos", "dst", "dst_deg").withColumnsRenamed(names)
    degrees = graph.edges.where("pos = 0").select(F.col("src").alias("node"), F.col("src_deg").alias("deg"))
    state = seeds.join(degrees, "node", "left").select(
        F.col("instance").cast("long").alias("instance"),
        F.lit(-1).cast("long").alias("parent_slot"),
        F.lit(0).cast("long").alias("slot"),
        F.col("node").cast("long").alias("node"),
        F.coalesce("deg", F.lit(0).cast("long")).alias("deg"),
    )
    stride = prod(fanouts)
    limit = MAX_WALKER // max(stride * max(fanouts, default=1), 1)
    told = F.raise_error(F.lit(f"with these fan-outs instances are numbers below {limit}"))
    state = state.withColumn("instance", F.when(F.col("instance").isNull() | (F.col("instance") < limit), F.col("instance")).otherwise(told))
    out = None
    for hop, f in enumerate([None, *fanouts]):
        if f is not None:
            state = materialize(_children(state, edges, method, hop, f, stride, seed), "hop")
        rows = state.select("instance", F.lit(hop).alias("hop"), "parent_slot", "slot", "node")
        out = rows if out is None else out.unionAll(rows)
    if method == "weighted_distinct":
        edges.unpersist()
    discard(*made)
    return out


def sample_lengths(samples: DataFrame) -> DataFrame:
    """Children of every parent that has some."""
    return (
        samples.where("hop > 0")
        .groupBy("instance", "hop", "parent_slot")
        .agg(F.count("*").alias("len"))
    )


def frontier(samples: DataFrame) -> DataFrame:
    """The flat bag (hop, node), without the tree."""
    return samples.select("hop", "node")


def frontier_sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("hop").agg(F.count("*").alias("n"))
