"""Random walks: uniform, weighted and second order, with optional termination.

Rows (walker, step, node): step 0 is the seed, and a walk of length n has n edges.
It ends at a vertex without edges or without bias, with probability ``tp`` before
each move, or after ``depth`` moves.

Two strategies give the same rows.  ``join`` moves all walkers by equi-joins with
the edges and suits any graph; paths are cut every ``segment`` steps, so plans and
rows stay short.  ``local`` sends the whole graph to each worker, only where its
edges number at most ``local_edges``, and walks all steps in one pass.  Both add
weights in the same order (see :func:`row_sums`), so fractional weights agree to the
last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambler.functions.rng import MAX_WALKER, Channel, M, draw, draw_numpy
from ambler.operators.alias import build_alias_table
from ambler.operators.graph import Graph
from ambler.operators.packed import blocks, reduced, unpacked
from ambler.plans.tables import discard, materialize, release

#: Edges of a graph that may be sent to workers by default: five arrays of 8 bytes, 80 MB at most.
LOCAL_EDGES = 2_000_000
#: Edges in a block of cumulative weights.
BLOCK = 1024
#: Edges of a hub for each further copy of its block totals, and most copies.
HEAD_EDGES, HEAD_COPIES = 1 << 16, 64
#: Proposals of a second-order step before the exact draw, and what sets their channels apart.
ATTEMPTS, APART = 8, 16


class StepContext:
    """Columns that a second-order bias may use.

    walker, step, node (where the walker stands), deg, prev (where it came from, null
    at first), state; dst, w and dst_deg of the edge; connected (whether an edge leads
    from prev to dst), which costs a join where it is used.  An update of the state may
    read all but w and connected; dst is then where the walker went.
    """

    def __init__(self, step: int):
        self.step = F.lit(step)
        self.dst, self.w, self.dst_deg = F.col("to"), F.col("w"), F.col("to_deg")
        self.asks_connected = False
        #: Columns of the walker that were asked for.
        self.read = set()

    def __getattr__(self, name: str) -> Column:
        if name not in ("walker", "node", "deg", "prev", "state"):
            raise AttributeError(name)
        self.read.add(name)
        return F.col(name)

    @property
    def connected(self) -> Column:
        self.asks_connected = True
        return F.col("connected")


@dataclass(frozen=True)
class WalkSpec:
    """What to walk.

    bias: uniform; weight or degree (by ``w`` or the destination's out-degree); any
    column expression of the edges; node2vec (``w`` with p and q) or node2vec_floor
    (two shares for going back, one for any other edge); or a function from
    :class:`StepContext` to a column, for second-order biases of one's own.
    table: draw from precomputed alias tables instead of cumulative weights.
    reject: node2vec by rejection.  Proposals are uniform, weights being ignored, or
    with ``table`` drawn by weight; after ATTEMPTS refusals the draw is made exactly.
    update: the walker's next ``state`` after a move, for biases that read it; null before.
    """

    depth: int
    bias: str | Column | Callable[[StepContext], Column] = "uniform"
    table: bool = False
    tp: float = 0.0
    p: float = 2.0
    q: float = 0.5
    seed: int = 0
    reject: bool = False
    update: Callable[[StepContext], Column] | None = None

    @property
    def shares(self) -> tuple[float, float, float]:
        """Factors of going back, to a common neighbour, and elsewhere."""
        return (2.0, 1.0, 1.0) if self.bias == "node2vec_floor" else (1 / self.p, 1.0, 1 / self.q)


#: Presets of the four applications.
def deepwalk(depth: int = 100, **options) -> WalkSpec:
    return WalkSpec(depth, **options)


def ppr(depth: int = 100, tp: float = 0.15, **options) -> WalkSpec:
    return WalkSpec(depth, tp=tp, **options)


def node2vec(depth: int = 100, p: float = 2.0, q: float = 0.5, **options) -> WalkSpec:
    return WalkSpec(depth, bias="node2vec", p=p, q=q, **options)


def first_vertices(graph: Graph, n: int) -> DataFrame:
    """Seeds 0 to n - 1: walker k starts at vertex k."""
    return graph.spark.range(n).select(F.col("id").alias("walker"), F.col("id").alias("node"))


def all_vertices(graph: Graph) -> DataFrame:
    """One seed for every vertex."""
    return graph.ids.select(F.col("id").alias("walker"), F.col("id").alias("node"))


def random_walk(
    graph: Graph, seeds: DataFrame, spec: WalkSpec, strategy: str = "auto", segment: int = 10, local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """walker, step, node of one walk for each row of seeds(walker, node); walkers are different numbers below MAX_WALKER."""
    numbered = F.when(F.col("walker") < MAX_WALKER, F.col("walker")).otherwise(F.raise_error(F.lit(f"walkers are numbers below {MAX_WALKER}")))
    seeds = seeds.withColumn("walker", F.when(F.col("walker").isNotNull(), numbered))
    if isinstance(spec.bias, Column) or spec.bias == "degree":
        column = F.col("dst_deg") if isinstance(spec.bias, str) else spec.bias
        graph = Graph(graph.edges.withColumn("w", column.cast("double")))
        spec = replace(spec, bias="weight")
    if not callable(spec.bias) and spec.bias not in ("uniform", "weight", "node2vec", "node2vec_floor"):
        raise ValueError(f"bias: {spec.bias!r}")
    if spec.reject and not spec.table or spec.bias == "node2vec_floor":
        graph = graph.with_weights("unit")
    if strategy == "auto":
        strategy = "local" if not callable(spec.bias) and graph.edges.count() <= local_edges else "join"
    if strategy == "local" and not callable(spec.bias):
        return _local_walk(graph, seeds, spec)
    if strategy != "join":
        raise ValueError(f"strategy: {strategy!r}, bias: {spec.bias!r}")
    return _join_walk(graph, seeds, spec, segment)


def lengths(walks: DataFrame) -> DataFrame:
    """walker, length: the edges each walk went along."""
    return walks.groupBy("walker").agg(F.max("step").cast("int").alias("length"))


# --- steps as joins ---------------------------------------------------------


class _Steps:
    """One step of all walkers as a plan: adds ``to`` and ``to_deg`` to rows of walkers.

    Walkers that stand still carry keys that no edge has, different ones, so that they
    are spread over tasks.  What all steps read is spread by its keys and kept until
    :meth:`close`; it comes from written tables, which a lost executor does not cost.
    """

    def __init__(self, graph: Graph, spec: WalkSpec):
        self.graph, self.spec, self.made, self.kept = graph, spec, [], []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(materialize(df, name))
        return self.made[-1]

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # In the order of a merge join too, so that no step sorts it again.
        self.kept.append(df.repartition(n, *keys).sortWithinPartitions(*keys).persist())
        return self.kept[-1]

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()
        discard(*self.made)

    def draw(self, t: int, channel: int) -> Column:
        return draw(F.col("walker"), t, channel, self.spec.seed)

    @staticmethod
    def keyed(state: DataFrame, moving: Column | None = None) -> DataFrame:
        moving = F.col("alive") if moving is None else moving
        return state.withColumn("node", F.when(moving, F.col("node")).otherwise(-1 - F.col("walker")))

    def step(self, state: DataFrame, t: int) -> DataFrame:
        raise NotImplementedError


class _Uniform(_Steps):
    def __init__(self, graph: Graph, spec: WalkSpec):
        super().__init__(graph, spec)
        self.edges = graph.edges.select(F.col("src").alias("node"), "pos", F.col("dst").alias("to"), F.col("dst_deg").alias("to_deg"))

    def slot(self, t: int, channel: int = Channel.SLOT) -> Column:
        return F.when(F.col("alive"), self.draw(t, channel) % F.col("deg")).otherwise(F.lit(-1).cast("long"))

    def step(self, state: DataFrame, t: int) -> DataFrame:
        return self.keyed(state.withColumn("pos", self.slot(t))).join(self.edges, ["node", "pos"], "left")


class _Alias(_Uniform):
    def __init__(self, graph: Graph, spec: WalkSpec):
        super().__init__(graph, spec)
        table = self.written(build_alias_table(graph).where("valid"), "alias")
        table = table.select(
            F.col("src").alias("node"), "pos", "prob", F.col("dst").alias("kept"), F.col("dst_deg").alias("kept_deg"), "alias_dst", "alias_dst_deg"
        )
        self.table = self.spread(table, "node", "pos")

    def step(self, state: DataFrame, t: int) -> DataFrame:
        moved = self.keyed(state.withColumn("pos", self.slot(t))).join(self.table, ["node", "pos"], "left")
        return self.chosen(moved, self.draw(t, Channel.COIN))

    @staticmethod
    def chosen(moved: DataFrame, coin: Column) -> DataFrame:
        keep = coin < F.col("prob") * M
        return (
            moved.withColumn("to", F.when(keep, F.col("kept")).otherwise(F.col("alias_dst")))
            .withColumn("to_deg", F.when(keep, F.col("kept_deg")).otherwise(F.col("alias_dst_deg")))
            .drop("kept", "kept_deg", "alias_dst", "alias_dst_deg", "prob")
        )


class _Weight(_Steps):
    """Cumulative weights in two levels, so that a hub's row is many short arrays.

    A row's edges are summed inside blocks of BLOCK edges; a block begins where the
    totals of the earlier ones end.  A hub's list of block totals has a copy for every
    HEAD_EDGES of its edges, and its walkers are dealt to the copies.
    """

    def __init__(self, graph: Graph, spec: WalkSpec):
        super().__init__(graph, spec)
        placed = graph.edges.select(F.col("src").alias("node"), "pos", "w", "dst", "dst_deg", F.floor(F.col("pos") / BLOCK).cast("int").alias("block"))
        inside = Window.partitionBy("node", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        blocks = (
            placed.withColumn("cum", F.sum("w").over(inside))
            .groupBy("node", "block")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "cum", "dst", "dst_deg"))).alias("part"))
        )
        blocks = self.written(blocks, "weights")
        totals = self.written(blocks.select("node", "block", F.element_at("part", -1)["cum"].alias("sum")), "weight-totals")
        earlier = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ends = totals.withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)))
        heads = (
            ends.groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("block", (F.col("base") + F.col("sum")).alias("cum"), "base"))).alias("ends"))
            .withColumn("total", F.element_at("ends", -1)["cum"])
            .where("total > 0")
        )
        copies = self.copies((F.size("ends") * BLOCK).cast("long"))
        heads = heads.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
        self.blocks = self.spread(blocks, "node", "block")
        self.heads = self.spread(heads, "node", "copy")

    @staticmethod
    def copies(deg: Column) -> Column:
        return F.least(F.floor(deg / HEAD_EDGES) + 1, F.lit(HEAD_COPIES).cast("long"))

    def step(self, state: DataFrame, t: int) -> DataFrame:
        # A hub's degree rounded up to whole blocks, as its copies are counted.
        edges = F.ceil(F.col("deg") / BLOCK) * BLOCK
        copy = F.when(F.col("alive"), F.pmod(F.col("walker"), self.copies(edges))).otherwise(F.lit(-1).cast("long"))
        # The draw is made below the join, once, and not for every sum that it is held against.
        at = self.keyed(state.withColumn("copy", copy).withColumn("h", self.draw(t, Channel.SLOT))).join(self.heads, ["node", "copy"], "left")
        at = at.withColumn("goal", F.col("h") * F.col("total"))
        at = at.withColumn("block", _passed(F.col("ends"), lambda e: e["cum"], F.col("goal")))
        at = at.withColumn("base", F.get("ends", F.col("block"))["base"]).withColumn("block", F.coalesce("block", F.lit(-1))).drop("ends")
        moved = at.join(self.blocks, ["node", "block"], "left")
        moved = moved.withColumn("at", _passed(F.col("part"), lambda e: F.col("base") + e["cum"], F.col("goal")))
        chosen = F.get("part", F.col("at"))
        return moved.withColumn("to", chosen["dst"]).withColumn("to_deg", chosen["dst_deg"]).drop("part", "total", "goal", "h", "base", "at")


def _passed(ends: Column, cum: Callable[[Column], Column], goal: Column) -> Column:
    """How many of the running sums a draw has passed; null without sums."""
    return F.when(ends.isNotNull(), F.size(F.filter(ends, lambda e: cum(e) * M <= goal)))


class _SecondOrder(_Steps):
    """Biases that read where the walker came from: every edge of its vertex is a row.

    Those rows are unpacked from a block, judged and reduced inside a task (see
    :mod:`ambler.operators.packed`) where the walker's vertex and the one before have BLOCK
    edges at most.  Where a graph has larger vertices, a step's walkers are written, and those
    on or from such a vertex are joined with its edges by (vertex, slot), so a hub's lie in many
    tasks, and where the bias asks for it with the edges from the vertex before; a window over
    the walker adds the biases up.  With ``reject``, ATTEMPTS proposals a walker come first, and
    only walkers whose proposals were all refused go on to that.
    """

    def __init__(self, graph: Graph, spec: WalkSpec):
        super().__init__(graph, spec)
        # Proposals from alias tables are joins by slot in any case.
        self.proposals = _Alias(graph, spec) if spec.reject and spec.table else None
        self.packed, e, linked = None, graph.edges, graph.edges
        if self.proposals is None:
            release(graph.spark)
            written = self.written(blocks(e, BLOCK), "blocks")
            release(graph.spark)
            self.packed = self.spread(written, "node", "block")
            if not self.packed.where("block > 0").take(1):
                return
            large, lead = F.col("src_deg") > BLOCK, F.col("dst_deg") > BLOCK
            after, before = (graph.edges.where(held).select(F.col(c).alias("src")).distinct() for held, c in ((large, "dst"), (lead, "src")))
            e, linked = (graph.edges.where(large).unionAll(graph.edges.where(~large).join(near, "src", "left_semi").select(*graph.edges.columns)) for near in (after, before))
        self.edges = self.spread(e.select(F.col("src").alias("node"), "pos", F.col("dst").alias("to"), F.col("dst_deg").alias("to_deg"), "w"), "node", "pos")
        pairs = linked.select(F.col("src").alias("prev"), F.col("dst").alias("to")).distinct().withColumn("connected", F.lit(True))
        self.pairs = self.spread(pairs, "prev", "to")

    def close(self) -> None:
        super().close()
        if self.proposals is not None:
            self.proposals.close()

    def bias(self, context: StepContext) -> Column:
        if callable(self.spec.bias):
            return self.spec.bias(context)
        return F.when(context.prev.isNull(), context.w).otherwise(context.w * self.share(context))

    def share(self, context: StepContext) -> Column:
        back, common, far = self.spec.shares
        other = F.lit(far) if common == far else F.when(context.connected, common).otherwise(far)
        return F.when(context.prev == context.dst, back).otherwise(other)

    def connected(self, rows: DataFrame, context: StepContext) -> DataFrame:
        """``rows`` with the flag, if the bias made with ``context`` asks for it."""
        if not context.asks_connected:
            return rows
        # A first step has no vertex before: keys that no edge has, different ones.
        key = F.coalesce("prev", -1 - F.col("walker"))
        held = rows.withColumn("came", F.col("prev")).withColumn("prev", key).join(self.pairs, ["prev", "to"], "left")
        return held.withColumn("prev", F.col("came")).drop("came").withColumn("connected", F.coalesce("connected", F.lit(False)))

    def proposed(self, state: DataFrame, t: int) -> DataFrame:
        """``state`` with the first accepted proposal in ``chosen``."""
        spec, context = self.spec, StepContext(t)
        h = lambda channel: draw(F.col("walker"), t, channel, spec.seed)
        tries = F.when(F.col("alive"), F.sequence(F.lit(0).cast("long"), F.lit(ATTEMPTS - 1).cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))
        rows = state.withColumn("node_", F.col("node")).withColumn("k", F.explode(tries))
        number = APART * F.col("k")
        rows = rows.withColumn("pos", F.when(F.col("alive"), h(Channel.SLOT + number) % F.col("deg")).otherwise(F.lit(-1).cast("long")))
        rows = self.keyed(rows.withColumn("y", h(Channel.ACCEPT + number)).withColumn("coin", h(Channel.COIN + number)))
        if self.proposals is None:
            rows = rows.join(self.edges, ["node", "pos"], "left")
        else:
            rows = _Alias.chosen(rows.join(self.proposals.table, ["node", "pos"], "left"), F.col("coin"))
        share, most = self.share(context), max(spec.shares)
        rows = self.connected(rows.withColumn("node", F.col("node_")), context)
        accepted = self.accepted(F.col("y"), share, most)
        return rows.groupBy("walker").agg(
            *[F.first(c).alias(c) for c in state.columns if c != "walker"],
            F.min(F.when(accepted, F.struct("k", "to", "to_deg"))).alias("chosen"),
        )

    @staticmethod
    def accepted(y: Column, share: Column, most: float) -> Column:
        return F.col("to").isNotNull() & (F.col("prev").isNull() | (y * most < share * M))

    def step(self, state: DataFrame, t: int) -> DataFrame:
        if self.packed is None:
            return self.joined(state, t)
        if not hasattr(self, "edges"):
            return self.unpacked(state, t)
        state = self.written(state, "step")
        # Degrees are null where a walk has ended or begins.
        far = F.greatest(F.coalesce("deg", F.lit(0)), F.coalesce("prev_deg", F.lit(0))) > BLOCK
        return self.unpacked(state.where(~far), t).unionByName(self.joined(state.where(far), t))

    def with_blocks(self, rows: DataFrame, moving: Column, asks: bool) -> DataFrame:
        """``rows`` with the block of the vertex where a walker moves, and if ``asks`` that of the vertex before."""
        first = self.packed.where("block = 0")
        if asks:
            near = first.select(F.col("node").alias("came"), F.col("block").alias("part"), F.col("blob").alias("near"))
            rows = rows.withColumn("came", F.coalesce(F.when(moving, F.col("prev")), -1 - F.col("walker"))).withColumn("part", F.lit(0))
            rows = rows.join(near, ["came", "part"], "left").drop("came", "part")
        at = first.select(F.col("node").alias("stands"), F.col("block").alias("part"), "blob")
        rows = rows.withColumn("stands", F.when(moving, F.col("node")).otherwise(-1 - F.col("walker"))).withColumn("part", F.lit(0))
        return rows.join(at, ["stands", "part"], "left").drop("stands", "part")

    def unpacked(self, state: DataFrame, t: int) -> DataFrame:
        spec, moving = self.spec, F.col("alive")
        if spec.reject:
            context = StepContext(t)
            share, most = self.share(context), max(spec.shares)
            rows = unpacked(self.with_blocks(state, moving, context.asks_connected and t > 0), sorted({*context.read, "walker", "prev"}), (ATTEMPTS, t, APART, spec.seed))
            # pos numbers the proposals; rows without a block are not accepted.
            y = draw(F.col("walker"), t, Channel.ACCEPT * F.lit(1).cast("long") + APART * F.greatest("pos", F.lit(0).cast("long")), spec.seed)
            rows = rows.withColumn("accepted", self.accepted(y, share, most))
            state = reduced(rows, state, "chosen")
            moving &= F.col("chosen").isNull()
        context = StepContext(t)
        bias = self.bias(context)
        rows = unpacked(self.with_blocks(state, moving, context.asks_connected and t > 0), sorted(context.read))
        rows = rows.withColumn("b", F.when(F.col("to").isNotNull(), bias.cast("double")))
        channel = Channel.SLOT + (APART * ATTEMPTS if spec.reject else 0)
        found = reduced(rows, state, "to", (t, channel, spec.seed))
        if spec.reject:
            found = found.withColumn("to", F.coalesce("chosen", "to")).withColumn("to_deg", F.coalesce("chosen_deg", "to_deg")).drop("chosen", "chosen_deg")
        return found

    def joined(self, state: DataFrame, t: int) -> DataFrame:
        """A step by (vertex, slot)."""
        if self.spec.reject:
            state = self.proposed(state, t)
            ready = F.col("chosen").isNotNull() | ~F.col("alive")
        else:
            ready = ~F.col("alive")
        # One row a walker that is settled, else one for each of its vertex's edges.
        none = F.array(F.lit(-1).cast("long"))
        rows = state.withColumn("node_", F.col("node")).withColumn("pos", F.explode(F.when(ready, none).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest("deg", F.lit(1)) - 1))))
        h = self.draw(t, Channel.SLOT + (APART * ATTEMPTS if self.spec.reject else 0))
        rows = self.keyed(rows.withColumn("h", h), F.col("pos") >= 0).join(self.edges, ["node", "pos"], "left")
        rows = rows.withColumn("node", F.col("node_")).drop("node_")
        context = StepContext(t)
        bias = self.bias(context)
        rows = self.connected(rows, context).withColumn("b", F.when(F.col("to").isNotNull(), bias.cast("double")))
        walker = Window.partitionBy("walker")
        rows = rows.withColumn("cum", F.sum("b").over(walker.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("total", F.max("cum").over(walker)).withColumn("goal", F.col("h") * F.col("total"))
        first = F.min(F.when((F.col("total") > 0) & (F.col("cum") * M > F.col("goal")), F.struct("pos", "to", "to_deg")))
        found = rows.groupBy("walker").agg(*[F.first(c).alias(c) for c in state.columns if c != "walker"], first.alias("drawn"))
        if self.spec.reject:
            pick = lambda c: F.coalesce(F.col(f"chosen.{c}"), F.col(f"drawn.{c}"))
        else:
            pick = lambda c: F.col(f"drawn.{c}")
        return found.withColumn("to", pick("to")).withColumn("to_deg", pick("to_deg")).drop("drawn", "chosen")


def _stepper(graph: Graph, spec: WalkSpec) -> _Steps:
    if callable(spec.bias) or spec.bias.startswith("node2vec"):
        return _SecondOrder(graph, spec)
    if spec.bias == "uniform":
        return _Uniform(graph, spec)
    return _Alias(graph, spec) if spec.table else _Weight(graph, spec)


def _join_walk(graph: Graph, seeds: DataFrame, spec: WalkSpec, segment: int) -> DataFrame:
    steps = _stepper(graph, spec)
    degrees = graph.edges.where("pos = 0").select(F.col("src").alias("node"), F.col("src_deg").alias("deg"))
    nothing = F.array().cast("array<bigint>")
    state = seeds.join(degrees, "node", "left").select(
        F.col("walker").cast("long").alias("walker"),
        F.col("node").cast("long").alias("node"),
        F.coalesce("deg", F.lit(0).cast("long")).alias("deg"),
        F.lit(None).cast("long").alias("prev"),
    )
    found = [state.select("walker", F.lit(0).alias("step"), "node")]
    state = state.withColumn("state", F.lit(None).cast("long")).withColumn("prev_deg", F.lit(None).cast("long"))
    for first in range(0, spec.depth, segment):
        last = min(first + segment, spec.depth)
        state = state.withColumn("path", nothing)
        for t in range(first, last):
            alive = F.coalesce(F.col("deg") > 0, F.lit(False))
            if spec.tp > 0:
                alive &= draw(F.col("walker"), t, Channel.STOP, spec.seed) >= F.lit(spec.tp * M)
            moved = steps.step(state.withColumn("alive", alive).withColumn("from", F.col("node")), t).withColumn("node", F.col("from"))
            went = F.col("to").isNotNull()
            after = spec.update(StepContext(t)).cast("long") if spec.update is not None else F.col("state")
            state = moved.select(
                "walker",
                F.col("to").alias("node"),
                F.col("to_deg").alias("deg"),
                F.when(went, F.col("from")).alias("prev"),
                F.when(went, F.col("deg")).alias("prev_deg"),
                F.when(went, after).alias("state"),
                F.when(went, F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"),
            )
        done = materialize(state, "walks")
        found.append(
            done.select("walker", F.posexplode("path").alias("i", "node")).select(
                "walker", (F.col("i") + first + 1).cast("int").alias("step"), "node"
            )
        )
        state = done.where("node is not null").drop("path")
    steps.close()
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out


# --- whole walks in one pass ------------------------------------------------


def row_sums(w: np.ndarray, first: np.ndarray, block: int | None = None) -> np.ndarray:
    """Running sums of each row ``w[first[i]:first[i + 1]]``, added one after the other.

    With ``block``, sums run inside blocks of that many edges, and a block begins where the
    totals of the earlier ones end, added in their order.  No row's sums depend on another's.
    """
    cum = np.array(w, np.float64)
    sizes = np.diff(first)
    for a, n in zip(first[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        if block is None or n <= block:
            np.cumsum(w[a : a + n], out=cum[a : a + n])
            continue
        base = 0.0
        for b in range(a, a + n, block):
            inside = np.cumsum(w[b : min(b + block, a + n)])
            cum[b : b + len(inside)] = base + inside
            base = base + inside[-1]
    return cum


@dataclass
class Csr:
    """A graph in arrays; rows sorted by destination."""

    first: np.ndarray
    dst: np.ndarray
    w: np.ndarray
    prob: np.ndarray | None = None
    alias: np.ndarray | None = None

    @cached_property
    def keys(self) -> np.ndarray:
        """Edges as ascending numbers, to look one up; made once in a worker."""
        n = len(self.first) - 1
        return np.repeat(np.arange(n), np.diff(self.first)) * n + self.dst

    @cached_property
    def cum(self) -> np.ndarray:
        """Running weight inside each row."""
        return row_sums(self.w, self.first, BLOCK)

    @cached_property
    def total(self) -> np.ndarray:
        """Weight of each row."""
        total = np.zeros(len(self.first) - 1)
        has = np.diff(self.first) > 0
        total[has] = self.cum[self.first[1:][has] - 1]
        return total

    @classmethod
    def collect(cls, graph: Graph, table: bool) -> Csr:
        """All edges on the driver; only for graphs within the bound of edges."""
        if table:
            edges = build_alias_table(graph).select("src", "pos", "dst", "w", "prob", "alias_pos")
        else:
            edges = graph.edges.select("src", "pos", "dst", "w")
        rows = edges.toArrow()
        src, pos = rows.column("src").to_numpy(), rows.column("pos").to_numpy()
        order = np.lexsort((pos, src))
        take = lambda c: rows.column(c).to_numpy()[order]
        dst = take("dst")
        n = int(max(src.max(initial=-1), dst.max(initial=-1))) + 1
        first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        return cls(first, dst, take("w"), take("prob") if table else None, take("alias_pos") if table else None)


def _step_local(g: Csr, spec: WalkSpec, walker, node, prev, t):
    """Next node of each walker, -1 where the walk ends."""
    n = len(g.first) - 1
    inside = (node >= 0) & (node < n)
    deg = np.where(inside, g.first[np.minimum(np.maximum(node, 0), n - 1) + 1] - g.first[np.minimum(np.maximum(node, 0), n - 1)], 0) if n else np.zeros(len(node), np.int64)
    alive = deg > 0
    if spec.tp > 0:
        alive &= draw_numpy(walker, t, Channel.STOP, spec.seed) >= spec.tp * M
    to = np.full(len(node), -1, np.int64)
    at = np.flatnonzero(alive)
    if not len(at):
        return to
    h, begin, count = draw_numpy(walker[at], t, Channel.SLOT, spec.seed), g.first[node[at]], deg[at]
    if spec.bias == "uniform":
        to[at] = g.dst[begin + h % count]
        return to
    if g.prob is not None and spec.bias == "weight":
        slot = begin + h % count
        keep = draw_numpy(walker[at], t, Channel.COIN, spec.seed) < g.prob[slot] * M
        moved = g.dst[np.where(keep, slot, begin + g.alias[slot])]
        has = g.total[node[at]] > 0
        to[at[has]] = moved[has]
        return to
    if spec.bias == "weight":
        total = g.total[node[at]]
        lo, hi = begin.copy(), begin + count
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(g.dst) - 1)
            past = g.cum[mid] * M > h * total
            hi = np.where(open_ & past, mid, hi)
            lo = np.where(open_ & ~past, mid + 1, lo)
        has = total > 0
        to[at[has]] = g.dst[lo[has]]
        return to
    if not spec.reject:
        to[at] = _second_order(g, spec, node[at], prev[at], h)
        return to
    open_, most = np.ones(len(at), bool), max(spec.shares)
    for k in range(ATTEMPTS):
        w = np.flatnonzero(open_)
        if not len(w):
            break
        drawn = lambda channel: draw_numpy(walker[at[w]], t, channel + APART * k, spec.seed)  # noqa: E731, B023
        slot = begin[w] + drawn(Channel.SLOT) % count[w]
        proposal, valid = g.dst[slot], np.ones(len(w), bool)
        if g.prob is not None:
            keep = drawn(Channel.COIN) < g.prob[slot] * M
            proposal, valid = g.dst[np.where(keep, slot, begin[w] + g.alias[slot])], g.total[node[at[w]]] > 0
        last = prev[at[w]]
        fits = valid & ((last < 0) | (drawn(Channel.ACCEPT) * most < _shares(g, spec, last, proposal) * M))
        to[at[w[fits]]] = proposal[fits]
        open_[w[fits]] = False
    left = at[open_]
    if len(left):
        h = draw_numpy(walker[left], t, Channel.SLOT + APART * ATTEMPTS, spec.seed)
        to[left] = _second_order(g, spec, node[left], prev[left], h)
    return to


def _shares(g: Csr, spec: WalkSpec, last: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Factor of each move to ``dst`` of a walker that came from ``last``."""
    back, common, far = spec.shares
    other = np.full(len(dst), far) if common == far else np.where(_connected(g, last, dst), common, far)
    return np.where(dst == last, back, other)


def _second_order(g: Csr, spec: WalkSpec, node: np.ndarray, last: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Next node of walkers on vertices with edges, by the biases of all edges of their rows, end to end."""
    begin, count = g.first[node], g.first[node + 1] - g.first[node]
    ends = np.cumsum(count)
    edge = np.repeat(begin - (ends - count), count) + np.arange(ends[-1])
    owner = np.repeat(np.arange(len(node)), count)
    came, w = last[owner], g.w[edge]
    bias = np.where(came < 0, w, w * _shares(g, spec, came, g.dst[edge]))
    cum = row_sums(bias, np.concatenate([[0], ends]))
    total = np.maximum.reduceat(cum, ends - count)
    passed = np.add.reduceat((cum * M <= (h * total)[owner]).astype(np.int64), ends - count)
    has = total > 0
    to = np.full(len(node), -1, np.int64)
    to[has] = g.dst[begin[has] + passed[has]]
    return to


def _connected(g: Csr, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(g.first) - 1
    wanted = np.where(a >= 0, a * n + b, -1)
    at = np.minimum(np.searchsorted(g.keys, wanted), len(g.keys) - 1)
    return g.keys[at] == wanted


def _local_walk(graph: Graph, seeds: DataFrame, spec: WalkSpec) -> DataFrame:
    shipped = graph.spark.sparkContext.broadcast(Csr.collect(graph, spec.table and (spec.bias == "weight" or spec.reject)))

    def run(batches):
        g = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                walker, node = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("walker", "node"))
                path = np.full((len(walker), spec.depth + 1), -1, np.int64)
                path[:, 0] = node
                prev = np.full(len(walker), -1, np.int64)
                for t in range(spec.depth):
                    moved = _step_local(g, spec, walker, node, prev, t)
                    prev, node = np.where(moved >= 0, node, -1), moved
                    path[:, t + 1] = moved
                    if not (moved >= 0).any():
                        break
                held = path >= 0
                held[:, 0] = True
                counts = held.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(walker),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(path[held])),
                    ],
                    ["walker", "path"],
                )

    paths = seeds.select(F.col("walker").cast("long").alias("walker"), F.col("node").cast("long").alias("node")).mapInArrow(
        run, "walker long, path array<long>"
    )
    return paths.select("walker", F.posexplode("path").alias("step", "node"))
