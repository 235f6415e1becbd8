"""Exact top-k by inner product with dual-tree search over cover trees.

Vectors are integers.  Every task of the scan packs its rows into blocks of at
most ``BLOCK`` vectors, so no key decides a block's size.  Data blocks are dealt to
places, ``PLACE_BLOCKS`` to one where there are many, and every query block goes to
every place once (the stated query set against all rows, in blocks); a task builds a
data block's cover tree once and searches it with the query blocks' trees.  The kth
score that a query block's queries reached in earlier blocks of a task prunes later ones.

A cover tree node has a centre, a covering radius, and children whose centres are
a net at 1 / ``BASE`` of that radius, so each child's radius is at most that.  A node
whose net would have more children than fill leaves stays a leaf.  For a query node (centre p, radius P) and a data node
(centre c, radius C) no score exceeds p.c + P |c| + C |p| + P C.  A pair of nodes
is pruned where this is below the worst kth score of the query node's queries.
Pairs are taken best bound first, and leaves are scored as one matrix product.

Edge cases: null vectors and those with a null or non-finite component take no
part, as queries or candidates; vectors of unlike length are compared as if padded
with zeros; ties go to the smaller vec_id; a query with fewer candidates than k
returns all; rows with the query's own vec_id are no candidates; a query id that is
repeated answers once, with its least vector (component by component); components and
scores beyond 64 bits count as the largest or least 64-bit number; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambler.llm.common import in_arrow, materialize, table

BLOCK = 4096
QUERY_BLOCK = 512
LEAF = 128
#: Quotient of the radii of neighbouring levels.
BASE = 1.3
#: Data blocks that share a place, and query blocks whose scores a task remembers.
PLACE_BLOCKS = 64
REMEMBERED = 4096
K = 5
QUERY_STEP = 50
SCALE = 256
#: Components up to here make scores of 64 components exact in a double.
_EXACT = 1 << 22
_LEAST = -(2**63)


class CoverTree:
    """Cover tree of a block; node i covers ``order[begin[i]:end[i]]``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        n = len(points)
        self.order = np.arange(n)
        self.centre, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        root = self._node(0, n, 0)
        stack = [root]
        while stack:
            node = stack.pop()
            if self.end[node] - self.begin[node] <= leaf or self.radius[node] == 0:
                continue
            kids = self._split(node, leaf)
            if kids:
                self.children[node] = kids
                stack.extend(kids)
        self.centres = points[self.centre]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.radius = np.array(self.radius)

    def _node(self, begin: int, end: int, centre: int) -> int:
        members = self.points[self.order[begin:end]]
        far = np.sqrt(((members - self.points[centre]) ** 2).sum(axis=1).max())
        for held, x in ((self.centre, centre), (self.radius, float(far) * (1 + 1e-9)), (self.begin, begin), (self.end, end), (self.children, None)):
            held.append(x)
        return len(self.centre) - 1

    def _split(self, node: int, leaf: int) -> list[int]:
        """Children: a net of farthest points at the next level's radius; none if it is too fine to fill leaves."""
        begin, end = self.begin[node], self.end[node]
        own = self.order[begin:end]
        members = self.points[own]
        most = max(2, -(-len(own) // leaf) * 2)
        centres = [self.centre[node]]
        away = ((members - self.points[centres[0]]) ** 2).sum(axis=1)
        nearest = np.zeros(len(own), np.int64)
        net = (self.radius[node] / BASE) ** 2
        while True:
            far = int(away.argmax())
            if away[far] <= net and len(centres) > 1:
                break
            if len(centres) == most:
                return []
            centres.append(int(own[far]))
            d = ((members - members[far]) ** 2).sum(axis=1)
            closer = d < away
            away[closer], nearest[closer] = d[closer], len(centres) - 1
        sort = np.argsort(nearest, kind="stable")
        self.order[begin:end] = own[sort]
        counts = np.bincount(nearest, minlength=len(centres))
        ends = begin + np.cumsum(counts)
        return [self._node(int(e - c), int(e), centre) for e, c, centre in zip(ends, counts, centres, strict=True) if c]


def dual_search(queries: CoverTree, data: CoverTree, query_ids: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per query row the best k (score, position in data) under (score desc, id asc); -1 where there are fewer.

    ``floor``: scores below it, known to be beaten k times elsewhere, are not wanted.
    """
    n = len(query_ids)
    floor = np.full(n, -np.inf) if floor is None else floor
    best = np.full((n, k), -np.inf)
    which = np.full((n, k), -1, np.int64)
    ids = np.full((n, k), np.iinfo(np.int64).max)

    def bound(q: int, d: np.ndarray) -> np.ndarray:
        dots = data.centres[d] @ queries.centres[q]
        p, c = queries.radius[q], data.radius[d]
        top = dots + p * data.norms[d] + c * queries.norms[q] + p * c
        return top + 1e-9 * np.abs(top) + 1e-6

    def worst(q: int) -> float:
        rows = queries.order[queries.begin[q] : queries.end[q]]
        return np.maximum(best[rows, k - 1], floor[rows]).min()

    def score(q: int, d: int) -> None:
        rows = queries.order[queries.begin[q] : queries.end[q]]
        cols = data.order[data.begin[d] : data.end[d]]
        found = queries.points[rows] @ data.points[cols].T
        found[query_ids[rows][:, None] == data_ids[cols][None, :]] = -np.inf
        limits = np.maximum(best[rows, k - 1], floor[rows])
        for i in np.flatnonzero(found.max(axis=1) >= limits):
            row = rows[i]
            take = np.flatnonzero((found[i] >= limits[i]) & (found[i] > -np.inf))
            if not len(take):
                continue
            scores = np.concatenate([best[row], found[i][take]])
            names = np.concatenate([ids[row], data_ids[cols[take]]])
            places = np.concatenate([which[row], cols[take]])
            keep = np.lexsort((names, -scores))[:k]
            best[row], ids[row], which[row] = scores[keep], names[keep], places[keep]

    turn = itertools.count()
    heap = [(-float(bound(0, np.array([0]))[0]), next(turn), 0, 0)]
    while heap:
        top, _, q, d = heapq.heappop(heap)
        if -top < worst(q):
            continue
        q_kids, d_kids = queries.children[q], data.children[d]
        if q_kids is None and d_kids is None:
            score(q, d)
        elif d_kids is None or q_kids is not None and queries.radius[q] > data.radius[d]:
            for kid in q_kids:
                heapq.heappush(heap, (-float(bound(kid, np.array([d]))[0]), next(turn), kid, d))
        else:
            limit = worst(q)
            bounds = bound(q, np.array(d_kids))
            for kid, b in zip(d_kids, bounds.tolist(), strict=True):
                if b >= limit:
                    heapq.heappush(heap, (-b, next(turn), q, kid))
    return best, which


def _exact(queries: np.ndarray, data: np.ndarray, query_ids, data_ids, k):
    """Search for blocks whose scores a double cannot hold: blocks of Python integers."""
    for i, q in enumerate(queries.tolist()):
        ranked = heapq.nsmallest(
            k,
            (
                (-min(max(sum(a * b for a, b in zip(q, c, strict=True)), _LEAST), -1 - _LEAST), name, j)
                for j, (c, name) in enumerate(zip(data.tolist(), data_ids.tolist(), strict=True))
                if name != query_ids[i]
            ),
        )
        yield [(-s, j) for s, _, j in ranked]


def _blocks(size: int):
    """mapInArrow: number, ids and vectors (64-bit integers as bytes) of each block."""

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids, vectors = [], []

        def told():
            width = max(map(len, vectors))
            packed = np.zeros((len(vectors), width), np.int64)
            for row, v in zip(packed, vectors, strict=True):
                row[: len(v)] = v
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) | made], pa.int64()),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([packed.tobytes()], pa.binary()),
                ],
                ["block", "ids", "vectors"],
            )

        for batch in batches:
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                ids.append(vec_id)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield told()
                    made, ids, vectors = made + 1, [], []
        if ids:
            yield told()

    return run


def _unpacked(ids, vectors) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids.as_buffer(), np.int64)
    return names, np.frombuffer(vectors.as_buffer(), np.int64).reshape(len(names), -1)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _search(k: int):
    """mapInArrow over (block, ids, vectors, q_block, q_ids, q_vectors): query_id, vec_id, score."""

    def run(batches):
        last, tree = None, None
        # Best k scores so far of the queries of each query block.
        reached: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(c) for c in ("block", "ids", "vectors", "q_block", "q_ids", "q_vectors")]
            for block, ids, vectors, q_block, q_ids, q_vectors in zip(*columns, strict=True):
                data_ids, data = _unpacked(ids, vectors)
                query_ids, queries = _unpacked(q_ids, q_vectors)
                width = max(data.shape[1], queries.shape[1])
                data, queries = _padded(data, width), _padded(queries, width)
                most = max(max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (data, queries))
                rows = []
                if most <= _EXACT and most * most * max(width, 1) < 1 << 53:
                    if last != (block.as_py(), width):
                        last, tree = (block.as_py(), width), CoverTree(data.astype(np.float64))
                    before = reached.get(q_block.as_py())
                    if before is None:
                        before = np.full((len(query_ids), k), -np.inf)
                    best, which = dual_search(CoverTree(queries.astype(np.float64)), tree, query_ids, data_ids, k, before[:, -1])
                    if q_block.as_py() in reached or len(reached) < REMEMBERED:
                        reached[q_block.as_py()] = -np.sort(-np.concatenate([before, best], axis=1), axis=1)[:, :k]
                    for i, j in zip(*np.nonzero(which >= 0), strict=True):
                        rows.append((query_ids[i], data_ids[which[i, j]], int(best[i, j])))
                else:
                    for i, found in enumerate(_exact(queries, data, query_ids, data_ids, k)):
                        rows += [(query_ids[i], data_ids[j], score) for score, j in found]
                q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (q, v, s)], ["query_id", "vec_id", "score"]
                )

    return run


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and integer vector of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have (vec_id, v array<long>)."""
    kind = "block long, ids binary, vectors binary"
    data = materialize(in_arrow(vectors, _blocks(BLOCK), kind), "data-blocks")
    asked = materialize(in_arrow(queries.groupBy("vec_id").agg(F.min("v").alias("v")), _blocks(QUERY_BLOCK), kind), "query-blocks")
    count = data.count()
    # As many places as tasks, more only where a place would have too many blocks.
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = max(1, min(count, tasks), -(-count // PLACE_BLOCKS))
    placed = data.withColumn("place", F.pmod(F.xxhash64("block"), F.lit(places)).cast("int"))
    dealt = asked.select(
        F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"),
        F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"),
    )
    # Merged, never broadcast: dealt queries grow with the data. A task meets a data block's pairs one after the other.
    pairs = placed.join(dealt.hint("merge"), "place")
    found = in_arrow(
        pairs.select("block", "ids", "vectors", "q_block", "q_ids", "q_vectors"), _search(k), "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of all embeddings for every fiftieth."""
    vectors = usable(table(spark, sf_dir, "embeddings"), SCALE)
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
