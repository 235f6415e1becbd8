"""MinHash near-duplicate detection with tensored banding, verified on full sets.

A document's set holds its distinct five-word shingles (lower-cased A-Z; with
fewer words the whole sequence).  Documents of Jaccard similarity at or over the
threshold are linked, and a class is a connected component of links.

1. One pass computes the set's digest and m small minhash collections of r
   hashes each.  Equal sets are one node from here on.
2. Tensoring: a table key is a pair of collections, so m * r hashes serve
   m (m - 1) / 2 tables.  A collection value that no other set has cannot be in a
   shared pair; those are dropped before pairs are formed, which leaves most sets
   with no table rows at all.
3. Star: a bucket's head is its least set, and a set is compared on the full sets with
   each head that leads a bucket of its, once however many tables share the two; then
   components are taken.
4. Rest: a head's group, all sets of the buckets it leads, may still span several
   components.  There the sets outside the largest one are compared with the group's others
   by blocks of bounded size, so every pair of a bucket across components is tested.
   Sets that are linked already are not paired again, no bucket is capped.

Sets whose sizes alone exclude the threshold are not fetched for the star.

At J = 0.85, r = 3 and m = 14 a pair shares a bucket with probability 0.99996; at
0.8, m = 18 gives 0.99995.

Edge cases: null or blank text has the empty set and is linked with nothing;
rows of equal doc_id are joined through their sets; a null doc_id never is the
class id unless a class has no other; repeated rows share a class; an empty table
gives an empty result; further columns pass through ``keep_one``, which keeps one
row per class.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.llm.common import connected_components, discard, in_arrow, materialize, slices, table
from ambler.llm.textblock import Words, mix

SHINGLE = 5
_SLICE = 1 << 20
#: Shingles in a block of step 4, one set at least.
BLOCK_SHINGLES = 1 << 18
_RANDOM = np.random.Generator(np.random.PCG64(7))
_XOR = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_MULTIPLY = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Rows with a set, their shingles end to end, where each begins, and the digest of every row's set."""
    full = np.flatnonzero([len(s) for s in sets])
    digests: list = [None] * len(sets)
    if not len(full):
        return full, np.zeros(0, np.uint64), full, digests
    flat = np.concatenate([sets[i] for i in full])
    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]]).astype(np.int64)
    low = np.add.reduceat(mix(flat ^ _XOR[254]), first)
    high = np.add.reduceat(mix(flat ^ _XOR[255]), first)
    for i, a, b in zip(full, high, low, strict=True):
        digests[i] = a.tobytes() + b.tobytes()
    return full, flat, first, digests


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(bounds, pa.array(flat.view(np.int64)))


def _signatures(k: int, r: int, m: int):
    """mapInArrow: doc_id, h, n_shingles, sid (digest of the set), keys (m collections)."""

    def run(batches):
        for batch in slices(batches, "text", _SLICE):
            sets = _distinct(*Words(batch.column("text"), lower=True).shingles(k))
            full, flat, first, digests = _digests(sets)
            keys = np.zeros((len(sets), m), np.uint64)
            for c in range(m if len(full) else 0):
                value = np.full(len(full), c + 1, np.uint64)
                for j in range(c * r, (c + 1) * r):
                    value = mix(value ^ np.minimum.reduceat((flat ^ _XOR[j]) * _MULTIPLY[j], first))
                keys[full, c] = value
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("h"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists(list(keys)),
                ],
                ["doc_id", "h", "n_shingles", "sid", "keys"],
            )

    return run


def _sets(k: int):
    """mapInArrow: sid and the sorted shingle hashes, once for each set that the task meets."""

    def run(batches):
        met = set()
        for batch in slices(batches, "text", _SLICE):
            sets = _distinct(*Words(batch.column("text"), lower=True).shingles(k))
            new = {d: s for d, s in zip(_digests(sets)[3], sets, strict=True) if d is not None and d not in met}
            met.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), _lists(list(new.values()))], ["sid", "shingles"])

    return run


def similar(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether two sets of distinct elements reach similarity num / den."""
    both, total = F.size(F.array_intersect(a, b)).cast("long"), (F.size(a) + F.size(b)).cast("long")
    return den * both >= num * (total - both)


class _Union:
    def __init__(self, labels):
        self.up = {x: x for x in labels}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y


def _cross(num: int, den: int):
    """applyInArrow over a block: links of components, found between its outliers and its other sets.

    Postings of the block's sets give each outlier's overlap with all others in one
    count.  Links inside what the block knows to be one component are not repeated.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        labels = group.column("label").to_pylist()
        side = np.array(group.column("side").to_pylist())
        lists = group.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = lists.flatten().to_numpy().view(np.uint64)
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        known = _Union(set(labels))
        links = []
        outliers = np.flatnonzero(side == 0)
        for i in outliers:
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            spans = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero(den * both >= num * (sizes[i] + sizes - both)):
                if known.join(labels[i], labels[j]):
                    links.append((labels[i], labels[j]))
        return pa.table(
            {"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())}
        )

    return run


def near_duplicate_classes(
    docs: DataFrame, threshold: Fraction = Fraction(85, 100), r: int = 3, m: int = 14, k: int = SHINGLE
) -> DataFrame:
    """doc_id, h (of doc_id and text), n_shingles, component_id and component_h of every row.

    (component_id, component_h) is the least row of the class; null ids come last.
    """
    return _classes(docs, threshold, r, m, k)[0]


def _classes(docs: DataFrame, threshold: Fraction, r: int, m: int, k: int = SHINGLE) -> tuple[DataFrame, list[DataFrame]]:
    """The classes, and the tables that they still read."""
    num, den = threshold.numerator, threshold.denominator
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("h")
    )
    signed = materialize(
        in_arrow(
            docs,
            _signatures(k, r, m), "doc_id long, h long, n_shingles long, sid binary, keys array<long>"
        ),
        "signatures",
    )
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    nodes = signed.where("sid is not null").groupBy("sid")

    # Collections that another set shares, then the pairs of them. A collection's number is part of its hash.
    single = nodes.agg(F.first("keys").alias("keys"), F.max("n_shingles").alias("size")).select(
        "sid", "size", F.explode("keys").alias("key")
    )
    shared = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    live = materialize(
        single.join(shared, "key")
        .groupBy("sid", "size")
        .agg(F.array_sort(F.collect_list("key")).alias("live"))
        .where("size(live) > 1"),
        "collections",
    )
    combos = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(m), 2)])
    bucketed = live.select(
        "sid",
        "size",
        F.explode(
            F.transform(
                F.filter(combos, lambda p: p["j"] < F.size("live")),
                lambda p: F.xxhash64(F.get("live", p["i"]), F.get("live", p["j"])),
            )
        ).alias("bucket"),
    )
    heads = bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("sid", "size")).alias("head")).where("n > 1").drop("n")
    # Many tables bring the same sets together: a set once for each head that leads a bucket of its.
    stars = materialize(
        bucketed.join(heads, "bucket")
        .where(F.col("sid") != F.col("head.sid"))
        .select(F.col("head.sid").alias("a"), F.col("head.size").alias("size_a"), F.col("sid").alias("b"), F.col("size").alias("size_b"))
        .distinct(),
        "stars",
    )
    discard(live)

    # Each set against its heads, on full sets; sizes too far apart need no look.
    wanted = stars.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    holders = nodes.agg(F.min("h").alias("h")).join(wanted, "sid", "left_semi").select("h").distinct()
    sets = materialize(in_arrow(docs.join(holders, "h").select("text"), _sets(k), "sid binary, shingles array<long>"), "sets")
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    near = F.lit(den).cast("long") * F.least("size_a", "size_b") >= F.lit(num).cast("long") * F.greatest("size_a", "size_b")
    starred = materialize(
        stars.where(near).select("a", "b").join(right, "b").join(left, "a").where(similar(F.col("sa"), F.col("sb"), num, den)).select("a", "b"),
        "links",
    )
    starred_labels = labels = materialize(connected_components(starred).withColumnRenamed("node", "sid"), "labels")

    # Groups of a head that span several components: outliers against the rest, by blocks.
    grouped = stars.select(F.col("a").alias("head"), F.col("b").alias("sid"), F.col("size_b").alias("size")).unionAll(
        stars.select(F.col("a").alias("head"), F.col("a").alias("sid"), F.col("size_a").alias("size")).distinct()
    )
    known = materialize(
        grouped.join(labels, "sid", "left").select("head", "sid", "size", F.coalesce("label", "sid").alias("label")), "groups"
    )
    parts = known.groupBy("head", "label").agg(F.count("*").alias("n"), F.sum("size").alias("load"))
    blocks_of = lambda load: F.ceil(load / BLOCK_SHINGLES)
    mixed = materialize(
        parts.groupBy("head")
        .agg(F.count("*").alias("labels"), F.max(F.struct("n", "label", "load")).alias("main"), F.sum("load").alias("load"))
        .where("labels > 1")
        .select(
            "head",
            F.col("main.label").alias("main"),
            blocks_of(F.col("main.load")).alias("mains"),
            blocks_of(F.col("load") - F.col("main.load")).alias("outs"),
        ),
        "mixed",
    )
    spread = known.join(mixed, "head").withColumn("out", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("mains"))).alias("own")
    # A block is part o of the outliers with part x of the main component (kind 0) or of the outliers (kind 1).
    block = lambda o, kind, x, side: F.struct(
        o.alias("o"), F.lit(kind).alias("kind"), x.alias("x"), F.lit(side).alias("side")
    )
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_out = F.concat(
        F.transform(upto("mains"), lambda x: block(F.col("own"), 0, x, 0)),
        F.transform(upto("outs"), lambda x: block(F.least("own", x), 1, F.greatest("own", x), 0)),
    )
    as_main = F.transform(upto("outs"), lambda o: block(o, 0, F.col("own"), 1))
    blocks = (
        spread.select("*", own)
        .select("head", "sid", "label", F.explode(F.when(F.col("out"), as_out).otherwise(as_main)).alias("block"))
        .select("head", "sid", "label", "block.*")
        .join(sets, "sid")
    )
    crossed = materialize(
        blocks.groupBy("head", "o", "kind", "x").applyInArrow(_cross(num, den), "a binary, b binary").distinct(), "crossed"
    )
    # What the second comparison linked are components of the first.
    joined = materialize(connected_components(crossed), "joined")
    labels = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("over")), "label", "left").select(
        "sid", F.coalesce("over", "label").alias("label")
    ).unionAll(
        joined.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("sid"), "label")
    )

    least = nodes.agg(F.min(row).alias("least"))
    classes = materialize(
        least.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")),
        "labelled",
    )
    # Written first, so that the join deals both sides anew and can split a class of many sets.
    first = materialize(classes.groupBy("label").agg(F.min("least").alias("first")), "least")
    named = materialize(
        classes.join(first, "label").select(
            "sid", F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("component_h")
        ),
        "classes",
    )
    discard(stars, sets, starred, starred_labels, known, mixed, crossed, joined, classes, first)
    alone = F.col("sid").isNull()
    told = signed.join(named, "sid", "left").select(
        "doc_id",
        "h",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("h")).otherwise(F.col("component_h")).alias("component_h"),
    )
    return told, [signed, named]


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def keep_one(docs: DataFrame, threshold: Fraction = Fraction(80, 100), r: int = 3, m: int = 18) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, in the same columns."""
    classes, used = _classes(docs.select("doc_id", "text"), threshold, r, m)
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__id")
    dropped = materialize(
        classes.where("not (h <=> component_h and doc_id <=> component_id)").select(id_key, F.col("h").alias("__h")), "dropped"
    )
    discard(*used)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), id_key, row_hash().alias("__h"))
    rest = keyed.join(dropped, ["__id", "__h"], "left_anti").dropDuplicates(["__id", "__h"])
    return rest.select("__row.*")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents at 85 of 100 common shingles."""
    classes = near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
