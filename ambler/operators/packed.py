"""Rows of a graph as packed blocks, and passes over the edges of walkers' vertices.

A block holds up to ``block`` following edges of one vertex in few bytes.  Walkers are
joined with blocks, and the edges of their vertices are rows only inside a task: they are
unpacked, judged by columns and reduced to one row a walker without a shuffle or a sort.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambler.functions.rng import M, draw_numpy

#: Edges unpacked at once, and rows reduced at once.
ROWS = 1 << 16
_INTS = ("<u1", "<u2", "<u4", "<i8")
_FLOAT = "<f8"
_TYPES = (*_INTS, _FLOAT)
#: Rounds of minima up to which a row's least edges are found without sorting.
_ROUNDS = 8


def _packed(x: np.ndarray, whole: bool = True) -> tuple[int, bytes]:
    """The number of the narrowest type that holds x, and its bytes."""
    if not whole:
        if not (np.isfinite(x).all() and (x >= 0).all() and (x < 1 << 32).all() and (x == np.floor(x)).all()):
            return 4, x.astype(_FLOAT).tobytes()
    top = x.max(initial=0)
    kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    return kind, x.astype(_INTS[kind]).tobytes()


def pack(dst: np.ndarray, w: np.ndarray, deg: np.ndarray) -> bytes:
    base = int(dst.min())
    columns = [_packed(dst - base), _packed(w, whole=False), _packed(deg)]
    return np.array([len(dst), base], "<i8").tobytes() + bytes(k for k, _ in columns) + b"".join(b for _, b in columns)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dst, w and dst_deg of a block, in its types; dst as 64 bits."""
    n, base = np.frombuffer(blob, "<i8", 2).tolist()
    out, at = [], 19
    for kind in blob[16:19]:
        out.append(np.frombuffer(blob, _TYPES[kind], n, at))
        at += n * out[-1].itemsize
    return out[0].astype(np.int64) + base, out[1], out[2]


def runs(batches, first, rows: int = ROWS):
    """Batches of whole runs; ``first`` tells of a batch where runs begin."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begin = np.flatnonzero(first(table))
        cut = int(begin[-1]) if len(begin) else 0
        if cut:
            yield from table.slice(0, cut).combine_chunks().to_batches()
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
        rows = max(ROWS, 2 * n)  # a run that has not ended is not looked through again and again
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def blocks(edges: DataFrame, block: int) -> DataFrame:
    """node, block, deg, blob of all edges; a weight that is null counts as 0."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select(
        F.col("src").alias("node"), F.floor(F.col("pos") / block).cast("int").alias("block"), "pos", "src_deg", "dst", F.coalesce("w", F.lit(0.0)).alias("w"), "dst_deg"
    )
    rows = rows.repartition(n, "node", "block").sortWithinPartitions("node", "pos")

    def run(batches):
        for batch in runs(batches, lambda table: _numbers(table.column("pos")) % block == 0):
            node, part, pos, src_deg, dst, w, deg = (_numbers(batch.column(c)) for c in ("node", "block", "pos", "src_deg", "dst", "w", "dst_deg"))
            begin = np.flatnonzero(pos % block == 0)
            ends = np.append(begin[1:], len(pos)).tolist()
            blobs = [pack(dst[a:b], w[a:b], deg[a:b]) for a, b in zip(begin.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[begin]), pa.array(part[begin]), pa.array(src_deg[begin]), pa.array(blobs, pa.binary())], ["node", "block", "deg", "blob"])

    return rows.mapInArrow(run, "node long, block int, deg long, blob binary")


def _chunks(batch: pa.RecordBatch, each: int | None = None):
    """First and last row, and the unpacked blobs (None: no block), of slices of about ROWS edges."""
    for at in range(0, batch.num_rows, 512):
        held = [None if b is None else unpack(b) for b in batch.column("blob").slice(at, 512).to_pylist()]
        a = n = 0
        for b, x in enumerate(held):
            n += 1 if x is None else each or len(x[0])
            if n >= ROWS or b + 1 == len(held):
                yield at + a, at + b + 1, held[a : b + 1]
                a, n = b + 1, 0


def _flat(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length of each block, and all edges end to end; a row of -1 where there is no block."""
    none = (np.array([-1]), np.array([0.0]), np.array([0]))
    held = [none if x is None else x for x in held]
    sizes = np.array([len(x[0]) for x in held])
    return sizes, *(np.concatenate([x[i] for x in held]).astype(kind) for i, kind in enumerate((np.int64, np.float64, np.int64)))


def _connected(near: list, owner: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each row's ``to`` is in the block ``near`` of its owner."""
    sets = [np.zeros(0, np.int64) if x is None else unpack(x)[0] for x in near]
    known = np.concatenate([np.zeros(0, np.int64), *sets])
    if not len(known):
        return np.zeros(len(to), bool)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    low, high = min(known.min(), to.min()), max(known.max(), to.max())
    span = int(high) - int(low) + 1
    if span * len(sets) < 1 << 62:
        known, wanted = of * span + (known - low), owner * span + (to - low)
    else:
        ids, code = np.unique(np.concatenate([known, to]), return_inverse=True)
        known, wanted = of * len(ids) + code[: len(known)], owner * len(ids) + code[len(known) :]
    if (known[1:] < known[:-1]).any():
        known.sort()
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def unpacked(rows: DataFrame, repeat: list[str], proposals: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A row for each edge of ``blob``: chunk, the columns ``repeat``, pos, to, to_deg, w and connected.

    Rows without a blob stay one row, with pos -1 and to null.  chunk, at the first of some 65,536
    rows, holds what :func:`reduced` gives back of them, so that few columns travel.  connected is read from ``near``, the block of the vertex
    before, where rows have it.  proposals (how many, step, channels apart, seed): uniformly drawn
    edges instead of all, numbered by pos.
    """
    asks = "near" in rows.columns
    held = [c for c in rows.columns if c not in ("blob", "near")]
    rows = rows.select(F.struct(*held).alias("rest"), *repeat, "blob", *["near"] * asks)
    kept = [f for f in rows.schema.fields if f.name in repeat]
    many = proposals[0] if proposals else None

    def run(batches):
        for batch in batches:
            for a, b, held in _chunks(batch, many):
                part = batch.slice(a, b - a)
                sizes, to, w, deg = _flat(held)
                missing = np.array([x is None for x in held])
                if proposals:
                    _, t, apart, seed = proposals
                    begin = np.cumsum(sizes) - sizes
                    walker = np.where(missing, 0, part.column("rest").field("walker").fill_null(0).to_numpy(zero_copy_only=False))
                    slots = np.stack([begin + draw_numpy(walker, t, apart * k, seed) % sizes for k in range(many)], axis=1)
                    use = np.ones(slots.shape, bool)
                    use[missing, 1:] = False
                    edge = slots[use]
                    to, w, deg, sizes = to[edge], w[edge], deg[edge], use.sum(axis=1)
                begin = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(to)) - begin[owner]
                none = missing[owner]
                every = pa.array(owner)
                chunk = pickle.dumps((part.column("rest").take(pa.array(np.arange(len(sizes)))), sizes, to, deg), 5)
                linked = [pa.array(_connected(part.column("near").to_pylist(), owner, to))] if asks else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk, *[None] * (len(to) - 1)], pa.binary()),
                        *[part.column(f.name).take(every) for f in kept],
                        pa.array(np.where(none, -1, at)),
                        pa.array(to, mask=none),
                        pa.array(deg, mask=none),
                        pa.array(w),
                        *linked,
                    ],
                    ["chunk", *[f.name for f in kept], "pos", "to", "to_deg", "w", *["connected"] * asks],
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    found = rows.mapInArrow(run, f"chunk binary, {schema}pos long, to long, to_deg long, w double" + ", connected boolean" * asks)
    return found if asks else found.withColumn("connected", F.lit(False))


def reduced(rows: DataFrame, like: DataFrame, to: str, drawn: tuple[int, int, int] | None = None) -> DataFrame:
    """The rows ``like`` from which :func:`unpacked` gave ``rows``, with ``to`` and ``to``_deg of one edge.

    drawn (step, channel, seed): the edge that a draw meets among the running sums of column b,
    added one after the other; without it the first edge where ``accepted`` holds.
    """
    from ambler.operators.walk import row_sums

    told = "b" if drawn else "accepted"

    def run(batches):
        for batch in runs(batches, lambda table: table.column("chunk").is_valid().to_numpy()):
            starts = np.flatnonzero(batch.column("chunk").is_valid().to_numpy(zero_copy_only=False))
            for first in starts.tolist():
                rest, sizes, to_, deg = pickle.loads(batch.column("chunk")[first].as_py())
                n = len(to_)
                judged = batch.column(told).slice(first, n)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                begin = bounds[:-1]
                if drawn:
                    t, channel, seed = drawn
                    cum = row_sums(_numbers(judged.fill_null(0.0)), bounds)
                    total = np.maximum.reduceat(cum, begin)
                    h = draw_numpy(_numbers(rest.field("walker").fill_null(0)), t, channel, seed)
                    fits = (cum * M > np.repeat(h * total, sizes)) & np.repeat(total > 0, sizes)
                else:
                    fits = _numbers(judged.fill_null(False)).astype(bool)
                found = np.minimum.reduceat(np.where(fits, np.arange(n), n), begin)
                none, place = found == n, np.minimum(found, n - 1)
                yield pa.RecordBatch.from_arrays([rest, pa.array(to_[place], mask=none), pa.array(deg[place], mask=none)], ["rest", to, f"{to}_deg"])

    kind = like.select(F.struct(*like.columns).alias("rest")).schema["rest"].dataType.simpleString()
    found = rows.select("chunk", told).mapInArrow(run, f"rest {kind}, `{to}` long, `{to}_deg` long")
    return found.select("rest.*", to, f"{to}_deg")


def _least(order: np.ndarray, valid: np.ndarray, begin: np.ndarray, sizes: np.ndarray, f: int) -> np.ndarray:
    """A bound of each row that its f least valid orders keep to."""
    left = np.where(valid, order, np.inf)
    if f <= _ROUNDS:
        for _ in range(f):
            least = np.minimum.reduceat(left, begin)
            left[left <= np.repeat(least, sizes)] = np.inf
        return least
    left = left[np.lexsort((left, np.repeat(np.arange(len(sizes)), sizes)))]
    return np.where(sizes >= f, left[begin + np.minimum(sizes, f) - 1], np.inf)


def heaviest(rows: DataFrame, f: int, block: int, channel: int, seed: int) -> DataFrame:
    """instance, slot, deg, pos, to, to_deg, w of the edges that may be among the f of a weighted draw without replacement.

    rows: instance, slot, parent (the draws' number), deg, block, blob.  Each block gives its f edges of
    least -log(u) / w, a few more where orders are as good as equal; all edges where deg <= f.
    """

    def run(batches):
        for batch in batches:
            for a, b, held in _chunks(batch):
                part = batch.slice(a, b - a)
                sizes, to, w, to_deg = _flat(held)
                parent, deg, number = (_numbers(part.column(c)) for c in ("parent", "deg", "block"))
                begin = np.cumsum(sizes) - sizes
                each = lambda x: np.repeat(x, sizes)  # noqa: B023, E731
                pos = np.arange(len(to)) - each(begin - number * block)
                whole, valid = each(deg <= f), w > 0
                key = draw_numpy(each(parent), pos, channel, seed)
                with np.errstate(all="ignore"):
                    order = -np.log((key + 1) / float(M + 1)) / w
                    # Logarithms of other libraries may differ in the last bits: the exact rank is taken from what is left.
                    keep = whole | valid & (order <= each(_least(order, valid, begin, sizes, f) * (1 + 1e-9)))
                chosen = np.flatnonzero(keep)
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes)[chosen])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(owner) for c in ("instance", "slot", "deg")], *[pa.array(x[chosen]) for x in (pos, to, to_deg, w)]],
                    ["instance", "slot", "deg", "pos", "to", "to_deg", "w"],
                )

    kept = rows.select("instance", "slot", "parent", "deg", "block", "blob")
    return kept.mapInArrow(run, "instance long, slot long, deg long, pos long, to long, to_deg long, w double")
