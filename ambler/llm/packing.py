"""Packing token streams into fixed sequences: concatenate and cut.

Pass one encodes every document and writes its ids with its task's number and its
offset inside the task.  The tasks' totals, one number each, are summed up to
where each task begins in the stream of all tokens.  Pass two cuts each document
where the stream crosses a multiple of the sequence length; a document on both
sides of such a boundary gives a record for either.  No row is moved to another
task, so no key can make a task large, and only the last sequence has padding.

Edge cases: null or empty text is the end token alone; a document longer than a
sequence spans several; repeated rows are packed one after the other; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambler.llm import bpe
from ambler.llm.common import in_arrow, materialize, slices, table

SEQUENCE = 4096
END_ID = 2
_SLICE = 2 << 20


def _tokens(path: str, end_id: int):
    """mapInArrow: doc_id, task, before (tokens of the task's earlier rows), doc_tokens, ids."""

    def run(batches):
        from pyspark import TaskContext

        task, before = TaskContext.get().partitionId(), 0
        coder = bpe.encoder(path)
        narrow = "<u2" if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in slices(batches, "text", _SLICE):
            ids, bounds = coder.encode_batch(batch.column("text"))
            counts = np.diff(bounds) + 1
            starts = before + np.concatenate([[0], np.cumsum(counts)[:-1]])
            before += int(counts.sum())
            ids = np.insert(ids, bounds[1:], end_id).astype(narrow)
            own = bounds + np.arange(len(bounds))
            held = [ids[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([task] * len(counts), pa.int32()), pa.array(starts), pa.array(counts), pa.array(held, pa.binary())],
                ["doc_id", "task", "before", "doc_tokens", "ids"],
            )

    return run


def _cut(sequence: int):
    """mapInArrow: the pieces of each document, ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            doc, at, n = [], [], []
            starts, lengths, places = [], [], []
            for i, (base, tokens, ids) in enumerate(
                zip(batch.column("at").to_pylist(), batch.column("doc_tokens").to_pylist(), batch.column("ids"), strict=True)
            ):
                held = np.frombuffer(ids.as_buffer(), "<u2" if len(ids.as_buffer()) == 2 * tokens else "<u4").astype("<u4")
                first = 0
                while first < tokens:
                    length = min(tokens - first, sequence - (base + first) % sequence)
                    doc.append(i)
                    starts.append(first)
                    lengths.append(length)
                    places.append(base + first)
                    n.append(tokens)
                    at.append(held[first : first + length].tobytes())
                    first += length
                    if len(doc) >= 4096:
                        yield told(batch, doc, starts, lengths, places, n, at)
                        doc, at, n, starts, lengths, places = [], [], [], [], [], []
            yield told(batch, doc, starts, lengths, places, n, at)

    def told(batch, doc, starts, lengths, places, n, ids):
        places = np.array(places, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc, pa.int64())),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(n, pa.int64()),
                pa.array(places // sequence),
                pa.array(places % sequence),
                pa.array(ids, pa.binary()),
            ],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    return run


def pack(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = materialize(
        in_arrow(
            docs.select("doc_id", F.col("text").cast("string").alias("text")),
            _tokens(path or bpe.vocabulary_path(), end_id),
            f"doc_id {kind}, task int, before long, doc_tokens long, ids binary",
        ),
        "tokens",
    )
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task of pass one: the count of input splits bounds the broadcast.
    bases = (
        encoded.groupBy("task")
        .agg(F.sum("doc_tokens").alias("n"))
        .select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    placed = encoded.join(F.broadcast(bases), "task").select(
        "doc_id", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids"
    )
    return in_arrow(
        placed, _cut(sequence), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def told(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return told(pack(table(spark, sf_dir, "documents").select("doc_id", "text")))
