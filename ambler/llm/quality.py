"""Quality rules: word and line counts, then bands of zstandard compression ratios.

The ratio is compressed bytes over bytes.  A text is judged as a whole and by
fixed chunks, each against the limits of its own length: below the lower limit it
repeats itself, above the upper one it does not compress as language does.  A
document fails on its whole ratio, or where more than half of its chunk bytes lie
outside their bands.  Texts shorter than the first band are not judged by ratio.

Limits come from general text (English licences and manuals, translated messages in
Polish, German, French, Spanish, Finnish, Russian, Greek, Arabic, Japanese and Korean)
and from noise.  Ratios fall with length, so a band's upper limit is over what dense
text measures where the band begins and under what noise measures where it ends.
Printable noise, base64 and random letters with digits are over it in every band;
random letters of both cases from 768 bytes on, small letters with digits from 1,536,
small letters alone from 2,048, hexadecimal from 8,192.  Below these lengths the ratio
cannot tell them from language.  Lower limits are near the first percentile of
the same texts.  Chinese measures higher than these texts (0.59 at 4,096 bytes), but
without white space it fails for its few words anyway.

Edge cases: null text counts as empty and fails for having no words; a text of
one very long word is one chunk run like any other; repeated rows are judged
alike; an empty table gives an empty result; further columns are not read by
``measure`` and pass through ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.llm.common import carried, in_arrow, opened, slices, table
from ambler.llm.textblock import Words, mix

#: (bytes from which it holds, lower limit, upper limit) of compressed / raw bytes.
BANDS = (
    (256, 0.36, 0.84),
    (384, 0.33, 0.80),
    (512, 0.31, 0.77),
    (768, 0.28, 0.725),
    (1024, 0.25, 0.69),
    (1536, 0.25, 0.64),
    (2048, 0.25, 0.59),
    (3072, 0.25, 0.57),
    (4096, 0.20, 0.55),
    (8192, 0.20, 0.51),
    (16384, 0.17, 0.49),
    (65536, 0.15, 0.46),
)
CHUNK_BYTES = 4096
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SLICE = 1 << 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " ratio double, bad_chunk_bytes long, band_failed boolean"
)


def _limits(n: int, bands) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for at_least, lo, hi in bands:
        if n >= at_least:
            low, high = lo, hi
    return low, high


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeat_words(words: Words, k: int = 3) -> np.ndarray:
    """Words per row inside runs of k words that the row holds at least twice."""
    hashes, bounds = words.windows(k)
    if not len(hashes):
        return np.zeros(len(words.counts), np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, inverse, counts = np.unique(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    first = words.bounds[row[twice]] + (twice - bounds[row[twice]])
    covered = np.zeros(len(words.hash), bool)
    for i in range(k):
        covered[first + i] = True
    return _per_row(covered, words.bounds)


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line and not line.isspace():
            seen.add(line)
    return n


def _measure(bands, chunk_bytes: int, level: int):
    def run(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in slices(batches, "text", _SLICE):
            words = Words(batch.column("text"), lower=False)
            data, offsets = words.data, words.offsets
            inside = np.zeros(len(data) + 1, np.int32)
            inside[words.start] += 1
            np.subtract.at(inside, words.end, 1)
            inside = np.cumsum(inside[:-1]) > 0
            chars = _per_row(inside & ((data & 0xC0) != 0x80), offsets)
            symbols = _per_row(_SYMBOLS[data], offsets)
            dup_lines, ratios, bad_bytes, failed = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b].tobytes()
                dup_lines.append(_dup_lines(text))
                n = len(text)
                ratio = len(compressor.compress(text)) / n if n else None
                low, high = _limits(n, bands)
                bad = 0
                for at in range(0, n, chunk_bytes) if n > chunk_bytes else ():
                    chunk = text[at : at + chunk_bytes]
                    lo, hi = _limits(len(chunk), bands)
                    if not lo <= len(compressor.compress(chunk)) / len(chunk) <= hi:
                        bad += len(chunk)
                ratios.append(ratio)
                bad_bytes.append(bad)
                failed.append(ratio is not None and not low <= ratio <= high or 2 * bad > n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(chars),
                    pa.array(symbols),
                    pa.array(dup_lines, pa.int64()),
                    pa.array(_repeat_words(words)),
                    pa.array(ratios, pa.float64()),
                    pa.array(bad_bytes, pa.int64()),
                    pa.array(failed, pa.bool_()),
                    *[batch.column(c) for c in batch.schema.names if c not in ("doc_id", "text")],
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")] + [c for c in batch.schema.names if c not in ("doc_id", "text")],
            )

    return run


def _verdicts(measured: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed"))


def measure(docs: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """Counts, ratios and verdict of every row; one pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _verdicts(in_arrow(rows, _measure(bands, chunk_bytes, level), SCHEMA))


def keep_good(docs: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` that pass, in the same columns, in one pass without a shuffle."""
    rows, judge = carried(docs), _measure(bands, chunk_bytes, level)
    kind = rows.schema["__row"].dataType.simpleString()
    judged = _verdicts(in_arrow(rows, lambda batches: judge(opened(batches)), f"{SCHEMA}, __row {kind}"))
    return judged.where("kept").select("__row.*")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the production bands."""
    return measure(table(spark, sf_dir, "documents"))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base verdict of operator 8 for every document: the part of its rows that SQL can express."""
    return measure(table(spark, sf_dir, "documents")).drop("ratio", "bad_chunk_bytes", "band_failed", "kept")
