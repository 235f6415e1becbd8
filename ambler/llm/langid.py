"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of words holds the filters of all languages, a bit each.  A lookup ANDs
the words that the hash functions choose and so returns the languages containing
the n-gram.  Per language the hits are counted over the whole text and corrected
for the false positives that the filter's fill predicts; the language with the
most corrected hits wins, ties to the lesser name.

Training reads a sample of labelled rows of bounded expected size, ``SAMPLE_DOCS``
per language, chosen by a hash of doc_id; a filter holds at most ``GRAMS`` n-grams
of its language, those seen most often there and not much more often elsewhere.  A
model has ``LANGS`` languages at most, which bounds its size.

Edge cases: text that is null or has no letter is ``und`` with score 0, as is
everything when nothing was labelled; a text that hits no filter has score 0 and
the first language; repeated rows are judged alike; an empty table gives an empty
result; further columns are not read by ``predict`` and pass through
``keep_known``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambler.llm.common import carried, in_arrow, opened, slices, table
from ambler.llm.textblock import mix

N = 4
SAMPLE_DOCS = 1500
GRAMS = 20_000
#: Most languages of a model: those with the most labelled rows, ties to the lesser name.
LANGS = 1024
TABLE_WORDS = 1 << 18
HASHES = 3
#: A gram belongs to a language where its share is at least this part of its largest share.
SHARE = 0.25
UNDETERMINED = "und"
MIN_SCORE = 0.30
#: Bytes of text whose grams are made at once: some 50 times that in arrays, in each Python worker.
_SLICE = 1 << 18


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams with a letter, and the bounds of each text's.

    Texts are lower-cased, each run of other characters than letters counts as one
    space, and a text begins and ends with one.
    """
    points = np.frombuffer("\0".join(" " + t.lower().replace("\0", " ") + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 0
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    keep[1:] |= ends[:-1]
    keep &= ~ends
    code = np.where(letter, points, np.uint32(32))[keep]
    owner = np.cumsum(ends)[keep]
    n = len(code) - N + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    total = np.zeros(n, np.uint64)
    lettered = np.zeros(n, bool)
    for i in range(N):
        part = code[i : i + n].astype(np.uint64)
        total = total * np.uint64(0x100000001B3) + part
        lettered |= part != 32
    valid = lettered & (owner[:n] == owner[N - 1 :])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[:n][valid], minlength=len(texts))[: len(texts)])])
    return mix(total[valid]), bounds


def _count(batches):
    """mapInArrow: lang, gram, n of each batch's rows."""
    for batch in slices(batches, "text", _SLICE):
        hashes, bounds = _grams([t or "" for t in batch.column("text").to_pylist()])
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        names, which = np.unique(langs, return_inverse=True)
        of = np.repeat(which, np.diff(bounds))
        for i, name in enumerate(names):
            grams, counts = np.unique(hashes[of == i], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "gram", "n"],
            )


@dataclass
class Model:
    """langs[i] is bit i % 64 of table i // 64; wrong[i] is its false positive rate."""

    langs: list[str]
    tables: np.ndarray
    wrong: np.ndarray

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Grams of each row found in each language's filter, corrected."""
        found = np.zeros((len(bounds) - 1, len(self.langs)))
        if not len(hashes):
            return found
        slots = [_slot(hashes, i) for i in range(HASHES)]
        rows = np.flatnonzero(np.diff(bounds))
        for plane, words in enumerate(self.tables):
            mask = words[slots[0]]
            for s in slots[1:]:
                mask = mask & words[s]
            for bit in range(min(64, len(self.langs) - 64 * plane)):
                has = ((mask >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
                found[rows, 64 * plane + bit] = np.add.reduceat(has, bounds[:-1][rows])
        n = np.diff(bounds)[:, None]
        return np.clip((found - n * self.wrong) / (1 - self.wrong), 0, n)


def _slot(hashes: np.ndarray, i: int) -> np.ndarray:
    return (hashes >> np.uint64(20 * i)) & np.uint64(TABLE_WORDS - 1)


def build(langs: list[str], grams: dict[str, np.ndarray]) -> Model:
    planes = max(1, -(-len(langs) // 64))
    tables = np.zeros((planes, TABLE_WORDS), np.uint64)
    wrong = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        plane, bit = tables[i // 64], np.uint64(1 << (i % 64))
        for h in range(HASHES):
            plane[_slot(grams[lang], h)] |= bit
        wrong[i] = min(0.99, np.mean(plane & bit != 0) ** HASHES)
    return Model(langs, tables, wrong)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS, most_langs: int = LANGS) -> Model:
    """Model of the ``most_langs`` languages with the most rows, from rows (doc_id, text, lang); lang not null."""
    labelled = labelled.where("lang is not null")
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    sizes = {r.lang: r.n for r in counted.collect()}
    langs = sorted(sizes)
    if not langs:
        return build([], {})
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(lang, min(1.0, sample_docs / n)) for lang, n in sizes.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = (
        in_arrow(labelled.join(F.broadcast(shares), "lang").where(drawn < F.col("share")).select("text", "lang"), _count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    told = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    largest = told.groupBy("gram").agg(F.max("share").alias("most"))
    chosen = (
        told.join(largest, "gram")
        .where(F.col("share") >= SHARE * F.col("most"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= grams)
        .groupBy("lang")
        .agg(F.collect_list("gram").alias("grams"))
        .collect()
    )
    by_lang = {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in chosen}
    return build(langs, {lang: by_lang.get(lang, np.zeros(0, np.uint64)) for lang in langs})


def _predict(model):
    """mapInArrow: text is replaced by lang_pred and score."""

    def run(batches):
        held = model.value
        for batch in slices(batches, "text", _SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            preds, scores = [], []
            hashes, bounds = _grams(texts)
            if held.langs:
                hits = held.hits(hashes, bounds)
                best = hits.argmax(axis=1)
                top = hits[np.arange(len(texts)), best] / np.maximum(np.diff(bounds), 1)
            for i, text in enumerate(texts):
                known = bool(held.langs) and any(map(str.isalpha, text))
                preds.append(held.langs[best[i]] if known else UNDETERMINED)
                scores.append(float(min(1.0, top[i])) if known else 0.0)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                names=[*rest, "lang_pred", "score"],
            )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return in_arrow(
        docs.select("doc_id", F.col("text").cast("string").alias("text")),
        _predict(shipped),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    )


def keep_known(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a learned language, in the same columns."""
    rows = carried(docs)
    kind = rows.schema["__row"].dataType.simpleString()
    judge = _predict(docs.sparkSession.sparkContext.broadcast(model))
    judged = in_arrow(
        rows,
        lambda batches: judge(b.select(["text", "__row"]) for b in opened(batches)),
        f"__row {kind}, lang_pred string, score double",
    )
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("__row.*")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))


def op5_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
