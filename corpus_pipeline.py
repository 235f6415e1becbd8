"""The corpus pipeline: what stays of ``documents``, stage by stage, packed into sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ambler.llm import langid, near_dedup, packing, quality, substring_dedup
from ambler.llm.common import discard, materialize, table


def identify_language(spark, docs, sf_dir):
    """Documents in a language that the labelled ones teach stay."""
    return langid.keep_known(docs, langid.train(langid.training_rows(docs)))


def apply_quality_rules(spark, docs, sf_dir):
    """Documents that pass the word rules and the compression bands stay."""
    return quality.keep_good(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each near-duplicate group stays."""
    return near_dedup.keep_one(docs)


def cut_repeated_passages(spark, docs, sf_dir):
    """Passages that a document of smaller id holds go; n_chars follows the text."""
    done = substring_dedup.dedupe(docs)
    length = F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of sequences of 4096 tokens."""
    return packing.told(packing.pack(docs))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]
#: The language model and compression have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name)
        if docs is not documents:
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
