"""Sharding by rendezvous hashing over weighted shards, in DataFrame functions only.

Every shard draws a score from the record's key alone; the record goes to the
shard with the best one.  A further shard only takes records for which its own
score is best, so growing from n to n + 1 equal shards moves about 1 in n + 1.

Edge cases: a null key is a key like any other (all null keys share a shard); a
null text has size 1 and the checksum of empty text; repeated rows share a shard
and get slots of their own; an empty table gives an empty result; columns beside
the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambler.llm.common import table

SHARDS = 8
#: Slots are counted inside blocks of a shard, by so many hexadecimal digits of a hash:
#: shards x 16**SLOT_DIGITS counts are broadcast at most, whatever the rows.
SLOT_DIGITS = 3
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def draw(key: Column, shard: int) -> Column:
    """Uniform number in (0, 1) from a key and a shard's number."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, _DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard with the least -ln(u) / weight, ties to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    scores = [F.struct((-F.ln(draw(key, i)) / float(w)).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def assign(docs: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``docs`` with its shard; a projection, so nothing is shuffled."""
    return docs.withColumn(shard, shard_of(F.col(key), weights))


def slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Numbers from 0 without gaps inside each shard.

    Rows are numbered inside (shard, block) windows by ``order``, a block being a
    hash of those columns, and block offsets come from pre-aggregated counts.
    """
    told = F.concat_ws("#", *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in order])
    blocked = rows.withColumn("__block", F.substring(F.md5(told), 1, SLOT_DIGITS))
    before = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(shard, "__block")
        .agg(F.count("*").alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(shard, "__block").orderBy(*order)
    numbered = blocked.withColumn("__row", F.row_number().over(inside).cast("long") - 1)
    return (
        numbered.join(F.broadcast(offsets), [shard, "__block"])
        .withColumn(slot, F.col("__base") + F.col("__row"))
        .drop("__block", "__base", "__row")
    )


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, with the shard each would have among 9."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(assign(docs, "doc_id", [1.0] * SHARDS), "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return slots(placed, "shard", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
