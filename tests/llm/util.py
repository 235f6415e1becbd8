"""Small tables with every kind of odd row."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of a table.
CLASH = ("h", "sid", "task", "ids", "score", "lang_pred", "__row", "digest", "dups", "kept", "shard", "label", "n")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def prose(seed, n):
    r = random.Random(seed)
    syllables = ("ba", "do", "ke", "lu", "mi", "no", "pa", "ri", "so", "tu", "vex", "zan")
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, rows, schema=DOCS):
    """rows of (doc_id, text[, lang[, source]])."""
    full = [(*r, *([None] * (4 - len(r))), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, schema)


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


def store(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "one"),
    (5, "One  two\nTHREE four"),
    (6, prose(1, 200)),
    (6, prose(1, 200)),
    (7, prose(1, 200).upper()),
    (8, "é ß Ａ 日本語 \U0001f600 ½ İstanbul"),
    (9, prose(2, 30_000)),
    (10, "x" * 50_000),
    (None, prose(3, 80)),
    (None, None),
    (11, "same " * 300),
]
