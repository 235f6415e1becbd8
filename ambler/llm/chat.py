"""Chat formatting with a finite-state machine over roles, in DataFrame functions only.

A template is data: the two halves of a header around the role's name, a footer, the
roles under the loss flag, and the transitions between states.  ``format_conversations`` emits per conversation the
segments (text, loss flag), their concatenation, and whether the order of turns
is accepted.  In texts and role names a backslash becomes ``\\b``, ``<`` becomes
``\\l`` and ``#`` becomes ``\\h``; so headers and footers, which hold ``#`` or
``<``, never occur inside, and ``parse`` restores texts exactly.

Edge cases: a null text is empty; a null role is the empty role; roles that no
transition names have the same header and footer and lead to the state ``error``;
rows with equal turn numbers are ordered by role, then text; repeated rows stay
as turns of their own; null turn numbers come first; a null conversation id is an
id like any other; an empty table gives an empty result; further columns are not
read.  An invalid order is reported, and the conversation is still formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.llm.common import table

TEMPLATE = {
    "header": ("### ", ": "),
    "footer": " </turn>\n",
    "loss": ["assistant"],
    "start": "start",
    "accept": ["user", "assistant"],
    "transitions": {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
}
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    for raw, coded in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(_ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _role_code(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def _role_of(code: Column) -> Column:
    return unescape(F.replace(code, F.lit("\\c"), F.lit(":")))


def machine(roles: Column, template: dict) -> Column:
    """Final state of the role sequence; ``error`` once no transition fits."""
    moves = F.create_map(
        *[F.lit(x) for (state, role), to in template["transitions"].items() for x in (f"{state}\n{role}", to)]
    )
    return F.aggregate(
        roles,
        F.lit(template["start"]),
        lambda state, role: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("error")),
    )


def format_conversations(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted."""
    open_, close = (F.lit(x) for x in template["header"])
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(open_, _role_code(t["role"]), close).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), t["role"].isin(template["loss"]).alias("loss")),
                F.struct(F.lit(template["footer"]).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    state = machine(F.transform("turns", lambda t: t["role"]), template)
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        state.isin(template["accept"]).alias("valid"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> back from formatted text."""
    open_, close = template["header"]
    parts = F.filter(F.split(formatted, "\\Q" + template["footer"] + "\\E"), lambda p: p.startswith(open_))
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_of(F.substr(F.substring_index(p, close, 1), F.lit(len(open_) + 1))).alias("role"),
            unescape(
                F.substr(p, F.length(F.substring_index(p, close, 1)) + F.lit(len(close) + 1))
            ).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, digested from what the format gives back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    done = format_conversations(rows.unionAll(probe))
    back = done.withColumn("turns", parse(F.col("formatted"))).withColumn("learned", loss_text(F.col("segments")))
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
