"""Counter-based uniform draws, equal in Spark, numpy and SQL.

A draw depends on (walker, step, channel, seed) alone: never on partitioning,
order or retries.  Every product stays below 2**62, which ANSI mode needs.
"""

from __future__ import annotations

from enum import IntEnum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647
#: Walker numbers below this keep the first sum in 64 bits.
MAX_WALKER = 120_000_000_000
_WALKER, _STEP, _CHANNEL = 73856093, 19349663, 83492791
_MIX = (48271, 69621)


class Channel(IntEnum):
    """Independent streams of one walker and step."""

    SLOT = 0
    STOP = 1
    COIN = 2
    KEY = 3
    ACCEPT = 4
    WEIGHT = 5


def draw(walker: Column, step: Column | int, channel: Column | int, seed: int = 0) -> Column:
    """Uniform integer in [0, M); a channel given as a column holds 64-bit integers."""
    step = F.lit(step) if isinstance(step, int) else step
    fixed = F.lit(channel * _CHANNEL + seed).cast("long")
    h = (walker.cast("long") * _WALKER + step.cast("long") * _STEP + fixed) % M
    for k in _MIX:
        h = ((h * h) % M + h * k) % M
    return h


def draw_numpy(walker: np.ndarray, step, channel: int, seed: int = 0) -> np.ndarray:
    h = (walker.astype(np.int64) * _WALKER + np.int64(step) * _STEP + channel * _CHANNEL + seed) % M
    for k in _MIX:
        h = ((h * h) % M + h * k) % M
    return h


def draw_sql(walker: str, step: str, channel: int, seed: int = 0) -> str:
    """The same draw as an ANSI SQL expression."""
    h = f"((({walker})::bigint * {_WALKER}::bigint + ({step})::bigint * {_STEP}::bigint + {channel * _CHANNEL + seed}::bigint) % {M})"
    for k in _MIX:
        h = f"(((({h}) * ({h})) % {M}::bigint + ({h}) * {k}::bigint) % {M}::bigint)"
    return h
