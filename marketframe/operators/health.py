"""Service and feed health from log lines and message times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scan import Running, running
from ..functions.storage import materialise
from ..functions.timeutil import ntz_micros

# Text that marks a line as critical.
CRITICAL = [
    "!!! GAP DETECTED !!!",
    "!!! STALE/EMPTY SPREAD !!!",
    "!!! LOW LIQUIDITY/FROZEN",
    "(HIGH LATENCY)",
    "Traceback (most recent call last):",
    "ConnectionError",
    "Rate limit hit",
    "[ERROR]",
]

# Text that makes a line harmless whatever else it holds.
IGNORED = [
    "WinError 10054",
    "Connection reset",
    "Connection aborted",
    "RemoteDisconnected",
    "Authorization for Unified V5 (Auth) failed",
]

SERVICE_SILENCE = 600
FEED_SILENCE = 60


def _any(text: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.contains(p)
    return found


def alerts(lines: DataFrame) -> DataFrame:
    """Critical lines with the first pattern found; ignorable text wins."""
    text = F.col("text")
    which = F.lit(None).cast("string")
    for p in reversed(CRITICAL):
        which = F.when(text.contains(p), p).otherwise(which)
    return lines.filter(_any(text, CRITICAL) & ~_any(text, IGNORED)).withColumn("pattern", which)


def heartbeats(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(F.col("text").contains(pattern))


def silences(
    messages: DataFrame, keys: Sequence[str], limit_seconds: int, until: Column | None = None
) -> DataFrame:
    """Stretches longer than the limit without a message.

    Two messages of one limit-long slot are never a silence apart, so only the
    first and last message of each slot matter; the slots are aggregated map
    side before anything is ordered.  With ``until`` the time from a key's last
    message to it counts too.
    """
    keys = list(keys)
    slot = F.floor(ntz_micros(F.col("ts")) / (limit_seconds * 1_000_000))
    # written once: the log is read once, whatever follows
    slots = materialise(
        messages.groupBy(*keys, slot.alias("_slot")).agg(
            F.min("ts").alias("_from"), F.max("ts").alias("_to")
        ),
        "slots",
    )
    seen = running(
        slots, keys, F.col("_from").cast("date"), ["_slot"],
        [Running("silent_from", "last", F.col("_to"), inclusive=False)],
    ).select(*keys, "silent_from", F.col("_from").alias("silent_to"))
    if until is not None:
        tail = slots.groupBy(*keys).agg(F.max("_to").alias("silent_from")).withColumn(
            "silent_to", until
        )
        seen = seen.unionByName(tail)
    took = (ntz_micros(F.col("silent_to")) - ntz_micros(F.col("silent_from"))) / 1_000_000
    return seen.withColumn("seconds", took).filter(F.col("seconds") > limit_seconds)
