"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Seconds per timeframe unit.
UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400}

# Fixed value: numbers above this are milliseconds, others seconds.
MILLIS_ABOVE = 3_000_000_000

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def timeframe_seconds(timeframe: str) -> int:
    """``'5m'`` -> 300.  One parser for every feed; unknown text is an error."""
    m = re.fullmatch(r"([1-9]\d*)([mhd])", timeframe)
    if not m:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return int(m.group(1)) * UNIT_SECONDS[m.group(2)]


def window_duration(timeframe: str) -> str:
    return f"{timeframe_seconds(timeframe)} seconds"


def micros_to_ntz(us: Column) -> Column:
    secs = us.cast("decimal(20,0)") / F.lit(1000000)
    return F.expr(_EPOCH) + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, as a long."""
    days = F.unix_date(ts.cast("date")).cast("long")
    secs = F.hour(ts) * 3600 + F.minute(ts) * 60
    frac = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("long")
    return (days * 86400 + secs) * 1000000 + frac


def epoch_number_to_ntz(raw: Column) -> Column:
    """Seconds or milliseconds, decided per row, fractions kept."""
    scale = F.when(raw > MILLIS_ABOVE, 1000.0).otherwise(1000000.0)
    return micros_to_ntz(F.round(raw * scale).cast("long"))


def bar_of(ts: Column, timeframe: str) -> Column:
    """Start of the epoch-aligned bar that holds ``ts``."""
    return F.window(ts, window_duration(timeframe)).getField("start")
