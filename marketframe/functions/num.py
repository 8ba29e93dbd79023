"""Scalar column helpers: zero-safe division, cleaning, tick rounding.

Missing values are NULL everywhere inside the library; NaN and infinities are
turned into NULL where data enters (``finite_or_null``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Largest finite double, used by the model-input sanitiser.
DOUBLE_MAX = 1.7976931348623157e308


def ratio(x: Column, d: Column) -> Column:
    """``x / d`` where a zero denominator counts as one."""
    return x / F.when(d == 0, F.lit(1.0)).otherwise(d)


def ratio_or_null(x: Column, d: Column) -> Column:
    """``x / d``, NULL where the denominator is zero."""
    return x / F.nullif(d, F.lit(0.0))


def finite_or_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def zero_fill_live(x: Column) -> Column:
    """NULL, NaN and both infinities become 0 (mode used on live rows)."""
    return F.coalesce(finite_or_null(x), F.lit(0.0))


def clamp_model_input(x: Column) -> Column:
    """NULL and NaN become 0, infinities the largest finite double."""
    inf = float("inf")
    return (
        F.when(x.isNull() | F.isnan(x), 0.0)
        .when(x == inf, DOUBLE_MAX)
        .when(x == -inf, -DOUBLE_MAX)
        .otherwise(x)
    )


def to_tick(price: Column, tick: Column) -> Column:
    """Nearest multiple of ``tick``, halves to even."""
    return F.round(F.bround(price / tick) * tick, 8)


def to_step(qty: Column, step: Column, minimum: Column) -> Column:
    """Nearest multiple of ``step``; quantities under ``minimum`` are 0."""
    return F.when(qty < minimum, 0.0).otherwise(to_tick(qty, step))


def encode_side(side: Column) -> Column:
    low = F.lower(side)
    return F.when(low == "buy", 1).when(low == "sell", -1).otherwise(0)
