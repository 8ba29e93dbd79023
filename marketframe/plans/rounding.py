"""Rounding shared by registered queries and their SQL twins.

Sums differ in the last bits between engines.  A shift smaller than the kept
digits moves values off the exact halves, so both engines round the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHIFT = 3.3e-7


def rnd(col: Column | str, digits: int = 4) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + SHIFT, digits)


def sql_rnd(expr: str, digits: int = 4) -> str:
    return f"round({expr} + {SHIFT}, {digits})"
