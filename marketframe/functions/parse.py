"""Parsing text columns once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def expand(df: DataFrame, parsed: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep`` plus the fields of the struct ``parsed``.

    The optimizer copies a parse expression into every filter that uses one of
    its fields.  A one-row generator keeps it in one place.
    """
    return df.select(*keep, F.inline(F.array(parsed)))
