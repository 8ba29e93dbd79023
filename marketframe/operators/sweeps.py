"""Parameter sets as data: tables of sets, grouped into blocks of bounded size.

Rows meet blocks, not single sets: a block is one row that lists its sets, and its number
belongs to the key of grouped work.  A task then holds the rows of a chunk and the sets of
one block, however many sets there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.joins import small_side_join
from ..functions.storage import materialise

#: Sets that one task evaluates together.
SET_BLOCK = 16

_TYPES = {"int": "int", "float": "double"}


@dataclass(frozen=True)
class Sets:
    """``table`` has a row per block: ``set_block`` and the array ``sets`` of structs."""

    table: DataFrame
    count: int
    blocks: int

    @property
    def numbers(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.blocks - 1))

    def beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` once per block, with its ``set_block`` and ``sets``."""
        return small_side_join(
            rows.withColumn("set_block", F.explode(self.numbers)), self.table, ["set_block"]
        )

    def largest(self, value: Column) -> int:
        """Largest value of an expression over the fields of ``p``."""
        every = self.table.select(F.explode("sets").alias("p"))
        return int(every.agg(F.max(value)).first()[0])


def table_of(spark: SparkSession, sets: Sequence) -> DataFrame:
    """A list of parameter objects as a table; ``set_id`` is the position."""
    kind = type(sets[0])
    columns = ", ".join(f"{f.name} {_TYPES[f.type]}" for f in fields(kind))
    rows = [(k, *[getattr(s, f.name) for f in fields(kind)]) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, f"set_id int, {columns}")


def in_blocks(params: DataFrame, kind: type, size: int = SET_BLOCK) -> Sets:
    """Blocks of a parameter table with ``set_id`` and any fields of ``kind``.

    Missing fields, and nulls, get the default of ``kind``; other columns are ignored.
    ``set_id`` must be unique.  Sets are numbered in one task: a table of sets is short.
    """
    values = [
        (F.coalesce(F.col(f.name), F.lit(f.default)) if f.name in params.columns else F.lit(f.default))
        .cast(_TYPES[f.type])
        .alias(f.name)
        for f in fields(kind)
    ]
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("set_id")) - 1
    numbered = params.select(F.col("set_id").cast("int"), *values).withColumn(
        "set_block", F.floor(number / size).cast("int")
    )
    held = [c for c in numbered.columns if c != "set_block"]
    table = materialise(
        numbered.groupBy("set_block").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("sets")),
        "parameter-sets",
    )
    facts = table.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.size("sets")), F.lit(0)).alias("n")).first()
    if not facts["n"]:
        raise ValueError("a sweep needs at least one parameter set")
    return Sets(table, facts["n"], facts["blocks"])


def literal(sets: Sequence) -> Column:
    """A short list of parameter objects as an array of structs."""
    names = [f.name for f in fields(type(sets[0]))]
    structs = [
        F.struct(F.lit(k).alias("set_id"), *[F.lit(getattr(s, n)).alias(n) for n in names])
        for k, s in enumerate(sets)
    ]
    return F.array(*structs)


def beside(rows: DataFrame, sets, kind: type) -> tuple[DataFrame, int]:
    """``rows`` per block with ``set_block`` and ``sets``, and the number of blocks.

    ``sets`` is a list of parameter objects, a table of them, or ``Sets``.
    """
    if isinstance(sets, Sequence) and len(sets) <= SET_BLOCK:
        return rows.withColumns({"set_block": F.lit(0), "sets": literal(sets)}), 1
    held = as_sets(rows.sparkSession, sets, kind)
    return held.beside(rows), held.blocks


def as_sets(spark: SparkSession, sets, kind: type) -> Sets:
    if isinstance(sets, Sets):
        return sets
    return in_blocks(sets if isinstance(sets, DataFrame) else table_of(spark, sets), kind)


def renamed(params: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under the names that an operator's parameters have."""
    return reduce(lambda df, n: df.withColumnRenamed(*n), names.items(), params)
