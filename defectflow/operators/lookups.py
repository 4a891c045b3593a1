"""Joins by key, rankings, and size-checked reads of small tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from defectflow.session import write_and_reread


def bounded_rows(df: DataFrame, max_rows: int):
    """The rows of a small frame, or ``None`` when it has over ``max_rows`` rows.

    ``collect`` on a limit reads a few partitions first and stops as soon as
    it has enough, so finding out that a table is large is cheap.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def bounded_table(df: DataFrame, max_rows: int):
    """``bounded_rows`` of numbers and vectors, as an Arrow table."""
    rows = bounded_rows(df, max_rows)
    if rows is None:
        return None
    return pa.Table.from_pylist([r.asDict(True) for r in rows], schema=to_arrow_schema(df.schema))


def keyed_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Plain join with a table of unique keys in which a null key equals a null key.

    Whether the table is broadcast, and whether hot keys are split, is left to
    the adaptive planner, which knows the sizes in bytes.
    """
    renamed = table.select(*[F.col(c).alias(f"_key_{c}") for c in on], *[c for c in table.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return df.join(renamed, same, how).drop(*[f"_key_{c}" for c in on])


def seeded_key(identifier: Column, seed: int = 42) -> Column:
    """Hex key that orders rows pseudo-randomly and identically everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark cuts every group to ``n`` rows before its shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def numbered(rows: DataFrame, order: list[str], name: str, purpose: str) -> DataFrame:
    """``rows`` as a written table with a dense number from 0 in the given order.

    Rows are cut into ranges; each has its place within its range, and the counts
    of the ranges before it, one number for each partition, are its offset.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_and_reread(placed.withColumn("_at", F.monotonically_increasing_id()), purpose)
    placed = placed.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    offsets, total = [], 0
    for part, count in sorted(map(tuple, placed.groupBy("_part").count().collect())):
        offsets.append((part, total))
        total += count
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    place = F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(table, "_part").select(*rows.columns, place.alias(name))
