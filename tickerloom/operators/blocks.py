"""Ordered windows whose partitions stay bounded, whatever the key distribution.

A window partitioned only by ticker puts one ticker's whole history on one task.  The
helpers here number the rows of every key in two steps (counts per key and year, then
row numbers inside a year) and cut each history into blocks.  Every block also receives
a halo: copies of the rows before and after it that its frames need.  Windows run per
(key, block); only the block's own rows are kept afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 2,000 own rows + 800 before + at most 20 after keep (1/0.8)^n inside double range.
BLOCK_ROWS = 2000
# weight left of a value 800 rows back: (25/27)^800 = 2e-27 for the slowest mean used
EMA_HALO = 800


def session_numbers(
    df: DataFrame, key: str, order: str, number: str = "session_no", period: Column | None = None
) -> DataFrame:
    """Row number (from 0) per key in order, without one task per key.

    ``period`` is any coarser value with the same order; the year of a date by default.
    """
    yearly = df.withColumn("_year", F.year(order) if period is None else period)
    counts = yearly.groupBy(key, "_year").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key), F.col("_year"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    in_year = Window.partitionBy(key, "_year").orderBy(order)
    numbered = yearly.withColumn("_rn", F.row_number().over(in_year) - 1)
    return (
        numbered.join(offsets, [key, "_year"])
        .withColumn(number, F.col("_offset") + F.col("_rn"))
        .drop("_year", "_rn", "_offset")
    )


def halo_blocks(
    df: DataFrame, key: str, order: str, back: int, ahead: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows with ``session_no``, ``_block``, ``_pos`` and ``_own``, halo copies included.

    ``_pos`` is the row's position inside its block partition, counted from 0.
    """
    numbered = df if "session_no" in df.columns else session_numbers(df, key, order)
    home = F.floor(F.col("session_no") / block_rows)
    first = F.greatest(F.lit(0), F.floor((F.col("session_no") - ahead) / block_rows))
    last = F.floor((F.col("session_no") + back) / block_rows)
    spread = numbered.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0), F.col("_block") * block_rows - back)
    return (
        spread.withColumn("_own", F.col("_block") == F.col("_home"))
        .withColumn("_pos", (F.col("session_no") - start).cast("int"))
        .drop("_home")
    )


def block_window(key: str, order: str):
    return Window.partitionBy(key, "_block").orderBy(order)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_block", "_pos")


def lead_lag(df: DataFrame, key: str, order: str, back: int, ahead: int, **columns: Column) -> DataFrame:
    """Add offset-window columns; each value is a function of the block window."""
    blocks = halo_blocks(df, key, order, back, ahead)
    w = block_window(key, order)
    return own_rows(blocks.select("*", *[make(w).alias(name) for name, make in columns.items()]))
