"""Macro series: landing, availability dates, quarter calendars, vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.domain import MACRO_LAG_DAYS
from tickerloom.operators.blocks import block_window, halo_blocks, own_rows, session_numbers
from tickerloom.sources.landing import keep_last

SERIES_FILES = {"DFF": "DFF.csv", "CPIAUCSL": "CPIAUCSL.csv", "DGS10": "DGS10.csv", "VIXCLS": "VIXCLS.csv"}
# rows of file order that are numbered together
FILE_ROWS = 100_000


def read_macro_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Four two-column CSVs as (series_id, observation_date text, value text); headers must match."""
    frames = []
    for series, file in SERIES_FILES.items():
        path = f"{folder}/{file}"
        header = spark.read.text(path).first()
        expected = f"observation_date,{series}"
        if header is None or header[0].lstrip("﻿").strip() != expected:
            raise ValueError(f"{file} must have the header {expected}")
        frame = spark.read.csv(path, header=True, schema="observation_date string, value string", enforceSchema=True)
        frames.append(frame.select(F.lit(series).alias("series_id"), "observation_date", "value"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def macro_violations(rows: DataFrame, sequence: str) -> DataFrame:
    """(series_id, observation_date, kind) of every row of an import that must be refused.

    ``invalid_date``: each row whose date does not parse.  ``duplicate_date``: each date a series has more than once.
    ``unsorted_date``: each row dated before the row ahead of it by ``sequence``; next to a date that does not parse nothing is compared.
    """
    dated = rows.select("series_id", "observation_date", sequence, F.expr("try_cast(observation_date AS date)").alias("_d"))
    text = F.col("_d").cast("string").alias("observation_date")
    bad = dated.filter(F.col("_d").isNull()).select("series_id", "observation_date", F.lit("invalid_date").alias("kind"))
    repeated = dated.filter(F.col("_d").isNotNull()).groupBy("series_id", "_d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bad.unionByName(repeated.select("series_id", text, F.lit("duplicate_date").alias("kind"))).unionByName(
        unsorted_dates(dated, sequence).select("series_id", text, F.lit("unsorted_date").alias("kind"))
    )


def unsorted_dates(dated: DataFrame, sequence: str) -> DataFrame:
    """Rows whose ``_d`` is earlier than that of the row before, in blocks of file order, so no series is one task."""
    numbered = session_numbers(dated, "series_id", sequence, period=F.floor(F.col(sequence) / FILE_ROWS))
    blocks = halo_blocks(numbered, "series_id", sequence, back=1)
    before = F.lag("_d").over(block_window("series_id", sequence))
    return own_rows(blocks.withColumn("_before", before)).filter(F.col("_d") < F.col("_before"))


def import_macro_checked(rows: DataFrame, sequence: str) -> DataFrame:
    """``import_macro`` of rows without a violation; the first few violations are named otherwise."""
    found = macro_violations(rows, sequence).limit(5).collect()
    if found:
        raise ValueError("Macro import refused: " + "; ".join(f"{r.series_id} {r.observation_date} {r.kind}" for r in found))
    return import_macro(rows)


def import_macro(rows: DataFrame) -> DataFrame:
    """Typed observations with their proxy availability date.

    Bad numbers become null; null values are dropped except for the price index, whose
    gaps must keep their place in the 12-observation change.
    """
    lag = F.element_at(F.create_map(*[F.lit(x) for kv in MACRO_LAG_DAYS.items() for x in kv]), F.col("series_id"))
    typed = rows.select(
        "series_id",
        F.col("series_id").alias("series_name"),
        F.when(F.col("series_id") == "CPIAUCSL", "monthly").otherwise("daily").alias("frequency"),
        F.to_date("observation_date").alias("observation_date"),
        F.expr("try_cast(value AS double)").alias("value"),
    ).filter(F.col("value").isNotNull() | (F.col("series_id") == "CPIAUCSL"))
    return typed.select(
        "*",
        F.date_add("observation_date", lag).alias("available_date"),
        F.lit(None).cast("date").alias("realtime_end"),
    )


def macro_vintages(observations: DataFrame) -> DataFrame:
    """First releases (date, realtime_start, value text) as observation/available pairs, last copy kept."""
    typed = observations.select(
        "series_id",
        F.to_date("date").alias("observation_date"),
        F.to_date("realtime_start").alias("available_date"),
        F.expr("try_cast(value AS double)").alias("value"),
        "ingest_seq",
    ).filter(F.col("value").isNotNull())
    return keep_last(typed, ["series_id", "observation_date", "available_date"], "ingest_seq")


def quarter_ranges(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive calendar-quarter chunks of each half-open [start, end) range."""
    last = F.date_sub(F.col(end), 1)
    quarters = F.sequence(F.trunc(start, "quarter").cast("date"), F.trunc(last, "quarter").cast("date"), F.expr("interval 3 months"))
    out = ranges.filter(F.col(start) < F.col(end)).withColumn("_q", F.explode(quarters))
    return out.select(
        *[c for c in ranges.columns if c not in (start, end)],
        F.greatest(F.col(start), F.col("_q")).alias("chunk_start"),
        F.least(last, F.last_day(F.add_months("_q", 2))).alias("chunk_end"),
    )
