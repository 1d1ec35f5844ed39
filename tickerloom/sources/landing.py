"""Landing transforms of market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.domain import BAR_SCHEMA


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Landed rows to the bar schema.

    The exchange's own calendar date is kept: the zone offset is cut off, never converted.
    """
    stamp = F.coalesce(*[F.col(c).cast("string") for c in ("Datetime", "Date") if c in raw.columns])
    extra = [c for c in raw.columns if c == "ingest_seq"]
    have = set(raw.columns)

    def number(name: str):
        value = F.col(f"`{name}`") if name in have else F.lit(None)
        value = value.cast("double")
        return F.coalesce(value, F.lit(0.0)) if name in ("Dividends", "Stock Splits") else value

    return raw.select(
        F.to_date(F.substring(stamp, 1, 10)).alias("Date"),
        F.col("ticker"),
        *[number(f.name).alias(f.name) for f in BAR_SCHEMA.fields[2:]],
        *extra,
    )


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row per key, the one that arrived last.

    A max over an order struct combines map-side, so copies of a hot key collapse before
    the shuffle; null keys group together as equal values.
    """
    rest = [c for c in df.columns if c not in keys and c != sequence]
    packed = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(sequence)).alias("_kept")
    )
    return packed.select(*[F.col(f"`{k}`") for k in keys], "_kept.*")


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One whole row per key: the first in the given order (ranked, for orders that need nulls or text)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def completed_sessions(bars: DataFrame, start: str, cutoff: str) -> DataFrame:
    """Bars inside the inclusive date range; raises when there is none."""
    kept = bars.filter(F.col("Date").between(F.lit(start).cast("date"), F.lit(cutoff).cast("date")))
    return require_rows(kept, f"No completed sessions between {start} and {cutoff}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when ``df`` is empty, else give it back."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def raw_bars_standin(bars: DataFrame) -> DataFrame:
    """Bars as they land: zoned text stamps, missing payouts, a superseded copy per row."""
    landed = bars.withColumn("Datetime", F.concat(F.col("Date").cast("string"), F.lit(" 00:00:00-05:00"))).drop("Date")
    payout = [F.when(F.col(f"`{c}`") != 0, F.col(f"`{c}`")).alias(c) for c in ("Dividends", "Stock Splits")]
    others = [F.col(f"`{c}`") for c in landed.columns if c not in ("Dividends", "Stock Splits")]
    final = landed.select(*others, *payout, F.lit(2).alias("ingest_seq"))
    earlier = final.withColumn("Close", F.col("Close") * 2).withColumn("ingest_seq", F.lit(1))
    return earlier.unionByName(final)
