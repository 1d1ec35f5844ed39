"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.domain import MACRO_FEATURES
from tickerloom.functions.columns import ratio


def macro_points(macro: DataFrame) -> DataFrame:
    """(series_id, available_date, value) with the price index as 12-observation change in percent."""
    by_observation = Window.partitionBy("series_id").orderBy("observation_date")
    yoy = (ratio(F.col("value"), F.lag("value", 12).over(by_observation)) - 1) * 100
    valued = macro.withColumn("_v", F.when(F.col("series_id") == "CPIAUCSL", yoy).otherwise(F.col("value")))
    # of several observations available on one day the latest observation counts
    return valued.groupBy("series_id", "available_date").agg(F.max_by("_v", "observation_date").alias("value"))


def validity(points: DataFrame, horizon: DataFrame) -> DataFrame:
    """Each non-null value with the last day it is still the newest known one.

    ``horizon`` holds one column ``last_day``; open ends stop there.
    """
    w = Window.partitionBy("series_id").orderBy("available_date")
    last_day = horizon.scalar()
    return points.filter(F.col("value").isNotNull()).select(
        "series_id",
        F.col("available_date").alias("valid_from"),
        F.coalesce(F.date_sub(F.lead("available_date").over(w), 1), F.greatest(F.col("available_date"), last_day)).alias(
            "valid_to"
        ),
        "value",
    )


def macro_days(macro: DataFrame, bars: DataFrame) -> DataFrame:
    """Wide macro context for every calendar day: newest value known on that day, per feature.

    Values spread over the days they are valid for, so the backward as-of join onto any
    number of bars becomes a plain equi-join on Date.  The day table is bounded by the
    calendar (one row per day), not by the number of tickers.
    """
    horizon = bars.select(F.max("Date").alias("last_day"))
    spans = validity(macro_points(macro), horizon)
    days = spans.select(F.explode(F.sequence("valid_from", "valid_to")).alias("Date"), "series_id", "value")
    return days.groupBy("Date").agg(
        *[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(n) for s, n in MACRO_FEATURES.items()]
    )


def asof_backward(left: DataFrame, right: DataFrame, on: str, keys: list[str], value: str, bucket_days: int = 365) -> DataFrame:
    """Inclusive backward as-of join on a date column, keyed, with bounded partitions.

    Rows of both sides meet per (key, period).  The newest value before a period is carried
    in from a small per-period table, so no task sees more than one period of one key.
    """
    period = F.floor(F.datediff(F.col(on), F.lit("1970-01-01").cast("date")) / bucket_days)
    known = right.filter(F.col(value).isNotNull()).select(*keys, on, F.col(value).alias("_value"), period.alias("_p"))
    closing = known.groupBy(*keys, "_p").agg(F.max_by("_value", on).alias("_close"))
    both = (
        left.withColumn("_p", period)
        .withColumn("_value", F.lit(None).cast(known.schema["_value"].dataType))
        .withColumn("_is_left", F.lit(1))
        .unionByName(known.withColumn("_is_left", F.lit(0)), allowMissingColumns=True)
    )
    w = Window.partitionBy(*keys, "_p").orderBy(on, "_is_left").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(w)).filter("_is_left = 1")
    periods = inside.select(*keys, "_p").distinct().withColumn("_close", F.lit(None).cast(known.schema["_value"].dataType))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    timeline = periods.unionByName(closing).groupBy(*keys, "_p").agg(F.max("_close").alias("_close"))
    carried = timeline.withColumn("_carry", F.last("_close", ignorenulls=True).over(before)).select(*keys, "_p", "_carry")
    return (
        inside.join(carried, [*keys, "_p"], "left")
        .withColumn(value, F.coalesce("_seen", "_carry"))
        .select(*left.columns, value)
    )


def visible_facts(facts: DataFrame, as_of: str) -> DataFrame:
    """Newest filing of every (ticker, concept, start, end) known at ``as_of``; later record wins ties."""
    order = F.struct("filed", "ingest_seq")
    return (
        facts.filter(F.col("filed") <= F.lit(as_of).cast("date"))
        .groupBy("ticker", "concept", "start", "end")
        .agg(F.max_by("val", order).alias("val"), F.max("filed").alias("filed"))
    )
