"""Exact ranks and order statistics without a single-task sort.

Equal values are counted first (this combines map-side, so one hot value costs nothing).
Distinct values are cut into ranges at approximate quantiles, level by level: each level cuts every range of the one above
into as many again.  There are as many levels as the session's shuffle partitions ask for, so that a range of the last level
is no more than a partition's share of the distinct values, whatever their number.  Only range totals, a fixed number per
range above, are summed in windows, and exact positions are found inside the last ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import cut_lineage, stored_table

RANGES = 64


def levels_for(partitions: int, ranges: int = RANGES) -> int:
    """Levels after which there are at least as many ranges as partitions."""
    levels, reached = 1, ranges
    while reached < partitions:
        levels, reached = levels + 1, reached * ranges
    return levels


def cumulative_counts(df: DataFrame, group: list[str], value: str, ranges: int = RANGES, levels: int | None = None) -> DataFrame:
    """(group, value, n, before, total): copies of each value and how many are smaller."""
    levels = levels or levels_for(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges)
    # read at every level and by the last step, so ``df`` is read once
    keyed = stored_table(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")))
    cuts = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    keys, before = list(group), F.lit(0)
    for level in range(levels):
        own = f"_range{level}"
        # the totals of all ranges above are known already; only the first level adds the group's
        total = [F.sum("n").alias("total")] if level == 0 else []
        bounds = cut_lineage(keyed.groupBy(*keys).agg(F.percentile_approx(value, cuts, 2000).alias("_cuts"), *total))
        keyed = keyed.join(bounds, keys).withColumn(own, F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
        earlier = Window.partitionBy(*keys).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
        starts = keyed.groupBy(*keys, own).agg(F.sum("n").alias("_m"))
        starts = starts.select(*keys, own, F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias(f"_start{level}"))
        keys = [*keys, own]
        keyed = keyed.join(starts, keys)
        before = before + F.col(f"_start{level}")
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    place = keyed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return place.select(*group, value, "n", (before + F.col("_in")).alias("before"), "total")


def order_statistic(df: DataFrame, group: list[str], value: str, rank: Callable[[Column], Column], name: str) -> DataFrame:
    """The value at a 1-based rank per group; ``rank`` maps the count column to the rank."""
    c = cumulative_counts(df, group, value)
    k = rank(F.col("total"))
    return c.filter((F.col("before") < k) & (k <= F.col("before") + F.col("n"))).select(*group, F.col(value).alias(name))


def exact_median(df: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    c = cumulative_counts(df, group, value)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)

    def holds(k: Column) -> Column:
        return (F.col("before") < k) & (k <= F.col("before") + F.col("n"))

    return c.filter(holds(low) | holds(high)).groupBy(*group).agg(F.avg(value).alias(name))


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share rank with averaged ties among non-null values; null values stay null."""
    keyed = df.withColumn("_all", F.lit(1))
    c = cumulative_counts(keyed, ["_all"], value).select(
        F.col(value).alias("_v"), ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias(name)
    )
    return df.join(c, F.col(value) == F.col("_v"), "left").drop("_v")
