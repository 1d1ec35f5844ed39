"""Asset risk profiles over the last year of sessions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.domain import BENCHMARK, PROFILE_MIN_HISTORY, PROFILE_WINDOW, SESSIONS_PER_YEAR
from tickerloom.functions.columns import clean, ratio
from tickerloom.operators.ranks import percentile_rank
from tickerloom.session import cut_lineage

PRICE = "Adj Close"


def calendar(bars: DataFrame) -> DataFrame:
    """All session dates of any ticker with the date of the session before."""
    # distinct dates only: at most one row per calendar day, however many bars there are
    order = Window.partitionBy(F.lit(1)).orderBy("Date")
    return bars.select("Date").distinct().select("Date", F.lag("Date").over(order).alias("previous"))


def session_returns(bars: DataFrame) -> DataFrame:
    """Return against the previous session of the whole market; null after a ticker's gap.

    An equi-join on (ticker, previous date) instead of a window, so no ticker's history
    has to sit on one task.
    """
    prices = bars.select("ticker", "Date", F.col(PRICE).alias("price"))
    dated = prices.join(calendar(bars), "Date")
    before = prices.select("ticker", F.col("Date").alias("previous"), F.col("price").alias("before"))
    return dated.join(before, ["ticker", "previous"]).select(
        "ticker", "Date", (ratio(F.col("price"), F.col("before")) - 1).alias("ret")
    )


def newest(df: DataFrame, n) -> DataFrame:
    """The newest rows per ticker; only the ranked head of each task's rows is shuffled."""
    w = Window.partitionBy("ticker").orderBy(F.desc("Date"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def risk_features(bars: DataFrame) -> DataFrame:
    returns = session_returns(bars).filter(F.col("ret").isNotNull())
    market = returns.filter(F.col("ticker") == BENCHMARK).select("Date", F.col("ret").alias("market"))
    pairs = newest(returns.join(market, "Date"), PROFILE_WINDOW)
    stats = pairs.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("history_days"),
        (F.stddev_samp("ret") * math.sqrt(SESSIONS_PER_YEAR)).alias("volatility"),
        ratio(F.covar_samp("ret", "market"), F.var_samp("market")).alias("beta"),
    )
    everyone = bars.select("ticker").distinct()
    stats = everyone.join(stats, "ticker", "left").withColumn("history_days", F.coalesce("history_days", F.lit(0)))
    enough = F.col("history_days") >= PROFILE_MIN_HISTORY

    recent = newest(
        bars.select("ticker", "Date", F.col(PRICE).alias("price"), "Close", "Dividends"), PROFILE_WINDOW + 1
    )
    window_prices = recent.filter(F.col("price").isNotNull()).join(stats.select("ticker", "history_days"), "ticker")
    window_prices = window_prices.filter(F.col("_rn") <= F.col("history_days") + 1)
    up_to = Window.partitionBy("ticker").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    fall = window_prices.withColumn("fall", ratio(F.col("price"), F.max("price").over(up_to)) - 1)
    drawdown = fall.groupBy("ticker").agg(F.min("fall").alias("drawdown"))

    own = recent.filter(F.col("_rn") <= PROFILE_WINDOW)
    payout = own.groupBy("ticker").agg(
        ratio(F.sum("Dividends"), F.nullif(F.max_by("Close", "Date"), F.lit(0.0))).alias("yield")
    )
    out = stats.join(drawdown, "ticker", "left").join(payout, "ticker", "left")
    return out.select(
        "ticker",
        *[
            F.when(enough, clean(F.col(source))).alias(name)
            for name, source in (
                ("volatility_1y", "volatility"),
                ("beta", "beta"),
                ("max_drawdown_1y", "drawdown"),
                ("dividend_yield", "yield"),
            )
        ],
        "history_days",
    )


def asset_profiles(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Universe metadata (typed, without index rows) plus the nested risk object."""
    bars = cut_lineage(bars)
    latest = bars.groupBy("ticker").agg(F.max("Date").alias("as_of"))
    assets = read_universe(universe).join(latest, "ticker")
    # one row per asset, read three times by the rank below
    risk = cut_lineage(assets.join(risk_features(bars), "ticker", "left"))
    ranked = percentile_rank(risk, "volatility_1y", "_rank").withColumn("volatility_rank", clean(F.col("_rank"), 4))
    fields = ["volatility_1y", "beta", "max_drawdown_1y", "dividend_yield", "history_days", "volatility_rank"]
    return ranked.select(*assets.columns, F.struct(*fields).alias("risk"))


def read_universe(universe: DataFrame) -> DataFrame:
    """Typed universe: no index rows, themes split, flags read without case."""

    def flag(name: str):
        return F.lower(F.col(name)) == "true"

    return universe.filter(F.col("asset_type") != "index").select(
        "ticker",
        "name",
        "asset_type",
        F.when(F.col("category") != "", F.col("category")).alias("category"),
        "sector",
        F.filter(F.split("themes", r"\|"), lambda t: t != "").alias("themes"),
        flag("recommendation_eligible").alias("recommendation_eligible"),
        flag("forecast_eligible").alias("forecast_eligible"),
        F.when(F.col("history_note") != "", F.col("history_note")).alias("history_note"),
    )
