"""A second formulation of every technical feature, for audits: folds and endpoints over one array per block.

A ticker's history is cut into blocks with halo rows (``operators.blocks``), and a block's rows become one array of
bounded length.  Recursive means follow their recursion value by value, rolling figures fold the slice they cover,
lags and labels are array endpoints.  No window function and no running sum is used, so a fault of the
window formulation cannot repeat itself here.

Defined cases: a missing price carries a recursive mean on and its weight decays over the gap; a rolling figure
whose slice holds a missing value, or reaches before the first row, is missing; a zero divisor gives a missing value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.domain import HORIZON, SESSIONS_PER_YEAR
from tickerloom.operators.blocks import BLOCK_ROWS, EMA_HALO, halo_blocks
from tickerloom.operators.features import PRICE

FIELDS = [
    "Adj Open", "Adj High", "Adj Low", "return_1d", "return_5d", "return_20d", "log_return_1d", "sma_5", "sma_20", "sma_50", "sma_200",
    "adjusted_close_lag_1", "adjusted_close_lag_5", "adjusted_close_lag_10", "adjusted_close_lag_20", "volume_change_1d", "volume_sma_20",
    "target_return_10d", "ema_12", "ema_26", "macd", "macd_signal", "rsi_14", "rolling_volatility_20", "bollinger_middle_20",
    "bollinger_upper_20", "bollinger_lower_20", "return_1d_lag_1", "return_1d_lag_5", "return_1d_lag_10", "volume_ratio_20", "atr_14",
    "macd_histogram", "bollinger_position_20",
]


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def recursive_mean(values: Column, span: int) -> Column:
    """The exponential mean of an array at each of its places, by its recursion."""
    a = 2.0 / (span + 1)

    def step(state: Column, x: Column) -> Column:
        last = F.get(state["means"], F.size(state["means"]) - 1)
        old = state["weight"] * (1.0 - a)
        mean = F.when(x.isNull(), last).when(last.isNull(), x).otherwise((old * last + a * x) / (old + a))
        return F.struct(F.when(x.isNull(), old).otherwise(1.0).alias("weight"), F.concat(state["means"], F.array(mean)).alias("means"))

    start = F.struct(F.lit(1.0).alias("weight"), F.array().cast("array<double>").alias("means"))
    return F.aggregate(values, start, step, lambda s: s["means"])


def rolling(values: Column, n: int) -> Column:
    """The mean of the last ``n`` values at each place of an array."""
    total = lambda i: F.aggregate(F.slice(values, i - n + 2, n), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.col("_at"), lambda i: F.when(i >= n - 1, total(i) / n))


def spread(values: Column, means: Column, n: int) -> Column:
    """The sample deviation of the last ``n`` values around their known mean."""
    square = lambda i: F.aggregate(F.slice(values, i - n + 2, n), F.lit(0.0), lambda s, x: s + (x - F.get(means, i)) * (x - F.get(means, i)))
    return F.transform(F.col("_at"), lambda i: F.when(i >= n - 1, F.sqrt(square(i) / (n - 1))))


def each(make) -> Column:
    return F.transform(F.col("_at"), make)


def shifted(values: Column, n: int) -> Column:
    return each(lambda i: F.get(values, i - n))


def change(values: Column, n: int) -> Column:
    return each(lambda i: over(F.get(values, i) - F.get(values, i - n), F.get(values, i - n)))


def folded_features(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ticker, Date, all of ``FIELDS``) of every bar; one array of at most ``block_rows`` + halo rows per block."""
    blocks = halo_blocks(bars.select("ticker", "Date", "Open", "High", "Low", "Close", PRICE, "Volume"), "ticker", "Date", EMA_HALO, HORIZON, block_rows)
    row = F.struct("_pos", "Date", "_own", "Open", "High", "Low", "Close", F.col(PRICE).alias("price"), F.col("Volume").cast("double").alias("volume"))
    arrays = blocks.groupBy("ticker", "_block").agg(F.sort_array(F.collect_list(row)).alias("r"))
    p, v, r1, m20, s20, tr = (F.col(n) for n in ("_price", "_volume", "return_1d", "sma_20", "_s20", "_range"))
    scaled = lambda n: F.transform("r", lambda x: over(x[n] * x["price"], x["Close"]))
    steps = [
        {"_at": F.sequence(F.lit(0), F.size("r") - 1), "_price": F.col("r.price"), "_volume": F.col("r.volume")} | {f"Adj {n}": scaled(n) for n in ("Open", "High", "Low")},
        {f"return_{n}d": change(p, n) for n in (1, 5, 20)}
        | {f"sma_{n}": rolling(p, n) for n in (5, 20, 50, 200)}
        | {f"ema_{n}": recursive_mean(p, n) for n in (12, 26)}
        | {
            "volume_sma_20": rolling(v, 20),
            "_up": each(lambda i: F.when(F.get(p, i) > F.get(p, i - 1), F.get(p, i) - F.get(p, i - 1)).when(F.get(p, i) <= F.get(p, i - 1), 0.0)),
            "_down": each(lambda i: F.when(F.get(p, i) < F.get(p, i - 1), F.get(p, i - 1) - F.get(p, i)).when(F.get(p, i) >= F.get(p, i - 1), 0.0)),
            "_range": each(
                lambda i: F.greatest(
                    F.get(F.col("Adj High"), i) - F.get(F.col("Adj Low"), i),
                    F.abs(F.get(F.col("Adj High"), i) - F.get(p, i - 1)),
                    F.abs(F.get(F.col("Adj Low"), i) - F.get(p, i - 1)),
                )
            ),
        },
        {"macd": F.zip_with("ema_12", "ema_26", lambda a, b: a - b), "_s20": spread(p, m20, 20), "_m1": rolling(r1, 20), "_gain": rolling(F.col("_up"), 14), "_loss": rolling(F.col("_down"), 14)},
        {"macd_signal": recursive_mean(F.col("macd"), 9), "_s1": spread(r1, F.col("_m1"), 20)},
        {
            "log_return_1d": each(lambda i: F.ln(F.get(p, i)) - F.ln(F.get(p, i - 1))),
            "volume_change_1d": change(v, 1),
            "target_return_10d": change_ahead(p, HORIZON),
            "rsi_14": F.zip_with("_gain", "_loss", lambda g, x: F.when(x != 0, 100 * over(g, g + x))),
            "rolling_volatility_20": F.transform("_s1", lambda s: s * math.sqrt(SESSIONS_PER_YEAR)),
            "bollinger_middle_20": m20,
            "bollinger_upper_20": F.zip_with(m20, s20, lambda m, s: m + 2 * s),
            "bollinger_lower_20": F.zip_with(m20, s20, lambda m, s: m - 2 * s),
            "bollinger_position_20": each(lambda i: over(F.get(p, i) - F.get(m20, i) + 2 * F.get(s20, i), 4 * F.get(s20, i))),
            "volume_ratio_20": F.zip_with(v, "volume_sma_20", over),
            "atr_14": rolling(tr, 14),
            "macd_histogram": F.zip_with("macd", "macd_signal", lambda a, b: a - b),
        }
        | {f"adjusted_close_lag_{n}": shifted(p, n) for n in (1, 5, 10, 20)}
        | {f"return_1d_lag_{n}": shifted(r1, n) for n in (1, 5, 10)},
    ]
    out = arrays
    for columns in steps:
        out = out.withColumns(columns)
    zipped = F.arrays_zip(F.col("r.Date").alias("Date"), F.col("r._own").alias("_own"), *[F.col(n) for n in FIELDS])
    return out.select("ticker", F.inline(F.filter(zipped, lambda x: x["_own"]))).drop("_own")


def change_ahead(values: Column, n: int) -> Column:
    return each(lambda i: over(F.get(values, i + n) - F.get(values, i), F.get(values, i)))
