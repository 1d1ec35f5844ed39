"""Technical features, labels, market context and relative model inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickerloom.domain import BENCHMARK, HORIZON, SESSIONS_PER_YEAR, VOLATILITY_INDEX
from tickerloom.functions.columns import full_frame, pct_change, ratio, rolling_mean, rolling_std, with_ema
from tickerloom.operators.blocks import EMA_HALO, block_window, halo_blocks, lead_lag, own_rows

PRICE = "Adj Close"

RETAINED = [
    "return_1d",
    "return_5d",
    "return_20d",
    "log_return_1d",
    "rsi_14",
    "rolling_volatility_20",
    "bollinger_position_20",
    "return_1d_lag_1",
    "return_1d_lag_5",
    "return_1d_lag_10",
    "volume_change_1d",
    "volume_ratio_20",
    "spy_return_1d",
    "spy_return_5d",
    "vix_close",
]
TREND = ["sma_5", "sma_20", "sma_50", "sma_200", "ema_12", "ema_26"]
SCALED = ["macd", "macd_signal", "macd_histogram", "atr_14"]
MODEL_INPUTS = (
    RETAINED + [f"price_vs_{n}" for n in TREND] + [f"{n}_relative" for n in SCALED] + ["bollinger_width_relative", "return_10d"]
)
MAY_BE_MISSING = ["rsi_14", "volume_change_1d"]


# --- single feature expressions over an ordered window --------------------------


def adjusted_ohl() -> dict[str, Column]:
    factor = ratio(F.col(PRICE), F.col("Close"))
    return {f"Adj {n}": F.col(n) * factor for n in ("Open", "High", "Low")}


def gain_loss(w: WindowSpec, n: int = 14) -> tuple[Column, Column]:
    change = F.col(PRICE) - F.lag(PRICE, 1).over(w)
    # greatest() skips nulls, so keep the first row's missing change missing
    gain = F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))
    loss = F.when(change.isNotNull(), -F.least(change, F.lit(0.0)))
    return gain, loss


def true_range(w: WindowSpec) -> Column:
    previous = F.lag(PRICE, 1).over(w)
    return F.greatest(
        F.col("Adj High") - F.col("Adj Low"), F.abs(F.col("Adj High") - previous), F.abs(F.col("Adj Low") - previous)
    )


def rsi(avg_gain: Column, avg_loss: Column) -> Column:
    return 100 - ratio(F.lit(100.0), 1 + ratio(avg_gain, F.nullif(avg_loss, F.lit(0.0))))


def rsi_defined(avg_gain: Column, avg_loss: Column) -> Column:
    """RSI with the zero-loss window given its limit: 100, or 50 for a flat window."""
    return (
        F.when((avg_loss == 0) & (avg_gain > 0), F.lit(100.0))
        .when((avg_loss == 0) & (avg_gain == 0), F.lit(50.0))
        .otherwise(rsi(avg_gain, avg_loss))
    )


# --- operators ------------------------------------------------------------------


def technical_features(bars: DataFrame) -> DataFrame:
    """All per-ticker indicators and the 10-session label.

    Every window shares the partitioning (ticker, block) and the order Date, so the
    whole feature set needs one exchange and one sort after the halo copies are made.
    """
    w = block_window("ticker", "Date")
    price, volume = F.col(PRICE), F.col("Volume")
    blocks = halo_blocks(bars, "ticker", "Date", back=EMA_HALO, ahead=HORIZON)

    gain, loss = gain_loss(w)
    step1 = blocks.select(
        "*",
        *[c.alias(n) for n, c in adjusted_ohl().items()],
        *[pct_change(price, w, n).alias(f"return_{n}d") for n in (1, 5, 20)],
        F.ln(ratio(price, F.lag(price, 1).over(w))).alias("log_return_1d"),
        *[rolling_mean(price, w, n).alias(f"sma_{n}") for n in (5, 20, 50, 200)],
        gain.alias("_gain"),
        loss.alias("_loss"),
        rolling_std(price, w, 20).alias("_std20"),
        *[F.lag(price, n).over(w).alias(f"adjusted_close_lag_{n}") for n in (1, 5, 10, 20)],
        pct_change(volume, w, 1).alias("volume_change_1d"),
        rolling_mean(volume, w, 20).alias("volume_sma_20"),
        (ratio(F.lead(price, HORIZON).over(w), price) - 1).alias("target_return_10d"),
    )
    averaged = with_ema(step1, w, "_pos", {f"ema_{n}": (PRICE, n) for n in (12, 26)})
    step2 = averaged.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    middle, std = F.col("sma_20"), F.col("_std20")
    step3 = with_ema(step2, w, "_pos", {"macd_signal": ("macd", 9)}).select(
        "*",
        rsi(rolling_mean(F.col("_gain"), w, 14), rolling_mean(F.col("_loss"), w, 14)).alias("rsi_14"),
        true_range(w).alias("_range"),
        (rolling_std(F.col("return_1d"), w, 20) * math.sqrt(SESSIONS_PER_YEAR)).alias("rolling_volatility_20"),
        middle.alias("bollinger_middle_20"),
        (middle + 2 * std).alias("bollinger_upper_20"),
        (middle - 2 * std).alias("bollinger_lower_20"),
        *[F.lag("return_1d", n).over(w).alias(f"return_1d_lag_{n}") for n in (1, 5, 10)],
        ratio(volume, F.nullif(F.col("volume_sma_20"), F.lit(0.0))).alias("volume_ratio_20"),
    )
    step4 = step3.select(
        "*",
        rolling_mean(F.col("_range"), w, 14).alias("atr_14"),
        (F.col("macd") - F.col("macd_signal")).alias("macd_histogram"),
        ratio(price - F.col("bollinger_lower_20"), F.col("bollinger_upper_20") - F.col("bollinger_lower_20")).alias(
            "bollinger_position_20"
        ),
    )
    return own_rows(step4).drop("_gain", "_loss", "_std20", "_range", "session_no")


def market_context(bars: DataFrame) -> DataFrame:
    """Benchmark close and returns, volatility-index close, one row per date of either."""
    w = block_window("ticker", "Date")
    benchmark = own_rows(
        halo_blocks(bars.filter(F.col("ticker") == BENCHMARK).select("ticker", "Date", PRICE), "ticker", "Date", back=5).select(
            "*",
            pct_change(F.col(PRICE), w, 1).alias("spy_return_1d"),
            pct_change(F.col(PRICE), w, 5).alias("spy_return_5d"),
        )
    ).select("Date", F.col(PRICE).alias("spy_adjusted_close"), "spy_return_1d", "spy_return_5d")
    fear = bars.filter(F.col("ticker") == VOLATILITY_INDEX).select("Date", F.col("Close").alias("vix_close"))
    return benchmark.join(fear, "Date", "outer")


def eligible_metadata(universe: DataFrame) -> DataFrame:
    return universe.filter(F.lower(F.col("forecast_eligible").cast("string")) == "true").select(
        "ticker", "asset_type", "category", "sector"
    )


def feature_dataset(bars: DataFrame, universe: DataFrame, macro_days: DataFrame | None, start_date: str) -> DataFrame:
    """Features + market context + point-in-time macro + metadata for eligible tickers.

    The start-date filter may only act on finished features, because their frames reach
    back; the eligibility filter is per ticker and runs before any window.
    """
    metadata = eligible_metadata(universe)
    featured = technical_features(bars.join(metadata.select("ticker"), "ticker", "left_semi"))
    out = featured.filter(F.col("Date") >= F.lit(start_date).cast("date")).join(market_context(bars), "Date", "left")
    if macro_days is not None:
        out = out.join(macro_days, "Date", "left")
    return out.join(metadata, "ticker", "left").withColumn("is_training_row", F.col("target_return_10d").isNotNull())


def model_inputs(features: DataFrame, bars: DataFrame, as_of: str | None = None) -> DataFrame:
    """Relative, past-only predictors; outcomes after ``as_of`` are censored."""
    w = block_window("ticker", "Date")
    price = F.col(PRICE)
    gain, loss = gain_loss(w)
    raw = halo_blocks(bars.select("ticker", "Date", PRICE, "Volume"), "ticker", "Date", back=20, ahead=HORIZON)
    raw = raw.select("*", gain.alias("_gain"), loss.alias("_loss"))
    derived = own_rows(
        raw.select(
            "ticker",
            "Date",
            "_own",
            "_block",
            "_pos",
            price.alias("source_price"),
            (ratio(F.lead(price, HORIZON).over(w), price) - 1).alias("expected_target"),
            F.lead("Date", HORIZON).over(w).alias("label_end_date"),
            rsi_defined(rolling_mean(F.col("_gain"), w, 14), rolling_mean(F.col("_loss"), w, 14)).alias("corrected_rsi"),
            (ratio(F.col("Volume"), F.nullif(F.lag("Volume", 1).over(w), F.lit(0.0))) - 1).alias("safe_volume_change"),
            pct_change(price, w, 10).alias("return_10d"),
        )
    )
    f = features.join(derived, ["ticker", "Date"], "left")
    if as_of is not None:
        cutoff = F.lit(as_of).cast("date")
        known = F.coalesce(F.col("label_end_date") <= cutoff, F.lit(False))
        f = (
            f.filter(F.col("Date") <= cutoff)
            .withColumn("target_return_10d", F.when(known, F.col("target_return_10d")))
            .withColumn("label_end_date", F.when(known, F.col("label_end_date")))
        )
    f = f.withColumn("rsi_14", F.col("corrected_rsi")).withColumn("volume_change_1d", F.col("safe_volume_change"))
    relative = (
        [(ratio(price, F.col(n)) - 1).alias(f"price_vs_{n}") for n in TREND]
        + [ratio(F.col(n), price).alias(f"{n}_relative") for n in SCALED]
        + [ratio(F.col("bollinger_upper_20") - F.col("bollinger_lower_20"), price).alias("bollinger_width_relative")]
    )
    f = f.select("*", *relative)
    return f.select(
        "Date",
        "ticker",
        *MODEL_INPUTS,
        "target_return_10d",
        "label_end_date",
        F.col("target_return_10d").isNotNull().alias("is_training_row"),
    )


def input_violations(features: DataFrame, bars: DataFrame) -> DataFrame:
    """(kind, ticker, Date) rows that break the input contract; empty means valid."""
    w_target = lead_lag(
        bars.select("ticker", "Date", PRICE),
        "ticker",
        "Date",
        0,
        HORIZON,
        expected_target=lambda w: ratio(F.lead(PRICE, HORIZON).over(w), F.col(PRICE)) - 1,
    ).select("ticker", "Date", F.col(PRICE).alias("source_price"), "expected_target")
    j = features.select("ticker", "Date", PRICE, "target_return_10d", "is_training_row").join(
        w_target, ["ticker", "Date"], "left"
    )
    price_ok = F.abs(F.col(PRICE) - F.col("source_price")) <= 1e-10 + 1e-9 * F.abs(F.col("source_price"))
    target, expected = F.col("target_return_10d"), F.col("expected_target")
    target_ok = (target.isNull() & expected.isNull()) | (F.abs(target - expected) <= 1e-10 + 1e-8 * F.abs(expected))
    kinds = F.array_compact(
        F.array(
            F.when(~F.coalesce(price_ok, F.lit(False)), F.lit("price_mismatch")),
            F.when(~F.coalesce(target_ok, F.lit(False)), F.lit("target_mismatch")),
            F.when(F.col("is_training_row") != expected.isNotNull(), F.lit("training_flag_mismatch")),
        )
    )
    return j.select("ticker", "Date", F.explode(kinds).alias("kind"))


def recomputed_features(bars: DataFrame) -> DataFrame:
    """Second formula set for the audit: running sums and array endpoints, no shared code path."""
    w = block_window("ticker", "Date")
    a = F.col(PRICE)
    blocks = halo_blocks(bars, "ticker", "Date", back=EMA_HALO, ahead=HORIZON)

    def total(value: Column, n: int) -> Column:
        return full_frame(value, F.sum(value), w, n)

    change = a - F.lag(a, 1).over(w)
    base = blocks.select(
        "*",
        (F.col("High") * a / F.col("Close")).alias("_h"),
        (F.col("Low") * a / F.col("Close")).alias("_l"),
        F.lag(a, 1).over(w).alias("_p"),
        F.when(change > 0, change).when(change.isNotNull(), 0.0).alias("_up"),
        F.when(change < 0, -change).when(change.isNotNull(), 0.0).alias("_down"),
        (a / F.lag(a, 1).over(w) - 1).alias("_r1"),
        (total(a, 20) / 20).alias("_m20"),
        full_frame(a, F.var_samp(a), w, 20).alias("_v20"),
    )
    high_low = F.col("_h") - F.col("_l")
    reach = F.when(F.col("_p").isNull(), high_low).otherwise(
        F.greatest(high_low, F.abs(F.col("_h") - F.col("_p")), F.abs(F.col("_l") - F.col("_p")))
    )
    spread = F.sqrt(F.col("_v20"))
    up, down = total(F.col("_up"), 14), total(F.col("_down"), 14)
    out = base.withColumn("_tr", reach).select(
        "ticker",
        "Date",
        "_own",
        "_block",
        "_pos",
        F.col("_r1").alias("return_1d"),
        *[(a / F.lag(a, n).over(w) - 1).alias(f"return_{n}d") for n in (5, 20)],
        F.log1p(F.col("_r1")).alias("log_return_1d"),
        *[(total(a, n) / n).alias(f"sma_{n}") for n in (5, 20, 50, 200)],
        (100 * ratio(up, up + F.nullif(down, F.lit(0.0)))).alias("rsi_14"),
        (total(F.col("_tr"), 14) / 14).alias("atr_14"),
        (F.sqrt(full_frame(F.col("_r1"), F.var_samp("_r1"), w, 20) * SESSIONS_PER_YEAR)).alias("rolling_volatility_20"),
        ratio(a - F.col("_m20") + 2 * spread, 4 * spread).alias("bollinger_position_20"),
        (F.lead(a, HORIZON).over(w) / a - 1).alias("target_return_10d"),
    )
    return own_rows(out)


def plain_ticker_window() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("Date")
