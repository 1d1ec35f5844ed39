"""Market data: landing, features, label, market context, model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import features as fe
from tickerloom.plans.catalog import query, r
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.session import cut_lineage
from tickerloom.sources import landing, standins

W = "(PARTITION BY ticker ORDER BY d)"


def roll(fn: str, col: str, n: int) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {fn}({col}) {frame} END"


def pct(col: str, n: int) -> str:
    return f"{col} / nullif(lag({col}, {n}) OVER {W}, 0) - 1"


cte(
    "step1",
    ["bars"],
    f"""
    SELECT ticker, d, o, h, l, c, ac, v, o * (ac / nullif(c, 0)) AS ao, h * (ac / nullif(c, 0)) AS ah, l * (ac / nullif(c, 0)) AS al,
           row_number() OVER {W} AS rn, lag(ac) OVER {W} AS pac, {pct('ac', 1)} AS r1, {pct('ac', 5)} AS r5, {pct('ac', 20)} AS r20,
           ln(ac / nullif(lag(ac) OVER {W}, 0)) AS lr1, {pct('v', 1)} AS vc1,
           lead(ac, 10) OVER {W} / nullif(ac, 0) - 1 AS target, lead(d, 10) OVER {W} AS label_end, ac / nullif(lag(ac, 10) OVER {W}, 0) - 1 AS r10,
           lag(v) OVER {W} AS pv
    FROM bars""",
)
cte(
    "step2",
    ["step1"],
    f"""
    SELECT *, {roll('avg', 'ac', 5)} AS sma_5, {roll('avg', 'ac', 20)} AS sma_20, {roll('avg', 'ac', 50)} AS sma_50, {roll('avg', 'ac', 200)} AS sma_200,
           {roll('stddev_samp', 'ac', 20)} AS sd20, {roll('stddev_samp', 'r1', 20)} * sqrt(252) AS vol20, {roll('avg', 'v', 20)} AS vsma,
           CASE WHEN ac - pac > 0 THEN ac - pac WHEN pac IS NOT NULL THEN 0.0 END AS gain, CASE WHEN ac - pac < 0 THEN pac - ac WHEN pac IS NOT NULL THEN 0.0 END AS loss,
           greatest(ah - al, abs(ah - pac), abs(al - pac)) AS tr,
           lag(ac, 1) OVER {W} AS l1, lag(ac, 5) OVER {W} AS l5, lag(ac, 10) OVER {W} AS l10, lag(ac, 20) OVER {W} AS l20,
           lag(r1, 1) OVER {W} AS rl1, lag(r1, 5) OVER {W} AS rl5, lag(r1, 10) OVER {W} AS rl10
    FROM step1""",
)
cte(
    "step3",
    ["step2"],
    f"""
    SELECT *, {roll('avg', 'gain', 14)} AS ag, {roll('avg', 'loss', 14)} AS al14, {roll('avg', 'tr', 14)} AS atr,
           sma_20 + 2 * sd20 AS bup, sma_20 - 2 * sd20 AS blo, v / nullif(vsma, 0) AS vr20
    FROM step2""",
)
# exponential means by explicit weights over the last 600 rows; older weights are below 1e-19
cte(
    "means",
    ["step1"],
    """
    SELECT a.ticker, a.d, a.rn,
           sum(CASE WHEN b.rn = 1 THEN pow(1 - 2.0::DOUBLE / 13, a.rn - 1) ELSE 2.0::DOUBLE / 13 * pow(1 - 2.0::DOUBLE / 13, a.rn - b.rn) END * b.ac) AS ema_12,
           sum(CASE WHEN b.rn = 1 THEN pow(1 - 2.0::DOUBLE / 27, a.rn - 1) ELSE 2.0::DOUBLE / 27 * pow(1 - 2.0::DOUBLE / 27, a.rn - b.rn) END * b.ac) AS ema_26
    FROM step1 a JOIN step1 b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 600 AND a.rn GROUP BY 1, 2, 3""",
)
cte(
    "signals",
    ["means"],
    """
    SELECT a.ticker, a.d, any_value(a.ema_12) AS ema_12, any_value(a.ema_26) AS ema_26, any_value(a.ema_12 - a.ema_26) AS macd,
           sum(CASE WHEN b.rn = 1 THEN pow(0.8::DOUBLE, a.rn - 1) ELSE 0.2::DOUBLE * pow(0.8::DOUBLE, a.rn - b.rn) END * (b.ema_12 - b.ema_26)) AS macd_signal
    FROM means a JOIN means b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 200 AND a.rn GROUP BY 1, 2""",
)
cte(
    "context",
    ["step1"],
    """
    SELECT coalesce(s.d, x.d) AS d, s.ac AS spy, s.r1 AS spy1, s.r5 AS spy5, x.c AS vix
    FROM (SELECT * FROM step1 WHERE ticker = 'SPY') s FULL JOIN (SELECT d, c FROM bars WHERE ticker = '^VIX') x ON s.d = x.d""",
)
cte("eligible", ["universe"], "SELECT ticker, asset_type, category, sector FROM universe WHERE fc")


@query(
    "bars_landing_keep_last",
    with_ctes("bars")
    + """SELECT ticker, CAST(d AS VARCHAR) AS "Date", o AS "Open", h AS "High", l AS "Low", c AS "Close", ac AS "Adj Close", v AS "Volume", dv AS "Dividends", sp AS "Stock Splits" FROM bars""",
)
def bars_landing(spark, sf):
    raw = landing.raw_bars_standin(standins.bars(spark, sf))
    return landing.keep_last(landing.normalize_bars(raw), ["ticker", "Date"], "ingest_seq").withColumn(
        "Date", F.col("Date").cast("string")
    )


@query(
    "completed_sessions",
    with_ctes("bars")
    + "SELECT ticker, count(*) AS sessions, CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date FROM bars WHERE d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1",
)
def completed(spark, sf):
    df = landing.completed_sessions(standins.bars(spark, sf), "1996-01-01", "2000-12-31")
    return df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min("Date").cast("string").alias("first_date"),
        F.max("Date").cast("string").alias("last_date"),
    )


def _features(spark, sf, *columns):
    f = fe.technical_features(standins.bars(spark, sf))
    return f.select("ticker", F.col("Date").cast("string").alias("Date"), *columns)


KEY = 'ticker, CAST(d AS VARCHAR) AS "Date"'


@query(
    "feature_adjusted_prices",
    with_ctes("step1") + f'SELECT {KEY}, round(ao, 4) AS "Adj Open", round(ah, 4) AS "Adj High", round(al, 4) AS "Adj Low" FROM step1',
)
def adjusted(spark, sf):
    return _features(spark, sf, r("Adj Open", 4), r("Adj High", 4), r("Adj Low", 4))


@query(
    "feature_returns",
    with_ctes("step2")
    + f"""SELECT {KEY}, round(r1, 8) AS return_1d, round(r5, 8) AS return_5d, round(r20, 8) AS return_20d, round(lr1, 8) AS log_return_1d,
          round(rl1, 8) AS return_1d_lag_1, round(rl5, 8) AS return_1d_lag_5, round(rl10, 8) AS return_1d_lag_10 FROM step2""",
)
def returns(spark, sf):
    names = ["return_1d", "return_5d", "return_20d", "log_return_1d", "return_1d_lag_1", "return_1d_lag_5", "return_1d_lag_10"]
    return _features(spark, sf, *[r(n, 8) for n in names])


@query(
    "feature_moving_averages",
    with_ctes("step2") + f"SELECT {KEY}, round(sma_5, 4) AS sma_5, round(sma_20, 4) AS sma_20, round(sma_50, 4) AS sma_50, round(sma_200, 4) AS sma_200 FROM step2",
)
def moving_averages(spark, sf):
    return _features(spark, sf, *[r(f"sma_{n}", 4) for n in (5, 20, 50, 200)])


@query(
    "feature_exponential_macd",
    with_ctes("signals")
    + f"""SELECT {KEY}, round(ema_12, 4) AS ema_12, round(ema_26, 4) AS ema_26, round(macd, 5) AS macd, round(macd_signal, 5) AS macd_signal,
          round(macd - macd_signal, 5) AS macd_histogram FROM signals""",
)
def exponential(spark, sf):
    return _features(
        spark, sf, r("ema_12", 4), r("ema_26", 4), r("macd", 5), r("macd_signal", 5), r("macd_histogram", 5)
    )


@query(
    "feature_rsi_atr",
    with_ctes("step3") + f"SELECT {KEY}, round(100 - 100 / (1 + ag / nullif(al14, 0)), 5) AS rsi_14, round(atr, 5) AS atr_14 FROM step3",
)
def rsi_atr(spark, sf):
    return _features(spark, sf, r("rsi_14", 5), r("atr_14", 5))


@query(
    "feature_volatility_bands",
    with_ctes("step3")
    + f"""SELECT {KEY}, round(vol20, 6) AS rolling_volatility_20, round(sma_20, 4) AS bollinger_middle_20, round(bup, 4) AS bollinger_upper_20,
          round(blo, 4) AS bollinger_lower_20, round((ac - blo) / nullif(bup - blo, 0), 6) AS bollinger_position_20 FROM step3""",
)
def bands(spark, sf):
    return _features(
        spark,
        sf,
        r("rolling_volatility_20"),
        r("bollinger_middle_20", 4),
        r("bollinger_upper_20", 4),
        r("bollinger_lower_20", 4),
        r("bollinger_position_20"),
    )


@query(
    "feature_lags_volume",
    with_ctes("step3")
    + f"""SELECT {KEY}, round(l1, 4) AS adjusted_close_lag_1, round(l5, 4) AS adjusted_close_lag_5, round(l10, 4) AS adjusted_close_lag_10,
          round(l20, 4) AS adjusted_close_lag_20, round(vc1, 6) AS volume_change_1d, round(vsma, 4) AS volume_sma_20, round(vr20, 6) AS volume_ratio_20 FROM step3""",
)
def lags_volume(spark, sf):
    lags = [r(f"adjusted_close_lag_{n}", 4) for n in (1, 5, 10, 20)]
    return _features(spark, sf, *lags, r("volume_change_1d"), r("volume_sma_20", 4), r("volume_ratio_20"))


@query("label_10_sessions", with_ctes("step1") + f"SELECT {KEY}, round(target, 8) AS target_return_10d FROM step1")
def label(spark, sf):
    return _features(spark, sf, r("target_return_10d", 8))


@query(
    "market_context",
    with_ctes("context")
    + """SELECT CAST(d AS VARCHAR) AS "Date", round(spy, 4) AS spy_adjusted_close, round(spy1, 8) AS spy_return_1d, round(spy5, 8) AS spy_return_5d, round(vix, 4) AS vix_close FROM context""",
)
def market_context(spark, sf):
    m = fe.market_context(standins.bars(spark, sf))
    return m.select(
        F.col("Date").cast("string").alias("Date"),
        r("spy_adjusted_close", 4),
        r("spy_return_1d", 8),
        r("spy_return_5d", 8),
        r("vix_close", 4),
    )


def input_frame(spark, sf, as_of=None):
    bars = cut_lineage(standins.bars(spark, sf))  # read by the features, the market context and the input check
    f = fe.feature_dataset(bars, standins.universe(spark, sf), None, standins.FEATURES_START)
    return fe.model_inputs(f, bars, as_of)


cte(
    "inputs",
    ["step3", "signals", "context", "eligible"],
    f"""
    SELECT s.d, s.ticker, r1, r5, r20, lr1, CASE WHEN al14 = 0 AND ag > 0 THEN 100.0 WHEN al14 = 0 AND ag = 0 THEN 50.0 ELSE 100 - 100 / (1 + ag / nullif(al14, 0)) END AS rsi,
           vol20, (ac - blo) / nullif(bup - blo, 0) AS bpos, rl1, rl5, rl10, v / nullif(pv, 0) - 1 AS vc, vr20, spy1, spy5, vix,
           ac / sma_5 - 1 AS p5, ac / sma_20 - 1 AS p20, ac / sma_50 - 1 AS p50, ac / sma_200 - 1 AS p200, ac / ema_12 - 1 AS pe12, ac / ema_26 - 1 AS pe26,
           macd / ac AS macd_rel, macd_signal / ac AS sig_rel, (macd - macd_signal) / ac AS hist_rel, atr / ac AS atr_rel, (bup - blo) / ac AS bw, r10,
           target, label_end, ac
    FROM step3 s JOIN eligible USING (ticker) JOIN signals g ON s.ticker = g.ticker AND s.d = g.d LEFT JOIN context x ON s.d = x.d
    WHERE s.d >= DATE '{standins.FEATURES_START}'""",
)
AS_OF_SESSION = "2001-06-29"
_SQL_INPUTS = dict(
    zip(
        fe.MODEL_INPUTS,
        "r1 r5 r20 lr1 rsi vol20 bpos rl1 rl5 rl10 vc vr20 spy1 spy5 vix p5 p20 p50 p200 pe12 pe26 macd_rel sig_rel hist_rel atr_rel bw r10".split(),
    )
)


@query(
    "model_inputs_relative",
    with_ctes("inputs")
    + f"""SELECT {KEY}, {', '.join(f'round({v}, 6) AS "{k}"' for k, v in _SQL_INPUTS.items())},
          round(CASE WHEN label_end <= DATE '{AS_OF_SESSION}' THEN target END, 8) AS target_return_10d,
          CAST(CASE WHEN label_end <= DATE '{AS_OF_SESSION}' THEN label_end END AS VARCHAR) AS label_end_date,
          coalesce(label_end <= DATE '{AS_OF_SESSION}' AND target IS NOT NULL, false) AS is_training_row
          FROM inputs WHERE d <= DATE '{AS_OF_SESSION}'""",
)
def model_inputs(spark, sf):
    f = input_frame(spark, sf, AS_OF_SESSION)
    return f.select(
        "ticker",
        F.col("Date").cast("string").alias("Date"),
        *[r(n) for n in fe.MODEL_INPUTS],
        r("target_return_10d", 8),
        F.col("label_end_date").cast("string").alias("label_end_date"),
        "is_training_row",
    )


@query(
    "feature_dataset",
    with_ctes("step1", "eligible", "context", "macro_wide")
    + f"""SELECT ticker, count(*) AS n, count(target) AS training_rows, any_value(sector) AS sector, count(cpi) AS with_cpi, round(avg(x.vix), 4) AS mean_vix_close, round(avg(m.dff), 5) AS mean_rate
          FROM step1 s JOIN eligible USING (ticker) LEFT JOIN context x ON s.d = x.d LEFT JOIN macro_wide m ON m.d = s.d WHERE s.d >= DATE '{standins.FEATURES_START}' GROUP BY 1""",
)
def feature_dataset(spark, sf):
    """Features, market context, point-in-time macro values and metadata, per ticker."""
    from tickerloom.operators.asof import macro_days

    bars = cut_lineage(standins.bars(spark, sf))
    f = fe.feature_dataset(bars, standins.universe(spark, sf), macro_days(standins.macro(spark, sf), bars), standins.FEATURES_START)
    return f.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_training_row").alias("training_rows"), F.any_value("sector").alias("sector"),
        F.count("inflation_cpi_yoy").alias("with_cpi"), r(F.avg("vix_close"), 4).alias("mean_vix_close"), r(F.avg("federal_funds_rate"), 5).alias("mean_rate"),
    )
