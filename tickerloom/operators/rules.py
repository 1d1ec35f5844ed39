"""Decision rules: stance, reason codes and trace as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.domain import DEFAULT_PROFILE, VOLATILITY_LIMITS
from tickerloom.functions.columns import fill, fixed, kept, percent, signed

# --- fixed values: thresholds, codes and message formats -------------------------
NEGATIVE_RETURN = 0.0
STRONG_RETURN = 2.0
BEARISH = -0.15
BULLISH = 0.15
MAX_INTERVAL_WIDTH = 6.0
MAX_SECTOR_WEIGHT = 0.30
TRUSTED_SOURCES = ["alpha_vantage", "marketaux"]
NEWS_MIN_ARTICLES = 2
NEWS_MAX_AGE_HOURS = 168
FUNDAMENTALS_SOURCE = "sec_xbrl"
FUNDAMENTALS_MIN_METRICS = 3
FUNDAMENTALS_MAX_AGE_DAYS = 456
CAUTION_ORDER = ["EXPLORE", "MONITOR", "CAUTION"]
MESSAGES = {
    "unknown_profile": "Risk profile '%s' not recognised; using Moderate limits.",
    "negative": "Downside risk: 10-day projected return is negative (%s%%).",
    "volatile": "Risk mismatch: volatility (%s) exceeds your %s limit (%s).",
    "bearish": "Adverse market environment: news sentiment is bearish (%s).",
    "no_interval": "No forecast uncertainty available; conviction capped at MONITOR.",
    "wide": "Forecast ambiguity: interval width (%s%%) exceeds threshold (6.0%%).",
    "includes_loss": "Forecast range includes a loss (lower bound %s%%).",
    "concentrated": "Portfolio concentration: %s already in this sector (limit 30%%).",
    "strong": "Favorable trend: projected return is strong (%s%%).",
    "bullish": "Supportive catalyst: news sentiment is bullish (%s).",
    "fits": "Risk aligned: volatility (%s) fits your %s boundary.",
    "narrow": "Model confidence: prediction interval is narrow (%s%%).",
    "moderate": "Moderate growth: projected return (%s%%) is below the high-conviction threshold (+2.0%%).",
    "positive": "Return outlook is positive (%s%%).",
    "neutral": "Balanced news backdrop: sentiment is neutral (%s).",
    "acceptable": "Risk acceptable: volatility (%s) is within %s limits.",
    "news_caution": "News-driven caution (experimental): recent %s news is negative (%s over %s articles), "
    "lowering the forecast-only stance from %s to %s, pending validation.",
    "news_positive": "Recent %s news is positive (%s over %s articles), but the stance stays %s — an unvalidated "
    "positive signal is not used to raise it.",
    "news_negative": "Recent %s news is also negative (%s over %s articles), consistent with this %s stance.",
    "no_fundamentals": "Fundamentals check abstained: no recent SEC filing data with enough reported metrics for this asset.",
    "weak_lowers": "Fundamentals-driven caution (experimental): SEC filings for fiscal year ending %s show weak %s, "
    "lowering the stance from %s to %s, pending validation.",
    "weak_already": "SEC fundamentals (fiscal year ending %s) are also weak, consistent with this CAUTION stance.",
    "strong_raises": "Fundamentals-driven upgrade (experimental): SEC filings for fiscal year ending %s show strong %s, "
    "raising the stance from MONITOR to EXPLORE, pending validation. Forecast caveats above still apply.",
    "strong_caution": "SEC fundamentals (fiscal year ending %s) are strong, but they never lift a CAUTION from "
    "forecast, risk or news rules.",
    "strong_blocked": "SEC fundamentals (fiscal year ending %s) are strong, but %s blocks an upgrade.",
    "strong_also": "SEC fundamentals (fiscal year ending %s) are also strong.",
    "mixed": "SEC fundamentals (fiscal year ending %s) are mixed; they do not move the stance.",
}


def say(key: str, *values: Column) -> Column:
    """A message; placeholders get already formatted text."""
    return fill(MESSAGES[key], *values) if values else F.lit(MESSAGES[key].replace("%%", "%"))


def plus(value: Column, digits: int) -> Column:
    """Signed number, exact ties to even."""
    return signed(value, digits)


def plain(value: Column, digits: int) -> Column:
    return fixed(value, digits)


# --- profile limits ----------------------------------------------------------------


def profile_key(raw: Column) -> Column:
    return F.replace(F.lower(F.trim(raw)), F.lit("_"), F.lit(" "))


def volatility_limit(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in VOLATILITY_LIMITS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, profile_key(raw)), F.lit(VOLATILITY_LIMITS[DEFAULT_PROFILE]))


def known_profile(raw: Column) -> Column:
    return F.coalesce(profile_key(raw).isin(*VOLATILITY_LIMITS), F.lit(False))


def invalid_reason(
    forecast_return: Column, volatility: Column, sentiment: Column, width: Column, lower: Column, sector_weight: Column
) -> Column:
    """Null for usable inputs, else the first broken range."""

    def bad(v: Column) -> Column:
        return F.isnan(v) | (F.abs(v) == float("inf"))

    def outside(v: Column, low: float, high: float) -> Column:
        return v.isNotNull() & (bad(v) | (v < low) | (v > high))

    inf = float("inf")
    return (
        F.when(forecast_return.isNull() | bad(forecast_return), "forecast_return must be a finite number")
        .when(volatility.isNull() | bad(volatility) | (volatility < 0), "volatility must be a finite number >= 0")
        .when(outside(sentiment, -1.0, 1.0), "sentiment_score must be None or within [-1, 1]")
        .when(outside(width, 0.0, inf), "prediction_interval_width must be None or >= 0")
        .when(lower.isNotNull() & bad(lower), "forecast_lower_bound must be None or a finite number")
        .when(outside(sector_weight, 0.0, 1.0), "sector_weight must be None or within [0, 1]")
    )


# --- base decision -----------------------------------------------------------------


def _conditions(
    forecast_return: Column, volatility: Column, sentiment: Column, width: Column, profile: Column, lower: Column, sector_weight: Column
) -> dict[str, Column]:
    """The tests of the decision list, by name."""
    no = F.lit(False)
    t = {
        "negative": forecast_return < NEGATIVE_RETURN,
        "volatile": volatility > volatility_limit(profile),
        "bearish": F.coalesce(sentiment <= BEARISH, no),
        "wide": F.coalesce(width > MAX_INTERVAL_WIDTH, no),
        "loss": F.coalesce((lower < 0) & (forecast_return >= 0), no),
        "concentrated": F.coalesce(sector_weight > MAX_SECTOR_WEIGHT, no),
        "strong": forecast_return >= STRONG_RETURN,
        "bullish": F.coalesce(sentiment >= BULLISH, no),
    }
    t["caution"] = t["negative"] | t["volatile"] | t["bearish"]
    uncertain = width.isNull() | t["wide"] | t["loss"]
    t["explore"] = ~t["caution"] & t["strong"] & t["bullish"] & ~uncertain & ~t["concentrated"]
    return t


def stance_only(*operands: Column) -> Column:
    """The stance of ``base_stance`` without its trace and codes."""
    t = _conditions(*operands)
    return F.when(t["caution"], "CAUTION").when(t["explore"], "EXPLORE").otherwise("MONITOR")


def base_stance(
    forecast_return: Column,
    volatility: Column,
    sentiment: Column,
    width: Column,
    profile: Column,
    lower: Column,
    sector_weight: Column,
) -> Column:
    """struct(stance, trace, codes) of the decision list; every operand is a column."""
    operands = (forecast_return, volatility, sentiment, width, profile, lower, sector_weight)
    limit = volatility_limit(profile)
    known = known_profile(profile)
    display = F.when(known, F.initcap(profile_key(profile))).otherwise(F.lit("Moderate (default)"))
    vol_text = plain(volatility, 2)

    t = _conditions(*operands)
    negative, volatile, bearish, wide, loss = (t[k] for k in ("negative", "volatile", "bearish", "wide", "loss"))
    concentrated, strong, bullish, caution, explore = (t[k] for k in ("concentrated", "strong", "bullish", "caution", "explore"))
    monitor = ~caution & ~explore
    neutral = monitor & sentiment.isNotNull() & ~bullish

    codes = kept(
        F.when(~known, "UNKNOWN_PROFILE"),
        F.when(sentiment.isNull(), "SENTIMENT_MISSING"),
        F.when(negative, "NEGATIVE_FORECAST"),
        F.when(volatile, "VOLATILITY_EXCEEDS_LIMIT"),
        F.when(bearish, "BEARISH_SENTIMENT"),
        F.when(width.isNull(), "INTERVAL_MISSING").when(wide, "INTERVAL_TOO_WIDE"),
        F.when(loss, "INTERVAL_INCLUDES_LOSS"),
        F.when(concentrated, "SECTOR_CONCENTRATION"),
        F.when(explore, "EXPLORE_CONFLUENCE"),
        F.when(monitor & ~strong, "RETURN_BELOW_THRESHOLD"),
        F.when(neutral, "SENTIMENT_NEUTRAL"),
    )
    trace = kept(
        F.when(~known, say("unknown_profile", profile)),
        F.when(negative, say("negative", plus(forecast_return, 1))),
        F.when(volatile, say("volatile", vol_text, display, plain(limit, 2))),
        F.when(bearish, say("bearish", plus(sentiment, 2))),
        F.when(width.isNull(), say("no_interval")).when(wide, say("wide", plain(width, 1))),
        F.when(loss, say("includes_loss", plus(lower, 1))),
        F.when(concentrated, say("concentrated", percent(sector_weight))),
        F.when(explore, say("strong", plus(forecast_return, 1))),
        F.when(explore, say("bullish", plus(sentiment, 2))),
        F.when(explore, say("fits", vol_text, display)),
        F.when(explore, say("narrow", plain(width, 1))),
        F.when(monitor & ~strong, say("moderate", plus(forecast_return, 1))),
        F.when(monitor & strong, say("positive", plus(forecast_return, 1))),
        F.when(neutral, say("neutral", plus(sentiment, 2))),
        F.when(monitor, say("acceptable", vol_text, display)),
    )
    return F.struct(stance_only(*operands).alias("stance"), trace.alias("trace"), codes.alias("codes"))


# --- gates -------------------------------------------------------------------------


def usable_news(news: Column) -> Column:
    """The score if the news struct clears the safeguards, else null."""
    ok = (
        news["score"].between(-1.0, 1.0)
        & news["source"].isin(*TRUSTED_SOURCES)
        & F.coalesce(news["relevant"], F.lit(False))
        & (F.coalesce(news["article_count"], F.lit(0)) >= NEWS_MIN_ARTICLES)
        & (news["recency_hours"] <= NEWS_MAX_AGE_HOURS)
    )
    return F.when(news.isNotNull() & ok, news["score"])


def fundamentals_usable(f: Column) -> Column:
    ok = (
        (f["source"] == FUNDAMENTALS_SOURCE)
        & f["score"].between(-1.0, 1.0)
        & f["rating"].isin("strong", "neutral", "weak")
        & (F.coalesce(f["metric_count"], F.lit(0)) >= FUNDAMENTALS_MIN_METRICS)
        & f["age_days"].between(0, FUNDAMENTALS_MAX_AGE_DAYS)
    )
    return F.coalesce(f.isNotNull() & ok, F.lit(False))


def metric_summary(metrics: Column, assessment: str) -> Column:
    """Names of the metrics (array of name/value/assessment) with one assessment."""
    names = F.transform(
        F.filter(metrics, lambda m: m["assessment"] == assessment), lambda m: F.replace(m["name"], F.lit("_"), F.lit(" "))
    )
    text = F.array_join(names, ", ")
    return F.when(text == "", "no single metric").otherwise(text)


def caution_rank(stance: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in CAUTION_ORDER]), stance) - 1


# --- hybrid decision ----------------------------------------------------------------

HYBRID_INPUTS = [
    "forecast_return",
    "volatility",
    "interval_width",
    "risk_profile",
    "lower_bound",
    "sector_weight",
    "news",
    "fundamentals",
]


def hybrid_signal(df: DataFrame) -> DataFrame:
    """Add ``signal`` to rows that carry HYBRID_INPUTS.

    News may only add caution; fundamentals then move at most one step either way.
    """
    c = F.col
    operands = (c("interval_width"), c("risk_profile"), c("lower_bound"), c("sector_weight"))
    missing = F.lit(None).cast("double")
    d = df.withColumn("_score", usable_news(c("news")))
    # both decisions are taken, but only the one that stands is written out
    score = c("_score")
    d = d.withColumn("_base", stance_only(c("forecast_return"), c("volatility"), missing, *operands))
    d = d.withColumn("_aware", stance_only(c("forecast_return"), c("volatility"), score, *operands))
    base, aware = c("_base"), c("_aware")
    lowered = score.isNotNull() & (caution_rank(aware) > caution_rank(base))
    d = d.withColumn("_op", base_stance(c("forecast_return"), c("volatility"), F.when(lowered, score), *operands))
    source, count = c("news")["source"], F.coalesce(c("news")["article_count"], F.lit(0)).cast("string")
    news_line = (
        F.when(lowered, say("news_caution", source, plus(score, 2), count, base, aware))
        .when(score >= BULLISH, say("news_positive", source, plus(score, 2), count, base))
        .when(score <= BEARISH, say("news_negative", source, plus(score, 2), count, base))
    )
    d = d.withColumn("_news_line", news_line)
    d = d.withColumn("_moved", F.coalesce(lowered, F.lit(False))).withColumn("_use", fundamentals_usable(c("fundamentals")))

    stance, codes = c("_op")["stance"], c("_op")["codes"]
    f = c("fundamentals")
    period, rating = f["period_end"], F.when(c("_use"), f["rating"])
    weak, strong = rating == "weak", rating == "strong"
    next_lower = F.element_at(
        F.array(*[F.lit(s) for s in CAUTION_ORDER]), F.least(F.lit(3), caution_rank(stance) + 2).cast("int")
    )
    blocked = F.arrays_overlap(codes, F.array(F.lit("SECTOR_CONCENTRATION"), F.lit("INTERVAL_MISSING")))
    drop = weak & (stance != "CAUTION")
    lift = strong & (stance == "MONITOR") & ~blocked
    block_reason = F.when(F.array_contains(codes, "SECTOR_CONCENTRATION"), "sector concentration").otherwise(
        "the missing forecast"
    )
    line = (
        F.when(rating.isNull(), say("no_fundamentals"))
        .when(drop, say("weak_lowers", period, metric_summary(f["metrics"], "weak"), stance, next_lower))
        .when(weak, say("weak_already", period))
        .when(lift, say("strong_raises", period, metric_summary(f["metrics"], "strong")))
        .when(strong & (stance == "CAUTION"), say("strong_caution", period))
        .when(strong & (stance == "MONITOR"), say("strong_blocked", period, block_reason))
        .when(strong, say("strong_also", period))
        .otherwise(say("mixed", period))
    )
    drop, lift = F.coalesce(drop, F.lit(False)), F.coalesce(lift, F.lit(False))
    signal = F.struct(
        base.alias("baseline_stance"),
        F.when(drop, next_lower).when(lift, "EXPLORE").otherwise(stance).alias("news_aware_stance"),
        (c("_moved") | drop | lift).alias("provisional"),
        F.concat(c("_op")["trace"], kept(c("_news_line"), line)).alias("decision_trace"),
        F.concat(codes, kept(F.when(drop, "FUNDAMENTALS_WEAK").when(lift, "FUNDAMENTALS_STRONG"))).alias("reason_codes"),
        F.struct(
            score.alias("score"),
            c("news")["relevance"].alias("relevance"),
            c("news")["recency_hours"].alias("recency_hours"),
            F.when(score.isNotNull(), source).alias("source"),
            F.coalesce(c("news")["article_count"], F.lit(0)).alias("article_count"),
        ).alias("news_signal"),
        F.when(c("_use"), f).alias("fundamentals_signal"),
        profile_key(c("risk_profile")).alias("risk_profile"),
    )
    return d.withColumn("signal", signal).drop("_score", "_base", "_aware", "_op", "_news_line", "_moved", "_use")


def asset_stance(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requested stances; a missing volatility falls back to the stored one, else the row is unavailable."""
    stored = profiles.select(F.upper("ticker").alias("_key"), F.col("risk.volatility_1y").alias("_stored"))
    j = requests.join(stored, F.upper(F.trim("ticker")) == F.col("_key"), "left")
    vol = F.coalesce("volatility", "_stored")
    nothing = F.lit(None).cast("double")
    decision = base_stance(
        F.col("forecast_return"), F.col("_vol"), F.col("sentiment"), F.col("width"),
        F.coalesce("risk_profile", F.lit(DEFAULT_PROFILE)), nothing, nothing,
    )
    j = j.withColumn("_vol", vol).withColumn(
        "_d", F.when(F.col("_key").isNotNull() & F.col("_vol").isNotNull(), decision)
    )
    status = (
        F.when(F.col("_key").isNull(), "unknown_ticker").when(F.col("_vol").isNull(), "no_volatility").otherwise("evaluated")
    )
    return j.select(*requests.columns, status.alias("status"), F.col("_d.stance").alias("stance"), F.col("_d.trace").alias("trace"))


def assess_forecasts(forecasts: DataFrame, profiles: DataFrame, investors: DataFrame, today: Column) -> DataFrame:
    """One assessment per (investor, selected forecast): unavailable, historical or evaluated."""
    risk = profiles.filter("recommendation_eligible").select(
        "ticker", F.col("risk.volatility_1y").alias("_v"), F.col("as_of").cast("date").alias("_dated")
    )
    j = forecasts.join(investors.select("investor_id", "risk_level"), "investor_id").join(risk, "ticker", "left")
    vol = F.when((F.col("_v") >= 0) & ~F.isnan("_v") & (F.col("_v") != float("inf")), F.col("_v"))
    dated = F.when(F.col("_dated") <= today, F.col("_dated"))
    j = j.withColumn("volatility", vol).withColumn("volatility_as_of", dated)
    usable = F.col("volatility").isNotNull() & known_profile(F.col("risk_level"))
    nothing = F.lit(None).cast("double")
    j = j.withColumn(
        "_d",
        base_stance(
            F.col("predicted_return_10d") * 100, F.col("volatility"), nothing, F.col("uncertainty_width_pp"),
            F.col("risk_level"), F.col("lower_return") * 100, nothing,
        ),
    )
    old = F.col("stale_snapshot") | F.coalesce(F.datediff(today, "volatility_as_of") > 7, F.lit(False))
    trace = F.concat(
        kept(F.when(old, "Historical research assessment: inputs are dated snapshots, not a current-market assessment.")),
        F.col("_d.trace"),
        kept(F.when(F.col("volatility_as_of").isNull(), "The one-year volatility measurement date is unavailable.")),
    )
    unavailable = F.array(
        F.lit("Research assessment unavailable: valid one-year volatility and a saved risk profile are required.")
    )
    return j.select(
        *forecasts.columns,
        F.when(~usable, "unavailable").when(old, "historical").otherwise("evaluated").alias("assessment_status"),
        F.when(usable, F.col("_d.stance")).alias("stance"),
        F.when(usable, trace).otherwise(unavailable).alias("decision_trace"),
    )
