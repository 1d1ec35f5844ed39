"""Point-in-time fundamentals signal from filing facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.columns import kept, ratio
from tickerloom.operators.asof import visible_facts

# --- fixed values: concept preference orders and thresholds -----------------------
SOURCE = "sec_xbrl"
MIN_METRICS = 3
MAX_PERIOD_AGE_DAYS = 456
STRONG_SCORE = 0.6
WEAK_SCORE = -0.4
REVENUE = [
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "RevenueFromContractWithCustomerIncludingAssessedTax",
    "RegulatedAndUnregulatedOperatingRevenue",
    "SalesRevenueNet",
    "RevenuesNetOfInterestExpense",
]
CAPEX = ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]
TOTAL_DEBT = ["LongTermDebt", "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities"]
NONCURRENT_DEBT = ["LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations"]
CURRENT_DEBT = ["LongTermDebtCurrent", "LongTermDebtAndCapitalLeaseObligationsCurrent", "DebtCurrent"]
OPERATING_INCOME = "OperatingIncomeLoss"
OPERATING_CASH = "NetCashProvidedByUsedInOperatingActivities"
# metric: strong at or above, weak below
THRESHOLDS = {
    "revenue_growth": (0.10, 0.0),
    "operating_margin": (0.15, 0.0),
    "free_cash_flow_margin": (0.10, 0.0),
    "current_ratio": (1.5, 1.0),
}
# strong at or below, weak above
DEBT_TO_EQUITY = (0.5, 2.0)
METRICS = [*THRESHOLDS, "debt_to_equity"]


def preference(concepts: list[str]) -> Column:
    """Position of the row's concept in a preference order, or null."""
    at = F.array_position(F.array(*[F.lit(x) for x in concepts]), F.col("concept"))
    return F.when(at > 0, at)


def preferred(concepts: list[str]) -> Column:
    """Aggregate: value of the most preferred concept present."""
    return F.min_by(F.when(preference(concepts).isNotNull(), F.col("val")), preference(concepts))


def value_of(concept: str) -> Column:
    return F.max(F.when(F.col("concept") == concept, F.col("val")))


def assessment(name: str, value: Column) -> Column:
    if name == "debt_to_equity":
        strong, weak = value <= DEBT_TO_EQUITY[0], value > DEBT_TO_EQUITY[1]
    else:
        strong, weak = value >= THRESHOLDS[name][0], value < THRESHOLDS[name][1]
    return F.when(strong, "strong").when(weak, "weak").otherwise("neutral")


def annual(known: DataFrame) -> DataFrame:
    return known.filter(F.datediff("end", "start").between(350, 380))


def instants(known: DataFrame) -> DataFrame:
    return known.filter(F.col("start").isNull())


def revenue_periods(known: DataFrame) -> DataFrame:
    """Per ticker: revenue of the newest fiscal year and of the year before, one concept."""
    series = annual(known).withColumn("_pref", preference(REVENUE)).filter(F.col("_pref").isNotNull())
    choice = series.groupBy("ticker").agg(
        F.max_by(F.struct("concept", F.col("end").alias("period_end")), F.struct("end", -F.col("_pref"))).alias("k")
    )
    same = series.join(choice.select("ticker", "k.*"), ["ticker", "concept"])
    gap = F.datediff("period_end", "end")
    before = gap.between(330, 400)
    return same.groupBy("ticker", "period_end").agg(
        F.max(F.when(gap == 0, F.col("val"))).alias("revenue"),
        F.max(F.when(gap == 0, F.col("filed"))).alias("filed"),
        F.max_by(F.when(before, F.col("val")), F.when(before, F.col("end"))).alias("previous"),
    )


def year_items(known: DataFrame, periods: DataFrame) -> DataFrame:
    at_end = annual(known).join(periods.select("ticker", F.col("period_end").alias("end")), ["ticker", "end"])
    return at_end.groupBy("ticker").agg(
        value_of(OPERATING_INCOME).alias("income"), value_of(OPERATING_CASH).alias("cash"), preferred(CAPEX).alias("capex")
    )


def balance_ratios(known: DataFrame) -> DataFrame:
    """Current ratio and debt to equity at the newest date both sides were reported."""
    sheet = (
        instants(known)
        .groupBy("ticker", "end")
        .agg(
            value_of("AssetsCurrent").alias("assets"),
            value_of("LiabilitiesCurrent").alias("liabilities"),
            value_of("StockholdersEquity").alias("equity"),
            preferred(TOTAL_DEBT).alias("total"),
            preferred(NONCURRENT_DEBT).alias("noncurrent"),
            preferred(CURRENT_DEBT).alias("current"),
        )
    )
    both = F.col("assets").isNotNull() & F.col("liabilities").isNotNull()
    debt = F.coalesce("total", F.col("noncurrent") + F.coalesce("current", F.lit(0.0)))
    owed = debt.isNotNull() & F.col("equity").isNotNull()
    newest = sheet.groupBy("ticker").agg(
        F.max_by(F.when(both, F.struct("assets", "liabilities")), F.when(both, F.col("end"))).alias("c"),
        F.max_by(F.when(owed, F.struct(debt.alias("debt"), F.col("equity"))), F.when(owed, F.col("end"))).alias("d"),
    )
    return newest.select(
        "ticker",
        F.when(F.col("c.liabilities") > 0, ratio(F.col("c.assets"), F.col("c.liabilities"))).alias("current_ratio"),
        F.when(F.col("d.equity") > 0, ratio(F.col("d.debt"), F.col("d.equity"))).alias("debt_to_equity"),
    )


def metric_values(facts: DataFrame, as_of: str) -> DataFrame:
    """One wide row per ticker with a fresh enough fiscal year."""
    known = visible_facts(facts.withColumn("ticker", F.upper("ticker")), as_of)
    periods = revenue_periods(known).filter(F.datediff(F.lit(as_of).cast("date"), "period_end") <= MAX_PERIOD_AGE_DAYS)
    j = periods.join(year_items(known, periods), "ticker", "left").join(balance_ratios(known), "ticker", "left")
    revenue = F.col("revenue")
    return j.select(
        "ticker",
        "period_end",
        "filed",
        F.when(F.col("previous") > 0, ratio(revenue, F.col("previous")) - 1).alias("revenue_growth"),
        F.when(revenue > 0, ratio(F.col("income"), revenue)).alias("operating_margin"),
        F.when(revenue > 0, ratio(F.col("cash") - F.col("capex"), revenue)).alias("free_cash_flow_margin"),
        "current_ratio",
        "debt_to_equity",
    )


def fundamentals_signals(facts: DataFrame, tickers: DataFrame, as_of: str) -> DataFrame:
    """(ticker, fundamentals struct) for every requested ticker; null struct where it abstains."""
    m = metric_values(facts, as_of)
    entries = kept(
        *[
            F.when(
                F.col(n).isNotNull(),
                F.struct(F.lit(n).alias("name"), F.bround(n, 4).alias("value"), assessment(n, F.col(n)).alias("assessment")),
            )
            for n in METRICS
        ]
    )
    m = m.withColumn("metrics", entries).withColumn("metric_count", F.size("metrics")).filter(F.col("metric_count") >= MIN_METRICS)
    points = F.aggregate(
        "metrics",
        F.lit(0),
        lambda acc, x: acc + F.when(x["assessment"] == "strong", 1).when(x["assessment"] == "weak", -1).otherwise(0),
    )
    m = m.withColumn("_score", points / F.col("metric_count"))
    rating = F.when(F.col("_score") >= STRONG_SCORE, "strong").when(F.col("_score") <= WEAK_SCORE, "weak").otherwise("neutral")
    signal = F.struct(
        F.bround("_score", 4).alias("score"),
        rating.alias("rating"),
        "metrics",
        "metric_count",
        F.col("period_end").cast("string").alias("period_end"),
        F.col("filed").cast("string").alias("filed"),
        F.datediff(F.lit(as_of).cast("date"), "filed").alias("age_days"),
        F.lit(SOURCE).alias("source"),
    )
    found = m.select(F.col("ticker").alias("_key"), signal.alias("fundamentals"))
    return tickers.join(found, F.upper("ticker") == F.col("_key"), "left").drop("_key")
