"""Domain tables derived from the star-schema test tables.

Each function is one declarative pass over whole tables.  The rules are plain arithmetic
on keys and measures, so the SQL twins in plans.sqlbase state the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.domain import BENCHMARK, MACRO_LAG_DAYS, RISK_TIERS, VOLATILITY_INDEX
from tickerloom.session import balanced, cut_lineage

# 2001-07-01 and 2001-08-20 00:00 UTC, in epoch seconds
EPOCH_S = 993945600
AS_OF_S = 998265600
AS_OF_DATE = "2001-08-20"
FEATURES_START = "1996-01-01"

SECTORS = [
    "Information Technology",
    "Health Care",
    "Financials",
    "Energy",
    "Utilities",
    "Consumer Discretionary",
    "Consumer Staples",
    "Industrials",
    "Communication Services",
    "Materials",
    "Real Estate",
]
THEME_POOL = ["renewable_energy", "solar_energy", "energy_transition", "grid_infrastructure", "electrification", "hydrogen"]
# company names whose first word occurs in the document prose
COMPANY_WORDS = [
    "That", "With", "This", "From", "Ther", "Than", "Thon", "Thre", "Thor", "Then", "Thin", "Thing", "Rewh",
    "Thatin", "Ononst", "Inoran", "Orre", "Orantion", "Hehely", "Sich", "Pour", "Dans", "Elle", "Ment", "Keit",
]
COMPANY_SUFFIXES = ["Inc.", "Corporation", "Company", "plc", "Holdings"]
SEGMENT_INTERESTS = {
    "MACHINERY": ["industrials", "materials", "technology"],
    "BUILDING": ["materials", "energy", "clean_energy"],
    "AUTOMOBILE": ["consumer", "industrials"],
    "FURNITURE": ["consumer"],
    "HOUSEHOLD": ["healthcare", "financials", "communication"],
}
PROVIDERS = ["alpaca", "alpha_vantage", "marketaux", "SEC EDGAR"]
FORMS = ["10-K", "10-Q", "8-K", "20-F"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def brand_number(column: str = "p_brand") -> Column:
    return F.regexp_extract(column, r"(\d+)", 1).cast("int")


def ticker_of(number: Column) -> Column:
    return F.concat(F.lit("B"), F.lpad(number.cast("string"), 2, "0"))


# --- market ----------------------------------------------------------------------


def _brand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_orderkey",
        "l_linenumber",
        F.to_date("l_shipdate").alias("Date"),
        "l_quantity",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", brand_number().alias("no"))
    trade = F.struct("l_orderkey", "l_linenumber", "unit")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("no", "Date")
        .agg(
            F.min(trade).alias("first"),
            F.max(trade).alias("last"),
            F.max("unit").alias("top"),
            F.min("unit").alias("bottom"),
            F.sum("l_quantity").alias("Volume"),
        )
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: 25 brand tickers, a market fund over all brands, a range index."""
    # three branches below, and every operator that reads bars twice, share this stored aggregate
    days = cut_lineage(_brand_days(spark, sf_dir))
    quarter_pay = (F.month("Date") % 3 == 0) & (F.dayofmonth("Date") == 15)
    split_day = (F.month("Date") == 7) & (F.dayofmonth("Date") == 4)

    def level(unit: str, scale: Column) -> Column:
        return F.lit(100.0) + F.col(unit) / scale

    brand_scale = F.lit(4000.0) * (1 + F.col("no") % 6)
    close = level("last.unit", brand_scale)
    brand = days.select(
        "Date",
        ticker_of(F.col("no")).alias("ticker"),
        level("first.unit", brand_scale).alias("Open"),
        level("top", brand_scale).alias("High"),
        level("bottom", brand_scale).alias("Low"),
        close.alias("Close"),
        (close * (F.lit(1.0) - (F.col("no") % 5) * F.lit(0.01))).alias("Adj Close"),
        "Volume",
        F.when(quarter_pay, (F.col("no") % 4) * F.lit(0.25)).otherwise(F.lit(0.0)).alias("Dividends"),
        F.when(split_day, F.lit(2.0)).otherwise(F.lit(0.0)).alias("Stock Splits"),
    )
    market = days.groupBy("Date").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("top").alias("top"),
        F.min("bottom").alias("bottom"),
        F.sum("Volume").alias("Volume"),
    )
    m_scale = F.lit(8000.0)
    m_close = level("last.unit", m_scale)
    fund = market.select(
        "Date",
        F.lit(BENCHMARK).alias("ticker"),
        level("first.unit", m_scale).alias("Open"),
        level("top", m_scale).alias("High"),
        level("bottom", m_scale).alias("Low"),
        m_close.alias("Close"),
        (m_close * F.lit(0.99)).alias("Adj Close"),
        "Volume",
        F.when(quarter_pay, F.lit(0.5)).otherwise(F.lit(0.0)).alias("Dividends"),
        F.lit(0.0).alias("Stock Splits"),
    )
    spread = F.lit(10.0) + (F.col("top") - F.col("bottom")) / F.lit(5000.0)
    fear = market.select(
        "Date",
        F.lit(VOLATILITY_INDEX).alias("ticker"),
        *[spread.alias(n) for n in ("Open", "High", "Low", "Close", "Adj Close")],
        F.lit(0.0).alias("Volume"),
        F.lit(0.0).alias("Dividends"),
        F.lit(0.0).alias("Stock Splits"),
    )
    return brand.unionByName(fund).unionByName(fear)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand plus the fund and the index; every column is text."""
    no = F.col("no")
    brands = (
        table(spark, sf_dir, "part")
        .groupBy(brand_number().alias("no"))
        .agg(F.min("p_type").alias("p_type"), F.min("p_name").alias("p_name"))
    )
    word = F.split("p_name", " ")
    stocks = brands.select(
        ticker_of(no).alias("ticker"),
        F.concat_ws(" ", pick(COMPANY_WORDS, no - 1), pick(COMPANY_SUFFIXES, no % 5)).alias("name"),
        F.when(no % 5 == 0, "etf").otherwise("stock").alias("asset_type"),
        F.initcap("p_type").alias("category"),
        pick(SECTORS, no % 11).alias("sector"),
        F.when(no % 3 == 0, F.concat_ws("|", pick(THEME_POOL, no % 6), word[0]))
        .when(no % 3 == 1, word[1])
        .otherwise("")
        .alias("themes"),
        F.when(no % 7 == 0, "False").otherwise("True").alias("recommendation_eligible"),
        F.when(no % 4 == 0, "false").otherwise("true").alias("forecast_eligible"),
        F.when(no % 6 == 0, "short history").otherwise("").alias("history_note"),
    )
    extra = spark.createDataFrame(
        [
            (BENCHMARK, "Broad Market Fund", "etf", "Broad market", "Broad Market", "", "True", "false", ""),
            (VOLATILITY_INDEX, "Volatility Index", "index", "Index", "Index", "", "False", "false", ""),
        ],
        stocks.schema,
    )
    return stocks.unionByName(extra)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bitemporal series: three daily, one monthly, from order values."""
    orders = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("day"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        "o_totalprice",
    )
    n = F.count(F.lit(1))
    daily = orders.groupBy(F.col("day").alias("observation_date")).agg(
        (F.sum("cents") / n / F.lit(10000000.0)).alias("DFF"),
        (F.max("o_totalprice") / F.lit(100000.0)).alias("DGS10"),
        (F.min("o_totalprice") / F.lit(1000.0)).alias("VIXCLS"),
    )
    monthly = orders.groupBy(F.trunc("day", "month").alias("observation_date")).agg(
        (F.sum("cents") / n / F.lit(100000.0)).alias("CPIAUCSL")
    )
    long = daily.unpivot("observation_date", ["DFF", "DGS10", "VIXCLS"], "series_id", "value").unionByName(
        monthly.unpivot("observation_date", ["CPIAUCSL"], "series_id", "value")
    )
    lag = F.element_at(F.create_map(*[F.lit(x) for kv in MACRO_LAG_DAYS.items() for x in kv]), F.col("series_id"))
    return long.select(
        "series_id",
        F.col("series_id").alias("series_name"),
        F.when(F.col("series_id") == "CPIAUCSL", "monthly").otherwise("daily").alias("frequency"),
        "observation_date",
        "value",
        F.date_add("observation_date", lag).alias("available_date"),
        F.lit(None).cast("date").alias("realtime_end"),
    )


# --- investors, facts --------------------------------------------------------------


def investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    level = F.least(F.lit(4), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000) / 2200)))
    interests = F.create_map(
        *[x for k, v in SEGMENT_INTERESTS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    )
    followed = F.array_distinct(F.array(ticker_of(key * 7 % 25 + 1), ticker_of((key * 13 + 3) % 25 + 1)))
    return table(spark, sf_dir, "customer").select(
        key.alias("investor_id"),
        pick(RISK_TIERS, level).alias("risk_level"),
        interests[F.col("c_mktsegment")].alias("interests"),
        F.when(key % 4 == 0, "stock").when(key % 4 == 1, "etf").otherwise("both").alias("asset_types"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(followed).alias("followed_tickers"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual and instant filing facts per brand ticker and shipping year."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.year("l_shipdate").alias("y"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        "l_returnflag",
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", brand_number().alias("no"))

    def flagged(flag: str) -> Column:
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("cents")).otherwise(F.lit(0).cast("bigint")))

    year = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("no", "y")
        .agg(F.sum("cents").alias("rev"), flagged("A").alias("a"), flagged("R").alias("r"), flagged("N").alias("n"))
    )
    no, y = F.col("no"), F.col("y")
    first_day, last_day = F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))
    filed = F.date_add(F.make_date(y + 1, F.lit(2), F.lit(15)), no)
    nothing = F.lit(None).cast("date")

    def row(seq: int, concept: Column | str, val: Column, start: Column, when: Column = filed) -> Column:
        concept = F.lit(concept) if isinstance(concept, str) else concept
        return F.struct(
            concept.alias("concept"),
            val.cast("double").alias("val"),
            start.alias("start"),
            last_day.alias("end"),
            when.alias("filed"),
            F.lit(seq).alias("ingest_seq"),
        )

    revenue = F.when(no % 2 == 0, "Revenues").otherwise("RevenueFromContractWithCustomerExcludingAssessedTax")
    capex = F.when(no % 3 == 0, "PaymentsToAcquireProductiveAssets").otherwise("PaymentsToAcquirePropertyPlantAndEquipment")
    debt = (
        F.when(no % 4 == 0, "LongTermDebt")
        .when(no % 4 == 1, "LongTermDebtNoncurrent")
        .when(no % 4 == 2, "LongTermDebtAndCapitalLeaseObligations")
    )
    current_debt = F.when(no % 4 == 1, "LongTermDebtCurrent")
    equity_sign = F.when(no % 9 == 0, -1).otherwise(1)
    rows = F.array(
        row(1, revenue, F.col("rev") / 100, first_day),
        row(2, "OperatingIncomeLoss", (F.col("a") - F.col("r") + F.col("n")) / 200, first_day),
        row(3, "NetCashProvidedByUsedInOperatingActivities", F.col("n") / 250, first_day),
        row(4, capex, F.col("r") / 800, first_day),
        row(5, "AssetsCurrent", F.col("a") / 100, nothing),
        row(6, "LiabilitiesCurrent", F.col("r") / 130, nothing),
        row(7, "StockholdersEquity", F.col("n") * equity_sign / 200, nothing),
        row(8, debt, F.col("a") / 300, nothing),
        row(9, current_debt, F.col("r") / 900, nothing),
        row(10, revenue, F.col("rev") / 90, first_day, F.date_add(filed, 120)),
    )
    return (
        year.select(ticker_of(no).alias("ticker"), F.explode(rows).alias("f"))
        .select("ticker", "f.*", F.lit("10-K").alias("form"))
        .filter(F.col("concept").isNotNull())
    )


# --- text ---------------------------------------------------------------------------


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw source records with text stamps, revisions, syndicated copies and faults."""
    d = F.col("doc_id")
    docs = balanced(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc")
    j = docs.join(labels, docs.doc_id == labels.l_doc, "left")
    kind = (F.floor(d / 4) % 4).cast("int")
    is_news = kind != 3
    published = F.lit(EPOCH_S) + (d * 7919 % 1440) * 3600 + (d % 60) * 60
    available = published + (d % 5) * 3600
    fetched = available + F.when(d % 53 == 0, -7200).otherwise(3600)
    tickers = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.array(
                    ticker_of(d % 25 + 1),
                    ticker_of((d * 7 + 3) % 25 + 1),
                    F.when(d % 3 == 0, F.lit("B01")),
                    F.when(d % 11 == 0, F.lit("ZZZ")),
                )
            )
        )
    )
    score = F.col("quality") * 0.5 - F.col("toxic") * 0.9 + (d % 7 - 3) * 0.05
    relevance = F.when(d % 10 != 9, (d % 10) / F.lit(10.0))
    payload = F.struct(score.cast("string").alias("score"), relevance.cast("string").alias("relevance"))
    sentiment = F.when(
        is_news & (kind != 0) & F.col("quality").isNotNull(),
        F.map_from_entries(F.transform(tickers, lambda t: F.struct(t, payload))),
    )
    url_no = d - d % 2
    news_url = F.concat(
        F.when(d % 29 == 0, "ftp").otherwise("https"),
        F.lit("://News.Example.com/a/"),
        url_no.cast("string"),
        F.lit("/?utm_source=feed&id="),
        url_no.cast("string"),
        F.lit("#top"),
    )
    sec_url = F.concat(F.lit("https://filings.example.com/d/"), d.cast("string"))
    return j.select(
        F.concat(F.when(is_news, "news:").otherwise("sec:"), d.cast("string")).alias("document_id"),
        F.when(is_news, "news").otherwise("sec").alias("source_type"),
        pick(PROVIDERS, kind).alias("provider"),
        F.when(d % 4 < 2, d - d % 4).otherwise(d).cast("string").alias("provider_id"),
        tickers.alias("tickers"),
        F.when(d % 31 == 0, F.regexp_replace(iso(published), "Z$", "")).otherwise(iso(published)).alias("published_at"),
        F.when(d % 97 != 0, iso(available)).alias("available_at"),
        iso(fetched).alias("fetched_at"),
        F.when(is_news & (d % 4 == 1), iso(published + 108000)).alias("updated_at"),
        F.when(is_news, news_url).otherwise(sec_url).alias("source_url"),
        F.when(d % 3 != 1, F.substring_index(F.col("text"), ".", 1)).otherwise("").alias("title"),
        "text",
        F.sha2("text", 256).alias("content_hash"),
        (d % 2 == 0).alias("content_available"),
        "source",
        F.when(~is_news, pick(FORMS, d % 3)).alias("form"),
        sentiment.alias("provider_sentiment"),
        d.alias("ingest_seq"),
    )


def chunk_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """(chunk_id, embedding): vectors are assigned to chunks round robin by ingest_seq."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count(F.lit(1))).scalar()
    keyed = chunks.select("chunk_id", (F.col("ingest_seq") % n).alias("vec_id"))
    return keyed.join(vectors, "vec_id").select("chunk_id", "embedding")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast(T.TimestampType()))
