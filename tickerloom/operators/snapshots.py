"""Research snapshots: ticker x risk tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.domain import RISK_TIERS
from tickerloom.functions.columns import fill, first_text, kept
from tickerloom.operators import rules
from tickerloom.operators.explain import explain
from tickerloom.operators.fundamentals import fundamentals_signals
from tickerloom.operators.retrieval import retrieve
from tickerloom.operators.sentiment import ASSEMBLY_WINDOW, news_signals, provider_records
from tickerloom.session import cut_lineage

# --- fixed values ----------------------------------------------------------------------
NEUTRAL_BAND = 0.5
BASIS = "development-fold estimate (experimental; XGBoost, 10-session horizon)"
PENDING_BASIS = "forecast pending — no saved forecast for this ticker"
PENDING_NOTE = (
    "Forecast pending: no saved 10-day forecast is available for this ticker; this stance reflects volatility and news only."
)
NEUTRAL_NOTE = (
    "Forecast treated as neutral: the 10-day estimate (%s%%) is within the model's uncertainty, so it does not move the "
    "stance — stock-return forecasts are weak and only a directionally confident forecast counts."
)
FORECAST_SCHEMA = "struct<return_10d:double,lower:double,upper:double,model_version:string,basis:string>"


def confident_return(forecast: Column) -> tuple[Column, Column]:
    """The return the rules may use and whether the forecast is directionally confident."""
    value, low, high = forecast["return_10d"], forecast["lower"], forecast["upper"]
    straddles = F.coalesce((low < 0) & (high > 0), F.lit(False))
    sure = F.coalesce(value.isNotNull() & ~straddles & (F.abs(value) >= NEUTRAL_BAND), F.lit(False))
    return F.when(sure, value).otherwise(F.lit(0.0)), sure


def saved_forecasts(rows: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Result rows (text numbers, fractions) to percent forecasts per ticker; bad rows are skipped."""
    version = report.select(F.max("selected_model")).scalar() if report is not None else F.lit(None).cast("string")

    def pct(name: str) -> Column:
        return F.expr(f"try_cast({name} AS double)") * 100

    d = rows.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        pct("predicted_return_10d").alias("r"),
        pct("lower_return").alias("l"),
        pct("upper_return").alias("u"),
        F.coalesce(version, F.col("model")).alias("m"),
        "ingest_seq",
    ).filter(F.col("ticker").isNotNull() & F.col("r").isNotNull() & F.col("l").isNotNull() & F.col("u").isNotNull())
    forecast = F.struct(
        F.col("r").alias("return_10d"), F.col("l").alias("lower"), F.col("u").alias("upper"), F.col("m").alias("model_version"), F.lit(BASIS).alias("basis")
    )
    return d.groupBy("ticker").agg(F.max_by(forecast, "ingest_seq").alias("forecast"))


def latest_batch(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of the newest batch by (as_of, generated_at); the batch id is one scalar."""
    newest = batches.select(F.max_by("batch_id", F.struct("as_of", "generated_at"))).scalar()
    return results.filter(F.col("batch_id") == newest)


def stored_articles(chunks: DataFrame, as_of: Column, lookback_days: int = 30, provider: str = "marketaux") -> DataFrame:
    inside = (F.col("published") > as_of - F.make_dt_interval(F.lit(lookback_days))) & (F.col("published") <= as_of)
    return chunks.filter((F.col("provider") == provider) & inside).withColumn(
        "provider_id", F.substring_index("document_id", ":", -1)
    )


def merge_documents(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union by document_id; fresh copies win."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in ("document_id", "_p")]
    return both.groupBy("document_id").agg(F.max_by(F.struct(*fields), "_p").alias("d")).select("document_id", "d.*")


def provider_news(documents: DataFrame, as_of: Column, k: int = 3) -> DataFrame:
    """Newest provider articles per ticker with the article's own score; first copy of a story wins."""
    story = first_text(F.col("source_url"), F.col("content_hash"), F.col("document_id"))
    known = documents.filter((F.col("published") <= as_of) & (F.col("available") <= as_of))
    d = known.select(
        F.explode("tickers").alias("ticker"),
        story.alias("story"),
        "ingest_seq",
        F.struct(
            F.coalesce("title", F.lit("")).alias("title"),
            F.lit("news").alias("source_type"),
            "published_at",
            F.coalesce("source_url", F.lit("")).alias("source_url"),
            F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 500).alias("snippet"),
        ).alias("e"),
        "published",
        "provider_sentiment",
    )
    score = F.expr("try_cast(try_element_at(provider_sentiment, ticker).score AS double)")
    d = d.withColumn("sentiment", score).drop("provider_sentiment")
    first = d.groupBy("ticker", "story").agg(F.min_by(F.struct("e", "published", "sentiment", "ingest_seq"), "ingest_seq").alias("f"))
    w = Window.partitionBy("ticker").orderBy(F.desc("published"), "ingest_seq")
    ranked = first.select("ticker", "f.*").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("ticker", "rank", "published", "e.*", "sentiment")


def recent_news(provider: DataFrame, retrieved: DataFrame, k: int = 3) -> DataFrame:
    """Both evidence lists per ticker, newest first; provider copies win duplicates and equal times."""
    a = provider.select("ticker", F.lit(0).alias("_list"), "rank", "published", "title", "source_type", "published_at", "source_url", "snippet", "sentiment")
    b = retrieved.select(
        "ticker", F.lit(1).alias("_list"), "rank", "published", "title", "source_type", "published_at", "source_url", "snippet",
        F.lit(None).cast("double").alias("sentiment"),
    )
    both = a.unionByName(b).withColumn("_key", first_text(F.col("source_url"), F.col("title")))
    once = Window.partitionBy("ticker", "_key").orderBy("_list", "rank")
    d = both.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    order = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("published"), "_list", "rank")
    return d.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).drop("_key", "_n", "_list", "rank")


EVIDENCE_FIELDS = ["title", "source_type", "published_at", "source_url", "snippet"]


def evidence_lists(news: DataFrame, filings: DataFrame) -> DataFrame:
    """(ticker, evidence array): news first, then filings; at most five items per ticker."""
    a = news.select("ticker", F.lit(0).alias("_g"), F.col("position").alias("_i"), *EVIDENCE_FIELDS)
    b = filings.select("ticker", F.lit(1).alias("_g"), F.col("rank").alias("_i"), *EVIDENCE_FIELDS)
    packed = a.unionByName(b).groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("_g", "_i", F.struct(*EVIDENCE_FIELDS).alias("e")))).alias("_l")
    )
    return packed.select("ticker", F.transform("_l", lambda x: x["e"]).alias("evidence"))


def build_snapshots(rows: DataFrame) -> DataFrame:
    """Signal, forecast notes and explanation for rows that hold one ticker x tier each."""
    forecast = F.col("forecast")
    value, sure = confident_return(forecast)
    has = forecast["return_10d"].isNotNull()
    width = F.when(has, forecast["upper"] - forecast["lower"])
    d = rows.select(
        "*",
        value.alias("forecast_return"),
        F.col("risk.volatility_1y").alias("volatility"),
        width.alias("interval_width"),
        F.when(has, forecast["lower"]).alias("lower_bound"),
        F.lit(None).cast("double").alias("sector_weight"),
    )
    d = rules.hybrid_signal(d)
    note = F.when(~has, F.lit(PENDING_NOTE)).when(~sure, fill(NEUTRAL_NOTE, rules.plus(forecast["return_10d"], 1)))
    s = F.col("signal")
    d = d.withColumn("signal", s.withField("decision_trace", F.concat(kept(note), s["decision_trace"])))
    d = explain(d)
    return d.select(
        "ticker", "name", "sector", "asset_type", "as_of", "risk_profile", "forecast", "signal", "evidence", "explanation"
    )


def assemble(
    profiles: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    facts: DataFrame,
    forecasts: DataFrame,
    as_of: Column,
    as_of_date: str,
) -> DataFrame:
    """All snapshots of the eligible tickers.

    Evidence and signals are computed once per ticker and stored; the five tiers are a
    literal array exploded at the very end.  ``query_vectors`` holds ticker, kind and
    query_vector for the two production queries.
    """
    eligible = profiles.filter(F.col("recommendation_eligible") & F.col("risk.volatility_1y").isNotNull())
    tickers = eligible.select("ticker")
    news = news_signals(provider_records(documents), tickers, as_of, ASSEMBLY_WINDOW)
    fundamentals = fundamentals_signals(facts, tickers, as_of_date)

    texts = {
        "news": ("news", " latest news and developments", 0.25),
        "sec": ("sec", " business risks and financial results", 0.30),
    }
    q = eligible.select("ticker", "name").join(query_vectors, "ticker")
    kind = F.col("kind")
    queries = q.select(
        F.concat_ws(":", "ticker", "kind").alias("query_id"),
        "ticker",
        "kind",
        F.concat(F.col("name"), F.when(kind == "news", texts["news"][1]).otherwise(texts["sec"][1])).alias("query"),
        "query_vector",
        as_of.alias("as_of"),
        F.array(kind).alias("source_types"),
        F.when(kind == "news", texts["news"][2]).otherwise(texts["sec"][2]).alias("min_similarity"),
    )
    found = retrieve(queries, chunks, vectors, k=3).join(queries.select("query_id", "ticker", "kind"), "query_id")
    found = cut_lineage(found.withColumn("published_at", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    own = provider_news(documents, as_of)
    evidence = evidence_lists(
        recent_news(own, found.filter("kind = 'news'")), found.filter("kind = 'sec' AND rank < 2")
    )
    empty = F.array().cast(evidence.schema["evidence"].dataType)
    pending = F.struct(
        *[F.lit(None).cast("double").alias(n) for n in ("return_10d", "lower", "upper")],
        F.lit(None).cast("string").alias("model_version"),
        F.lit(PENDING_BASIS).alias("basis"),
    )
    per_ticker = (
        eligible.join(news, "ticker", "left")
        .join(fundamentals, "ticker", "left")
        .join(evidence, "ticker", "left")
        .join(forecasts, "ticker", "left")
        .withColumn("evidence", F.coalesce("evidence", empty))
        .withColumn("forecast", F.coalesce("forecast", pending))
        .withColumn("as_of", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    tiers = F.explode(F.array(*[F.lit(t) for t in RISK_TIERS]))
    return build_snapshots(cut_lineage(per_ticker).withColumn("risk_profile", tiers))


def coverage(snapshots: DataFrame, profiles: DataFrame) -> DataFrame:
    per = snapshots.groupBy("ticker").agg(
        F.max(F.col("signal.news_signal.article_count") > 0).alias("news"),
        F.max(F.size("evidence") > 0).alias("evidence"),
        F.max(F.col("forecast.return_10d").isNotNull()).alias("forecast"),
        F.max(F.col("signal.fundamentals_signal").isNotNull()).alias("fundamentals"),
        F.count(F.lit(1)).alias("n"),
    )
    base = profiles.filter("recommendation_eligible").agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if(F.col("risk.volatility_1y").isNull()).alias("skipped_no_volatility"),
    )
    found = per.agg(
        *[F.count_if(n).alias(f"with_{n}") for n in ("news", "evidence", "forecast", "fundamentals")],
        F.coalesce(F.sum("n"), F.lit(0)).alias("snapshots"),
    )
    names = [f"with_{n}" for n in ("news", "evidence", "forecast", "fundamentals")] + ["snapshots"]
    packed = found.select(F.struct(*names)).scalar()
    return base.withColumn("_f", packed).select("eligible", "skipped_no_volatility", *[F.col(f"_f.{n}").alias(n) for n in names])


def serving_rows(snapshots: DataFrame) -> DataFrame:
    """Flat rows as the serving table stores them."""
    return snapshots.select(
        "ticker",
        "risk_profile",
        "as_of",
        F.col("signal.baseline_stance").alias("baseline_stance"),
        F.col("signal.news_aware_stance").alias("news_aware_stance"),
        F.col("signal.provisional").alias("provisional"),
        F.to_json("forecast").alias("forecast"),
        F.to_json("signal").alias("signal_detail"),
        F.to_json("evidence").alias("evidence"),
        F.to_json("explanation").alias("explanation"),
    )
