"""Provider articles to document records, and the collection backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.columns import first_text, sha

MATCH_SCALE = 100.0


def utc(stamp: Column) -> Column:
    return F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _within(d: DataFrame, universe: DataFrame, key: str, tags: str) -> DataFrame:
    """Adds ``tickers``: the article's tags inside the universe; articles without one drop out."""
    kept = (
        d.select(key, F.explode(tags).alias("ticker"))
        .join(universe.select("ticker"), "ticker", "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    )
    return d.join(kept, key)


def symbol_tagged(articles: DataFrame, universe: DataFrame, fetched_at: str) -> DataFrame:
    """Articles with a symbols array (id, symbols, headline, content, summary, url, created_at, updated_at)."""
    d = _within(articles, universe, "id", "symbols")
    text = F.coalesce(first_text(F.col("content"), F.col("summary")), F.lit(""))
    updated = utc(F.coalesce("updated_at", "created_at"))
    version = F.substring(sha(F.concat(updated, sha(text))), 1, 12)
    return d.select(
        F.concat_ws(":", F.lit("news:alpaca"), "id", version).alias("document_id"),
        F.lit("news").alias("source_type"),
        F.lit("alpaca").alias("provider"),
        F.col("id").cast("string").alias("provider_id"),
        "tickers",
        utc(F.col("created_at")).alias("published_at"),
        F.lit(fetched_at).alias("available_at"),
        updated.alias("updated_at"),
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.coalesce("headline", F.lit("")).alias("title"),
        text.alias("text"),
        sha(text).alias("content_hash"),
        first_text(F.col("content")).isNotNull().alias("content_available"),
    )


def ticker_scored(articles: DataFrame, universe: DataFrame, fetched_at: str) -> DataFrame:
    """Articles with ticker_sentiment[ticker, label, score, relevance] as text, kept as sent."""
    identity = sha(F.coalesce(first_text(F.col("url")), F.concat(F.coalesce("title", F.lit("")), F.col("time_published"))))
    keyed = articles.withColumn("provider_id", identity).withColumn("_tags", F.transform("ticker_sentiment", lambda x: x["ticker"]))
    d = _within(keyed, universe, "provider_id", "_tags")
    inside = F.filter("ticker_sentiment", lambda x: F.array_contains("tickers", x["ticker"]))
    entries = F.transform(
        inside,
        lambda x: F.struct(x["ticker"], F.named_struct(F.lit("label"), x["label"], F.lit("score"), x["score"], F.lit("relevance"), x["relevance"])),
    )
    text = F.coalesce("summary", F.lit(""))
    return d.select(
        F.concat_ws(":", F.lit("news:alpha_vantage"), "provider_id", F.substring(sha(text), 1, 12)).alias("document_id"),
        F.lit("news").alias("source_type"),
        F.lit("alpha_vantage").alias("provider"),
        "provider_id",
        "tickers",
        F.date_format(F.to_timestamp("time_published", "yyyyMMdd'T'HHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.lit(fetched_at).alias("available_at"),
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.coalesce("title", F.lit("")).alias("title"),
        text.alias("text"),
        sha(text).alias("content_hash"),
        F.map_from_entries(entries).alias("provider_sentiment"),
    )


def sentiment_label(score: Column) -> Column:
    return F.when(score <= -0.15, "Bearish").when(score >= 0.15, "Bullish").otherwise("Neutral")


def entity_scored(articles: DataFrame, universe: DataFrame, fetched_at: str) -> DataFrame:
    """Articles with entities[symbol, sentiment_score, match_score]; rows without a scored entity drop out."""
    e = (
        articles.select("uuid", F.posexplode("entities").alias("pos", "e"))
        .select("uuid", "pos", F.col("e.symbol").alias("ticker"), F.expr("try_cast(e.sentiment_score AS double)").alias("score"), F.expr("try_cast(e.match_score AS double)").alias("match_score"))
        .filter(F.col("score").isNotNull())
        .join(universe.select("ticker"), "ticker", "left_semi")
    )
    relevance = F.greatest(F.lit(0.0), F.least(F.col("match_score") / MATCH_SCALE, F.lit(1.0)))
    e = e.withColumn("relevance", F.when(F.col("match_score").isNotNull(), relevance))
    payload = F.struct("score", "relevance", sentiment_label(F.col("score")).alias("label"), "match_score")
    per = (
        e.groupBy("uuid", "ticker").agg(F.max_by(payload, "pos").alias("p")).groupBy("uuid")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "p")))).alias("provider_sentiment"))
    )
    text = F.coalesce(first_text(F.col("description"), F.col("snippet")), F.lit(""))
    return articles.join(per, "uuid").select(
        F.concat(F.lit("news:marketaux:"), F.col("uuid")).alias("document_id"),
        F.lit("news").alias("source_type"),
        F.lit("marketaux").alias("provider"),
        F.col("uuid").alias("provider_id"),
        F.array_sort(F.map_keys("provider_sentiment")).alias("tickers"),
        utc(F.col("published_at")).alias("published_at"),
        F.lit(fetched_at).alias("available_at"),
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.coalesce("title", F.lit("")).alias("title"),
        text.alias("text"),
        sha(text).alias("content_hash"),
        (text != "").alias("content_available"),
        "provider_sentiment",
    )


def append_new(existing: DataFrame, incoming: DataFrame, key: str, sequence: str) -> DataFrame:
    """Incoming rows whose key is new, the first copy of each."""
    fields = [c for c in incoming.columns if c != key]
    new = incoming.join(existing.select(key), key, "left_anti")
    return new.groupBy(key).agg(F.min_by(F.struct(*fields), sequence).alias("_f")).select(key, "_f.*")


def pending_windows(ranges: DataFrame, ledger: DataFrame, quota: int) -> DataFrame:
    """Daily windows (provider, day) still to collect, newest first, cut by the remaining quota."""
    # windows are made beside the days a provider has: no window is shuffled, and a provider's days are bounded by the calendar
    done = ledger.filter(F.col("status").isin("collected", "no_results")).groupBy("provider").agg(F.collect_set("day").alias("_done"))
    open_days = F.array_except(F.sequence("start", F.date_sub("end", 1)), F.coalesce("_done", F.array().cast("array<date>")))
    # of one provider no more than its newest ``quota`` windows can be among the newest of all
    newest = F.slice(F.sort_array(open_days, asc=False), 1, quota)
    days = ranges.join(done, "provider", "left").select("provider", F.explode(newest).alias("day"))
    return days.orderBy(F.desc("day"), "provider").limit(quota)


def window_status(results: DataFrame, limit: int) -> DataFrame:
    """Ledger rows from (provider, day, articles)."""
    n = F.col("articles")
    return results.withColumn("status", F.when(n == 0, "no_results").when(n >= limit, "partial").otherwise("collected"))
