"""Sentiment aggregation over dated, attributed records."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.columns import first_text, ratio


@dataclass(frozen=True)
class NewsWindow:
    """Safeguards of the relevance-weighted aggregate."""

    relevance_floor: float = 0.1
    window_hours: float = 72.0
    half_life_hours: float = 24.0
    min_articles: int = 2


ASSEMBLY_WINDOW = NewsWindow(relevance_floor=0.0, window_hours=168, min_articles=2)


def seconds(stamp: Column) -> Column:
    return F.unix_micros(stamp) / F.lit(1e6)


def dated(documents: DataFrame) -> DataFrame:
    """Parsed publication and availability; a stamp without zone counts as UTC."""
    published = F.try_to_timestamp("published_at")
    return documents.withColumn("published", published).withColumn(
        "available", F.coalesce(F.try_to_timestamp("available_at"), published)
    )


def provider_records(documents: DataFrame, default_relevance: float | None = None) -> DataFrame:
    """One row per (document, ticker) provider score; rows without a number are dropped."""
    d = documents.select(
        F.explode("provider_sentiment").alias("ticker", "payload"),
        "provider",
        "published",
        F.coalesce("available", "published").alias("available"),
        "source_url",
        "content_hash",
        "provider_id",
        "ingest_seq",
    )
    given = F.expr("try_cast(payload.relevance AS double)")
    default = F.lit(default_relevance).cast("double")
    return d.select(
        "ticker",
        F.expr("try_cast(payload.score AS double)").alias("score"),
        F.coalesce(given, default).alias("relevance"),
        given.isNull().alias("relevance_assumed"),
        "published",
        "available",
        F.coalesce("source_url", F.lit("")).alias("url"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce(F.col("provider_id"), F.lit("")).alias("article_id"),
        F.coalesce(first_text(F.col("provider")), F.lit("alpha_vantage")).alias("source"),
        "ingest_seq",
    ).filter(F.col("score").isNotNull() & F.col("relevance").isNotNull())


def news_signals(records: DataFrame, tickers: DataFrame, as_of: Column, window: NewsWindow = NewsWindow()) -> DataFrame:
    """(ticker, news struct) for every requested ticker; null where too few articles remain.

    Stories collapse per (ticker, story) before the ticker aggregate, both with map-side
    combine, so a ticker with a third of all records never meets on one task as rows.
    """
    age = (seconds(as_of) - seconds(F.col("published"))) / 3600.0
    eligible = records.withColumn("age", age).filter(
        (F.col("published") <= as_of)
        & (F.col("available") <= as_of)
        & F.col("score").between(-1.0, 1.0)
        & F.col("relevance").between(0.0, 1.0)
        & (F.col("relevance") >= window.relevance_floor)
        & F.col("age").between(0, window.window_hours)
    )
    story = F.coalesce(
        first_text(F.col("url"), F.col("content_hash"), F.col("article_id")),
        F.concat_ws(":", "ticker", F.col("published").cast("string")),
    )
    newest = F.struct("published", -F.col("ingest_seq"))
    stories = eligible.groupBy("ticker", story.alias("story")).agg(
        F.max_by(F.struct("score", "relevance", "age", "source", "relevance_assumed"), newest).alias("s"),
        F.min("ingest_seq").alias("first_seen"),
    )
    weight = F.exp(F.lit(-math.log(2)) * F.col("s.age") / window.half_life_hours) * F.col("s.relevance")
    per = stories.groupBy("ticker").agg(
        F.count(F.lit(1)).cast("int").alias("article_count"),
        ratio(F.sum(weight * F.col("s.score")), F.nullif(F.sum(weight), F.lit(0.0))).alias("score"),
        F.avg("s.relevance").alias("relevance"),
        F.min("s.age").alias("recency_hours"),
        F.min_by("s.source", "first_seen").alias("source"),
        F.bool_or(~F.col("s.relevance_assumed")).alias("relevance_available"),
    )
    per = per.filter((F.col("article_count") >= window.min_articles) & F.col("score").isNotNull())
    news = F.struct(
        "score", "relevance", "recency_hours", "source", "article_count", F.lit(True).alias("relevant"), "relevance_available"
    )
    return tickers.join(per.select("ticker", news.alias("news")), "ticker", "left")


def weekly_sentiment(documents: DataFrame, scores: DataFrame, tickers: DataFrame, as_of: Column) -> DataFrame:
    """Seven-day, two-day half-life means of local and provider scores, one row per ticker."""
    age_days = (seconds(as_of) - seconds(F.col("published"))) / 86400.0
    recent = (
        documents.filter(F.col("source_type") == "news")
        .filter((F.col("published") >= as_of - F.expr("interval 7 days")) & (F.col("published") <= as_of) & (F.col("available") <= as_of))
        .select("document_id", "published", "published_at", "provider_sentiment", F.explode("tickers").alias("ticker"))
        .withColumn("w", F.exp(F.lit(-math.log(2)) * age_days / 2))
    )
    local = scores.filter("status = 'scored'").select("document_id", "ticker", F.col("score").alias("local"))
    provider = F.expr("try_cast(try_element_at(provider_sentiment, ticker).score AS double)")
    j = recent.join(local, ["document_id", "ticker"], "left").withColumn(
        "provider", F.when(provider.between(-1.0, 1.0), provider)
    )

    def mean(name: str) -> Column:
        present = F.when(F.col(name).isNotNull(), F.col("w"))
        return ratio(F.sum(F.col(name) * F.col("w")), F.sum(present))

    per = j.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("articles_7d"),
        F.count("local").alias("local_scored_articles_7d"),
        mean("local").alias("local_sentiment_7d"),
        mean("provider").alias("provider_sentiment_7d"),
        F.max("published_at").alias("latest_publication"),
    )
    out = tickers.join(per, "ticker", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "ticker",
        F.coalesce("articles_7d", zero).alias("articles_7d"),
        F.coalesce("local_scored_articles_7d", zero).alias("local_scored_articles_7d"),
        "local_sentiment_7d",
        "provider_sentiment_7d",
        F.when(F.col("local_scored_articles_7d") > 0, "available").otherwise("unavailable").alias("sentiment_status"),
        "latest_publication",
    )


def latest_sentiment(documents: DataFrame, weekly: DataFrame, as_of: Column, provider: str = "marketaux") -> DataFrame:
    """Per ticker the newer of: one provider's mean over the week before its newest article, or the stored aggregate."""
    own = (
        documents.filter((F.col("provider") == provider) & (F.col("published") <= as_of))
        .select("published", "published_at", F.explode("provider_sentiment").alias("ticker", "payload"))
        .withColumn("score", F.expr("try_cast(payload.score AS double)"))
        .filter(F.col("score").isNotNull())
    )
    newest = own.groupBy("ticker").agg(F.max("published").alias("newest"), F.max("published_at").alias("newest_at"))
    first = (
        own.join(newest, "ticker")
        .filter(F.col("published") > F.col("newest") - F.expr("interval 7 days"))
        .groupBy("ticker")
        .agg(F.avg("score").alias("score"), F.max("newest_at").alias("as_of"), F.count(F.lit(1)).alias("article_count"))
        .select("ticker", "score", F.lit(provider).alias("source"), "as_of", "article_count", F.lit(1).alias("priority"))
    )
    stored = weekly.filter(
        (F.col("sentiment_status") == "available") & F.col("provider_sentiment_7d").isNotNull()
    ).select(
        "ticker",
        F.col("provider_sentiment_7d").alias("score"),
        F.lit("alpha_vantage").alias("source"),
        F.col("latest_publication").alias("as_of"),
        F.col("articles_7d").alias("article_count"),
        F.lit(0).alias("priority"),
    )
    both = first.unionByName(stored)
    return (
        both.groupBy("ticker")
        .agg(F.max_by(F.struct("score", "source", "as_of", "article_count"), F.struct("as_of", "priority")).alias("s"))
        .select("ticker", "s.*")
    )


def attribution_diagnostics(scored: DataFrame, documents: DataFrame, weekly: DataFrame) -> DataFrame:
    """One row: ambiguity, article and aggregate sign agreement, provider share."""
    provider = documents.select("document_id", F.explode("provider_sentiment").alias("ticker", "payload")).select(
        "document_id", "ticker", F.expr("try_cast(payload.score AS double)").alias("theirs")
    )
    j = scored.select("document_id", "ticker", "status", "score").join(provider, ["document_id", "ticker"], "left")
    both = (F.col("status") == "scored") & F.col("score").isNotNull() & F.col("theirs").isNotNull()
    agree = both & ((F.col("score") >= 0) == (F.col("theirs") >= 0))
    rows = j.agg(
        F.count(F.lit(1)).alias("associations"),
        F.count_if(F.col("status") != "scored").alias("ambiguous"),
        F.count_if(both).alias("rows_with_both"),
        F.count_if(agree).alias("sign_agreement"),
    )
    l, p = F.col("local_sentiment_7d"), F.col("provider_sentiment_7d")
    agg = weekly.agg(
        F.count_if(l.isNotNull() & p.isNotNull()).alias("n"),
        F.count_if(((l >= 0) == (p >= 0))).alias("same"),
        F.avg(F.abs(l - p)).alias("diff"),
    ).select(F.struct("n", "same", "diff")).scalar()
    share = documents.filter("source_type = 'news'").agg(F.avg((F.col("provider") == "alpha_vantage").cast("double"))).scalar()
    return rows.withColumn("_a", agg).select(
        "associations",
        "ambiguous",
        "rows_with_both",
        "sign_agreement",
        F.col("_a.n").alias("aggregate_pairs"),
        F.col("_a.same").alias("aggregate_agreement"),
        F.col("_a.diff").alias("mean_abs_diff"),
        share.alias("provider_share"),
    )


NAME_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"


def pieces(text: Column) -> Column:
    """Lower-cased words and, one by one, the characters between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(NAME_PIECE), F.lit(0))


def name_dictionary(universe: DataFrame) -> DataFrame:
    """(other, parts, key, at): each short company name as pieces, keyed by its word that the fewest names hold.

    The short name lacks article and legal suffix; if under four characters are left, the full name stands for it.
    Names that are still shorter, and names without a word, are left out.
    """
    from tickerloom.operators.text import LEGAL_SUFFIX

    article_free = F.regexp_replace("name", r"(?i)^the\s+", "")
    brief = F.trim(F.regexp_replace(article_free, LEGAL_SUFFIX, ""))
    named = universe.select(F.col("ticker").alias("other"), F.when(F.length(brief) >= 4, brief).otherwise(F.col("name")).alias("brief"))
    names = named.filter(F.length("brief") >= 4).select("other", pieces(F.col("brief")).alias("parts"))
    words = names.select("other", "parts", F.posexplode("parts").alias("at", "key")).filter(F.rlike("key", F.lit(r"^[\p{L}\p{N}_]")))
    shared = words.groupBy("key").agg(F.countDistinct("other").alias("names"))
    rarest = F.min_by(F.struct("key", "at"), F.struct("names", -F.length("key"), "key", "at")).alias("k")
    return words.join(shared, "key").groupBy("other", "parts").agg(rarest).select("other", "parts", "k.*")


def name_hits(texts: DataFrame, universe: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, start, other): every place where a text holds a company's short name as whole words, in any case.

    A token dictionary join: pieces of the texts, as narrow (``by``, position, piece) rows, meet the names' rarest words;
    a hit of a name of several pieces is then checked piece by piece against the same rows.  No text is copied or
    searched once per name, and a first word that many names or texts share keys nothing.  ``by`` must identify a
    row of ``texts``; a null text has no hits.
    """
    found = texts.select(*by, F.posexplode(pieces(F.col("text"))).alias("pos", "piece"))
    names = name_dictionary(universe)
    starts = found.join(names, found["piece"] == names["key"]).select(*by, (F.col("pos") - F.col("at")).alias("start"), "other", "parts")
    short = F.size("parts") == 1
    wanted = starts.filter(~short & (F.col("start") >= 0)).select(*by, "start", "other", F.size("parts").alias("k"), F.posexplode("parts").alias("i", "piece"))
    wanted = wanted.withColumn("pos", F.col("start") + F.col("i"))
    met = wanted.join(found, [*by, "pos", "piece"]).groupBy(*by, "start", "other", "k").agg(F.count(F.lit(1)).alias("n"))
    return starts.filter(short).select(*by, "start", "other").unionByName(met.filter("n = k").select(*by, "start", "other"))


def contaminated(scored_text: DataFrame, universe: DataFrame) -> DataFrame:
    """Scored (document, ticker) texts that also name another company of the universe, by name only."""
    hits = name_hits(scored_text.select("document_id", "ticker", "text"), universe, ["document_id", "ticker"])
    return hits.filter(F.col("other") != F.col("ticker")).select("document_id", "ticker", "other").distinct()
