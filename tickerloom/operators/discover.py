"""Discovery, diversification and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.domain import ASSET_TYPE_CHOICES, INTERESTS, RISK_LABELS, RISK_TIERS
from tickerloom.functions.columns import percent
from tickerloom.operators.recommend import interest_assets, interest_table, signatures, type_allowed, with_signature
from tickerloom.operators.rules import volatility_limit

CONCENTRATED_SHARE = 0.5


def interest_targets(investors: DataFrame) -> DataFrame:
    """Per investor the sorted union of sectors and themes of the chosen interests."""
    t = interest_table(investors.sparkSession).select("interest", "sectors", "themes")
    d = investors.select("investor_id", F.explode("interests").alias("interest")).join(t, "interest")
    return d.groupBy("investor_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sectors")))).alias("sectors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("themes")))).alias("themes"),
    )


def ranked_candidates(investors: DataFrame, assets: DataFrame, limit: int = 10) -> DataFrame:
    """(investor_id, ticker, sector, match_score, rank), scored once per distinct set of answers."""
    open_assets = assets.filter("recommendation_eligible")
    s = signatures(investors)
    scored = (
        s.select("signature", "asset_types", "followed_tickers", F.explode("interests").alias("interest"))
        .join(interest_assets(open_assets), "interest")
        .join(open_assets.select("ticker", "sector", "asset_type"), "ticker")
        .filter(type_allowed(F.col("asset_types"), F.col("asset_type")) & ~F.array_contains("followed_tickers", F.col("ticker")))
        .groupBy("signature", "ticker", "sector")
        .agg(F.count(F.lit(1)).alias("match_score"))
    )
    w = Window.partitionBy("signature").orderBy(F.desc("match_score"), "ticker")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return with_signature(investors).select("investor_id", "signature").join(best, "signature").drop("signature")


def sector_exposure(investors: DataFrame, assets: DataFrame) -> DataFrame:
    """(investor_id, sector, share, first_pos) over followed tickers that are in the catalogue."""
    f = investors.select("investor_id", F.posexplode("followed_tickers").alias("pos", "ticker"))
    j = f.join(assets.select("ticker", "sector").filter(F.col("sector") != ""), "ticker")
    per = j.groupBy("investor_id", "sector").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    total = Window.partitionBy("investor_id")
    return per.select("investor_id", "sector", (F.col("n") / F.sum("n").over(total)).alias("share"), "first_pos")


def diversification(investors: DataFrame, assets: DataFrame, candidates: DataFrame) -> DataFrame:
    top = sector_exposure(investors, assets).groupBy("investor_id").agg(
        F.max_by(F.struct("sector", "share"), F.struct("share", -F.col("first_pos"))).alias("t")
    )
    picks = candidates.groupBy("investor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "sector"))).alias("c"))
    j = investors.select("investor_id").join(top, "investor_id", "left").join(picks, "investor_id", "left")
    outside = F.filter("c", lambda x: (x["sector"] != "") & ~x["sector"].eqNullSafe(F.col("t.sector")))
    concentrated = F.coalesce(F.col("t.share") > CONCENTRATED_SHARE, F.lit(False))
    warning = F.when(
        concentrated,
        F.concat(
            percent(F.col("t.share")), F.lit(" of the assets you follow are in "), F.col("t.sector"),
            F.lit(". Consider diversifying across other sectors to reduce single-industry risk."),
        ),
    )
    none = F.array().cast("array<string>")
    return j.select(
        "investor_id",
        F.col("t.sector").alias("dominant_sector"),
        concentrated.alias("concentrated"),
        warning.alias("warning"),
        F.coalesce(F.transform(F.slice(outside, 1, 5), lambda x: x["ticker"]), none).alias("diversifying_tickers"),
    )


def discover(investors: DataFrame, assets: DataFrame, limit: int = 10) -> DataFrame:
    """Candidates and the diversification note per investor."""
    candidates = ranked_candidates(investors, assets, limit)
    note = diversification(investors, assets, candidates)
    packed = candidates.groupBy("investor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]).alias("candidates")
    )
    return note.join(packed, "investor_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def snapshots_for_investors(investors: DataFrame, assets: DataFrame, snapshots: DataFrame, limit: int = 20) -> DataFrame:
    """Snapshots of the investor's risk tier whose asset matches an interest, by ticker."""
    open_assets = assets.filter("recommendation_eligible")
    s = signatures(investors)
    wanted = (
        s.select("signature", "risk_level", F.explode("interests").alias("interest"))
        .join(interest_assets(open_assets), "interest")
        .select("signature", F.col("risk_level").alias("risk_profile"), "ticker")
        .distinct()
        .join(snapshots, ["ticker", "risk_profile"])
    )
    w = Window.partitionBy("signature").orderBy("ticker")
    best = wanted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return with_signature(investors).select("investor_id", "signature").join(best, "signature").drop("signature")


def snapshot_by_key(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Case-insensitive lookup of (ticker, risk_profile) requests."""
    keyed = snapshots.withColumn("_k", F.upper("ticker")).drop("ticker")
    return requests.withColumn("_k", F.upper(F.trim("ticker"))).join(keyed, ["_k", "risk_profile"], "left").drop("_k")


def followed_sectors(investors: DataFrame, assets: DataFrame) -> DataFrame:
    f = investors.select("investor_id", F.explode("followed_tickers").alias("ticker"))
    return f.join(assets.select("ticker", "sector"), "ticker")


def interest_counts(assets: DataFrame) -> DataFrame:
    """How many recommendable assets sit behind each offered interest."""
    t = interest_table(assets.sparkSession).select("interest", "label")
    n = interest_assets(assets.filter("recommendation_eligible")).groupBy("interest").agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, "interest", "left").select("interest", "label", F.coalesce("n", F.lit(0)).alias("asset_count"))


def search_assets(assets: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Ticker prefix or name substring, without case; the text is data, never a pattern."""
    t = F.lit(text.strip().lower())
    hit = F.startswith(F.lower("ticker"), t) | F.contains(F.lower("name"), t)
    return assets.filter(F.col("recommendation_eligible") & hit).select("ticker", "name", "asset_type", "sector").orderBy("ticker").limit(limit)


def search_many(assets: DataFrame, requests: DataFrame, limit: int = 8) -> DataFrame:
    """Top matches for many ticker-prefix requests (request_id, text).

    Every ticker stands under each of its prefixes (as many as it has letters); a prefix keeps its first
    ``limit`` tickers before the shuffle, and requests meet them by an equi-join on the whole prefix.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.length("ticker")), lambda n: F.upper(F.substring(F.col("ticker"), F.lit(1), n)))
    a = assets.filter(F.col("recommendation_eligible") & (F.length("ticker") > 0)).select("ticker", "name", F.explode(prefixes).alias("_k"))
    w = Window.partitionBy("_k").orderBy("ticker")
    heads = a.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return requests.withColumn("_k", F.upper(F.trim("text"))).join(heads, "_k").drop("_k")


def eligible_subset(tickers: DataFrame, assets: DataFrame) -> DataFrame:
    return tickers.join(assets.filter("recommendation_eligible").select("ticker"), "ticker", "left_semi")


def checked_profiles(submitted: DataFrame, assets: DataFrame) -> DataFrame:
    """Submitted answers normalised, with the first reason to refuse them (null when saved)."""
    clean = F.array_distinct(F.filter(F.transform("followed_tickers", lambda t: F.upper(F.trim(t))), lambda t: t != ""))
    d = submitted.withColumn("followed_tickers", clean).withColumn("_interests", F.array_distinct("interests"))
    unknown = (
        d.select("investor_id", F.posexplode("followed_tickers").alias("pos", "ticker"))
        .join(assets.filter("recommendation_eligible").select("ticker"), "ticker", "left_anti")
        .groupBy("investor_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ticker"))), lambda x: x["ticker"]).alias("_missing"))
    )
    d = d.join(unknown, "investor_id", "left")
    bad_interests = F.filter("interests", lambda i: ~i.isin(*[k for k, *_ in INTERESTS]))
    problem = (
        F.when(~F.col("risk_level").isin(*RISK_TIERS), F.concat(F.lit("Unknown risk level '"), F.col("risk_level"), F.lit("'")))
        .when(F.size(bad_interests) > 0, F.concat(F.lit("Unknown interests: "), F.array_join(bad_interests, ", ")))
        .when(~F.col("asset_types").isin(*ASSET_TYPE_CHOICES), F.concat(F.lit("Unknown asset type '"), F.col("asset_types"), F.lit("'")))
        .when(F.size("_missing") > 0, F.concat(F.lit("Unknown tickers: "), F.array_join("_missing", ", ")))
    )
    return d.select("investor_id", "risk_level", F.col("_interests").alias("interests"), "asset_types", "followed_tickers", problem.alias("problem"))


# --- dashboard ------------------------------------------------------------------------------


def dashboard(investors: DataFrame, assets: DataFrame, recommended: DataFrame) -> DataFrame:
    """One row per investor: risk step, prices as-of, watchlist, suggestions."""
    open_assets = assets.filter("recommendation_eligible")
    prices = open_assets.agg(F.max("as_of")).scalar()
    watch = (
        investors.select("investor_id", F.posexplode("followed_tickers").alias("pos", "ticker"))
        .join(open_assets.select("ticker"), "ticker", "left_semi")
        .groupBy("investor_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ticker"))), lambda x: x["ticker"]).alias("watchlist"))
    )
    picks = recommended.groupBy("investor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]).alias("suggestions")
    )
    step = F.array_position(F.array(*[F.lit(t) for t in RISK_TIERS]), F.col("risk_level"))
    labels = F.create_map(*[F.lit(x) for kv in RISK_LABELS.items() for x in kv])
    none = F.array().cast("array<string>")
    j = investors.join(watch, "investor_id", "left").join(picks, "investor_id", "left")
    return j.select(
        "investor_id",
        F.coalesce(F.try_element_at(labels, F.col("risk_level")), F.col("risk_level")).alias("risk_label"),
        volatility_limit(F.col("risk_level")).alias("volatility_limit"),
        F.when(step > 0, step).alias("step"),
        prices.alias("prices_as_of"),
        F.coalesce("watchlist", none).alias("watchlist"),
        F.coalesce("suggestions", none).alias("suggestions"),
    )


def _listed(board: DataFrame, assets: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("watchlist").alias("list"), F.col("watchlist").alias("t")), F.struct(F.lit("suggested").alias("list"), F.col("suggestions").alias("t")))
    d = board.select("investor_id", "volatility_limit", F.explode(both).alias("b"))
    return d.select("investor_id", "volatility_limit", "b.list", F.explode("b.t").alias("ticker")).join(
        assets.select("ticker", "sector", F.col("risk.volatility_1y").alias("volatility")), "ticker"
    )


def sector_spread(board: DataFrame, assets: DataFrame) -> DataFrame:
    return _listed(board, assets).groupBy("investor_id", "sector").agg(
        F.count_if(F.col("list") == "watchlist").alias("watchlist"), F.count_if(F.col("list") == "suggested").alias("suggested")
    )


def risk_check(board: DataFrame, assets: DataFrame) -> DataFrame:
    v = F.col("volatility")
    return _listed(board, assets).groupBy("investor_id").agg(
        F.count_if(v <= F.col("volatility_limit")).alias("within"),
        F.count_if(v > F.col("volatility_limit")).alias("above"),
        F.count_if(v.isNull()).alias("unknown"),
    )


def selected_forecasts(selections: DataFrame, forecasts: DataFrame, today: Column) -> DataFrame:
    """Forecasts in request order with age; tickers without one are listed as unavailable."""
    s = selections.select("investor_id", F.posexplode("tickers").alias("pos", "ticker"))
    j = s.join(forecasts, "ticker", "left")
    age = F.datediff(today, F.col("date"))
    return j.select(
        "investor_id", "pos", "ticker", F.col("date").isNotNull().alias("available"), age.alias("age_days"), (age > 7).alias("stale"),
        *[c for c in forecasts.columns if c not in ("ticker", "date")],
    )


def unavailable_tickers(selected: DataFrame) -> DataFrame:
    d = selected.filter(~F.col("available")).groupBy("investor_id")
    return d.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ticker"))), lambda x: x["ticker"]).alias("unavailable"))


def research_detail(snapshot: DataFrame, news: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Snapshot rows with the ticker's newest articles and its latest sentiment."""
    packed = news.groupBy("ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("recent_news")
    )
    s = sentiment.select("ticker", F.struct(*[c for c in sentiment.columns if c != "ticker"]).alias("news_sentiment"))
    return snapshot.join(packed, "ticker", "left").join(s, "ticker", "left")


