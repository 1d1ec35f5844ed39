"""Recommendations, their evaluation, discovery and dashboards for all investors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.domain import INTERESTS, RISK_TIERS
from tickerloom.operators import discover as di
from tickerloom.operators import profiles
from tickerloom.operators import recommend as rc
from tickerloom.operators.retrieval import STOP_WORDS
from tickerloom.plans.catalog import query, r
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.session import cut_lineage
from tickerloom.sources import standins


def catalogue(spark, sf):
    """Recommendable assets, also those without volatility yet; stored, because the recommender reads them many times."""
    p = profiles.asset_profiles(standins.bars(spark, sf), standins.universe(spark, sf))
    return cut_lineage(p.filter("recommendation_eligible"))


def graded_catalogue(spark, sf):
    """The evaluation grades by volatility, so it is over the recommendable assets that have one, as in the reference."""
    return catalogue(spark, sf).filter("risk.volatility_1y IS NOT NULL")


def all_assets(spark, sf):
    return profiles.read_universe(standins.universe(spark, sf))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _l(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


cte("interests", [], " UNION ALL ".join(f"SELECT '{k}' AS interest, {i} AS ino, '{lb}' AS label, {_l(s)} AS sectors, {_l(t)} AS themes" for i, (k, lb, s, t) in enumerate(INTERESTS)))
cte("cat", ["profiles"], "SELECT * FROM profiles WHERE rec AND vol IS NOT NULL")
_TOK = "list_filter(regexp_extract_all(lower({t}), '\\w\\w+'), lambda w: NOT list_contains(" + _STOP + ", w))"
cte(
    "item_tok",
    ["cat"],
    f"SELECT ticker, unnest({_TOK.format(t=chr(39).join(['concat_ws(', ' ', ', category, replace(sector, ', ' ', ', ', '_', '), array_to_string(themes, ', ' ', '))']))}) AS token FROM cat",
)
cte("idf", ["item_tok", "cat"], "SELECT token, ln((1.0::DOUBLE + (SELECT count(*) FROM cat)) / (1 + count(DISTINCT ticker))) + 1 AS idf FROM item_tok GROUP BY 1")
cte(
    "item_w",
    ["item_tok", "idf"],
    "SELECT ticker, token, w / sqrt(sum(w * w) OVER (PARTITION BY ticker)) AS w FROM (SELECT ticker, token, count(*) * any_value(idf) AS w FROM item_tok JOIN idf USING (token) GROUP BY 1, 2)",
)
cte(
    "ask_w",
    ["interests", "idf"],
    f"""SELECT interest, token, w / sqrt(sum(w * w) OVER (PARTITION BY interest)) AS w FROM (SELECT interest, token, count(*) * any_value(idf) AS w FROM (
        SELECT interest, unnest({_TOK.format(t="concat_ws(' ', array_to_string(list_transform(sectors, lambda s: replace(s, ' ', '_')), ' '), array_to_string(themes, ' '))")}) AS token FROM interests) JOIN idf USING (token) GROUP BY 1, 2)""",
)
cte("isim", ["item_w", "ask_w", "interests"], "SELECT interest, any_value(ino) AS ino, any_value(label) AS label, ticker, sum(a.w * b.w) AS sim FROM item_w a JOIN ask_w b USING (token) JOIN interests USING (interest) GROUP BY interest, ticker")
cte(
    "attrs",
    ["cat"],
    """
    WITH m AS (SELECT median(vol) AS mv, median(beta) AS mb, median(dd) AS md, median(dy) AS my FROM cat),
    f AS (SELECT ticker, sector, asset_type, category, themes, coalesce(vol, mv) AS a, coalesce(beta, mb) AS b, coalesce(dd, md) AS c, coalesce(dy, my) AS d FROM cat, m),
    s AS (SELECT ticker, list_distinct(list_concat(['sector:' || sector, 'type:' || asset_type, 'category:' || category], list_transform(themes, lambda t: 'theme:' || t))) AS labels,
          [(a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ())] AS nums FROM f)
    SELECT *, sqrt(len(labels) + list_dot_product(nums, nums)) AS norm FROM s""",
)
cte(
    "fsim",
    ["attrs"],
    "SELECT a.ticker AS followed, b.ticker, (len(list_intersect(a.labels, b.labels)) + list_dot_product(a.nums, b.nums)) / (a.norm * b.norm) AS sim FROM attrs a, attrs b",
)
_TIER_LIMIT = "CASE {c} WHEN 'very_conservative' THEN 0.15 WHEN 'conservative' THEN 0.20 WHEN 'moderate' THEN 0.35 WHEN 'growth' THEN 0.45 ELSE 0.55 END::DOUBLE"
cte(
    "recs",
    ["investors", "cat", "isim", "fsim"],
    f"""
    WITH base AS (SELECT i.investor_id, i.risk_level, i.interests, i.followed, c.ticker, c.sector, c.asset_type, c.vol, {_TIER_LIMIT.format(c='risk_level')} AS lim FROM investors i, cat c
           WHERE i.asset_types IN ('both', c.asset_type) AND NOT list_contains(i.followed, c.ticker)),
    it AS (SELECT investor_id, i.ticker, max(sim) AS s, list(label ORDER BY round(sim, 12) DESC, ino) FILTER (sim >= 0.1) AS labels FROM (SELECT investor_id, unnest(interests) AS interest FROM investors) x JOIN isim i USING (interest) GROUP BY 1, 2),
    fo AS (SELECT investor_id, f.ticker, max(sim) AS s, arg_max(f.followed, sim * 1000000 - pos / 1000000.0::DOUBLE) AS closest FROM (SELECT investor_id, unnest(followed) AS followed, generate_subscripts(followed, 1) AS pos FROM investors) x JOIN fsim f USING (followed) GROUP BY 1, 2),
    j AS (SELECT b.*, it.s AS si, it.labels, fo.s AS sf, fo.closest FROM base b LEFT JOIN it USING (investor_id, ticker) LEFT JOIN fo USING (investor_id, ticker) WHERE len(it.labels) > 0 OR fo.s >= 0.5)
    SELECT *, row_number() OVER (PARTITION BY investor_id ORDER BY score DESC, ticker) AS rank FROM (
      SELECT *, round_even((0.5 * coalesce(si, 0) + CASE WHEN sf IS NOT NULL THEN 0.3 ELSE 0 END * coalesce(sf, 0) + 0.2 * greatest(0, least(1, 2 - vol / lim))) / (0.7 + CASE WHEN sf IS NOT NULL THEN 0.3 ELSE 0 END), 4) AS score FROM j)
    QUALIFY rank <= 10""",
)


@query("tfidf_top_terms", with_ctes("item_w") + "SELECT ticker, token, rank, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(w, 10) DESC, token) AS rank FROM item_w) WHERE rank <= 5")
def terms(spark, sf):
    return rc.top_terms(catalogue(spark, sf)).select("ticker", "token", F.col("rank").cast("bigint").alias("rank"), r("weight"))


@query("interest_similarity", with_ctes("isim") + "SELECT interest, ticker, round(sim, 6) AS similarity FROM isim")
def similarity(spark, sf):
    return rc.interest_similarity(catalogue(spark, sf)).select("interest", "ticker", r("similarity"))


@query("asset_neighbours", with_ctes("fsim") + "SELECT followed, ticker, round(sim, 6) AS similarity FROM fsim WHERE sim >= 0.5")
def neighbours(spark, sf):
    cat = catalogue(spark, sf)
    return rc.neighbours(rc.attributes(cat), cat.select("ticker")).select("followed", "ticker", r("similarity"))


@query(
    "investor_recommendations",
    with_ctes("recs")
    + """SELECT investor_id, rank, ticker, round(score, 4) AS score, concat_ws(' / ',
           CASE WHEN len(labels) > 0 THEN 'Matches your ' || CASE WHEN len(labels) = 1 THEN 'interest' ELSE 'interests' END || ' in ' || CASE WHEN len(labels) = 1 THEN labels[1] ELSE array_to_string(labels[1:len(labels) - 1], ', ') || ' and ' || labels[len(labels)] END END,
           CASE WHEN sf >= 0.5 THEN 'Similar to ' || closest || ', which you follow' END) AS reasons FROM recs""",
)
def recommendations(spark, sf):
    rec = rc.recommend(standins.investors(spark, sf), catalogue(spark, sf))
    content = F.filter("reasons", lambda x: ~x.startswith("Yearly"))
    return rec.select("investor_id", F.col("rank").cast("bigint").alias("rank"), "ticker", r("score", 4), F.array_join(content, " / ").alias("reasons"))


cte(
    "grades",
    ["investors", "cat", "interests"],
    f"""
    SELECT investor_id, ticker, sector, hit + (vol <= lim)::INT AS g, (vol <= lim)::INT AS win FROM (
      SELECT i.investor_id, c.ticker, c.sector, c.vol, {_TIER_LIMIT.format(c='i.risk_level')} AS lim,
             (EXISTS (SELECT 1 FROM interests t WHERE list_contains(i.interests, t.interest) AND (list_contains(t.sectors, c.sector) OR len(list_intersect(t.themes, c.themes)) > 0)))::INT AS hit
      FROM investors i, cat c WHERE i.asset_types IN ('both', c.asset_type) AND NOT list_contains(i.followed, c.ticker))""",
)


@query(
    "recommender_metrics",
    with_ctes("grades", "recs")
    + """, ideal AS (SELECT investor_id, sum((pow(2, g) - 1) / log2(rn + 1)) AS best FROM (SELECT investor_id, g, row_number() OVER (PARTITION BY investor_id ORDER BY g DESC) AS rn FROM grades) WHERE rn <= 5 GROUP BY 1),
       got AS (SELECT r.investor_id, count(*) FILTER (g = 2) / 5.0::DOUBLE AS p, sum((pow(2, g) - 1) / log2(rank + 1)) AS dcg, sum(win) / 5.0::DOUBLE AS rk, count(DISTINCT g.sector) / 5.0::DOUBLE AS dv
               FROM recs r JOIN grades g USING (investor_id, ticker) WHERE rank <= 5 GROUP BY 1)
       SELECT i.investor_id, round(coalesce(p, 0), 6) AS precision, round(CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE 0 END, 6) AS ndcg, round(coalesce(rk, 0), 6) AS risk_compat, round(coalesce(dv, 0), 6) AS diversification
       FROM investors i LEFT JOIN ideal USING (investor_id) LEFT JOIN got USING (investor_id)""",
)
def metrics(spark, sf):
    inv, cat = standins.investors(spark, sf), graded_catalogue(spark, sf)
    rec = cut_lineage(rc.recommend(inv, cat, 5))
    m = rc.ranking_metrics(rec, inv, cat, 5)
    return m.select("investor_id", *[r(n) for n in ("precision", "ndcg", "risk_compat", "diversification")])


@query(
    "recommender_systems_report",
    with_ctes("grades", "recs", "isim", "cat")
    + """, io AS (SELECT investor_id, ticker, row_number() OVER (PARTITION BY investor_id ORDER BY s DESC, ticker) AS rank FROM (
            SELECT x.investor_id, i.ticker, round(max(sim), 12) AS s FROM (SELECT investor_id, followed, asset_types, unnest(interests) AS interest FROM investors) x JOIN isim i USING (interest) JOIN cat c USING (ticker)
            WHERE x.asset_types IN ('both', c.asset_type) AND NOT list_contains(x.followed, i.ticker) GROUP BY 1, 2)),
       both_ AS (SELECT 'interest_only' AS system, investor_id, ticker, rank FROM io WHERE rank <= 5 UNION ALL SELECT 'content_based', investor_id, ticker, rank FROM recs WHERE rank <= 5)
       SELECT system, (SELECT count(*) FROM investors) AS profiles, round(count(*) FILTER (g = 2) / 5.0::DOUBLE / (SELECT count(*) FROM investors), 6) AS precision, round(sum(win) / 5.0::DOUBLE / (SELECT count(*) FROM investors), 6) AS risk_compat
       FROM both_ JOIN grades USING (investor_id, ticker) GROUP BY 1""",
)
def systems(spark, sf):
    inv, cat = standins.investors(spark, sf), graded_catalogue(spark, sf)
    frames = []
    for name, rec in (("content_based", rc.recommend(inv, cat, 5)), ("interest_only", rc.interest_only(inv, cat, 5))):
        frames.append(rc.ranking_metrics(cut_lineage(rec), inv, cat, 5).withColumn("system", F.lit(name)))
    rep = rc.evaluation_report(frames[0].unionByName(frames[1]))
    return rep.select("system", "profiles", r("precision"), r("risk_compat"))


@query("random_baseline")
def random_baseline(spark, sf):
    """200 seeded draws of five parts per brand: the random system over the part table."""
    c = standins.table(spark, sf, "part").select(F.col("p_brand").alias("profile"), F.col("p_partkey").cast("string").alias("ticker"))
    d = rc.random_draws(c, 5)
    return d.groupBy("profile").agg(F.count_distinct("draw").alias("draws"), F.count(F.lit(1)).alias("picks"), F.count_distinct("ticker").alias("distinct_items"))


@query(
    "catalogue_coverage",
    with_ctes("recs", "cat") + "SELECT (SELECT count(*) FROM cat) AS assets, count(DISTINCT ticker) AS recommended FROM recs",
)
def coverage(spark, sf):
    cat = catalogue(spark, sf)
    return rc.catalogue_coverage(rc.recommend(standins.investors(spark, sf), cat), cat)


# --- discovery ---------------------------------------------------------------------------------

cte(
    "matched",
    ["assets", "interests"],
    "SELECT t.interest, a.ticker FROM assets a JOIN interests t ON list_contains(t.sectors, a.sector) OR len(list_intersect(t.themes, a.themes)) > 0 WHERE a.rec",
)
cte(
    "ranked",
    ["investors", "matched", "assets"],
    """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY investor_id ORDER BY n DESC, ticker) AS rank FROM (
      SELECT x.investor_id, ticker, any_value(a.sector) AS sector, count(*) AS n FROM (SELECT investor_id, asset_types, followed, unnest(interests) AS interest FROM investors) x JOIN matched USING (interest) JOIN assets a USING (ticker)
      WHERE x.asset_types IN ('both', a.asset_type) AND NOT list_contains(x.followed, ticker) GROUP BY 1, 2)) WHERE rank <= 10""",
)
cte(
    "exposure",
    ["investors", "assets"],
    """
    SELECT investor_id, sector, n / sum(n) OVER (PARTITION BY investor_id) AS share, fp FROM (SELECT investor_id, sector, count(*) AS n, min(pos) AS fp
      FROM (SELECT investor_id, unnest(followed) AS ticker, generate_subscripts(followed, 1) AS pos FROM investors) JOIN assets USING (ticker) GROUP BY 1, 2)""",
)


@query(
    "interest_targets",
    with_ctes("investors", "interests")
    + "SELECT investor_id, array_to_string(list_sort(list_distinct(flatten(list(sectors)))), '|') AS sectors, array_to_string(list_sort(list_distinct(flatten(list(themes)))), '|') AS themes FROM (SELECT investor_id, unnest(interests) AS interest FROM investors) JOIN interests USING (interest) GROUP BY 1",
)
def targets(spark, sf):
    t = di.interest_targets(standins.investors(spark, sf))
    return t.select("investor_id", F.array_join("sectors", "|").alias("sectors"), F.array_join("themes", "|").alias("themes"))


@query("discovery_candidates", with_ctes("ranked") + "SELECT investor_id, ticker, sector, n AS match_score, rank FROM ranked")
def candidates(spark, sf):
    c = di.ranked_candidates(standins.investors(spark, sf), all_assets(spark, sf))
    return c.select("investor_id", "ticker", "sector", "match_score", F.col("rank").cast("bigint").alias("rank"))


@query("sector_exposure", with_ctes("exposure") + "SELECT investor_id, sector, round(share, 6) AS share FROM exposure")
def exposure(spark, sf):
    return di.sector_exposure(standins.investors(spark, sf), all_assets(spark, sf)).select("investor_id", "sector", r("share"))


@query(
    "discovery_with_diversification",
    with_ctes("ranked", "exposure", "investors")
    + """, dom AS (SELECT investor_id, sector, share FROM exposure QUALIFY row_number() OVER (PARTITION BY investor_id ORDER BY share DESC, fp) = 1)
       SELECT i.investor_id, d.sector AS dominant_sector, coalesce(d.share > 0.5, false) AS concentrated,
              CASE WHEN d.share > 0.5 THEN CAST(CAST(round(d.share * 100) AS INTEGER) AS VARCHAR) || '% of the assets you follow are in ' || d.sector || '. Consider diversifying across other sectors to reduce single-industry risk.' END AS warning,
              coalesce(array_to_string((list(k.ticker ORDER BY k.rank) FILTER (k.sector IS DISTINCT FROM d.sector))[1:5], ','), '') AS diversifying, coalesce(string_agg(k.ticker, ',' ORDER BY k.rank), '') AS candidates
       FROM investors i LEFT JOIN dom d USING (investor_id) LEFT JOIN ranked k USING (investor_id) GROUP BY i.investor_id, d.sector, d.share""",
)
def discovery(spark, sf):
    d = di.discover(standins.investors(spark, sf), all_assets(spark, sf))
    return d.select(
        "investor_id", "dominant_sector", "concentrated", "warning", F.array_join("diversifying_tickers", ",").alias("diversifying"), F.array_join("candidates", ",").alias("candidates")
    )


@query(
    "interest_asset_counts",
    with_ctes("matched", "interests") + "SELECT interest, label, count(ticker) AS asset_count FROM interests LEFT JOIN matched USING (interest) GROUP BY 1, 2",
)
def interest_counts(spark, sf):
    return di.interest_counts(all_assets(spark, sf))


@query(
    "catalogue_search",
    with_ctes("assets") + "SELECT ticker, name, asset_type, sector FROM assets WHERE rec AND (ticker ILIKE 'th%' OR name ILIKE '%th%') ORDER BY ticker LIMIT 8",
)
def search(spark, sf):
    return di.search_assets(all_assets(spark, sf), "TH")


@query(
    "catalogue_search_many",
    with_ctes("assets")
    + """SELECT o_orderkey AS request_id, ticker, rank FROM (SELECT o_orderkey, a.ticker, row_number() OVER (PARTITION BY o_orderkey ORDER BY a.ticker) AS rank
         FROM (SELECT o_orderkey, 'B' || CAST(o_custkey % 4 AS VARCHAR) AS t FROM orders) JOIN assets a ON a.rec AND starts_with(a.ticker, t)) WHERE rank <= 8""",
)
def search_many(spark, sf):
    req = standins.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("b"), (F.col("o_custkey") % 4).cast("string")).alias("text"))
    return di.search_many(all_assets(spark, sf), req).select("request_id", "ticker", F.col("rank").cast("bigint").alias("rank"))


@query(
    "eligible_followed",
    with_ctes("assets", "investors") + "SELECT investor_id, ticker FROM (SELECT investor_id, unnest(followed) AS ticker FROM investors) WHERE ticker IN (SELECT ticker FROM assets WHERE rec)",
)
def eligible(spark, sf):
    f = standins.investors(spark, sf).select("investor_id", F.explode("followed_tickers").alias("ticker"))
    return di.eligible_subset(f, all_assets(spark, sf)).select("investor_id", "ticker")


@query(
    "profile_save_rules",
    with_ctes("assets", "investors")
    + """SELECT investor_id, CASE WHEN rl NOT IN ('very_conservative', 'conservative', 'moderate', 'growth', 'aggressive') THEN 'Unknown risk level ''' || rl || '''' WHEN len(bad) > 0 THEN 'Unknown tickers: ' || array_to_string(bad, ', ') END AS problem FROM (
         SELECT investor_id, CASE WHEN investor_id % 13 = 0 THEN 'wild' ELSE risk_level END AS rl, list_filter(followed, lambda t: NOT list_contains(okay, t)) AS bad FROM investors, (SELECT list(ticker) AS okay FROM assets WHERE rec))""",
)
def save_rules(spark, sf):
    inv = standins.investors(spark, sf)
    sent = inv.select(
        "investor_id", F.when(F.col("investor_id") % 13 == 0, "wild").otherwise(F.col("risk_level")).alias("risk_level"), "interests", "asset_types",
        F.concat(F.transform("followed_tickers", lambda t: F.lower(t)), F.array(F.lit(" "))).alias("followed_tickers"),
    )
    return di.checked_profiles(sent, all_assets(spark, sf)).select("investor_id", "problem")


cte(
    "boards",
    ["investors", "assets", "recs"],
    f"""
    SELECT i.investor_id, {_TIER_LIMIT.format(c='i.risk_level')} AS lim, list_position({_l(RISK_TIERS)}, i.risk_level) AS step, list_filter(i.followed, lambda t: list_contains(k.okay, t)) AS watch,
           coalesce(list(r.ticker ORDER BY r.rank) FILTER (r.ticker IS NOT NULL), []) AS sug FROM investors i CROSS JOIN (SELECT list(ticker) AS okay FROM assets WHERE rec) k LEFT JOIN recs r ON r.investor_id = i.investor_id GROUP BY i.investor_id, i.risk_level, i.followed, k.okay""",
)


def board(spark, sf):
    inv, cat = standins.investors(spark, sf), catalogue(spark, sf)
    p = all_assets(spark, sf).withColumn("as_of", F.lit("2001-08-20"))
    return cut_lineage(di.dashboard(inv, p, rc.recommend(inv, cat))), cat


@query(
    "dashboards",
    with_ctes("boards") + "SELECT investor_id, lim AS volatility_limit, step::BIGINT AS step, '2001-08-20' AS prices_as_of, array_to_string(watch, ',') AS watchlist, array_to_string(sug, ',') AS suggestions FROM boards",
)
def dashboards(spark, sf):
    b, _ = board(spark, sf)
    return b.select("investor_id", "volatility_limit", F.col("step").cast("bigint").alias("step"), "prices_as_of", F.array_join("watchlist", ",").alias("watchlist"), F.array_join("suggestions", ",").alias("suggestions"))


_LISTED = "(SELECT investor_id, lim, 'w' AS l, unnest(watch) AS ticker FROM boards UNION ALL SELECT investor_id, lim, 's', unnest(sug) FROM boards)"


@query(
    "dashboard_sector_spread",
    with_ctes("boards", "cat") + f"SELECT investor_id, sector, count(*) FILTER (l = 'w') AS watchlist, count(*) FILTER (l = 's') AS suggested FROM {_LISTED} JOIN cat USING (ticker) GROUP BY 1, 2",
)
def spread(spark, sf):
    return di.sector_spread(*board(spark, sf))


@query(
    "dashboard_risk_check",
    with_ctes("boards", "cat") + f"SELECT investor_id, count(*) FILTER (vol <= lim) AS within, count(*) FILTER (vol > lim) AS above, 0::BIGINT AS unknown FROM {_LISTED} JOIN cat USING (ticker) GROUP BY 1",
)
def risk_check(spark, sf):
    return di.risk_check(*board(spark, sf))


def selections(spark, sf):
    """What investors follow; every third also follows a planted ticker without bars."""
    followed = F.when(F.col("investor_id") % 3 == 0, F.array_append("followed_tickers", "NEW")).otherwise(F.col("followed_tickers"))
    return standins.investors(spark, sf).select("investor_id", followed.alias("tickers"))


@query(
    "selected_forecasts",
    with_ctes("investors", "bars")
    + """SELECT i.investor_id, i.ticker, f.d IS NOT NULL AS available, (DATE '2001-11-10' - f.d)::BIGINT AS age_days, (DATE '2001-11-10' - f.d) > 7 AS stale
         FROM (SELECT investor_id, unnest(CASE WHEN investor_id % 3 = 0 THEN list_append(followed, 'NEW') ELSE followed END) AS ticker FROM investors) i LEFT JOIN (SELECT ticker, max(d) AS d FROM bars GROUP BY 1) f USING (ticker)""",
)
def selected(spark, sf):
    f = standins.bars(spark, sf).groupBy("ticker").agg(F.max("Date").alias("date"))
    s = di.selected_forecasts(selections(spark, sf), f, F.lit("2001-11-10").cast("date"))
    return s.select("investor_id", "ticker", "available", F.col("age_days").cast("bigint").alias("age_days"), "stale")


@query(
    "unavailable_forecasts",
    with_ctes("investors", "bars")
    + "SELECT investor_id, string_agg(ticker, ',' ORDER BY pos) AS unavailable FROM (SELECT investor_id, unnest(f) AS ticker, generate_subscripts(f, 1) AS pos FROM (SELECT investor_id, CASE WHEN investor_id % 3 = 0 THEN list_append(followed, 'NEW') ELSE followed END AS f FROM investors)) WHERE ticker NOT IN (SELECT ticker FROM bars) GROUP BY 1",
)
def unavailable(spark, sf):
    f = standins.bars(spark, sf).groupBy("ticker").agg(F.max("Date").alias("date"))
    s = di.selected_forecasts(selections(spark, sf), f, F.lit("2001-11-10").cast("date"))
    return di.unavailable_tickers(s).withColumn("unavailable", F.array_join("unavailable", ","))


@query(
    "snapshots_for_investors",
    with_ctes("investors", "matched", "snapshot_rows", "assets")
    + """SELECT investor_id, ticker, rank, fin AS stance FROM (SELECT *, row_number() OVER (PARTITION BY investor_id ORDER BY ticker) AS rank FROM (
           SELECT DISTINCT x.investor_id, s.ticker, s.fin FROM (SELECT investor_id, risk_level, unnest(interests) AS interest FROM investors) x JOIN matched USING (interest) JOIN snapshot_rows s ON s.ticker = matched.ticker AND s.tier = x.risk_level)) WHERE rank <= 20""",
)
def investor_snapshots(spark, sf):
    from tickerloom.plans.evidence_queries import assembled

    snaps = cut_lineage(assembled(spark, sf).select("ticker", "risk_profile", F.col("signal.news_aware_stance").alias("stance")))
    s = di.snapshots_for_investors(standins.investors(spark, sf), all_assets(spark, sf), snaps)
    return s.select("investor_id", "ticker", F.col("rank").cast("bigint").alias("rank"), "stance")


@query(
    "research_detail",
    with_ctes("snapshot_rows", "raw_docs")
    + f"""SELECT o_orderkey, s.fin AS stance, n.docs AS recent_news FROM (SELECT o_orderkey, 'B' || lpad(CAST(o_custkey % 25 + 1 AS VARCHAR), 2, '0') AS ticker FROM orders) q
         LEFT JOIN snapshot_rows s ON s.ticker = q.ticker AND s.tier = 'moderate' LEFT JOIN (SELECT ticker, string_agg(document_id, ',' ORDER BY rank) AS docs FROM (SELECT ticker, document_id, row_number() OVER (PARTITION BY ticker ORDER BY pub DESC, document_id) AS rank
          FROM (SELECT document_id, pub, unnest(tickers) AS ticker FROM raw_docs WHERE source_type = 'news' AND pub <= {standins.AS_OF_S})) WHERE rank <= 3 GROUP BY 1) n ON n.ticker = q.ticker""",
)
def research_detail(spark, sf):
    from tickerloom.operators.retrieval import latest_articles
    from tickerloom.plans import evidence_queries as eq
    from tickerloom.plans.text_queries import as_of

    snaps = cut_lineage(eq.assembled(spark, sf).select("ticker", "risk_profile", F.col("signal.news_aware_stance").alias("stance")))
    req = standins.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit(" b"), F.lpad((F.col("o_custkey") % 25 + 1).cast("string"), 2, "0")).alias("ticker"), F.lit("moderate").alias("risk_profile")
    )
    found = di.snapshot_by_key(req, snaps).withColumn("ticker", F.upper(F.trim("ticker")))
    news = latest_articles(eq.evidence_chunks(spark, sf), as_of(), 3)
    sentiment = news.select("ticker").distinct().withColumn("score", F.lit(None).cast("double"))
    d = di.research_detail(found, news, sentiment)
    return d.select("o_orderkey", "stance", F.array_join("recent_news", ",").alias("recent_news"))
