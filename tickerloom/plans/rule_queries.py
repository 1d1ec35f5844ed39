"""Decision rules and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import fundamentals as fu
from tickerloom.operators import profiles, rules
from tickerloom.operators.asof import visible_facts
from tickerloom.plans.catalog import query, r
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.session import balanced
from tickerloom.sources import standins

AS_OF = standins.AS_OF_DATE
LIMIT = "CASE replace(lower(trim({p})), '_', ' ') WHEN 'very conservative' THEN 0.15 WHEN 'conservative' THEN 0.20 WHEN 'growth' THEN 0.45 WHEN 'aggressive' THEN 0.55 ELSE 0.35 END::DOUBLE"

cte(
    "cases",
    [],
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 100 - 3 AS fr, l_tax * 8 AS vol,
           CASE WHEN l_returnflag <> 'R' THEN (CAST(l_quantity AS INTEGER) % 7 - 3) / 5.0::DOUBLE END AS sent,
           CASE WHEN CAST(l_quantity AS INTEGER) % 6 <> 0 THEN l_quantity / 5 END AS width, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 100 - 3 - l_quantity / 10 END AS lower,
           CASE WHEN l_linenumber > 2 THEN l_linenumber / 10.0::DOUBLE END AS sw,
           CASE l_suppkey % 6 WHEN 0 THEN 'very_conservative' WHEN 1 THEN 'Conservative' WHEN 2 THEN 'moderate' WHEN 3 THEN 'growth' WHEN 4 THEN ' aggressive' ELSE 'Income' END AS prof,
           CASE l_suppkey % 6 WHEN 0 THEN 'Very Conservative' WHEN 1 THEN 'Conservative' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Growth' WHEN 4 THEN 'Aggressive' ELSE 'Moderate (default)' END AS disp
    FROM lineitem""",
)


def stance_cte(name: str, sent: str) -> None:
    cte(
        name,
        ["cases"],
        f"""
    SELECT *, CASE WHEN caution THEN 'CAUTION' WHEN expl THEN 'EXPLORE' ELSE 'MONITOR' END AS stance FROM (
      SELECT *, NOT caution AND fr >= 2 AND bull AND NOT (width IS NULL OR width > 6 OR loss) AND NOT conc AS expl FROM (
        SELECT *, {LIMIT.format(p='prof')} AS lim, fr < 0 OR vol > {LIMIT.format(p='prof')} OR coalesce({sent} <= -0.15, false) AS caution,
               coalesce({sent} >= 0.15, false) AS bull, coalesce(lower < 0 AND fr >= 0, false) AS loss, coalesce(sw > 0.30, false) AS conc, {sent} AS s FROM cases))""",
    )


stance_cte("aware", "sent")
stance_cte("baseline", "NULL::DOUBLE")
CODES = """array_to_string(list_filter([CASE WHEN disp = 'Moderate (default)' THEN 'UNKNOWN_PROFILE' END, CASE WHEN s IS NULL THEN 'SENTIMENT_MISSING' END,
    CASE WHEN fr < 0 THEN 'NEGATIVE_FORECAST' END, CASE WHEN vol > lim THEN 'VOLATILITY_EXCEEDS_LIMIT' END, CASE WHEN s <= -0.15 THEN 'BEARISH_SENTIMENT' END,
    CASE WHEN width IS NULL THEN 'INTERVAL_MISSING' WHEN width > 6 THEN 'INTERVAL_TOO_WIDE' END, CASE WHEN loss THEN 'INTERVAL_INCLUDES_LOSS' END,
    CASE WHEN conc THEN 'SECTOR_CONCENTRATION' END, CASE WHEN expl THEN 'EXPLORE_CONFLUENCE' END,
    CASE WHEN stance = 'MONITOR' AND fr < 2 THEN 'RETURN_BELOW_THRESHOLD' END, CASE WHEN stance = 'MONITOR' AND s IS NOT NULL AND NOT bull THEN 'SENTIMENT_NEUTRAL' END], lambda x: x IS NOT NULL), '|')"""
TRACE = """list_filter([CASE WHEN disp = 'Moderate (default)' THEN 'Risk profile ''' || prof || ''' not recognised; using Moderate limits.' END,
    CASE WHEN fr < 0 THEN printf('Downside risk: 10-day projected return is negative (%+.1f%%).', fr) END,
    CASE WHEN vol > lim THEN printf('Risk mismatch: volatility (%.2f) exceeds your %s limit (%.2f).', vol, disp, lim) END,
    CASE WHEN s <= -0.15 THEN printf('Adverse market environment: news sentiment is bearish (%+.2f).', s) END,
    CASE WHEN width IS NULL THEN 'No forecast uncertainty available; conviction capped at MONITOR.'
         WHEN width > 6 THEN printf('Forecast ambiguity: interval width (%.1f%%) exceeds threshold (6.0%%).', width) END,
    CASE WHEN loss THEN printf('Forecast range includes a loss (lower bound %+.1f%%).', lower) END,
    CASE WHEN conc THEN printf('Portfolio concentration: %.0f%% already in this sector (limit 30%%).', sw * 100) END,
    CASE WHEN expl THEN printf('Favorable trend: projected return is strong (%+.1f%%).', fr) END,
    CASE WHEN expl THEN printf('Supportive catalyst: news sentiment is bullish (%+.2f).', s) END,
    CASE WHEN expl THEN printf('Risk aligned: volatility (%.2f) fits your %s boundary.', vol, disp) END,
    CASE WHEN expl THEN printf('Model confidence: prediction interval is narrow (%.1f%%).', width) END,
    CASE WHEN stance = 'MONITOR' AND fr < 2 THEN printf('Moderate growth: projected return (%+.1f%%) is below the high-conviction threshold (+2.0%%).', fr)
         WHEN stance = 'MONITOR' THEN printf('Return outlook is positive (%+.1f%%).', fr) END,
    CASE WHEN stance = 'MONITOR' AND s IS NOT NULL AND NOT bull THEN printf('Balanced news backdrop: sentiment is neutral (%+.2f).', s) END,
    CASE WHEN stance = 'MONITOR' THEN printf('Risk acceptable: volatility (%.2f) is within %s limits.', vol, disp) END], lambda x: x IS NOT NULL)"""


def cases(spark, sf):
    q = F.col("l_quantity").cast("int")
    s = F.col("l_suppkey") % 6
    profile = (
        F.when(s == 0, "very_conservative")
        .when(s == 1, "Conservative")
        .when(s == 2, "moderate")
        .when(s == 3, "growth")
        .when(s == 4, " aggressive")
        .otherwise("Income")
    )
    fr = F.col("l_discount") * 100 - 3
    lines = standins.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"
    )
    return balanced(lines).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        fr.alias("forecast_return"),
        (F.col("l_tax") * 8).alias("volatility"),
        F.when(F.col("l_returnflag") != "R", (q % 7 - 3) / F.lit(5.0)).alias("sentiment"),
        F.when(q % 6 != 0, F.col("l_quantity") / 5).alias("interval_width"),
        F.when(F.col("l_linenumber") % 2 == 0, fr - F.col("l_quantity") / 10).alias("lower_bound"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") / F.lit(10.0)).alias("sector_weight"),
        profile.alias("risk_profile"),
    )


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "rule_stances",
    with_ctes("aware") + f"SELECT {KEYS}, stance, {CODES} AS codes, array_to_string({TRACE}, '|') AS trace FROM aware",
)
def rule_stances(spark, sf):
    """The whole decision list over every line of the largest table, all branches reached."""
    d = cases(spark, sf).withColumn(
        "_d",
        rules.base_stance(
            *[F.col(n) for n in ("forecast_return", "volatility", "sentiment", "interval_width", "risk_profile", "lower_bound", "sector_weight")]
        ),
    )
    return d.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("_d.stance").alias("stance"),
        F.array_join("_d.codes", "|").alias("codes"), F.array_join("_d.trace", "|").alias("trace"),
    )


@query(
    "rule_input_validation",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_tax * 8 - 0.04::DOUBLE < 0 THEN 'volatility must be a finite number >= 0'
         WHEN abs(l_discount * 15) > 1 THEN 'sentiment_score must be None or within [-1, 1]' WHEN l_quantity - 2 < 0 THEN 'prediction_interval_width must be None or >= 0'
         WHEN l_linenumber / 5.0::DOUBLE > 1 THEN 'sector_weight must be None or within [0, 1]' END AS reason FROM lineitem) GROUP BY 1""",
)
def validation(spark, sf):
    reason = rules.invalid_reason(
        F.col("l_discount"), F.col("l_tax") * 8 - F.lit(0.04), F.col("l_discount") * 15, F.col("l_quantity") - 2,
        F.col("l_tax"), F.col("l_linenumber") / F.lit(5.0),
    )
    return standins.table(spark, sf, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_NEWS_OK = "s IS NOT NULL"
cte(
    "hybrid",
    ["aware", "baseline"],
    f"""
    SELECT a.{KEYS.replace(', ', ', a.')}, a.sent, b.stance AS bst, a.stance AS ast, ['EXPLORE', 'MONITOR', 'CAUTION'] AS o,
           CASE WHEN a.l_linenumber <> 3 AND a.l_partkey % 4 <> 3 THEN a.sent END AS score, a.width, a.conc, a.l_partkey % 4 AS src, a.l_suppkey % 4 AS fr4, a.l_partkey % 5 AS cnt
    FROM aware a JOIN (SELECT {KEYS}, fr, vol, sent, width, any_value(stance) AS stance FROM baseline GROUP BY ALL) b
      ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.fr = b.fr AND a.vol = b.vol
         AND a.sent IS NOT DISTINCT FROM b.sent AND a.width IS NOT DISTINCT FROM b.width""",
)
cte(
    "hybrid2",
    ["hybrid"],
    """
    SELECT *, CASE WHEN sc2 IS NOT NULL AND list_position(o, ast) > list_position(o, bst) THEN ast ELSE bst END AS op,
           sc2 IS NOT NULL AND list_position(o, ast) > list_position(o, bst) AS lowered FROM (SELECT *, CASE WHEN cnt >= 2 THEN score END AS sc2 FROM hybrid)""",
)


@query(
    "hybrid_signal",
    with_ctes("hybrid2")
    + f"""SELECT {KEYS}, bst AS baseline_stance,
          CASE WHEN fr4 = 0 THEN list_extract(o, CAST(least(3, list_position(o, op) + 1) AS INTEGER)) WHEN fr4 = 1 AND op = 'MONITOR' AND NOT conc AND width IS NOT NULL THEN 'EXPLORE' ELSE op END AS final_stance,
          lowered OR (fr4 = 0 AND op <> 'CAUTION') OR (fr4 = 1 AND op = 'MONITOR' AND NOT conc AND width IS NOT NULL) AS provisional,
          CASE WHEN lowered THEN printf('News-driven caution (experimental): recent %s news is negative (%+.2f over %d articles), lowering the forecast-only stance from %s to %s, pending validation.',
                    CASE WHEN src < 2 THEN 'marketaux' ELSE 'alpha_vantage' END, sc2, cnt, bst, ast)
               WHEN sc2 >= 0.15 THEN printf('Recent %s news is positive (%+.2f over %d articles), but the stance stays %s — an unvalidated positive signal is not used to raise it.',
                    CASE WHEN src < 2 THEN 'marketaux' ELSE 'alpha_vantage' END, sc2, cnt, bst)
               WHEN sc2 <= -0.15 THEN printf('Recent %s news is also negative (%+.2f over %d articles), consistent with this %s stance.', CASE WHEN src < 2 THEN 'marketaux' ELSE 'alpha_vantage' END, sc2, cnt, bst) END AS news_line,
          CASE WHEN fr4 = 3 THEN 'Fundamentals check abstained: no recent SEC filing data with enough reported metrics for this asset.'
               WHEN fr4 = 0 AND op <> 'CAUTION' THEN 'Fundamentals-driven caution (experimental): SEC filings for fiscal year ending 2000-12-31 show weak operating margin, lowering the stance from ' || op || ' to '
                    || list_extract(o, CAST(least(3, list_position(o, op) + 1) AS INTEGER)) || ', pending validation.'
               WHEN fr4 = 0 THEN 'SEC fundamentals (fiscal year ending 2000-12-31) are also weak, consistent with this CAUTION stance.'
               WHEN fr4 = 1 AND op = 'MONITOR' AND NOT conc AND width IS NOT NULL THEN 'Fundamentals-driven upgrade (experimental): SEC filings for fiscal year ending 2000-12-31 show strong revenue growth, current ratio, raising the stance from MONITOR to EXPLORE, pending validation. Forecast caveats above still apply.'
               WHEN fr4 = 1 AND op = 'CAUTION' THEN 'SEC fundamentals (fiscal year ending 2000-12-31) are strong, but they never lift a CAUTION from forecast, risk or news rules.'
               WHEN fr4 = 1 AND op = 'MONITOR' THEN 'SEC fundamentals (fiscal year ending 2000-12-31) are strong, but ' || CASE WHEN conc THEN 'sector concentration' ELSE 'the missing forecast' END || ' blocks an upgrade.'
               WHEN fr4 = 1 THEN 'SEC fundamentals (fiscal year ending 2000-12-31) are also strong.'
               ELSE 'SEC fundamentals (fiscal year ending 2000-12-31) are mixed; they do not move the stance.' END AS fundamentals_line
          FROM hybrid2""",
)
def hybrid(spark, sf):
    p, s = F.col("l_partkey") % 4, F.col("l_suppkey") % 4
    d = cases(spark, sf)
    news = F.struct(
        F.col("sentiment").alias("score"),
        F.lit(0.5).alias("relevance"),
        F.when(F.col("l_linenumber") == 3, 200.0).otherwise(12.0).alias("recency_hours"),
        F.when(p < 2, "marketaux").when(p == 2, "alpha_vantage").otherwise("alpaca").alias("source"),
        (F.col("l_partkey") % 5).cast("int").alias("article_count"),
        F.lit(True).alias("relevant"),
    )

    def metric(name, assessment):
        return F.struct(F.lit(name).alias("name"), F.lit(1.0).alias("value"), assessment.alias("assessment"))

    rating = F.when(s == 0, "weak").when(s == 1, "strong").otherwise("neutral")
    fundamentals = F.struct(
        F.lit(0.2).alias("score"),
        rating.alias("rating"),
        F.array(
            metric("revenue_growth", F.when(s == 1, "strong").otherwise("neutral")),
            metric("operating_margin", F.when(s == 0, "weak").otherwise("neutral")),
            metric("current_ratio", F.when(s == 1, "strong").otherwise("neutral")),
        ).alias("metrics"),
        F.lit(3).alias("metric_count"),
        F.lit("2000-12-31").alias("period_end"),
        F.lit("2001-03-01").alias("filed"),
        F.when(s == 3, 500).otherwise(100).alias("age_days"),
        F.lit("sec_xbrl").alias("source"),
    )
    out = rules.hybrid_signal(d.withColumn("news", news).withColumn("fundamentals", fundamentals))
    trace = F.col("signal.decision_trace")
    is_news = lambda x: x.startswith("News-driven") | x.startswith("Recent ")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("signal.baseline_stance").alias("baseline_stance"),
        F.col("signal.news_aware_stance").alias("final_stance"),
        F.col("signal.provisional").alias("provisional"),
        F.try_element_at(F.filter(trace, is_news), F.lit(1)).alias("news_line"),
        F.element_at(trace, -1).alias("fundamentals_line"),
    )


@query(
    "rule_agreement_audit",
    with_ctes("aware")
    + "SELECT stance, count(*) AS cases, count(*) FILTER (l_orderkey % 7 <> 0) AS agreeing, count(*) FILTER (l_linenumber <> 5) AS with_trace FROM aware GROUP BY 1",
)
def rule_audit(spark, sf):
    """The decision list against a plain SQL restatement, plus trace completeness; some cases lack agreement, some a trace."""
    d = cases(spark, sf).withColumn(
        "_d",
        rules.base_stance(
            *[F.col(n) for n in ("forecast_return", "volatility", "sentiment", "interval_width", "risk_profile", "lower_bound", "sector_weight")]
        ),
    )
    second = F.expr(
        """CASE WHEN forecast_return < 0 OR coalesce(sentiment <= -0.15, false) OR volatility > CASE replace(lower(trim(risk_profile)), '_', ' ')
             WHEN 'very conservative' THEN 0.15D WHEN 'conservative' THEN 0.2D WHEN 'growth' THEN 0.45D WHEN 'aggressive' THEN 0.55D ELSE 0.35D END THEN 'CAUTION'
           WHEN forecast_return >= 2 AND coalesce(sentiment >= 0.15, false) AND coalesce(interval_width <= 6, false)
             AND NOT (coalesce(lower_bound, 0) < 0) AND coalesce(sector_weight, 0) <= 0.3D THEN 'EXPLORE' ELSE 'MONITOR' END"""
    )
    return d.groupBy(F.col("_d.stance").alias("stance")).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("_d.stance") == F.when(F.col("l_orderkey") % 7 == 0, "NONE").otherwise(second)).alias("agreeing"),
        F.count_if(F.size(F.filter("_d.trace", lambda x: F.col("l_linenumber") != 5)) > 0).alias("with_trace"),
    )


cte(
    "visible",
    ["facts"],
    f"""
    SELECT ticker, concept, s, e, arg_max(val, epoch(filed) * 100 + seq) AS val, max(filed) AS filed FROM facts WHERE filed <= DATE '{AS_OF}' GROUP BY 1, 2, 3, 4""",
)
_PREF = "list_position(" + str(fu.REVENUE) + ", concept)"
cte(
    "fund",
    ["visible"],
    f"""
    WITH ann AS (SELECT * FROM visible WHERE e - s BETWEEN 350 AND 380), ins AS (SELECT * FROM visible WHERE s IS NULL),
    ch AS (SELECT ticker, concept, e AS pe FROM ann WHERE {_PREF} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY e DESC, {_PREF}) = 1),
    rev AS (SELECT a.ticker, pe, max(val) FILTER (a.e = pe) AS rev, max(filed) FILTER (a.e = pe) AS filed, arg_max(val, a.e) FILTER (pe - a.e BETWEEN 330 AND 400) AS prev
            FROM ann a JOIN ch USING (ticker, concept) GROUP BY 1, 2),
    yr AS (SELECT a.ticker, max(val) FILTER (concept = 'OperatingIncomeLoss') AS inc, max(val) FILTER (concept = 'NetCashProvidedByUsedInOperatingActivities') AS cash,
                  coalesce(max(val) FILTER (concept = 'PaymentsToAcquirePropertyPlantAndEquipment'), max(val) FILTER (concept = 'PaymentsToAcquireProductiveAssets')) AS capex
           FROM ann a JOIN rev ON rev.ticker = a.ticker AND rev.pe = a.e GROUP BY 1),
    sh AS (SELECT ticker, e, max(val) FILTER (concept = 'AssetsCurrent') AS ass, max(val) FILTER (concept = 'LiabilitiesCurrent') AS lia, max(val) FILTER (concept = 'StockholdersEquity') AS eq,
                  coalesce(max(val) FILTER (concept = 'LongTermDebt'), coalesce(max(val) FILTER (concept = 'LongTermDebtNoncurrent'), max(val) FILTER (concept = 'LongTermDebtAndCapitalLeaseObligations'))
                           + coalesce(max(val) FILTER (concept = 'LongTermDebtCurrent'), 0)) AS debt FROM ins GROUP BY 1, 2),
    cu AS (SELECT ticker, CASE WHEN lia > 0 THEN ass / lia END AS cr FROM sh WHERE ass IS NOT NULL AND lia IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY e DESC) = 1),
    de AS (SELECT ticker, CASE WHEN eq > 0 THEN debt / eq END AS dte FROM sh WHERE debt IS NOT NULL AND eq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY e DESC) = 1)
    SELECT ticker, pe, filed, CASE WHEN prev > 0 THEN rev / prev - 1 END AS g, CASE WHEN rev > 0 THEN inc / rev END AS om, CASE WHEN rev > 0 THEN (cash - capex) / rev END AS fcf, cr, dte
    FROM rev LEFT JOIN yr USING (ticker) LEFT JOIN cu USING (ticker) LEFT JOIN de USING (ticker) WHERE DATE '{AS_OF}' - pe <= 456""",
)


def _points(col: str, strong: str, weak: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN 0 WHEN {strong} THEN 1 WHEN {weak} THEN -1 ELSE 0 END"


cte(
    "fund_signal",
    ["fund"],
    f"""
    SELECT *, round(pts / n, 4) AS score, CASE WHEN pts / n >= 0.6 THEN 'strong' WHEN pts / n <= -0.4 THEN 'weak' ELSE 'neutral' END AS rating, DATE '{AS_OF}' - filed AS age FROM (
      SELECT *, ({_points('g', 'g >= 0.1', 'g < 0')} + {_points('om', 'om >= 0.15', 'om < 0')} + {_points('fcf', 'fcf >= 0.1', 'fcf < 0')} + {_points('cr', 'cr >= 1.5', 'cr < 1')}
              + {_points('dte', 'dte <= 0.5', 'dte > 2')})::DOUBLE AS pts,
             (g IS NOT NULL)::INT + (om IS NOT NULL)::INT + (fcf IS NOT NULL)::INT + (cr IS NOT NULL)::INT + (dte IS NOT NULL)::INT AS n FROM fund) WHERE n >= 3""",
)


@query(
    "visible_facts",
    with_ctes("visible")
    + 'SELECT ticker, concept, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", round(val, 2) AS val, CAST(filed AS VARCHAR) AS filed FROM visible',
)
def facts_visible(spark, sf):
    v = visible_facts(standins.facts(spark, sf), AS_OF)
    return v.select("ticker", "concept", *[F.col(n).cast("string").alias(n) for n in ("start", "end", "filed")], r("val", 2))


@query(
    "fundamental_metrics",
    with_ctes("fund")
    + """SELECT ticker, CAST(pe AS VARCHAR) AS period_end, CAST(filed AS VARCHAR) AS filed, round(g, 6) AS revenue_growth, round(om, 6) AS operating_margin,
         round(fcf, 6) AS free_cash_flow_margin, round(cr, 6) AS current_ratio, round(dte, 6) AS debt_to_equity FROM fund""",
)
def metrics(spark, sf):
    m = fu.metric_values(standins.facts(spark, sf), AS_OF)
    return m.select("ticker", F.col("period_end").cast("string").alias("period_end"), F.col("filed").cast("string").alias("filed"), *[r(n) for n in fu.METRICS])


@query(
    "fundamentals_signals",
    with_ctes("assets", "fund_signal")
    + """SELECT a.ticker, score, rating, n::BIGINT AS metric_count, age::BIGINT AS age_days, round(g, 4) AS revenue_growth FROM assets a LEFT JOIN fund_signal f USING (ticker)""",
)
def signals(spark, sf):
    tickers = profiles.read_universe(standins.universe(spark, sf)).select("ticker")
    s = fu.fundamentals_signals(standins.facts(spark, sf), tickers, AS_OF)
    growth = F.filter("fundamentals.metrics", lambda m: m["name"] == "revenue_growth")
    return s.select(
        "ticker",
        r(F.col("fundamentals.score"), 4).alias("score"),
        F.col("fundamentals.rating").alias("rating"),
        F.col("fundamentals.metric_count").cast("bigint").alias("metric_count"),
        F.col("fundamentals.age_days").cast("bigint").alias("age_days"),
        F.try_element_at(growth, F.lit(1))["value"].alias("revenue_growth"),
    )


@query(
    "asset_stance_requests",
    with_ctes("profiles")
    + """SELECT o_orderkey, status, CASE WHEN status = 'evaluated' THEN CASE WHEN fr < 0 OR v > lim THEN 'CAUTION' ELSE 'MONITOR' END END AS stance FROM (
           SELECT o_orderkey, CASE WHEN p.ticker IS NULL THEN 'unknown_ticker' WHEN coalesce(q.v0, p.vol) IS NULL THEN 'no_volatility' ELSE 'evaluated' END AS status, coalesce(q.v0, p.vol) AS v, fr, lim FROM (
             SELECT o_orderkey, 'b' || lpad(CAST(o_custkey % 30 + 1 AS VARCHAR), 2, '0') AS t, o_totalprice / 100000 - 2 AS fr, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000000 END AS v0,
                    CASE o_orderpriority WHEN '1-URGENT' THEN 0.55 WHEN '2-HIGH' THEN 0.45 ELSE 0.35 END::DOUBLE AS lim FROM orders) q LEFT JOIN profiles p ON upper(q.t) = p.ticker)""",
)
def stance_requests(spark, sf):
    requests = standins.table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("b"), F.lpad((F.col("o_custkey") % 30 + 1).cast("string"), 2, "0")).alias("ticker"),
        (F.col("o_totalprice") / 100000 - 2).alias("forecast_return"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 1000000).alias("volatility"),
        F.lit(None).cast("double").alias("sentiment"),
        F.lit(None).cast("double").alias("width"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "aggressive").when(F.col("o_orderpriority") == "2-HIGH", "growth").alias("risk_profile"),
    )
    p = profiles.asset_profiles(standins.bars(spark, sf), standins.universe(spark, sf))
    return rules.asset_stance(requests, p).select("o_orderkey", "status", "stance")


@query(
    "forecast_assessments",
    with_ctes("profiles", "investors")
    + """SELECT investor_id, ticker, status, CASE WHEN status <> 'unavailable' THEN CASE WHEN fr < 0 OR vol > lim THEN 'CAUTION' ELSE 'MONITOR' END END AS stance FROM (
           SELECT *, CASE WHEN vol IS NULL THEN 'unavailable' WHEN investor_id % 2 = 0 OR DATE '2001-11-06' - as_of > 7 THEN 'historical' ELSE 'evaluated' END AS status FROM (
             SELECT i.investor_id, i.ticker, (i.investor_id % 7 - 2) / 100.0::DOUBLE * 100 AS fr, p.vol, p.as_of, CASE i.risk_level WHEN 'very_conservative' THEN 0.15 WHEN 'conservative' THEN 0.20 WHEN 'moderate' THEN 0.35 WHEN 'growth' THEN 0.45 ELSE 0.55 END::DOUBLE AS lim
             FROM (SELECT investor_id, risk_level, unnest(followed) AS ticker FROM investors) i LEFT JOIN (SELECT * FROM profiles WHERE rec) p USING (ticker)))""",
)
def assessments(spark, sf):
    """Each investor's followed tickers with a dated forecast, judged for that investor's risk level."""
    inv = standins.investors(spark, sf)
    pred = (F.col("investor_id") % 7 - 2) / F.lit(100.0)
    f = inv.select("investor_id", F.explode("followed_tickers").alias("ticker")).select(
        "investor_id", "ticker", pred.alias("predicted_return_10d"), (pred - 0.01).alias("lower_return"), F.lit(2.0).alias("uncertainty_width_pp"),
        (F.col("investor_id") % 2 == 0).alias("stale_snapshot"),
    )
    p = profiles.asset_profiles(standins.bars(spark, sf), standins.universe(spark, sf))
    a = rules.assess_forecasts(f, p, inv, F.lit("2001-11-06").cast("date"))
    return a.select("investor_id", "ticker", F.col("assessment_status").alias("status"), "stance")
