"""Asset risk profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import profiles
from tickerloom.plans.catalog import query, r
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.sources import standins

cte("cal", ["bars"], "SELECT d, lag(d) OVER (ORDER BY d) AS prev FROM (SELECT DISTINCT d FROM bars)")
cte(
    "session_returns",
    ["bars", "cal"],
    "SELECT b.ticker, b.d, b.ac / nullif(p.ac, 0) - 1 AS ret FROM bars b JOIN cal USING (d) JOIN bars p ON p.ticker = b.ticker AND p.d = cal.prev",
)
cte(
    "pairs",
    ["session_returns"],
    """
    SELECT * FROM (SELECT a.ticker, a.d, a.ret, m.ret AS mkt, row_number() OVER (PARTITION BY a.ticker ORDER BY a.d DESC) AS rn
    FROM session_returns a JOIN session_returns m ON m.ticker = 'SPY' AND m.d = a.d WHERE a.ret IS NOT NULL AND m.ret IS NOT NULL) WHERE rn <= 252""",
)
cte(
    "risk",
    ["pairs", "bars"],
    """
    WITH st AS (SELECT t.ticker, count(p.ret) AS hist, stddev_samp(ret) * sqrt(252) AS vol, covar_samp(ret, mkt) / nullif(var_samp(mkt), 0) AS beta
                FROM (SELECT DISTINCT ticker FROM bars) t LEFT JOIN pairs p USING (ticker) GROUP BY 1),
    w AS (SELECT b.ticker, b.d, b.ac, row_number() OVER (PARTITION BY b.ticker ORDER BY b.d DESC) AS rn FROM bars b),
    dd AS (SELECT ticker, min(fall) AS dd FROM (SELECT w.ticker, ac / max(ac) OVER (PARTITION BY w.ticker ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS fall
           FROM w JOIN st USING (ticker) WHERE rn <= hist + 1) GROUP BY 1),
    pay AS (SELECT ticker, sum(dv) / nullif(arg_max(c, d), 0) AS dy FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM bars) WHERE rn <= 252 GROUP BY 1)
    SELECT ticker, hist, CASE WHEN hist >= 60 THEN round(vol, 6) END AS vol, CASE WHEN hist >= 60 THEN round(beta, 6) END AS beta,
           CASE WHEN hist >= 60 THEN round(dd, 6) END AS dd, CASE WHEN hist >= 60 THEN round(dy, 6) END AS dy
    FROM st LEFT JOIN dd USING (ticker) LEFT JOIN pay USING (ticker)""",
)
cte(
    "profiles",
    ["risk", "assets", "bars"],
    """
    SELECT a.*, r.hist, r.vol, r.beta, r.dd, r.dy, l.as_of,
           CASE WHEN vol IS NOT NULL THEN round((rank() OVER (ORDER BY vol) + (count(*) OVER (PARTITION BY vol) - 1) / 2.0::DOUBLE) / count(vol) OVER (), 4) END AS vol_rank
    FROM assets a JOIN (SELECT ticker, max(d) AS as_of FROM bars GROUP BY 1) l USING (ticker) LEFT JOIN risk r USING (ticker)""",
)


@query(
    "returns_on_market_calendar",
    with_ctes("session_returns") + 'SELECT ticker, CAST(d AS VARCHAR) AS "Date", round(ret, 8) AS ret FROM session_returns',
)
def calendar_returns(spark, sf):
    x = profiles.session_returns(standins.bars(spark, sf))
    return x.select("ticker", F.col("Date").cast("string").alias("Date"), r("ret", 8))


@query(
    "risk_features",
    with_ctes("risk")
    + "SELECT ticker, hist::BIGINT AS history_days, round(vol, 5) AS volatility_1y, round(beta, 5) AS beta, round(dd, 5) AS max_drawdown_1y, round(dy, 5) AS dividend_yield FROM risk",
)
def risk_features(spark, sf):
    x = profiles.risk_features(standins.bars(spark, sf))
    return x.select(
        "ticker",
        F.col("history_days").cast("bigint").alias("history_days"),
        *[r(n, 5) for n in ("volatility_1y", "beta", "max_drawdown_1y", "dividend_yield")],
    )


@query(
    "asset_profiles",
    with_ctes("profiles")
    + """SELECT ticker, name, asset_type, category, sector, array_to_string(themes, '|') AS themes, rec AS recommendation_eligible, fc AS forecast_eligible,
         history_note, CAST(as_of AS VARCHAR) AS as_of, round(vol, 5) AS volatility_1y, round(vol_rank, 4) AS volatility_rank FROM profiles""",
)
def asset_profiles(spark, sf):
    p = profiles.asset_profiles(standins.bars(spark, sf), standins.universe(spark, sf))
    return p.select(
        "ticker",
        "name",
        "asset_type",
        "category",
        "sector",
        F.array_join("themes", "|").alias("themes"),
        "recommendation_eligible",
        "forecast_eligible",
        "history_note",
        F.col("as_of").cast("string").alias("as_of"),
        r(F.col("risk.volatility_1y"), 5).alias("volatility_1y"),
        r(F.col("risk.volatility_rank"), 4).alias("volatility_rank"),
    )


@query(
    "price_percentile_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE) / count(*) OVER (), 8) AS pct FROM lineitem""",
)
def price_rank(spark, sf):
    """The averaged percentile rank over a whole fact table."""
    from tickerloom.operators.ranks import percentile_rank

    lines = standins.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return percentile_rank(lines, "l_extendedprice", "pct").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("pct", 8)
    )


@query(
    "universe_typed",
    with_ctes("assets")
    + """SELECT ticker, name, asset_type, category, sector, array_to_string(themes, '|') AS themes, rec AS recommendation_eligible, fc AS forecast_eligible, history_note FROM assets""",
)
def universe_typed(spark, sf):
    return profiles.read_universe(standins.universe(spark, sf)).withColumn("themes", F.array_join("themes", "|"))
