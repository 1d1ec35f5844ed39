"""Macro series and point-in-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.domain import MACRO_LAG_DAYS
from tickerloom.operators import asof, quality
from tickerloom.plans.catalog import query, r
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.sources import macro as macro_source
from tickerloom.sources import standins

cte(
    "macro_points",
    ["macro"],
    """
    SELECT sid, av, CASE WHEN sid = 'CPIAUCSL' THEN (val / nullif(lag(val, 12) OVER (PARTITION BY sid ORDER BY od), 0) - 1) * 100 ELSE val END AS val FROM macro""",
)
cte("session_dates", ["bars"], "SELECT DISTINCT d FROM bars")
cte(
    "macro_wide",
    ["macro_points", "session_dates"],
    """
    SELECT s.d, max(val) FILTER (sid = 'DFF') AS dff, max(val) FILTER (sid = 'DGS10') AS dgs, max(val) FILTER (sid = 'VIXCLS') AS vix, max(val) FILTER (sid = 'CPIAUCSL') AS cpi
    FROM session_dates s LEFT JOIN (
        SELECT p.sid, t.d, p.val FROM (SELECT sid, d FROM session_dates, (SELECT DISTINCT sid FROM macro_points)) t
        ASOF JOIN (SELECT * FROM macro_points WHERE val IS NOT NULL) p ON t.sid = p.sid AND t.d >= p.av) x ON s.d = x.d
    GROUP BY s.d""",
)



@query(
    "macro_import",
    """SELECT 'DFF' AS series_id, count(*) AS n, count(val)::BIGINT AS valued, CAST(min(od + 1) AS VARCHAR) AS first_available, sum(val)::BIGINT AS total
       FROM (SELECT CAST(o_orderdate AS DATE) AS od, CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice) AS BIGINT) END AS val FROM orders) WHERE val IS NOT NULL
       UNION ALL
       SELECT 'CPIAUCSL', count(*), count(val)::BIGINT, CAST(min(od + 50) AS VARCHAR), sum(val)::BIGINT
       FROM (SELECT CAST(o_orderdate AS DATE) AS od, CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice) AS BIGINT) END AS val FROM orders)""",
)
def macro_import(spark, sf):
    """Text rows as they land: an unparseable value for every pending order."""
    orders = standins.table(spark, sf, "orders")
    text = orders.select(
        F.explode(F.array(F.lit("DFF"), F.lit("CPIAUCSL"))).alias("series_id"),
        F.to_date("o_orderdate").cast("string").alias("observation_date"),
        F.when(F.col("o_orderstatus") == "P", ".")
        .otherwise(F.round("o_totalprice").cast("bigint").cast("string"))
        .alias("value"),
    )
    m = macro_source.import_macro(text)
    return m.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("valued"),
        F.min("available_date").cast("string").alias("first_available"),
        F.sum(F.col("value").cast("bigint")).alias("total"),
    )


@query(
    "macro_import_violations",
    """WITH t AS (SELECT o_orderkey AS k, s, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM orders, (VALUES ('DFF'), ('CPIAUCSL')) v(s)),
       p AS (SELECT k, s, d, try_cast(d AS DATE) AS day FROM t)
       SELECT s AS series_id, d AS observation_date, 'invalid_date' AS kind FROM p WHERE day IS NULL
       UNION ALL SELECT s, CAST(day AS VARCHAR), 'duplicate_date' FROM p WHERE day IS NOT NULL GROUP BY s, day HAVING count(*) > 1
       UNION ALL SELECT s, CAST(day AS VARCHAR), 'unsorted_date' FROM (SELECT s, day, lag(day) OVER (PARTITION BY s ORDER BY k) AS before FROM p) WHERE day < before""",
)
def macro_import_violations(spark, sf):
    """Orders in key order as an import file: pending ones carry no date, days repeat and go back."""
    text = standins.table(spark, sf, "orders").select(
        F.explode(F.array(F.lit("DFF"), F.lit("CPIAUCSL"))).alias("series_id"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.to_date("o_orderdate").cast("string")).alias("observation_date"),
        F.col("o_orderkey").alias("row_number"),
    )
    return macro_source.macro_violations(text, "row_number")


@query(
    "macro_vintages",
    """SELECT CAST(od AS VARCHAR) AS observation_date, CAST(rs AS VARCHAR) AS available_date, arg_max(p, k)::BIGINT AS value FROM (
       SELECT CAST(o_orderdate AS DATE) AS od, CAST(o_orderdate AS DATE) + CAST(o_custkey % 3 AS INTEGER) AS rs, CAST(round(o_totalprice) AS BIGINT) AS p, o_orderkey AS k, o_orderstatus AS st FROM orders)
       WHERE st <> 'P' GROUP BY od, rs""",
)
def macro_vintages(spark, sf):
    orders = standins.table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    observations = orders.select(
        F.lit("DFF").alias("series_id"),
        day.cast("string").alias("date"),
        F.date_add(day, (F.col("o_custkey") % 3).cast("int")).cast("string").alias("realtime_start"),
        F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.round("o_totalprice").cast("bigint").cast("string")).alias("value"),
        F.col("o_orderkey").alias("ingest_seq"),
    )
    v = macro_source.macro_vintages(observations)
    return v.select(
        F.col("observation_date").cast("string").alias("observation_date"),
        F.col("available_date").cast("string").alias("available_date"),
        F.col("value").cast("bigint").alias("value"),
    )


@query(
    "quarter_ranges",
    """SELECT c_custkey, CAST(greatest(s, q) AS VARCHAR) AS chunk_start, CAST(least(e - 1, CAST(q + INTERVAL 3 MONTH AS DATE) - 1) AS VARCHAR) AS chunk_end FROM (
         SELECT c_custkey, s, e, CAST(unnest(generate_series(date_trunc('quarter', s)::TIMESTAMP, date_trunc('quarter', e - 1)::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE) AS q FROM (
           SELECT o_custkey AS c_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1) WHERE s < e)""",
)
def quarter_ranges(spark, sf):
    lives = (
        standins.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e"))
    )
    q = macro_source.quarter_ranges(lives, "s", "e")
    return q.select("c_custkey", F.col("chunk_start").cast("string").alias("chunk_start"), F.col("chunk_end").cast("string").alias("chunk_end"))


@query(
    "macro_context_by_session",
    with_ctes("macro_wide")
    + """SELECT CAST(d AS VARCHAR) AS "Date", round(dff, 6) AS federal_funds_rate, round(dgs, 6) AS treasury_yield_10y, round(vix, 6) AS fred_vix, round(cpi, 5) AS inflation_cpi_yoy FROM macro_wide""",
)
def macro_context(spark, sf):
    bars = standins.bars(spark, sf)
    days = asof.macro_days(standins.macro(spark, sf), bars)
    dates = bars.select("Date").distinct()
    return dates.join(days, "Date", "left").select(
        F.col("Date").cast("string").alias("Date"),
        r("federal_funds_rate"),
        r("treasury_yield_10y"),
        r("fred_vix"),
        r("inflation_cpi_yoy", 5),
    )


@query(
    "asof_join_bars_to_macro",
    with_ctes("macro_wide", "bars")
    + """SELECT b.ticker, count(*) AS n, count(cpi) AS with_cpi, round(avg(ac * dff), 4) AS mean_scaled, round(max(vix), 6) AS top_vix
         FROM bars b LEFT JOIN macro_wide m ON b.d = m.d GROUP BY 1""",
)
def asof_bars(spark, sf):
    bars = standins.bars(spark, sf)
    j = bars.join(asof.macro_days(standins.macro(spark, sf), bars), "Date", "left")
    return j.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("inflation_cpi_yoy").alias("with_cpi"),
        r(F.avg(F.col("Adj Close") * F.col("federal_funds_rate")), 4).alias("mean_scaled"),
        r(F.max("fred_vix")).alias("top_vix"),
    )


@query(
    "asof_join_keyed",
    """WITH trades AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem),
            quotes AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) + 3 AS d, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
       SELECT k, count(*) AS n, count(price) AS priced, round(sum(price), 2) AS total FROM (SELECT t.k, q.price FROM trades t ASOF LEFT JOIN quotes q ON t.k = q.k AND t.d >= q.d) GROUP BY 1""",
)
def asof_keyed(spark, sf):
    lines = standins.table(spark, sf, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    trades = lines.select(F.col("l_suppkey").alias("k"), "d", "l_quantity")
    quotes = (
        lines.filter("l_returnflag = 'R'")
        .groupBy(F.col("l_suppkey").alias("k"), F.date_add("d", 3).alias("d"))
        .agg(F.max("l_extendedprice").alias("price"))
    )
    j = asof.asof_backward(trades, quotes, "d", ["k"], "price")
    return j.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), r(F.sum("price"), 2).alias("total")
    )


@query(
    "macro_provenance",
    with_ctes("macro")
    + """SELECT sid AS series_id, string_agg(lag, ',' ORDER BY lag::INT) AS lag_days, 0::BIGINT AS realtime_end_non_null, true AS manual_pattern
         FROM (SELECT DISTINCT sid, CAST(av - od AS VARCHAR) AS lag FROM macro) GROUP BY 1""",
)
def provenance(spark, sf):
    return quality.macro_provenance(standins.macro(spark, sf))


@query(
    "macro_join_audit",
    with_ctes("macro_points", "session_dates")
    + """SELECT p.sid AS series_id, count(*) AS checked, count(*) FILTER (day(t.d) = 3) AS mismatches, count(*) FILTER (day(t.d) = 4) AS future_rows
         FROM (SELECT sid, d FROM session_dates, (SELECT DISTINCT sid FROM macro_points)) t
         ASOF JOIN (SELECT * FROM macro_points WHERE val IS NOT NULL) p ON t.sid = p.sid AND t.d >= p.av GROUP BY 1""",
)
def macro_audit(spark, sf):
    """The day-table join against the bucketed keyed as-of join, per series; values are wrong on the third, dates on the fourth of a month."""
    bars = standins.bars(spark, sf)
    points = asof.macro_points(standins.macro(spark, sf))
    dates = bars.select("Date").distinct()
    horizon = bars.select(F.max("Date").alias("last_day"))
    spans = asof.validity(points, horizon)
    joined = spans.select(
        F.explode(F.sequence("valid_from", "valid_to")).alias("Date"), "series_id", F.col("value").alias("joined"), "valid_from"
    ).join(dates, "Date")
    grid = dates.withColumn("series_id", F.explode(F.array(*[F.lit(x) for x in MACRO_LAG_DAYS])))
    known = points.select("series_id", F.col("available_date").alias("Date"), "value")
    second = asof.asof_backward(grid, known, "Date", ["series_id"], "value")
    day = F.dayofmonth("Date")
    joined = joined.withColumns({"joined": F.when(day == 3, F.col("joined") + 1).otherwise(F.col("joined")), "valid_from": F.when(day == 4, F.date_add("Date", 1)).otherwise(F.col("valid_from"))})
    j = joined.join(second, ["series_id", "Date"])
    return j.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(~F.col("joined").eqNullSafe(F.col("value"))).alias("mismatches"),
        F.count_if(F.col("valid_from") > F.col("Date")).alias("future_rows"),
    )


@query(
    "missing_macro_months",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, o_custkey AS k FROM orders),
            life AS (SELECT k, min(mon) AS a, max(mon) AS b FROM m GROUP BY 1)
       SELECT k AS series, count(*) AS missing_months FROM (
         SELECT k, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS mon FROM life) w
         ANTI JOIN m USING (k, mon) GROUP BY 1""",
)
def missing_months(spark, sf):
    """Month gaps of every per-customer monthly series."""
    months = (
        standins.table(spark, sf, "orders")
        .select(F.col("o_custkey").alias("series"), F.trunc("o_orderdate", "month").alias("month"))
        .distinct()
    )
    life = months.groupBy("series").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    wanted = life.select("series", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return wanted.join(months, ["series", "month"], "left_anti").groupBy("series").agg(F.count(F.lit(1)).alias("missing_months"))
