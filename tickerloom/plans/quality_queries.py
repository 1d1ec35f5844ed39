"""Data-quality audits over bars, features and macro data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import asof
from tickerloom.operators import features as fe
from tickerloom.operators import quality as qa
from tickerloom.operators import twins
from tickerloom.operators.blocks import session_numbers
from tickerloom.plans.catalog import query, r
from tickerloom.plans.market_queries import input_frame
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.sources import landing, standins


@query(
    "duplicate_line_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_lines(spark, sf):
    return qa.duplicate_keys(standins.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("bar_date_range", with_ctes("bars") + 'SELECT CAST(min(d) AS VARCHAR) AS "first", CAST(max(d) AS VARCHAR) AS "last" FROM bars')
def bar_dates(spark, sf):
    return qa.date_range(standins.bars(spark, sf), "Date")


@query(
    "frame_summary",
    """SELECT count(*) AS rows, (count(*) - count(quality))::BIGINT * 2 + count(*) FILTER (text IS NULL) AS null_cells, 0::BIGINT AS infinite_cells, (count(*) - count(DISTINCT d.doc_id // 2))::BIGINT AS duplicate_keys
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def frame_summary(spark, sf):
    docs = standins.table(spark, sf, "documents").join(standins.table(spark, sf, "labels"), "doc_id", "left")
    return qa.frame_summary(docs.select(F.floor(F.col("doc_id") / 2).alias("pair"), "text", "quality", "toxic"), ["pair"])


TWIN_FIELDS = [
    "return_1d", "return_5d", "return_20d", "log_return_1d", "sma_5", "sma_20", "sma_50", "sma_200", "rsi_14",
    "atr_14", "rolling_volatility_20", "bollinger_position_20", "target_return_10d",
]
AUDITED = ["return_1d", "rsi_14", "sma_200", "volume_ratio_20"]


@query(
    "feature_audit",
    with_ctes("step3")
    + """SELECT "column", n AS rows, missing, missing AS nonfinite FROM (
           SELECT count(*) AS n, count(*) - count(r1) AS m1, count(*) - count(100 - 100 / (1 + ag / nullif(al14, 0))) AS m2, count(*) - count(sma_200) AS m3, count(*) - count(vr20) AS m4 FROM step3),
         LATERAL (VALUES ('return_1d', m1), ('rsi_14', m2), ('sma_200', m3), ('volume_ratio_20', m4)) t("column", missing)""",
)
def feature_audit(spark, sf):
    return qa.feature_audit(fe.technical_features(standins.bars(spark, sf)), AUDITED)


@query(
    "feature_twin_comparison",
    with_ctes("bars")
    + "SELECT field, (SELECT count(*) FROM bars) AS rows, (SELECT count(*) FROM bars WHERE day(d) = k) AS mismatches FROM (VALUES "
    + ", ".join(
        f"('{n}', {k})"
        for k, n in enumerate([
            "return_1d", "return_5d", "return_20d", "log_return_1d", "sma_5", "sma_20", "sma_50", "sma_200", "rsi_14",
            "atr_14", "rolling_volatility_20", "bollinger_position_20", "target_return_10d",
        ], 1)
    )
    + ") t(field, k)",
)
def feature_twin(spark, sf):
    """Two formulations of the features compared; in the second one, each field is wrong on one day of the month."""
    bars = standins.bars(spark, sf)
    second = fe.recomputed_features(bars)
    fields = [n for n in second.columns if n not in ("ticker", "Date")]
    day = F.dayofmonth("Date")
    second = second.withColumns({n: F.when(day == TWIN_FIELDS.index(n) + 1, 1e6).otherwise(F.col(n)) for n in fields})
    return qa.compare_columns(fe.technical_features(bars), second, ["ticker", "Date"], fields, 1e-8)


@query(
    "feature_folded_twin",
    with_ctes("bars")
    + "SELECT field, (SELECT count(*) FROM bars) AS rows, (SELECT count(*) FROM bars WHERE dayofyear(d) % 34 = k) AS mismatches FROM (VALUES "
    + ", ".join(f"('{n}', {k})" for k, n in enumerate(twins.FIELDS))
    + ") t(field, k)",
)
def feature_folded_twin(spark, sf):
    """All features against array folds; on every 34th day of the year each field is off by a thousandth, or there where it should be missing."""
    bars = standins.bars(spark, sf)
    turn = F.dayofyear("Date") % 34
    off = lambda n: F.coalesce(F.col(n), F.lit(0.0)) + 0.001 * F.greatest(F.lit(1.0), F.abs(F.col(n)))
    second = twins.folded_features(bars)
    second = second.withColumns({n: F.when(turn == k, off(n)).otherwise(F.col(n)) for k, n in enumerate(twins.FIELDS)})
    return qa.compare_columns(fe.technical_features(bars), second, ["ticker", "Date"], twins.FIELDS, 1e-8)


@query(
    "prefix_invariance",
    with_ctes("bars")
    + "SELECT ticker, least(count(*), 700) AS rows, count(*) FILTER (no <= 700 AND day(d) = 9) AS mismatches FROM (SELECT ticker, d, row_number() OVER (PARTITION BY ticker ORDER BY d) AS no FROM bars) GROUP BY 1",
)
def prefix_invariance(spark, sf):
    """Features of the first 700 sessions must not change when later sessions exist; on every ninth of a month one of them does."""
    bars = standins.bars(spark, sf)
    prefix = session_numbers(bars, "ticker", "Date").filter("session_no < 700").drop("session_no")
    names = ["return_20d", "sma_200", "ema_26", "macd_signal", "rsi_14", "atr_14", "rolling_volatility_20", "volume_ratio_20"]
    full = fe.technical_features(bars).select("ticker", "Date", *names)
    full = full.withColumn("volume_ratio_20", F.when(F.dayofmonth("Date") == 9, 1e6).otherwise(F.col("volume_ratio_20")))
    part = fe.technical_features(prefix).select("ticker", "Date", *[F.col(n).alias(f"{n}__p") for n in names])
    j = part.join(full, ["ticker", "Date"], "left")
    wrong = F.lit(False)
    for n in names:
        wrong = wrong | ~qa.is_close(F.col(n), F.col(f"{n}__p"), 1e-9, 1e-9)
    return j.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("mismatches"))


@query(
    "ohlc_plausibility",
    with_ctes("bars")
    + """SELECT ticker, count(*) FILTER (least(o, h, l, c, ac) <= 0) AS nonpositive, count(*) FILTER (h + 1e-8 < greatest(o, c, l) OR l - 1e-8 > least(o, c, h)) AS invalid_range,
         count(*) FILTER (v < 0) AS negative_volume, count(*) FILTER (v = 0) AS zero_volume, count(*) FILTER (dayofweek(d) IN (0, 6)) AS weekend_rows FROM bars GROUP BY 1""",
)
def plausibility(spark, sf):
    return qa.ohlc_plausibility(standins.bars(spark, sf))


@query(
    "raw_price_violations",
    """SELECT kind, count(*) AS n FROM (
         SELECT unnest(list_filter([CASE WHEN least(o, h, l, c) <= 0 THEN 'not_positive' END, CASE WHEN l > least(o, c) THEN 'low_above_body' END,
                CASE WHEN h < greatest(o, c) THEN 'high_below_body' END], lambda x: x IS NOT NULL)) AS kind
         FROM (SELECT l_extendedprice AS o, l_extendedprice * (1 - l_tax) AS h, l_extendedprice * (1 - l_discount) AS l, l_extendedprice * (1 - l_discount) - 0 AS c FROM lineitem)) GROUP BY 1""",
)
def price_violations(spark, sf):
    """Lines read as bars whose high is the taxed and low the discounted price: real violations."""
    price = F.col("l_extendedprice")
    bars = standins.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("ticker"),
        F.to_date("l_shipdate").alias("Date"),
        price.alias("Open"),
        (price * (1 - F.col("l_tax"))).alias("High"),
        (price * (1 - F.col("l_discount"))).alias("Low"),
        (price * (1 - F.col("l_discount"))).alias("Close"),
        (price * (1 - F.col("l_discount"))).alias("Adj Close"),
        F.col("l_quantity").alias("Volume"),
    )
    return qa.raw_price_violations(bars).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_coverage",
    with_ctes("bars")
    + """SELECT b.ticker, b.n AS rows, CAST(a AS VARCHAR) AS first_date, CAST(z AS VARCHAR) AS last_date, count(s.d) - b.n + 0 AS missing_sessions, 0::BIGINT AS extra_sessions
         FROM (SELECT ticker, count(*) AS n, min(d) AS a, max(d) AS z FROM bars GROUP BY 1) b JOIN (SELECT d FROM bars WHERE ticker = 'SPY') s ON s.d BETWEEN a AND z GROUP BY b.ticker, b.n, a, z""",
)
def coverage(spark, sf):
    x = qa.session_coverage(standins.bars(spark, sf))
    return x.withColumn("first_date", F.col("first_date").cast("string")).withColumn("last_date", F.col("last_date").cast("string"))


@query(
    "missing_sessions",
    with_ctes("bars")
    + """SELECT ticker, CAST(d AS VARCHAR) AS "Date" FROM (SELECT t.ticker, s.d FROM (SELECT ticker, min(d) AS a, max(d) AS z FROM bars GROUP BY 1) t
         JOIN (SELECT d FROM bars WHERE ticker = 'SPY') s ON s.d BETWEEN a AND z) ANTI JOIN bars USING (ticker, d)""",
)
def missing(spark, sf):
    return qa.missing_sessions(standins.bars(spark, sf)).withColumn("Date", F.col("Date").cast("string"))


@query(
    "corporate_actions",
    with_ctes("bars")
    + """SELECT ticker, count(*) FILTER (sp <> 0) AS split_rows, count(*) FILTER (dv <> 0) AS dividend_rows, round(max(abs(ret)) FILTER (sp <> 0), 8) AS split_day_max_abs_return,
         count(*) FILTER (abs(ret) > 0.5) AS returns_over_half FROM (SELECT *, ac / lag(ac) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM bars) GROUP BY 1""",
)
def actions(spark, sf):
    return qa.corporate_actions(standins.bars(spark, sf)).withColumn("split_day_max_abs_return", r(F.col("split_day_max_abs_return"), 8))


@query(
    "label_audit",
    with_ctes("step1", "eligible", "bars")
    + f"""SELECT ticker, count(target) AS labeled, count(*) - count(target) AS unlabeled, 0::BIGINT AS flag_mismatches,
          count(*) FILTER (target IS NOT NULL AND label_end > (SELECT max(d) FROM bars)) AS immature_labels, CAST(max(d) FILTER (target IS NOT NULL) AS VARCHAR) AS last_labeled_origin
          FROM step1 JOIN eligible USING (ticker) WHERE d >= DATE '{standins.FEATURES_START}' GROUP BY 1""",
)
def label_audit(spark, sf):
    last_day = standins.bars(spark, sf).agg(F.max("Date")).scalar()
    return qa.label_audit(input_frame(spark, sf), last_day)


@query(
    "target_check",
    with_ctes("step1", "eligible")
    + f"""SELECT count(*) AS checked_rows, count(target) AS labeled_rows, count(*) - count(target) AS unlabeled_rows, count(target) FILTER (day(d) = 3) AS mismatches, count(*) FILTER (day(d) = 4) AS flag_mismatches
          FROM step1 JOIN eligible USING (ticker) WHERE d >= DATE '{standins.FEATURES_START}'""",
)
def target_check(spark, sf):
    bars = standins.bars(spark, sf)
    f = fe.feature_dataset(bars, standins.universe(spark, sf), None, standins.FEATURES_START)
    # labels are wrong on the third and flags on the fourth of every month
    day, target, flag = F.dayofmonth("Date"), F.col("target_return_10d"), F.col("is_training_row")
    f = f.withColumns({"target_return_10d": F.when(day == 3, target + 1).otherwise(target), "is_training_row": F.when(day == 4, ~flag).otherwise(flag)})
    return qa.target_check(f, bars).drop("max_abs_error")


@query(
    "macro_preserves_rows",
    with_ctes("step1", "eligible")
    + f"""SELECT count(*) FILTER (day(d) = 2) AS lost, count(*) FILTER (day(d) = 4) AS added, count(*) FILTER (day(d) = 3) AS changed FROM step1 JOIN eligible USING (ticker) WHERE d >= DATE '{standins.FEATURES_START}'""",
)
def preserves(spark, sf):
    """The macro join must keep rows and labels; rows are lost on the second, changed on the third and added on the fourth of a month."""
    bars, universe = standins.bars(spark, sf), standins.universe(spark, sf)
    plain = fe.feature_dataset(bars, universe, None, standins.FEATURES_START)
    days = asof.macro_days(standins.macro(spark, sf), bars)
    enriched = fe.feature_dataset(bars, universe, days, standins.FEATURES_START)
    day, target = F.dayofmonth("Date"), F.col("target_return_10d")
    enriched = enriched.select("ticker", "Date", F.when(day == 3, F.coalesce(target, F.lit(0.0)) + 1).otherwise(target).alias("target_return_10d"))
    faulty = enriched.filter(day != 2).unionByName(enriched.filter(day == 4).withColumn("ticker", F.concat("ticker", F.lit(" again"))))
    return qa.rows_preserved(plain, faulty, ["ticker", "Date"], "target_return_10d")


FOLDS = [("1998-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"), ("2000-01-01", "2000-12-31")]


@query(
    "purge_counts",
    with_ctes("step1", "eligible")
    + f"""SELECT s AS evaluation_start, e AS evaluation_end, count(*) FILTER (d < s::DATE) AS naive_train, count(*) FILTER (d < s::DATE AND label_end < s::DATE) AS mature_train,
          count(*) FILTER (d < s::DATE) - count(*) FILTER (d < s::DATE AND label_end < s::DATE) AS purged_train,
          count(*) FILTER (d BETWEEN s::DATE AND e::DATE) AS naive_evaluation, count(*) FILTER (d BETWEEN s::DATE AND e::DATE AND label_end <= e::DATE) AS evaluation
          FROM step1 JOIN eligible USING (ticker), (VALUES {', '.join(f"('{a}', '{b}')" for a, b in FOLDS)}) f(s, e)
          WHERE target IS NOT NULL AND d >= DATE '{standins.FEATURES_START}' GROUP BY 1, 2""",
)
def purge(spark, sf):
    return qa.purge_counts(input_frame(spark, sf), FOLDS)


@query(
    "rsi_zero_loss_rows",
    with_ctes("step3") + 'SELECT ticker, CAST(d AS VARCHAR) AS "Date" FROM step3 WHERE al14 = 0',
)
def rsi_zero_loss(spark, sf):
    """Null RSI rows explained by a loss-free 14-session window."""
    bars = standins.bars(spark, sf)
    null_rsi = fe.technical_features(bars).filter(F.col("rsi_14").isNull()).select("ticker", "Date")
    from tickerloom.functions.columns import rolling_mean
    from tickerloom.operators.blocks import block_window, halo_blocks, own_rows

    w = block_window("ticker", "Date")
    _, loss = fe.gain_loss(w)
    b = halo_blocks(bars.select("ticker", "Date", "Adj Close"), "ticker", "Date", 20).withColumn("_loss", loss)
    zero = own_rows(b.withColumn("_avg", rolling_mean(F.col("_loss"), w, 14))).filter("_avg = 0").select("ticker", "Date")
    return null_rsi.join(zero, ["ticker", "Date"], "left_semi").withColumn("Date", F.col("Date").cast("string"))


cte(
    "bar_faults",
    ["bars"],
    "SELECT count(*) FILTER (least(o, h, l, c, ac) <= 0) AS np, count(*) FILTER (h + 1e-8 < greatest(o, c, l) OR l - 1e-8 > least(o, c, h)) AS ir, count(*) FILTER (v < 0) AS nv, count(*) FILTER (dayofweek(d) IN (0, 6)) AS wk FROM bars",
)


@query(
    "integrity_verdict",
    with_ctes("bar_faults", "bars")
    + """SELECT np AS nonpositive, ir AS invalid_range, nv AS negative_volume, wk AS weekend_rows, 0::BIGINT AS duplicate_keys, (SELECT count(*) FROM bars) - (SELECT count(*) FROM (SELECT DISTINCT ticker, d FROM bars)) AS excess,
         np + ir + nv + wk = 0 AS integrity_pass, CASE WHEN np + ir + nv + wk = 0 THEN 'CONDITIONAL' ELSE 'BLOCKED' END AS price_only_research, 'BLOCKED' AS current_serving FROM bar_faults""",
)
def verdict(spark, sf):
    bars = standins.bars(spark, sf)
    p = qa.ohlc_plausibility(bars).agg(
        *[F.sum(n).alias(n) for n in ("nonpositive", "invalid_range", "negative_volume", "weekend_rows")]
    )
    dup = qa.duplicate_keys(bars, ["ticker", "Date"]).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).scalar()
    faults = F.col("nonpositive") + F.col("invalid_range") + F.col("negative_volume") + F.col("weekend_rows")
    out = p.withColumn("duplicate_keys", dup).withColumn("excess", F.col("duplicate_keys"))
    passed = (faults + F.col("duplicate_keys")) == 0
    return out.select(
        "*",
        passed.alias("integrity_pass"),
        F.when(passed, "CONDITIONAL").otherwise("BLOCKED").alias("price_only_research"),
        F.lit("BLOCKED").alias("current_serving"),
    )


@query(
    "stride_sample",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(text), doc_id) - 1 AS rn FROM documents) WHERE rn % 20 = 0""",
)
def stride(spark, sf):
    docs = standins.table(spark, sf, "documents").select(
        "doc_id", F.lit("all").alias("key"), F.concat(F.sha2("text", 256), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id")
    )
    return qa.stride_sample(docs, "key", "id", 20, F.substring("id", 1, 2)).select("doc_id")


@query("seeded_sample")
def seeded(spark, sf):
    docs = standins.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return qa.hash_sample(docs, "id", 12)


@query(
    "problem_report",
    with_ctes("raw_docs")
    + """SELECT kind, n, examples FROM (
           SELECT p AS kind, count(*) AS n, array_to_string(list_sort((list(document_id ORDER BY document_id))[1:5]), ',') AS examples FROM (
             SELECT document_id, unnest(list_filter([CASE WHEN doc_id % 97 = 0 THEN 'available_missing' END, CASE WHEN doc_id % 31 = 0 THEN 'published_without_zone' END,
                    CASE WHEN doc_id % 97 <> 0 AND fet < av THEN 'fetched_before_available' END], lambda x: x IS NOT NULL)) AS p FROM raw_docs) GROUP BY 1)""",
)
def problems(spark, sf):
    d = standins.documents(spark, sf)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("available_at").isNull(), "available_missing"),
            F.when(~F.col("published_at").endswith("Z"), "published_without_zone"),
            F.when(F.to_timestamp("fetched_at") < F.to_timestamp("available_at"), "fetched_before_available"),
        )
    )
    return qa.problem_report(d.select(F.col("document_id").alias("id"), F.explode(kinds).alias("kind")))


@query(
    "append_first_wins",
    """WITH inc AS (SELECT event_id // 3 AS id, ts, event_type, event_id FROM events)
       SELECT id, arg_min(event_type, event_id) AS event_type, min(event_id) AS kept FROM inc GROUP BY 1""",
)
def append_first(spark, sf):
    """Every third event repeats an identity; the first arrival stays."""
    inc = standins.events(spark, sf).select(
        F.floor(F.col("event_id") / 3).alias("id"), "event_type", F.col("event_id").alias("kept")
    )
    return landing.first_by(inc, ["id"], "kept")
