"""Forecast partitions, baselines, calibration, evaluation, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import forecast as fc
from tickerloom.operators import walkforward as wf
from tickerloom.operators.features import MODEL_INPUTS
from tickerloom.plans.catalog import query, r
from tickerloom.plans.market_queries import _SQL_INPUTS, input_frame
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.session import cut_lineage
from tickerloom.sources import standins

T, C, E = "1999-07-01", "1999-10-01", "2000-01-01"
Y = "target_return_10d"

cte(
    "parts",
    ["inputs"],
    f"""SELECT *, CASE WHEN target IS NULL THEN NULL WHEN d < DATE '{T}' AND label_end < DATE '{T}' THEN 'training' WHEN d >= DATE '{T}' AND d < DATE '{C}' AND label_end < DATE '{C}' THEN 'inner'
        WHEN d >= DATE '{C}' AND d < DATE '{E}' AND label_end < DATE '{E}' THEN 'calibration' END AS part FROM inputs""",
)
cte("train", ["parts"], "SELECT * FROM parts WHERE part = 'training' AND ticker IN (SELECT ticker FROM parts WHERE part = 'training' GROUP BY 1 HAVING count(*) >= 252)")
cte("base", ["train"], "SELECT avg(target) AS mean, median(target) AS med, avg((target > 0)::INT) > 0.5 AS up FROM train")
cte(
    "calib",
    ["parts", "train", "base"],
    """SELECT abs(target - med) AS c, abs(target - med) / greatest(vol20 * sqrt(10 / 252.0::DOUBLE), 0.005) AS s, d, label_end FROM parts, base WHERE part = 'calibration' AND ticker IN (SELECT ticker FROM train)""",
)
cte(
    "quant",
    ["calib"],
    "SELECT (list(s ORDER BY s))[CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT)] AS sq, (list(c ORDER BY c))[CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT)] AS cq, count(*) AS n FROM calib",
)


def parts(spark, sf):
    return fc.purged_partitions(input_frame(spark, sf), T, C, E)


def eligible_parts(spark, sf):
    p = cut_lineage(parts(spark, sf))
    return p.join(fc.eligible_tickers(p).select("ticker"), "ticker", "left_semi")


@query(
    "purged_partitions",
    with_ctes("parts") + "SELECT part, count(*) AS rows, CAST(min(d) AS VARCHAR) AS first_origin, CAST(max(d) AS VARCHAR) AS last_origin, CAST(max(label_end) AS VARCHAR) AS latest_outcome FROM parts WHERE part IS NOT NULL GROUP BY 1",
)
def partitions(spark, sf):
    return parts(spark, sf).filter("part IS NOT NULL").groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("Date").cast("string").alias("first_origin"), F.max("Date").cast("string").alias("last_origin"),
        F.max("label_end_date").cast("string").alias("latest_outcome"),
    )


@query("forecast_eligibility", with_ctes("parts") + "SELECT ticker, count(*) AS rows FROM parts WHERE part = 'training' GROUP BY 1 HAVING count(*) >= 252")
def eligibility(spark, sf):
    return fc.eligible_tickers(parts(spark, sf))


@query(
    "training_contract",
    with_ctes("inputs")
    + """SELECT kind, count(*) AS n FROM (
           SELECT 'missing_outcome_date' AS kind FROM inputs WHERE target IS NOT NULL AND month(d) = 3 AND day(d) = 3 UNION ALL SELECT 'outcome_not_later' FROM inputs WHERE target IS NOT NULL AND month(d) = 3 AND day(d) = 4
           UNION ALL SELECT 'target_not_finite' FROM inputs WHERE target IS NOT NULL AND month(d) = 3 AND day(d) = 5 UNION ALL SELECT 'duplicate_origin' FROM inputs WHERE month(d) = 3 AND day(d) = 8
           UNION ALL SELECT 'missing_origin' FROM inputs WHERE d = DATE '1999-06-15') GROUP BY 1""",
)
def contract(spark, sf):
    """The input contract over all rows, with faults of every kind planted by date."""
    d = input_frame(spark, sf)
    march = lambda n: (F.month("Date") == 3) & (F.dayofmonth("Date") == n)
    end = F.when(march(3) & F.col(Y).isNotNull(), None).when(march(4), F.col("Date")).otherwise(F.col("label_end_date"))
    target = F.when(march(5) & F.col(Y).isNotNull(), float("nan")).otherwise(F.col(Y))
    faulty = d.withColumns({"label_end_date": end, Y: target}).unionByName(d.filter(march(8)))
    origin = F.when(F.col("Date") != fc.day("1999-06-15"), F.col("Date"))
    return fc.contract_violations(faulty.withColumn("Date", origin))


@query(
    "training_medians",
    with_ctes("train") + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(median({c}), 6) AS median FROM train" for n, c in _SQL_INPUTS.items()),
)
def medians(spark, sf):
    return fc.training_medians(eligible_parts(spark, sf).filter("part = 'training'")).select("feature", r("median"))


@query(
    "training_moments",
    with_ctes("train") + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 5) AS std FROM train" for n, c in _SQL_INPUTS.items() if n not in ("rsi_14", "volume_change_1d")),
)
def moments(spark, sf):
    names = [n for n in MODEL_INPUTS if n not in ("rsi_14", "volume_change_1d")]
    d = eligible_parts(spark, sf).filter("part = 'training'").select(*names).unpivot([], names, "feature", "value")
    return d.groupBy("feature").agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value"), 5).alias("std"))


@query("baseline_constants", with_ctes("base") + "SELECT round(mean, 8) AS mean, round(med, 8) AS median, up AS majority_up FROM base")
def constants(spark, sf):
    train = eligible_parts(spark, sf).filter("part = 'training'")
    from tickerloom.operators.ranks import exact_median

    med = exact_median(train.select(F.lit(1).alias("g"), Y), ["g"], Y).select("median").scalar()
    return train.agg(r(F.avg(Y), 8).alias("mean"), (F.avg((F.col(Y) > 0).cast("double")) > 0.5).alias("majority_up")).select("mean", r(med, 8).alias("median"), "majority_up")


def median_predictions(spark, sf, part):
    p = eligible_parts(spark, sf)
    median = fc.target_median(p.filter("part = 'training'"))
    return p, median, p.filter(F.col("part") == part).withColumn("prediction", F.lit(median))


@query(
    "calibration_quantiles",
    with_ctes("quant", "calib") + "SELECT round(sq, 6) AS scaled_quantile, round(cq, 6) AS constant_quantile, n AS rows, (SELECT count(DISTINCT d) FROM calib) AS dates, (SELECT CAST(max(label_end) AS VARCHAR) FROM calib) AS latest_outcome FROM quant",
)
def calibration(spark, sf):
    _, _, cal = median_predictions(spark, sf, "calibration")
    c = fc.calibration_record(cal)
    rows = [(c["scaled_quantile"], c["constant_quantile"], c["rows"], c["dates"], str(c["latest_outcome"]))]
    d = spark.createDataFrame(rows, "scaled_quantile double, constant_quantile double, rows bigint, dates bigint, latest_outcome string")
    return d.withColumn("scaled_quantile", r(F.col("scaled_quantile"))).withColumn("constant_quantile", r(F.col("constant_quantile")))


cte(
    "evaluated",
    ["parts", "train", "base", "quant"],
    f"""SELECT d, target AS y, med AS p, med - sq * sc AS lo, med + sq * sc AS hi, mean, med, up FROM (SELECT *, greatest(vol20 * sqrt(10 / 252.0::DOUBLE), 0.005) AS sc FROM parts), base, quant
        WHERE target IS NOT NULL AND d >= DATE '{E}' AND ticker IN (SELECT ticker FROM train)""",
)
_EVAL = """count(*) AS rows, round(avg(abs(y - p)) * 100, 6) AS "MAE_pp", round(sqrt(avg((y - p) * (y - p))) * 100, 6) AS "RMSE_pp", round(avg(((y > 0) = (p > 0))::INT) * 100, 6) AS direction_accuracy_pct,
    round((count(*) FILTER (y > 0 AND p > 0) / count(*) FILTER (y > 0) + count(*) FILTER (y <= 0 AND p <= 0) / count(*) FILTER (y <= 0)) / 2 * 100, 6) AS balanced_accuracy_pct,
    round(avg((y >= lo AND y <= hi)::INT), 6) AS interval_coverage, round(avg(hi - lo) * 100, 6) AS mean_interval_width_pp,
    round(avg(hi - lo + 20 * (greatest(lo - y, 0) + greatest(y - hi, 0))) * 100, 5) AS interval_score_pp, round(avg(abs(y - mean)) * 100, 6) AS "mean_baseline_MAE_pp\""""
_EVAL_NAMES = ["MAE_pp", "RMSE_pp", "direction_accuracy_pct", "balanced_accuracy_pct", "interval_coverage", "mean_interval_width_pp", "mean_baseline_MAE_pp"]


def evaluated(spark, sf, by=None):
    p, median, cal = median_predictions(spark, sf, "calibration")
    stats = p.filter("part = 'training'").agg(F.avg(Y).alias("m"), F.avg((F.col(Y) > 0).cast("double")).alias("u")).first()
    q = fc.calibration_record(cal)["scaled_quantile"]
    rows = fc.with_interval(p.filter(F.col("Date") >= fc.day(E)).withColumn("prediction", F.lit(median)), q)
    return fc.evaluate(rows, stats["m"], median, stats["u"] > 0.5, by=by)


@query("forecast_evaluation", with_ctes("evaluated") + f"SELECT {_EVAL} FROM evaluated")
def evaluation(spark, sf):
    return evaluated(spark, sf).select("rows", *[r(n) for n in _EVAL_NAMES], r("interval_score_pp", 5))


@query("forecast_evaluation_by_month", with_ctes("evaluated") + """SELECT CAST(date_trunc('month', d)::DATE AS VARCHAR) AS month, count(*) AS rows, round(avg(abs(y - p)) * 100, 6) AS "MAE_pp", round(avg((y >= lo AND y <= hi)::INT), 6) AS interval_coverage FROM evaluated GROUP BY 1""")
def evaluation_by_month(spark, sf):
    e = evaluated(spark, sf, [F.trunc("Date", "month").cast("string").alias("month")])
    return e.select("month", "rows", r("MAE_pp"), r("interval_coverage"))


@query(
    "interval_comparison",
    with_ctes("evaluated", "quant")
    + "SELECT 'scaled' AS band, count(*) AS rows, round(avg((y >= lo AND y <= hi)::INT), 6) AS coverage, round(avg(hi - lo) * 100, 6) AS width_pp FROM evaluated UNION ALL SELECT 'constant', count(*), round(avg((abs(y - p) <= cq)::INT), 6), round(avg(2 * cq) * 100, 6) FROM evaluated, quant",
)
def intervals(spark, sf):
    p, median, cal = median_predictions(spark, sf, "calibration")
    c = fc.calibration_record(cal)
    rows = p.filter(F.col("Date") >= fc.day(E)).filter(F.col(Y).isNotNull()).withColumn("prediction", F.lit(median))
    d = fc.with_interval(rows, c["scaled_quantile"])
    d = d.withColumn("c_lo", F.col("prediction") - c["constant_quantile"]).withColumn("c_hi", F.col("prediction") + c["constant_quantile"])
    x = fc.interval_comparison(d, {"scaled": ("lower_return", "upper_return"), "constant": ("c_lo", "c_hi")})
    return x.select("band", "rows", r("coverage"), r("width_pp"))


@query("ridge_forecast")
def ridge_forecast(spark, sf):
    """Ridge selected on inner error, calibrated, evaluated; tested against the closed form."""
    frame = cut_lineage(input_frame(spark, sf))
    m = fc.train_model(frame, T, C, E, model="ridge")
    e = fc.evaluate(m.predict(m.servable(frame)), m.metadata["training_mean"], m.metadata["training_median"], m.metadata["training_majority_up"])
    return e.withColumn("model", F.lit(m.metadata["selected_model"]))


YEARS = [1998, 1999, 2000]
cte(
    "fold_dates",
    [],
    "SELECT y AS fold, make_date(y - 1, 7, 1) AS t, make_date(y - 1, 10, 1) AS c, make_date(y, 1, 1) AS e, make_date(y + 1, 1, 1) AS n FROM (VALUES " + ", ".join(f"({y})" for y in YEARS) + ") v(y)",
)
cte(
    "fold_inputs",
    ["inputs", "fold_dates"],
    """SELECT * FROM inputs, fold_dates WHERE target IS NOT NULL QUALIFY sum((d < t AND label_end < t)::INT) OVER (PARTITION BY fold, ticker) >= 252""",
)
cte(
    "fold_scores",
    ["fold_inputs"],
    """
    WITH base AS (SELECT fold, avg(target) AS mean, median(target) AS med, avg((target > 0)::INT) > 0.5 AS up FROM fold_inputs WHERE d < c AND label_end < c GROUP BY 1),
    said AS (SELECT fold, 'mean' AS model, mean AS p, mean, med, up FROM base UNION ALL SELECT fold, 'median', med, mean, med, up FROM base),
    cal AS (SELECT fold, model, abs(target - p) / greatest(vol20 * sqrt(10 / 252.0::DOUBLE), 0.005) AS s FROM fold_inputs JOIN said USING (fold) WHERE d >= c AND d < e AND label_end < e),
    q AS (SELECT fold, model, (list(s ORDER BY s))[CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT)] AS sq FROM cal GROUP BY 1, 2)
    SELECT fold, model, target AS y, p, p - sq * sc AS lo, p + sq * sc AS hi, mean, med, up FROM (SELECT *, greatest(vol20 * sqrt(10 / 252.0::DOUBLE), 0.005) AS sc FROM fold_inputs WHERE d >= e AND d < n AND label_end < n)
      JOIN said USING (fold) JOIN q USING (fold, model)""",
)
_FOLD_NAMES = ["MAE_pp", "RMSE_pp", "R2", "direction_accuracy_pct", "balanced_accuracy_pct", "always_up_accuracy_pct", "training_majority_accuracy_pct", "interval_coverage", "mean_interval_width_pp", "mean_baseline_MAE_pp", "median_baseline_MAE_pp"]


@query(
    "walk_forward",
    with_ctes("fold_scores")
    + f"""SELECT fold, model, {_EVAL}, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS "R2", round(avg((y > 0)::INT) * 100, 6) AS always_up_accuracy_pct, round(avg(((y > 0) = up)::INT) * 100, 6) AS training_majority_accuracy_pct,
          round(avg(abs(y - med)) * 100, 6) AS "median_baseline_MAE_pp" FROM fold_scores GROUP BY 1, 2""",
)
def walk_forward(spark, sf):
    """Mean and median baselines by evaluation year, refitted and calibrated in each fold."""
    e = wf.walk_forward(input_frame(spark, sf), YEARS, ("mean", "median"))
    return e.select("fold", "model", "rows", *[r(n) for n in _FOLD_NAMES], r("interval_score_pp", 5))


@query("walk_forward_ridge")
def walk_forward_ridge(spark, sf):
    """Ridge by evaluation year from one set of normal equations; tested against the closed form of each fold."""
    return wf.walk_forward(input_frame(spark, sf), YEARS, ("ridge",))


@query("boosted_forecast")
def boosted_forecast(spark, sf):
    """Boosted trees selected over the whole grid on inner error, calibrated, evaluated."""
    frame = cut_lineage(input_frame(spark, sf))
    m = fc.train_model(frame, T, C, E, model="boosted", grid=fc.GRID)
    e = fc.evaluate(m.predict(m.servable(frame)), m.metadata["training_mean"], m.metadata["training_median"], m.metadata["training_majority_up"])
    return e.withColumn("model", F.lit(m.metadata["selected_model"]))


@query("block_bootstrap")
def bootstrap(spark, sf):
    """Paired gain of the training mean over the training median, resampled in date blocks."""
    p, median, _ = median_predictions(spark, sf, "calibration")
    mean = p.filter("part = 'training'").agg(F.avg(Y)).first()[0]
    daily = fc.daily_gain(p.filter(F.col("Date") >= fc.day(E)).withColumn("prediction", F.lit(mean)), median)
    return fc.block_bootstrap(cut_lineage(daily))


@query(
    "latest_forecasts",
    with_ctes("evaluated", "parts", "train", "base") + """SELECT ticker, CAST(max(d) AS VARCHAR) AS "Date", (DATE '2001-11-10' - max(d))::BIGINT AS data_age_days, (DATE '2001-11-10' - max(d)) > 7 AS stale FROM parts WHERE ticker IN (SELECT ticker FROM train) GROUP BY 1""",
)
def latest(spark, sf):
    p, median, _ = median_predictions(spark, sf, "calibration")
    f = fc.latest_forecasts(p.withColumn("prediction", F.lit(median)), F.lit("2001-11-10").cast("date"))
    return f.select("ticker", F.col("Date").cast("string").alias("Date"), F.col("data_age_days").cast("bigint").alias("data_age_days"), "stale")


@query(
    "origin_tasks",
    with_ctes("step1") + """SELECT ticker, CAST(d AS VARCHAR) AS "Date", CAST(label_end AS VARCHAR) AS label_end_date FROM step1 WHERE rn >= 252 AND (rn - 252) % 5 = 0 AND label_end <= DATE '2000-12-31'""",
)
def origins(spark, sf):
    o = fc.origin_tasks(standins.bars(spark, sf), 252, 10, 5, "2000-12-31")
    return o.select("ticker", F.col("Date").cast("string").alias("Date"), F.col("label_end_date").cast("string").alias("label_end_date"))


@query(
    "context_baselines",
    with_ctes("step1")
    + """SELECT ticker, CAST(d AS VARCHAR) AS "Date", round(CASE WHEN count(r10) OVER w10 = 10 THEN median(r10) OVER w10 END, 7) AS median_10, round(CASE WHEN count(lr1) OVER w20 = 20 THEN greatest(stddev_samp(lr1) OVER w20 * sqrt(10), 0.005) END, 7) AS scale
         FROM step1 WINDOW w10 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def context(spark, sf):
    b = fc.context_baselines(standins.bars(spark, sf))
    return b.select("ticker", F.col("Date").cast("string").alias("Date"), r("median_10", 7), r("scale", 7))
