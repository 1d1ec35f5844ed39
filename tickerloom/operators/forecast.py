"""Leak-free forecast training, calibration and evaluation on DataFrames and MLlib."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.domain import HORIZON, SESSIONS_PER_YEAR
from tickerloom.functions.columns import ratio
from tickerloom.operators.blocks import block_window, halo_blocks, own_rows, session_numbers
from tickerloom.operators.features import MODEL_INPUTS
from tickerloom.operators.ranks import exact_median, order_statistic
from tickerloom.session import cut_lineage

TARGET = "target_return_10d"
MINIMUM_SCALE = 0.005
# bounded grid: depth, step size, rounds
GRID = [(d, s, n) for d, s in ((1, 0.03), (2, 0.03), (3, 0.03), (2, 0.1)) for n in (10, 50, 150)]


def day(value: str) -> Column:
    return F.lit(value).cast("date")


# --- partitions ------------------------------------------------------------------------


def purged_partitions(frame: DataFrame, tuning: str, calibration: str, evaluation: str) -> DataFrame:
    """Adds ``part``: training, inner, calibration or null for rows whose outcome overlaps the next part."""
    if not tuning < calibration < evaluation:
        raise ValueError("Expected strictly ordered date boundaries")
    t, c, e = day(tuning), day(calibration), day(evaluation)
    d, end = F.col("Date"), F.col("label_end_date")
    part = (
        F.when((d < t) & (end < t), "training")
        .when((d >= t) & (d < c) & (end < c), "inner")
        .when((d >= c) & (d < e) & (end < e), "calibration")
    )
    return frame.withColumn("part", F.when(F.col(TARGET).isNotNull(), part))


def eligible_tickers(parts: DataFrame, min_rows: int = 252) -> DataFrame:
    n = parts.filter("part = 'training'").groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    return n.filter(F.col("rows") >= min_rows)


def contract_violations(frame: DataFrame) -> DataFrame:
    """(kind, n) of broken training-input rules."""
    has = F.col(TARGET).isNotNull()
    rules = {
        "missing_outcome_date": has & F.col("label_end_date").isNull(),
        "outcome_not_later": has & (F.col("label_end_date") <= F.col("Date")),
        "target_not_finite": has & (F.isnan(TARGET) | (F.abs(TARGET) == float("inf"))),
        "missing_origin": F.col("Date").isNull(),
    }
    stats = frame.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    dup = frame.groupBy("ticker", "Date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    long = stats.unpivot([], list(rules), "kind", "n").filter("n > 0")
    return long.unionByName(dup.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("duplicate_origin").alias("kind"), "n"))


# --- preprocessing ---------------------------------------------------------------------


def training_medians(train: DataFrame, names: list[str] = MODEL_INPUTS) -> DataFrame:
    """Exact median per predictor (feature, median), fitted on the training rows only."""
    long = train.select(*names).unpivot([], names, "feature", "value")
    return exact_median(long, ["feature"], "value")


@dataclass
class Preprocess:
    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.coalesce(F.col(n), F.lit(m)) for n, m in self.medians.items()})

    def scale(self, df: DataFrame) -> DataFrame:
        """Standardised by population moments; a constant column stays centred."""
        return df.withColumns({f"{n}__z": (F.col(n) - self.means[n]) / (self.stds[n] or 1.0) for n in self.medians})


def fit_preprocess(train: DataFrame, names: list[str] = MODEL_INPUTS) -> Preprocess:
    """A few dozen numbers reach the driver: one median, mean and deviation per predictor."""
    medians = {row["feature"]: row["median"] for row in training_medians(train, names).collect()}
    missing = sorted(set(names) - set(medians))
    if missing:
        raise ValueError(f"All-missing predictors in training: {missing}")
    p = Preprocess({n: medians[n] for n in names})
    stats = p.impute(train).agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    ).first()
    p.means = {n: stats[f"m_{n}"] for n in names}
    p.stds = {n: stats[f"s_{n}"] for n in names}
    return p


# --- candidates ------------------------------------------------------------------------


@dataclass
class Candidate:
    name: str
    predict: Callable[[DataFrame], DataFrame]
    params: dict


def constant(name: str, value: float) -> Candidate:
    return Candidate(name, lambda df: df.withColumn("prediction", F.lit(float(value))), {"value": value})


def _assembled(p: Preprocess, df: DataFrame, scaled: bool) -> DataFrame:
    d = p.impute(df)
    names = list(p.medians)
    if scaled:
        d = p.scale(d)
        names = [f"{n}__z" for n in names]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(d)


def _tidy(original: DataFrame, predicted: DataFrame) -> DataFrame:
    """Original columns (unimputed) back next to the prediction is not needed downstream; drop helpers only."""
    return predicted.drop("_x", "_y", "_pc", *[c for c in predicted.columns if c.endswith("__z")])


def ridge(train: DataFrame, p: Preprocess, alpha: float) -> Candidate:
    """Ridge on standardised columns; the penalty is mapped to the solver's scaled objective."""
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(TARGET).alias("s")).first()
    model = LinearRegression(
        featuresCol="_x", labelCol=TARGET, predictionCol="prediction", solver="normal", elasticNetParam=0.0,
        regParam=alpha / stats["n"] * stats["s"], standardization=False,
    ).fit(_assembled(p, train, True))
    return Candidate(
        f"Ridge alpha={alpha:g}", lambda df: _tidy(df, model.transform(_assembled(p, df, True))),
        {"alpha": alpha, "coefficients": [float(x) for x in model.coefficients], "intercept": float(model.intercept)},
    )


def elastic_net(train: DataFrame, p: Preprocess, reg: float = 0.001, mix: float = 0.5) -> Candidate:
    model = LinearRegression(
        featuresCol="_x", labelCol=TARGET, predictionCol="prediction", elasticNetParam=mix, regParam=reg, standardization=False
    ).fit(_assembled(p, train, True))
    return Candidate("Elastic net", lambda df: _tidy(df, model.transform(_assembled(p, df, True))), {"reg": reg, "mix": mix})


def boosted(train: DataFrame, p: Preprocess, depth: int, step: float, rounds: int) -> Candidate:
    """Boosted trees on the centred target, at least 100 rows per leaf."""
    mean = train.agg(F.avg(TARGET)).first()[0]
    data = _assembled(p, train, False).withColumn("_y", F.col(TARGET) - mean)
    model = GBTRegressor(
        featuresCol="_x", labelCol="_y", predictionCol="prediction", maxDepth=depth, stepSize=step, maxIter=rounds,
        minInstancesPerNode=100, seed=42,
    ).fit(data)

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(_assembled(p, df, False))
        return _tidy(df, out.withColumn("prediction", F.col("prediction") + mean))

    return Candidate(f"Boosted trees depth={depth} step={step:g} rounds={rounds}", predict, {"depth": depth, "step": step, "rounds": rounds})


def forest(train: DataFrame, p: Preprocess, trees: int = 50, depth: int = 5) -> Candidate:
    model = RandomForestRegressor(
        featuresCol="_x", labelCol=TARGET, predictionCol="prediction", numTrees=trees, maxDepth=depth, minInstancesPerNode=100, seed=42
    ).fit(_assembled(p, train, False))
    return Candidate("Random forest", lambda df: _tidy(df, model.transform(_assembled(p, df, False))), {"trees": trees, "depth": depth})


def pca_ridge(train: DataFrame, p: Preprocess, k: int, alpha: float = 100.0) -> Candidate:
    x = _assembled(p, train, True)
    reducer = PCA(k=k, inputCol="_x", outputCol="_pc").fit(x)
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(TARGET).alias("s")).first()
    model = LinearRegression(
        featuresCol="_pc", labelCol=TARGET, predictionCol="prediction", solver="normal", elasticNetParam=0.0,
        regParam=alpha / stats["n"] * stats["s"], standardization=False,
    ).fit(reducer.transform(x))
    return Candidate(
        f"PCA({k}) + ridge", lambda df: _tidy(df, model.transform(reducer.transform(_assembled(p, df, True)))), {"k": k, "alpha": alpha}
    )


def blend(a: Candidate, b: Candidate) -> Candidate:
    """Even mix of two candidates."""

    def predict(df: DataFrame) -> DataFrame:
        first = a.predict(df).withColumnRenamed("prediction", "_first")
        return b.predict(first).withColumn("prediction", (F.col("_first") + F.col("prediction")) / 2).drop("_first")

    return Candidate(f"Blend of {a.name} and {b.name}", predict, {})


def candidate_scores(candidate: Candidate, inner: DataFrame) -> tuple[float, float]:
    e = F.col(TARGET) - F.col("prediction")
    row = candidate.predict(inner).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).first()
    return row["mae"], row["rmse"]


def choose(candidates: list[Candidate], inner: DataFrame) -> tuple[int, list[dict]]:
    """Lowest inner MAE, then RMSE, then the first."""
    records = []
    for c in candidates:
        mae, rmse = candidate_scores(c, inner)
        records.append({"model": c.name, "inner_mae": mae, "inner_rmse": rmse})
    best = min(range(len(records)), key=lambda i: (records[i]["inner_mae"], records[i]["inner_rmse"]))
    return best, records


# --- calibration and prediction -----------------------------------------------------------


def volatility_scale() -> Column:
    return F.greatest(F.col("rolling_volatility_20") * math.sqrt(HORIZON / SESSIONS_PER_YEAR), F.lit(MINIMUM_SCALE))


def finite_sample_quantile(df: DataFrame, score: str, coverage: float) -> DataFrame:
    """Value at rank ceil((n+1) * coverage); no row when the sample is too small."""
    return order_statistic(df.withColumn("_all", F.lit(1)), ["_all"], score, lambda n: F.ceil((n + 1) * F.lit(coverage)), "quantile").select("quantile")


def calibration_record(predicted: DataFrame, coverage: float = 0.9) -> dict:
    residual = F.abs(F.col(TARGET) - F.col("prediction"))
    d = predicted.select("Date", "label_end_date", residual.alias("constant"), (residual / volatility_scale()).alias("scaled"))
    quantiles = {}
    for n in ("scaled", "constant"):
        row = finite_sample_quantile(d, n, coverage).first()
        if row is None:
            raise ValueError("The calibration window has too few rows for this coverage")
        quantiles[f"{n}_quantile"] = row[0]
    stats = d.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("Date").alias("dates"), F.max("label_end_date").alias("latest_outcome")).first()
    return {"coverage": coverage, **quantiles, **stats.asDict()}


def with_interval(predicted: DataFrame, scaled_quantile: float | Column) -> DataFrame:
    q = F.lit(scaled_quantile) if not isinstance(scaled_quantile, Column) else scaled_quantile
    half = q * volatility_scale()
    return predicted.withColumns(
        {"lower_return": F.col("prediction") - half, "upper_return": F.col("prediction") + half, "uncertainty_width_pp": half * 200}
    )


@dataclass
class ForecastModel:
    candidate: Candidate
    calibration: dict
    metadata: dict

    def servable(self, frame: DataFrame) -> DataFrame:
        """The rows that may be forecast: origins after the calibration window, tickers known to training."""
        late = frame.filter(F.col("Date") >= day(self.metadata["evaluation_start"]))
        return late.join(self.metadata["eligible"].select("ticker"), "ticker", "left_semi")

    def predict(self, frame: DataFrame) -> DataFrame:
        """Forecasts with intervals for every row; raises if a row may not be forecast (see ``servable``)."""
        known = self.metadata["eligible"].select("ticker", F.lit(True).alias("_known"))
        fault = F.when(F.col("Date") < day(self.metadata["evaluation_start"]), "origin inside the calibration window").when(F.col("_known").isNull(), "ticker unknown to training")
        first = frame.select("ticker", "Date").join(known, "ticker", "left").withColumn("fault", fault).filter("fault IS NOT NULL").orderBy("ticker", "Date").first()
        if first is not None:
            raise ValueError(f"No forecast for {first['ticker']} at {first['Date']}: {first['fault']}")
        return with_interval(self.candidate.predict(frame), self.calibration["scaled_quantile"])


def train_model(
    frame: DataFrame,
    tuning: str,
    calibration: str,
    evaluation: str,
    model: str = "auto",
    coverage: float = 0.9,
    min_training_rows: int = 252,
    grid: list[tuple[int, float, int]] | None = None,
    refit: bool = False,
) -> ForecastModel:
    """Candidates chosen on inner error, then frozen and calibrated on later, purged rows."""
    parts = purged_partitions(frame, tuning, calibration, evaluation)
    eligible = eligible_tickers(parts, min_training_rows)
    parts = cut_lineage(parts.join(eligible.select("ticker"), "ticker", "left_semi"))
    train, inner, cal = (parts.filter(F.col("part") == n) for n in ("training", "inner", "calibration"))
    p = fit_preprocess(train)
    makers: list[Callable[[DataFrame, Preprocess], Candidate]] = []
    if model in ("auto", "boosted"):
        makers += [lambda d, q, g=g: boosted(d, q, *g) for g in (grid or [(2, 0.03, n) for n in (1, 10, 50)])]
    if model in ("auto", "ridge"):
        makers += [lambda d, q, a=a: ridge(d, q, a) for a in (100.0, 1000.0)]
    if model in ("auto", "mean"):
        makers.append(lambda d, q: constant("Training-mean baseline", d.agg(F.avg(TARGET)).first()[0]))
    if model in ("auto", "median"):
        makers.append(lambda d, q: constant("Training-median baseline", target_median(d)))
    candidates = [m(train, p) for m in makers]
    best, records = choose(candidates, inner)
    chosen, fit_rows = candidates[best], train
    if refit:
        cut = day(calibration)
        fit_rows = parts.filter((F.col("Date") < cut) & (F.col("label_end_date") < cut) & F.col(TARGET).isNotNull())
        chosen = makers[best](fit_rows, fit_preprocess(fit_rows))
    stats = fit_rows.agg(F.avg(TARGET).alias("mean"), F.avg((F.col(TARGET) > 0).cast("double")).alias("up")).first()
    metadata = {
        "selected_model": chosen.name,
        "selection": records,
        "eligible": eligible,
        "evaluation_start": evaluation,
        "training_mean": stats["mean"],
        "training_median": target_median(fit_rows),
        "training_majority_up": stats["up"] > 0.5,
    }
    return ForecastModel(chosen, calibration_record(chosen.predict(cal), coverage), metadata)


def target_median(df: DataFrame) -> float:
    return exact_median(df.select(F.lit(1).alias("_g"), TARGET), ["_g"], TARGET).first()["median"]


# --- evaluation -----------------------------------------------------------------------------


def evaluate(predicted: DataFrame, mean: float, median: float, majority_up: bool, coverage: float = 0.9, by: list[Column] | None = None) -> DataFrame:
    """All metrics in one aggregate; rows need target, prediction, lower_return, upper_return."""
    y, p, lo, hi = F.col(TARGET), F.col("prediction"), F.col("lower_return"), F.col("upper_return")
    e = y - p
    up, said = y > 0, p > 0

    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    score = hi - lo + F.lit(2 / (1 - coverage)) * (F.when(y < lo, lo - y).otherwise(0.0) + F.when(y > hi, y - hi).otherwise(0.0))
    balanced = (ratio(F.sum((up & said).cast("double")), F.count_if(up)) + ratio(F.sum((~up & ~said).cast("double")), F.count_if(~up))) / 2
    spread = F.count(F.lit(1)) * F.var_pop(y)
    return predicted.filter(y.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.avg(F.abs(e)) * 100).alias("MAE_pp"),
        (F.sqrt(F.avg(e * e)) * 100).alias("RMSE_pp"),
        (1 - ratio(F.sum(e * e), F.nullif(spread, F.lit(0.0)))).alias("R2"),
        (share(up == said) * 100).alias("direction_accuracy_pct"),
        (balanced * 100).alias("balanced_accuracy_pct"),
        (share(up) * 100).alias("always_up_accuracy_pct"),
        (share(up == F.lit(majority_up)) * 100).alias("training_majority_accuracy_pct"),
        share((y >= lo) & (y <= hi)).alias("interval_coverage"),
        (F.avg(hi - lo) * 100).alias("mean_interval_width_pp"),
        (F.avg(score) * 100).alias("interval_score_pp"),
        (F.avg(F.abs(y - F.lit(mean))) * 100).alias("mean_baseline_MAE_pp"),
        (F.avg(F.abs(y - F.lit(median))) * 100).alias("median_baseline_MAE_pp"),
    )


def interval_comparison(df: DataFrame, bands: dict[str, tuple[str, str]]) -> DataFrame:
    """Coverage and width of several lower/upper column pairs side by side."""
    pairs = F.array(*[F.struct(F.lit(n).alias("band"), F.col(lo).alias("lo"), F.col(hi).alias("hi")) for n, (lo, hi) in bands.items()])
    d = df.select(F.col(TARGET).alias("y"), F.explode(pairs).alias("b"))
    y, lo, hi = F.col("y"), F.col("b.lo"), F.col("b.hi")
    return d.groupBy(F.col("b.band").alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(((y >= lo) & (y <= hi)).cast("double")).alias("coverage"), (F.avg(hi - lo) * 100).alias("width_pp")
    )


def block_bootstrap(daily: DataFrame, lengths=(10, 20, 40), repeats: int = 1000, seed: int = 42) -> DataFrame:
    """Date-block bootstrap of sum/count: 2.5 and 97.5 percent quantiles per block length.

    ``daily`` has Date, s and c, one row per date, so it is bounded by the calendar.  A
    block's total is the difference of two running totals: repeats x blocks rows are joined
    by position, never repeats x dates.
    """
    numbered = session_numbers(daily.withColumn("_all", F.lit("all")), "_all", "Date", "no").drop("_all")
    years = numbered.withColumn("_y", F.year("Date"))
    inside = Window.partitionBy("_y").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(1)).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    per_year = years.groupBy("_y").agg(F.sum("s").alias("ys"), F.sum("c").alias("yc"))
    base = per_year.select("_y", F.coalesce(F.sum("ys").over(before), F.lit(0.0)).alias("bs"), F.coalesce(F.sum("yc").over(before), F.lit(0)).alias("bc"))
    running = (
        years.withColumn("is", F.sum("s").over(inside)).withColumn("ic", F.sum("c").over(inside)).join(base, "_y")
        .select((F.col("no") + 1).alias("at"), (F.col("is") + F.col("bs")).alias("cs"), (F.col("ic") + F.col("bc")).alias("cc"))
    )
    zero = running.limit(0).sparkSession.createDataFrame([(0, 0.0, 0)], "at bigint, cs double, cc bigint")
    running = cut_lineage(running.unionByName(zero))
    n = running.agg(F.max("at")).first()[0]
    spark = daily.sparkSession
    usable = [k for k in lengths if n >= k]
    draws = spark.range(repeats).select(F.col("id").alias("rep"), F.explode(F.array(*[F.lit(k) for k in usable])).alias("len"))
    draws = draws.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(n) / F.col("len")).cast("int") - 1)))
    start = F.pmod(F.xxhash64("rep", "len", "block", F.lit(seed)), F.lit(n) - F.col("len") + 1)
    size = F.least(F.col("len").cast("bigint"), F.lit(n) - F.col("block") * F.col("len"))
    draws = draws.withColumn("a", start).withColumn("b", F.col("a") + size)
    j = draws.join(running.select(F.col("at").alias("a"), F.col("cs").alias("s0"), F.col("cc").alias("c0")), "a").join(
        running.select(F.col("at").alias("b"), F.col("cs").alias("s1"), F.col("cc").alias("c1")), "b"
    )
    samples = j.groupBy("len", "rep").agg((F.sum(F.col("s1") - F.col("s0")) / F.sum(F.col("c1") - F.col("c0"))).alias("v"))
    return samples.groupBy(F.col("len").alias("block_sessions")).agg(
        F.count(F.lit(1)).alias("samples"), F.percentile("v", 0.025).alias("lower_95_pp"), F.percentile("v", 0.975).alias("upper_95_pp")
    )


def daily_gain(predicted: DataFrame, median: float) -> DataFrame:
    y = F.col(TARGET)
    gain = (F.abs(y - F.lit(median)) - F.abs(y - F.col("prediction"))) * 100
    return predicted.filter(y.isNotNull()).groupBy("Date").agg(F.sum(gain).alias("s"), F.count(F.lit(1)).alias("c"))


# --- serving and context baselines --------------------------------------------------------------


def latest_forecasts(predicted: DataFrame, today: Column) -> DataFrame:
    """Newest origin per ticker with age and staleness; a struct maximum, no sort of a ticker's history."""
    fields = [c for c in predicted.columns if c != "ticker"]
    newest = predicted.groupBy("ticker").agg(F.max_by(F.struct(*fields), "Date").alias("f")).select("ticker", "f.*")
    age = F.datediff(today, "Date")
    return newest.withColumn("data_age_days", age).withColumn("stale", age > 7).withColumn("status", F.lit("experimental_snapshot_forecast"))


def origin_tasks(bars: DataFrame, context: int, horizon: int, stride: int, end: str) -> DataFrame:
    """Origins with enough past sessions and a label that matures inside the fold, every ``stride`` sessions."""
    b = halo_blocks(bars.select("ticker", "Date"), "ticker", "Date", 0, horizon)
    w = block_window("ticker", "Date")
    b = own_rows(b.withColumn("label_end_date", F.lead("Date", horizon).over(w)))
    past = F.col("session_no") - (context - 1)
    return b.filter((past >= 0) & (past % stride == 0) & (F.col("label_end_date") <= day(end))).select("ticker", "Date", "session_no", "label_end_date")


def context_baselines(bars: DataFrame) -> DataFrame:
    """Rolling median of the last ten 10-session returns, and the scaled deviation of 20 log returns."""
    w = block_window("ticker", "Date")
    b = halo_blocks(bars.select("ticker", "Date", F.col("Adj Close").alias("p")), "ticker", "Date", 25)
    b = b.select("*", (ratio(F.col("p"), F.lag("p", 10).over(w)) - 1).alias("r10"), F.ln(ratio(F.col("p"), F.lag("p", 1).over(w))).alias("lr"))
    ten, twenty = w.rowsBetween(-9, 0), w.rowsBetween(-19, 0)
    median = F.when(F.count("r10").over(ten) == 10, F.percentile("r10", 0.5).over(ten))
    scale = F.when(F.count("lr").over(twenty) == 20, F.greatest(F.stddev_samp("lr").over(twenty) * math.sqrt(10), F.lit(MINIMUM_SCALE)))
    return own_rows(b.withColumn("median_10", median).withColumn("scale", scale)).select("ticker", "Date", "median_10", "scale")
