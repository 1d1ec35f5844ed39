"""Walk-forward evaluation with folds as a column: every statistic of all folds comes from one grouped aggregation.

A fold is an evaluation year with its tuning, calibration and evaluation dates.  Rows become (fold, role) rows once;
targets' means and medians, predictor medians and moments and the ridge normal equations are aggregates by fold, scores are one
join by fold.  Only numbers per fold and predictor reach the driver.  Boosted trees, which are fitted by MLlib, take a pass a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.features import MODEL_INPUTS
from tickerloom.operators.forecast import TARGET, boosted, candidate_scores, day, evaluate, fit_preprocess, volatility_scale, with_interval
from tickerloom.operators.ranks import exact_median, order_statistic
from tickerloom.session import cut_lineage

ALPHAS = (100.0, 1000.0)
KEPT = ["fold", "role", "ticker", "Date", "label_end_date", TARGET, "rolling_volatility_20"]


def fold_rows(frame: DataFrame, years: list[int], min_rows: int = 252) -> DataFrame:
    """The labelled rows of each fold with ``fold`` and ``role``; tickers with too few training rows leave a fold.

    Roles: training, inner, calibration, evaluation, and ``fit`` for all rows known when calibration begins.  A row whose outcome
    overlaps the next part has no role in it.
    """
    d, end = F.col("Date"), F.col("label_end_date")
    folds = []
    for year in years:
        t, c, e, n = (day(x) for x in (f"{year - 1}-07-01", f"{year - 1}-10-01", f"{year}-01-01", f"{year + 1}-01-01"))
        part = (
            F.when((d < t) & (end < t), "training").when((d >= t) & (d < c) & (end < c), "inner")
            .when((d >= c) & (d < e) & (end < e), "calibration").when((d >= e) & (d < n) & (end < n), "evaluation")
        )
        folds += [F.struct(F.lit(year).alias("fold"), part.alias("role")), F.struct(F.lit(year).alias("fold"), F.when((d < c) & (end < c), "fit").alias("role"))]
    places = F.filter(F.array(*folds), lambda x: x["role"].isNotNull())
    rows = frame.filter(F.col(TARGET).isNotNull()).withColumn("_p", F.explode(places)).select("_p.fold", "_p.role", *frame.columns)
    known = rows.filter("role = 'training'").groupBy("fold", "ticker").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    return rows.join(known.select("fold", "ticker"), ["fold", "ticker"], "left_semi")


def baselines(rows: DataFrame) -> DataFrame:
    """(fold, mean, median, majority_up) of the rows known when calibration begins."""
    fit = rows.filter("role = 'fit'")
    stats = fit.groupBy("fold").agg(F.avg(TARGET).alias("mean"), (F.avg((F.col(TARGET) > 0).cast("double")) > 0.5).alias("majority_up"))
    return stats.join(exact_median(fit.select("fold", TARGET), ["fold"], TARGET), "fold")


def _stage(rows: DataFrame) -> DataFrame:
    """Adds ``stage``: the fit that a row belongs to or is scored by (training for inner rows, else fit)."""
    return rows.withColumn("stage", F.when(F.col("role").isin("training", "inner"), "training").otherwise("fit"))


def standardised(rows: DataFrame, names: list[str] = MODEL_INPUTS) -> DataFrame:
    """Rows with ``stage`` and ``z``: predictors imputed by the medians and scaled by the moments of their fold and stage."""
    staged = _stage(rows)
    own = staged.filter(F.col("role") == F.col("stage"))
    long = own.select("fold", "stage", *names).unpivot(["fold", "stage"], names, "feature", "value")
    medians = exact_median(long, ["fold", "stage", "feature"], "value").groupBy("fold", "stage")
    medians = cut_lineage(medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("_m")))
    short = medians.filter(F.size("_m") < len(names)).select("fold").first()
    if short is not None:
        raise ValueError(f"All-missing predictors in the training rows of fold {short['fold']}")
    filled = staged.join(medians, ["fold", "stage"]).withColumn("x", F.array(*[F.coalesce(F.col(n), F.col("_m")[n]) for n in names])).select(*KEPT, "stage", "x")
    at = lambda f: F.array(*[f(F.get("x", F.lit(i))) for i in range(len(names))])
    moments = filled.filter(F.col("role") == F.col("stage")).groupBy("fold", "stage").agg(at(F.avg).alias("_a"), at(F.stddev_pop).alias("_s"))
    scaled = F.transform(F.arrays_zip("x", "_a", "_s"), lambda v: (v["x"] - v["_a"]) / F.when(v["_s"] > 0, v["_s"]).otherwise(1.0))
    return filled.join(moments, ["fold", "stage"]).select(*KEPT, "stage", scaled.alias("z"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, stage, at, v): sums of the products of (1, z, y) over the rows of a task."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        z = np.array(batch.column("z").to_pylist(), float)
        x = np.column_stack((np.ones(len(z)), z, batch.column(TARGET).to_numpy(zero_copy_only=False)))
        fold, stage = np.array(batch.column("fold").to_pylist()), np.array(batch.column("stage").to_pylist())
        for key in sorted(set(zip(fold.tolist(), stage.tolist(), strict=True))):
            own = x[(fold == key[0]) & (stage == key[1])]
            total[key] = total.get(key, 0) + own.T @ own
    for (fold, stage), m in total.items():
        v = m.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([fold] * v.size, pa.int32()), pa.array([stage] * v.size), pa.array(range(v.size), pa.int32()), pa.array(v)], names=["fold", "stage", "at", "v"]
        )


def ridge_weights(z: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(fold, stage, alpha, w, b) from the normal equations of every fold, summed in one pass."""
    own = z.filter(F.col("role") == F.col("stage")).select("fold", "stage", "z", TARGET)
    cells = own.mapInArrow(_products, "fold int, stage string, at int, v double").groupBy("fold", "stage", "at").agg(F.sum("v").alias("v")).collect()
    sums: dict[tuple, dict[int, float]] = {}
    for fold, stage, at, v in cells:
        sums.setdefault((fold, stage), {})[at] = v
    out = []
    for (fold, stage), own_cells in sums.items():
        size = int(np.sqrt(len(own_cells)))
        m = np.array([own_cells[i] for i in range(size * size)]).reshape(size, size)
        n, inner, right = m[0, 0], m[1:-1, 1:-1], m[1:-1, -1]
        mean = m[0, -1] / n
        for alpha in alphas:
            w = np.linalg.solve(inner + alpha * np.eye(size - 2), right - m[1:-1, 0] * mean)
            out.append((fold, stage, alpha, [float(x) for x in w], float(mean)))
    return z.sparkSession.createDataFrame(out, "fold int, stage string, alpha double, w array<double>, b double")


def ridge_predictions(rows: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Calibration and evaluation rows of each fold with the ridge of least inner error (then the weaker penalty)."""
    z = cut_lineage(standardised(rows))
    scored = z.filter(~F.col("role").isin("training", "fit")).join(ridge_weights(z, alphas), ["fold", "stage"])
    product = F.aggregate(F.zip_with("z", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = scored.withColumn("prediction", F.col("b") + product)
    e = F.col(TARGET) - F.col("prediction")
    inner = scored.filter("role = 'inner'").groupBy("fold", "alpha").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    best = inner.groupBy("fold").agg(F.min_by("alpha", F.struct("mae", "rmse", "alpha")).alias("alpha"))
    return scored.filter("role <> 'inner'").join(best, ["fold", "alpha"], "left_semi").select(*KEPT, F.lit("ridge").alias("model"), "prediction")


def boosted_predictions(rows: DataFrame, grid: list[tuple[int, float, int]], years: list[int]) -> DataFrame:
    """The boosted trees of least inner error of each fold, refitted on its fit rows; one set of jobs a fold."""
    out = None
    for year in years:
        own = rows.filter(F.col("fold") == year)
        train, inner, fit = (own.filter(F.col("role") == n).drop("fold", "role") for n in ("training", "inner", "fit"))
        p = fit_preprocess(train)
        best = min(grid, key=lambda g: candidate_scores(boosted(train, p, *g), inner))
        chosen = boosted(fit, fit_preprocess(fit), *best)
        made = chosen.predict(own.filter(F.col("role").isin("calibration", "evaluation"))).select(*KEPT, F.lit("boosted").alias("model"), "prediction")
        out = made if out is None else out.unionByName(made)
    return out


def walk_forward(frame: DataFrame, years: list[int], models: tuple[str, ...] = ("mean", "median", "ridge"), grid: list | None = None, coverage: float = 0.9) -> DataFrame:
    """All evaluation metrics by (fold, model); intervals are calibrated on each fold's own calibration rows."""
    rows = cut_lineage(fold_rows(frame, years))
    base = cut_lineage(baselines(rows))
    held = rows.filter(F.col("role").isin("calibration", "evaluation")).select(*KEPT)
    predicted = []
    for name in models:
        if name in ("mean", "median"):
            predicted.append(held.join(base.select("fold", F.col(name).alias("prediction")), "fold").select(*KEPT, F.lit(name).alias("model"), "prediction"))
        elif name == "ridge":
            predicted.append(ridge_predictions(rows))
        elif name == "boosted":
            predicted.append(boosted_predictions(rows, grid, years))
        else:
            raise ValueError(f"Unknown model {name}")
    every = predicted[0]
    for more in predicted[1:]:
        every = every.unionByName(more)
    score = (F.abs(F.col(TARGET) - F.col("prediction")) / volatility_scale()).alias("score")
    calibration = every.filter("role = 'calibration'").select("fold", "model", score)
    quantiles = order_statistic(calibration, ["fold", "model"], "score", lambda n: F.ceil((n + 1) * F.lit(coverage)), "quantile")
    rows = with_interval(every.filter("role = 'evaluation'").join(quantiles, ["fold", "model"]), F.col("quantile")).join(base, "fold")
    return evaluate(rows, F.col("mean"), F.col("median"), F.col("majority_up"), coverage, [F.col("fold"), F.col("model")])
