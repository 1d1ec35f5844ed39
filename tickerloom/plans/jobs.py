"""Composed jobs: read pinned inputs, retrain and package, refresh snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.domain import MODEL_START_DATE
from tickerloom.operators import features as fe
from tickerloom.operators import forecast as fc
from tickerloom.operators.quality import validate_unique
from tickerloom.operators.storage import content_identity, file_inventory, write_table
from tickerloom.session import cut_lineage
from tickerloom.sources.landing import completed_sessions

NULLABLE_PREDICTORS = ["rsi_14", "volume_change_1d"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the cluster's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_local_inputs(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Parquet inputs with a content hash per input, taken before the read and checked by ``unchanged``."""
    return {n: spark.read.parquet(p) for n, p in paths.items()}, {n: content_hash(spark, p) for n, p in paths.items()}


def content_hash(spark: SparkSession, path: str) -> str:
    """Identity of an input's files by name and content; only sums reach the driver."""
    files = file_inventory(spark, path)
    return files.agg(content_identity(F.concat_ws(":", "path", "sha256"))).first()[0]


def unchanged(spark: SparkSession, paths: dict[str, str], hashes: dict[str, str]) -> bool:
    return all(content_hash(spark, p) == hashes[n] for n, p in paths.items())


def read_feature_snapshot(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    """Latest predictor rows of a package: manifest hash, exact columns, unique tickers, finite values."""
    if content_hash(spark, path) != manifest["features_sha256"]:
        raise ValueError("Feature snapshot differs from its manifest")
    df = spark.read.parquet(path)
    if df.columns != manifest["feature_columns"]:
        raise ValueError("Feature snapshot columns differ from its manifest")
    validate_unique(df, ["ticker"], "feature snapshot")
    strict = [c for c in fe.MODEL_INPUTS if c not in NULLABLE_PREDICTORS]
    bad = F.lit(False)
    for c in strict:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if not df.filter(bad).isEmpty():
        raise ValueError("Feature snapshot holds missing or infinite predictors")
    return df


def result_package(spark: SparkSession, path: str, model: fc.ForecastModel, frame: DataFrame, as_of: str, report: dict) -> dict:
    """Write features, forecasts, report and manifest to a new folder; an existing one is refused."""
    if exists(spark, path):
        raise ValueError("The run folder exists already and is left as it is")
    newest = frame.groupBy("ticker").agg(F.max_by(F.struct(*[c for c in frame.columns if c != "ticker"]), "Date").alias("f")).select("ticker", "f.*")
    features = newest.select("ticker", "Date", *fe.MODEL_INPUTS)
    write_table(features, f"{path}/features", sort=["ticker"])
    forecasts = fc.latest_forecasts(model.predict(model.servable(newest)), F.lit(as_of).cast("date"))
    kept = forecasts.select("ticker", "Date", F.col("prediction").alias("predicted_return_10d"), "lower_return", "upper_return", "uncertainty_width_pp", "data_age_days", "stale", "status")
    write_table(kept.withColumn("model", F.lit(model.candidate.name)), f"{path}/forecasts", "csv")
    manifest = {
        "as_of": as_of,
        "selected_model": model.candidate.name,
        "feature_columns": features.columns,
        "features_sha256": content_hash(spark, f"{path}/features"),
        "parameters": model.candidate.params,
    }
    for name, body in (("report", report), ("manifest", manifest)):
        line = json.dumps(body, default=str)
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("error").text(f"{path}/{name}")
    return manifest


def retrain(
    spark: SparkSession, bars: DataFrame, universe: DataFrame, path: str, as_of: str, tuning: str, calibration: str, evaluation: str,
    model: str = "auto", start_date: str = MODEL_START_DATE, grid: list | None = None,
) -> dict:
    """Completed sessions -> features -> inputs -> trained, calibrated model -> package."""
    sessions = cut_lineage(completed_sessions(bars, "1900-01-01", as_of))
    frame = cut_lineage(fe.model_inputs(fe.feature_dataset(sessions, universe, None, start_date), sessions, as_of))
    if not fe.input_violations(fe.feature_dataset(sessions, universe, None, start_date), sessions).isEmpty():
        raise ValueError("Model inputs break their contract")
    m = fc.train_model(frame, tuning, calibration, evaluation, model=model, grid=grid)
    known = frame.filter(F.col(fc.TARGET).isNotNull())
    row = fc.evaluate(m.predict(m.servable(known)), m.metadata["training_mean"], m.metadata["training_median"], m.metadata["training_majority_up"]).first()
    report = {
        "calibration": m.calibration,
        "selection": m.metadata["selection"],
        "evaluation": row.asDict() if row else None,
        "boundaries": [tuning, calibration, evaluation],
    }
    return result_package(spark, path, m, frame, as_of, report)


def refresh_snapshots(spark: SparkSession, store: str, run: int, snapshots: DataFrame) -> DataFrame:
    """Nightly refresh: new serving rows as the delta of run number ``run``; returns the newest row of each (ticker, risk_profile)."""
    from tickerloom.streaming.increments import SNAPSHOT_KEYS, read_newest, upsert_snapshots

    upsert_snapshots(store)(snapshots, run)
    return read_newest(spark, store, SNAPSHOT_KEYS).drop("part", "batch")
