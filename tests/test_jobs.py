import pytest
from pyspark.sql import functions as F

from tickerloom.plans import jobs
from tickerloom.sources import standins


def test_retrain_writes_a_package_once(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    bars = standins.bars(spark, sf).filter(F.col("ticker").isin("B01", "B02", "B03", "SPY", "^VIX"))
    u = standins.universe(spark, sf)
    path = str(tmp_path / "run")
    args = dict(as_of="2001-06-29", tuning="1999-07-01", calibration="1999-10-01", evaluation="2000-01-01", model="median", start_date="1996-01-01")
    m = jobs.retrain(spark, bars, u, path, **args)
    snap = jobs.read_feature_snapshot(spark, f"{path}/features", m)
    assert snap.count() == 3
    rows = spark.read.csv(f"{path}/forecasts", header=True).collect()
    assert {r["ticker"] for r in rows} == {"B01", "B02", "B03"} and all(r["stale"] in ("true", "false") for r in rows)
    with pytest.raises(ValueError):
        jobs.result_package(spark, path, None, None, "2001-06-29", {})
    with pytest.raises(ValueError):
        jobs.read_feature_snapshot(spark, f"{path}/features", {**m, "features_sha256": "0"})
