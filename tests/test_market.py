import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.functions.columns import with_ema
from tickerloom.operators import blocks
from tickerloom.operators import features as fe
from tickerloom.operators import quality as qa
from tickerloom.operators import twins
from tickerloom.operators.ranks import cumulative_counts, exact_median, order_statistic, percentile_rank
from tickerloom.sources import landing
from tickerloom.sources import macro as macro_source


def walk(spark, tickers=("AAA", "SPY"), n=310, zero_volume=270, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i in range(n):
            d = dt.date(2019, 12, 20) + dt.timedelta(days=i)
            c = float(close[i])
            rows.append((d, t, c * 0.99, c * 1.02, c * 0.98, c, c * 0.9, 0.0 if i == zero_volume else 1000.0 + i % 7, 0.0, 0.0))
    from tickerloom.domain import BAR_SCHEMA

    return spark.createDataFrame(rows, BAR_SCHEMA)


def pandas_features(g):
    g = g.sort_values("Date").reset_index(drop=True)
    a = g["Adj Close"]
    out = g[["ticker", "Date"]].copy()
    out["ema_26"] = a.ewm(span=26, adjust=False).mean()
    macd = a.ewm(span=12, adjust=False).mean() - out["ema_26"]
    out["macd_signal"] = macd.ewm(span=9, adjust=False).mean()
    out["sma_200"] = a.rolling(200).mean()
    out["rolling_volatility_20"] = a.pct_change().rolling(20).std() * np.sqrt(252)
    out["target_return_10d"] = a.shift(-10) / a - 1
    return out


@pytest.mark.parametrize("block_rows", [2000, 120])
def test_features_match_a_sequential_computation(spark, monkeypatch, block_rows):
    bars = walk(spark)
    monkeypatch.setattr(blocks.halo_blocks, "__defaults__", (0, block_rows))
    got = fe.technical_features(bars).toPandas().sort_values(["ticker", "Date"]).reset_index(drop=True)
    want = pd.concat(pandas_features(g) for _, g in bars.toPandas().groupby("ticker")).sort_values(["ticker", "Date"]).reset_index(drop=True)
    assert len(got) == len(want) == 620
    for c in want.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-10, atol=1e-12, err_msg=c)


def test_long_history_means_are_exact_across_blocks(spark):
    bars = walk(spark, tickers=("AAA",), n=4300, zero_volume=-1)
    got = fe.technical_features(bars).select("ticker", "Date", "ema_26", "macd_signal").toPandas().sort_values("Date").reset_index(drop=True)
    want = pandas_features(bars.toPandas())
    np.testing.assert_allclose(got["ema_26"], want["ema_26"], rtol=1e-12)
    np.testing.assert_allclose(got["macd_signal"], want["macd_signal"], rtol=1e-9, atol=1e-10)


def test_means_with_missing_prices(spark):
    rng = np.random.default_rng(3)
    rows = [(f"T{k}", i, None if i in gone else float(100 + rng.normal(0, 5))) for k, gone in enumerate([(0, 20), (0, 1, 2, 30, 31, 59), (), tuple(range(60))]) for i in range(60)]
    d = spark.createDataFrame(rows, "ticker string, pos long, price double")
    w = Window.partitionBy("ticker").orderBy("pos")
    got = with_ema(d, w, "pos", {"m12": ("price", 12), "m9": ("price", 9)}).toPandas().sort_values(["ticker", "pos"])
    for _, g in got.groupby("ticker"):
        for n in (12, 9):
            np.testing.assert_allclose(g[f"m{n}"].astype(float), g["price"].astype(float).ewm(span=n, adjust=False).mean(), rtol=1e-11)


def test_model_inputs_contract(spark):
    rising = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i, 0.0 if i == 270 else 10.0) for i in range(310)]
    rows = [(d, t, p, p, p, p, p, v, 0.0, 0.0) for t in ("AAA", "SPY", "^VIX") for d, p, v in rising]
    from tickerloom.domain import BAR_SCHEMA

    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    universe = spark.createDataFrame([("AAA", "stock", "c", "s", "TRUE")], "ticker string, asset_type string, category string, sector string, forecast_eligible string")
    f = fe.feature_dataset(bars, universe, None, "2019-01-01")
    x = fe.model_inputs(f, bars).toPandas().sort_values("Date").reset_index(drop=True)
    assert len(fe.MODEL_INPUTS) == 27
    assert (x["rsi_14"].dropna() == 100).all()
    assert x["volume_change_1d"].isna().sum() == 2  # first row, and the row after the zero volume
    assert x["target_return_10d"].isna().sum() == 10
    cutoff = str(x["Date"][250])
    y = fe.model_inputs(f, bars, cutoff).toPandas().sort_values("Date").reset_index(drop=True)
    assert len(y) == 251 and y["target_return_10d"].isna().sum() == 10
    assert fe.input_violations(f, bars).isEmpty()
    broken = f.withColumn("target_return_10d", F.col("target_return_10d") + 0.1)
    assert fe.input_violations(broken, bars).select("kind").distinct().first()[0] == "target_mismatch"


def test_session_coverage_counts_from_each_own_life(spark):
    days = [dt.date(2020, 1, d) for d in (2, 3, 6, 7, 8, 9)]
    rows = [("SPY", d) for d in days] + [("AAA", d) for d in (days[1], days[4], dt.date(2020, 1, 5))]
    bars = spark.createDataFrame(rows, "ticker string, Date date")
    got = {r["ticker"]: (r["missing_sessions"], r["extra_sessions"]) for r in qa.session_coverage(bars).collect()}
    assert got == {"SPY": (0, 0), "AAA": (2, 1)}
    gaps = {(r["ticker"], r["Date"]) for r in qa.missing_sessions(bars).collect()}
    assert gaps == {("AAA", days[2]), ("AAA", days[3])}


def test_ranks_against_pandas(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 40, 500)] + [7.0] * 300  # one value holds a third of all rows
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", v) for i, v in enumerate(values)], "id int, g string, v double")
    pdf = df.toPandas()
    med = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert med == pdf.groupby("g")["v"].median().to_dict()
    q = order_statistic(df.withColumn("one", F.lit(1)), ["one"], "v", lambda n: F.ceil((n + 1) * 0.9), "q").first()["q"]
    assert q == np.sort(values)[int(np.ceil(801 * 0.9)) - 1]
    ranked = percentile_rank(df, "v", "p").toPandas().sort_values("id")
    np.testing.assert_allclose(ranked["p"].to_numpy(), pdf["v"].rank(pct=True).to_numpy())
    total = cumulative_counts(df, ["g"], "v").agg(F.sum("n")).first()[0]
    assert total == 800


def test_ranks_over_several_levels(spark):
    """Two and three levels of few ranges give the positions that one sort gives."""
    from tickerloom.operators.ranks import cumulative_counts, levels_for

    rng = np.random.default_rng(7)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 1500), np.round(rng.normal(size=1500), 2), strict=True)] + [(0, 0.5)] * 300 + [(1, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    want = {}
    for g in range(3):
        own = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, v): (own.count(v), own.index(v), len(own)) for v in own}
    for ranges, levels in ((64, None), (3, 2), (4, 3)):
        got = {(r["g"], r["v"]): (r["n"], r["before"], r["total"]) for r in cumulative_counts(df, ["g"], "v", ranges, levels).collect()}
        assert got == want
    assert [levels_for(p) for p in (1, 64, 65, 4096, 100_000)] == [1, 1, 2, 2, 3]


def test_quantiles_of_ranges_are_taken_once(spark):
    """Approximate quantiles differ from run to run, so no plan may hold them for a second run."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3000).cast("double").alias("v"))
    for ranges, levels in ((64, 1), (4, 3)):
        counts = cumulative_counts(df, ["g"], "v", ranges, levels)
        assert "percentile_approx" not in counts._jdf.queryExecution().optimizedPlan().toString()
        assert counts.groupBy("g").agg(F.count_distinct("before").alias("n")).filter("n = 1000").count() == 3


def test_landing_keeps_the_last_copy_and_the_exchange_date(spark):
    raw = spark.createDataFrame(
        [("2020-01-02 00:00:00-05:00", "A", 1.0, None, 1), ("2020-01-02 00:00:00-05:00", "A", 2.0, 0.5, 2)],
        "Datetime string, ticker string, Close double, Dividends double, ingest_seq int",
    )
    row = landing.keep_last(landing.normalize_bars(raw), ["ticker", "Date"], "ingest_seq").collect()
    assert len(row) == 1 and row[0]["Close"] == 2.0 and row[0]["Date"] == dt.date(2020, 1, 2)
    assert row[0]["Stock Splits"] == 0.0
    with pytest.raises(ValueError):
        landing.require_rows(raw.filter("false"), "no sessions")


def test_macro_csv_import(spark, tmp_path):
    for s, f in macro_source.SERIES_FILES.items():
        body = "2025-09-01,324.4\n2025-10-01,.\n" if s == "CPIAUCSL" else "2025-09-01,4.1\n2025-09-02,\n"
        (tmp_path / f).write_text(f"observation_date,{s}\n{body}")
    m = macro_source.import_macro(macro_source.read_macro_csv(spark, str(tmp_path)))
    rows = {(r["series_id"], str(r["observation_date"])): (r["value"], str(r["available_date"])) for r in m.collect()}
    assert rows[("CPIAUCSL", "2025-09-01")] == (324.4, "2025-10-21")
    assert rows[("CPIAUCSL", "2025-10-01")][0] is None and len(rows) == 5
    (tmp_path / "DFF.csv").write_text("date,DFF\n")
    with pytest.raises(ValueError):
        macro_source.read_macro_csv(spark, str(tmp_path))


def test_array_folds_equal_the_windows_over_gaps_and_block_borders(spark):
    bars = walk(spark, ("AAA", "BBB"), n=120)
    gap = F.dayofmonth("Date").isin(3, 4, 17)
    bars = bars.withColumn(fe.PRICE, F.when(gap, F.lit(None)).otherwise(F.col(fe.PRICE)))
    fields = [n for n in twins.FIELDS if not n.startswith("Adj ")]
    found = qa.compare_columns(fe.technical_features(bars), twins.folded_features(bars, block_rows=50), ["ticker", "Date"], fields, 1e-9)
    assert {r.field: (r.rows, r.mismatches) for r in found.collect()} == {n: (240, 0) for n in fields}


def test_array_folds_follow_a_recursion_written_out(spark):
    bars = walk(spark, ("AAA",), n=60)
    got = twins.folded_features(bars).orderBy("Date").toPandas()
    price = bars.orderBy("Date").toPandas()[fe.PRICE]
    assert np.allclose(got["ema_12"], price.ewm(span=12, adjust=False).mean(), rtol=1e-12)
    assert np.allclose(got["macd_signal"], got["macd"].ewm(span=9, adjust=False).mean(), rtol=1e-12)
    assert np.allclose(got["sma_20"][19:], price.rolling(20).mean()[19:], rtol=1e-12) and got["sma_20"][:19].isna().all()
    assert twins.folded_features(bars.limit(0)).count() == 0


def test_a_macro_import_is_refused_with_the_broken_rows_named(spark):
    schema = "series_id string, observation_date string, value string, row_number long"
    good = spark.createDataFrame([("DFF", "2001-01-02", "1.5", 0), ("DFF", "2001-01-03", ".", 1), ("DGS10", "2001-01-02", "4", 0)], schema)
    assert macro_source.macro_violations(good, "row_number").count() == 0
    assert macro_source.import_macro_checked(good, "row_number").count() == 2
    rows = [("DFF", "2001-01-05", "1", 99_999), ("DFF", "2001-01-03", "1", 100_000), ("DFF", "soon", "1", 100_001), ("DFF", "2001-01-03", "1", 100_002), ("DFF", None, "1", 100_003)]
    bad = spark.createDataFrame(rows, schema)
    found = sorted((r.kind, str(r.observation_date)) for r in macro_source.macro_violations(bad, "row_number").collect())
    assert found == [("duplicate_date", "2001-01-03"), ("invalid_date", "None"), ("invalid_date", "soon"), ("unsorted_date", "2001-01-03")]
    with pytest.raises(ValueError, match="Macro import refused"):
        macro_source.import_macro_checked(bad, "row_number")


def test_a_range_without_sessions_is_refused(spark):
    bars = walk(spark, ("AAA",), n=5)
    assert landing.completed_sessions(bars, "2019-12-20", "2019-12-22").count() == 3
    with pytest.raises(ValueError, match="No completed sessions"):
        landing.completed_sessions(bars, "2031-01-01", "2031-02-01")
