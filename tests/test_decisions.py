import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import forecast as fc
from tickerloom.operators import fundamentals as fu
from tickerloom.operators import recommend as rc
from tickerloom.operators import rules
from tickerloom.operators.features import MODEL_INPUTS

LIMITS = {"very conservative": 0.15, "conservative": 0.20, "moderate": 0.35, "growth": 0.45, "aggressive": 0.55}


def expected_stance(fr, vol, sent, width, profile, lower, weight):
    limit = LIMITS.get(profile.strip().lower().replace("_", " "), 0.35)
    if fr < 0 or vol > limit or (sent is not None and sent <= -0.15):
        return "CAUTION"
    calm = width is not None and width <= 6 and not (lower is not None and lower < 0) and not (weight is not None and weight > 0.3)
    return "EXPLORE" if fr >= 2 and sent is not None and sent >= 0.15 and calm else "MONITOR"


def test_rule_grid(spark):
    grid = list(
        itertools.product(
            (-0.1, 0.0, 1.9, 2.0, 5.0), (0.1, 0.15, 0.2, 0.35, 0.36, 0.6), (None, -0.5, -0.15, 0.0, 0.15, 0.9), (None, 1.0, 6.0, 6.1),
            ("very_conservative", "Moderate", "aggressive", "odd"), (None, -1.0, 0.5), (None, 0.3, 0.31),
        )
    )
    df = spark.createDataFrame(grid, "fr double, vol double, s double, w double, p string, lo double, sw double")
    d = df.select("*", rules.base_stance(*[F.col(c) for c in ("fr", "vol", "s", "w", "p", "lo", "sw")]).alias("d"))
    wrong = 0
    for r in d.select("fr", "vol", "s", "w", "p", "lo", "sw", "d.stance", F.size("d.trace").alias("n")).toLocalIterator():
        wrong += r["stance"] != expected_stance(*r[:7]) or r["n"] == 0
    assert wrong == 0 and len(grid) == 25920


def test_half_even_formats(spark):
    r = spark.range(1).select(rules.plus(F.lit(0.25), 1), rules.plus(F.lit(-2.5), 0), rules.plain(F.lit(0.125), 2)).first()
    assert tuple(r) == ("+0.2", "-2", "0.12")


def test_fundamentals_expected_values(spark):
    def annual(c, v, y, filed=None):
        return ("AAA", c, float(v), dt.date(y, 1, 1), dt.date(y, 12, 31), filed or dt.date(y + 1, 2, 1))

    def instant(c, v):
        return ("AAA", c, float(v), None, dt.date(2024, 12, 31), dt.date(2025, 2, 1))

    rows = [
        annual("Revenues", 100, 2023), annual("Revenues", 120, 2024), annual("Revenues", 999, 2024, dt.date(2025, 9, 1)),
        annual("OperatingIncomeLoss", 30, 2024), annual("NetCashProvidedByUsedInOperatingActivities", 36, 2024),
        annual("PaymentsToAcquireProductiveAssets", 6, 2024), instant("AssetsCurrent", 200), instant("LiabilitiesCurrent", 100),
        instant("StockholdersEquity", 100), instant("LongTermDebtNoncurrent", 15), instant("LongTermDebtCurrent", 5),
    ]
    f = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ticker string, concept string, val double, start date, end date, filed date, ingest_seq int")
    t = spark.createDataFrame([("aaa",), ("ZZZ",)], "ticker string")
    got = {r["ticker"]: r["fundamentals"] for r in fu.fundamentals_signals(f, t, "2025-06-30").collect()}
    s = got["aaa"]
    assert {m["name"]: m["value"] for m in s["metrics"]} == {
        "revenue_growth": 0.2, "operating_margin": 0.25, "free_cash_flow_margin": 0.25, "current_ratio": 2.0, "debt_to_equity": 0.2,
    }
    assert s["rating"] == "strong" and s["score"] == 1.0 and s["age_days"] == 149 and got["ZZZ"] is None
    stale = fu.fundamentals_signals(f, t, "2027-06-30").filter("ticker = 'aaa'").first()["fundamentals"]
    assert stale is None


def label_rows(seed):
    """Assets with few and many labels, light and heavy numbers, copies, none of either."""
    rng = np.random.default_rng(seed)
    rows = [(f"T{i:02d}", [f"s{i % 4}", f"t{i % 3}"], [float(x) for x in rng.random(4)]) for i in range(20)]
    rows += [(f"U{i:02d}", sorted({f"s{int(k)}" for k in rng.integers(0, 12, int(rng.integers(0, 7)))}), [float(x) for x in rng.random(4) * rng.choice([0, 0.2, 1], 4)]) for i in range(40)]
    return [*rows, ("V0", ["s1"], [1.0] * 4), ("V1", ["z"], [1.0] * 4), ("V2", [], [0.0] * 4), ("V3", ["z"], [0.0] * 4)]


@pytest.mark.parametrize("floor", [0.3, 0.5, 0.8, 0.95])
def test_neighbours_equal_all_pairs(spark, floor):
    rows = label_rows(int(floor * 100))
    a = spark.createDataFrame(rows, "ticker string, labels array<string>, numbers array<double>")
    a = a.withColumn("norm", F.sqrt(F.size("labels") + F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x * x)))
    got = [(r["followed"], r["ticker"]) for r in rc.neighbours(a, a.select("ticker").filter("ticker <> 'T03'"), floor).collect()]
    want = set()
    for x, y in itertools.product(rows, rows):
        dot = len(set(x[1]) & set(y[1])) + np.dot(x[2], y[2])
        lengths = np.sqrt(len(x[1]) + np.dot(x[2], x[2])) * np.sqrt(len(y[1]) + np.dot(y[2], y[2]))
        if x[0] != "T03" and lengths and dot / lengths >= floor:
            want.add((x[0], y[0]))
    assert len(got) == len(set(got)) and set(got) == want


def test_neighbour_prefixes_leave_common_labels_out(spark):
    rows = [(f"T{i}", ["type:stock", f"theme:{i % 50}", f"theme:{(i + 1) % 50}"], [0.1] * 4) for i in range(200)]
    a = spark.createDataFrame(rows, "ticker string, labels array<string>, numbers array<double>")
    a = a.withColumn("norm", F.sqrt(F.size("labels") + F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x * x)))
    assert rc.with_prefix(a, 0.8).filter(F.array_contains("prefix", "type:stock")).count() == 0


def shop(spark):
    """Assets with many ties and few, some without volatility, and investors with and without follows."""
    from tickerloom.domain import INTERESTS, RISK_TIERS

    rng = np.random.default_rng(8)
    sectors = sorted({x for i in INTERESTS for x in i[2]})
    themes = sorted({x for i in INTERESTS for x in i[3]})
    pick = lambda values, n=1: [values[int(k)] for k in rng.integers(0, len(values), n)]
    assets = []
    for i in range(90):
        risk = tuple(None if rng.random() < 0.1 else float(np.round(rng.random(), 1 if i % 2 else 3)) for _ in range(4))
        assets.append((f"A{i:02d}", f"Asset {i}", pick(["stock", "etf"])[0], pick([None, "growth", "index fund"])[0], pick(sectors[:4] if i % 2 else sectors)[0], pick(themes, i % 3), risk))
    kinds = "ticker string, name string, asset_type string, category string, sector string, themes array<string>, risk struct<volatility_1y double, beta double, max_drawdown_1y double, dividend_yield double>"
    names = [i[0] for i in INTERESTS]
    people = []
    for i in range(40):
        follows = [] if i % 3 == 0 else [f"A{int(k):02d}" for k in rng.integers(0, 95, 1 + i % 3)]
        people.append((i, pick(RISK_TIERS)[0], sorted(set(pick(names, i % 4))), pick(["stock", "etf", "both"])[0], follows))
    return spark.createDataFrame(assets, kinds), spark.createDataFrame(people, "investor_id int, risk_level string, interests array<string>, asset_types string, followed_tickers array<string>")


def test_recommendations_follow_k_not_the_catalogue(spark):
    """Heads of one row, widened until the bound falls below the k-th score, give what whole lists give."""
    assets, people = shop(spark)
    rows = lambda **more: sorted(map(str, rc.recommend(people, assets, 4, **more).collect()))
    whole = rows(head=1000)
    assert rows(head=1) == whole and rows(head=6) == whole and len(whole) > 100


def model_frame(spark, n=400, tickers=("A", "B")):
    rng = np.random.default_rng(0)
    rows = []
    for t in tickers:
        x = rng.normal(size=(n, len(MODEL_INPUTS)))
        y = x[:, 0] * 0.02 + rng.normal(size=n) * 0.01
        for i in range(n):
            d = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            vals = [float(v) for v in x[i]]
            vals[5] = abs(vals[5]) * 0.1
            rows.append((d, t, *vals, float(y[i]), d + dt.timedelta(days=10)))
    names = ["Date", "ticker", *MODEL_INPUTS, "target_return_10d", "label_end_date"]
    types = ["date", "string", *["double"] * len(MODEL_INPUTS), "double", "date"]
    return spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, types)))


def test_ridge_equals_the_closed_form(spark):
    frame = model_frame(spark)
    p = fc.fit_preprocess(frame)
    c = fc.ridge(frame, p, 100.0)
    x = frame.select(*MODEL_INPUTS).toPandas().to_numpy()
    y = frame.select("target_return_10d").toPandas().to_numpy()[:, 0]
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 100 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    np.testing.assert_allclose(c.params["coefficients"], beta, atol=1e-10)
    assert abs(c.params["intercept"] - y.mean()) < 1e-12


def test_training_selects_calibrates_and_refuses_overlap(spark):
    frame = model_frame(spark)
    m = fc.train_model(frame, "2020-07-01", "2020-09-15", "2020-12-01", model="auto", min_training_rows=100, grid=[(1, 0.1, 2)], refit=True)
    assert m.metadata["selected_model"].startswith("Ridge")
    assert len(m.metadata["selection"]) == 5
    out = m.predict(m.servable(frame)).select("Date", "lower_return", "upper_return", "prediction").toPandas()
    assert out["Date"].min() == dt.date(2020, 12, 1) and (out["lower_return"] < out["upper_return"]).all()
    with pytest.raises(ValueError, match="calibration window"):
        m.predict(frame)
    e = fc.evaluate(m.predict(m.servable(frame)), 0.0, 0.0, True).first()
    assert e["MAE_pp"] < e["mean_baseline_MAE_pp"]
    parts = fc.purged_partitions(frame, "2020-07-01", "2020-09-15", "2020-12-01")
    late = parts.filter("part = 'training'").agg(F.max("label_end_date")).first()[0]
    assert late < dt.date(2020, 7, 1)


def test_research_families_fit(spark):
    frame = model_frame(spark, n=300)
    p = fc.fit_preprocess(frame)
    a, b = fc.elastic_net(frame, p), fc.forest(frame, p, trees=3, depth=2)
    for c in (a, b, fc.pca_ridge(frame, p, 5), fc.blend(a, b)):
        mae, rmse = fc.candidate_scores(c, frame)
        assert 0 < mae <= rmse


def test_block_bootstrap_of_a_constant_gain(spark):
    rows = [(dt.date(2020, 11, 20) + dt.timedelta(days=i), 2.0, 2) for i in range(60)]
    daily = spark.createDataFrame(rows, "Date date, s double, c bigint")
    got = fc.block_bootstrap(daily, repeats=50).collect()
    assert sorted(r["block_sessions"] for r in got) == [10, 20, 40]
    assert all(abs(r["lower_95_pp"] - 1) < 1e-12 and abs(r["upper_95_pp"] - 1) < 1e-12 and r["samples"] == 50 for r in got)


def test_random_draws_are_seeded_and_complete(spark):
    c = spark.createDataFrame([("p", f"t{i}") for i in range(12)], "profile string, ticker string")
    a = rc.random_draws(c, 5, draws=20)
    assert a.count() == 100 and a.groupBy("draw").agg(F.count_distinct("ticker").alias("n")).filter("n <> 5").isEmpty()
    assert a.exceptAll(rc.random_draws(c, 5, draws=20)).isEmpty()


def test_assets_without_volatility_stay_in_recommendations_and_boards(spark, sf):
    """Most histories of the smallest tables are shorter than a year."""
    from tickerloom.plans import catalog

    catalog.load_all()
    from tickerloom.plans import investor_queries as iq

    cat = iq.catalogue(spark, sf)
    short = {r.ticker for r in cat.filter("risk.volatility_1y IS NULL").collect()}
    eligible = iq.all_assets(spark, sf).filter("recommendation_eligible")
    assert short and {r.ticker for r in cat.collect()} == {r.ticker for r in eligible.collect()}
    rec = iq.recommendations(spark, sf).collect()
    assert all(("Not enough price history yet" in r.reasons) == (r.ticker in short) for r in rec) and any(r.ticker in short for r in rec)
    assert sum(r.unknown for r in iq.risk_check(spark, sf).collect()) > 0
    assert iq.graded_catalogue(spark, sf).count() == cat.count() - len(short)


def test_boosted_forecast_tries_every_grid_point(spark, monkeypatch):
    from tickerloom.plans import catalog

    catalog.load_all()
    from tickerloom.plans import forecast_queries as fq

    class Seen(Exception):
        pass

    def trained(*args, **kwargs):
        raise Seen(kwargs["model"], list(kwargs["grid"]))

    monkeypatch.setattr(fq, "cut_lineage", lambda d: d)
    monkeypatch.setattr(fq, "input_frame", lambda *a: None)
    monkeypatch.setattr(fq.fc, "train_model", trained)
    with pytest.raises(Seen) as seen:
        fq.boosted_forecast(spark, None)
    points = list(itertools.product([(1, 0.03), (2, 0.03), (3, 0.03), (2, 0.1)], [10, 50, 150]))
    assert seen.value.args == ("boosted", [(d, s, n) for (d, s), n in points])


def test_walk_forward_equals_each_fold_alone(spark):
    """Ridge, mean and median of all folds from grouped aggregates against numpy, fold by fold."""
    from tickerloom.operators import walkforward as wf
    from tickerloom.operators.forecast import TARGET

    frame = model_frame(spark, n=1700, tickers=("A", "B")).unionByName(model_frame(spark, n=100, tickers=("C",)))
    frame = frame.withColumn("rsi_14", F.when(F.dayofmonth("Date") % 5 > 0, F.col("rsi_14")))
    got = {(r["fold"], r["model"]): r for r in wf.walk_forward(frame, [2022, 2023]).collect()}
    assert set(got) == set(itertools.product([2022, 2023], ["mean", "median", "ridge"]))
    table = frame.toPandas()
    table = table[table.ticker != "C"]
    d, end, y = (table[c].to_numpy().astype("datetime64[D]") if c != TARGET else table[c].to_numpy() for c in ("Date", "label_end_date", TARGET))
    x0 = table[MODEL_INPUTS].to_numpy(float)
    for year in (2022, 2023):
        t, c, e, n = (np.datetime64(v) for v in (f"{year - 1}-07-01", f"{year - 1}-10-01", f"{year}-01-01", f"{year + 1}-01-01"))
        train, fit, inner = (d < t) & (end < t), (d < c) & (end < c), (d >= t) & (d < c) & (end < c)
        cal, ev = (d >= c) & (d < e) & (end < e), (d >= e) & (d < n) & (end < n)

        def solved(rows, alpha):
            x = np.where(np.isnan(x0), np.nanmedian(x0[rows], axis=0), x0)
            z = (x - x[rows].mean(0)) / x[rows].std(0)
            w = np.linalg.solve(z[rows].T @ z[rows] + alpha * np.eye(z.shape[1]), z[rows].T @ (y[rows] - y[rows].mean()))
            return z @ w + y[rows].mean()

        alpha = min((100.0, 1000.0), key=lambda a: np.abs(y - solved(train, a))[inner].mean())
        scale = np.maximum(table["rolling_volatility_20"].to_numpy() * np.sqrt(10 / 252), 0.005)
        for name, p in (("ridge", solved(fit, alpha)), ("mean", np.full(len(y), y[fit].mean())), ("median", np.full(len(y), np.median(y[fit])))):
            scores = np.sort((np.abs(y - p) / scale)[cal])
            half = scores[int(np.ceil((cal.sum() + 1) * 0.9)) - 1] * scale
            r = got[year, name]
            assert r["rows"] == ev.sum()
            assert np.isclose(r["MAE_pp"], np.abs(y - p)[ev].mean() * 100) and np.isclose(r["mean_interval_width_pp"], 2 * half[ev].mean() * 100)
            assert np.isclose(r["interval_coverage"], (np.abs(y - p) <= half)[ev].mean())


def test_walk_forward_with_trees(spark):
    from tickerloom.operators import walkforward as wf

    rows = wf.walk_forward(model_frame(spark, n=1300), [2022], ("median", "boosted"), grid=[(1, 0.5, 1), (2, 0.5, 3)]).collect()
    mae = {r["model"]: r["MAE_pp"] for r in rows}
    assert mae["boosted"] < mae["median"]


def test_faithfulness_keeps_answers_without_claims_and_orders_unsupported_ones(spark):
    from tickerloom.operators import evalmetrics as em

    schema = "answer_id string, claims array<string>, passages array<string>"
    answers = spark.createDataFrame([("a", ["z is  new here", "b is said", "a is not said"], ["z is new here", "b is said"]), ("b", [], ["x"]), ("c", ["lone claim stands"], None), ("d", None, ["x"])], schema)
    judged = spark.createDataFrame([("a", "a is not said", 0.2), ("c", "lone claim stands", 0.5)], "answer_id string, claim string, entailment double")
    got = {r.answer_id: (r.claims, r.faithfulness, r.unsupported) for r in em.faithfulness(answers, judged).collect()}
    assert got == {"a": (3, pytest.approx(2 / 3), ["a is not said"]), "b": (0, None, []), "c": (1, 1.0, []), "d": (0, None, [])}
    total = em.faithfulness_summary(em.faithfulness(answers)).first()
    assert (total.explanations, total.claims, total.fully_faithful_share) == (4, 4, 0.0)


def test_hybrid_signal_writes_out_one_decision(spark):
    """News adds caution only, and only the decision that stands is formatted, not both."""
    news = "named_struct('score', {s}, 'relevance', 0.5D, 'recency_hours', 1D, 'source', 'marketaux', 'article_count', 3, 'relevant', true)"
    none = "CAST(NULL AS struct<score:double,rating:string,metrics:array<struct<name:string,value:double,assessment:string>>,metric_count:int,period_end:string,filed:string,age_days:int,source:string>)"
    base = "SELECT 3D AS forecast_return, 0.1D AS volatility, 2D AS interval_width, 'moderate' AS risk_profile, 1D AS lower_bound, 0.1D AS sector_weight"
    df = spark.sql(f"SELECT *, {none} AS fundamentals FROM ({base}) CROSS JOIN (VALUES ('low', -0.5D), ('high', 0.5D)) v(k, s)").withColumn("news", F.expr(news.format(s="s"))).localCheckpoint()
    out = rules.hybrid_signal(df)
    got = {r["k"]: r["signal"] for r in out.collect()}
    assert [(got[k]["baseline_stance"], got[k]["news_aware_stance"], got[k]["provisional"]) for k in ("low", "high")] == [("MONITOR", "CAUTION", True), ("MONITOR", "MONITOR", False)]
    assert "BEARISH_SENTIMENT" in got["low"]["reason_codes"] and "SENTIMENT_MISSING" in got["high"]["reason_codes"]

    operands = [F.col(n) for n in ("forecast_return", "volatility", "news.score", "interval_width", "risk_profile", "lower_bound", "sector_weight")]
    formats = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("format_number")
    once = formats(df.select(rules.base_stance(*operands).alias("d")))
    assert once < formats(out) <= once + 4, (once, formats(out))
