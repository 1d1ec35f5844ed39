"""Data-quality predicates and audit gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.domain import BENCHMARK, HORIZON, MACRO_LAG_DAYS
from tickerloom.functions.columns import is_close, ratio
from tickerloom.operators.blocks import lead_lag, session_numbers

PRICE = "Adj Close"
OHLC = ["Open", "High", "Low", "Close"]


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def validate_unique(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{source} has duplicate {keys} rows")
    return df


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(c(column)).cast("string").alias("first"), F.max(c(column)).cast("string").alias("last"))


def frame_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, excess copies of keys, null and infinite cells; one pass plus one key count."""
    numeric = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    nulls = sum((F.count_if(c(n).isNull()) for n in df.columns), F.lit(0))
    infinite = sum((F.count_if(F.abs(c(n)) == float("inf")) for n in numeric), F.lit(0))
    totals = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("null_cells"), infinite.alias("infinite_cells"))
    excess = duplicate_keys(df, keys).select(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).scalar()
    return totals.withColumn("duplicate_keys", excess)


def feature_audit(df: DataFrame, allowlist: list[str]) -> DataFrame:
    """Per column: missing and non-finite counts, from a single aggregate over the table."""
    absent = sorted(set(allowlist) - set(df.columns))
    if absent:
        raise ValueError(f"Missing candidate feature columns: {absent}")

    def bad(name: str) -> Column:
        v = c(name)
        return F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.count_if(c(n).isNull()).alias("missing"), bad(n).alias("nonfinite")).alias(n) for n in allowlist],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), c(n).alias("s")) for n in allowlist])
    return stats.select("rows", F.explode(pairs).alias("p")).select("p.column", "rows", "p.s.missing", "p.s.nonfinite")


def compare(df: DataFrame, actual: str, expected: str, tolerance: float = 1e-10, by: list[str] | None = None) -> DataFrame:
    a, e = c(actual), c(expected)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~is_close(a, e, tolerance, tolerance)).alias("mismatches"),
        F.max(F.abs(a - e)).alias("max_abs_error"),
    )


def compare_columns(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], tolerance=1e-10) -> DataFrame:
    """(field, rows, mismatches) for several columns in one join and one aggregate."""
    e = expected.select(*[c(k) for k in keys], *[c(n).alias(f"{n}__e") for n in columns])
    j = actual.select(*[c(k) for k in keys], *[c(n) for n in columns]).join(e, keys)
    stats = j.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~is_close(c(n), c(f"{n}__e"), tolerance, tolerance)).alias(n) for n in columns],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c(n).alias("mismatches")) for n in columns])
    return stats.select("rows", F.explode(pairs).alias("p")).select("p.field", "rows", "p.mismatches")


def ohlc_plausibility(bars: DataFrame) -> DataFrame:
    slack = F.lit(1e-8)
    bad_range = (c("High") + slack < F.greatest("Open", "Close", "Low")) | (
        c("Low") - slack > F.least("Open", "Close", "High")
    )
    positive = F.least(*OHLC, c(PRICE)) <= 0
    return bars.groupBy("ticker").agg(
        F.count_if(positive).alias("nonpositive"),
        F.count_if(bad_range).alias("invalid_range"),
        F.count_if(c("Volume") < 0).alias("negative_volume"),
        F.count_if(c("Volume") == 0).alias("zero_volume"),
        F.count_if(F.dayofweek("Date").isin(1, 7)).alias("weekend_rows"),
    )


def raw_price_violations(bars: DataFrame) -> DataFrame:
    """(ticker, Date, kind) of every broken price rule."""
    values = [*OHLC, PRICE]

    def bad_number(name: str) -> Column:
        v = c(name)
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    not_finite = bad_number("Volume")
    for n in values:
        not_finite = not_finite | bad_number(n)
    kinds = F.array_compact(
        F.array(
            F.when(not_finite, "not_finite"),
            F.when(F.least(*[c(n) for n in values]) <= 0, "not_positive"),
            F.when(c("Low") > F.least("Open", "Close"), "low_above_body"),
            F.when(c("High") < F.greatest("Open", "Close"), "high_below_body"),
            F.when(c("Volume") < 0, "negative_volume"),
        )
    )
    return bars.select("ticker", "Date", F.explode(kinds).alias("kind"))


def benchmark_sessions(bars: DataFrame) -> DataFrame:
    """(Date, no): the benchmark's sessions in order."""
    own = bars.filter(c("ticker") == BENCHMARK).select("ticker", "Date")
    return session_numbers(own, "ticker", "Date", "no").select("Date", "no")


def session_coverage(bars: DataFrame) -> DataFrame:
    """Sessions missing from and extra to the benchmark calendar inside each ticker's own life.

    Calendar positions replace a range join: between positions a and b lie b-a+1 sessions.
    """
    days = benchmark_sessions(bars)
    life = (
        bars.select("ticker", "Date")
        .join(days, "Date", "left")
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("Date").alias("first_date"),
            F.max("Date").alias("last_date"),
            F.count("no").alias("_on"),
            F.count_if(F.col("no").isNull()).alias("extra_sessions"),
        )
    )
    # position of any calendar day: its newest session at or before it
    following = days.select(F.date_sub("Date", 1).alias("until"), (F.col("no") - 1).alias("no"))
    horizon = bars.agg(F.max("Date")).scalar()
    spans = days.join(following, "no", "left").withColumn("until", F.coalesce("until", F.greatest("Date", horizon)))
    positions = spans.select(F.explode(F.sequence("Date", "until")).alias("day"), "no", F.col("Date").alias("session"))
    first = positions.select(
        F.col("day").alias("first_date"), F.when(F.col("day") == F.col("session"), F.col("no")).otherwise(F.col("no") + 1).alias("_a")
    )
    last = positions.select(F.col("day").alias("last_date"), F.col("no").alias("_b"))
    j = life.join(first, "first_date", "left").join(last, "last_date", "left")
    between = F.coalesce(F.col("_b"), F.lit(-1)) - F.coalesce(F.col("_a"), F.lit(0)) + 1
    return j.select(
        "ticker", "rows", "first_date", "last_date", (between - F.col("_on")).alias("missing_sessions"), "extra_sessions"
    )


def missing_sessions(bars: DataFrame) -> DataFrame:
    """The (ticker, Date) pairs a ticker lacks inside its own life."""
    days = benchmark_sessions(bars)
    have = bars.select("ticker", "Date").join(days, "Date")
    life = have.groupBy("ticker").agg(F.min("no").alias("a"), F.max("no").alias("b"))
    wanted = life.select("ticker", F.explode(F.sequence("a", "b")).alias("no"))
    return wanted.join(have.select("ticker", "no"), ["ticker", "no"], "left_anti").join(days, "no").select("ticker", "Date")


def corporate_actions(bars: DataFrame) -> DataFrame:
    r = lead_lag(
        bars.select("ticker", "Date", PRICE, "Dividends", "Stock Splits"),
        "ticker",
        "Date",
        1,
        0,
        ret=lambda w: ratio(c(PRICE), F.lag(PRICE).over(w)) - 1,
    )
    on_split = c("Stock Splits") != 0
    return r.groupBy("ticker").agg(
        F.count_if(on_split).alias("split_rows"),
        F.count_if(c("Dividends") != 0).alias("dividend_rows"),
        F.max(F.when(on_split, F.abs("ret"))).alias("split_day_max_abs_return"),
        F.count_if(F.abs("ret") > 0.5).alias("returns_over_half"),
    )


def label_audit(labelled: DataFrame, last_day: Column) -> DataFrame:
    """Needs target_return_10d, is_training_row and label_end_date per row."""
    has = F.col("target_return_10d").isNotNull()
    return labelled.groupBy("ticker").agg(
        F.count_if(has).alias("labeled"),
        F.count_if(~has).alias("unlabeled"),
        F.count_if(F.col("is_training_row") != has).alias("flag_mismatches"),
        F.count_if(has & (F.col("label_end_date") > last_day)).alias("immature_labels"),
        F.max(F.when(has, F.col("Date"))).cast("string").alias("last_labeled_origin"),
    )


def target_check(features: DataFrame, bars: DataFrame) -> DataFrame:
    """One row: label agreement with an independent forward return."""
    expected = lead_lag(
        bars.select("ticker", "Date", PRICE), "ticker", "Date", 0, HORIZON, expected=lambda w: F.lead(PRICE, HORIZON).over(w)
    ).select("ticker", "Date", (ratio(c("expected"), c(PRICE)) - 1).alias("expected"))
    j = features.select("ticker", "Date", "target_return_10d", "is_training_row").join(expected, ["ticker", "Date"])
    t, e = c("target_return_10d"), c("expected")
    return j.agg(
        F.count(F.lit(1)).alias("checked_rows"),
        F.count_if(e.isNotNull()).alias("labeled_rows"),
        F.count_if(e.isNull()).alias("unlabeled_rows"),
        F.count_if(~is_close(t, e, 1e-12, 1e-12)).alias("mismatches"),
        F.count_if(c("is_training_row") != e.isNotNull()).alias("flag_mismatches"),
        F.max(F.abs(t - e)).alias("max_abs_error"),
    )


def macro_provenance(macro: DataFrame) -> DataFrame:
    """Availability lags per series and whether they fit the manual-import pattern."""
    lag = F.datediff("available_date", "observation_date")
    per = macro.groupBy("series_id").agg(
        F.sort_array(F.collect_set(lag)).alias("lags"), F.count("realtime_end").alias("realtime_end_non_null")
    )
    want = F.element_at(F.create_map(*[F.lit(x) for kv in MACRO_LAG_DAYS.items() for x in kv]), F.col("series_id"))
    return per.select(
        "series_id",
        F.array_join(F.transform("lags", lambda v: v.cast("string")), ",").alias("lag_days"),
        "realtime_end_non_null",
        ((F.size("lags") == 1) & (F.col("lags")[0] == want) & (F.col("realtime_end_non_null") == 0)).alias("manual_pattern"),
    )


def rows_preserved(before: DataFrame, after: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row: keys lost, keys added, changed values of ``column``."""
    b = before.select(*keys, c(column).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, c(column).alias("_a"), F.lit(True).alias("_in_a"))
    j = b.join(a, keys, "outer")
    both = F.col("_in_a") & F.col("_in_b")
    return j.agg(
        F.count_if(F.col("_in_a").isNull()).alias("lost"),
        F.count_if(F.col("_in_b").isNull()).alias("added"),
        F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
    )


def purge_counts(rows: DataFrame, folds: list[tuple[str, str]]) -> DataFrame:
    """Naive and purged train/evaluation rows per (start, end) fold, in one pass.

    ``folds`` is a short fixed list; each row is read once and counted into every fold.
    """
    has = F.col("target_return_10d").isNotNull()
    aggs = []
    for start, end in folds:
        s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
        train = has & (F.col("Date") < s)
        mature = train & (F.col("label_end_date") < s)
        ev = has & F.col("Date").between(s, e)
        ev_mature = ev & (F.col("label_end_date") <= e)
        aggs.append(
            F.struct(
                F.lit(start).alias("evaluation_start"),
                F.lit(end).alias("evaluation_end"),
                F.count_if(train).alias("naive_train"),
                F.count_if(mature).alias("mature_train"),
                (F.count_if(train) - F.count_if(mature)).alias("purged_train"),
                F.count_if(ev).alias("naive_evaluation"),
                F.count_if(ev_mature).alias("evaluation"),
            )
        )
    return rows.agg(F.array(*aggs).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def stride_sample(df: DataFrame, key: str, order: str, stride: int, period: Column | None = None) -> DataFrame:
    """Every n-th row of each key's order."""
    numbered = session_numbers(df, key, order, "_no", period)
    return numbered.filter(F.col("_no") % stride == 0).drop("_no")


def hash_sample(df: DataFrame, identity: str, size: int, seed: int = 17) -> DataFrame:
    """Seeded sample: the rows with the smallest hashes."""
    return df.orderBy(F.xxhash64(F.col(identity), F.lit(seed)), identity).limit(size)


def problem_report(problems: DataFrame, examples: int = 5) -> DataFrame:
    """Counts per kind and the first ids, without collecting a whole kind in one place."""
    w = Window.partitionBy("kind").orderBy("id")
    counts = problems.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    first = (
        problems.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= examples)
        .groupBy("kind")
        .agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    )
    return counts.join(first, "kind")
