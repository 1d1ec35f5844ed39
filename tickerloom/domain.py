"""Fixed values and schemas of the market-research domain."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------
BENCHMARK = "SPY"
VOLATILITY_INDEX = "^VIX"
HORIZON = 10
SESSIONS_PER_YEAR = 252
MODEL_START_DATE = "2021-09-01"

PROFILE_WINDOW = 252
PROFILE_MIN_HISTORY = 60

# days between the observation of a macro value and its availability
MACRO_LAG_DAYS = {"DFF": 1, "CPIAUCSL": 50, "DGS10": 1, "VIXCLS": 0}
MACRO_FEATURES = {
    "DFF": "federal_funds_rate",
    "DGS10": "treasury_yield_10y",
    "VIXCLS": "fred_vix",
    "CPIAUCSL": "inflation_cpi_yoy",
}

RISK_TIERS = ["very_conservative", "conservative", "moderate", "growth", "aggressive"]
RISK_LABELS = {
    "very_conservative": "Very Conservative",
    "conservative": "Conservative",
    "moderate": "Moderate",
    "growth": "Growth",
    "aggressive": "Aggressive",
}
VOLATILITY_LIMITS = {
    "very conservative": 0.15,
    "conservative": 0.20,
    "moderate": 0.35,
    "growth": 0.45,
    "aggressive": 0.55,
}
DEFAULT_PROFILE = "moderate"

# key, label, sectors, themes
INTERESTS = [
    ("technology", "Technology", ["Information Technology"], []),
    ("healthcare", "Healthcare", ["Health Care"], []),
    ("financials", "Financials", ["Financials"], []),
    ("energy", "Energy", ["Energy", "Utilities"], []),
    ("consumer", "Consumer", ["Consumer Discretionary", "Consumer Staples"], []),
    ("industrials", "Industrials", ["Industrials"], []),
    (
        "clean_energy",
        "Clean Energy",
        [],
        ["renewable_energy", "solar_energy", "energy_transition", "grid_infrastructure", "electrification", "hydrogen"],
    ),
    ("communication", "Communication", ["Communication Services"], []),
    ("materials", "Materials", ["Materials"], []),
]
ASSET_TYPE_CHOICES = ["both", "stock", "etf"]
MAX_FOLLOWED_TICKERS = 20

CHUNK_TOKENS = 220
OVERLAP_TOKENS = 32

# retrieval constants
RRF_DAMPING = 60
MIN_SIMILARITY = 0.30
SNIPPET_CHARS = 320

# --- schemas ------------------------------------------------------------------
BAR_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("Adj Close", T.DoubleType()),
        T.StructField("Volume", T.DoubleType()),
        T.StructField("Dividends", T.DoubleType()),
        T.StructField("Stock Splits", T.DoubleType()),
    ]
)
MACRO_COLUMNS = [
    "series_id",
    "series_name",
    "frequency",
    "observation_date",
    "value",
    "available_date",
    "realtime_end",
]
UNIVERSE_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("asset_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("themes", T.StringType()),
        T.StructField("recommendation_eligible", T.StringType()),
        T.StructField("forecast_eligible", T.StringType()),
        T.StructField("history_note", T.StringType()),
    ]
)
FACT_COLUMNS = ["ticker", "concept", "val", "start", "end", "filed", "form", "ingest_seq"]
