"""A spread of registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

NAMES = [
    "feature_exponential_macd", "macro_context_by_session", "asof_join_keyed", "rule_stances", "hybrid_signal", "fundamentals_signals",
    "documents_prepared", "document_chunks", "news_signals", "vector_search", "keyword_search", "discovery_with_diversification",
    "macro_import_violations", "explanation_claims", "explanation_faithfulness_judged", "faithfulness_summary", "filing_document_rows", "jsonl_projection", "completed_sessions",
    "upsert_rows", "filings_selected", "stream_trailing_sentiment", "label_10_sessions", "price_percentile_rank",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, cur.fetchall())


def test_every_query_is_unique_and_every_oracle_belongs_to_one():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
