"""Operators that once shuffled or sorted more than their results need, against plain versions."""

import datetime as dt

import pytest

from tickerloom.operators import recommend as rc
from tickerloom.operators import text as tx
from tickerloom.plans import text_queries
from tickerloom.sources import news


def test_windows_are_not_shuffled(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    spans = [("a", 0, 40), ("b", 10, 12), ("c", 5, 90), ("d", 3, 4)]
    ledger = [(p, day(i), ["collected", "partial", "no_results"][i % 3]) for p, s, e in spans[:3] for i in range(s, e, 2)] + [("a", day(39), "collected"), ("a", day(39), "partial")]
    ranges = spark.createDataFrame([(p, day(s), day(e)) for p, s, e in spans], "provider string, start date, end date")
    known = spark.createDataFrame(ledger, "provider string, day date, status string")
    done = {(p, d) for p, d, s in ledger if s != "partial"}
    every = sorted(((p, day(i)) for p, s, e in spans for i in range(s, e) if (p, day(i)) not in done), key=lambda x: (-x[1].toordinal(), x[0]))
    for quota in (1, 7, 1000):
        got = news.pending_windows(ranges, known, quota)
        assert [(r["provider"], r["day"]) for r in got.collect()] == every[:quota]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


@pytest.mark.parametrize("spare", [0, 1, 64])
def test_draws_below_a_bound_are_all_draws(spark, spare):
    """Whatever the bound, the draws are those of a whole sort; with none to spare most draws fall short and are sorted whole."""
    rows = [("a", str(i)) for i in range(700)] + [("b", str(i)) for i in range(3)] + [(None, str(i)) for i in range(90)]
    c = spark.createDataFrame(rows, "profile string, ticker string")
    pick = lambda s: sorted((r["profile"] or "", r["draw"], r["rank"], r["ticker"]) for r in rc.random_draws(c, 5, 20, spare=s).collect())
    got = pick(spare)
    assert got == pick(10**6) and len(got) == 20 * (5 + 3 + 5)


def test_profile_reads_chunks_once(spark):
    rows = [("Document", "a", "h1"), ("Item 1", "Table of Contents", "h2"), ("Document", "a", "h1")]
    d = tx.corpus_profile(spark.createDataFrame(rows, "section string, text string, content_hash string"))
    assert d.first().asDict() == {"chunks": 3, "lead_in_chunks": 2, "cover": 0, "toc": 1, "signatures": 0, "exact_duplicates_excess": 1}
    assert "scalar-subquery" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_gates_read_stored_chunks_and_documents(spark, sf):
    """Chunks and prepared documents are made once, not for every count."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan(text_queries.chunk_gate(spark, sf))
    assert "max_by" not in plan(text_queries.manifest(spark, sf))
