"""SQL twins of the stand-in tables and shared sub-results, for the DuckDB oracle."""

from __future__ import annotations

from tickerloom.domain import RISK_TIERS
from tickerloom.sources import standins as S


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _tick(expr: str) -> str:
    return f"'B' || lpad(CAST({expr} AS VARCHAR), 2, '0')"


_NO = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER)"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(*names: str, extra: str = "") -> str:
    """WITH clause holding the named sub-results and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTES[name][0]:
            visit(n)
        order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" + extra if extra else "") + "\n"


cte(
    "brand_days",
    [],
    f"""
    SELECT {_NO} AS no, CAST(l_shipdate AS DATE) AS d,
           min(struct_pack(a := l_orderkey, b := l_linenumber, u := l_extendedprice / l_quantity)) AS f,
           max(struct_pack(a := l_orderkey, b := l_linenumber, u := l_extendedprice / l_quantity)) AS l,
           max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo, sum(l_quantity) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
cte(
    "market_days",
    ["brand_days"],
    "SELECT d, min(f) AS f, max(l) AS l, max(hi) AS hi, min(lo) AS lo, sum(v) AS v FROM brand_days GROUP BY d",
)
_PAY = "month(d) % 3 = 0 AND day(d) = 15"
cte(
    "bars",
    ["brand_days", "market_days"],
    f"""
    SELECT d, {_tick('no')} AS ticker, 100.0::DOUBLE + f.u / (4000.0::DOUBLE * (1 + no % 6)) AS o,
           100.0::DOUBLE + hi / (4000.0::DOUBLE * (1 + no % 6)) AS h, 100.0::DOUBLE + lo / (4000.0::DOUBLE * (1 + no % 6)) AS l,
           100.0::DOUBLE + l.u / (4000.0::DOUBLE * (1 + no % 6)) AS c,
           (100.0::DOUBLE + l.u / (4000.0::DOUBLE * (1 + no % 6))) * (1.0::DOUBLE - (no % 5) * 0.01::DOUBLE) AS ac, v,
           CASE WHEN {_PAY} THEN (no % 4) * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS dv,
           CASE WHEN month(d) = 7 AND day(d) = 4 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS sp
    FROM brand_days
    UNION ALL
    SELECT d, 'SPY', 100.0::DOUBLE + f.u / 8000.0::DOUBLE, 100.0::DOUBLE + hi / 8000.0::DOUBLE, 100.0::DOUBLE + lo / 8000.0::DOUBLE,
           100.0::DOUBLE + l.u / 8000.0::DOUBLE, (100.0::DOUBLE + l.u / 8000.0::DOUBLE) * 0.99::DOUBLE, v,
           CASE WHEN {_PAY} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE
    FROM market_days
    UNION ALL
    SELECT d, '^VIX', x, x, x, x, x, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
    FROM (SELECT d, 10.0::DOUBLE + (hi - lo) / 5000.0::DOUBLE AS x FROM market_days)""",
)
cte(
    "universe",
    [],
    f"""
    SELECT {_tick('no')} AS ticker, list_extract({_list(S.COMPANY_WORDS)}, no) || ' ' || list_extract({_list(S.COMPANY_SUFFIXES)}, no % 5 + 1) AS name,
           CASE WHEN no % 5 = 0 THEN 'etf' ELSE 'stock' END AS asset_type,
           upper(left(pt, 1)) || lower(substr(pt, 2)) AS category, list_extract({_list(S.SECTORS)}, no % 11 + 1) AS sector,
           CASE WHEN no % 3 = 0 THEN list_extract({_list(S.THEME_POOL)}, no % 6 + 1) || '|' || split_part(pn, ' ', 1)
                WHEN no % 3 = 1 THEN split_part(pn, ' ', 2) ELSE '' END AS themes,
           no % 7 <> 0 AS rec, no % 4 <> 0 AS fc, CASE WHEN no % 6 = 0 THEN 'short history' END AS history_note
    FROM (SELECT {_NO} AS no, min(p_type) AS pt, min(p_name) AS pn FROM part GROUP BY 1)
    UNION ALL SELECT 'SPY', 'Broad Market Fund', 'etf', 'Broad market', 'Broad Market', '', true, false, NULL
    UNION ALL SELECT '^VIX', 'Volatility Index', 'index', 'Index', 'Index', '', false, false, NULL""",
)
cte(
    "assets",
    ["universe"],
    """
    SELECT ticker, name, asset_type, category, sector, list_filter(string_split(themes, '|'), lambda x: x <> '') AS themes, rec, fc, history_note
    FROM universe WHERE asset_type <> 'index'""",
)
cte(
    "macro",
    [],
    """
    SELECT 'DFF' AS sid, CAST(o_orderdate AS DATE) AS od, CAST(o_orderdate AS DATE) + 1 AS av,
           sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 10000000.0::DOUBLE AS val FROM orders GROUP BY CAST(o_orderdate AS DATE)
    UNION ALL SELECT 'DGS10', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 1, max(o_totalprice) / 100000.0::DOUBLE FROM orders GROUP BY CAST(o_orderdate AS DATE)
    UNION ALL SELECT 'VIXCLS', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE), min(o_totalprice) / 1000.0::DOUBLE FROM orders GROUP BY CAST(o_orderdate AS DATE)
    UNION ALL SELECT 'CPIAUCSL', CAST(date_trunc('month', o_orderdate) AS DATE), CAST(date_trunc('month', o_orderdate) AS DATE) + 50,
           sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100000.0::DOUBLE FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)""",
)
_SEG = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in S.SEGMENT_INTERESTS.items())
cte(
    "investors",
    [],
    f"""
    SELECT c_custkey AS investor_id, list_extract({_list(RISK_TIERS)}, CAST(least(4, greatest(0, floor((c_acctbal + 1000) / 2200))) AS INTEGER) + 1) AS risk_level,
           CASE c_mktsegment {_SEG} END AS interests,
           CASE c_custkey % 4 WHEN 0 THEN 'stock' WHEN 1 THEN 'etf' ELSE 'both' END AS asset_types,
           CASE WHEN c_custkey % 5 = 0 THEN [] WHEN c_custkey * 7 % 25 = (c_custkey * 13 + 3) % 25 THEN [{_tick('c_custkey * 7 % 25 + 1')}]
                ELSE [{_tick('c_custkey * 7 % 25 + 1')}, {_tick('(c_custkey * 13 + 3) % 25 + 1')}] END AS followed
    FROM customer""",
)
cte(
    "fact_years",
    [],
    f"""
    SELECT {_NO} AS no, year(l_shipdate) AS y, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS rev,
           coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'A'), 0)::BIGINT AS a,
           coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'R'), 0)::BIGINT AS r,
           coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'N'), 0)::BIGINT AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
_REV = "CASE WHEN no % 2 = 0 THEN 'Revenues' ELSE 'RevenueFromContractWithCustomerExcludingAssessedTax' END"
cte(
    "facts",
    ["fact_years"],
    f"""
    SELECT {_tick('no')} AS ticker, concept, val::DOUBLE AS val, CASE WHEN dur THEN make_date(y, 1, 1) END AS s, make_date(y, 12, 31) AS e,
           CAST(make_date(y + 1, 2, 15) + no + wait AS DATE) AS filed, seq
    FROM (
      SELECT no, y, {_REV} AS concept, rev / 100 AS val, true AS dur, 0 AS wait, 1 AS seq FROM fact_years
      UNION ALL SELECT no, y, 'OperatingIncomeLoss', (a - r + n) / 200, true, 0, 2 FROM fact_years
      UNION ALL SELECT no, y, 'NetCashProvidedByUsedInOperatingActivities', n / 250, true, 0, 3 FROM fact_years
      UNION ALL SELECT no, y, CASE WHEN no % 3 = 0 THEN 'PaymentsToAcquireProductiveAssets' ELSE 'PaymentsToAcquirePropertyPlantAndEquipment' END, r / 800, true, 0, 4 FROM fact_years
      UNION ALL SELECT no, y, 'AssetsCurrent', a / 100, false, 0, 5 FROM fact_years
      UNION ALL SELECT no, y, 'LiabilitiesCurrent', r / 130, false, 0, 6 FROM fact_years
      UNION ALL SELECT no, y, 'StockholdersEquity', n * CASE WHEN no % 9 = 0 THEN -1 ELSE 1 END / 200, false, 0, 7 FROM fact_years
      UNION ALL SELECT no, y, CASE no % 4 WHEN 0 THEN 'LongTermDebt' WHEN 1 THEN 'LongTermDebtNoncurrent' ELSE 'LongTermDebtAndCapitalLeaseObligations' END, a / 300, false, 0, 8 FROM fact_years WHERE no % 4 <> 3
      UNION ALL SELECT no, y, 'LongTermDebtCurrent', r / 900, false, 0, 9 FROM fact_years WHERE no % 4 = 1
      UNION ALL SELECT no, y, {_REV}, rev / 90, true, 120, 10 FROM fact_years)""",
)
_T1, _T2 = _tick("doc_id % 25 + 1"), _tick("(doc_id * 7 + 3) % 25 + 1")
cte(
    "raw_docs",
    [],
    f"""
    SELECT *, CASE WHEN kind <> 3 AND kind <> 0 AND quality IS NOT NULL THEN quality * 0.5::DOUBLE - toxic * 0.9::DOUBLE + (doc_id % 7 - 3) * 0.05::DOUBLE END AS score,
           CASE WHEN doc_id % 10 <> 9 THEN (doc_id % 10) / 10.0::DOUBLE END AS relevance
    FROM (
      SELECT d.doc_id, d.text, d.source, l.quality, l.toxic, (d.doc_id // 4) % 4 AS kind,
             CASE WHEN (d.doc_id // 4) % 4 = 3 THEN 'sec' ELSE 'news' END AS source_type,
             list_extract({_list(S.PROVIDERS)}, CAST((d.doc_id // 4) % 4 AS INTEGER) + 1) AS provider,
             CASE WHEN (d.doc_id // 4) % 4 = 3 THEN 'sec:' ELSE 'news:' END || CAST(d.doc_id AS VARCHAR) AS document_id,
             CAST(CASE WHEN d.doc_id % 4 < 2 THEN d.doc_id - d.doc_id % 4 ELSE d.doc_id END AS VARCHAR) AS provider_id,
             list_sort(list_distinct(list_filter([{_T1.replace('doc_id', 'd.doc_id')}, {_T2.replace('doc_id', 'd.doc_id')},
                 CASE WHEN d.doc_id % 3 = 0 THEN 'B01' END, CASE WHEN d.doc_id % 11 = 0 THEN 'ZZZ' END], lambda x: x IS NOT NULL))) AS tickers,
             {S.EPOCH_S} + (d.doc_id * 7919 % 1440) * 3600 + (d.doc_id % 60) * 60 AS pub,
             {S.EPOCH_S} + (d.doc_id * 7919 % 1440) * 3600 + (d.doc_id % 60) * 60 + (d.doc_id % 5) * 3600 AS av,
             {S.EPOCH_S} + (d.doc_id * 7919 % 1440) * 3600 + (d.doc_id % 60) * 60 + (d.doc_id % 5) * 3600 + CASE WHEN d.doc_id % 53 = 0 THEN -7200 ELSE 3600 END AS fet,
             CASE WHEN (d.doc_id // 4) % 4 <> 3 AND d.doc_id % 4 = 1 THEN {S.EPOCH_S} + (d.doc_id * 7919 % 1440) * 3600 + (d.doc_id % 60) * 60 + 108000 END AS upd,
             CASE WHEN (d.doc_id // 4) % 4 = 3 THEN 'https://filings.example.com/d/' || CAST(d.doc_id AS VARCHAR)
                  ELSE CASE WHEN d.doc_id % 29 = 0 THEN 'ftp' ELSE 'https' END || '://News.Example.com/a/' || CAST(d.doc_id - d.doc_id % 2 AS VARCHAR)
                       || '/?utm_source=feed&id=' || CAST(d.doc_id - d.doc_id % 2 AS VARCHAR) || '#top' END AS source_url,
             CASE WHEN (d.doc_id // 4) % 4 = 3 THEN 'https://filings.example.com/d/' || CAST(d.doc_id AS VARCHAR)
                  ELSE 'https://news.example.com/a/' || CAST(d.doc_id - d.doc_id % 2 AS VARCHAR) || '?id=' || CAST(d.doc_id - d.doc_id % 2 AS VARCHAR) END AS canonical_url,
             CASE WHEN d.doc_id % 3 <> 1 THEN split_part(d.text, '.', 1) ELSE '' END AS title, d.doc_id % 2 = 0 AS content_available,
             CASE WHEN (d.doc_id // 4) % 4 = 3 THEN list_extract({_list(S.FORMS)}, CAST(d.doc_id % 3 AS INTEGER) + 1) END AS form
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
)
