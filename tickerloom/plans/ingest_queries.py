"""Landing transforms of filings, facts and provider articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import profiles
from tickerloom.plans.catalog import query, r
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.sources import filings as fl
from tickerloom.sources import jsonl, news, standins

FETCHED = "2001-09-01T00:00:00Z"


def tickers(spark, sf):
    return profiles.read_universe(standins.universe(spark, sf)).select("ticker")


# --- filings: orders read as filings of customers -----------------------------------------

AS_OF = "2001-06-30 00:00:00"
cte(
    "filing_list",
    [],
    """
    SELECT o_custkey AS cik, printf('%010d-%02d-%06d', o_custkey, year(o_orderdate) % 100, o_orderkey % 1000000) AS accession, CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_custkey % 5 = 0 THEN '20-F' ELSE '10-K' END WHEN 1 THEN '10-Q' WHEN 2 THEN '10-Q'
             WHEN 3 THEN '8-K' WHEN 4 THEN '6-K' WHEN 5 THEN '10-K' ELSE 'S-1' END AS form, CAST(o_orderdate AS DATE) AS filed, o_orderkey AS k FROM orders""",
)


def filing_list(spark, sf):
    key = F.col("o_orderkey")
    form = (
        F.when(key % 7 == 0, F.when(F.col("o_custkey") % 5 == 0, "20-F").otherwise("10-K"))
        .when((key % 7).isin(1, 2), "10-Q").when(key % 7 == 3, "8-K").when(key % 7 == 4, "6-K").when(key % 7 == 5, "10-K").otherwise("S-1")
    )
    day = F.to_date("o_orderdate").cast("string")
    return standins.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cik"),
        F.format_string("%010d-%02d-%06d", F.col("o_custkey"), F.year("o_orderdate") % 100, key % 1000000).alias("accessionNumber"),
        form.alias("form"),
        day.alias("filingDate"),
        F.lit(None).cast("string").alias("reportDate"),
        F.when(key % 3 != 0, F.concat(day, F.lit("T17:30:00"))).alias("acceptanceDateTime"),
        F.concat(F.lit("d"), key.cast("string"), F.lit(".htm")).alias("primaryDocument"),
    )


@query(
    "filings_selected",
    with_ctes("filing_list")
    + """, known AS (SELECT *, filed::TIMESTAMP + CASE WHEN k % 3 <> 0 THEN INTERVAL 63000 SECOND ELSE INTERVAL 86399 SECOND END AS local FROM filing_list WHERE form <> 'S-1' QUALIFY row_number() OVER (PARTITION BY cik, accession ORDER BY local DESC) = 1),
       acc AS (SELECT * FROM known WHERE local <= TIMESTAMP '2001-06-29 20:00:00'),
       cls AS (SELECT cik, arg_max(form, strftime(local, '%Y%m%d%H%M%S') || accession) AS af FROM acc WHERE form IN ('10-K', '20-F', '40-F') GROUP BY 1),
       j AS (SELECT a.*, coalesce(af IN ('20-F', '40-F'), false) AS fo, coalesce(CASE WHEN af IN ('20-F', '40-F') THEN af END, '10-K') AS ann FROM acc a LEFT JOIN cls USING (cik))
       SELECT cik, accession, form FROM (SELECT *, row_number() OVER (PARTITION BY cik, form ORDER BY local DESC, accession DESC) AS rn FROM j)
       WHERE (form = ann AND rn <= 2) OR (NOT fo AND form = '10-Q' AND rn <= 4) OR (form = CASE WHEN fo THEN '6-K' ELSE '8-K' END AND local >= TIMESTAMP '2001-03-31 19:00:00')""",
)
def filings_selected(spark, sf):
    s = fl.select_filings(filing_list(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return s.select("cik", F.col("accessionNumber").alias("accession"), "form")


@query(
    "acceptance_times",
    with_ctes("filing_list")
    + """SELECT k, epoch(CASE WHEN k % 3 <> 0 THEN (filed::TIMESTAMP + INTERVAL 63000 SECOND) ELSE (filed::TIMESTAMP + INTERVAL 86399 SECOND) END)::BIGINT AS local_s FROM filing_list""",
)
def acceptance(spark, sf):
    """UTC instants brought back to Eastern wall time."""
    d = filing_list(spark, sf)
    t = fl.acceptance_time(F.col("acceptanceDateTime"), F.col("filingDate"))
    return d.select(
        F.regexp_extract("primaryDocument", r"d(\d+)", 1).cast("bigint").alias("k"),
        F.unix_seconds(F.from_utc_timestamp(t, fl.EASTERN)).alias("local_s"),
    )


@query(
    "filing_rows_padded",
    """WITH n AS (SELECT o_custkey AS cik, count(*) AS rows FROM orders GROUP BY 1) SELECT cik, rows, rows AS with_form FROM n UNION ALL SELECT -cik - 1, rows, least(rows, 2) FROM n""",
)
def rows_padded(spark, sf):
    """Parallel arrays per customer, and planted copies whose form array ends after two entries."""
    d = filing_list(spark, sf)
    arrays = d.groupBy("cik").agg(*[F.collect_list(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fl.FILING_COLUMNS])
    short = arrays.withColumns({"cik": -F.col("cik") - 1, "form": F.slice("form", 1, 2)})
    x = fl.filing_rows(arrays.unionByName(short), "cik")
    return x.groupBy("cik").agg(F.count(F.lit(1)).alias("rows"), F.count("form").alias("with_form"))


@query(
    "filing_documents_merged",
    """WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 1)
       SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'T2' WHEN b.doc_id IS NULL THEN 'T1' ELSE 'T1,T2' END AS tickers,
              sha256(CASE WHEN a.doc_id IS NULL OR (b.doc_id IS NOT NULL AND a.doc_id % 2 = 0) THEN 'new ' || b.text ELSE a.text END) AS text_hash FROM a FULL JOIN b USING (doc_id)""",
)
def merged(spark, sf):
    docs = standins.table(spark, sf, "documents")
    d = F.col("doc_id")

    def side(cond, ticker, text, version):
        return docs.filter(cond).select(
            d.cast("string").alias("document_id"), F.array(F.lit(ticker)).alias("tickers"), text.alias("text"), F.sha2(text, 256).alias("content_hash"), version.alias("normalization_version")
        )

    a = side(d % 3 != 0, "T1", F.col("text"), F.when(d % 2 == 0, 1).otherwise(2))
    b = side(d % 3 != 1, "T2", F.concat(F.lit("new "), F.col("text")), F.lit(2))
    m = fl.merge_filings(a, b)
    return m.select(F.col("document_id").cast("bigint").alias("doc_id"), F.array_join("tickers", ",").alias("tickers"), F.sha2("text", 256).alias("text_hash"))


@query(
    "bulk_facts",
    """SELECT accn, concept, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", arg_max(val, q) AS val FROM (
         SELECT CAST(l_orderkey AS VARCHAR) AS accn, CASE l_linenumber % 2 WHEN 0 THEN 'Revenues' ELSE 'Assets' END AS concept, CASE WHEN l_linenumber % 4 < 2 THEN CAST(CAST(l_shipdate AS DATE) - INTERVAL 12 MONTH AS DATE) + 1 END AS s, CAST(l_shipdate AS DATE) AS e,
                l_extendedprice AS val, l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS q, l_linenumber, l_returnflag FROM lineitem) JOIN orders ON CAST(o_orderkey AS VARCHAR) = accn
       WHERE l_linenumber <= 5 AND l_returnflag <> 'R' AND o_orderstatus <> 'P' GROUP BY 1, 2, 3, 4""",
)
def bulk(spark, sf):
    """Orders as submissions and lines as numbers, with a foreign unit, segments and planted unknown issuers to drop."""
    o, li = standins.table(spark, sf, "orders"), standins.table(spark, sf, "lineitem")
    sub = o.select(
        F.col("o_orderkey").cast("string").alias("adsh"), F.col("o_custkey").cast("string").alias("cik"), F.when(F.col("o_orderstatus") == "P", "8-K").otherwise("10-K").alias("form"),
        F.year("o_orderdate").cast("string").alias("fy"), F.lit("FY").alias("fp"), F.date_format("o_orderdate", "yyyyMMdd").alias("filed"),
    )
    n = F.col("l_linenumber")
    num = li.select(
        F.col("l_orderkey").cast("string").alias("adsh"),
        F.when(n % 2 == 0, "Revenues").otherwise("Assets").alias("tag"),
        F.lit("us-gaap/2001").alias("version"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("ddate"),
        F.when(n % 4 < 2, "4").otherwise("0").alias("qtrs"),
        F.when(n > 5, "EUR").otherwise("USD").alias("uom"),
        F.when(F.col("l_returnflag") == "R", "Segment=A").otherwise("").alias("segments"),
        F.lit("").alias("coreg"),
        F.col("l_extendedprice").cast("string").alias("value"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("ingest_seq"),
    )
    planted = lambda df: df.withColumn("adsh", F.concat(F.lit("X"), "adsh"))
    sub, num = sub.unionByName(planted(sub).withColumn("cik", F.concat(F.lit("999999"), "cik"))), num.unionByName(planted(num))
    ciks = standins.table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_custkey").alias("issuer_cik"))
    f = fl.bulk_facts(sub, num, ciks, ["Revenues", "Assets"])
    return f.select("accn", "concept", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "val")


@query(
    "missing_quarters",
    """WITH o AS (SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS n FROM orders), q AS (SELECT n FROM o UNION SELECT max(n) + 3 FROM o) SELECT CAST(n // 4 AS VARCHAR) || 'q' || CAST(n % 4 + 1 AS VARCHAR) AS q FROM (
         SELECT unnest(generate_series((SELECT min(n) FROM q), (SELECT max(n) FROM q))) AS n) ANTI JOIN q USING (n)""",
)
def quarters(spark, sf):
    """Quarters of all orders and one planted three quarters after the last."""
    d = standins.table(spark, sf, "orders").select("o_orderdate")
    d = d.unionByName(d.agg(F.add_months(F.trunc(F.max("o_orderdate"), "quarter"), 9).alias("o_orderdate")))
    return fl.missing_quarters(d.select(F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string")).alias("q")))


@query(
    "fact_coverage",
    with_ctes("assets", "facts")
    + """SELECT a.ticker, CASE WHEN n > 0 THEN 'collected' WHEN a.ticker LIKE 'B1%' THEN 'no_supported_facts' ELSE 'failed' END AS status, coalesce(n, 0) AS facts FROM (SELECT ticker FROM assets UNION ALL SELECT 'B1X' UNION ALL SELECT 'X01') a
         LEFT JOIN (SELECT ticker, count(*) AS n FROM facts GROUP BY 1) f USING (ticker)""",
)
def fact_coverage(spark, sf):
    """Coverage of every asset; two planted ones have no facts, one of them an issuer number."""
    t = tickers(spark, sf).select("ticker")
    t = t.unionByName(spark.createDataFrame([("B1X",), ("X01",)], "ticker string"))
    ciks = t.filter("ticker LIKE 'B1%'").select("ticker", F.lit(1).alias("issuer_cik"))
    return fl.fact_coverage(t, ciks, standins.facts(spark, sf))


@query("issuer_map", "SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS ticker, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def issuers(spark, sf):
    n = standins.table(spark, sf, "nation")
    name = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    entries = n.select(F.lower(name).alias("ticker"), F.col("n_nationkey").cast("bigint").alias("cik"))
    u = n.select(name.alias("ticker"), F.lit("stock").alias("asset_type"))
    m = fl.issuer_map(entries, u)
    c = standins.table(spark, sf, "customer")
    return m.join(c, m.issuer_cik == c.c_nationkey).groupBy("ticker").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "company_facts_flattened",
    """SELECT l_orderkey AS k, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""",
)
def flattened(spark, sf):
    """Lines packed into nested company-facts JSON per order, then flattened again."""
    value = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("end"), F.col("l_extendedprice").alias("val"), F.when(F.col("l_returnflag") == "R", "S-1").otherwise("10-K").alias("form"),
        F.lit("2001-01-01").alias("filed"),
    )
    per = standins.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(value)).alias("v"))
    docs = per.select(
        F.col("l_orderkey").alias("ticker"), F.concat(F.lit('{"facts":{"us-gaap":{"Revenues":{"units":{"USD":'), F.col("v"), F.lit(',"shares":[]}}}}}')).alias("json")
    )
    f = fl.flatten_company_facts(docs)
    return f.groupBy(F.col("ticker").alias("k")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("val"), 2).alias("total"))


# --- provider articles ------------------------------------------------------------------------


@query(
    "articles_symbol_tagged",
    with_ctes("raw_docs")
    + """SELECT doc_id, array_to_string(list_filter(tickers, lambda t: t <> 'ZZZ'), ',') AS tickers, 'news:alpaca:' || doc_id || ':' || left(sha256(strftime(make_timestamp((pub + CASE WHEN doc_id % 4 = 1 THEN 108000 ELSE 0 END) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || sha256(text)), 12) AS document_id FROM raw_docs""",
)
def alpaca(spark, sf):
    d = standins.documents(spark, sf)
    published = F.concat(F.regexp_replace("published_at", "Z$", ""), F.lit("Z"))
    later = F.date_format(F.to_timestamp(published) + F.expr("interval 30 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    a = d.select(
        F.col("ingest_seq").alias("id"), F.col("tickers").alias("symbols"), F.col("title").alias("headline"), F.col("text").alias("content"), F.lit("").alias("summary"),
        F.col("source_url").alias("url"), published.alias("created_at"), F.when(F.col("ingest_seq") % 4 == 1, later).alias("updated_at"),
    )
    n = news.symbol_tagged(a, tickers(spark, sf), FETCHED)
    return n.select(F.col("provider_id").cast("bigint").alias("doc_id"), F.array_join("tickers", ",").alias("tickers"), "document_id")


@query(
    "articles_ticker_scored",
    with_ctes("raw_docs")
    + """SELECT sha256('u' || CAST(doc_id AS VARCHAR)) AS provider_id, array_to_string(list_filter(tickers, lambda t: t <> 'ZZZ'), ',') AS tickers, len(list_filter(tickers, lambda t: t <> 'ZZZ'))::BIGINT AS entries FROM raw_docs""",
)
def alpha(spark, sf):
    d = standins.documents(spark, sf)
    tag = lambda t: F.named_struct(F.lit("ticker"), t, F.lit("label"), F.lit("Neutral"), F.lit("score"), F.lit("0.1"), F.lit("relevance"), F.lit("0.5"))
    a = d.select(
        F.concat(F.lit("u"), F.col("ingest_seq").cast("string")).alias("url"), "title", F.lit("20010701T120000").alias("time_published"), F.col("text").alias("summary"),
        F.transform("tickers", tag).alias("ticker_sentiment"),
    )
    n = news.ticker_scored(a, tickers(spark, sf), FETCHED)
    return n.select("provider_id", F.array_join("tickers", ",").alias("tickers"), F.size("provider_sentiment").cast("bigint").alias("entries"))


@query(
    "articles_entity_scored",
    with_ctes("raw_docs")
    + """SELECT doc_id, t AS ticker, round(s, 6) AS score, CASE WHEN s <= -0.15 THEN 'Bearish' WHEN s >= 0.15 THEN 'Bullish' ELSE 'Neutral' END AS label, least((doc_id % 150) / 100.0::DOUBLE, 1) AS relevance FROM (
         SELECT doc_id, unnest(list_filter(tickers, lambda t: t <> 'ZZZ')) AS t, (doc_id % 21 - 10) / 10.0::DOUBLE AS s FROM raw_docs WHERE doc_id % 9 <> 0)""",
)
def marketaux(spark, sf):
    d = standins.documents(spark, sf)
    k = F.col("ingest_seq")
    score = F.when(k % 9 == 0, "n/a").otherwise(((k % 21 - 10) / F.lit(10.0)).cast("string"))
    ent = lambda t: F.named_struct(F.lit("symbol"), t, F.lit("sentiment_score"), score, F.lit("match_score"), (k % 150).cast("string"))
    a = d.select(
        k.cast("string").alias("uuid"), F.transform("tickers", ent).alias("entities"), F.col("text").alias("description"), F.lit("").alias("snippet"), "title",
        F.col("source_url").alias("url"), "published_at",
    )
    n = news.entity_scored(a, tickers(spark, sf), FETCHED)
    x = n.select(F.col("provider_id").cast("bigint").alias("doc_id"), F.explode("provider_sentiment").alias("ticker", "p"))
    return x.select("doc_id", "ticker", r(F.col("p.score")).alias("score"), F.col("p.label").alias("label"), F.col("p.relevance").alias("relevance"))


@query(
    "articles_appended",
    "SELECT event_id // 4 AS id, min(event_id) AS first_event FROM events WHERE event_id // 4 NOT IN (SELECT event_id // 4 FROM events WHERE event_type = 'error') GROUP BY 1",
)
def appended(spark, sf):
    e = standins.events(spark, sf).withColumn("id", F.floor(F.col("event_id") / 4))
    have = e.filter("event_type = 'error'").select("id").distinct()
    return news.append_new(have, e.select("id", F.col("event_id").alias("first_event")), "id", "first_event")


@query(
    "pending_windows",
    """WITH w AS (SELECT o_custkey AS provider, CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM orders GROUP BY 1)
       SELECT provider, CAST(day AS VARCHAR) AS day FROM w ANTI JOIN (SELECT o_custkey AS provider, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'P') USING (provider, day) ORDER BY day DESC, provider LIMIT 500""",
)
def pending(spark, sf):
    """Daily collection windows per account; the quota cut is the feature itself."""
    o = standins.table(spark, sf, "orders")
    ranges = o.groupBy(F.col("o_custkey").alias("provider")).agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end")).filter("start < end")
    ledger = o.select(F.col("o_custkey").alias("provider"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "P", "partial").otherwise("collected").alias("status"))
    return news.pending_windows(ranges, ledger, 500).withColumn("day", F.col("day").cast("string"))


@query(
    "filing_document_rows",
    """SELECT 'sec:' || doc_id || ':' || acc AS document_id, 'T' || (doc_id % 50) AS tickers, source || ' ' || form || ' (2001-01-02)' AS title, '2001-01-02T17:30:00Z' AS published_at, '2001-01-02T17:30:00Z' AS available_at,
              'https://www.sec.gov/Archives/edgar/data/' || doc_id || '/' || replace(acc, '-', '') || '/d' || doc_id || '.htm' AS source_url, sha256(text) AS content_hash, doc_id AS cik, form
       FROM (SELECT *, format('{:010d}-{:02d}-{:06d}', doc_id, doc_id % 100, doc_id % 1000000) AS acc, CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '8-K' END AS form,
               FROM (SELECT doc_id, source, text FROM documents UNION ALL SELECT doc_id, source, '' FROM documents)) WHERE text <> ''""",
)
def filing_document_rows(spark, sf):
    """Every document as a filing of its own issuer; a copy of each without text is planted and must go."""
    d = standins.table(spark, sf, "documents").withColumn("accessionNumber", F.format_string("%010d-%02d-%06d", "doc_id", F.col("doc_id") % 100, F.col("doc_id") % 1000000))
    d = d.withColumn("cik", F.col("doc_id"))
    selected = d.select(
        "cik", "accessionNumber", F.concat(F.lit("T"), (F.col("cik") % 50).cast("string")).alias("ticker"), F.col("source").alias("issuer"), F.when(F.col("cik") % 2 == 0, "10-K").otherwise("8-K").alias("form"),
        F.lit("2001-01-02").alias("filingDate"), F.lit("2001-01-02 17:30:00").cast("timestamp").alias("accepted"), F.concat(F.lit("d"), F.col("cik").cast("string"), F.lit(".htm")).alias("primaryDocument"),
    )
    texts = d.select("cik", "accessionNumber", "text")
    rows = fl.filing_documents(selected, texts.unionByName(texts.withColumn("text", F.lit(""))))
    return rows.select("document_id", F.array_join("tickers", ",").alias("tickers"), "title", "published_at", "available_at", "source_url", "content_hash", "cik", "form")


@query(
    "jsonl_projection",
    """SELECT document_id, source_type, provider_id, tickers, published, problem, sha256(line) AS payload_hash FROM (
         SELECT CAST(event_id AS VARCHAR) AS document_id, event_type AS source_type, CAST(user_id AS VARCHAR) AS provider_id, event_type || ',X' AS tickers, CASE WHEN event_id % 4 < 2 THEN 978307200 END AS published,
                CASE WHEN event_id % 4 = 2 THEN 'stamp_without_zone' END AS problem,
                '{"document_id":"' || event_id || '","source_type":"' || event_type || '","provider_id":' || user_id || CASE event_id % 4 WHEN 0 THEN ',"published_at":"2001-01-01T00:00:00Z"' WHEN 1 THEN ',"published_at":"2001-01-01T05:30:00+05:30"' WHEN 2 THEN ',"published_at":"2001-01-01T00:00:00"' ELSE '' END || ',"tickers":["' || event_type || '","X"]}' AS line FROM events)""",
)
def jsonl_projection(spark, sf):
    """All typed fields of every event as a JSON line: numbers as text, two zones, a stamp without one, a missing stamp."""
    k = F.col("event_id")
    stamp = F.when(k % 4 == 0, "2001-01-01T00:00:00Z").when(k % 4 == 1, "2001-01-01T05:30:00+05:30").when(k % 4 == 2, "2001-01-01T00:00:00")
    line = F.to_json(F.struct(k.cast("string").alias("document_id"), F.col("event_type").alias("source_type"), F.col("user_id").alias("provider_id"), stamp.alias("published_at"), F.array("event_type", F.lit("X")).alias("tickers")))
    rec = jsonl.query_records(jsonl.check_lines(standins.events(spark, sf).select(line.alias("value"))))
    return rec.select("document_id", "source_type", "provider_id", F.array_join("tickers", ",").alias("tickers"), F.unix_seconds("published_at").alias("published"), "problem", F.sha2("payload", 256).alias("payload_hash"))


@query(
    "jsonl_records",
    """SELECT event_id, CASE WHEN event_id % 10 = 1 THEN 'not_json' WHEN event_id % 10 = 2 THEN 'not_an_object' WHEN event_id % 10 = 3 THEN 'stamp_without_zone' ELSE 'ok' END AS outcome FROM events WHERE event_id % 10 <> 4""",
)
def json_lines(spark, sf):
    """Every event as a JSON line, some broken: blank, not JSON, an array, a stamp without zone."""
    k = F.col("event_id")
    good = F.to_json(F.struct(k.cast("string").alias("document_id"), F.when(k % 10 == 3, "2001-01-01T00:00:00").otherwise("2001-01-01T00:00:00Z").alias("published_at"), F.array(F.col("event_type")).alias("tickers")))
    value = F.when(k % 10 == 1, "{broken").when(k % 10 == 2, "[1, 2]").when(k % 10 == 4, "  ").otherwise(good)
    lines = standins.events(spark, sf).select(value.alias("value"), k.alias("event_id"))
    checked = jsonl.check_lines(lines)
    rec = jsonl.query_records(checked)
    n = rec.groupBy("document_id", "problem").agg(F.count(F.lit(1)).alias("n"))  # typed projection is exercised whole
    typed = n.filter(F.col("document_id").isNotNull()).select(F.col("document_id").cast("bigint").alias("event_id"), F.coalesce("problem", F.lit("ok")).alias("outcome"))
    broken = checked.filter(F.col("problem").isNotNull()).select("event_id", F.col("problem").alias("outcome"))
    return typed.unionByName(broken)
