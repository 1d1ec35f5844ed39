"""Text preparation, attribution, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions.columns import clean_lines, sha
from tickerloom.functions.html import with_visible_text
from tickerloom.operators import profiles
from tickerloom.operators import sentiment as se
from tickerloom.operators import text as tx
from tickerloom.operators.quality import compare
from tickerloom.plans.catalog import query, r
from tickerloom.plans.html_sql import PAGE_TEXT
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.session import balanced, cut_lineage, stored_table
from tickerloom.sources import standins

AS_OF_S = standins.AS_OF_S


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF_S))


def tickers(spark, sf):
    return profiles.read_universe(standins.universe(spark, sf)).select("ticker")


CLEAN = "array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> ''), chr(10))"
cte(
    "screen",
    ["raw_docs"],
    f"""
    SELECT *, list_filter(tickers, lambda t: t <> 'ZZZ') AS kt,
           CASE WHEN doc_id % 97 = 0 OR doc_id % 31 = 0 OR fet < av THEN 'invalid_source_record' WHEN av > {AS_OF_S} THEN 'not_available_at_cutoff'
                WHEN (doc_id % 29 = 0 AND kind <> 3) OR body = '' THEN 'invalid_source_record' WHEN coalesce(upd, av) > {AS_OF_S} THEN 'revision_after_cutoff' END AS reason
    FROM (SELECT *, {CLEAN.format(x="CASE WHEN kind <> 3 THEN concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(text), '')) ELSE text END")} AS body FROM raw_docs)""",
)
cte(
    "revs",
    ["screen"],
    """
    SELECT *, min(doc_id) OVER (PARTITION BY provider, provider_id) AS pos FROM screen WHERE reason IS NULL
    QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY coalesce(upd, av) DESC, doc_id) = 1""",
)
cte(
    "prepared",
    ["revs"],
    """
    SELECT c.*, g.mt, g.mav, g.mfet, g.n FROM (
      SELECT * FROM revs QUALIFY row_number() OVER (PARTITION BY source_type, canonical_url ORDER BY content_available DESC, len(body) DESC, pos) = 1) c
    JOIN (SELECT source_type, canonical_url, list_sort(list_distinct(flatten(list(kt)))) AS mt, max(av) AS mav, max(fet) AS mfet, count(*) AS n FROM revs GROUP BY 1, 2) g
      USING (source_type, canonical_url)""",
)


def screened(spark, sf):
    return tx.screened(standins.documents(spark, sf), tickers(spark, sf), as_of(), html_bodies=True)


def prepared(spark, sf):
    """The prepared documents as a stored table: later steps read it several times."""
    # of a record only the body goes on, not the text it was made from
    return cut_lineage(tx.syndicated(cut_lineage(tx.newest_revisions(screened(spark, sf).drop("text")))))


@query(
    "document_screening",
    with_ctes("screen") + "SELECT document_id, coalesce(reason, 'accepted') AS outcome, len(body)::BIGINT AS body_chars, sha256(body) AS body_hash FROM screen",
)
def screening(spark, sf):
    s = screened(spark, sf)
    return s.select(
        "document_id",
        F.coalesce("reason", F.lit("accepted")).alias("outcome"),
        F.length("body").cast("bigint").alias("body_chars"),
        sha(F.col("body")).alias("body_hash"),
    )


@query(
    "canonical_urls",
    """SELECT page_id, CASE WHEN regexp_extract(url, '^(?:https?)://[^/]+') <> '' THEN
         lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/')
         || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM (
           SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
             lambda p: split_part(p, '=', 2) <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_.*|fbclid|gclid)$')), '&') AS q FROM pages)""",
)
def canonical(spark, sf):
    return standins.pages(spark, sf).select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


@query("page_visible_text", PAGE_TEXT)
def page_text(spark, sf):
    """HTML pages to visible text, every page whole."""
    p = with_visible_text(standins.pages(spark, sf).select("page_id", "html"), "html", "text")
    return p.select("page_id", F.length("text").alias("chars"), sha(F.col("text")).alias("text_hash"))


@query(
    "documents_prepared",
    with_ctes("prepared")
    + """SELECT document_id, source_type, canonical_url, array_to_string(mt, ',') AS tickers, sha256(body) AS content_hash, mav::BIGINT AS available_s, mfet::BIGINT AS fetched_s, n AS source_count FROM prepared""",
)
def documents_prepared(spark, sf):
    return prepared(spark, sf).select(
        "document_id",
        "source_type",
        "canonical_url",
        F.array_join("tickers", ",").alias("tickers"),
        "content_hash",
        F.unix_seconds("available").alias("available_s"),
        F.unix_seconds("fetched").alias("fetched_s"),
        "source_count",
    )


@query(
    "document_sources",
    with_ctes("prepared", "revs")
    + "SELECT p.document_id, v.document_id AS source_document_id FROM prepared p JOIN revs v USING (source_type, canonical_url)",
)
def sources(spark, sf):
    rev = cut_lineage(tx.newest_revisions(screened(spark, sf)))
    return tx.document_sources(rev, tx.syndicated(rev))


cte(
    "headed",
    [],
    f"""SELECT doc_id, body, sha256(body) AS h FROM (SELECT doc_id, {CLEAN.format(x="regexp_replace(text, '(?m)^T', 'Item 7. T', 'g')")} AS body FROM documents)""",
)
cte(
    "line_rows",
    ["headed"],
    """
    SELECT *, CASE WHEN regexp_matches(line, '(?i)^(?:part\\s+[ivx]+[. \\t]*)?item\\s+\\d+[a-z]?[. :\\t-]*.{0,120}$') AND off > 0 THEN 1 ELSE 0 END AS head FROM (
      SELECT doc_id, i, line, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM headed WHERE body <> ''))""",
)
cte(
    "section_rows",
    ["line_rows"],
    """
    SELECT doc_id, sec, min(off) AS s0, CASE WHEN min(off) = 0 THEN 'Document' ELSE trim(arg_min(line, i)) END AS section, string_agg(line, chr(10) ORDER BY i) AS part
    FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM line_rows) GROUP BY 1, 2""",
)
cte(
    "chunks",
    ["section_rows", "headed"],
    """
    WITH tok AS (SELECT doc_id, sec, s0, section, w, i, (sum(len(w) + 1) OVER (PARTITION BY doc_id, sec ORDER BY i) - 1)::BIGINT AS fin, count(*) OVER (PARTITION BY doc_id, sec) AS n
           FROM (SELECT doc_id, sec, s0, section, unnest(regexp_extract_all(part, '\\S+')) AS w, generate_subscripts(regexp_extract_all(part, '\\S+'), 1) AS i FROM section_rows)),
    ks AS (SELECT DISTINCT doc_id, sec, s0, section, n, k FROM (SELECT *, unnest(generate_series(0, n // 188)) AS k FROM (SELECT DISTINCT doc_id, sec, s0, section, n FROM tok)) WHERE k = 0 OR 188 * (k - 1) + 220 < n)
    SELECT ks.doc_id, ks.section, least(188 * k + 220, ks.n) - 188 * k AS tokens, ks.s0 + a.fin - len(a.w) AS l, ks.s0 + b.fin AS r
    FROM ks JOIN tok a ON a.doc_id = ks.doc_id AND a.sec = ks.sec AND a.i = 188 * k + 1 JOIN tok b ON b.doc_id = ks.doc_id AND b.sec = ks.sec AND b.i = least(188 * k + 220, ks.n)""",
)


def headed_documents(spark, sf):
    """The corpus with item headings put before lines that start with T."""
    body = clean_lines(F.regexp_replace("text", r"(?m)^T", "Item 7. T"))
    docs = balanced(standins.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", body.alias("text")).select(
        F.col("doc_id").cast("string").alias("document_id"), "text", sha(F.col("text")).alias("content_hash")
    )


@query(
    "filing_sections",
    with_ctes("section_rows") + "SELECT CAST(doc_id AS VARCHAR) AS document_id, section, s0::BIGINT AS section_start FROM section_rows",
)
def filing_sections(spark, sf):
    s = tx.sections(headed_documents(spark, sf))
    return s.select("document_id", "section", F.col("section_start").cast("bigint").alias("section_start"))


@query(
    "document_chunks",
    with_ctes("chunks")
    + """SELECT sha256(CAST(doc_id AS VARCHAR) || ':' || h || ':' || l || ':' || r) AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, section, l::BIGINT AS start_char, r::BIGINT AS end_char,
         tokens::BIGINT AS token_count, sha256(substr(body, CAST(l + 1 AS BIGINT), CAST(r - l AS BIGINT))) AS content_hash FROM chunks JOIN headed USING (doc_id)""",
)
def document_chunks(spark, sf):
    ch = tx.chunk_documents(headed_documents(spark, sf))
    return ch.select(
        "chunk_id", "document_id", "section", *[F.col(n).cast("bigint").alias(n) for n in ("start_char", "end_char", "token_count")], "content_hash"
    )


_CHUNK_FAULTS = {
    1: "chunk_offset", 2: "chunk_identity", 3: "chunk_missing_parent", 4: "declared_token_bound", 5: "chunk_source_url", 6: "chunk_source_type", 7: "chunk_tickers",
    8: "chunk_available", 9: "duplicate_chunk_id",
}


@query(
    "chunk_gate",
    with_ctes("chunks", "headed")
    + "SELECT kind, count(*) AS n FROM (SELECT kind FROM chunks JOIN (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _CHUNK_FAULTS.items()) + ") f(k, kind) ON doc_id % 101 = k"
    + " UNION ALL SELECT 'document_without_chunks' FROM headed WHERE body <> '' AND doc_id % 101 = 3) GROUP BY 1",
)
def chunk_gate(spark, sf):
    """Chunks of all documents against their parents, with faults of every kind planted by document number."""
    docs = headed_documents(spark, sf).filter("text <> ''").select(
        "*", F.lit("u").alias("source_url"), F.lit("sec").alias("source_type"), F.array(F.lit("B01")).alias("tickers"), F.lit(0).alias("available")
    )
    # the checks read texts three times and chunks six times, so both are stored
    docs = stored_table(docs)
    chunks = stored_table(tx.chunk_documents(docs)).withColumn("_k", F.col("document_id").cast("bigint") % 101)
    wrong = lambda k, c, value: F.when(F.col("_k") == k, value).otherwise(F.col(c))
    faulty = chunks.withColumns({
        "text": wrong(1, "text", F.concat("text", F.lit("x"))), "chunk_id": wrong(2, "chunk_id", F.concat("chunk_id", F.lit("x"))), "document_id": wrong(3, "document_id", F.concat("document_id", F.lit("x"))),
        "token_count": wrong(4, "token_count", F.lit(0)), "source_url": wrong(5, "source_url", F.lit(None)), "source_type": wrong(6, "source_type", F.lit("news")),
        "tickers": wrong(7, "tickers", F.array(F.lit("B02"))), "available": wrong(8, "available", F.lit(1)),
    })
    faulty = faulty.unionByName(chunks.filter("_k = 9"))
    return tx.chunk_problems(faulty, docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "corpus_profile",
    with_ctes("chunks", "headed")
    + """SELECT count(*) AS chunks, count(*) FILTER (section = 'Document') AS lead_in_chunks, 0::BIGINT AS cover, 0::BIGINT AS toc, 0::BIGINT AS signatures, count(*) - count(DISTINCT t) AS exact_duplicates_excess
         FROM (SELECT section, substr(body, CAST(l + 1 AS BIGINT), CAST(r - l AS BIGINT)) AS t FROM chunks JOIN headed USING (doc_id))""",
)
def corpus_profile(spark, sf):
    return tx.corpus_profile(tx.chunk_documents(headed_documents(spark, sf)))


@query(
    "source_gate",
    with_ctes("raw_docs")
    + f"""SELECT kind, count(*) AS n FROM (
           SELECT unnest(list_filter([CASE WHEN bad THEN 'source_timestamp_invalid' END, CASE WHEN NOT bad AND NOT (pub <= av AND av <= fet AND fet <= {AS_OF_S}) THEN 'source_timestamp_order' END,
             CASE WHEN NOT bad AND upd > av THEN 'revision_not_yet_available' END, CASE WHEN list_contains(tickers, 'ZZZ') THEN 'source_tickers' END], lambda x: x IS NOT NULL)) AS kind
           FROM (SELECT *, doc_id % 97 = 0 OR doc_id % 31 = 0 AS bad FROM raw_docs)) GROUP BY 1""",
)
def source_gate(spark, sf):
    p = tx.source_problems(standins.documents(spark, sf), tickers(spark, sf), as_of())
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prepared_gate",
    with_ctes("prepared")
    + """SELECT kind, count(*) AS n FROM (SELECT left(sha256(document_id), 1) AS k, mt FROM prepared) p
         JOIN (VALUES ('0', 'merged_availability'), ('1', 'prepared_content_hash'), ('2', 'merged_tickers'), ('3', 'unknown_source_reference'), ('3', 'merged_tickers'),
                      ('4', 'duplicate_canonical_url'), ('4', 'unknown_source_reference'), ('4', 'merged_tickers')) f(k, kind) USING (k)
         WHERE kind <> 'merged_tickers' OR k = '2' OR len(mt) > 0 GROUP BY 1""",
)
def prepared_gate(spark, sf):
    """Prepared documents against their sources, with faults of every kind planted by a digit of the id's hash."""
    rev = cut_lineage(tx.newest_revisions(screened(spark, sf)))
    docs = cut_lineage(tx.syndicated(rev))
    digit = F.left(sha(F.col("document_id")), F.lit(1))
    faulty = docs.withColumns({
        "available": F.when(digit == "0", F.col("available") + F.expr("interval 1 hour")).otherwise(F.col("available")),
        "content_hash": F.when(digit == "1", "none").otherwise(F.col("content_hash")),
        "tickers": F.when(digit == "2", F.array_append("tickers", "NONE")).otherwise(F.col("tickers")),
    })
    again = docs.filter(digit == "4").withColumn("document_id", F.concat("document_id", F.lit(" again")))
    p = tx.document_problems(faulty.unionByName(again), tx.document_sources(rev, docs).filter(digit != "3"), standins.documents(spark, sf))
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


cte(
    "company_names",
    ["assets"],
    """
    SELECT ticker, lower(name) AS name, lower(trim(regexp_replace(name, '(?i)[,\\s]+(?:incorporated|inc\\.?|corporation|corp\\.?|company|co\\.?|plc|ltd\\.?)(?:[,\\s].*)?$', ''))) AS short FROM assets""",
)
cte(
    "attributed",
    ["prepared", "company_names"],
    """
    WITH sent AS (SELECT document_id, mt, s, i FROM (SELECT document_id, mt, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (
             SELECT document_id, mt, string_split(regexp_replace(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS ss FROM prepared WHERE source_type = 'news'))),
    hit AS (SELECT document_id, i, s, ticker FROM (SELECT document_id, i, s, unnest(mt) AS ticker FROM sent) JOIN company_names USING (ticker)
            WHERE contains(lower(s), short) AND CASE WHEN contains(lower(s), short) THEN regexp_matches(s, '(?i)(^|[^\\p{L}\\p{N}_])' || short || '([^\\p{L}\\p{N}_]|$)') ELSE false END),
    one AS (SELECT document_id, i, any_value(s) AS s, any_value(ticker) AS ticker FROM hit GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT p.document_id, p.ticker, coalesce(t.text, '') AS text FROM (SELECT document_id, unnest(mt) AS ticker FROM prepared WHERE source_type = 'news') p
    LEFT JOIN (SELECT document_id, ticker, string_agg(s, ' ' ORDER BY i) AS text FROM one GROUP BY 1, 2) t USING (document_id, ticker)""",
)


def attributed(spark, sf, docs=None):
    return tx.attributed_text(prepared(spark, sf) if docs is None else docs, profiles.read_universe(standins.universe(spark, sf)))


def attributed_once(spark, sf, docs=None):
    """The attributed sentences as a stored table, for queries that read them several times."""
    return cut_lineage(attributed(spark, sf, docs))


def score_cache(inputs):
    """Deterministic scores per text hash, the place of a model's output table."""
    texts = inputs.filter("status = 'pending'").select(sha(F.col("text")).alias("input_hash"), F.length("text").alias("n")).distinct()
    pos, neg = (F.col("n") % 13) / F.lit(20.0), (F.col("n") % 7) / F.lit(20.0)
    return texts.filter("n % 5 <> 0").select(
        "input_hash", (pos - neg).alias("score"), pos.alias("positive"), neg.alias("negative"), (1 - pos - neg).alias("neutral"), F.col("n").alias("input_tokens")
    )


cte(
    "scored",
    ["attributed"],
    """SELECT *, CASE WHEN text = '' THEN 'unavailable_ambiguous_attribution' WHEN len(text) % 5 <> 0 THEN 'scored' ELSE 'not_run' END AS status,
       CASE WHEN text <> '' AND len(text) % 5 <> 0 THEN (len(text) % 13) / 20.0::DOUBLE - (len(text) % 7) / 20.0::DOUBLE END AS sc FROM attributed""",
)


@query(
    "attributed_sentences",
    with_ctes("attributed")
    + "SELECT document_id, ticker, CASE WHEN text <> '' THEN 'pending' ELSE 'unavailable_ambiguous_attribution' END AS status, sha256(text) AS text_hash FROM attributed",
)
def attributed_sentences(spark, sf):
    return attributed(spark, sf).select("document_id", "ticker", "status", sha(F.col("text")).alias("text_hash"))


@query(
    "sentiment_scored",
    with_ctes("scored") + "SELECT document_id, ticker, status, round(sc, 6) AS score, len(text) > 512 AND status = 'scored' AS truncated FROM scored",
)
def sentiment_scored(spark, sf):
    inputs = attributed_once(spark, sf)
    s = tx.scored(inputs, score_cache(inputs))
    return s.select("document_id", "ticker", "status", r("score"), F.coalesce("input_truncated", F.lit(False)).alias("truncated"))


@query(
    "sentiment_unscored_backlog",
    with_ctes("scored") + "SELECT DISTINCT sha256(text) AS input_hash FROM scored WHERE status = 'not_run'",
)
def backlog(spark, sf):
    inputs = attributed_once(spark, sf)
    return tx.unscored(inputs, score_cache(inputs)).select("input_hash")


cte(
    "weekly",
    ["prepared", "scored", "assets", "revs"],
    f"""
    WITH entries AS (SELECT source_type, canonical_url, t, arg_max(score, pos) AS score FROM (SELECT source_type, canonical_url, score, pos, unnest(tickers) AS t FROM revs WHERE score IS NOT NULL) GROUP BY 1, 2, 3),
    rec AS (SELECT p.document_id, p.source_type, p.canonical_url, p.pub, unnest(p.mt) AS ticker FROM prepared p WHERE source_type = 'news' AND pub BETWEEN {AS_OF_S} - 7 * 86400 AND {AS_OF_S} AND mav <= {AS_OF_S}),
    j AS (SELECT r.*, exp(-ln(2) * (({AS_OF_S} - r.pub) / 86400.0::DOUBLE) / 2) AS w, s.sc, CASE WHEN e.score BETWEEN -1 AND 1 THEN e.score END AS prov
          FROM rec r LEFT JOIN (SELECT document_id, ticker, sc FROM scored WHERE status = 'scored') s USING (document_id, ticker)
          LEFT JOIN entries e ON e.source_type = r.source_type AND e.canonical_url = r.canonical_url AND e.t = r.ticker)
    SELECT a.ticker, count(j.document_id) AS n, count(sc) AS nl, sum(sc * w) / sum(w) FILTER (sc IS NOT NULL) AS loc, sum(prov * w) / sum(w) FILTER (prov IS NOT NULL) AS prov, max(pub) AS latest
    FROM assets a LEFT JOIN j USING (ticker) GROUP BY 1""",
)


def weekly(spark, sf):
    docs = prepared(spark, sf)
    inputs = attributed_once(spark, sf, docs)
    return se.weekly_sentiment(docs, tx.scored(inputs, score_cache(inputs)), tickers(spark, sf), as_of())


@query(
    "weekly_sentiment",
    with_ctes("weekly")
    + """SELECT ticker, n AS articles_7d, nl AS local_scored_articles_7d, round(loc, 6) AS local_sentiment_7d, round(prov, 6) AS provider_sentiment_7d, CASE WHEN nl > 0 THEN 'available' ELSE 'unavailable' END AS sentiment_status,
         strftime(make_timestamp(latest * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS latest_publication FROM weekly""",
)
def weekly_sentiment(spark, sf):
    return weekly(spark, sf).withColumn("local_sentiment_7d", r(F.col("local_sentiment_7d"))).withColumn(
        "provider_sentiment_7d", r(F.col("provider_sentiment_7d"))
    )


@query(
    "sentiment_aggregate_gate",
    with_ctes("weekly") + "SELECT count(*) AS rows, count(loc) FILTER (ticker < 'B05') AS mismatches FROM weekly",
)
def aggregate_gate(spark, sf):
    """Weekly means recomputed from text-level rows and compared; the recomputed ones of a few tickers are wrong."""
    docs = prepared(spark, sf)
    inputs = attributed_once(spark, sf, docs)
    sc = tx.scored(inputs, score_cache(inputs))
    first = se.weekly_sentiment(docs, sc, tickers(spark, sf), as_of()).select("ticker", "local_sentiment_7d")
    age = (F.lit(AS_OF_S) - F.unix_seconds("published")) / 86400.0
    again = (
        sc.filter("status = 'scored'")
        .join(docs.select("document_id", "published"), "document_id")
        .filter(F.col("published").between(as_of() - F.expr("interval 7 days"), as_of()) & (F.col("available") <= as_of()))
        .withColumn("w", F.pow(F.lit(0.5), age / 2))
        .groupBy("ticker")
        .agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("again"))
    )
    again = again.withColumn("again", F.col("again") + F.when(F.col("ticker") < "B05", 1.0).otherwise(0.0))
    return compare(first.join(again, "ticker", "left"), "local_sentiment_7d", "again").select("rows", "mismatches")


cte(
    "news_records",
    ["raw_docs"],
    """SELECT doc_id, unnest(tickers) AS ticker, score, relevance, pub, CASE WHEN doc_id % 97 = 0 THEN pub ELSE av END AS av, source_url, provider FROM raw_docs WHERE score IS NOT NULL""",
)


def signal_sql(floor: float, hours: int, half: int, minimum: int, relevance: str) -> str:
    return f"""
    WITH el AS (SELECT *, {relevance} AS rel, ({AS_OF_S} - pub) / 3600.0::DOUBLE AS age FROM news_records WHERE pub <= {AS_OF_S} AND av <= {AS_OF_S} AND score BETWEEN -1 AND 1),
    st AS (SELECT *, min(doc_id) OVER (PARTITION BY ticker, source_url) AS fs FROM el WHERE rel >= {floor} AND age BETWEEN 0 AND {hours}
           QUALIFY row_number() OVER (PARTITION BY ticker, source_url ORDER BY pub DESC, doc_id) = 1)
    SELECT ticker, count(*) AS n, sum(exp(-ln(2) * age / {half}) * rel * score) / nullif(sum(exp(-ln(2) * age / {half}) * rel), 0) AS score, avg(rel) AS relevance, min(age) AS recency, arg_min(provider, fs) AS source
    FROM st GROUP BY 1 HAVING count(*) >= {minimum}"""


cte("news_signal", ["news_records"], signal_sql(0.0, 168, 24, 2, "relevance"))
cte("news_signal_default", ["news_records"], signal_sql(0.1, 72, 24, 2, "coalesce(relevance, 1.0)"))
_SIGNAL_SELECT = """SELECT a.ticker, n::BIGINT AS article_count, round(score, 6) AS score, round(relevance, 6) AS relevance, round(recency, 6) AS recency_hours, source
    FROM assets a LEFT JOIN {t} s ON a.ticker = s.ticker AND s.score IS NOT NULL"""


def _signals(spark, sf, default, window):
    rec = se.provider_records(se.dated(standins.documents(spark, sf)), default)
    s = se.news_signals(rec, tickers(spark, sf), as_of(), window)
    return s.select(
        "ticker",
        F.col("news.article_count").cast("bigint").alias("article_count"),
        *[r(F.col(f"news.{n}")).alias(n) for n in ("score", "relevance", "recency_hours")],
        F.col("news.source").alias("source"),
    )


@query("news_signals", with_ctes("news_signal", "assets") + _SIGNAL_SELECT.format(t="news_signal"))
def news_signals(spark, sf):
    return _signals(spark, sf, None, se.ASSEMBLY_WINDOW)


@query("news_signals_assumed_relevance", with_ctes("news_signal_default", "assets") + _SIGNAL_SELECT.format(t="news_signal_default"))
def news_signals_default(spark, sf):
    return _signals(spark, sf, 1.0, se.NewsWindow())


@query(
    "latest_sentiment",
    with_ctes("raw_docs", "weekly")
    + f"""SELECT ticker, round(arg_max(score, (k, pr)), 6) AS score, arg_max(source, (k, pr)) AS source, arg_max(n, (k, pr)) AS article_count FROM (
          SELECT ticker, avg(score) AS score, 'marketaux' AS source, any_value(nw) AS k, 1 AS pr, count(*) AS n FROM (
             SELECT *, max(pub) OVER (PARTITION BY ticker) AS nw FROM (SELECT unnest(tickers) AS ticker, score, pub FROM raw_docs WHERE provider = 'marketaux' AND score IS NOT NULL AND pub <= {AS_OF_S}))
          WHERE pub > nw - 7 * 86400 GROUP BY 1
          UNION ALL SELECT ticker, prov, 'alpha_vantage', latest, 0, n FROM weekly WHERE nl > 0 AND prov IS NOT NULL) GROUP BY 1""",
)
def latest_sentiment(spark, sf):
    s = se.latest_sentiment(se.dated(standins.documents(spark, sf)), weekly(spark, sf), as_of())
    return s.select("ticker", r("score"), "source", "article_count")


@query(
    "attribution_diagnostics",
    with_ctes("scored", "weekly", "prepared", "revs")
    + """SELECT count(*) AS associations, count(*) FILTER (status <> 'scored') AS ambiguous, count(*) FILTER (status = 'scored' AND e.score IS NOT NULL) AS rows_with_both,
         count(*) FILTER (status = 'scored' AND e.score IS NOT NULL AND (sc >= 0) = (e.score >= 0)) AS sign_agreement,
         (SELECT count(*) FROM weekly WHERE loc IS NOT NULL AND prov IS NOT NULL) AS aggregate_pairs, (SELECT count(*) FROM weekly WHERE (loc >= 0) = (prov >= 0)) AS aggregate_agreement,
         round((SELECT avg(abs(loc - prov)) FROM weekly), 6) AS mean_abs_diff, round((SELECT avg((provider = 'alpha_vantage')::INT) FROM prepared WHERE source_type = 'news'), 6) AS provider_share
         FROM scored s JOIN prepared p USING (document_id) LEFT JOIN (SELECT source_type, canonical_url, t, arg_max(score, pos) AS score FROM (SELECT source_type, canonical_url, score, pos, unnest(tickers) AS t FROM revs WHERE score IS NOT NULL) GROUP BY 1, 2, 3) e
           ON e.source_type = p.source_type AND e.canonical_url = p.canonical_url AND e.t = s.ticker""",
)
def diagnostics(spark, sf):
    docs = prepared(spark, sf)
    inputs = attributed_once(spark, sf, docs)
    sc = tx.scored(inputs, score_cache(inputs))
    d = se.attribution_diagnostics(sc, docs, se.weekly_sentiment(docs, sc, tickers(spark, sf), as_of()))
    return d.withColumn("mean_abs_diff", r(F.col("mean_abs_diff"))).withColumn("provider_share", r(F.col("provider_share")))


@query(
    "name_contamination",
    with_ctes("scored", "company_names")
    + """SELECT s.document_id, s.ticker, n.ticker AS other FROM scored s JOIN company_names n ON n.ticker <> s.ticker
         AND contains(lower(s.text), n.short) AND CASE WHEN contains(lower(s.text), n.short) THEN regexp_matches(s.text, '(?i)(^|[^\\p{L}\\p{N}_])' || n.short || '([^\\p{L}\\p{N}_]|$)') ELSE false END WHERE s.status = 'scored'""",
)
def contamination(spark, sf):
    inputs = attributed_once(spark, sf)
    sc = tx.scored(inputs, score_cache(inputs)).filter("status = 'scored'")
    return se.contaminated(sc, profiles.read_universe(standins.universe(spark, sf)))


@query(
    "preparation_manifest",
    with_ctes("screen", "prepared", "attributed")
    + """SELECT count(*) AS records, count(*) FILTER (reason = 'not_available_at_cutoff') AS not_available_at_cutoff, count(*) FILTER (reason = 'revision_after_cutoff') AS revision_after_cutoff,
         count(*) FILTER (reason = 'invalid_source_record') AS invalid_source_record, (SELECT count(*) FROM prepared) AS documents, (SELECT count(*) FROM attributed) AS sentiment_inputs,
         (SELECT count(*) FROM attributed WHERE text <> '') AS sentiment_pending FROM screen""",
)
def manifest(spark, sf):
    # records are screened once; documents are counted, chunked and attributed
    s = stored_table(screened(spark, sf))
    docs = cut_lineage(tx.syndicated(cut_lineage(tx.newest_revisions(s))))
    inputs = attributed_once(spark, sf, docs)
    m = tx.preparation_manifest(s, docs, tx.chunk_documents(docs), inputs)
    return m.drop("chunks", "chunk_tokens", "overlap_tokens")


@query(
    "article_snippets",
    """SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'),
         '[ \\t]+', ' ', 'g')), 1, 500) AS snippet FROM pages""",
)
def snippets(spark, sf):
    return standins.pages(spark, sf).select("page_id", tx.snippet(F.col("html")).alias("snippet"))


@query(
    "sentiment_gate",
    with_ctes("scored")
    + """SELECT kind, count(*) AS n FROM (SELECT left(sha256(document_id), 1) AS k, status = 'scored' AS done FROM scored) s
         JOIN (VALUES ('0', 'sentiment_parent', NULL), ('0', 'missing_sentiment_association', NULL), ('1', 'sentiment_provenance', NULL), ('2', 'sentiment_score', true), ('2', 'sentiment_probabilities', true),
                      ('3', 'sentiment_probabilities', true), ('4', 'missing_sentiment_not_null', false)) f(k, kind, needs) ON f.k = s.k AND (needs IS NULL OR needs = done) GROUP BY 1""",
)
def sentiment_gate(spark, sf):
    """Scores of all associations against their documents, with faults of every kind planted by a digit of the id's hash."""
    docs = prepared(spark, sf)
    inputs = attributed_once(spark, sf, docs)
    digit, done = F.left(sha(F.col("document_id")), F.lit(1)), F.col("status") == "scored"
    score = F.when((digit == "2") & done, 2.0).when((digit == "4") & ~done, 0.1).otherwise(F.col("score"))
    faulty = tx.scored(inputs, score_cache(inputs)).withColumns({
        "document_id": F.when(digit == "0", F.concat("document_id", F.lit(" none"))).otherwise(F.col("document_id")),
        "source_url": F.when(digit == "1", "none").otherwise(F.col("source_url")),
        "positive": F.when((digit == "3") & done, F.col("positive") + 0.5).otherwise(F.col("positive")),
        "score": score,
    })
    p = tx.sentiment_problems(faulty, docs)
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filing_coverage_check",
    with_ctes("raw_docs")
    + "SELECT DISTINCT document_id AS id FROM (SELECT document_id, doc_id, unnest(tickers) AS t FROM raw_docs WHERE source_type = 'sec') WHERE t = 'ZZZ' OR t IN ('B03', 'B07')",
)
def coverage_check(spark, sf):
    """Every document carries number 1; the coverage record of two tickers says 2 and one ticker has none."""
    docs = standins.documents(spark, sf).withColumn("cik", F.lit(1))
    record = tickers(spark, sf).select("ticker", F.when(F.col("ticker").isin("B03", "B07"), 2).otherwise(1).alias("cik"))
    return tx.coverage_problems(docs, record).select("id")
