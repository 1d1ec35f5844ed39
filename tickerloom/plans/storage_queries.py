"""Merges, verification, retrieval and generation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import evalmetrics as em
from tickerloom.operators import profiles
from tickerloom.operators import storage as st
from tickerloom.plans.catalog import query, r
from tickerloom.plans.evidence_queries import evidence_chunks, search_queries
from tickerloom.plans.sqlbase import cte, with_ctes
from tickerloom.sources import standins


def sides(spark, sf):
    o = standins.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    existing = o.filter("o_orderstatus <> 'P'")
    incoming = o.filter("o_orderstatus <> 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("o_custkey", F.col("o_custkey") + 1000000)
    return existing, incoming


@query(
    "upsert_counts",
    "SELECT count(*) FILTER (o_orderstatus = 'P') AS inserted, count(*) FILTER (o_orderstatus = 'O') AS updated, count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders",
)
def upsert_counts(spark, sf):
    return st.change_counts(st.upsert(*sides(spark, sf), ["o_orderkey"]))


@query(
    "upsert_rows",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders""",
)
def upsert_rows(spark, sf):
    """The customer key plays the completion time that stays once set."""
    return st.upsert(*sides(spark, sf), ["o_orderkey"], keep_first=["o_custkey"]).select("o_orderkey", "o_totalprice", "o_custkey")


@query(
    "batch_import_status",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'new' WHEN 'O' THEN 'already_imported' ELSE 'conflict' END AS status FROM orders",
)
def batch_status(spark, sf):
    o = standins.table(spark, sf, "orders")
    batch = o.select(F.lit("m").alias("model"), F.col("o_orderkey").alias("generated_at"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("source_sha256"))
    stored = o.filter("o_orderstatus <> 'P'").select(
        F.lit("m").alias("model"), F.col("o_orderkey").alias("generated_at"),
        F.sha2(F.when(F.col("o_orderstatus") == "F", F.lit("other")).otherwise(F.col("o_totalprice").cast("string")), 256).alias("source_sha256"),
    )
    return st.new_batches(batch, stored).select(F.col("generated_at").alias("o_orderkey"), "status")


@query(
    "table_verification",
    "SELECT 'missing' AS side, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders UNION ALL SELECT 'extra', count(*) FILTER (o_orderstatus = 'P') FROM orders",
)
def verification(spark, sf):
    """A copy with changed pending rows against the original, whole rows compared."""
    o = standins.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    copy = o.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return st.content_differences(o, copy)


@query(
    "lossless_conversion",
    """SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 1000 <> 0 THEN 'sub_microsecond' END, CASE WHEN user_id * 43200000 % 86400000 <> 0 THEN 'date_not_midnight' END,
         CASE WHEN value > 400 THEN 'int64_overflow' END, CASE WHEN event_type = 'error' THEN 'nul_in_text' END], lambda x: x IS NOT NULL)) AS kind FROM events) GROUP BY 1""",
)
def lossless(spark, sf):
    e = standins.events(spark, sf).select(
        F.col("event_id").alias("id"), F.col("event_id").alias("nanos"), (F.col("user_id") * 43200000).alias("day_ms"),
        F.when(F.col("value") > 400, F.lit("18446744073709551615").cast("decimal(20,0)")).otherwise(F.lit(1).cast("decimal(20,0)")).alias("number"),
        F.when(F.col("event_type") == "error", F.lit("a\x00b")).otherwise(F.lit("ab")).alias("text"),
    )
    return st.lossy_values(e, "nanos", "day_ms", "number", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_check", "SELECT 'src1' AS dataset, 'row_count' AS kind FROM (SELECT count(*) AS n FROM documents WHERE source = 'src1') WHERE n > 0")
def manifest_check(spark, sf):
    d = standins.table(spark, sf, "documents")
    counts = d.groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
    hashes = d.groupBy(F.col("source").alias("dataset")).agg(F.sha2(F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).cast("string"), 256).alias("sha256"))
    declared = counts.join(hashes, "dataset").withColumn("rows", F.when(F.col("dataset") == "src1", F.col("rows") + 1).otherwise(F.col("rows")))
    return st.manifest_problems(declared, counts, hashes)


@query(
    "snapshot_identity",
    """SELECT 'ss_' || left(sha256(string_agg(rh, '' ORDER BY r)), 20) AS version FROM (SELECT left(h, 2) AS r, sha256(string_agg(h, '' ORDER BY h)) AS rh
       FROM (SELECT sha256(doc_id || ':' || sha256(text)) AS h FROM documents) GROUP BY 1)""",
)
def identity(spark, sf):
    d = standins.table(spark, sf, "documents")
    return st.snapshot_identity(d.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")))


@query("numbered_import", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS source_row FROM orders")
def numbered(spark, sf):
    o = standins.table(spark, sf, "orders").select("o_orderkey", F.struct(F.to_date("o_orderdate"), F.col("o_orderkey")).alias("at"), F.trunc("o_orderdate", "month").alias("month"))
    return st.numbered_rows(o, "all", "at", F.col("month")).select("o_orderkey", "source_row")


@query(
    "forecast_item_constraints",
    """SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'interval_not_ordered' END, CASE WHEN l_tax > 0.06 THEN 'width_mismatch' END, CASE WHEN l_linenumber > 6 THEN 'calibration_after_origin' END], lambda x: x IS NOT NULL)) AS kind FROM lineitem) GROUP BY 1""",
)
def constraints(spark, sf):
    lo, hi = F.lit(-0.08), F.lit(0.08)
    d = standins.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ticker"), F.col("l_discount").alias("predicted_return_10d"), lo.alias("lower_return"), hi.alias("upper_return"),
        (F.when(F.col("l_tax") > 0.06, 17.0).otherwise(100 * (hi - lo))).alias("uncertainty_width_pp"), F.lit("2000-01-10").cast("date").alias("date"),
        F.when(F.col("l_linenumber") > 6, F.lit("2000-01-10")).otherwise(F.lit("2000-01-01")).cast("date").alias("calibration_latest_outcome"),
    )
    return st.forecast_item_problems(d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "batch_consistency",
    "SELECT count(DISTINCT o_orderstatus) AS models, 1::BIGINT AS coverages, count(DISTINCT o_orderpriority) AS stamps, count(*) - count(DISTINCT o_custkey) AS repeated_tickers, count(*) FILTER (o_orderdate > TIMESTAMP '2001-07-01') AS future_origins, false AS consistent FROM orders",
)
def consistency(spark, sf):
    d = standins.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("model"), F.lit(0.9).alias("nominal_coverage"), F.col("o_orderpriority").alias("generated_at"), F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")
    )
    return st.batch_consistency(d, F.lit("2001-07-01").cast("date"))


# --- retrieval metrics ------------------------------------------------------------------------


def judged_pool(spark, sf):
    """Judge scores of each query's candidate pool, from the document number."""
    from tickerloom.operators.retrieval import candidates

    q = search_queries(spark, sf)
    c = candidates(q, evidence_chunks(spark, sf).select("chunk_id", "tickers", "published", "source_type", "ingest_seq"))
    return q, c.select("query_id", F.col("chunk_id").alias("item"), ((F.col("ingest_seq") % 7) / F.lit(6.0)).alias("score"), "ingest_seq")


cte("pool", ["pairs_asked"], "SELECT query_id, document_id, doc_id, (doc_id % 7) / 6.0::DOUBLE AS score FROM pairs_asked")
cte(
    "rag",
    ["pool"],
    """
    WITH rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 11, doc_id) - 1 AS rank FROM pool QUALIFY rank < 5),
    h AS (SELECT query_id, count(*) AS n, count(*) FILTER (rank < 1 AND score >= 0.5) AS h1, count(*) FILTER (rank < 3 AND score >= 0.5) AS h3, count(*) FILTER (score >= 0.5) AS h5, avg(score) FILTER (rank < 3) AS c3 FROM rk GROUP BY 1),
    p AS (SELECT query_id, count(*) AS pool, count(*) FILTER (score >= 0.5) AS rel FROM pool GROUP BY 1)
    SELECT query_id, split_part(query_id, ':', 2) AS kind, pool, rel, n, h1 / 1.0::DOUBLE AS p1, h3 / 3.0::DOUBLE AS p3, h5 / 5.0::DOUBLE AS p5, h3 / nullif(rel, 0)::DOUBLE AS r3, h5 / nullif(rel, 0)::DOUBLE AS r5, c3 FROM p JOIN h USING (query_id)""",
)


def metrics(spark, sf):
    from pyspark.sql import Window

    _, pool = judged_pool(spark, sf)
    w = Window.partitionBy("query_id").orderBy(F.col("ingest_seq") % 11, "ingest_seq")
    ranked = pool.withColumn("rank", F.row_number().over(w) - 1).filter("rank < 5").select("query_id", "item", "rank")
    return em.query_metrics(ranked, pool.select("query_id", "item", "score"))


@query(
    "retrieval_metrics",
    with_ctes("rag") + "SELECT query_id, pool, rel AS relevant_in_pool, n AS retrieved, round(p1, 6) AS precision_1, round(p3, 6) AS precision_3, round(p5, 6) AS precision_5, round(r3, 6) AS recall_3, round(r5, 6) AS recall_5, round(c3, 6) AS context_relevance_3 FROM rag",
)
def retrieval_metrics(spark, sf):
    m = metrics(spark, sf)
    return m.select("query_id", "pool", "relevant_in_pool", "retrieved", *[r(n) for n in ("precision_1", "precision_3", "precision_5", "recall_3", "recall_5", "context_relevance_3")])


@query(
    "retrieval_metrics_by_kind",
    with_ctes("rag") + "SELECT coalesce(kind, 'all') AS kind, count(*) AS queries, round(avg(p3), 3) AS precision_3, round(avg(r5), 3) AS recall_5 FROM rag GROUP BY ROLLUP (kind)",
)
def by_kind(spark, sf):
    m = metrics(spark, sf).withColumn("kind", F.substring_index("query_id", ":", -1))
    return em.metrics_by_kind(m.select("kind", *[c for c in m.columns if c[-1].isdigit()])).select("kind", "queries", r("precision_3", 3), r("recall_5", 3))


@query(
    "evaluation_queries",
    with_ctes("assets") + "SELECT ticker, 'production-' || k AS kind, k AS source_type, name || CASE k WHEN 'news' THEN ' latest news and developments' ELSE ' business risks and financial results' END AS query FROM assets, (VALUES ('news'), ('sec')) t(k) WHERE rec",
)
def evaluation_queries(spark, sf):
    return em.production_queries(profiles.read_universe(standins.universe(spark, sf)))


_SENT = "list_filter(list_transform(string_split(regexp_replace(replace({t}, chr(10), chr(1)), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: len(list_filter(string_split(s, ' '), lambda w: w <> '')) >= 3)"
cte(
    "turns",
    [],
    "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations",
)


@query(
    "claim_split",
    f"SELECT conv_id, turn, len({_SENT.format(t='text')})::BIGINT AS sentences FROM conversations",
)
def claim_split(spark, sf):
    t = standins.table(spark, sf, "conversations")
    headed = F.concat(F.lit("Headline\n[1] cited\nWhy this signal:\n"), F.col("text"))
    return t.select("conv_id", "turn", F.size(em.sentence_list(F.col("text"))).cast("bigint").alias("sentences"), em.claims(headed).alias("_c")).drop("_c")


@query(
    "explanation_faithfulness",
    f"""SELECT conv_id || ':' || turn AS answer_id, len(cl)::BIGINT AS claims, round(len(list_filter(cl, lambda c: contains(txt, c))) / len(cl)::DOUBLE, 6) AS faithfulness FROM (
          SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS txt, list_concat(list_transform({_SENT.format(t='text')}, lambda s: regexp_replace(s, '\\s+', ' ', 'g')), ['Revenue tripled overnight without cause.']) AS cl FROM conversations)""",
)
def faithful(spark, sf):
    """Each turn's sentences plus one fabricated claim, checked against the turn itself."""
    t = standins.table(spark, sf, "conversations")
    claims = F.concat(em.sentence_list(F.col("text")), F.array(F.lit("Revenue tripled overnight without cause.")))
    a = t.select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), claims.alias("claims"), F.array("text").alias("passages"))
    return em.faithfulness(a).select("answer_id", "claims", r("faithfulness"))


# --- explanations taken apart ------------------------------------------------------------

cte(
    "told",
    [],
    f"""SELECT conv_id, turn, list_concat(list_concat(['turn ' || turn || ' of this conversation'], sents), ['This was made up for turn ' || turn || '.']) AS cl, sents FROM (SELECT conv_id, turn, {_SENT.format(t='text')} AS sents FROM conversations)""",
)


def told(spark, sf):
    """An explanation for each conversation turn: headline, trace, a quote of the turn, and a claim without ground.

    Turns of even number carry their text as evidence, the others none.
    """
    turn = F.col("turn").cast("string")
    trace = F.concat(F.lit("turn "), turn, F.lit(" of this conversation"))
    parts = [F.lit("Monitor — keep on your radar."), F.lit("Why this signal:"), F.concat(F.lit("- "), trace), F.lit("Supporting evidence:"), F.concat(F.lit("[1] "), "role", F.lit(" — news")),
             F.concat(F.lit("    “"), "text", F.lit("”")), F.lit("No recent news or filing evidence was found."), F.concat(F.lit("- This was made up for turn "), turn, F.lit("."))]
    item = F.struct(F.col("role").alias("title"), F.col("text").alias("snippet"))
    return standins.table(spark, sf, "conversations").select(
        "conv_id", "turn", em.claims(F.concat_ws("\n", *parts)).alias("claims"), F.filter(F.array(item), lambda x: F.col("turn") % 2 == 0).alias("evidence"), F.array(trace).alias("trace")
    )


@query(
    "explanation_claims",
    with_ctes("told") + "SELECT conv_id, turn, unnest(range(len(cl))) AS pos, sha256(unnest(cl)) AS claim_hash FROM told",
)
def explanation_claims(spark, sf):
    """Every claim of every explanation; headline, headings, citations and notes are none."""
    c = told(spark, sf).select("conv_id", "turn", F.posexplode("claims").alias("pos", "claim"))
    return c.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.sha2("claim", 256).alias("claim_hash"))


def judged_answers(spark, sf):
    """Faithfulness with a judge that entails the made-up claim on every third turn, denies it on the next and is silent on the last."""
    t = told(spark, sf).withColumn("answer_id", F.concat_ws(":", "conv_id", "turn"))
    verdict = F.when(F.col("turn") % 3 == 0, 0.9).otherwise(0.1).alias("entailment")
    judged = t.filter(F.col("turn") % 3 != 2).select("answer_id", F.concat(F.lit("This was made up for turn "), F.col("turn").cast("string"), F.lit(".")).alias("claim"), verdict)
    return em.faithfulness(t.select("answer_id", "claims", em.context_passages(F.col("evidence"), F.col("trace")).alias("passages")), judged)


_JUDGED = """, per AS (SELECT conv_id || ':' || turn AS answer_id, len(cl)::BIGINT AS claims,
         list_concat(CASE WHEN turn % 2 = 0 THEN [] ELSE sents END, CASE WHEN turn % 3 = 0 THEN [] ELSE [cl[-1]] END) AS missed FROM told),
       share AS (SELECT *, 1 - len(missed) / claims::DOUBLE AS faithful FROM per) """


@query(
    "explanation_faithfulness_judged",
    with_ctes("told") + _JUDGED + "SELECT answer_id, claims, round(faithful, 6) AS faithfulness, len(missed)::BIGINT AS unsupported, sha256(array_to_string(missed, chr(10))) AS unsupported_hash FROM share",
)
def explanation_faithfulness_judged(spark, sf):
    d = judged_answers(spark, sf)
    return d.select("answer_id", "claims", r("faithfulness"), F.size("unsupported").cast("bigint").alias("unsupported"), F.sha2(F.array_join("unsupported", "\n"), 256).alias("unsupported_hash"))


@query(
    "faithfulness_summary",
    with_ctes("told") + _JUDGED + "SELECT count(*) AS explanations, sum(claims)::BIGINT AS claims, round(avg(faithful), 4) AS faithfulness, round(avg((faithful = 1)::INT), 4) AS fully_faithful_share FROM share",
)
def faithfulness_summary(spark, sf):
    return em.faithfulness_summary(judged_answers(spark, sf))
