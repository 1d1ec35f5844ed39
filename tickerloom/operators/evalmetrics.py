"""Quality of retrieval and of generated explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.columns import one_spaced, ratio

# --- fixed values -----------------------------------------------------------------------
KS = (1, 3, 5)
RELEVANT = 0.5
ENTAILED = 0.5
SENTENCE_END = r"(?<=[.!?…])\s+|\n"


def production_queries(profiles: DataFrame, topical: DataFrame | None = None) -> DataFrame:
    """The two templates per eligible asset, and topical questions of known tickers."""
    kinds = F.array(
        F.struct(F.lit("production-news").alias("kind"), F.lit("news").alias("source"), F.lit(" latest news and developments").alias("tail")),
        F.struct(F.lit("production-sec").alias("kind"), F.lit("sec").alias("source"), F.lit(" business risks and financial results").alias("tail")),
    )
    d = profiles.filter("recommendation_eligible").select("ticker", "name", F.explode(kinds).alias("k"))
    out = d.select("ticker", F.col("k.kind").alias("kind"), F.col("k.source").alias("source_type"), F.concat("name", "k.tail").alias("query"))
    if topical is None:
        return out
    return out.unionByName(topical.join(profiles.select("ticker"), "ticker", "left_semi").select(*out.columns))


def query_metrics(ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """precision, recall and context relevance at 1, 3, 5 per query.

    ``ranked``: query_id, item, rank from 0; ``pool``: query_id, item, score.
    """
    per_pool = pool.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("pool"), F.count_if(F.col("score") >= RELEVANT).alias("relevant_in_pool")
    )
    j = ranked.join(pool, ["query_id", "item"], "left")
    good = F.coalesce(F.col("score") >= RELEVANT, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("retrieved")]
    for k in KS:
        head = F.col("rank") < k
        aggs += [F.count_if(head & good).alias(f"_hit{k}"), F.avg(F.when(head, F.col("score"))).alias(f"context_relevance_{k}")]
    found = per_pool.join(j.groupBy("query_id").agg(*aggs), "query_id", "left")
    zero = F.lit(0).cast("bigint")
    hits = {k: F.coalesce(F.col(f"_hit{k}"), zero) for k in KS}
    return found.select(
        "query_id", "pool", "relevant_in_pool", F.coalesce("retrieved", zero).alias("retrieved"),
        *[(hits[k] / k).alias(f"precision_{k}") for k in KS],
        *[ratio(hits[k].cast("double"), F.nullif(F.col("relevant_in_pool"), F.lit(0))).alias(f"recall_{k}") for k in KS],
        *[f"context_relevance_{k}" for k in KS],
    )


def metrics_by_kind(metrics: DataFrame) -> DataFrame:
    """Means per kind and over all; nulls are skipped."""
    names = [f"{m}_{k}" for k in KS for m in ("precision", "recall", "context_relevance")]
    d = metrics.rollup("kind").agg(F.count(F.lit(1)).alias("queries"), *[F.bround(F.avg(n), 4).alias(n) for n in names], F.grouping("kind").alias("_g"))
    return d.withColumn("kind", F.when(F.col("_g") == 1, "all").otherwise(F.col("kind"))).drop("_g")


def sentence_list(text: Column) -> Column:
    """Trimmed sentences of at least three words."""
    parts = F.transform(F.split(text, SENTENCE_END), F.trim)
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 3)


def claims(text: Column) -> Column:
    """Claim sentences of an explanation, scaffolding left out."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    body = F.filter(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda x: (x != "") & ~x.endswith(":") & ~x.rlike(r"^\[\d+\]") & ~x.startswith("No recent news or filing evidence") & ~x.startswith("- Note:"),
    )
    bare = F.transform(body, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[-•* ]+", ""), r"^[“”\"]+|[“”\"]+$", "")))
    return F.flatten(F.transform(bare, sentence_list))


def context_passages(evidence: Column, trace: Column) -> Column:
    """Evidence and trace passages plus their sentences, first occurrences in order."""
    quoted = F.transform(evidence, lambda e: F.trim(F.concat(F.coalesce(e["title"], F.lit("")), F.lit(". "), F.coalesce(e["snippet"], F.lit("")))))
    passages = F.filter(F.concat(quoted, trace), lambda p: p != "")
    return F.array_distinct(F.concat(passages, F.flatten(F.transform(passages, sentence_list))))


def faithfulness(answers: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Share of claims found verbatim in a passage or judged entailed, with the unsupported ones in order.

    ``answers``: answer_id, claims, passages.  ``judged``: answer_id, claim, entailment (the
    best score over passages), from a model's output table.  An answer without claims has 0 claims and no share.
    """
    rows = answers.select("answer_id", "passages", F.posexplode_outer("claims").alias("pos", "claim"))
    verbatim = F.coalesce(F.exists("passages", lambda p: F.contains(one_spaced(p), one_spaced(F.col("claim")))), F.lit(False))
    d = rows.select("answer_id", "pos", "claim", verbatim.alias("ok"))
    if judged is not None:
        d = d.join(judged, ["answer_id", "claim"], "left").withColumn("ok", F.col("ok") | F.coalesce(F.col("entailment") >= ENTAILED, F.lit(False)))
    missed = F.collect_list(F.when(~F.col("ok") & F.col("claim").isNotNull(), F.struct("pos", "claim")))
    per = d.groupBy("answer_id").agg(
        F.count("claim").alias("claims"),
        F.avg(F.when(F.col("claim").isNotNull(), F.col("ok").cast("double"))).alias("faithfulness"),
        F.transform(F.sort_array(missed), lambda x: x["claim"]).alias("unsupported"),
    )
    return per


def faithfulness_summary(per_answer: DataFrame) -> DataFrame:
    f = F.col("faithfulness")
    return per_answer.agg(
        F.count(F.lit(1)).alias("explanations"),
        F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"),
        F.bround(F.avg(f), 4).alias("faithfulness"),
        F.bround(F.avg(F.when(f.isNotNull(), (f == 1.0).cast("double"))), 4).alias("fully_faithful_share"),
    )
