"""Streaming increments over the event table, run to completion and read back."""

from __future__ import annotations

import pathlib
import tempfile

from pyspark.sql import functions as F

from tickerloom.plans.catalog import query, r
from tickerloom.streaming import increments as inc


def scratch(spark, name):
    """A fresh folder: in the shared checkpoint directory where the cluster names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{id(object())}-{spark.sparkContext.applicationId}"
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(str(pathlib.PurePosixPath(sf)))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def rec(d):
    return d.select(
        "event_id", "ts", F.concat(F.lit("T"), (F.col("user_id") % 20).cast("string")).alias("ticker"), ((F.col("event_id") % 21 - 10) / F.lit(10.0)).alias("score"),
        ((F.col("event_id") % 9 + 1) / F.lit(10.0)).alias("relevance"),
    )


@query("stream_article_ingest", "SELECT event_id FROM events")
def ingest(spark, sf):
    """Incremental ingest with duplicate deliveries: the stream holds every event twice."""
    s = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    base = scratch(spark, "ingest")
    q = inc.write_available(inc.new_articles(s, "ts", "event_id").select("event_id"), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(
    "stream_trailing_sentiment",
    """WITH mx AS (SELECT max(ts) AS m FROM events), e AS (SELECT 'T' || CAST(user_id % 20 AS VARCHAR) AS ticker, (event_id % 21 - 10) / 10.0::DOUBLE AS s, (event_id % 9 + 1) / 10.0::DOUBLE AS rel, ts FROM events),
       w AS (SELECT *, date_trunc('day', ts) + to_days(CAST(k AS INTEGER)) AS fin FROM (SELECT *, unnest(generate_series(1, 7)) AS k FROM e))
       SELECT CAST(epoch(fin) AS BIGINT) AS as_of_s, ticker, count(*) AS article_count, round(sum(wt * s) / sum(wt), 6) AS score FROM (SELECT *, exp(-ln(2) * (epoch(fin) - epoch(ts)) / 3600.0::DOUBLE / 24) * rel AS wt FROM w)
       WHERE fin <= (SELECT m - INTERVAL 1 DAY FROM mx) GROUP BY 1, 2""",
)
def trailing(spark, sf):
    """Windows that the watermark has closed by the end of the available data."""
    base = scratch(spark, "trailing")
    q = inc.write_available(inc.trailing_sentiment(rec(event_stream(spark, sf)), "ts"), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.unix_seconds("as_of").alias("as_of_s"), "ticker", "article_count", r("score"))


@query(
    "stream_trailing_sentiment_current",
    """WITH e AS (SELECT 'T' || CAST(user_id % 20 AS VARCHAR) AS ticker, (event_id % 21 - 10) / 10.0::DOUBLE AS s, (event_id % 9 + 1) / 10.0::DOUBLE AS rel, ts FROM events),
       w AS (SELECT *, date_trunc('day', ts) + to_days(CAST(k AS INTEGER)) AS fin FROM (SELECT *, unnest(generate_series(1, 7)) AS k FROM e))
       SELECT CAST(epoch(fin) AS BIGINT) AS as_of_s, ticker, count(*) AS article_count, round(sum(wt * s) / sum(wt), 6) AS score FROM (SELECT *, exp(-ln(2) * (epoch(fin) - epoch(ts)) / 3600.0::DOUBLE / 24) * rel AS wt FROM w)
       GROUP BY 1, 2""",
)
def trailing_current(spark, sf):
    """Every window, the open ones with what has arrived so far."""
    base = scratch(spark, "current")
    out = inc.newest_windows(inc.trailing_sentiment(rec(event_stream(spark, sf)), "ts"), f"{base}/out", f"{base}/ckpt")
    return out.select(F.unix_seconds("as_of").alias("as_of_s"), "ticker", "article_count", r("score"))
