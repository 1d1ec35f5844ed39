"""The nightly work as Structured Streaming increments."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.functions.columns import ratio


def new_articles(stream: DataFrame, time: str, key: str, lateness: str = "3 days") -> DataFrame:
    """First arrival of each article inside the watermark; state is bounded by ``lateness``."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def trailing_sentiment(stream: DataFrame, time: str, lateness: str = "1 day", length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Relevance- and recency-weighted mean per ticker and trailing window, weights relative to its end.

    Rows need ticker, score, relevance and the event time.  Late rows beyond the watermark
    are dropped by the engine and reported in the query progress.
    """
    d = stream.withWatermark(time, lateness).withColumn("w", F.window(time, length, slide))
    age = (F.unix_micros("w.end") - F.unix_micros(time)) / F.lit(3.6e9)
    weight = F.exp(F.lit(-math.log(2)) * age / 24.0) * F.col("relevance")
    agg = d.withColumn("k", weight).groupBy("w", "ticker").agg(
        F.count(F.lit(1)).alias("article_count"), ratio(F.sum(F.col("k") * F.col("score")), F.nullif(F.sum("k"), F.lit(0.0))).alias("score")
    )
    return agg.select(F.col("w.end").alias("as_of"), "ticker", "article_count", "score")


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, then stop: the nightly trigger."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only file sink with exactly-once commits."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def embed_new(encode: Callable[[DataFrame], DataFrame], store: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: encode only chunks without a stored vector and append them.

    Appends go to a folder per batch id written with overwrite, so a replayed batch
    replaces its own output instead of doubling it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(f"{store}/batch=*").select("chunk_id")
            known = known.filter(~F.input_file_name().contains(f"/batch={batch_id}/"))
            missing = batch.join(known, "chunk_id", "left_anti")
        except Exception as error:  # no store yet: everything is new
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing = batch
        encode(missing.dropDuplicates(["chunk_id"])).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return handle


# --- keyed stores -----------------------------------------------------------------------
# A store is a folder of deltas, ``part=<p>/batch=<n>``: a batch writes its own rows into the parts it touches and rewrites nothing.  Of a key the
# row of the newest batch counts.  A replayed batch replaces its own folders; compaction merges the deltas of a part.

MOST_DELTAS = 8


def delta_writer(store: str, keys: list[str], part: Column, newest_by: str | None = None, most: int = MOST_DELTAS) -> Callable[[DataFrame, int], None]:
    """Batch handler: rows by ``keys`` into the folders of their ``part``; ``part`` must be a function of the keys.

    With ``newest_by`` a batch may hold several rows of a key; the one of the largest value counts.  Parts with more than ``most``
    deltas are compacted after the batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy(*keys).agg(F.max_by(F.struct("*"), newest_by).alias("s")).select("s.*") if newest_by else batch
        rows = rows.withColumns({"part": part, "batch": F.lit(batch_id).cast("long")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(store)
        compact(batch.sparkSession, store, keys, most)

    return handle


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def deltas(spark: SparkSession, store: str) -> dict[str, list[int]]:
    """The batches of each part, from folder names only: as many entries as parts and uncompacted batches."""
    system, root = _folder(spark, store)
    out: dict[str, list[int]] = {}
    for f in system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "part=*/batch=*")) or ():
        out.setdefault(f.getPath().getParent().getName().removeprefix("part="), []).append(int(f.getPath().getName().removeprefix("batch=")))
    return {k: sorted(v) for k, v in out.items()}


def read_newest(spark: SparkSession, store: str, keys: list[str], parts: list[str] | None = None) -> DataFrame:
    """The rows of a store, or of some of its parts; the newest batch of each key counts."""
    found = spark.read.option("basePath", store).parquet(*([f"{store}/part={p}" for p in parts] if parts else [store]))
    fields = [c for c in found.columns if c not in ("part", "batch")]
    return found.groupBy("part", *keys).agg(F.max_by(F.struct(*fields, "batch"), "batch").alias("s")).select("s.*", "part")


def compact(spark: SparkSession, store: str, keys: list[str], most: int = MOST_DELTAS) -> list[str]:
    """Merges the deltas of parts that have more than ``most`` into their newest one; returns those parts.

    The merged rows replace the newest delta first and the older ones go afterwards.  Between the two steps readers see the same rows, and
    a run that stops there is finished by the next.
    """
    crowded = {p: b for p, b in deltas(spark, store).items() if len(b) > most}
    if crowded:
        merged = read_newest(spark, store, keys, sorted(crowded)).drop("batch")
        last = F.create_map(*[F.lit(x) for p, b in crowded.items() for x in (p, b[-1])])
        merged = merged.withColumn("batch", last[F.coalesce(F.col("part").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))].cast("long"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(store)
        for p, batches in crowded.items():
            for b in batches[:-1]:
                system, path = _folder(spark, f"{store}/part={p}/batch={b}")
                system.delete(path, True)
    return sorted(crowded)


SNAPSHOT_KEYS, WINDOW_KEYS = ["ticker", "risk_profile"], ["as_of", "ticker"]
SNAPSHOT_PARTS = 16


def upsert_snapshots(store: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: refreshed snapshots by (ticker, risk_profile), in parts by hash of the ticker."""
    return delta_writer(store, SNAPSHOT_KEYS, F.pmod(F.xxhash64("ticker"), F.lit(SNAPSHOT_PARTS)), "as_of")


def upsert_windows(store: str) -> Callable[[DataFrame, int], None]:
    """Batch handler of update mode: newest values by (as_of, ticker), open windows too, in parts by day."""
    return delta_writer(store, WINDOW_KEYS, F.to_date("as_of"))


def newest_windows(stream: DataFrame, store: str, checkpoint: str) -> DataFrame:
    """All windows of the trailing stream after everything that has arrived, also those the watermark has not closed."""
    q = run_available(stream, checkpoint, upsert_windows(store), mode="update")
    q.awaitTermination()
    if not deltas(stream.sparkSession, store):
        return stream.sparkSession.createDataFrame([], stream.schema)
    return read_newest(stream.sparkSession, store, WINDOW_KEYS).select(*stream.columns)
