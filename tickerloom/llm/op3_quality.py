"""Query op3: quality scores of all documents by a factorisation machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import quality_fm
from tickerloom.llm.labelled import fold

THRESHOLD = 0.3


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality_fm.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    scored = quality_fm.score(docs, machine)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
