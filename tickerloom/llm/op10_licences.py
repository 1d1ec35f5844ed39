"""Query op10: licence families of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import licences


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licences.scan(docs, licences.train(docs))
