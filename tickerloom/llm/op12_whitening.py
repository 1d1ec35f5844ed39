"""Query op12: all embeddings, whitened by the components of their distinct vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.whitening import fit, whiten, whole


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole(F.col("embedding")).alias("x"))
    return whiten(vectors, fit(vectors))
