"""Query op8: suffix-array deduplication of all documents over strings of 50 bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.suffixes import deduplicate


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
