"""Query op7: base quality rules and the calibrated n-gram verdict for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import quality_rules
from tickerloom.llm.labelled import fold


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, quality_rules.train(docs, labels, fold(F.col("doc_id"), 5) != 0))
