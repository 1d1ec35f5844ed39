"""Query op4: all documents as token-id files, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.token_files import read_tokens, write_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)
    return read_tokens(segments).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
