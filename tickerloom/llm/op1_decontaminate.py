"""Query op1: every document against every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.decontaminate import contaminated


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items)


_SHINGLES = """
  case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
       when len(w) > 0 then [array_to_string(w, ' ')] else [] end
"""

ORACLE = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), t as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark
), ds as (
  select doc_id, unnest({_SHINGLES}) as s from d
), ts as (
  select item_id, {_SHINGLES} as ss from t
), tl as (
  select item_id, len(ss) as n, unnest(ss) as s from ts
)
select doc_id, item_id, cast(n as bigint) as item_shingles, count(*) as found, count(*) / n as containment
from ds join tl using (s) group by doc_id, item_id, n having count(*) >= 0.8::double * n
"""
