"""Query op9: components of documents with similar shingle sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.jaccard_join import components


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end as ss from d
), each as (
  select doc_id, len(ss) as n, unnest(ss) as s from sets
), link as (
  select a.doc_id as x, b.doc_id as y from each a join each b on a.s = b.s and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select doc_id as x, doc_id as y from sets union select r.x, l.y from reach r join link l on r.y = l.x
)
select s.doc_id, cast(len(ss) as bigint) as n_shingles, (select min(y) from reach r where r.x = s.doc_id) as component_id from sets s
"""
