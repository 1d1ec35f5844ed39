"""Query op6: substring deduplication of all documents over windows of 20 words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.substrings import deduplicate


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, unnest(range(1, len(w) - 18)) as p, w from d where len(w) >= 20
), keyed as (
  select doc_id, p, array_to_string(w[p:p + 19], ' ') as s from win
), late as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as r from keyed) where r > 1
), gone as (
  select distinct doc_id, unnest(range(p, p + 20)) as i from late
), each as (
  select d.doc_id, i, w[i] as word from d, unnest(range(1, len(w) + 1)) as t(i)
), left_over as (
  select e.doc_id, count(*) as n, string_agg(e.word, ' ' order by e.i) as kept
  from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i where g.i is null group by e.doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (doc_id)
"""
