"""The corpus pipeline: five stages over ``documents``, each written and read back before the next.

1. quality: the factorisation machine scores every text; documents it rejects go.
2. near_duplicates: n-gram Jaccard components; of each group one row stays, of the smallest id (a null id is the largest).
3. repeated_strings: every byte covered by a 50-byte string of an earlier document goes.
4. decontamination: documents that hold a benchmark item go.
5. tokens: byte-level BPE, encoded and decoded.

Stages 1 to 4 return the columns of ``documents``; stage 5 returns (doc_id, n_tokens, ids_sha256,
decoded_sha256).  Stages 2 and 4 decide by id and text, so rows of one id or without an id have decisions of their
own.  Each works on all rows its predecessor kept.  The first stage is a trained model, so SQL
cannot give the rows; the tests hold every stage against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import bpe, decontaminate, jaccard_join, quality_fm, suffixes
from tickerloom.llm.exchange import settled
from tickerloom.llm.labelled import fold
from tickerloom.llm.op2_bpe import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_THRESHOLD = 0.3
BATCH_BYTES = 4 << 20


def in_small_batches(stage: Callable) -> Callable:
    """The stage with Arrow batches of ``BATCH_BYTES``: a batch is held on both sides of each worker, so batches of 64 MB take an executor's memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least the threshold; the score is made beside the row, so nothing is joined."""
    machine = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    return quality_fm.accepted(docs.select(*COLUMNS), machine, QUALITY_THRESHOLD)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``_key``, a number of their id and text."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of the smallest id in it; rows with no words stay."""
    rows = keyed(docs)

    def grouped() -> DataFrame:
        groups = jaccard_join.components(rows, doc_id="_key").filter("n_shingles > 0")
        return groups.select(F.col("doc_id").alias("_key"), "component_id").distinct()

    members = settled(spark, grouped)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")
    firsts = members.join(rows.select("_key", "doc_id").distinct(), "_key").groupBy("component_id").agg(F.min(order).alias("first")).select("first._key")
    one = rows.join(firsts, "_key").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return one.unionByName(rows.join(members, "_key", "left_anti").select(*COLUMNS))


@in_small_batches
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; a character that a cut leaves incomplete goes with it."""

    def cut() -> DataFrame:
        changed = suffixes.deduplicate(docs, as_text=True).filter("n_removed > 0")
        return changed.select(F.col("doc_id").alias("id"), "text_md5", "kept").dropDuplicates(["id", "text_md5"])

    done = settled(spark, cut)
    rest = docs.select(*COLUMNS).join(done, F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5(F.col("text").cast("binary")) == F.col("text_md5")), "left")
    length = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return rest.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source", length.alias("n_chars"))


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    rows = keyed(docs)
    found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="_key")
    return rows.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*COLUMNS)


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode_and_decode(docs, VOCABULARY)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every result but the last is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir))
    docs = STAGES[-1][1](spark, docs, sf_dir)
    return docs
