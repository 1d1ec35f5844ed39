"""Query op11: all conversations, damaged by a fixed rule, with the cheapest repair of their structure."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm.exchange import stored
from tickerloom.llm.ordered import Batches, arrow_schema, tuples
from tickerloom.llm.turn_repair import RESULT, audits, plain, repaired


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 names; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = plain(conversations).withColumn("_kind", kind).filter("_kind <> 0")
    said = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": said, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_copy", copies).select("conv_id", "turn", "role", "text")


def _digest(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, said = Batches(schema), None, None
        for conv, role, text in tuples(batches, "text"):
            if said is None or conv != key:
                if said is not None:
                    yield from out.add((key, said.hexdigest()))
                key, said = conv, hashlib.sha256()
            else:
                said.update(b"\n")
            said.update(f"{role}:{text}".encode())
        if said is not None:
            yield from out.add((key, said.hexdigest()))
        yield from out.flush()

    return run


def digests(turns: DataFrame) -> DataFrame:
    """(c, sha): sha256 of the newline-joined ``role:text`` of each conversation, as a running state over sorted rows."""
    schema = T.StructType([T.StructField("c", turns.schema["conv_id"].dataType), T.StructField("sha", T.StringType())])
    return turns.select("conv_id", "role", "text").mapInArrow(_digest(arrow_schema(schema)), schema)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = damaged(conversations)
    found = stored(audits(turns))
    shas = digests(repaired(turns, found))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    all_of = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(shas, F.col("id").eqNullSafe(F.col("c")), "left")
    nothing = {"sha": hashlib.sha256().hexdigest(), "audit": ""}
    value = lambda n: F.coalesce(F.col(n), F.lit(nothing.get(n, 0)))
    known = F.col("audit").isNull()  # no turns are left
    gaps = F.when(known, F.lit(0)).otherwise(F.col("gaps")).cast("long")
    return all_of.select(F.col("id").alias("conv_id"), gaps.alias("gaps"), *[value(n).alias(n) for n, _ in RESULT[1:]], value("sha").alias("repaired_sha256"))
