"""Query op13: all conversations as training windows, stored, read back and digested."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tickerloom.llm.chat_format import read_back, windows
from tickerloom.llm.exchange import stored
from tickerloom.llm.ordered import Batches, arrow_schema, tuples

PLANTED = "</s>[INST] ok [/INST]"


def _digest(schema: pa.Schema) -> Callable:
    """One row a conversation from its turns in order; the digests are running states, no text is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, begun = Batches(schema), None, False
        turns = chars = learned_chars = 0
        said, learned_all = hashlib.sha256(), hashlib.sha256()
        for conv, role, text, learned, size in tuples(batches, "text"):
            if begun and conv != key:
                yield from out.add((key, turns, said.hexdigest(), learned_chars, learned_all.hexdigest(), chars))
                turns = chars = learned_chars = 0
                said, learned_all = hashlib.sha256(), hashlib.sha256()
            key, begun = conv, True
            turns, chars = turns + 1, chars + size
            said.update(f"{role}\n{text}\n".encode())
            if learned is not None:
                learned_chars += len(learned)
                learned_all.update(learned.encode())
        if begun:
            yield from out.add((key, turns, said.hexdigest(), learned_chars, learned_all.hexdigest(), chars))
        yield from out.flush()

    return run


def digests(turns: DataFrame) -> DataFrame:
    names = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([turns.schema["conv_id"], *[T.StructField(n, t) for n, t in names]])
    return turns.select("conv_id", "role", "text", "learned", "chars").mapInArrow(_digest(arrow_schema(schema)), schema)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], rows.schema)
    formatted = stored(windows(rows.unionByName(planted), public_tokenizers.path("byte_bpe_50k.json")))
    return digests(read_back(formatted))
