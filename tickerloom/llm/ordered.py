"""Order inside long keys: positions and running sums without one task a key, and sorted streams of a key's rows.

``running`` deals rows by range of (key, order), so a key with a third of all rows is spread over many tasks.  Only the
first key of a partition can have begun in an earlier one: what lies before is at most one row a partition, which is
small whatever the data, and is broadcast under that bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm import arrays as A
from tickerloom.llm.exchange import buckets, stored

FLUSH_ROWS, FLUSH_BYTES = 4096, 4 << 20


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Batches:
    """Collects output rows and hands them on as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= FLUSH_ROWS or self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


def tuples(batches: Iterator[pa.RecordBatch], text: str | None = None) -> Iterator[tuple]:
    """The rows of record batches as tuples, a few MB at a time; ``text`` names the column that decides the size."""
    for batch in batches:
        for part in A.slices(batch, text) if text else (batch,):
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _within(weight: int, first: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key, place, total, begun, opening = None, 0, 0, False, True
        for batch in batches:
            keys, weights = batch.column(first).to_pylist(), batch.column(weight).to_pylist()
            positions, before, openings = [], [], []
            for k, w in zip(keys, weights, strict=True):
                if not begun or k != key:
                    opening = not begun
                    key, place, total, begun = k, 0, 0, True
                positions.append(place)
                before.append(total)
                openings.append(opening)
                place, total = place + 1, total + w
            extra = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(openings, pa.bool_()), pa.array(positions, pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "_part", "_opening", "_position", "_before"])

    return run


def running(rows: DataFrame, key: str, order: list[Column], weight: str, weigh: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows, stored, with ``position`` (0, 1, ...) and ``before`` (sum of ``weight`` over earlier rows) inside their key.

    ``weigh`` may add a costly weight row by row; it runs once, on the dealt rows, not again for the samples that find the ranges.
    Rows equal in ``key`` and ``order`` stand in any order: they are spread over partitions by a number of their own.  Null keys are one key.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(key).asc_nulls_first(), *order, F.col("_row")]
    dealt = dealt.repartitionByRange(buckets(rows.sparkSession), *by).sortWithinPartitions(*by).drop("_row")
    dealt = weigh(dealt) if weigh else dealt
    schema = T.StructType([*dealt.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_opening", T.BooleanType()), T.StructField("_position", T.LongType()), T.StructField("_before", T.LongType())])
    local = stored(dealt.mapInArrow(_within(dealt.columns.index(weight), dealt.columns.index(key)), schema))
    ended = local.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), F.max("_opening").alias("opening"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = ended.select("_part", "opening", F.sum("n").over(earlier).alias("_n"), F.sum("w").over(earlier).alias("_w"))
    begun = begun.filter("opening and _n is not null").select("_part", F.lit(True).alias("_opening"), "_n", "_w")  # one row a partition at most
    met = local.join(F.broadcast(begun), ["_part", "_opening"], "left")
    place = lambda own, add: F.col(own) + F.coalesce(F.col(add), F.lit(0))
    return met.select(*dealt.columns, place("_position", "_n").alias("position"), place("_before", "_w").alias("before"))
