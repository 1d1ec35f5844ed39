"""Chunks of documents and key exchanges: how windows of all documents meet without leaving any task unbounded.

``chunked`` packs whole documents into chunks of a few MB, one row each, and writes them once to the shared
folder, bucketed by chunk; a longer document is a chunk of its own.  A step then works in three moves:

1. every chunk posts its keys, already distinct inside the chunk, as one packed row per bucket of the key's hash;
2. each bucket answers (``ask``): a group holds a key at most once per chunk, so a key that a third of the
   documents hold costs a bucket one entry a chunk and no skew; buckets are even because keys are hashes;
3. answers go back to their chunk (``reply``).

The number of buckets is the session's ``spark.sql.shuffle.partitions``, so a bucket's share is the size of
an ordinary shuffle partition.  Texts never go to the driver; nothing is broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import arrays as A

CHUNK_BYTES = 2 << 20
NULL_ID = np.iinfo(np.int64).max
CHUNK_TABLE = "tickerloom_chunks_"
CHUNK_SCHEMA = "chunk long, ids binary, sizes binary, data binary"
MESSAGE_SCHEMA = "bucket int, chunk long, n int, payload binary"
ANSWER_SCHEMA = "chunk long, payload binary"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: what ``spark.checkpoint.dir`` names, else one of this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickerloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


def _note(path: str) -> None:
    if _SCOPES:
        _SCOPES[-1].append(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getName().startswith(CHUNK_TABLE):
            spark.sql(f"DROP TABLE IF EXISTS {at.getName()}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame | tuple[DataFrame, ...]]):
    """Stores the table or tables that ``make()`` gives, then deletes what was stored on the way: nothing reads it any more."""
    _SCOPES.append([])
    try:
        made = make()
        inner = _SCOPES[-1]
        _SCOPES[-1] = []
        out = tuple(stored(m) for m in made) if isinstance(made, tuple) else stored(made)
    finally:
        kept = _SCOPES.pop()
    for path in kept:
        _note(path)
    _delete(spark, inner)
    return out


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Chunk:
    """The documents of one row: ids (NULL_ID for a null id), bytes and offsets."""

    def __init__(self, row: dict):
        self.key = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.off = np.concatenate(([0], np.cumsum(sizes)))
        self.buf = np.frombuffer(pa.decompress(row["data"], decompressed_size=int(self.off[-1]), codec="zstd"), np.uint8) if self.off[-1] else np.zeros(0, np.uint8)


def _pack(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], key: int) -> pa.RecordBatch:
    data = b"".join(b.tobytes() for _, b, _ in parts)
    row = [key, np.concatenate([i for i, _, _ in parts]).tobytes(), np.concatenate([np.diff(o) for _, _, o in parts]).astype(np.int64).tobytes(), pa.compress(data, codec="zstd", asbytes=True) if data else b""]
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], names=["chunk", "ids", "sizes", "data"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    key = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        for part in A.slices(batch, "text", CHUNK_BYTES):
            buf, off = A.flat(part.column("text"))
            if held and size + buf.size > CHUNK_BYTES:
                yield _pack(held, key)
                key, held, size = key + 1, [], 0
            held.append((part.column("doc_id").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64), buf.copy(), off))
            size += buf.size
    if held:
        yield _pack(held, key)


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunk table of all documents, stored; other columns of ``docs`` are not read.

    It is bucketed by chunk, so the texts stay where they are when answers come back: only answers are shuffled.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    name = f"{CHUNK_TABLE}{uuid.uuid4().hex}"
    rows = source.mapInArrow(_chunk_rows, CHUNK_SCHEMA)
    rows.write.bucketBy(buckets(spark), "chunk").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name, format="parquet")
    _note(f"{shared_folder(spark)}/{name}")
    return spark.table(name)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(payload: bytes, n: int, kinds: str) -> list[np.ndarray]:
    """Columns of n values each; ``kinds`` is a comma list of numpy types."""
    out, at = [], 0
    for kind in kinds.split(","):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def bucket_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """Even buckets even for keys that are minima of hashes and so lie close together."""
    return ((A.mix(hashes) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def posted(chunk: int, hashes: np.ndarray, columns: list[np.ndarray], count: int) -> pa.RecordBatch:
    """One message row for each bucket that gets some of the keys."""
    to = bucket_of(hashes, count).astype(np.int32)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(count + 1))
    filled = np.flatnonzero(np.diff(cuts))
    payloads = [packed([c[order[cuts[b] : cuts[b + 1]]] for c in columns]) for b in filled]
    return pa.RecordBatch.from_arrays(
        [pa.array(filled.astype(np.int32)), pa.array(np.full(filled.size, chunk, np.int64)), pa.array(np.diff(cuts)[filled].astype(np.int32)), pa.array(payloads, pa.binary())],
        names=["bucket", "chunk", "n", "payload"],
    )


def post(chunks: DataFrame, make: Callable[..., pa.RecordBatch], read: Callable = Chunk) -> DataFrame:
    """Messages of every chunk; ``read`` makes of a row what ``make`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield make(read(row))

    return chunks.mapInArrow(run, MESSAGE_SCHEMA)


def ask(messages: DataFrame, answer: Callable[[np.ndarray, np.ndarray, list[bytes]], list[tuple[int, bytes]]], schema: str = ANSWER_SCHEMA) -> DataFrame:
    """(chunk, payload) rows that ``answer(chunks, sizes, payloads)`` gives for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        chunks, sizes = (table.column(c).to_numpy() for c in ("chunk", "n"))
        out = answer(chunks, sizes, table.column("payload").to_pylist())
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    return messages.groupBy("bucket").applyInArrow(run, schema)


def reply(chunks: DataFrame, answers: DataFrame, make: Callable[..., pa.Table | pa.RecordBatch], schema: str, read: Callable = Chunk) -> DataFrame:
    """What ``make(chunk, its answers)`` gives for every chunk, answered or not."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        payloads = right.column("payload").to_pylist()
        made = [make(read(row), payloads) for row in left.to_pylist()]
        return pa.Table.from_batches([b for m in made for b in (m.to_batches() if isinstance(m, pa.Table) else [m])]) if made else _empty(schema)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def ids_out(ids: np.ndarray) -> pa.Array:
    """Document ids as a column, NULL_ID as null again."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in log2(width) passes."""
    if values.size < width:
        return values[:0]
    out, k = values, 1
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    rest = width - k
    return np.minimum(out[: out.size - rest], out[rest:]) if rest else out


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not sorted_set.size:
        return np.zeros(values.size, bool)
    at = np.minimum(np.searchsorted(sorted_set, values), sorted_set.size - 1)
    return sorted_set[at] == values


def member_of_runs(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """``member`` for values that come in runs: each run is looked up once."""
    if not values.size:
        return np.zeros(0, bool)
    head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return np.repeat(member(values[head], sorted_set), np.diff(np.append(head, values.size)))


def repeated_keys(chunks: np.ndarray, sizes: np.ndarray, payloads: list[bytes]) -> list[tuple[int, bytes]]:
    """Answer for messages of (key u8, repeated-inside-the-chunk u1): each chunk's keys that repeat anywhere."""
    parts = [unpacked(p, int(n), "<u8,u1") for n, p in zip(sizes, payloads, strict=True)]
    keys = np.concatenate([k for k, _ in parts])
    own = np.repeat(np.arange(len(parts)), sizes)
    order, bounds = A.groups(keys)
    size = np.diff(bounds)
    many = (size > 1) | np.logical_or.reduceat(np.concatenate([f for _, f in parts])[order] > 0, bounds[:-1])
    hit = np.zeros(keys.size, bool)
    hit[order] = np.repeat(many, size)
    cuts = np.searchsorted(own[hit], np.arange(len(parts) + 1))
    found = keys[hit]
    return [(int(c), found[a:b].tobytes()) for c, a, b in zip(chunks, cuts[:-1], cuts[1:], strict=True) if b > a]


def key_counts(kind: str) -> Callable[[np.ndarray, np.ndarray, list[bytes]], list[tuple[int, bytes]]]:
    """Answer for messages of (key u8, count of type ``kind``): each chunk's keys with a total of two or more, (u8, total u4)."""

    def answer(chunks: np.ndarray, sizes: np.ndarray, payloads: list[bytes]) -> list[tuple[int, bytes]]:
        parts = [unpacked(p, int(n), f"<u8,{kind}") for n, p in zip(sizes, payloads, strict=True)]
        keys, times = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order, bounds = A.groups(keys)
        total = np.empty(keys.size, np.int64)
        total[order] = np.repeat(np.add.reduceat(times[order].astype(np.int64), bounds[:-1]), np.diff(bounds))
        own = np.repeat(np.arange(len(parts)), sizes)
        hit = total > 1
        cuts = np.searchsorted(own[hit], np.arange(len(parts) + 1))
        keys, total = keys[hit], np.minimum(total[hit], 2**31).astype("<u4")
        return [(int(c), packed([keys[a:b], total[a:b]])) for c, a, b in zip(chunks, cuts[:-1], cuts[1:], strict=True) if b > a]

    return answer


def repeated_marks(count: int) -> Callable[[np.ndarray, np.ndarray, list[bytes]], list[tuple[int, bytes]]]:
    """As ``repeated_keys``, but a chunk gets one bit for each key it posted to the bucket; ``marked`` reads them."""

    def answer(chunks: np.ndarray, sizes: np.ndarray, payloads: list[bytes]) -> list[tuple[int, bytes]]:
        parts = [unpacked(p, int(n), "<u8,u1") for n, p in zip(sizes, payloads, strict=True)]
        keys = np.concatenate([k for k, _ in parts])
        order, bounds = A.groups(keys)
        size = np.diff(bounds)
        many = (size > 1) | np.logical_or.reduceat(np.concatenate([f for _, f in parts])[order] > 0, bounds[:-1])
        hit = np.zeros(keys.size, bool)
        hit[order] = np.repeat(many, size)
        bucket = int(bucket_of(keys[:1], count)[0]).to_bytes(4, "little")
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return [(int(c), bucket + np.packbits(hit[a:b]).tobytes()) for c, a, b in zip(chunks, cuts[:-1], cuts[1:], strict=True) if hit[a:b].any()]

    return answer


def marked(keys: np.ndarray, answers: list[bytes], count: int) -> np.ndarray:
    """The keys, as they were posted, whose bit is set."""
    to = bucket_of(keys, count)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(count + 1))
    out = np.zeros(keys.size, bool)
    for a in answers:
        b = int.from_bytes(a[:4], "little")
        mine = order[cuts[b] : cuts[b + 1]]
        out[mine] = np.unpackbits(np.frombuffer(a, np.uint8, -1, 4), count=mine.size).astype(bool)
    return keys[out]
