"""Token-id files: a context-mixing range coder over independently reset, checksummed blocks.

Three experts predict the next id.  Order 2 and order 1 say, for a hash of the last two and for the last one id, the id that
follows it most often in the segment and how often; order 0 is the distribution of the ids that neither of them foresees.
These tables are counted once a segment, stored before its blocks and the same for all of them.  The experts are mixed with
weights that each block starts anew and that follow each expert's own success (Bayesian posterior with a leak).  One
range-coder step codes which of the two predictions holds or neither; a miss takes one more step through order 0.  The coder
has a 64-bit low and 16-bit words and carries into words already written.  Only integer arithmetic and exactly rounded
+ - * / are used, so any machine decodes the same ids.

A block is ``BLOCK`` ids with its own mixing and coder state and a crc32 of its ids; a segment is a row of
blocks of whole documents with a table of their ids and lengths.  Blocks of a segment run in lockstep, one
numpy lane each, so a step costs array operations over all of them.  Segments are rows of a Parquet table
in the shared folder: an executor that is lost is redone, and readers verify every checksum.

Order: documents are range-partitioned by id before they are encoded; a segment knows its partition and its
first id there, and partition offsets are a running sum over one number a partition.  Null ids come first,
rows of one id follow each other.  Null and empty texts are only the end id.  Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm import bpe
from tickerloom.llm.arrays import flat, slices
from tickerloom.llm.exchange import NULL_ID, buckets, ids_out, stored
from tickerloom.llm.pieces import Pieces

BLOCK = 512
SEGMENT_TOKENS = 3_000_000
BITS, ZERO_BITS = 15, 17
MAGIC = b"TKSEG2\0\0"
NO_ID = 65_535
_U, _F = np.uint64, np.float32
_LEAST = _U(1 << 48)
_ROWS = 64  # steps whose predictions are looked up together when ids are known


def _slot(last: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    return ((last * 0x9E3779B1 + before * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - bits)


def _packed(array: np.ndarray, kind: str) -> bytes:
    data = zlib.compress(array.astype(kind).tobytes(), 1)
    return struct.pack("<q", len(data)) + data


class Model:
    """What all blocks of a segment share: for each context of order 1 and 2 ``id << 8 | share of 256``, and the ids that neither foresees."""

    def __init__(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.one, self.two, self.bits, self.ids, self.counts = one, two, two.size.bit_length() - 1, ids, counts
        size = 1 + counts * ((1 << ZERO_BITS) - ids.size) // max(1, int(counts.sum()))
        if ids.size:
            size[np.argmax(counts)] += (1 << ZERO_BITS) - size.sum()
        start = np.cumsum(size) - size
        self.size, self.start = np.zeros(NO_ID + 1, _U), np.zeros(NO_ID + 1, _U)
        self.size[ids], self.start[ids] = size, start
        self.id_at = np.repeat(ids, size).astype(np.int32)

    @classmethod
    def fitted(cls, rows: np.ndarray) -> Model:
        """Of a (blocks, steps) array of ids."""
        last = np.zeros_like(rows)
        last[:, 1:] = rows[:, :-1]
        bits = min(max(rows.size.bit_length() - 4, 8), 18)
        slot = np.zeros_like(rows)
        slot[:, 1:] = last[:, :-1]
        slot = _slot(last, slot, bits)
        one, two = cls._most(last, rows, 1 << 16, 3), cls._most(slot, rows, 1 << bits, 4)
        missed = rows[(one.take(last) >> 8 != rows) & (two.take(slot) >> 8 != rows)]
        counts = np.bincount(missed, minlength=1)
        ids = np.flatnonzero(counts)
        return cls(one, two, ids, counts[ids])

    @staticmethod
    def _most(context: np.ndarray, ids: np.ndarray, size: int, least: int) -> np.ndarray:
        """The most frequent id of each context with its share, where it occurs ``least`` times."""
        table = np.full(size, NO_ID << 8 | 1, np.int32)
        key = (context << 16 | ids).ravel()
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count, key = np.diff(np.append(first, key.size)), key[first]
        where = key >> 16
        head = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        best, total = np.maximum.reduceat(count << 16 | (key & 0xFFFF), head), np.add.reduceat(count, head)
        often = best >> 16
        kept = often >= least
        table[where[head[kept]]] = ((best & 0xFFFF) << 8 | np.clip((often << 8) // (total + 1), 1, 250))[kept]
        return table

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<q", self.bits)]
        for table in (self.one, self.two):
            at = np.flatnonzero(table >> 8 != NO_ID)
            parts += [_packed(np.diff(at, prepend=0), "<u4"), _packed(table[at] >> 8, "<u2"), _packed(table[at] & 255, "u1")]
        return b"".join([*parts, _packed(np.diff(self.ids, prepend=0), "<u2"), _packed(self.counts, "<u4")])

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        at, arrays = 8, []
        for kind in ("<u4", "<u2", "u1", "<u4", "<u2", "u1", "<u2", "<u4"):
            (n,) = struct.unpack_from("<q", data, at)
            arrays.append(np.frombuffer(zlib.decompress(data[at + 8 : at + 8 + n]), kind).astype(np.int64))
            at += 8 + n
        tables = []
        for size, (where, ids, share) in zip((1 << 16, 1 << struct.unpack_from("<q", data)[0]), (arrays[:3], arrays[3:6]), strict=True):
            table = np.full(size, NO_ID << 8 | 1, np.int32)
            table[np.cumsum(where)] = ids << 8 | share
            tables.append(table)
        return cls(*tables, np.cumsum(arrays[6]), arrays[7])


def _told(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, share) of entries of a model's tables."""
    return entry >> 8, (entry & 255).astype(_F) * _F(1 / 256)


class Mixer:
    """The weights of all lanes."""

    def __init__(self, lanes: int):
        self.none, self.one, self.two = (np.full(lanes, 1 / 3, _F) for _ in range(3))

    def predict(self, one: np.ndarray, two: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies of 'order 2 holds' and 'order 2 or else order 1 holds' out of 2^BITS, of the experts' shares and whether their ids differ."""
        self.p = one, two
        first, second = self.one * one, self.two * two
        apart = first * differ
        second += first - apart
        high = (second * _F(32000)).astype(_U) + _U(1)
        return high, high + (apart * _F(32000)).astype(_U) + _U(1)

    def learn(self, one: np.ndarray, two: np.ndarray) -> None:
        """``one`` and ``two``: whether the expert was right; the likelihood of a wrong one is that of order 0."""
        first = self.one * np.where(one, self.p[0] * _F(4096), _F(1) - self.p[0])
        second = self.two * np.where(two, self.p[1] * _F(4096), _F(1) - self.p[1])
        scale = _F(0.97) / (self.none + first + second)
        self.none, self.one, self.two = self.none * scale + _F(0.01), first * scale + _F(0.01), second * scale + _F(0.01)


def encode_blocks(ids: np.ndarray, model: Model) -> list[bytes]:
    """One stream for each column of a (steps, lanes) array of ids below 65,535."""
    steps, lanes = ids.shape
    mixer, width = Mixer(lanes), 2 * steps + 4
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    out, place = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    whole = _U(1 << BITS)

    def word(at: np.ndarray) -> None:
        out[place[at]] = low[at] >> _U(48)
        place[at] += 1
        low[at] <<= _U(16)

    nothing = np.zeros((2, lanes), ids.dtype)
    for t in range(0, steps, _ROWS):
        x = ids[t : t + _ROWS]
        past = np.concatenate((nothing, x))
        nothing = past[-2:]
        one, share1 = _told(model.one.take(past[1:-1]))
        two, share2 = _told(model.two.take(_slot(past[1:-1], past[:-2], model.bits)))
        good1, good2, differ = one == x, two == x, one != two
        miss = ~(good1 | good2)
        start, size = model.start.take(x), model.size.take(x)
        for i in range(x.shape[0]):
            f2, f12 = mixer.predict(share1[i], share2[i], differ[i])
            mixer.learn(good1[i], good2[i])
            begin = np.where(good2[i], _U(0), np.where(miss[i], f12, f2))
            unit = span >> _U(BITS)
            add = unit * begin
            span = unit * (np.where(good2[i], f2, np.where(miss[i], whole, f12)) - begin)
            m = np.flatnonzero(miss[i])
            unit = span[m] >> _U(ZERO_BITS)
            add[m] += unit * start[i, m]
            span[m] = unit * size[i, m]
            low += add
            over = place[low < add] - 1
            while over.size:
                out[over] += np.uint16(1)
                over = over[out[over] == 0] - 1
            at = np.flatnonzero(span < _LEAST)
            while at.size:
                word(at)
                span[at] <<= _U(16)
                at = at[span[at] < _LEAST]
    for _ in range(4):
        word(np.arange(lanes))
    rows = out.reshape(lanes, width).astype("<u2")
    return [rows[i, :n].tobytes() for i, n in enumerate((place - np.arange(lanes) * width).tolist())]


def decode_blocks(streams: list[bytes], steps: int, model: Model) -> np.ndarray:
    lanes = len(streams)
    mixer = Mixer(lanes)
    sizes = np.array([len(s) // 2 for s in streams])
    data = np.concatenate((np.frombuffer(b"".join(streams), "<u2").astype(np.uint16), np.zeros(8, np.uint16)))
    place = np.cumsum(sizes) - sizes
    end = data.size - 1
    code, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    for _ in range(4):
        code = code << _U(16) | data[np.minimum(place, end)]
        place += 1
    out = np.empty((steps, lanes), np.int32)
    last = before = np.zeros(lanes, np.int64)
    whole, most = _U(1 << BITS), _U((1 << ZERO_BITS) - 1)
    for t in range(steps):
        one, share1 = _told(model.one.take(last))
        two, share2 = _told(model.two.take(_slot(last, before, model.bits)))
        f2, f12 = mixer.predict(share1, share2, one != two)
        unit = span >> _U(BITS)
        good2, miss = code < unit * f2, code >= unit * f12
        begin = np.where(good2, _U(0), np.where(miss, f12, f2))
        code -= unit * begin
        span = unit * (np.where(good2, f2, np.where(miss, whole, f12)) - begin)
        x = np.where(good2, two, one)
        m = np.flatnonzero(miss)
        if m.size and model.id_at.size:
            unit, rest = span[m] >> _U(ZERO_BITS), code[m]
            found = model.id_at.take(np.minimum(rest // unit, most).astype(np.int64))
            x[m] = found
            code[m] = rest - unit * model.start.take(found)
            span[m] = unit * model.size.take(found)
        at = np.flatnonzero(span < _LEAST)
        while at.size:
            span[at] <<= _U(16)
            code[at] = code[at] << _U(16) | data.take(place[at], mode="clip")
            place[at] += 1
            at = at[span[at] < _LEAST]
        mixer.learn(one == x, two == x)
        out[t] = x
        before, last = last, x.astype(np.int64)
    return out


def write_segment(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """magic | n_docs, n_ids, n_blocks, n_steps, model size, model crc32 | doc ids | lengths | block sizes | block crc32s | model | streams."""
    if ids.size and not 0 <= ids.min() <= ids.max() < NO_ID:
        raise ValueError(f"ids must lie below {NO_ID}")
    blocks = max(1, -(-ids.size // BLOCK))
    steps = min(BLOCK, max(1, ids.size))
    rows = np.zeros((blocks, steps), np.int64)
    rows.reshape(-1)[: ids.size] = ids
    model = Model.fitted(rows)
    streams = encode_blocks(np.ascontiguousarray(rows.T), model)
    crc = [zlib.crc32(r) for r in rows.astype("<u4")]
    tables = model.to_bytes()
    head = struct.pack("<qqqqqq", docs.size, ids.size, blocks, steps, len(tables), zlib.crc32(tables))
    return b"".join(
        [MAGIC, head, docs.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), np.array([len(s) for s in streams], "<u4").tobytes(), np.array(crc, "<u4").tobytes(), tables, *streams]
    )


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids); raises ValueError if the tables or a block's ids do not have their checksum."""
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    docs, n_ids, blocks, steps, model, check = struct.unpack_from("<qqqqqq", data, 8)
    at, parts = 56, []
    for kind, n in (("<i8", docs), ("<i8", docs), ("<u4", blocks), ("<u4", blocks)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    tables, at = data[at : at + model], at + model
    if zlib.crc32(tables) != check:
        raise ValueError("the tables fail their checksum")
    ends = at + np.cumsum(parts[2].astype(np.int64))
    columns = decode_blocks([data[e - s : e] for e, s in zip(ends.tolist(), parts[2].tolist(), strict=True)], steps, Model.from_bytes(tables))
    rows = np.ascontiguousarray(columns.T).astype("<u4", copy=False)
    for i, crc in enumerate(parts[3].tolist()):
        if zlib.crc32(rows[i]) != crc:
            raise ValueError(f"block {i} fails its checksum")
    return parts[0], parts[1], rows.reshape(-1)[:n_ids]


# --- Spark side ---------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes all documents in ascending id order into segments; the stored table (part, first, n_tokens, segment)."""
    spark = docs.sparkSession
    shared = bpe.vocabulary(spark, vocabulary_path)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranged = source.repartitionByRange(buckets(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, first, held, size = TaskContext.get().partitionId(), 0, [], 0
        pieces = bpe.loaded(shared, Pieces)

        def segment() -> pa.RecordBatch:
            docs, sizes, ids = (np.concatenate(a) for a in zip(*held, strict=True))
            data = write_segment(docs, sizes, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([ids.size], pa.int64()), pa.array([data], pa.binary())], names=["part", "first", "n_tokens", "segment"])

        for batch in batches:
            for cut in slices(batch, "text"):
                ids, sizes = pieces.encode(*flat(cut.column("text")), int(end_id))
                if held and size + ids.size > SEGMENT_TOKENS:
                    yield segment()
                    first, held, size = first + size, [], 0
                held.append((cut.column("doc_id").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64), sizes, ids))
                size += ids.size
        if held:
            yield segment()

    return stored(ranged.mapInArrow(run, "part int, first long, n_tokens long, segment binary"))


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files; ids are packed little-endian u32.

    A segment meets its partition's offset before it is decoded, so ids are never shuffled.  The offsets are
    one number for each range partition that ``write_tokens`` made, which bounds what is broadcast.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base = batch.column("base")[i].as_py()
                docs, sizes, ids = read_segment(batch.column("segment")[i].as_py())
                off = np.concatenate(([0], np.cumsum(sizes)))
                for s in range(0, docs.size, 2000):
                    e = min(s + 2000, docs.size)
                    cut = [ids[a:b].tobytes() for a, b in zip(off[s:e].tolist(), off[s + 1 : e + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids_out(docs[s:e]), pa.array(base + off[s:e], pa.int64()), pa.array(sizes[s:e], pa.int64()), pa.array(cut, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    placed = segments.join(F.broadcast(parts), "part").select((F.col("offset") + F.col("first")).alias("base"), "segment")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
