"""Byte-level BPE by segment trees over the ranks of adjacent pairs, encoding and exact decoding.

A piece (one match of the vocabulary's split pattern) is a row of leaves, one for each adjacent pair of
symbols, with the key ``rank * size + position``.  Inner nodes hold the minimum of their children, so the
root yields the leftmost pair of lowest rank.  A merge changes at most three leaves (the pair itself and
its two neighbours); each is a point update along one path to the root.  The piece is done when the root
holds no rank.  Pieces of one size class are rows of one numpy array and step together, so a batch costs
array operations, not Python steps; each piece of a batch that the worker has not met is encoded once.

Null and empty texts give no ids.  Added tokens of the vocabulary file that occur in a text are found
first, as the library does.  Very long pieces take O(n log n).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.arrays import slices

# The split pattern of this family of vocabularies; fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int64(1) << np.int64(60)
CACHE_PIECES = 400_000
LEAVES_AT_ONCE = 1 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = [""] * 256
    for b in plain:
        letters[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[b] = chr(256 + i)
    return letters


class Bpe:
    """One vocabulary: ``encode`` gives little-endian ids of pieces, ``decode`` the bytes of ids."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: i for i, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(SPLIT)
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        left, right, merged = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            left.append(vocab[a])
            right.append(vocab[b])
            merged.append(vocab[a + b])
        pair = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank, self.merged = pair[order], order.astype(np.int64), np.array(merged, np.int64)
        self.cache: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE where they do not merge (or either is missing, -1)."""
        if not self.pair.size:
            return np.full(left.shape, NONE)
        key = (left << np.int64(20)) | right
        at = np.minimum(np.searchsorted(self.pair, key), self.pair.size - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Merges every row of a (rows, size) array of ids padded with -1; dead symbols become -1."""
        rows, size = ids.shape
        place = np.arange(size, dtype=np.int64)
        left = np.tile(place - 1, (rows, 1))
        right = np.tile(place + 1, (rows, 1))
        right[right >= size] = size - 1
        nothing = np.full((rows, 1), -1, np.int64)
        after = np.concatenate((ids[:, 1:], nothing), 1)
        right[after < 0] = -1
        r = self.ranks(ids, after)
        tree = np.full((rows, 2 * size), NONE)
        tree[:, size:] = np.where(r < NONE, r * size + place, NONE)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.arange(rows)
        width = 2 * size
        nodes = tree.reshape(-1)

        def update(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = size + leaf
            base = row * width
            nodes[base + node] = value
            while size > 1:
                node = node >> 1
                nodes[base + node] = np.minimum(nodes[base + 2 * node], nodes[base + 2 * node + 1])
                if node[0] == 1:  # all leaves are equally deep
                    break

        while True:
            root = tree[live, 1]
            more = root < NONE
            live, root = live[more], root[more]
            if not live.size:
                return ids
            rank, p = root // size, root % size
            q = right[live, p]
            n = right[live, q]
            ids[live, p] = self.merged[rank]
            ids[live, q] = -1
            right[live, p] = n
            update(live, q, np.full(live.size, NONE))
            has = n >= 0
            nxt = np.where(has, ids[live, n], -1)
            left[live[has], n[has]] = p[has]
            r = self.ranks(ids[live, p], nxt)
            update(live, p, np.where(r < NONE, r * size + p, NONE))
            o = left[live, p]
            has = o >= 0
            if has.any():
                row, o, p = live[has], o[has], p[has]
                r = self.ranks(ids[row, o], ids[row, p])
                update(row, o, np.where(r < NONE, r * size + o, NONE))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.array([len(b) for b in raw], np.int64)
        out: list[bytes] = [b""] * len(raw)
        size_of = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for size in np.unique(size_of).tolist():
            members = np.flatnonzero(size_of == size)
            step = max(1, LEAVES_AT_ONCE // size)
            for s in range(0, members.size, step):
                part = members[s : s + step]
                data = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
                ends = np.cumsum(lengths[part])
                ids = np.full((part.size, size), -1, np.int64)
                inside = np.arange(size) < lengths[part][:, None]
                ids[inside] = self.byte_id[data]
                ids = self._merge(ids)
                kept = ids >= 0
                packed = ids[kept].astype("<u4").tobytes()
                at = 0
                for i, k in zip(part.tolist(), (4 * kept.sum(1)).tolist(), strict=True):
                    out[i] = packed[at : at + k]
                    at += k
                del ends
        return out

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.split.findall(part)
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed; every piece that the worker has not met is encoded once."""
        cut = [self.pieces(t) for t in texts]
        cache = self.cache
        fresh = list({p for ps in cut for p in ps if p not in cache})
        if len(cache) + len(fresh) > CACHE_PIECES:
            cache.clear()
            fresh = list({p for ps in cut for p in ps})
        plain = [p for p in fresh if p not in self.added]
        cache.update(zip(plain, self.encode_pieces(plain), strict=True))
        cache.update((p, int(self.added[p]).to_bytes(4, "little")) for p in fresh if p in self.added)
        get = cache.__getitem__
        return [b"".join(map(get, ps)) for ps in cut]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[tuple, object] = {}


def loaded(shared, make=Bpe):
    """``make(file text)`` of a broadcast vocabulary file, parsed once in each worker and kept across its tasks."""
    key = (make.__name__, zlib.crc32(shared.value.encode()))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make(shared.value)
    return _LOADED[key]


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file (its size is that of the vocabulary, a few MB whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_and_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids as packed little-endian u32, decoded text) of every row."""
    from pyspark.sql import functions as F

    shared = vocabulary(docs.sparkSession, path)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared)
        for batch in batches:
            for part in slices(batch, "text"):
                packed = bpe.encode_texts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([bpe.decode(p) for p in packed], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
        bpe.cache.clear()  # the worker goes on to other operators' tasks, whose memory this would take

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
