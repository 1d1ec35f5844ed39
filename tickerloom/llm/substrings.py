"""Substring deduplication by level-wise doubling of repeated word windows.

A window is ``window`` consecutive words of one document; every word that lies in a window whose word
sequence also starts earlier (smaller doc_id, or the same document and an earlier start) is removed.
Windows are judged on the input, not on what is left.

Levels: lengths start, 2*start, 4*start ... ``window``.  At a length n below the target, a window of the
target length stands or falls with the n-word windows inside it: two equal target windows hold the same
n-word windows, so the one of least hash repeats too.  Only target windows whose representative at length
n repeats somewhere are extended to twice that length; the rest are settled.  At the target length
each chunk posts the first of each of its surviving sequences (two independent 64-bit hashes) with its
place, and the bucket names all but the earliest.  Equal windows inside a chunk are settled there.

Each level is one exchange of distinct keys (see ``exchange``): a line that a third of the documents hold
is one key a chunk.  Chunk texts are stored once and move by chunk, compressed.

Defined cases: null and empty texts have no words and give an empty kept text.  Texts of fewer than
``window`` words lose nothing.  Rows of one doc_id count as one document; of two windows with the same id
and start neither is earlier.  A null id counts as the largest.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm import arrays as A
from tickerloom.llm import exchange as X

WINDOW = 20
START = 10


class Words:
    def __init__(self, chunk: X.Chunk):
        self.chunk = chunk
        self.starts, self.ends, self.at = A.words(chunk.buf, chunk.off)
        self.hash = A.word_hashes(chunk.buf, self.starts, self.ends)
        self.doc = A.owner(self.at)

    def windows(self, n: int) -> np.ndarray:
        return A.Spans(self.hash).windows(n)

    def second(self, n: int) -> np.ndarray:
        return A.Spans(A.word_hashes(self.chunk.buf, self.starts, self.ends, 1), 1).windows(n)

    def lead(self, n: int, window: int) -> np.ndarray:
        """Of every window, the least hash of the n-word windows inside; by start, over document borders too."""
        return X.sliding_min(self.windows(n), window - n + 1)


def _level(words: Words, starts: np.ndarray, n: int, window: int, count: int) -> pa.RecordBatch:
    """Distinct leads of some windows, with a mark on those that occur twice in this chunk."""
    keys = np.unique(words.lead(n, window)[starts])
    own, times = np.unique(words.windows(n)[A.window_starts(words.at, n)], return_counts=True)
    twice = X.member(keys, own[times > 1])
    return X.posted(words.chunk.key, keys, [keys, twice.astype(np.uint8)], count)


def _survivors(words: Words, n: int, window: int, answers: list[bytes]) -> np.ndarray:
    found = np.sort(np.frombuffer(b"".join(answers), "<u8"))
    starts = A.window_starts(words.at, window)
    return starts[X.member(words.lead(n, window)[starts], found)] if starts.size else starts


def _local(words: Words, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later) of some windows: the earliest of each sequence in this chunk, and those after it."""
    if not starts.size:
        return starts, starts
    ids = words.chunk.ids[words.doc[starts]]
    place = starts - words.at[words.doc[starts]]
    order = np.lexsort((place, ids, hashes[starts]))
    k = hashes[starts][order]
    head = np.concatenate(([True], k[1:] != k[:-1]))
    at = np.maximum.accumulate(np.where(head, np.arange(k.size), 0))
    after = (ids[order] != ids[order][at]) | (place[order] != place[order][at])
    return starts[order[head]], starts[order[after]]


def _earliest(chunks: np.ndarray, sizes: np.ndarray, payloads: list[bytes]) -> list[tuple[int, bytes]]:
    """Answer at the target length: each chunk's windows whose sequence starts earlier in another chunk."""
    parts = [X.unpacked(p, int(n), "<u8,<u8,<i8,<i4,<i4") for n, p in zip(sizes, payloads, strict=True)]
    hi, lo, ids, place, where = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((place, ids, lo, hi))
    h, low, d, p = hi[order], lo[order], ids[order], place[order]
    head = np.concatenate(([True], (h[1:] != h[:-1]) | (low[1:] != low[:-1])))
    at = np.maximum.accumulate(np.where(head, np.arange(h.size), 0))
    late = np.zeros(h.size, bool)
    late[order] = (d != d[at]) | (p != p[at])
    own = np.repeat(np.arange(len(parts)), sizes)[late]
    cuts = np.searchsorted(own, np.arange(len(parts) + 1))
    found = where[late]
    return [(int(c), found[a:b].tobytes()) for c, a, b in zip(chunks, cuts[:-1], cuts[1:], strict=True) if b > a]


def deduplicate(docs: DataFrame, window: int = WINDOW, start: int = START, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept`` joins the remaining words by one space."""
    chunks = X.chunked(docs, doc_id, text)
    count = X.buckets(docs.sparkSession)
    lengths = [start]
    while 2 * lengths[-1] < window:
        lengths.append(2 * lengths[-1])

    def first(chunk: X.Chunk) -> pa.RecordBatch:
        words = Words(chunk)
        return _level(words, A.window_starts(words.at, window), lengths[0], window, count)

    answers = X.ask(X.post(chunks, first), X.repeated_keys)
    for shorter, longer in zip(lengths, lengths[1:], strict=False):

        def next_level(chunk: X.Chunk, found: list[bytes], shorter=shorter, longer=longer) -> pa.RecordBatch:
            words = Words(chunk)
            return _level(words, _survivors(words, shorter, window, found), longer, window, count)

        answers = X.ask(X.reply(chunks, answers, next_level, X.MESSAGE_SCHEMA), X.repeated_keys)
    last = lengths[-1]

    def target(chunk: X.Chunk, found: list[bytes]) -> pa.RecordBatch:
        words = Words(chunk)
        hashes = words.windows(window)
        own, _ = _local(words, hashes, _survivors(words, last, window, found))
        d = words.doc[own]
        columns = [hashes[own], words.second(window)[own], chunk.ids[d], (own - words.at[d]).astype(np.int32), own.astype(np.int32)]
        return X.posted(chunk.key, columns[0], columns, count)

    def finish(chunk: X.Chunk, found: list[bytes]) -> pa.RecordBatch:
        words = Words(chunk)
        _, later = _local(words, words.windows(window), A.window_starts(words.at, window))
        late = np.concatenate((later, np.frombuffer(b"".join(found), "<i4").astype(np.int64)))
        kept = ~A.covered(words.hash.size, late, window)
        n_words = np.diff(words.at)
        n_kept = np.diff(np.concatenate(([0], np.cumsum(kept)))[words.at])
        s, size = words.starts[kept], (words.ends - words.starts + 1)[kept]
        off = np.concatenate(([0], np.cumsum(size)))
        out = chunk.buf[np.minimum(np.repeat(s - off[:-1], size) + np.arange(off[-1]), max(chunk.buf.size - 1, 0))] if off[-1] else chunk.buf[:0]
        out[off[1:] - 1] = 32
        cut = off[np.concatenate(([0], np.cumsum(n_kept)))]
        data = out.tobytes()
        texts = [data[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [X.ids_out(chunk.ids), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
        )

    late = X.ask(X.reply(chunks, answers, target, X.MESSAGE_SCHEMA), _earliest)
    return X.reply(chunks, late, finish, "doc_id long, n_words long, n_removed long, kept string")
