"""Suffix-array deduplication: merges of shard Burrows-Wheeler transforms give the repeated byte strings.

Every byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id is
removed.  Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

1. Blocking.  Of every ``length``-byte string the least hash of its ``ANCHOR``-byte substrings is its lead:
   equal strings have equal leads.  One exchange of distinct leads (see ``exchange``) finds those that repeat.
   A second exchange does the same for pairs of the lead and a second lead, the greatest anchor hash: of leads
   that repeat by chance hardly any string stays.  A lead with more than ``HOT`` distinct surroundings (a passage
   that very many documents hold, each with its own text beside it) asks for its whole strings instead and is
   dealt by both leads.
2. Runs of strings whose lead repeats are segments (up to 84 bytes for the usual lengths).  Equal segments of
   one chunk are one entry under its smallest document; copies in larger documents are settled at home, so a
   passage that a third of the documents hold is one entry a chunk.  Entries meet by lead.
3. A bucket handles its leads in batches of bounded size.  The distinct segments of a batch are dealt to
   shards; every shard sorts only its own suffixes (prefix doubling) and keeps its transform.  The shards'
   transforms are merged by iterative interleave refinement: pass h stably deals the interleave by the
   transform's symbols, after which it is ordered by prefixes of h bytes; a position starts a new block where
   the symbol or the previous pass's block differs, so blocks after pass h are the intervals with a common
   prefix of h.  No suffix is sorted again.  After ``length`` passes the blocks are the repeated strings; in
   each, all but the smallest document lose theirs.

Defined cases: null and empty texts are zero bytes; texts shorter than ``length`` lose nothing.  Rows of one
doc_id never remove each other's bytes.  A null id counts as the largest.  ``kept`` is binary, since a cut
may fall inside a character.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm import arrays as A
from tickerloom.llm import exchange as X

LENGTH = 50
ANCHOR = 16
SHARD_BYTES = 64 << 10
BATCH_BYTES = 256 << 10
HOT = 512


# --- one batch: transforms of shards and their merge ---------------------------------------------


def cyclic(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, length) of the string that owns each position."""
    size = np.diff(off)
    return np.repeat(off[:-1], size), np.repeat(size, size)


def shard_order(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotations of all strings of a shard in order, by prefix doubling; their first 8 symbols); every string ends with a 0."""
    first, size = cyclic(off)
    inside = np.arange(symbols.size) - first
    key = np.zeros(symbols.size, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | symbols[first + (inside + j) % size]
    _, rank = np.unique(key, return_inverse=True)
    k = 8
    while rank.max(initial=-1) + 1 < symbols.size:
        both = rank.astype(np.uint64) * np.uint64(symbols.size) + rank[first + (inside + k) % size].astype(np.uint64)
        _, rank = np.unique(both, return_inverse=True)
        k *= 2
    order = np.empty(symbols.size, np.int64)
    order[rank] = np.arange(symbols.size)
    return order, key[order]


def merged_blocks(transforms: list[np.ndarray], heads: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, block): in merged order, the index into the joined shard orders and the block of common prefix ``depth``.

    The sorted ``heads`` (first 8 symbols) of the shards are merged as runs; refinement goes on from there.
    """
    symbols, head = np.concatenate(transforms), np.concatenate(heads)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [t.size for t in transforms])
    place = np.argsort(head, kind="stable")
    head, shard = head[place], shard[place]
    block = np.cumsum(np.concatenate(([False], head[1:] != head[:-1])), dtype=np.int32)
    for _ in range(depth - 8):
        c = symbols[place]
        order = np.argsort(c, kind="stable")
        c, block, shard = c[order], block[order], shard[order]
        fresh = np.empty(c.size, bool)
        fresh[:1] = False
        fresh[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(fresh, dtype=np.int32)
        place = np.empty_like(place)
        place[np.argsort(shard, kind="stable")] = np.arange(place.size)
        if block[-1] == c.size - 1:  # every prefix is already alone
            break
    return place, block


def late_windows(contents: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, offset) of the ``length``-byte strings that also start in a content of a smaller document."""
    shards, held, size = [], [], 0
    for i, c in enumerate(contents):
        held.append(i)
        size += len(c) + 1
        if size >= SHARD_BYTES:
            shards.append(held)
            held, size = [], 0
    if held:
        shards.append(held)
    transforms, heads, content, offset = [], [], [], []
    for members in shards:
        off = np.concatenate(([0], np.cumsum([len(contents[i]) + 1 for i in members])))
        symbols = np.zeros(off[-1], np.uint8)
        text = np.ones(off[-1], bool)
        text[off[1:] - 1] = False
        symbols[text] = np.frombuffer(b"".join(contents[i] for i in members), np.uint8) + 1  # no UTF-8 byte is 255
        order, head = shard_order(symbols, off)
        heads.append(head)
        first, n = cyclic(off)
        inside = np.arange(symbols.size) - first
        transforms.append(symbols[first + (inside - 1) % n][order])
        content.append(np.repeat(np.array(members), np.diff(off))[order])
        offset.append(inside[order])
    place, block = merged_blocks(transforms, heads, length)
    content, offset = np.concatenate(content)[place], np.concatenate(offset)[place]
    whole = offset + length <= np.array([len(c) for c in contents])[content]
    content, offset, block = content[whole], offset[whole], block[whole]
    if not content.size:
        return content, offset
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    doc = docs[content]
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, doc.size)))
    late = doc > least
    return content[late], offset[late]


def runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of the maximal stretches that sorted windows cover."""
    if not starts.size:
        return starts, starts
    new = np.concatenate(([True], starts[1:] > starts[:-1] + length))
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], starts.size) - 1] + length


# --- chunk side ---------------------------------------------------------------------------------


class Strings:
    """All ``length``-byte strings of a chunk by start, with their leads."""

    def __init__(self, chunk: X.Chunk, length: int):
        self.chunk, self.length = chunk, length
        self.spans = A.Spans(chunk.buf)
        self.anchors = self.spans.windows(ANCHOR)
        self.starts = A.window_starts(chunk.off, length)
        self.lead = X.sliding_min(self.anchors, length - ANCHOR + 1)[self.starts]

    def keep(self, marks: np.ndarray) -> None:
        self.starts, self.lead = self.starts[marks], self.lead[marks]

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return self.spans(self.starts[which], self.starts[which] + self.length)

    def pair(self) -> np.ndarray:
        """Hash of lead and second lead."""
        other = ~X.sliding_min(~self.anchors, self.length - ANCHOR + 1)[self.starts]
        return A.mix(self.lead + other * np.uint64(0x9E3779B97F4A7C15))

    def segments(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, stop, key, document) of the runs of consecutive strings with one key in one document."""
        starts = self.starts
        owner = np.searchsorted(self.chunk.off, starts, side="right") - 1
        new = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if starts.size else np.zeros(0, bool)
        first = np.flatnonzero(new)
        stop = starts[np.append(first[1:], starts.size) - 1] + self.length if first.size else starts
        return starts[first], stop, key[first], owner[first]

    def contents(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return A.mix(self.spans(begin, stop) + (stop - begin).astype(np.uint64))


def _lead_message(chunk: X.Chunk, length: int, count: int) -> pa.RecordBatch:
    """Distinct leads with the number of their distinct segments; two at least if a segment occurs twice."""
    strings = Strings(chunk, length)
    begin, stop, key, _ = strings.segments(strings.lead)
    order, bounds = A.groups(strings.contents(begin, stop))
    head = order[bounds[:-1]]
    times = np.where(np.diff(bounds) > 1, 2, 1)
    keys, at = np.unique(key[head], return_inverse=True)
    several = np.zeros(keys.size, np.int64)
    np.maximum.at(several, at, times)
    several = np.maximum(several, np.bincount(at, minlength=keys.size))
    return X.posted(chunk.key, keys, [keys, np.minimum(several, 65535).astype("<u2")], count)


def _known(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(repeated leads, hot leads, both sorted, answers of the second exchange) from tagged answers."""
    kinds: dict[int, list[bytes]] = {0: [], 1: []}
    for a in answers:
        kinds[a[0]].append(a[1:])
    parts = [X.unpacked(p, len(p) // 12, "<u8,<u4") for p in kinds[0]]
    lead = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    times = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
    return np.sort(lead), np.sort(lead[times > HOT]), kinds[1]


def _tagged(answer, tag: int):
    return lambda chunks, sizes, payloads: [(c, bytes([tag]) + p) for c, p in answer(chunks, sizes, payloads)]


def _second(strings: Strings, known: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keeps the strings of known leads; (keys of the second exchange, pairs, marks of hot leads)."""
    strings.keep(X.member_of_runs(strings.lead, known))
    pairs, is_hot = strings.pair(), X.member_of_runs(strings.lead, hot)
    keys = pairs.copy()
    keys[is_hot] = strings.hashes(is_hot)
    return keys, pairs, is_hot


def _second_message(chunk: X.Chunk, length: int, answers: list[bytes], count: int) -> pa.RecordBatch:
    """Distinct keys of the second exchange, with a mark on those that occur twice in this chunk."""
    known, hot, _ = _known(answers)
    strings = Strings(chunk, length)
    keys, _, _ = _second(strings, known, hot)
    keys, times = _distinct(strings, keys)
    return X.posted(chunk.key, keys, [keys, (times > 1).astype(np.uint8)], count)


def _distinct(strings: Strings, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their numbers; consecutive strings of one key are one occurrence."""
    return np.unique(strings.segments(keys)[2], return_counts=True)


def _segments(chunk: X.Chunk, length: int, answers: list[bytes], count: int) -> pa.RecordBatch:
    """Messages: entries by bucket of their key, and ranges settled at home under a negative size."""
    known, hot, answers = _known(answers)
    strings = Strings(chunk, length)
    second, pairs, is_hot = _second(strings, known, hot)
    live = X.member_of_runs(second, X.marked(_distinct(strings, second)[0], answers, count))
    strings.keep(live)
    key = np.where(is_hot[live], pairs[live], strings.lead)
    begin, stop, key, owner = strings.segments(key)
    ids = chunk.ids[owner]
    content = strings.contents(begin, stop)
    order = np.lexsort((begin, ids, content))
    c = content[order]
    head = np.concatenate(([True], c[1:] != c[:-1])) if c.size else np.zeros(0, bool)
    entry = np.cumsum(head) - 1
    least = ids[order[head]][entry] if c.size else ids
    home = ids[order] == least
    copies = order[~home]
    entries, places, of = order[head], begin[order[home]], entry[home]
    to = X.bucket_of(key[entries], count)
    by = np.argsort(to, kind="stable")
    entries, to = entries[by], to[by]
    rank = np.empty_like(by)
    rank[by] = np.arange(by.size)
    of = rank[of]
    along = np.argsort(of, kind="stable")
    of, places = of[along], places[along]
    size = (stop - begin)[entries]
    cut = np.concatenate(([0], np.cumsum(size)))
    data = chunk.buf[np.repeat(begin[entries] - cut[:-1], size) + np.arange(cut[-1])]
    out_bucket, out_n, out_payload = [], [], []
    edges = np.searchsorted(to, np.arange(count + 1))
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        p_lo, p_hi = np.searchsorted(of, [lo, hi])
        text = data[cut[lo] : cut[hi]].tobytes()
        part = X.packed([size[lo:hi].astype("<i4"), ids[entries[lo:hi]].astype("<i8"), (A.mix(key[entries[lo:hi]]) & np.uint64(0xFFFFFFFF)).astype("<u4"), (of[p_lo:p_hi] - lo).astype("<i4"), places[p_lo:p_hi].astype("<i4")])
        out_bucket.append(int(b))
        out_n.append(int(hi - lo))
        out_payload.append(struct.pack("<ii", p_hi - p_lo, len(text)) + part + pa.compress(text, codec="zstd", asbytes=True))
    if copies.size:
        out_bucket.append(int(chunk.key % count))
        out_n.append(-1)
        out_payload.append(X.packed([begin[copies].astype("<i4"), stop[copies].astype("<i4")]))
    return pa.RecordBatch.from_arrays(
        [pa.array(out_bucket, pa.int32()), pa.array([chunk.key] * len(out_bucket), pa.int64()), pa.array(out_n, pa.int32()), pa.array(out_payload, pa.binary())], names=["bucket", "chunk", "n", "payload"]
    )


def _ranges(length: int):
    """Answer of a bucket: byte ranges, as (starts, stops), for each chunk that posted there."""

    def answer(chunks: np.ndarray, sizes: np.ndarray, payloads: list[bytes]) -> list[tuple[int, bytes]]:
        out: list[tuple[int, bytes]] = []
        contents: list[bytes] = []
        docs, batch, which, place, place_chunk = [], [], [], [], []
        total = 0
        for chunk, n, payload in zip(chunks.tolist(), sizes.tolist(), payloads, strict=True):
            if n < 0:
                out.append((chunk, payload))
                continue
            n_places, n_bytes = struct.unpack_from("<ii", payload)
            at = 8
            arrays = []
            for kind, m in (("<i4", n), ("<i8", n), ("<u4", n), ("<i4", n_places), ("<i4", n_places)):
                arrays.append(np.frombuffer(payload, kind, m, at))
                at += m * np.dtype(kind).itemsize
            text = pa.decompress(payload[at:], decompressed_size=n_bytes, codec="zstd", asbytes=True)
            ends = np.cumsum(arrays[0]).tolist()
            contents += [text[e - s : e] for e, s in zip(ends, arrays[0].tolist(), strict=True)]
            docs.append(arrays[1])
            batch.append(arrays[2])
            which.append(arrays[3].astype(np.int64) + total)
            place.append(arrays[4])
            place_chunk.append(np.full(n_places, chunk))
            total += n
        if not contents:
            return out
        docs, batch, which, place, place_chunk = (np.concatenate(x) for x in (docs, batch, which, place, place_chunk))
        number: dict[bytes, int] = {}
        same = np.array([number.setdefault(c, len(number)) for c in contents])
        distinct = list(number)
        least = np.full(len(distinct), X.NULL_ID)
        np.minimum.at(least, same, docs)
        group = np.zeros(len(distinct), np.int64)
        group[same] = batch
        size = np.array([len(c) for c in distinct])
        spans: dict[int, list[tuple[int, int]]] = {}
        _, at, many = np.unique(group, return_inverse=True, return_counts=True)
        order = np.argsort(group, kind="stable")
        order = order[many[at[order]] > 1]  # a lead with one distinct segment has nothing to be merged with
        g = group[order]
        edge = np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), g.size) if g.size else np.zeros(1, np.int64)
        start = 0
        for stop in edge[1:]:  # leads of one group stay together
            if stop < g.size and size[order[start:stop]].sum() < BATCH_BYTES:
                continue
            members = order[start:stop]
            start = stop
            content, offset = late_windows([distinct[i] for i in members], least[members], length)
            by = np.lexsort((offset, content))
            content, offset = content[by], offset[by]
            for piece in np.split(np.arange(content.size), np.flatnonzero(np.diff(content)) + 1) if content.size else ():
                a, b = runs(offset[piece], length)
                spans[int(members[content[piece[0]]])] = list(zip(a.tolist(), b.tolist(), strict=True))
        copy = docs > least[same]  # an equal segment lies in a smaller document
        places: dict[int, tuple[list[int], list[int]]] = {}
        for w, p, chunk in zip(which.tolist(), place.tolist(), place_chunk.tolist(), strict=True):
            c = int(same[w])
            ranges = [(0, int(size[c]))] if copy[w] else spans.get(c, ())
            if ranges:
                a, b = places.setdefault(chunk, ([], []))
                a += [p + x for x, _ in ranges]
                b += [p + y for _, y in ranges]
        out += [(chunk, X.packed([np.array(a, "<i4"), np.array(b, "<i4")])) for chunk, (a, b) in places.items()]
        return out

    return answer


def deduplicate(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, text_md5) of every row; ``kept`` joins the remaining bytes.

    With ``as_text`` ``kept`` is a string, without the bytes of characters that a cut left incomplete, and ``text_md5``
    is that of the input text, so that rows of one id find their own result; else it is null.
    """
    chunks = X.chunked(docs, doc_id, text)
    count = X.buckets(docs.sparkSession)

    def finish(chunk: X.Chunk, answers: list[bytes]) -> pa.RecordBatch:
        size = chunk.buf.size
        # all answers of a chunk are added up at once: one pass over its bytes, not one for each bucket that answered
        spans = [X.unpacked(p, len(p) // 8, "<i4,<i4") for p in answers]
        starts, stops = (np.concatenate([x[i] for x in spans]) if spans else np.zeros(0, np.int32) for i in (0, 1))
        edge = np.bincount(starts, minlength=size + 1) - np.bincount(stops, minlength=size + 1)
        gone = np.cumsum(edge)[:size] > 0
        before = np.concatenate(([0], np.cumsum(gone)))
        n_bytes, n_removed = np.diff(chunk.off), np.diff(before[chunk.off])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = chunk.off[chunk.off < size]
        opens[inner] |= gone[inner]
        n_spans = np.diff(np.concatenate(([0], np.cumsum(opens)))[chunk.off])
        kept = chunk.buf[~gone].tobytes()
        cut = (chunk.off - before[chunk.off]).tolist()
        left = [kept[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        shown = pa.array([b.decode("utf-8", "ignore") for b in left], pa.string()) if as_text else pa.array(left, pa.binary())
        whole, edges = chunk.buf.tobytes() if as_text else b"", chunk.off.tolist()
        md5 = [hashlib.md5(whole[a:b]).hexdigest() if as_text else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [X.ids_out(chunk.ids), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], shown, pa.array(md5, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text_md5"],
        )

    found = X.stored(X.ask(X.post(chunks, lambda c: _lead_message(c, length, count)), _tagged(X.key_counts("<u2"), 0)))
    second = X.ask(X.reply(chunks, found, lambda c, answers: _second_message(c, length, answers, count), X.MESSAGE_SCHEMA), _tagged(X.repeated_marks(count), 1))
    messages = X.reply(chunks, found.unionByName(second), lambda c, answers: _segments(c, length, answers, count), X.MESSAGE_SCHEMA)
    late = X.ask(messages, _ranges(length))
    return X.reply(chunks, late, finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, text_md5 string")
