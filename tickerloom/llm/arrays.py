"""Vectorised text primitives for Arrow batches: words, hashes of spans, groups inside documents.

Texts stay UTF-8 bytes in one buffer with document offsets.  A null text counts as empty.  Words are
maximal runs of bytes other than 0x20 and 0x09-0x0D; none of those occurs inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_STEP = 1 << 18


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    a = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of at most ``limit`` text bytes; a longer text is a run of its own."""
    sizes = np.diff(flat(batch.column(column))[1]) + 16
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total + size > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, at): word spans of all documents; the words of document d are at[d]:at[d + 1]."""
    inside = ~_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < buf.size)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or have[0].size < n:
        size = -(-n // _STEP) * _STEP
        base = _BASE[kind]
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = (both[0], both[1])
        if size <= 4 << 20:
            _POWERS[kind] = have
    return have


class Spans:
    """Hashes of any spans of a sequence from one running sum: O(1) a span, two independent kinds."""

    def __init__(self, values: np.ndarray, kind: int = 0):
        self.powers, self.inverse = _powers(values.size + 1, kind)
        self.sums = np.zeros(values.size + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.powers[: values.size], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def windows(self, n: int) -> np.ndarray:
        """Hash of every n consecutive values, by start."""
        count = self.sums.size - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:count]) * self.inverse[:count])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hashes of sorted, disjoint spans; long buffers go piece by piece, as a span's hash does not depend on its place."""
    if buf.size <= 2 * SLICE_BYTES:
        return Spans(buf, kind)(starts, ends)
    cuts = np.searchsorted(starts, np.arange(0, buf.size + SLICE_BYTES, SLICE_BYTES))
    out = [np.zeros(0, np.uint64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            lo, hi = int(starts[a]), int(ends[b - 1])
            out.append(Spans(buf[lo:hi], kind)(starts[a:b] - lo, ends[a:b] - lo))
    return np.concatenate(out)


def owner(at: np.ndarray) -> np.ndarray:
    """The document number of each element of a list of offsets."""
    return np.repeat(np.arange(at.size - 1), np.diff(at))


def window_starts(at: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive elements lie inside one document."""
    total = int(at[-1])
    last = np.repeat(at[1:], np.diff(at))
    return np.flatnonzero(np.arange(total) + n <= last)


def covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Boolean marks of all positions that lie in [s, s + n) for one of the starts."""
    steps = np.bincount(starts, minlength=size + n + 1)[: size + n + 1].astype(np.int64)
    ends = np.zeros_like(steps)
    ends[n:] = steps[:-n]
    return np.cumsum(steps - ends)[:size] > 0


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): equal keys are order[bounds[i]:bounds[i + 1]]."""
    order = np.argsort(keys)
    k = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if k.size else np.zeros(0, np.int64)
    return order, np.append(heads, k.size)


def repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, later): equal elements of one document; ``later`` leaves out the first of each group."""
    order, bounds = groups(mix(hashes + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    sizes = np.diff(bounds)
    repeated = np.zeros(hashes.size, bool)
    later = np.zeros(hashes.size, bool)
    if hashes.size:
        many = np.repeat(sizes > 1, sizes)
        repeated[order] = many
        later[order] = many
        later[np.minimum.reduceat(order, bounds[:-1])] = False
    return repeated, later
