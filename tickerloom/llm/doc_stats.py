"""Per-document counts of an Arrow slice, all in numpy over bytes."""

from __future__ import annotations

import numpy as np

from tickerloom.llm import arrays as A

SYMBOLS = b"#*$%&|<>"  # fixed value of the rule


class Slice:
    """Words, hashes and counts of the documents of one slice."""

    def __init__(self, column):
        self.buf, self.off = A.flat(column)
        self.docs = self.off.size - 1
        self.starts, self.ends, self.at = A.words(self.buf, self.off)
        self.bytes_hash = A.Spans(self.buf)
        self.word_hash = self.bytes_hash(self.starts, self.ends)
        self.n_words = np.diff(self.at)
        self.word_doc = A.owner(self.at)

    def per_doc(self, marks: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sum of marks inside each document's span of offsets."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[off[1:]] - total[off[:-1]]

    def of_bytes(self, table: np.ndarray) -> np.ndarray:
        return self.per_doc(table[self.buf], self.off)

    def word_chars(self) -> np.ndarray:
        """Code points inside words: bytes that are neither spaces nor continuation bytes."""
        return self.of_bytes(_CHAR)

    def symbols(self) -> np.ndarray:
        return self.of_bytes(_SYMBOL)

    def duplicate_lines(self) -> np.ndarray:
        """Lines (split at \\n) with a word that equal an earlier line of the same document."""
        breaks = np.flatnonzero(self.buf == 10)
        starts = np.union1d(self.off[:-1], breaks + 1)
        inside = np.searchsorted(self.off, starts, side="right") - 1
        starts, inside = starts[inside < self.docs], inside[inside < self.docs]
        stop = np.searchsorted(breaks, starts)
        ends = np.minimum(np.append(breaks, self.buf.size)[stop], self.off[inside + 1])
        filled = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends, inside = starts[filled], ends[filled], inside[filled]
        _, later = A.repeats(inside, self.bytes_hash(starts, ends))
        return np.bincount(inside[later], minlength=self.docs)

    def repeated_words(self, n: int = 3) -> np.ndarray:
        """Words that lie in an n-word window found twice or more in the document, the first found included."""
        at = A.window_starts(self.at, n)
        hashes = A.Spans(self.word_hash).windows(n)
        repeated, _ = A.repeats(self.word_doc[at], hashes[at])
        return self.per_doc(A.covered(self.word_hash.size, at[repeated], n), self.at)


_CHAR = np.ones(256, np.int64)
_CHAR[128:192] = 0
_CHAR[[32, 9, 10, 11, 12, 13]] = 0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(b"!?.,;:")] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = 1
_LETTER[97:123] = 1
_LETTER[192:] = 1
_LINE = np.zeros(256, np.int64)
_LINE[10] = 1
_EXCLAIM = np.zeros(256, np.int64)
_EXCLAIM[33] = 1
_URLISH = np.zeros(256, np.int64)
_URLISH[list(b"/@_=\\{}[]")] = 1


def structure(s: Slice) -> np.ndarray:
    """Bounded structure and metadata statistics of every document: shares in [0, 1] and log lengths."""
    size = np.maximum(np.diff(s.off), 1).astype(float)
    n = np.maximum(s.n_words, 1).astype(float)
    chars = s.word_chars()
    order, bounds = A.groups(A.mix(s.word_hash + s.word_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    distinct = np.bincount(s.word_doc[order[bounds[:-1]]], minlength=s.docs) if s.word_hash.size else np.zeros(s.docs)
    lines = s.of_bytes(_LINE) + 1.0
    return np.stack(
        [
            np.ones(s.docs),
            np.log1p(s.n_words) / 10,
            np.log1p(np.diff(s.off)) / 12,
            np.minimum(chars / n, 20) / 20,
            s.symbols() / size,
            s.of_bytes(_UPPER) / size,
            s.of_bytes(_DIGIT) / size,
            s.of_bytes(_MARK) / size,
            s.of_bytes(_LETTER) / size,
            s.of_bytes(_EXCLAIM) / size,
            s.of_bytes(_URLISH) / size,
            s.duplicate_lines() / lines,
            s.repeated_words() / n,
            distinct / n,
            np.minimum(lines / n, 1.0),
            (s.n_words < 50) * 1.0,
        ],
        1,
    ).astype(np.float32)


STRUCTURE = 16
