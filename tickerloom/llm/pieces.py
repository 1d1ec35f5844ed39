"""The tokenizers library over Arrow buffers: texts are cut into the vocabulary's pieces by array operations on their bytes, and the
library is asked once for each distinct piece that the worker has not met.

The cut is that of ``bpe.SPLIT``: contractions, runs of letters, of digits and of other characters, each with one space before it, and
white space.  Classes of characters beyond ASCII come from the same pattern library, once for each character met.  A piece of up to 15
bytes is two words that hold its bytes and its length, so equal words are equal pieces; longer pieces are keys of a dictionary.
"""

from __future__ import annotations

import numpy as np
import regex

from tickerloom.llm import bpe

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
KEPT = 2_000_000  # entries after which a worker starts anew
ASKED = 4_096  # pieces in one call of the library
_U = np.uint64
_KINDS = ((SPACE, regex.compile(r"\s")), (LETTER, regex.compile(r"\p{L}")), (DIGIT, regex.compile(r"\p{N}")))
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def kind_of(char: str) -> int:
    return next((k for k, pattern in _KINDS if pattern.fullmatch(char)), OTHER)


class Pieces:
    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.own = bpe.Bpe(text)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kinds[:128] = [kind_of(chr(c)) for c in range(128)]
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << 16, -1, np.int32)
        self.key0, self.key1, self.first, self.size = (np.zeros(1 << 12, t) for t in (_U, _U, np.int64, np.int32))
        self.entries, self.used, self.pool, self.long = 0, 0, np.zeros(1 << 14, np.int32), {}

    # --- cutting --------------------------------------------------------------------------------

    def classes(self, buf: np.ndarray) -> np.ndarray:
        """The class of each byte's character; ``buf`` ends in zero bytes."""
        kinds = self.kinds[:256][buf]
        lead = np.flatnonzero(buf >= 0xC0)
        if lead.size:
            a, b, c, d = (buf[lead + i].astype(np.int64) & 63 for i in range(4))
            three, four = buf[lead] >= 0xE0, buf[lead] >= 0xF0
            point = np.where(four, (a & 7) << 18 | b << 12 | c << 6 | d, np.where(three, (a & 15) << 12 | b << 6 | c, (a & 31) << 6 | b))
            kind = self.kinds[point]
            if (kind == UNKNOWN).any():
                for p in np.unique(point[kind == UNKNOWN]).tolist():
                    self.kinds[p] = kind_of(chr(p))
                kind = self.kinds[point]
            kinds[lead], kinds[lead + 1] = kind, kind
            kinds[lead[three] + 2] = kind[three]
            kinds[lead[four] + 3] = kind[four]
        return kinds

    def cut(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pieces of all documents begin; ``buf`` ends in at least 16 zero bytes beyond the last document."""
        n = int(off[-1])
        kinds = self.classes(buf)
        begins = np.ones(n + 4, bool)
        begins[1:n] = kinds[1:n] != kinds[: n - 1] if n else False
        opening = np.zeros(n + 4, bool)
        opening[off] = True
        # the last white space before other text stands alone, and a plain space goes with that text
        after = np.flatnonzero((kinds[1:n] != SPACE) & (kinds[: max(n - 1, 0)] == SPACE) & ~opening[1:n]) + 1
        plain = buf[after - 1] == 32
        begins[after[plain]] = False
        back = after - 1
        for _ in range(3):
            back -= (buf[back] & 0xC0) == 0x80
        begins[back] = True
        begins[: n + 1] |= opening[: n + 1]
        # contractions begin at an apostrophe that begins a piece
        mark = np.flatnonzero((buf[:n] == 39) & begins[:n])
        ends = np.flatnonzero(opening)
        stop = ends[np.searchsorted(ends, mark, "right")] if mark.size else mark
        for ending in _ENDINGS:
            fits = mark + len(ending) < stop
            for i, letter in enumerate(ending):
                fits &= buf[mark + 1 + i] == letter
            begins[mark[fits] + 1] = False
            begins[mark[fits] + 1 + len(ending)] = True
        begins = begins[:n]
        for content in self.own.added:
            self._recut(buf, off, begins, content.encode())
        return np.flatnonzero(begins)

    def _recut(self, buf: np.ndarray, off: np.ndarray, begins: np.ndarray, content: bytes) -> None:
        """Documents that hold an added token are cut by the pattern, piece by piece."""
        data, done = memoryview(buf).tobytes(), -1
        at = data.find(content)
        while at >= 0:
            d = int(np.searchsorted(off, at, "right")) - 1
            if d != done:
                begins[off[d] : off[d + 1]] = False
                place = int(off[d])
                for piece in self.own.pieces(data[off[d] : off[d + 1]].decode()):
                    if piece:
                        begins[place] = True
                        place += len(piece.encode())
                done = d
            at = data.find(content, at + 1)

    # --- entries --------------------------------------------------------------------------------

    def _slots(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        h = key0 * _U(0x9E3779B97F4A7C15) ^ key1 * _U(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> _U(29)) * _U(0xBF58476D1CE4E5B9)
        return (h >> _U(65 - self.table.size.bit_length())).astype(np.int64)

    def _find(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where it has none."""
        slot = self._slots(key0, key1)
        found = self.table[slot]
        other = np.flatnonzero((found >= 0) & ((self.key0[found] != key0) | (self.key1[found] != key1)))
        while other.size:
            slot[other] = (slot[other] + 1) & (self.table.size - 1)
            entry = self.table[slot[other]]
            found[other] = entry
            other = other[(entry >= 0) & ((self.key0[entry] != key0[other]) | (self.key1[entry] != key1[other]))]
        return found

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slots(self.key0[entries], self.key1[entries])
        while entries.size:
            free = self.table[slot] < 0
            self.table[slot[free]] = entries[free]
            left = self.table[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (self.table.size - 1)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """New entries with the ids that the library gives each piece."""
        ids, sizes = [], []
        for s in range(0, len(pieces), ASKED):
            some = [p.decode() for p in pieces[s : s + ASKED]]
            told = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(told.ids, np.int32))
            sizes.append(np.bincount(np.array(told.word_ids, np.int64), minlength=len(some)))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        n, used = self.entries + sizes.size, self.used + ids.size
        if n > self.first.size:
            self.key0, self.key1, self.first, self.size = (np.concatenate((a[: self.entries], np.zeros(2 * n - self.entries, a.dtype))) for a in (self.key0, self.key1, self.first, self.size))
        if used > self.pool.size:
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(2 * used - self.used, np.int32)))
        new = np.arange(self.entries, n)
        self.pool[self.used : used] = ids
        self.first[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.entries, self.used = n, used
        return new

    def _short(self, view: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
        key0 = view[starts] & _MASK[np.minimum(sizes, 8)]
        key1 = view[starts + 8] & _MASK[np.clip(sizes - 8, 0, 7)] | sizes.astype(_U) << _U(56)
        found = self._find(key0, key1)
        fresh = np.flatnonzero(found < 0)
        if fresh.size:
            order = fresh[np.lexsort((key1[fresh], key0[fresh]))]
            differs = np.concatenate(([True], (key0[order[1:]] != key0[order[:-1]]) | (key1[order[1:]] != key1[order[:-1]])))
            one = order[differs]
            new = self._add([data[s : s + k].tobytes() for s, k in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)])
            self.key0[new], self.key1[new] = key0[one], key1[one]
            if 2 * self.entries > self.table.size:
                self.table = np.full(1 << (4 * self.entries).bit_length(), -1, np.int32)
                new = np.flatnonzero(self.key1[: self.entries])  # entries of long pieces have no key
            self._place(new.astype(np.int32))
            found[order] = self._find(key0[order], key1[order])
        return found

    def encode(self, buf: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, their numbers); ``end`` follows each document."""
        if self.entries > KEPT or self.used > 8 * KEPT:
            self.clear()
        buf = np.concatenate((buf, np.zeros(24, np.uint8)))
        starts = self.cut(buf, off)
        sizes = np.diff(starts, append=off[-1])
        view = np.ndarray((buf.size - 7,), "<u8", buf, 0, (1,))
        entry = np.empty(starts.size, np.int64)
        short = sizes < 16
        entry[short] = self._short(view, starts[short], sizes[short], buf)
        wide = np.flatnonzero(~short)
        if wide.size:
            pieces = [buf[s : s + k].tobytes() for s, k in zip(starts[wide].tolist(), sizes[wide].tolist(), strict=True)]
            fresh = list({p for p in pieces if p not in self.long})
            if fresh:
                self.long.update(zip(fresh, self._add(fresh).tolist(), strict=True))
            entry[wide] = [self.long[p] for p in pieces]
        # the ids of entry after entry, and one place after the last entry of each document
        at = np.searchsorted(starts, off)
        docs = np.arange(off.size - 1)
        place = np.arange(starts.size) + np.repeat(docs, np.diff(at))
        count, first = np.ones(starts.size + docs.size, np.int64), np.zeros(starts.size + docs.size, np.int64)
        count[place], first[place] = self.size[entry], self.first[entry]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(first - total + count, count) + np.arange(total[-1] if total.size else 0)]
        last = total[at[1:] + docs]
        ids[last - 1] = end
        return ids, np.diff(last, prepend=0)
