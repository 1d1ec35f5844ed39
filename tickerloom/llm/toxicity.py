"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams of 3 to 6 bytes (A-Z lowered, with < and > at its ends) and
itself, each hashed to a row of one embedding table, so a misspelling that training never saw shares most
of its vectors with the word it stands for.  The embeddings of ``WINDOW`` consecutive words are averaged
and a linear softmax gives the window's probability; a document scores its worst window, so one insult in a
long text is not averaged away.  Embeddings and softmax are trained together: first on all windows with the
label of their document, then on the worst window of each document as the current model sees it (positives
must own one bad window, negatives none).  N-grams that fewer than ``MIN_DOCS`` sample documents hold stay zero.  As the softmax is linear, scoring folds table and weights into
one number per bucket.

Training uses a bounded, deterministic sample: at most ``train_rows`` labelled rows of each class and, for
fitting only, ``train_words`` first words of each.  Null and empty texts have no window and score the
softmax's prior for an empty bag, which is below one half.  Without labels of both classes every score is
that prior.  Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays as A
from tickerloom.llm.labelled import sample

BITS = 17
DIM = 8
WINDOW = 8
GRAMS = (3, 4, 5, 6)
TRAIN_ROWS = 1500
TRAIN_WORDS = 20_000
PRIOR = -3.0
MIN_DOCS = 5
SPANS_AT_ONCE = 50_000
LEAST_STEPS = 12


def subwords(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): hashed n-grams of <word> and of the word itself, for each span; spans go in blocks."""
    parts = [_subwords(buf, starts[i : i + SPANS_AT_ONCE], ends[i : i + SPANS_AT_ONCE]) for i in range(0, max(starts.size, 1), SPANS_AT_ONCE)]
    return np.concatenate([b for b, _ in parts]), np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in parts]))))


def _subwords(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = ends - starts + 2
    off = np.concatenate(([0], np.cumsum(size)))
    wrapped = np.empty(int(off[-1]), np.uint8)
    inside = np.ones(wrapped.size, bool)
    inside[off[:-1]] = False
    inside[off[1:] - 1] = False
    wrapped[off[:-1]], wrapped[off[1:] - 1] = 60, 62
    wrapped[inside] = A.LOWER[buf[np.repeat(starts - off[:-1] - 1, size)[inside] + np.flatnonzero(inside)]]
    spans = A.Spans(wrapped)
    word = np.arange(starts.size)
    rows, keys = [word], [spans(off[:-1], off[1:])]
    for n in GRAMS:
        at = A.window_starts(off, n)
        rows.append(A.owner(off)[at])
        keys.append(spans.windows(n)[at] + np.uint64(n))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    buckets = (A.mix(keys) >> np.uint64(64 - BITS)).astype(np.int32)[order]
    return buckets, np.bincount(rows, minlength=starts.size)


class Bags:
    """Words of some documents as distinct words with subword lists, and windows over them."""

    def __init__(self, column):
        buf, off = A.flat(column)
        starts, ends, at = A.words(buf, off)
        hashes = A.word_hashes(A.LOWER[buf], starts, ends)
        _, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.buckets, self.sub_off = subwords(buf, starts[first], ends[first])
        self.docs, n = off.size - 1, np.diff(at)
        per_doc = -(-n // WINDOW)
        self.win_doc = np.repeat(np.arange(self.docs), per_doc)
        base = np.concatenate(([0], np.cumsum(per_doc)))
        nth = np.arange(base[-1]) - base[self.win_doc]
        self.win_start = at[self.win_doc] + nth * WINDOW
        self.win_stop = np.minimum(self.win_start + WINDOW, at[self.win_doc + 1])
        self.doc_win = base

    def margins(self, scalar: np.ndarray, bias: float) -> np.ndarray:
        """Toxic minus clean logit of every window; ``scalar`` is one number per bucket."""
        total = np.concatenate(([0.0], np.cumsum(scalar[self.buckets], dtype=np.float64)))
        size = np.diff(self.sub_off)
        word = np.concatenate(([0.0], np.cumsum((total[self.sub_off[1:]] - total[self.sub_off[:-1]])[self.word])))
        count = np.concatenate(([0], np.cumsum(size[self.word])))
        return (word[self.win_stop] - word[self.win_start]) / np.maximum(count[self.win_stop] - count[self.win_start], 1) + bias

    def worst(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents with a window, their window of greatest margin)."""
        if not margins.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.lexsort((-margins, self.win_doc))
        head = np.flatnonzero(np.concatenate(([True], np.diff(self.win_doc[order]) > 0)))
        return self.win_doc[order[head]], order[head]

    def rare(self, least: int) -> np.ndarray:
        """Marks of the buckets that fewer than ``least`` documents hold."""
        n = np.diff(self.sub_off)
        first = np.full(1 << BITS, -1, np.int64)
        seen = np.zeros(1 << BITS, np.int64)
        doc_of = np.repeat(self.win_doc, self.win_stop - self.win_start)
        pairs = np.unique(doc_of << 32 | self.word)
        for part in np.array_split(pairs, max(1, pairs.size // 20_000)):
            words = part & 0xFFFFFFFF
            take = np.repeat(self.sub_off[words] - np.concatenate(([0], np.cumsum(n[words])[:-1])), n[words]) + np.arange(n[words].sum())
            both = np.unique(np.repeat(part >> 32, n[words]) << BITS | self.buckets[take])
            docs, b = both >> BITS, both & ((1 << BITS) - 1)
            new = first[b] != docs  # a document cut between two parts counts once where it was seen last
            np.add.at(seen, b[new], 1)
            first[b] = docs
        return seen < least

    def subwords_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, window number) of the subwords of some windows."""
        n = self.win_stop[windows] - self.win_start[windows]
        own = np.repeat(np.arange(windows.size), n)
        words = self.word[np.repeat(self.win_start[windows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        m = self.sub_off[words + 1] - self.sub_off[words]
        take = np.repeat(self.sub_off[words] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        return self.buckets[take], np.repeat(own, m)


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
        self.soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.array([-PRIOR / 2, PRIOR / 2], np.float32)
        self.rare = np.zeros(1 << BITS, bool)

    def scalar(self) -> tuple[np.ndarray, float]:
        return self.table @ (self.soft[:, 1] - self.soft[:, 0]), float(self.bias[1] - self.bias[0])

    def step(self, buckets: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> None:
        """One AdaGrad step of table and softmax together on some windows."""
        n = np.maximum(np.bincount(own, minlength=y.size), 1).astype(np.float32)
        rows = self.table[buckets]
        mean = np.stack([np.bincount(own, rows[:, f], minlength=y.size) for f in range(DIM)], 1).astype(np.float32) / n[:, None]
        logits = mean @ self.soft + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        e = p.copy()
        e[np.arange(y.size), y] -= 1
        e *= weight[:, None] / weight.sum()
        back = (e @ self.soft.T) / n[:, None]
        used, at = np.unique(buckets, return_inverse=True)
        d = np.stack([np.bincount(at, back[own, f], minlength=used.size) for f in range(DIM)], 1).astype(np.float32)
        ds, db = mean.T @ e, e.sum(0)
        state["table"][used] += d * d
        state["soft"] += ds * ds
        state["bias"] += db * db
        self.table[used] -= rate * d / np.sqrt(state["table"][used]) * ~self.rare[used][:, None]
        self.soft -= 0.1 * rate * ds / np.sqrt(state["soft"])
        self.bias -= 0.1 * rate * db / np.sqrt(state["bias"])

    def fit(self, bags: Bags, y: np.ndarray) -> None:
        """Fits twice: a model of each half of the sample first reads the other half, and rows of label 1 in
        which it finds no bad window at all (labels without a cause in the text) are left out of the final fit."""
        if not y.size or y.min() == y.max():
            return
        half = np.random.default_rng(11).random(y.size) < 0.5
        doubt = np.zeros(y.size, bool)
        for side in (half, ~half):
            if y[side].min(initial=1) < y[side].max(initial=0):
                other = Model()
                other._fit(bags, y, side, warm=1, rounds=4)
                doubt |= ~side & (y == 1) & (other.score(bags) < 0.5)
        self._fit(bags, y, ~doubt if (y[~doubt] == 1).any() else np.ones(y.size, bool))

    def _fit(self, bags: Bags, y: np.ndarray, use: np.ndarray, warm: int = 2, rounds: int = 14, rate: float = 0.3, batch: int = 256, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.rare = bags.rare(MIN_DOCS)
        self.table[self.rare] = 0
        state = {"table": np.full(self.table.shape, 1e-8, np.float32), "soft": np.full(self.soft.shape, 1e-4, np.float32), "bias": np.full(2, 1e-4, np.float32)}
        share = np.where(y[bags.win_doc] == 1, 1.0, 0.25) * use[bags.win_doc]
        for turn in range(warm + rounds):
            if turn < warm:
                chosen = np.flatnonzero(rng.random(share.size) < np.minimum(share, 40_000 / max(share.sum(), 1)))
            else:
                chosen = bags.worst(bags.margins(*self.scalar()))[1]
                extra = rng.integers(0, bags.win_doc.size, chosen.size)
                chosen = np.concatenate((chosen, extra[y[bags.win_doc[extra]] == 0]))
                chosen = chosen[use[bags.win_doc[chosen]]]
            label = y[bags.win_doc[chosen]]
            weight = np.where(label == 1, 0.5 / max((label == 1).mean(), 1e-6), 0.5 / max((label == 0).mean(), 1e-6)).astype(np.float32)
            order = np.concatenate([rng.permutation(chosen.size) for _ in range(max(1, LEAST_STEPS * batch // max(chosen.size, 1)))])
            for s in range(0, order.size, batch):
                part = order[s : s + batch]
                self.step(*bags.subwords_of(chosen[part]), label[part], weight[part], state, rate)

    def score(self, bags: Bags) -> np.ndarray:
        scalar, bias = self.scalar()
        worst = np.full(bags.docs, min(bias, PRIOR))
        docs, at = bags.worst(m := bags.margins(scalar, bias))
        worst[docs] = m[at]
        return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in A.slices(batch, "text"):
            texts = [" ".join((t or "").split(maxsplit=TRAIN_WORDS)[:TRAIN_WORDS]) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(texts, pa.string())], names=["doc_id", "y", "words"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS, label: str = "toxic") -> Model:
    """A model fitted on at most ``train_rows`` labelled rows of each class for which ``usable`` holds."""
    model = Model()
    frame = sample(docs, labels, label, usable, train_rows, _first_words, "words string", each_class=True)
    if len(frame):
        model.fit(Bags(pa.array(frame["words"], pa.string())), frame["y"].to_numpy(np.int64))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(Bags(part.column("text"))), pa.float64())], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")
