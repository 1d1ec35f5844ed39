"""Quality rules: fixed base rules, then a calibrated logistic regression over hashed n-grams.

Base counts are exact and per document.  The learned rule is a logistic regression whose features are the
mean over the text's words and over its character 4-grams (of bytes) of hashed weights, so its score is one
gather and one sum a document.  It is trained with AdaGrad in numpy on a bounded sample of labelled rows
(``train_rows``, a parameter), then calibrated: on rows kept out of the fit, a two-parameter logistic map of
the raw score is fitted by Newton steps, so the verdict compares a probability with a fixed threshold.

A document is kept if no base rule fails and its calibrated probability reaches ``threshold``.  Null and
empty texts have no words and fail the base rule of length.  Without labelled rows the probability is 0.5.
Scoring is one pass without a shuffle over whole texts, in Arrow slices of a few MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays as A
from tickerloom.llm.doc_stats import Slice
from tickerloom.llm.labelled import sample

WORD_BITS, CHAR_BITS, GRAM = 17, 17, 4
BUCKETS = (1 << WORD_BITS) + (1 << CHAR_BITS)
TRAIN_ROWS = 4000
THRESHOLD = 0.3
LEAST_STEPS = 600
MIN_WORDS = 50


def columns(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word columns, word offsets, gram columns, gram offsets); grams lie inside one document."""
    w = (s.word_hash >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    at = A.window_starts(s.off, GRAM)
    b = s.buf.astype(np.uint32)
    n = b.size - GRAM + 1
    packed = (b[:n] | (b[1 : n + 1] << 8) | (b[2 : n + 2] << 16) | (b[3 : n + 3] << 24)) if n > 0 else np.zeros(0, np.uint32)
    g = ((packed[at] * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)).astype(np.int32) + (1 << WORD_BITS)
    return w, s.at, g, np.searchsorted(at, s.off)


def _mean(weights: np.ndarray, cols: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[cols], dtype=np.float64)))
    return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off), 1)


class Regression:
    def __init__(self):
        self.w = np.zeros(BUCKETS, np.float32)
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0

    def raw(self, parts) -> np.ndarray:
        w, w_off, g, g_off = parts
        return self.bias + _mean(self.w, w, w_off) + _mean(self.w, g, g_off)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 2.0, batch: int = 32, seed: int = 5) -> None:
        """``docs``: (columns, mean values) of each row, as ``sparse`` gives them."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(docs), 1)))
        g, g0 = np.full(BUCKETS, 1e-4, np.float32), 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for s in range(0, len(docs), batch):
                rows = order[s : s + batch]
                size = np.array([docs[i][0].size for i in rows])
                c = np.concatenate([docs[i][0] for i in rows])
                x = np.concatenate([docs[i][1] for i in rows])
                own = np.repeat(np.arange(rows.size), size)
                raw = self.bias + np.bincount(own, self.w[c] * x, minlength=rows.size)
                e = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / rows.size
                used, back = np.unique(c, return_inverse=True)
                d = np.bincount(back, e[own] * x, minlength=used.size).astype(np.float32)
                g[used] += d * d
                self.w[used] -= rate * d / np.sqrt(g[used])
                g0 += float(e.sum()) ** 2
                self.bias -= 0.1 * float(e.sum()) / g0**0.5

    def calibrate(self, raw: np.ndarray, y: np.ndarray, steps: int = 30) -> None:
        """Two-parameter logistic map with smoothed targets, by damped Newton steps."""
        if raw.size == 0 or y.min() == y.max():
            return
        up, down = y.sum(), y.size - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            e, h = p - target, np.maximum(p * (1 - p), 1e-9)
            grad = np.array([(e * raw).sum(), e.sum()])
            hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if a > 0:
            self.slope, self.shift = float(a), float(b)


def sparse(w: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of one document and their mean values."""
    out = []
    for part in (w, g):
        c, n = np.unique(part, return_counts=True)
        out.append((c.astype(np.int32), (n / max(part.size, 1)).astype(np.float32)))
    return np.concatenate([c for c, _ in out]), np.concatenate([x for _, x in out])


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in A.slices(batch, "text"):
            w, w_off, g, g_off = columns(Slice(part.column("text")))
            cut = [sparse(w[w_off[i] : w_off[i + 1]], g[g_off[i] : g_off[i + 1]]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), pa.array([c.tobytes() for c, _ in cut], pa.binary()), pa.array([x.tobytes() for _, x in cut], pa.binary())], names=["doc_id", "y", "columns", "values"]
            )


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, train_rows: int = TRAIN_ROWS, label: str = "quality") -> Regression:
    """Fits on three quarters of the sample and calibrates on the rest; ids decide which row goes where."""
    import zlib

    rows = sample(docs, labels, label, F.lit(True) if usable is None else usable, train_rows, _training_rows, "columns binary, values binary")
    model = Regression()
    if not len(rows):
        return model
    data = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(rows["columns"], rows["values"], strict=True)]
    y = rows["y"].to_numpy(np.float64)
    apart = np.array([zlib.crc32(f"calibrate {i}".encode()) % 4 == 0 for i in rows["doc_id"]])
    if apart.all() or not apart.any():
        apart = np.zeros(len(rows), bool)
    fit = np.flatnonzero(~apart)
    model.fit([data[i] for i in fit], y[fit])
    rest = np.flatnonzero(apart)
    model.calibrate(np.array([model.bias + float(model.w[data[i][0]] @ data[i][1]) for i in rest]), y[rest])
    return model


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Regression, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, probability) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text"):
                s = Slice(part.column("text"))
                counts = [s.n_words, s.word_chars(), s.symbols(), s.duplicate_lines(), s.repeated_words()]
                failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > 50 * counts[0])
                p = model.probability(model.raw(columns(s)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p, pa.float64())],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "probability"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, probability double")


