"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]).  The bracket is the
sum of all pairwise products <v_i, v_j> x_i x_j in time linear in the number of features.  Words are hashed
to ``BUCKETS`` columns with values count / |counts|; structure statistics are shares and log lengths of the
whole text.  Training is AdaGrad on mini-batches in numpy over a bounded sample of labelled rows
(``train_rows``, a parameter); the model has a fixed size (about 2.5 MB) and travels with the task.

Null and empty texts have no words and zero statistics; they get the score of that input.  Without any
labelled row the model is untrained and every score is 0.5; with one class only, the bias carries it.
Scoring is one pass without a shuffle, in slices of whole texts of a quarter of a MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays as A
from tickerloom.llm.doc_stats import STRUCTURE, Slice, structure
from tickerloom.llm.labelled import sample

BUCKETS = 1 << 16
FACTORS = 8
TRAIN_ROWS = 6000
LEAST_STEPS = 600
SLICE_BYTES = 256 << 10  # arrays of a slice take some fifty times its bytes


def features(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, columns, values) of the documents of a slice, rows in CSR form."""
    key = (s.word_doc.astype(np.uint64) << np.uint64(16)) | (s.word_hash >> np.uint64(48))
    key.sort()
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else np.zeros(0, np.int64)
    count = np.diff(np.append(head, key.size)).astype(np.float32)
    doc, column = (key[head] >> np.uint64(16)).astype(np.int64), (key[head] & np.uint64(0xFFFF)).astype(np.int64)
    norm = np.sqrt(np.bincount(doc, count * count, minlength=s.docs)).astype(np.float32)
    value = count / np.maximum(norm[doc], 1e-9)
    stats = structure(s)
    rows = np.concatenate((doc, np.repeat(np.arange(s.docs), STRUCTURE)))
    columns = np.concatenate((column, BUCKETS + np.tile(np.arange(STRUCTURE), s.docs)))
    values = np.concatenate((value, stats.ravel()))
    order = np.argsort(rows, kind="stable")
    off = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=s.docs))))
    return off, columns[order].astype(np.int32), values[order].astype(np.float32)


class Machine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0 = np.float32(0)
        self.w = np.zeros(BUCKETS + STRUCTURE, np.float32)
        self.v = rng.normal(0, 0.01, (BUCKETS + STRUCTURE, FACTORS)).astype(np.float32)

    def raw(self, off: np.ndarray, columns: np.ndarray, values: np.ndarray):
        v = self.v[columns] * values[:, None]
        at = off[:-1]  # every row has its structure columns, so no row is empty
        total = np.add.reduceat(v, at, axis=0)
        pairs = 0.5 * (total * total - np.add.reduceat(v * v, at, axis=0)).sum(1)
        return self.w0 + np.add.reduceat(self.w[columns] * values, at) + pairs, total, v

    def score(self, off, columns, values) -> np.ndarray:
        if off.size < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(off, columns, values)[0].astype(float), -30, 30)))

    def fit(self, off, columns, values, y, epochs: int = 10, rate: float = 0.1, penalty: float = 1e-4, batch: int = 64, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = y.size
        epochs = max(epochs, -(-LEAST_STEPS * batch // n))
        gw, gv, g0 = np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(n)
            for s in range(0, n, batch):
                rows = order[s : s + batch]
                sizes = off[rows + 1] - off[rows]
                at = np.concatenate(([0], np.cumsum(sizes)))
                take = np.repeat(off[rows] - at[:-1], sizes) + np.arange(at[-1])
                c, x = columns[take], values[take]
                raw, total, v = self.raw(at, c, x)
                e = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]).astype(np.float32) / rows.size
                each = np.repeat(e, sizes) * x
                own = np.repeat(np.arange(rows.size), sizes)
                used, back = np.unique(c, return_inverse=True)
                dw = np.bincount(back, each, minlength=used.size).astype(np.float32) + penalty * self.w[used]
                dv = penalty * self.v[used]
                grad = each[:, None] * (total[own] - v)
                for f in range(FACTORS):
                    dv[:, f] += np.bincount(back, grad[:, f], minlength=used.size)
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                d0 = float(e.sum())
                g0 += d0 * d0
                self.w0 -= np.float32(rate * d0 / np.sqrt(g0))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in A.slices(batch, "text", SLICE_BYTES):
            off, columns, values = features(Slice(part.column("text")))
            cut = [(columns[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), pa.array([c for c, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())], names=["doc_id", "y", "columns", "values"]
            )


def train(docs: DataFrame, labels: DataFrame, usable, train_rows: int = TRAIN_ROWS, label: str = "quality") -> Machine:
    """A machine fitted on at most ``train_rows`` labelled rows for which the condition ``usable`` holds."""
    rows = sample(docs, labels, label, usable, train_rows, _feature_rows, "columns binary, values binary")
    machine = Machine()
    if len(rows):
        off = np.concatenate(([0], np.cumsum([len(b) // 4 for b in rows["columns"]])))
        columns = np.frombuffer(b"".join(rows["columns"]), np.int32)
        values = np.frombuffer(b"".join(rows["values"]), np.float32)
        machine.fit(off, columns, values, rows["y"].to_numpy(np.float32))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text", SLICE_BYTES):
                p = machine.score(*features(Slice(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, machine: Machine, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, columns unchanged; nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text", SLICE_BYTES):
                yield part.filter(pa.array(machine.score(*features(Slice(part.column("text")))) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
