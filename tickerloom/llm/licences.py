"""License scans: a trained paragraph classifier whose predictions template comparison confirms.

A paragraph is a line (split at \\n) with a word; lines between blank ones form a block, and a notice may run over the
lines of its block.  Words are A-Z lowered, punctuation at their ends and words of marks only (comment marks) are
dropped; a line without any other word counts as blank.  Features are hashed word 1- to 3-grams; a sparse multinomial
logistic regression gives probabilities over the licence families, ``unknown`` (licence wording of no listed family)
and ``none``.  It is trained in numpy on noisy variants of public notice sentences and on paragraphs of a bounded
sample of the corpus (``train_docs``, a parameter) as ``none``; a temperature fitted on variants kept apart calibrates it.

A family stands if a line, or a passage of a block of at most twice a template's words and over any line breaks, holds
at least ``share`` of the template's word pairs and its probability reaches ``threshold``; of passages that overlap, the
one with the largest share of its template decides.  It stands too for a line that is only a title (``TITLES``) with
articles and numbers, and for an SPDX tag, whose every identifier counts.  A licence-like line outside such notices is
``unknown``, whatever its length; so is, once, a licence-like run of up to ``RUN`` lines of which none counted yet.

Per document: n_paragraphs, n_licensed (lines that hold part of a notice with a family), n_unknown, the sorted families,
and the family of the first notice.  Null and empty texts have no paragraphs, no families and a null first family.
Repeated rows give a row each.  Scoring is one pass without a shuffle over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays as A

# Public notice sentences by licence family; fixed values.
TEMPLATES = {
    "agpl": [
        "This program is free software under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "This work has been dedicated to the public domain under CC0 1.0 Universal."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
# Licence wording that names no family of the list; the marks stand for invented words.
OPEN_ENDED = [
    "{a} License", "Licensed under the {a} License.", "Distributed under the terms of the {a} {b} License, version 2.", "This file is licensed under {a} terms.",
    "Use of this {a} is subject to the {b} license agreement.", "Released under the {a} Public License.", "You may not copy or distribute this {a} without permission of the licensor.",
]
# Titles that fill a line, and the beginnings of SPDX identifiers (longer ones first where one begins another).
TITLES = {
    "agpl": ["GNU Affero General Public License", "Affero General Public License", "AGPL License"],
    "apache-2.0": ["Apache License", "Apache Software License"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License", "Modified BSD License"],
    "cc-by": ["CC BY", "CC BY License", "Creative Commons Attribution", "Creative Commons Attribution License", "Creative Commons Attribution International", "Creative Commons Attribution International License"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC License", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial International", "Creative Commons Attribution-NonCommercial International License"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA License", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike International", "Creative Commons Attribution-ShareAlike International License"],
    "cc0": ["CC0 Universal", "CC0 License", "Creative Commons CC0", "Creative Commons Zero"],
    "gpl": ["GNU General Public License", "General Public License", "GPL License", "GNU GPL"],
    "lgpl": ["GNU Lesser General Public License", "Lesser General Public License", "GNU Library General Public License", "LGPL License", "GNU LGPL"],
    "mit": ["MIT License", "MIT License MIT"],
    "mpl": ["Mozilla Public License", "MPL License"],
}
SPDX = {
    "agpl": r"agpl-\d.*", "apache-2.0": r"apache-2\.0", "bsd": r"(0bsd|bsd-\d-clause.*)", "cc-by": r"cc-by-\d.*", "cc-by-nc": r"cc-by-nc-\d.*", "cc-by-sa": r"cc-by-sa-\d.*",
    "cc0": r"cc0-1\.0", "gpl": r"gpl-\d.*", "lgpl": r"lgpl-\d.*", "mit": r"mit(-0)?", "mpl": r"mpl-\d.*",
}
_BESIDE = re.compile(r"the|version|v|.*\d.*|january|february|march|april|may|june|july|august|september|october|november|december")

FAMILIES = tuple(sorted(TEMPLATES))
CLASSES = (*FAMILIES, "unknown", "none")
BITS = 15
TRAIN_DOCS = 400
TRAIN_LINES = 20
THRESHOLD = 0.5
SHARE = 0.7
RUN = 4

_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]{}<>*#/|")] = True
_SAYS = np.zeros(256, bool)
_SAYS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Feature of every n consecutive words, by start."""
    return (A.mix(A.Spans(hashes).windows(n) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32)


class Lines:
    """Lines of some documents as words with hashes, without words of marks only; a line without a word is left out.

    ``counted`` holds the document of every line with any word, ``block`` the block of each line kept.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf = buf
        starts, ends, _ = A.words(buf, off)
        breaks = np.flatnonzero(buf == 10)

        def heads(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            line, doc = np.searchsorted(breaks, starts), np.searchsorted(off, starts, side="right") - 1
            new = np.concatenate(([True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))) if starts.size else np.zeros(0, bool)
            first = np.flatnonzero(new)
            return first, line[first], doc[first]

        self.counted = heads(starts)[2]
        for _ in range(4):  # up to four marks at either end of a word
            long = ends - starts > 1
            starts = starts + (long & _TRIM[buf[starts]])
            ends = ends - ((ends - starts > 1) & _TRIM[buf[ends - 1]])
        says = np.concatenate(([0], np.cumsum(_SAYS[buf])))
        keep = says[ends] > says[starts]
        self.starts, self.ends = starts[keep], ends[keep]
        first, line, self.doc = heads(self.starts)
        self.at = np.append(first, self.starts.size)
        apart = (line[1:] != line[:-1] + 1) | (self.doc[1:] != self.doc[:-1])
        self.block = np.concatenate((np.zeros(min(1, line.size), np.int64), np.cumsum(apart)))
        self.hash = A.word_hashes(A.LOWER[buf], self.starts, self.ends)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, line of each): hashed 1- to 3-grams inside a line."""
        own = A.owner(self.at)
        cols, rows = [], []
        for n in (1, 2, 3):
            at = A.window_starts(self.at, n)
            cols.append(_buckets(self.hash, n)[at])
            rows.append(own[at])
        return np.concatenate(cols), np.concatenate(rows)

    def words(self, i: int) -> list[str]:
        return [bytes(A.LOWER[self.buf[s:e]]).decode("utf-8", "replace") for s, e in zip(self.starts[self.at[i] : self.at[i + 1]].tolist(), self.ends[self.at[i] : self.at[i + 1]].tolist(), strict=True)]


def of_texts(texts: list[str]) -> Lines:
    return Lines(*A.flat(pa.array(texts, pa.string())))


class Templates:
    """Hashed word pairs of every template, its family and its number of words."""

    def __init__(self):
        self.family = np.array([f for f, name in enumerate(FAMILIES) for _ in TEMPLATES[name]])
        words = [of_texts([t]).hash for name in FAMILIES for t in TEMPLATES[name]]
        self.length = [w.size for w in words]
        self.pairs = [np.unique(A.Spans(w).windows(2)) for w in words]
        self.all = np.unique(np.concatenate(self.pairs))
        self.titles = {tuple(of_texts([t]).words(0)): FAMILIES.index(name) for name, ts in TITLES.items() for t in ts}
        self.title_ends = np.unique(np.concatenate([of_texts([t]).hash for ts in TITLES.values() for t in ts]))
        self.tag = of_texts(["SPDX-License-Identifier:"]).hash[0]
        self.spdx = [(FAMILIES.index(name), re.compile(p)) for name, p in SPDX.items()]

    def of_identifier(self, word: str) -> int | None:
        return next((f for f, p in self.spdx if p.fullmatch(word.rstrip("+"))), None)


class Classifier:
    def __init__(self):
        self.w = np.zeros((1 << BITS, len(CLASSES)), np.float32)
        self.bias = np.zeros(len(CLASSES), np.float32)
        self.bias[-1] = 4.0
        self.heat = 1.0

    def logits(self, cols: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(np.bincount(rows, minlength=n), 1)
        out = np.empty((n, len(CLASSES)))
        for k in range(len(CLASSES)):
            out[:, k] = np.bincount(rows, self.w[:, k][cols], minlength=n) / np.sqrt(count) + self.bias[k]
        return out

    def of_spans(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of spans of words, from running sums: O(1) a span."""
        out, count = np.zeros((starts.size, len(CLASSES))), np.zeros(starts.size, np.int64)
        for n in (1, 2, 3):
            cols = _buckets(hashes, n)
            lo = np.minimum(starts, cols.size)
            hi = np.maximum(np.minimum(ends - n + 1, cols.size), lo)
            count += hi - lo
            for k in range(len(CLASSES)):
                sums = np.concatenate(([0.0], np.cumsum(self.w[:, k][cols], dtype=np.float64)))
                out[:, k] += sums[hi] - sums[lo]
        return self.probabilities(out / np.sqrt(np.maximum(count, 1))[:, None] + self.bias)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = 12, rate: float = 0.5, batch: int = 128, seed: int = 9) -> None:
        lines = of_texts([re.sub(r"\s+", " ", t) for t in texts])
        y = y[lines.doc]
        cols, rows = lines.features()
        order = np.argsort(rows, kind="stable")
        cols, off = cols[order], np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=y.size))))
        rng = np.random.default_rng(seed)
        gw, gb = np.full(self.w.shape, 1e-3, np.float32), np.full(self.bias.shape, 1e-3, np.float32)
        apart = rng.random(y.size) < 0.2
        use = np.flatnonzero(~apart)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(use), max(1, use.size // batch)):
                n = off[part + 1] - off[part]
                own = np.repeat(np.arange(part.size), n)
                c = cols[np.repeat(off[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                e = self.probabilities(self.logits(c, own, part.size)).astype(np.float32)
                e[np.arange(part.size), y[part]] -= 1
                e /= part.size
                scaled = e / np.sqrt(np.maximum(n, 1))[:, None]
                used, back = np.unique(c, return_inverse=True)
                d = np.stack([np.bincount(back, scaled[own, k], minlength=used.size) for k in range(len(CLASSES))], 1).astype(np.float32) + 1e-5 * self.w[used]
                gw[used] += d * d
                self.w[used] -= rate * d / np.sqrt(gw[used])
                b = e.sum(0)
                gb += b * b
                self.bias -= 0.1 * rate * b / np.sqrt(gb)
        rest = np.flatnonzero(apart)
        if rest.size:
            n = off[rest + 1] - off[rest]
            own = np.repeat(np.arange(rest.size), n)
            c = cols[np.repeat(off[rest] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            z = self.logits(c, own, rest.size)
            heats = np.geomspace(0.25, 4, 33)
            loss = []
            for self.heat in heats:
                loss.append(-np.log(np.maximum(self.probabilities(z)[np.arange(rest.size), y[rest]], 1e-12)).mean())
            self.heat = float(heats[int(np.argmin(loss))])


def variants(seed: int = 4, each: int = 60) -> tuple[list[str], list[str]]:
    """Noisy copies of the templates with their classes: other words around, words lost, case changed."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(list(letters), rng.integers(2, 10)))
    texts, classes = [], []
    for family in FAMILIES:
        for t in TEMPLATES[family]:
            for i in range(each):
                w = t.split()
                if i and len(w) > 4 and rng.random() < 0.4:
                    del w[int(rng.integers(len(w)))]
                before, after = ([word() for _ in range(rng.integers(0, 6) * (rng.random() < 0.4))] for _ in range(2))
                s = " ".join([*before, *w, *after])
                texts.append(s.upper() if i and rng.random() < 0.1 else s)
                classes.append(family)
    for t in OPEN_ENDED:
        for _ in range(each * 2):
            texts.append(t.format(a=word().title(), b=word().title()))
            classes.append("unknown")
    return texts, classes


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Classifier:
    """Fitted on template variants and on at most ``train_docs`` * ``train_lines`` corpus lines without licence wording."""
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    ids = chosen.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    some = chosen.join(ids, "doc_id").select(F.slice(F.split("text", "\n"), 1, train_lines).alias("lines"))
    corpus = [line[:1000] for row in some.collect() for line in row["lines"]]
    wording = re.compile(r"licen|rights reserved|copyright|spdx|permission|public domain|\bcc\b", re.I)
    corpus = sorted({line for line in corpus if line.strip() and not wording.search(line)})
    corpus += sorted({" ".join(line.split()[:n]) for line in corpus for n in (1, 2)})
    texts, classes = variants()
    y = np.array([CLASSES.index(c) for c in classes] + [CLASSES.index("none")] * len(corpus))
    model = Classifier()
    model.fit(texts + corpus, y)
    return model


def _passages(lines: Lines, t: Templates, share: float) -> list[tuple[int, int, int, float]]:
    """(start, end, family, share held) of lines, and of passages inside blocks, that hold enough of a template."""
    n = lines.hash.size
    if n < 2:
        return []
    line = A.owner(lines.at)
    block = lines.block[line]
    key = A.Spans(lines.hash).windows(2)
    at = np.minimum(np.searchsorted(t.all, key), t.all.size - 1)
    hits = np.flatnonzero((t.all[at] == key) & (block[1:] == block[:-1]))
    found = []
    for pairs, length, family in zip(t.pairs, t.length, t.family.tolist(), strict=True):
        number = np.minimum(np.searchsorted(pairs, key[hits]), pairs.size - 1)
        own = pairs[number] == key[hits]
        pos, number = hits[own], number[own]
        need = share * pairs.size - 1e-9
        last = np.searchsorted(block, block[pos], side="right")
        inside = line[pos] == line[pos + 1]
        opens = inside & np.concatenate((np.ones(min(1, pos.size), bool), line[pos[1:]] != line[pos[:-1]]))
        passage = np.searchsorted(pos, np.minimum(pos + 2 * length, last))
        whole = np.searchsorted(pos, np.where(opens, lines.at[line[pos] + 1] - 1, pos))
        for end, as_line in ((passage, False), (whole, True)):
            for i in np.flatnonzero(end - np.arange(pos.size) >= need).tolist():
                held, first = np.unique(number[i : end[i]], return_index=True)
                if held.size >= need:
                    span = lines.at[line[pos[i]] : line[pos[i]] + 2] if as_line else (pos[i], pos[i + first.max()] + 2)
                    found.append((int(span[0]), int(span[1]), family, held.size / pairs.size))
    return found


def _tags(lines: Lines, t: Templates) -> list[tuple[int, int, int]]:
    """(start, end, family) of titles that fill a line and of identifiers of SPDX tags."""
    out = []
    size = np.diff(lines.at)
    known = np.add.reduceat(np.isin(lines.hash, t.title_ends), lines.at[:-1]) if size.size else size
    for i in np.flatnonzero((size < 14) & (known > 1)).tolist():
        words = lines.words(i)
        family = t.titles.get(tuple(words), t.titles.get(tuple(w for w in words if not _BESIDE.fullmatch(w))))
        if family is not None:
            out.append((int(lines.at[i]), int(lines.at[i + 1]), family))
    for p in np.flatnonzero(lines.hash == t.tag).tolist():
        i = int(np.searchsorted(lines.at, p, side="right")) - 1
        words = lines.words(i)[p - int(lines.at[i]) + 1 :]
        wanted = True
        for k, w in enumerate(words):
            if wanted:
                family = t.of_identifier(w)
                if family is not None:
                    out.append((p, p + k + 2, family))
            elif w not in ("or", "and", "with"):
                break
            wanted = not wanted
    return out


def _judge(lines: Lines, model: Classifier, t: Templates, threshold: float, share: float) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """((start, family) of the notices in order, lines that hold part of one, lines or first lines of runs that are unknown)."""
    n = lines.doc.size
    if not n:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    passages = _passages(lines, t, share)
    runs = [np.flatnonzero(lines.block[k:] == lines.block[: n - k]) for k in range(min(RUN, n))]
    starts = np.concatenate([lines.at[r] for r in runs] + [np.array([x[0] for x in passages], np.int64)])
    ends = np.concatenate([lines.at[r + k + 1] for k, r in enumerate(runs)] + [np.array([x[1] for x in passages], np.int64)])
    p = model.of_spans(lines.hash, starts, ends)
    kept = [(a, b, f, held, q) for (a, b, f, held), q in zip(passages, p[p.shape[0] - len(passages) :, :].tolist(), strict=True)]
    notices = _tags(lines, t)
    taken = np.zeros(lines.hash.size, bool)
    for a, b, _ in notices:
        taken[a:b] = True
    for a, b, f, _, q in sorted(kept, key=lambda x: (-x[3], x[1] - x[0], -x[4][x[2]], x[0], x[2])):
        if q[f] >= threshold and not taken[a:b].any():
            taken[a:b] = True
            notices.append((a, b, f))
    licensed = np.logical_or.reduceat(taken, lines.at[:-1])
    counted = licensed.copy()
    unknown = []
    done = 0
    for k, r in enumerate(runs):
        like = r[p[done : done + r.size, -1] < 1 - threshold]
        done += r.size
        for i in like.tolist():
            if not counted[i : i + k + 1].any():
                counted[i : i + k + 1] = True
                unknown.append(i)
    return sorted((a, f) for a, _, f in notices), np.flatnonzero(licensed), np.array(unknown, np.int64)


def scan(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, n_unknown, families, first_family) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            for part in A.slices(batch, "text"):
                lines = Lines(*A.flat(part.column("text")))
                notices, licensed, unknown = _judge(lines, model, templates, threshold, share)
                n = part.num_rows
                known: dict[int, list[int]] = {}
                for a, f in notices:
                    known.setdefault(int(lines.doc[np.searchsorted(lines.at, a, side="right") - 1]), []).append(f)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.bincount(lines.counted, minlength=n), pa.int64()),
                        pa.array(np.bincount(lines.doc[licensed], minlength=n), pa.int64()),
                        pa.array(np.bincount(lines.doc[unknown], minlength=n), pa.int64()),
                        pa.array([sorted({FAMILIES[f] for f in known.get(i, ())}) for i in range(n)], pa.list_(pa.string())),
                        pa.array([FAMILIES[known[i][0]] if known.get(i) else None for i in range(n)], pa.string()),
                    ],
                    names=["doc_id", "n_paragraphs", "n_licensed", "n_unknown", "families", "first_family"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_paragraphs long, n_licensed long, n_unknown long, families array<string>, first_family string")
