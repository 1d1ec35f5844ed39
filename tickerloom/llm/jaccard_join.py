"""N-gram Jaccard join by token-combination prefixes: components of documents with similar shingle sets.

A document's set holds the hashes of its distinct five-word shingles (A-Z lower-cased; with fewer words its
whole sequence is the one shingle).  Two documents link when 100 * |intersection| >= 80 * |union|.

1. Filter.  Tokens whose hash lies in the lowest ``SAMPLED`` share of the hash range are counted over all
   documents in one exchange of distinct keys.  A linked document misses at most slack = n - ceil(0.8 n)
   of its tokens in its partner, so one that holds s sampled tokens sees at least s - slack of them in
   another set; every other document is settled without a link.  Most of a corpus ends here.  The sets that
   are left, each distinct one once, count all their tokens among themselves in a second exchange; a set that
   sees fewer than n - slack of them in another set is settled too, such as one that shares a long passage only.
2. Order.  Tokens are ordered by (number of left sets that hold them, hash): rare ones first.
3. Prefixes.  Tokens that no other set holds use up slack and are not indexed.  Rare tokens are a class that is
   indexed singly; those of more than ``FREQUENT`` sets fall into M classes by hash whose 2-combinations are
   indexed, those of more than ``HOT`` sets into M classes whose 3-combinations are.  The prefix is extended until
   sum over classes max(0, tokens - k + 1) reaches slack + 1: then any partner shares k tokens of some
   class with it, inside both prefixes.  M grows with the set size in levels; sets near a border index both
   levels, so any two sets that can link meet in one.  Sets under ``LEVEL_0`` tokens index single tokens.
4. Candidates and verification.  Sets that are equal are one node.  Nodes that share a signature are compared
   by exact intersection, unless their sizes and the numbers of tokens they see elsewhere rule a link out.  Only
   components are asked for, so a pair is compared only while its nodes lie in
   different components.  Each signature's nodes stand in order of company (how many nodes they meet in
   all); the first is the pivot all others are held against, each node with its most shared pivot first.
   Nodes of signatures that still span components are dealt to packs, those of a signature and component together.
   Two packs that share such a signature are compared once, by an index of their tokens, however many signatures
   they share: every pair is compared or connected, no cap ends this early.

Memory: a bucket or task holds a key once a chunk; a group is held in packs of bounded weight, two at a time.  Hot
pivots are split by Spark's skew join.  Components come from label propagation with pointer jumping on stored tables.

Defined cases: null, empty and wordless texts have an empty set, n_shingles 0, and are their own component.
Rows of one doc_id are one after another: each gives a row, all under that id.  A null id counts as the
largest and comes back as null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm import arrays as A
from tickerloom.llm import exchange as X
from tickerloom.llm.components import connected

WIDTH = 5
SHARE = 80
SAMPLED = 5 / 16
FREQUENT = 32
HOT = 1024
LEVEL_0 = 8
PACK = 1 << 18  # tokens of a pack of sets that are compared with another pack; a set weighs PACK_NODE more
PACK_NODE = 256

SET_SCHEMA = "f1 long, f2 long, n int, doc_id long, tokens binary"
PACK_SCHEMA = "chunk long, f1 binary, f2 binary, n binary, doc_id binary, tokens binary"
NODE_SCHEMA = "node long, f1 long, f2 long, n int, seen int, doc_id long, tokens binary, signatures array<long>"


class Sets:
    """Shingle sets of a chunk: tokens sorted by (document, token), with offsets."""

    def __init__(self, chunk: X.Chunk, width: int = WIDTH):
        low = A.LOWER[chunk.buf]
        starts, ends, at = A.words(low, chunk.off)
        words = A.word_hashes(low, starts, ends)
        spans = A.Spans(words)
        place = A.window_starts(at, width)
        doc = A.owner(at)[place]
        token = spans.windows(width)[place]
        n_words = np.diff(at)
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        doc = np.concatenate((doc, short))
        token = np.concatenate((token, spans(at[short], at[short + 1])))
        order = np.lexsort((token, doc))
        doc, token = doc[order], token[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))) if doc.size else np.zeros(0, bool)
        self.doc, self.token = doc[new], token[new]
        self.n = np.bincount(self.doc, minlength=chunk.ids.size)
        self.off = np.concatenate(([0], np.cumsum(self.n)))
        total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(A.mix(self.token + np.uint64(seed))))) for seed in (1, 2)]
        self.prints = np.stack([A.mix(t[self.off[1:]] - t[self.off[:-1]] + self.n.astype(np.uint64)) for t in total])

    def first_of_set(self) -> np.ndarray:
        """One document of this chunk for each distinct set."""
        _, at = np.unique(self.prints, axis=1, return_index=True)
        return np.sort(at)


def sampled(token: np.ndarray) -> np.ndarray:
    return token < np.uint64(int(SAMPLED * 2**64))


def slack_of(n, share: int = SHARE):
    """How many tokens of a set of n can be missing in a linked partner."""
    return n - -(-share * n // 100)


def levels(n: int) -> list[int]:
    """Numbers of frequent classes (0: single tokens) under which a set of n tokens is indexed."""
    out = [0] if n < LEVEL_0 * 5 // 4 else []
    m = 1
    while 8 * m <= n:
        if n < 8 * m * 5:
            out.append(m)
        m *= 4
    return out


def signatures(token: np.ndarray, count: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Signatures of one set; ``count`` says how many sets hold each token (under 2: no other one)."""
    order = np.lexsort((token, count))
    token, count = token[order], count[order]
    need = int(slack_of(token.size, share)) + 1
    out = []
    for m in levels(token.size):
        salt = np.uint64(m * 0x9E3779B9 + 1)
        if m == 0:
            out.append(A.mix(token[:need][count[:need] > 1] + salt))
            continue
        # classes: -2 unseen, -1 rare, 0 .. m-1 frequent (pairs), m .. 2m-1 hot (triples)
        kind = (A.mix(token) % np.uint64(m)).astype(np.int64) + m * (count > HOT)
        kind = np.where(count < 2, -2, np.where(count <= FREQUENT, -1, kind))
        order = np.argsort(kind, kind="stable")
        head = np.searchsorted(kind[order], kind[order])
        nth = np.empty(kind.size, np.int64)
        nth[order] = np.arange(kind.size) - head
        adds = nth >= np.select([kind < 0, kind < m], [0, 1], 2)
        length = int(np.searchsorted(np.cumsum(adds), need)) + 1
        t, k = token[:length], kind[:length]
        out.append(A.mix(t[k == -1] + salt))
        for c in np.unique(k[k >= 0]):
            own = np.sort(t[k == c])
            if own.size > 1 and c < m:
                i, j = np.triu_indices(own.size, 1)
                out.append(A.mix(A.mix(own[i] + salt) + own[j]))
            elif own.size > 2 and c >= m:
                i, j, l = np.array(list(combinations(range(own.size), 3))).T
                out.append(A.mix(A.mix(A.mix(own[i] + salt) + own[j]) + own[l]))
    return np.unique(np.concatenate(out))


def _survivors(chunk: X.Chunk, answers: list[bytes], share: int) -> pa.RecordBatch:
    """The sets of a chunk that see enough of their sampled tokens elsewhere, each once."""
    sets = Sets(chunk)
    known, _ = _counted(answers)
    inside = sampled(sets.token)
    s = np.bincount(sets.doc[inside], minlength=sets.n.size)
    seen = np.bincount(sets.doc[X.member(sets.token, known) & inside], minlength=sets.n.size)
    out: list[list] = [[], [], [], [], []]
    for d in sets.first_of_set().tolist():
        n = int(sets.n[d])
        if n == 0 or seen[d] < s[d] - slack_of(n, share):
            continue
        same = (sets.prints == sets.prints[:, d : d + 1]).all(0)
        row = (int(sets.prints[0, d].view(np.int64)), int(sets.prints[1, d].view(np.int64)), n, int(chunk.ids[same].min()), sets.token[sets.off[d] : sets.off[d + 1]].tobytes())
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["f1", "f2", "n", "doc_id", "tokens"])


def _counted(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and totals of a chunk's answers."""
    parts = [X.unpacked(p, len(p) // 12, "<u8,<u4") for p in answers]
    known = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    times = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    order = np.argsort(known)
    return known[order], times[order]


class Pack:
    """Distinct sets of one row: fingerprints, sizes, ids and tokens."""

    def __init__(self, row: dict):
        self.key = row["chunk"]
        self.f1, self.f2, self.doc_id = (np.frombuffer(row[c], np.int64) for c in ("f1", "f2", "doc_id"))
        self.n = np.frombuffer(row["n"], np.int32)
        self.off = np.concatenate(([0], np.cumsum(self.n, dtype=np.int64)))
        self.token = np.frombuffer(row["tokens"], np.uint64)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    key, held, size = TaskContext.get().partitionId() << 20, [], 0

    def pack() -> pa.RecordBatch:
        columns = [np.array([r[i] for r in held], kind).tobytes() for i, kind in enumerate((np.int64, np.int64, np.int32, np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *[pa.array([c], pa.binary()) for c in (*columns, b"".join(r[4] for r in held))]], names=["chunk", "f1", "f2", "n", "doc_id", "tokens"])

    for row in X.rows_of(batches):
        if held and size + len(row["tokens"]) > X.CHUNK_BYTES:
            yield pack()
            key, held, size = key + 1, [], 0
        held.append((row["f1"], row["f2"], row["n"], row["doc_id"], row["tokens"]))
        size += len(row["tokens"])
    if held:
        yield pack()


def _nodes(pack: Pack, answers: list[bytes], share: int) -> pa.RecordBatch:
    """The sets of a pack that see enough of their tokens in other sets, with signatures."""
    known, times = _counted(answers)
    count = np.ones(pack.token.size, np.int64)
    hit = X.member(pack.token, known)
    count[hit] = times[np.searchsorted(known, pack.token[hit])]
    seen = np.bincount(A.owner(pack.off), weights=hit, minlength=pack.n.size).astype(np.int32)
    kept = np.flatnonzero(seen >= pack.n - slack_of(pack.n.astype(np.int64), share))
    spans = [slice(pack.off[d], pack.off[d + 1]) for d in kept.tolist()]
    columns = [pa.array((pack.key << 20) + kept, pa.int64()), *[pa.array(c[kept]) for c in (pack.f1, pack.f2, pack.n, seen, pack.doc_id)]]
    columns += [pa.array([pack.token[s].tobytes() for s in spans], pa.binary()), pa.array([signatures(pack.token[s], count[s], share).view(np.int64) for s in spans], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["node", "f1", "f2", "n", "seen", "doc_id", "tokens", "signatures"])


# --- pairs and components -----------------------------------------------------------------------


def verified(nodes: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets link, by exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if x.size > y.size:
                    x, y = y, x
                both = int(X.member(x, y).sum())
                keep.append(100 * both >= share * (x.size + y.size - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, share: int = SHARE) -> DataFrame:
    """(node, component) of all nodes that are in a component of several; see the module's step 4."""
    spark = nodes.sparkSession
    label = None

    def posted() -> DataFrame:
        index = nodes.select("node", F.explode("signatures").alias("sig"))
        groups = index.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = X.stored(index.join(groups, "sig"))
        weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
        return shared.join(nodes.select("node", "n", "seen").join(weight, "node"), "node")

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        if label is None:
            return rows.withColumn(name, F.col(node))
        own = label.select(F.col("node").alias(node), F.col("component").alias("_c"))
        return rows.join(own, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")

    def merge(found: DataFrame) -> None:
        nonlocal label
        fresh = X.stored(found)
        if not fresh.isEmpty():
            stars = label.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")) if label is not None else None
            edges = fresh if stars is None else stars.unionByName(fresh)
            label = X.settled(spark, lambda: connected(edges))

    def settle(candidates: DataFrame) -> None:
        """Compares (a, b, times) pairs unless they are connected, the most shared pivot of each a first."""
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b"))
        candidates = X.stored(candidates.withColumn("rank", rank))
        merge(verified(nodes, candidates.filter("rank = 1").select("a", "b"), share))
        left = X.stored(labelled(labelled(candidates.filter("rank > 1"), "a", "_x"), "b", "_y").filter("_x != _y").select("a", "b"))
        if not left.isEmpty():
            merge(verified(nodes, left, share))

    # a link needs share * (n + m - both) <= 100 * both, and no more than the lesser "seen" is in both
    fits = F.least("seen", "seen_too") * (100 + share) >= (F.col("n") + F.col("m")) * share
    rows = X.settled(spark, posted)
    # pivot of a signature: its node with the most company, then by id
    head = F.max_by(F.struct("node", "n", "seen"), F.struct("weight", -F.col("node"))).alias("h")
    heads = rows.groupBy("sig").agg(head).select("sig", F.col("h.node").alias("pivot"), F.col("h.n").alias("m"), F.col("h.seen").alias("seen_too"))
    met = rows.join(heads, "sig").filter((F.col("node") != F.col("pivot")) & fits)
    settle(met.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("times")))
    # what is left: signatures of more than two nodes whose nodes lie in several components
    rows = labelled(rows.filter("size > 2"), "node", "c")
    spans = rows.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("sig")
    rows = X.stored(rows.join(spans, "sig"))
    if not rows.isEmpty():
        merge(packed_links(nodes, rows, share))
    return label if label is not None else nodes.select("node", F.col("node").alias("component")).limit(0)


def regions(rows: DataFrame) -> DataFrame:
    """(node, pack, c): nodes that share a signature lie in few packs of bounded weight, those of one component together.

    A node's home is its most frequent signature.  A component that outweighs a pack at its home is dealt to packs of
    its own, the others share packs.  Only sums meet, so a hot signature is no hot task.
    """
    weight = F.col("n") + PACK_NODE
    home = rows.groupBy("node").agg(F.max(F.struct("size", "sig")).alias("h"), F.first("n").alias("n"), F.first("c").alias("c")).select("node", "n", "c", F.col("h.sig").alias("home"))
    parts = home.groupBy("home", "c").agg(F.sum(weight).alias("own"))
    shared = parts.filter(F.col("own") <= PACK).groupBy("home").agg(F.sum("own").alias("rest"))
    dealt = lambda of, total: F.pmod(F.xxhash64(of), F.ceil(F.col(total) / PACK))
    alone = F.xxhash64("home", "c", dealt("node", "own"))
    key = F.when(F.col("own") > PACK, alone).otherwise(F.xxhash64("home", dealt("c", "rest")))
    return home.join(parts, ["home", "c"]).join(shared, "home", "left").select("node", key.alias("pack"), "c")


def packed_links(nodes: DataFrame, rows: DataFrame, share: int) -> DataFrame:
    """(a, b) links that connect all components ``c`` of ``rows`` that link: packs that share a signature are compared, each pair once."""
    where = X.stored(regions(rows))
    here = rows.select("sig", "node").join(where, "node").groupBy("sig", "pack").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    there = here.select("sig", F.col("pack").alias("pack_too"), F.col("lo").alias("lo_too"), F.col("hi").alias("hi_too"))
    several = F.least("lo", "lo_too") != F.greatest("hi", "hi_too")
    pairs = X.stored(here.join(there, "sig").filter((F.col("pack") <= F.col("pack_too")) & several).select("pack", "pack_too").distinct())
    held = where.join(nodes.select("node", "n", "seen", "tokens"), "node")
    packs = X.stored(held.groupBy("pack").agg(F.collect_list(F.struct("node", "c", "n", "seen", "tokens")).alias("x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = Region(batch.column("x")[row].values)
                y = x if batch.column("pack")[row] == batch.column("pack_too")[row] else Region(batch.column("y")[row].values)
                found = np.array(links_between(x, y, share), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    other = packs.select(F.col("pack").alias("pack_too"), F.col("x").alias("y"))
    return pairs.join(packs, "pack").join(other, "pack_too").select("pack", "pack_too", "x", "y").mapInArrow(run, "a long, b long")


class Region:
    """The nodes of a pack with their tokens, and which of them hold a token."""

    def __init__(self, rows: pa.StructArray):
        self.node, self.c, self.n, self.seen = (rows.field(f).to_numpy().astype(np.int64) for f in ("node", "c", "n", "seen"))
        self.off = np.concatenate(([0], np.cumsum(self.n)))
        self.token = np.frombuffer(b"".join(rows.field("tokens").to_pylist()), np.uint64)
        order = np.argsort(self.token, kind="stable")
        self.known, first = np.unique(self.token[order], return_index=True)
        self.bounds = np.append(first, order.size)
        self.holder = np.repeat(np.arange(self.n.size), self.n)[order]

    def places(self, token: np.ndarray) -> np.ndarray:
        """Where each token stands in ``known``; -1 for others."""
        at = np.minimum(np.searchsorted(self.known, token), self.known.size - 1)
        return np.where(self.known[at] == token, at, -1)

    def common(self, places: np.ndarray) -> np.ndarray:
        """For every node, how many of the tokens at ``places`` it holds."""
        places = places[places >= 0]
        size = self.bounds[places + 1] - self.bounds[places]
        at = np.repeat(self.bounds[places] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.holder[at], minlength=self.n.size)


def links_between(x: Region, y: Region, share: int) -> list[tuple[int, int]]:
    """Links of nodes of ``x`` with nodes of ``y``, enough to connect all components that have one.

    Of two nodes of different components at least one is outside the largest, so only such nodes are held against the others.
    """
    kinds, group = np.unique(np.concatenate((x.c, y.c)), return_inverse=True)
    large = np.bincount(group).argmax()
    inside, out = group == large, []
    halves = (slice(0, x.n.size), slice(x.n.size, None))
    # the second turn holds the rest of y against the largest component in x
    for u, v, own, far, only in [(x, y, *halves, None), (y, x, *halves[::-1], inside[halves[0]])][: 1 if x is y else 2]:
        places = v.places(u.token)
        for i in np.flatnonzero(~inside[own]).tolist():
            fits = (group[far] != group[own][i]) & (np.minimum(u.seen[i], v.seen) * (100 + share) >= (u.n[i] + v.n) * share)
            if only is not None:
                fits &= only
            if not fits.any():
                continue
            both = v.common(places[u.off[i] : u.off[i + 1]])
            for j in np.flatnonzero(fits & (100 * both >= share * (u.n[i] + v.n - both))).tolist():
                if group[far][j] != group[own][i]:
                    out.append((int(u.node[i]), int(v.node[j])))
                    group[group == group[far][j]] = group[own][i]
    return out


def node_table(packs: DataFrame, share: int = SHARE) -> DataFrame:
    """The sets of ``packs`` that can link another one, one row each."""
    count = X.buckets(packs.sparkSession)

    def tokens(pack: Pack) -> pa.RecordBatch:
        keys, times = np.unique(pack.token, return_counts=True)
        return X.posted(pack.key, A.mix(keys), [keys, times.astype("<u4")], count)

    answers = X.ask(X.post(packs, tokens, Pack), X.key_counts("u4"))
    return X.reply(packs, answers, lambda pack, payloads: _nodes(pack, payloads, share), NODE_SCHEMA, Pack)


def set_tables(docs: DataFrame, share: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, f1, f2) of every row, and packs of the distinct sets that pass the sampled filter."""
    chunks = X.chunked(docs, doc_id, text)
    count = X.buckets(docs.sparkSession)

    def tokens(chunk: X.Chunk) -> pa.RecordBatch:
        sets = Sets(chunk)
        own = np.isin(sets.doc, sets.first_of_set()) & sampled(sets.token)
        keys, times = np.unique(sets.token[own], return_counts=True)
        return X.posted(chunk.key, A.mix(keys), [keys, np.minimum(times, 255).astype(np.uint8)], count)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.rows_of(batches):
            chunk = X.Chunk(row)
            sets = Sets(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids), pa.array(sets.n, pa.int64()), *[pa.array(p.view(np.int64)) for p in sets.prints]], names=["id", "n_shingles", "f1", "f2"])

    answers = X.ask(X.post(chunks, tokens), X.key_counts("u1"))
    found = X.reply(chunks, answers, lambda chunk, payloads: _survivors(chunk, payloads, share), SET_SCHEMA)
    once = found.groupBy("f1", "f2").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"))
    return chunks.mapInArrow(members, "id long, n_shingles long, f1 long, f2 long"), once.select("f1", "f2", "n", "doc_id", "tokens").mapInArrow(_packs, PACK_SCHEMA)


def linked_sets(packs: DataFrame, share: int) -> DataFrame:
    """(f1, f2, component) of the sets with a link; the component is the smallest id of its documents."""
    nodes = X.stored(node_table(packs, share))
    joined = X.stored(nodes.select("f1", "f2", "node", "doc_id").join(links(nodes, share), "node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("least"))
    return joined.join(least, "component").select("f1", "f2", F.col("least").alias("component"))


def components(docs: DataFrame, share: int = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    rows, packs = X.settled(spark, lambda: set_tables(docs, share, doc_id, text))
    joined = X.settled(spark, lambda: linked_sets(packs, share))
    same = rows.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = same.join(joined, ["f1", "f2"], "full").select("f1", "f2", F.least("least", "component").alias("group"))
    out = rows.join(groups, ["f1", "f2"], "left").withColumn("group", F.when(F.col("n_shingles") > 0, F.coalesce("group", "id")).otherwise(F.col("id")))
    null = F.lit(int(X.NULL_ID))
    return out.select(F.nullif("id", null).alias("doc_id"), "n_shingles", F.nullif("group", null).alias("component_id"))
