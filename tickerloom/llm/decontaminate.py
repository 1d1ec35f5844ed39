"""Benchmark decontamination in DataFrame functions only: size-partitioned MinHash containment search.

A short test item sits inside a long document when at least ``share`` of the item's distinct word shingles
occur in the document; Jaccard similarity of the two sets would be near zero, so the search estimates
containment.  Items fall into partitions by the power of two of their shingle count.  The MinHash sketch of
an item is the ``k`` of its shingles with the least hash, where ``k`` follows from the partition's upper size
u: k = floor((1 - share) * u) + 1.  Fewer than k shingles of an item can be missing from a document that
holds ``share`` of them, so one sketch value at least occurs in every such document: the search loses none.
Candidates are then verified on the shingle strings themselves, not on hashes.

Scale: documents are read twice, once to meet the sketches and once for the candidates; neither pass has a
shuffle on texts as long as the smaller side is found small enough by Spark itself; no hint is given, and a
benchmark of any size falls back to a sort-merge join.  A passage that a third of the documents hold gives
at most k rows for each such document.

Defined cases: null or empty texts and items have no shingles and match nothing.  Words are lower-cased A-Z.
An item of fewer than five words is one shingle, its whole sequence, and matches documents with exactly that
sequence.  Repeated items or documents give one row for each (doc_id, item_id); if one id has several texts,
the best match counts.  Other columns of the inputs are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
SHARE = 0.8


def word_list(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null gives none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _sliding(w: Column, one: Column, width: int, window) -> Column:
    n = F.size(w)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), window)).when(n > 0, F.array(one))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    return _sliding(w, F.xxhash64(F.lit(""), F.array_join(w, " ")), width, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))


def shingle_texts(w: Column, width: int = WIDTH) -> Column:
    return F.array_distinct(_sliding(w, F.array_join(w, " "), width, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(width)])))


def item_sketches(items: DataFrame, share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """(item_id, h): the k least hashes of every item, k by the size partition."""
    sets = items.select("item_id", F.array_distinct(shingle_hashes(F.col("w"), width)).alias("hs")).filter(F.size("hs") > 0)
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.size("hs"))) + 1) - 1
    k = (F.floor((F.lit(1.0) - F.lit(share)) * upper + F.lit(1e-9)) + 1).cast("int")
    mixed = F.array_sort(F.transform("hs", lambda h: F.struct(F.xxhash64(h, F.lit(17)).alias("order"), h.alias("h"))))
    least = F.transform(F.slice(mixed, F.lit(1), k), lambda s: s["h"])
    return sets.select("item_id", F.explode(least).alias("h")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_shingles, found, containment) of every pair with containment >= ``share``."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    t = items.select(F.col("item_id"), word_list(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    met = d.select("doc_id", word_list(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes(F.col("w"), width)).alias("h")).join(item_sketches(t, share, width), "h")
    pairs = met.select("doc_id", "item_id").distinct()
    full = t.select("item_id", shingle_texts(F.col("w"), width).alias("item_set"))
    found_in = pairs.withColumnRenamed("doc_id", "id")
    near = d.join(found_in, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "item_id", word_list(F.col("text")).alias("w")).select("doc_id", "item_id", shingle_texts(F.col("w"), width).alias("doc_set"))
    n, found = F.size("item_set"), F.size(F.array_intersect("doc_set", "item_set"))
    checked = near.join(full, "item_id").select("doc_id", "item_id", n.cast("long").alias("n"), found.cast("long").alias("f"))
    held = checked.filter(F.col("f") >= F.lit(share) * F.col("n"))
    best = held.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n", "f"), F.struct(F.col("f") / F.col("n"), F.col("n"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("item_shingles"), F.col("b.f").alias("found"), (F.col("b.f") / F.col("b.n")).alias("containment"))
