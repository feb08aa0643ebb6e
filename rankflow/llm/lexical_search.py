"""Exact ranked lexical search by norm buckets of impact vectors.

A document is a sparse vector of impacts over the items' vocabulary (term weight times
saturated, length-normalised frequency, all integers), an item the vector of its term
counts; the score is their inner product. Each task orders the vectors of a shard by
length and cuts them into buckets. Per bucket and item:

1. Cauchy-Schwarz: where item norm times the bucket's greatest norm stays below the item's
   current k-th score, the bucket is left out.
2. Coordinates: the item's terms are ordered by the most that each can add within the
   bucket; the least prefix of terms is accumulated without which no document can reach
   the k-th score, and a document survives if its sum, plus the lesser of what the other
   coordinates and the norms of the two rests allow, reaches it.
3. Survivors are scored again from their whole vectors in 64-bit integers.

A first round scores each shard's longest bucket only and gives every item a k-th score
for all tasks to begin with; the second covers all buckets. Bounds are floats with
slack, results integers, and equal scores are never pruned.

Documents are counted where they are read (one narrow pass per block of items) and their
vectors written once; only frequencies, k-th scores and results are shuffled. Items are dealt
into blocks whose vocabulary, measured, is at most `BLOCK_BYTES` (or one item); a block
is what a broadcast holds.

A null text has no terms. Documents without terms take no part in the statistics. Very
long texts are counted whole. Equal scores go by ascending doc_id, null ids last; rows
that repeat a doc_id rank each for themselves. Items are told apart by id and text, so equal
rows count once; a null item_id is returned as such. Empty tables give no rows. Extra
columns of any name are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

TOP = 10
BLOCK_BYTES = 32_000_000
ENTRY_BYTES = 150
SHARD = 16_384
BUCKET = 2_048
SLACK = 1 + 1e-9
#: Letters and digits stay (A-Z as a-z), every other ASCII character ends a term, bytes of other characters stay.
BYTES = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def _ints(values: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def item_terms(items: DataFrame) -> DataFrame:
    """Per distinct (item_id, text): item_id as text, `key`, its terms and their counts, and the bytes that a broadcast of them takes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(t or b"")) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            words = pa.array([list(c) for c in found], pa.list_(pa.binary()))
            counts = _ints([np.fromiter(c.values(), np.int32, len(c)) for c in found])
            size = pa.array([sum(len(t) + ENTRY_BYTES for t in c) for c in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, counts, size], ["item_id", "key", "terms", "counts", "size"])

    told = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    rows = told.select("item_id", F.xxhash64(F.isnull("item_id"), "item_id", F.isnull("text"), "text").alias("key"), "text")
    return rows.mapInArrow(run, "item_id string, key long, terms array<binary>, counts array<int>, size long").where("size > 0")


def blocks(items: DataFrame, most: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Adds `block` to the items' rows, in as few blocks as keep each within `most` bytes; and the number of blocks."""
    total = items.agg(F.sum("size").alias("s")).first()["s"] or 0
    n = -(-total // most)
    while n:
        dealt = items.withColumn("block", F.pmod("key", F.lit(n)))
        if not dealt.groupBy("block").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).where(f"s > {most} and n > 1").limit(1).count():
            return dealt, n
        n *= 2
    return items.withColumn("block", F.lit(0).cast("long")), 0


class Items:
    """The vectors of one block: vocabulary, and per item the ids of its terms and their counts."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        give = self.vocabulary.setdefault
        self.terms = [np.array([give(bytes(t), len(self.vocabulary)) for t in r["terms"]], np.int64) for r in rows]
        self.counts = [np.array(r["counts"], np.int64) for r in rows]
        self.norms = np.array([math.sqrt(float((c.astype(float) ** 2).sum())) for c in self.counts])


def counted(docs: DataFrame, items) -> DataFrame:
    """Per row with a term (`items`: a broadcast): doc_id, n (its terms), and the vocabulary's terms in it with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value.vocabulary.get
        for batch in batches:
            sizes, own, tf, there = [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                found = terms(text.as_py() or b"")
                if not found:
                    continue
                counts = Counter(map(known, found))
                counts.pop(None, None)
                there.append(i)
                sizes.append(len(found))
                own.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there, pa.int64())), pa.array(sizes, pa.int64()), _ints(own), _ints(tf)], ["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


class Weights:
    """What the statistics give: N, L and the weight of each term of the vocabulary."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.docs, self.all = n_docs, n_terms
        self.of = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def impacts(self, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, each: np.ndarray) -> np.ndarray:
        """Impacts of all terms of some documents; `each` is the number of terms of a document."""
        m = 100 - 75 + (75 * n * self.docs) // self.all
        return self.of[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, each)))


class Shard:
    """Documents of one task, ordered by the lengths of their vectors, longest first."""

    def __init__(self, batches: list[pa.RecordBatch], weights: Weights):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda c: table[c].chunk(0) if table[c].num_chunks else pa.array([], table.schema.field(c).type)
        self.ids = column("doc_id")
        lists = column("terms")
        each = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        own, tf = lists.flatten().to_numpy().astype(np.int64), column("tf").flatten().to_numpy().astype(np.int64)
        impact = weights.impacts(column("n").to_numpy().astype(np.int64), own, tf, each)
        doc = np.repeat(np.arange(len(each)), each)
        norms = np.sqrt(np.bincount(doc, impact.astype(float) ** 2, len(each)))
        self.order = np.argsort(-norms, kind="stable")
        self.norms = norms[self.order]
        self.place = np.empty(len(each), np.int64)  # of an id among the shard's ids, for ties
        self.place[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(each))
        starts = np.cumsum(each) - each
        own_each = each[self.order]
        at = np.repeat(starts[self.order] - (np.cumsum(own_each) - own_each), own_each) + np.arange(int(own_each.sum()))
        self.terms, self.impact, self.ends = own[at], impact[at], np.concatenate([[0], np.cumsum(own_each)])

    def buckets(self, size: int, most: int | None = None) -> Iterator[tuple[int, int]]:
        for a in range(0, len(self.norms), size)[:most]:
            yield a, min(len(self.norms), a + size)


class Bucket:
    """Postings of the documents a..b of a shard, by term."""

    def __init__(self, shard: Shard, a: int, b: int, vocabulary: int):
        self.shard, self.first = shard, a
        lo, hi = shard.ends[a], shard.ends[b]
        doc = np.repeat(np.arange(b - a), np.diff(shard.ends[a : b + 1]))
        by = np.argsort(shard.terms[lo:hi], kind="stable")
        self.doc, self.value = doc[by], shard.impact[lo:hi][by]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(shard.terms[lo:hi], minlength=vocabulary))])
        self.most = np.zeros(vocabulary, np.int64)  # the greatest impact of each term
        np.maximum.at(self.most, shard.terms[lo:hi], shard.impact[lo:hi])
        self.squares = shard.norms[a:b] ** 2

    def survivors(self, terms: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
        """Documents that the coordinates' bounds let reach the score `least` (and one above 0)."""
        most = counts * self.most[terms]
        order = np.argsort(-most, kind="stable")
        rest = np.cumsum(most[order][::-1])[::-1]  # what the terms from here on can add
        used = int((rest >= max(least, 1)).sum())  # a document without these can't reach it
        if not used:
            return np.zeros(0, np.int64)
        sums, squares = np.zeros(len(self.squares), np.int64), np.zeros(len(self.squares))
        for t, c in zip(terms[order[:used]].tolist(), counts[order[:used]].tolist(), strict=True):
            lo, hi = self.bounds[t], self.bounds[t + 1]
            value = self.value[lo:hi]
            sums[self.doc[lo:hi]] += c * value  # a document is there once
            squares[self.doc[lo:hi]] += value.astype(float) ** 2
        left = counts[order[used:]].astype(float)
        norms = math.sqrt(float((left**2).sum())) * np.sqrt(np.maximum(self.squares * SLACK - squares, 0))
        bound = sums + np.minimum(norms * SLACK, float(rest[used]) if used < len(rest) else 0.0)
        return np.flatnonzero((sums > 0) & (bound * SLACK >= least))

    def scores(self, docs: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Exact scores of some documents against a dense item vector."""
        lo, hi = self.shard.ends[self.first + docs], self.shard.ends[self.first + docs + 1]
        each = hi - lo
        at = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        return np.add.reduceat(vector[self.shard.terms[at]] * self.shard.impact[at], np.cumsum(each) - each)


def best(shard: Shard, items: Items, least: np.ndarray, k: int, size: int, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per item with any: its number, rows and scores of its k best documents in the (first `most`) buckets of a shard.

    `least` holds k-th scores known so far, 0 where there are none.
    """
    known = least.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.ids)
    vector = np.zeros(len(items.vocabulary), np.int64)
    for a, b in shard.buckets(size, most):
        bucket = None
        for q in np.flatnonzero(items.norms * shard.norms[a] * SLACK >= np.maximum(known, 1)).tolist():
            bucket = bucket or Bucket(shard, a, b, len(vector))
            own, counts = items.terms[q], items.counts[q]
            docs = bucket.survivors(own, counts, int(known[q]))
            if not len(docs):
                continue
            vector[own] = counts
            scores = bucket.scores(docs, vector)
            vector[own] = 0
            good = scores >= max(int(known[q]), 1)
            rows, scores = np.concatenate([found[q][0], shard.order[a + docs[good]]]), np.concatenate([found[q][1], scores[good]])
            top = np.lexsort((shard.place[rows], -scores))[:k]
            found[q] = rows[top], scores[top]
            if len(top) == k:
                known[q] = max(known[q], scores[top[-1]])
    for q, (rows, scores) in enumerate(found):
        if len(rows):
            yield q, rows, scores


def _round(counts: DataFrame, items, weights, least: np.ndarray, k: int, most: int | None, size: int, shard: int) -> DataFrame:
    """Rows (item, doc_id, score): what `best` finds in each shard of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def searched() -> Iterator[pa.RecordBatch]:
            whole = Shard(held, weights.value)
            found = list(best(whole, items.value, least, k, size, most))
            if found:
                number = np.repeat([q for q, _, _ in found], [len(r) for _, r, _ in found])
                ids = whole.ids.take(pa.array(np.concatenate([r for _, r, _ in found])))
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), ids, pa.array(np.concatenate([s for _, _, s in found]))], ["item", "doc_id", "score"])
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= shard:
                yield from searched()
        if held:
            yield from searched()

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(run, f"item int, doc_id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET, shard: int = SHARD) -> DataFrame:
    """Per item (item_id, text) its k best documents (doc_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind, doc_kind = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    dealt, n = blocks(written(item_terms(items), "lexical-items"), block_bytes)
    results = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    for number in range(n):
        own = Items(dealt.where(F.col("block") == number).select("item_id", "terms", "counts").orderBy("key").collect())
        if not own.ids:
            continue
        shared = spark.sparkContext.broadcast(own)
        counts = written(counted(docs, shared), "lexical-counts")
        whole = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not whole["docs"]:
            break
        df = np.zeros(len(own.vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # at most the block's vocabulary
            df[r["t"]] = r["df"]
        weights = spark.sparkContext.broadcast(Weights(whole["docs"], whole["terms"], df))
        least = np.zeros(len(own.ids), np.int64)
        first = _ranked(_round(counts, shared, weights, least, k, 1, bucket, shard), k)
        for r in first.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect():  # one row per item of the block
            least[r["item"]] = r["least"]
        ids = spark.createDataFrame(list(enumerate(own.ids)), "item int, item_id string")
        found = written(_ranked(_round(counts, shared, weights, least, k, None, bucket, shard), k), "lexical-found")
        results = results.union(found.join(ids, "item").select(F.col("item_id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return results
