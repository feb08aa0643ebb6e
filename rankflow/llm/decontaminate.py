"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is `size` consecutive words of an item, or the whole of a shorter item. A
document holds a window only if it holds every shingle of it, so one shingle is a
sufficient prefix; the rarest in the corpus is taken (ties: the first by name). The
document's shingles are joined with these prefix shingles. Each hit fixes where the
window would begin (positional bound) and that it must fit into the document (length
bound); then the words are compared one by one over the window's length.

A benchmark of at most `block_bytes` (measured) is collected, and its prefix index
broadcast; then no row moves. A larger one stays a table of windows. Its prefix shingles
leave a table of fixed size behind, which tells the length and offset of the windows that
a word may be the prefix of, and the windows a Bloom filter of at most `BLOOM_BITS` bits
over hashes of all their words. Documents slide the same hash along; only the stretches
that pass both are written out, and Spark joins these with the windows on all their
words. Beyond the filter's size more stretches pass, and none is lost. Corpus counts are
one partial aggregate in either case.

Null or empty texts have no words. Null items have no windows. Repeated items share
windows and are each named; repeated documents each get their row. Windows of items
without an item_id are hits like others; such items count as one and have no name. Very
long texts are compared whole. An empty table has no rows, an empty benchmark no hits.
Extra columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, judge_texts, written

WINDOW = 13
BLOCK_BYTES = 1_000_000
FILTER = 1 << 20
BLOOM_BITS = 1 << 27
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_BACK = pow(_BASE, -1, 1 << 64)
_CHUNK_WORDS = 200_000

#: Lower-cases A-Z and turns everything but 0-9, a-z and non-ASCII bytes into spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    n = min(size, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []


def rarity(docs: DataFrame, items: list[tuple[str | None, str]]) -> dict[bytes, int]:
    """How often each shingle (one word) of the items occurs in all documents.

    Tasks count only words that the items have; partial counts are summed by Spark.
    """
    vocabulary = {w for _, text in items for w in words_of(text)}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, seen = shared.value, Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(filter(wanted.__contains__, words_of(text)))
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    counts = docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}  # no more rows than the block has words


def prefix_index(items: list[tuple[str, str]], counts: dict[bytes, int], size: int) -> dict[bytes, dict]:
    """Prefix shingle -> window -> (offset of the shingle in the window, ids of its items)."""
    index: dict[bytes, dict] = {}
    for item_id, text in items:
        for w in windows_of(words_of(text), size):
            key = min(w, key=lambda x: (counts.get(x, 0), x))
            index.setdefault(key, {}).setdefault(w, (w.index(key), set()))[1].add(item_id)
    return index


def find(words: list[bytes], index: dict[bytes, dict]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words that windows cover, and the items of these windows."""
    spans, found = [], set()
    n = len(words)
    for i, word in enumerate(words):
        if word in index:
            for window, (offset, ids) in index[word].items():
                start, size = i - offset, len(window)
                if start >= 0 and start + size <= n and words[start] == window[0] and tuple(words[start : start + size]) == window:
                    spans.append((start, start + size))
                    found |= ids
    return spans, found


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if windows cover a word of it and at least a twentieth
    of its words.
    """
    return judged(docs.select("doc_id", "text"), items, "found", size, block_bytes).select("doc_id", "found.*")


def judged(docs: DataFrame, items: DataFrame, name: str, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns and the struct `name` of what `decontaminate` returns per document; no column may have that name."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _judged_by_join(docs, items, name, size)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]  # at most block_bytes
    index = docs.sparkSession.sparkContext.broadcast(prefix_index(rows, rarity(docs.select("text"), rows) if rows else {}, size))

    def judge(texts: list) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text)
            hit, found = _covered(words, index.value)
            n, k = len(words), sum(hit)
            out.append((n, k, len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), k > 0 and 20 * k >= n))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return judge_texts(docs, judge, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", name)


def _covered(words: list[bytes], index: dict[bytes, dict]) -> tuple[bytearray, set]:
    """A byte for each word, 1 where a window covers it, and the items of these windows."""
    hit = bytearray(len(words))
    spans, found = find(words, index)
    for a, b in spans:
        hit[a:b] = b"\x01" * (b - a)
    return hit, found


def _windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, win): an item's windows, words with spaces between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item_id, text in zip(pdf["item_id"], pdf["text"], strict=True):
                found = list({b" ".join(w).decode() for w in windows_of(words_of(text), size)})
                for a in range(0, len(found), 10_000):
                    yield pd.DataFrame({"item_id": [item_id] * len(found[a : a + 10_000]), "win": found[a : a + 10_000]})

    return items.mapInPandas(run, "item_id string, win string").distinct()


def _counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(words_of(text))
                if len(seen) > 200_000:
                    yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})

    return docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _prefixes(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Distinct (at, offset, n): of each window the number of its rarest word, that word's place in it and the window's length.

    Words of the items meet the corpus counts one by one and come back to their item, so
    what is shuffled grows with the items' words, not with their windows' words.
    """
    texts = items.select("text").distinct().select(_key(1).alias("k1"), _key(2).alias("k2"), "text")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k1, k2, text in zip(pdf["k1"], pdf["k2"], pdf["text"], strict=True):
                words = [w.decode() for w in words_of(text)]
                for a in range(0, len(words), 10_000):
                    part = words[a : a + 10_000]
                    yield pd.DataFrame({"k1": k1, "k2": k2, "pos": range(a, a + len(part)), "word": part})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            marks = set()
            for item in pdf["words"]:
                words = [(w["n"], w["word"], w["pos"]) for w in item]
                n = min(size, len(words))
                for a in range(len(words) - n + 1):
                    _, word, pos = min(words[a : a + n])
                    marks.add((zlib.crc32(word.encode()) & (FILTER - 1), pos - a, n))
            yield pd.DataFrame(sorted(marks), columns=["at", "offset", "n"])

    counts = written(_counts(docs), "decontaminate-counts")  # written, so that a frequent word can be split in the join
    placed = texts.mapInPandas(place, "k1 long, k2 long, pos int, word string").join(counts, "word", "left")
    whole = placed.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("words"))
    return whole.select("words").mapInPandas(choose, "at long, offset int, n int").distinct()


def _key(i: int):
    return F.xxhash64(F.coalesce("text", F.lit("")), F.lit(i))


class _Slide:
    """Hashes of all stretches of a list of words, from sums that wrap at 2^64."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power(_BASE)[:n])])
        self.back = power(_BACK)

    def hashes(self, starts: np.ndarray, n: int) -> np.ndarray:
        h = (self.sums[starts + n] - self.sums[starts]) * self.back[starts] + np.uint64(n)
        h ^= h >> np.uint64(32)
        h *= np.uint64(_BASE)
        return h ^ (h >> np.uint64(29))


def _slots(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit slot for each hash, and three bits of it."""
    at = (hashes >> np.uint64(18)) & np.uint64(slots - 1)
    one = lambda shift: np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return at.astype(np.int64), one(0) | one(6) | one(12)


def _passes(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, bits = _slots(hashes, len(bloom))
    return bloom[at] & bits == bits


def _bloom(wins: DataFrame, most_bits: int = BLOOM_BITS) -> np.ndarray:
    """The windows' hashes in 64-bit slots, about 16 bits a window up to `most_bits` in all."""
    slots = 1 << max(6, min(most_bits // 64, wins.count() // 4).bit_length() - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [w.encode().split(b" ") for w in pdf["win"]]
            n = np.array([len(w) for w in words], np.int64)
            starts, slide, hashes = np.cumsum(n) - n, _Slide([x for w in words for x in w]), np.zeros(len(n), np.uint64)
            for k in np.unique(n).tolist():
                hashes[n == k] = slide.hashes(starts[n == k], k)
            at, bits = _slots(hashes, slots)
            yield pd.DataFrame({"at": at, "bits": bits.view(np.int64)})

    set_ = wins.select("win").mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most most_bits / 64 rows
    bloom = np.zeros(slots, np.uint64)
    bloom[set_["at"].to_numpy(np.int64)] = set_["bits"].to_numpy(np.int64).view(np.uint64)
    return bloom


def _chunks(pdf: pd.DataFrame) -> Iterator[tuple[list[tuple[int, int]], list[list[bytes]]]]:
    """Keys and words of the rows, some hundred thousand words at a time; a longer text comes by itself, whole."""
    ids: list[tuple[int, int]] = []
    texts: list[list[bytes]] = []
    total = 0
    for k1, k2, text in zip(pdf["k1"], pdf["k2"], pdf["text"], strict=True):
        words = words_of(text)
        if words:
            if texts and total + len(words) > _CHUNK_WORDS:
                yield ids, texts
                ids, texts, total = [], [], 0
            ids.append((k1, k2))
            texts.append(words)
            total += len(words)
    if texts:
        yield ids, texts


def _judged_by_join(docs: DataFrame, items: DataFrame, name: str, size: int) -> DataFrame:
    """As `judged`, with the benchmark as a table."""
    wins = written(_windows(items, size), "decontaminate-windows")
    marks = _prefixes(docs, items, size)
    number = (F.col("n") * (F.col("n") - 1) / 2).cast("int") + F.col("offset")
    parts = -(-(size * (size + 1) // 2) // 32)
    flags = F.transform(F.array(*[F.lit(k) for k in range(parts)]), lambda k: F.when(F.floor(F.col("number") / 32) == k, F.pow(F.lit(2.0), F.col("number") % 32).cast("long")).otherwise(F.lit(0).cast("long")))
    bits = marks.select("at", number.alias("number")).select("at", flags.alias("flags")).groupBy("at").agg(*[F.bit_or(F.get("flags", F.lit(k))).alias(f"b{k}") for k in range(parts)])
    found = bits.toPandas()  # at most FILTER rows
    table = np.zeros((FILTER, parts), np.uint32)
    table[found["at"].to_numpy(np.int64)] = found[[f"b{k}" for k in range(parts)]].to_numpy(np.uint64).astype(np.uint32)
    some = docs.sparkSession.sparkContext.broadcast((table, _bloom(wins)))  # FILTER * parts * 4 bytes and BLOOM_BITS / 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bloom = some.value
        for pdf in batches:
            for ids, texts in _chunks(pdf):
                words = [w for t in texts for w in t]
                ends = np.cumsum([len(t) for t in texts])
                own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                flags = table[np.fromiter((zlib.crc32(w) & (FILTER - 1) for w in words), np.int64, len(words))]
                near = np.flatnonzero(flags.any(axis=1))
                slide = _Slide(words)
                out: list[tuple] = []
                for n in range(1, size + 1):
                    starts = []
                    for o in range(n):
                        j, bit = divmod(n * (n - 1) // 2 + o, 32)
                        at = near[(flags[near, j] >> np.uint32(bit)) & np.uint32(1) == 1]
                        first = at - o  # the window's place follows from the prefix shingle's
                        starts.append(first[(first >= (ends - np.diff(ends, prepend=0))[own[at]]) & (first + n <= ends[own[at]])])
                    starts = np.unique(np.concatenate(starts))
                    for a in starts[_passes(bloom, slide.hashes(starts, n))].tolist():
                        k = own[a]
                        out.append((*ids[k], a - int(ends[k]) + len(texts[k]), n, b" ".join(words[a : a + n]).decode()))
                for x in range(0, len(out), 20_000):
                    yield pd.DataFrame(out[x : x + 20_000], columns=["k1", "k2", "first", "n", "win"])

    keyed = docs.select(_key(1).alias("k1"), _key(2).alias("k2"), "text")
    stretches = keyed.mapInPandas(run, "k1 long, k2 long, first int, n int, win string")
    met = written(stretches.join(wins.select("win"), "win", "left_semi"), "decontaminate-met")
    ends = F.array_sort(F.collect_set(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("z"))))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["z"]).alias("end"), (acc["sum"] + F.greatest(x["z"] - F.greatest(acc["end"], x["a"]), F.lit(0))).cast("long").alias("sum")
    )
    covered = met.groupBy("k1", "k2").agg(F.aggregate(ends, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")), step)["sum"].alias("hits"))
    named = met.select("k1", "k2", "win").distinct().join(wins, "win").select("k1", "k2", "item_id").distinct()
    names = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("ids"), F.count(F.lit(1)).alias("items"))
    found = covered.join(names, ["k1", "k2"]).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "hits", "items", F.array_join("ids", ",").alias("names"))
    words = judge_texts(docs.select("text", F.struct(*columns(docs.columns)).alias("row")), lambda texts: pd.DataFrame({"n_words": [len(words_of(t)) for t in texts]}), "n_words long", "count")
    every = words.join(found, (_key(1) == F.col("h1")) & (_key(2) == F.col("h2")), "left")
    k, n = F.coalesce("hits", F.lit(0)), F.col("count.n_words")
    result = F.struct(
        n.alias("n_words"), k.alias("n_hit"), F.coalesce("items", F.lit(0)).alias("n_items"),
        F.sha2(F.encode(F.coalesce("names", F.lit("")), "utf-8"), 256).alias("items_sha256"), ((k > 0) & (20 * k >= n)).alias("contaminated"),
    )
    return every.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], result.alias(name))
