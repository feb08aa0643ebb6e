"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint holds the majority bits of the 64-bit hashes of its shingles.
Fingerprints link if they differ in at most `DISTANCE` = 2 bits. The 64 bits are cut into
five blocks; two fingerprints that close agree in at least three of them, so they
meet under one of the ten keys made of three blocks each.

Documents with one fingerprint collapse to one row first. A key that few distinct
fingerprints share is joined with itself, and the Hamming distance verified. Under a
key that many share, pairs would grow with the square of the group: there, each
fingerprint is listed with every choice of two of the key's free bits masked, and
those alike under a mask (which differ in those two bits at most) link to the least
of them. That loses no link between components and grows in proportion to the group.

Texts without a word have fingerprint zero and link like any other. Fewer words than
a shingle make one shingle. Null texts count as empty; a null doc_id gets a
fingerprint and the component's least id, and never is that id itself unless no
other is there. Repeated rows each get their row. Very long texts are hashed whole, a
bounded number of shingles at a time. An empty table has no rows. Extra columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, components, judge_texts, map_texts, written

SHINGLE = 3
DISTANCE = 2
SEED = 42
CUTS = (0, 13, 26, 39, 52, 64)
HOT = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 values of all shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        values = np.array([hashed(b" ".join(words[i : i + shingle]), SEED) for i in range(a, min(n, a + 65536))], np.uint64)
        ones += np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row (doc_id, text): doc_id and `fp`, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in pdf["text"]], np.int64)})

    return map_texts(docs, run, "fp long")


def _mask(low: int, high: int) -> int:
    """Bits low..high-1 from the top, as a signed long."""
    return int.from_bytes((((1 << (high - low)) - 1) << (64 - high)).to_bytes(8, "big"), "big", signed=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b), a < b, that connect distinct fingerprints (column fp) within the distance."""
    cuts = list(zip(CUTS, CUTS[1:], strict=False))
    kept = [_signed(sum(_mask(*cuts[i]) & ((1 << 64) - 1) for i in c)) for c in combinations(range(5), 3)]
    keys: Column = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(kept)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.slot", "k.key")
    sizes = keyed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keyed.join(sizes, ["slot", "key"]), "simhash-keys")
    few = met.where(F.col("n") <= hot).select("slot", "key", "fp")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["slot", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .select("a", "b")
    )
    many = met.where(F.col("n") > hot)
    free = [[b for j, (lo, hi) in enumerate(cuts) if j not in c for b in range(lo, hi)] for c in combinations(range(5), 3)]
    masks = F.array(*[F.array(*[F.lit(_signed(~((1 << 63 - x) | (1 << 63 - y)) & ((1 << 64) - 1))) for x, y in combinations(bits, 2)]) for bits in free])
    alike = many.select("fp", F.explode(F.get(masks, F.col("slot"))).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    least = alike.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mask", "rest", "a")
    stars = alike.join(least, ["mask", "rest"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _rooted(groups: DataFrame) -> DataFrame:
    """Adds the component's root to one row per fingerprint (fp, low)."""
    roots = components(links(groups.select("fp")), "simhash")
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row (doc_id, text): doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    fps = written(fingerprints(docs, shingle), "simhash-fps")
    placed = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(salt: int) -> Column:
    """Half of the key under which rows alike in doc_id and text fall together."""
    return F.xxhash64(F.isnull("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(salt))


def representatives(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The row_key halves (__r1, __r2) of one document per component: the smallest doc_id, null ones last, then the least key."""

    def run(texts: list) -> pd.DataFrame:
        return pd.DataFrame({"fp": np.array([fingerprint(t, shingle) for t in texts], np.int64)})

    rows = judge_texts(docs.select("doc_id", "text"), run, "fp long", "found")
    fps = written(rows.select("found.fp", F.struct(F.isnull("doc_id").alias("n"), F.col("doc_id"), row_key(1).alias("__r1"), row_key(2).alias("__r2")).alias("row")), "simhash-rows")
    lowest = _rooted(fps.groupBy("fp").agg(F.min("row").alias("low"))).groupBy("root").agg(F.min("low").alias("low"))
    return lowest.select("low.__r1", "low.__r2")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns of one document per component, that of `representatives`; of repeated rows, one."""
    keyed = docs.select(row_key(1).alias("k1"), row_key(2).alias("k2"), F.struct(*columns(docs.columns)).alias("row"))
    kept = keyed.join(representatives(docs, shingle), (F.col("k1") == F.col("__r1")) & (F.col("k2") == F.col("__r2")), "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
