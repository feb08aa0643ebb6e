"""Block resampling and significance, reproducible in every engine.

Draws come from hashes, not from a generator: u(key) is the first 13 hex digits of
md5(key) over 2^52. Units are aggregated before they are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import scratch


def uniform(*key: Column | str) -> Column:
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def numbered(units: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds `unit`, 0, 1, ... by order (per `by`), and `units`; for frames that are aggregated already."""
    return units.withColumn("unit", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("units", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def bootstrap(units: DataFrame, num: str | Sequence[str], den: str, reps: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """Per repetition: the ratio of sums over as many units as there are, drawn with replacement; for several `num`, ratio_<num> of each from the same draws.

    `units` has columns unit and units (see `numbered`). Draws are joined with the
    units; sums are partial before the shuffle.
    """
    draws = units.select(*by, "units", F.col("unit").alias("i")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    picked = draws.withColumn("unit", F.floor(uniform(seed, F.col("rep"), F.col("i")) * F.col("units")).cast("int")).select(*by, "rep", "unit")
    names = {"ratio": num} if isinstance(num, str) else {f"ratio_{c}": c for c in num}
    return picked.join(units.select(*by, "unit", *names.values(), den), [*by, "unit"]).groupBy(*by, "rep").agg(*[(F.sum(c) / F.sum(den)).alias(k) for k, c in names.items()])


_TURNS = [t for turns in ([7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]) for t in turns * 4]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16][i // 16] for i in range(64)]


def uniforms(prefix: str, first: int, stop: int) -> np.ndarray:
    """`uniform` of the keys prefix + i for first <= i < stop, numbers of equally many digits; the MD5 of all of them at once. A key holds at most 55 bytes."""
    digits, head = len(str(first)), prefix.encode()
    length = len(head) + digits
    if length > 55:
        raise ValueError("a key of more than 55 bytes")
    text = np.zeros((stop - first, 64), np.uint8)
    text[:, : len(head)], text[:, length], text[:, 56] = np.frombuffer(head, np.uint8), 128, 8 * length & 255
    text[:, 57] = 8 * length >> 8
    i = np.arange(first, stop)
    for k in range(digits):
        text[:, length - 1 - k] = 48 + i % 10
        i //= 10
    own = range(len(head) // 4, (length - 1) // 4 + 1)  # words that differ from key to key
    words = [np.ascontiguousarray(text.view("<u4")[:, w]) if w in own else text.view("<u4")[:1, w].copy() for w in range(16)]
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(stop - first, x, np.uint32) for x in start)
    for r in range(64):
        f = [lambda: d ^ (b & (c ^ d)), lambda: c ^ (d & (b ^ c)), lambda: b ^ c ^ d, lambda: c ^ (b | ~d)][r // 16]()
        f += a
        f += words[_PLACES[r]] + np.uint32(_SINES[r])
        turn = np.uint32(_TURNS[r])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in ((a, start[0]), (b, start[1])))
    return ((high << np.uint64(20)) | (low >> np.uint64(12))).astype(float) / float(1 << 52)


CHUNK, TOGETHER = 1 << 14, 8


def drawn(prefix: str, n: int) -> np.ndarray:
    """How often each of n units is drawn in n draws."""
    times = np.zeros(n, np.uint16)
    first = 0
    while first < n:
        stop = min(n, first + CHUNK, 10 ** len(str(first)))
        np.add.at(times, (uniforms(prefix, first, stop) * n).astype(np.int64), np.uint16(1))
        first = stop
    return times


def bootstrap_many(units: DataFrame, num: Sequence[str], den: str, reps: int, seed: str, by: Sequence[str]) -> DataFrame:
    """As `bootstrap`, of the same draws, for many units: draws are neither rows nor joined.

    Units are written once, a folder per group. A task draws a few repetitions of a group, holds how
    often each unit came (two bytes a unit and repetition) and multiplies these counts with
    the values, which it reads in batches.
    """
    spark, names = units.sparkSession, [*num, den]
    path = scratch(spark, "units")
    keys = [F.concat_ws("-", *by).alias("__group")]
    units.select(*keys, "unit", *[F.col(c).cast("double").alias(c) for c in names]).write.partitionBy("__group").parquet(path)
    blocks = units.groupBy(*by).agg(F.first("units").alias("units")).select(*by, *keys, "units", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(TOGETHER))).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                block = range(row["first"], min(reps, row["first"] + TOGETHER))
                times = [drawn(f"{seed}|{rep}|", int(row["units"])) for rep in block]
                sums = np.zeros((len(block), len(names)))
                for batch in ds.dataset(f"{root}/__group={row['__group']}", filesystem=fs, format="parquet").to_batches(columns=["unit", *names], batch_size=1 << 17, batch_readahead=1, fragment_readahead=1):
                    unit, values = batch["unit"].to_numpy(), np.stack([batch[c].to_numpy() for c in names])
                    for k, t in enumerate(times):
                        sums[k] += values @ t[unit].astype(float)
                yield pd.DataFrame({**{c: row[c] for c in by}, "rep": list(block), **{f"ratio_{c}": sums[:, j] / sums[:, -1] for j, c in enumerate(num)}})

    shape = ", ".join([*[f"{c} {units.schema[c].dataType.simpleString()}" for c in by], "rep int", *[f"ratio_{c} double" for c in num]])
    return blocks.repartition(-(-reps // TOGETHER)).mapInPandas(run, shape)


def interval(reps: DataFrame, by: Sequence[str] = (), value: str = "ratio") -> DataFrame:
    """Interpolated 2.5 and 97.5 percentiles."""
    return reps.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def floor_interval(reps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles by floor index: the values at places floor(.025 n) and floor(.975 n)."""
    s = F.sort_array(F.collect_list("ratio"))
    at = lambda q: F.get(s, F.floor(F.lit(q) * F.count(F.lit(1))).cast("int"))
    return reps.groupBy(*by).agg(at(0.025).alias("low"), at(0.975).alias("high"))


def sign_flips(blocks: DataFrame, delta: str, block: str, draws: int, seed: str, by: Sequence[str] = (), slack: float = 1e-12) -> DataFrame:
    """One-sided paired test: the share of sign flips whose sum is as low as the observed one; 1 if that isn't below zero.

    A draw's signs are made once per block and shared by all tests. Draws are dealt to the
    tasks, and blocks, which are aggregated already, come to them.
    """
    sign = F.when(uniform(seed, F.col("draw"), F.col(block)) < 0.5, -1.0).otherwise(1.0)
    signs = blocks.select(block).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("sign", sign).repartition(blocks.sparkSession.sparkContext.defaultParallelism, "draw")
    flips = signs.join(F.broadcast(blocks.select(*by, block, delta)), block).groupBy(*by, "draw").agg(F.sum(F.col(delta) * F.col("sign")).alias("flipped"), F.sum(delta).alias("observed"))
    return flips.groupBy(*by).agg(
        F.first("observed").alias("observed"),
        F.when(F.first("observed") >= 0, 1.0).otherwise((F.count_if(F.col("flipped") <= F.col("observed") + slack) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )


def holm(df: DataFrame, p: str, order: Sequence[str]) -> DataFrame:
    """Adds p_holm, the step-down adjusted p of a table of tests."""
    w = Window.orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("__step", step).withColumn("p_holm", F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def block_of(day: Column, days: int = 28) -> Column:
    """Calendar block of a date: proleptic ordinal over `days`."""
    return F.floor((F.unix_date(day) + 719163) / days).cast("long")
