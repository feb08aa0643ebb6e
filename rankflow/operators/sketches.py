"""Distinct counts by mergeable sketches: one pass over the rows for any number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def bound(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """Relative error that an estimate stays within but for one case in many thousands."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def sketched(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """Per group one sketch of each column (binary, of bounded size), to be stored beside a table's partitions; nulls don't count."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, F.lit(lg_k)).alias(c) for c in columns])


def merged(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The sketches of all groups together, without reading a row again."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in columns])


def estimates(sketches: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    return sketches.select(*keep, *[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c) for c in columns])
