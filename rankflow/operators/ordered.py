"""Order-dependent columns for keys of any size.

A window over a key holds all rows of the key in one task. Here rows are put in order by
range, so that a key with most rows lies in many tasks, each with a piece of it. What a row
needs from its own piece comes from a window over (key, piece); what it needs from earlier
pieces (their number of rows, sums, last values) comes from a window over the pieces,
of which a key has at most as many as there are tasks. The ordered rows are written
once, so that a task that runs again finds the same pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import stored


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordered") -> DataFrame:
    """Adds __at, ascending by keys and order over the whole table, and __piece; nulls come first."""
    by = [*keys, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    return stored(rows, name).withColumn("__piece", F.shiftright("__at", 33))


def _pieces(rows: DataFrame, keys: Sequence[str], values: dict, before: dict) -> DataFrame:
    """Per (key, piece): `before`'s columns over the aggregates `values` of the key's earlier pieces."""
    told = rows.groupBy(*keys, "__piece").agg(*[v.alias(k) for k, v in values.items()])
    return told.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__p"), *[v.alias(k) for k, v in before.items()])


def _met(rows: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(pieces, [*same, F.col("__piece") == F.col("__p")]).drop("__p", *[f"__k{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, keys: Sequence[str], name: str = "seq") -> DataFrame:
    """Rows of `placed` with their number within the key, from 1."""
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = _pieces(rows, keys, {"n": F.count(F.lit(1)), "first": F.min("__at")}, {"__skip": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "__first": F.col("first")})
    return _met(rows, pieces, keys).withColumn(name, F.col("__at") - F.col("__first") + F.col("__skip") + 1).drop("__skip", "__first")


def previous(rows: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Rows of `placed` with `columns` (new name: column) of the row before within the key; null for the first."""
    within = Window.partitionBy(*keys, "__piece").orderBy("__at")
    pieces = Window.partitionBy(*keys).orderBy("__piece")
    last = _pieces(rows, keys, {"last": F.max_by(F.struct(*columns.values()), "__at")}, {"__last": F.lag("last").over(pieces)})
    own = rows.withColumn("__own", F.lag(F.struct(*columns.values())).over(within))
    met = _met(own, last, keys)
    told = F.coalesce("__own", "__last")
    return met.withColumns({name: told[c] for name, c in columns.items()}).drop("__own", "__last")


def sums_before(rows: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Rows of `placed` with `columns` (new name: column) summed over all rows before within the key; 0 for the first."""
    within = Window.partitionBy(*keys, "__piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = _pieces(rows, keys, {name: F.sum(c) for name, c in columns.items()}, {f"__b_{name}": F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in columns})
    own = rows.withColumns({f"__w_{name}": F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in columns.items()})
    return _met(own, pieces, keys).withColumns({name: F.col(f"__b_{name}") + F.col(f"__w_{name}") for name in columns}).drop(*[f"__{x}_{name}" for name in columns for x in "bw"])
