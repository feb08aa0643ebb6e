"""Leak-free histories: what was known about a key before the day of the row.

Rows are first summed per key and day, so a hot key's window holds days, not rows;
the frame ends the day before (`rangeBetween(.., -1)`), so a day never informs itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW_DAYS = 1095


def daily(df: DataFrame, keys: Sequence[str], values: dict[str, Column], day: str = "dn") -> DataFrame:
    """Per key and day: n rows and the sum of each value."""
    return df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in values.items()])


def history(df: DataFrame, keys: Sequence[str], values: dict[str, Column], days: int | None = WINDOW_DAYS, day: str = "dn", prefix: str = "h_") -> DataFrame:
    """Adds h_n and h_<value>: counts and sums over the `days` before the row's day (None: all earlier days)."""
    return _attached(df, past(df, keys, values, days, day, prefix), [*keys, day])


def past(df: DataFrame, keys: Sequence[str], values: dict[str, Column], days: int | None = WINDOW_DAYS, day: str = "dn", prefix: str = "h_") -> DataFrame:
    """What `history` adds, once per key and day that has rows."""
    sums = daily(df, keys, values, day)
    if days is not None and _whole(sums, values):
        return running(sums, keys, ["n", *values], days, day, prefix).select(*keys, day, *[prefix + c for c in ("n", *values)])
    frame = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding if days is None else -days, -1)
    return sums.select(*keys, day, *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(prefix + c) for c in ("n", *values)])


def _whole(sums: DataFrame, values) -> bool:
    return all(sums.schema[c].dataType.simpleString() in ("bigint", "int") for c in values)


def running(sums: DataFrame, keys: Sequence[str], values: Sequence[str], days: int, day: str, prefix: str) -> DataFrame:
    """Adds <prefix><value>: whole numbers summed over the `days` before the row's day.

    A day's sums are added at the day and taken off `days` later, so that one running sum
    tells every window; a frame that slides is summed anew for each day.
    """
    moves = F.explode(F.array(F.struct(F.col(day).alias("at"), F.lit(1).alias("sign")), F.struct((F.col(day) + days).alias("at"), F.lit(-1).alias("sign"))))
    frame = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    moved = sums.withColumn("__m", moves).withColumns({"__at": F.col("__m.at"), "__sign": F.col("__m.sign")}).drop("__m")
    told = {prefix + c: F.when(F.col(day).isNull(), F.col(c)).otherwise(F.coalesce(F.sum(F.col(c) * F.col("__sign")).over(frame), F.lit(0))) for c in values}
    return moved.withColumns(told).where("__sign = 1").drop("__at", "__sign")


def decayed(df: DataFrame, keys: Sequence[str], values: dict[str, Column], half_life: float, centre: int, day: str = "dn", prefix: str = "d_") -> DataFrame:
    """As `history` over all earlier days, each weighted by 2^(-age / half_life); `centre` keeps powers in range."""
    frame = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    grow = F.pow(F.lit(2.0), (F.col(day) - centre) / half_life)
    sums = daily(df, keys, values, day)
    past = sums.select(*keys, day, *[F.coalesce(F.sum(F.col(c) * grow).over(frame) / grow, F.lit(0.0)).alias(prefix + c) for c in ("n", *values)])
    return _attached(df, past, [*keys, day])


def contexts(df: DataFrame, key: str, sets: dict[str, Sequence[str]], values: dict[str, Column], days: int = WINDOW_DAYS, day: str = "dn", tasks: int | None = None) -> DataFrame:
    """As `history` for several key sets at once, each `key` and further columns: adds <prefix>n and <prefix><value> per set.

    Rows are summed once per day and all columns that any set has; those sums are
    brought together by `key`, so that the windows of all sets need no exchange of their
    own, and joined once. `tasks` is the number of tasks of that exchange.
    """
    every = sorted({c for extra in sets.values() for c in extra})
    sums = daily(df, [key, *every], values, day)
    sums = sums.repartition(tasks, key) if tasks else sums.repartition(key)
    frame = lambda extra: Window.partitionBy(key, *extra).orderBy(day).rangeBetween(-days, -1)
    once = [prefix for prefix, extra in sets.items() if not extra and _whole(sums, values)]  # the longest windows; those of the other sets hold few days
    for prefix in once:
        sums = running(sums, [key], ["n", *values], days, day, prefix)
    done = [prefix + c for prefix in once for c in ("n", *values)]
    past = sums.select(key, *every, day, *done, *[F.coalesce(F.sum(c).over(frame(extra)), F.lit(0)).alias(prefix + c) for prefix, extra in sets.items() if prefix not in once for c in ("n", *values)])
    return _attached(df, past, [key, *every, day])


def _attached(df: DataFrame, past: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins histories to their rows; null keys are keys like others."""
    named = past.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *[c for c in past.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    met = df.join(named, same)
    return met.drop(*[f"__{i}" for i in range(len(keys))])


def smoothed(wins: Column, n: Column) -> Column:
    """Base rate of a competitor: one win in twelve as prior."""
    return (wins + 1) / (n + 12)


def context_blend(base: Column, wins: Column, n: Column, strength: float, cap: float) -> Column:
    """Base rate mixed with the rate under like conditions, by at most `cap`."""
    weight = F.least(F.lit(cap), n / (n + 5))
    return base * (1 - weight) + weight * (wins + strength / 12) / (n + strength)


def agent_blend(base: Column, wins: Column, n: Column, cap: float) -> Column:
    """Base rate mixed with an agent's rate, by at most `cap`."""
    weight = cap * n / (n + 100)
    return base * (1 - weight) + weight * (wins + 10) / (n + 120)


def share(score: Column, *race: str) -> Column:
    """A score's share of its contest's sum."""
    return score / F.sum(score).over(Window.partitionBy(*race))


def refreshed(base: DataFrame, delta: DataFrame, keys: Sequence[str], day: str = "dn") -> DataFrame:
    """Daily sums after a revision: the delta's (key, day) rows replace the base's, none counts twice."""
    kept = base.join(delta.select(*keys, day).distinct(), [*keys, day], "left_anti")
    return kept.unionByName(delta)
