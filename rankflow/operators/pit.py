"""Point-in-time evidence: what had happened, and had been recorded, before a row's day.

The range join runs on buckets of the window's length: evidence falls into one bucket,
a row looks into two, so a busy key is spread over its days and no row meets evidence
outside its window's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evidence(rows: DataFrame, seen: DataFrame, key: str, days: int, day: str = "dn", event_day: str = "wd", created: str = "created", how: str = "inner") -> DataFrame:
    """Pairs of a row and its evidence with event day in [day - days, day - 1] and creation before the day."""
    bucket = lambda c: F.floor(c / days).cast("long")
    left = rows.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(day) - days), bucket(F.col(day) - 1))))
    right = seen.withColumn("__bucket", bucket(F.col(event_day)))
    inside = (F.col(event_day) >= F.col(day) - days) & (F.col(event_day) < F.col(day)) & (F.col(created) < F.col(day))
    return left.join(right, [key, "__bucket"], how).where(inside).drop("__bucket")


def latest(pairs: DataFrame, row_key: list[str], order: list[Column]) -> DataFrame:
    """The row's last piece of evidence in the given order."""
    w = Window.partitionBy(*row_key).orderBy(*order)
    return pairs.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def quartile(value: Column, *group: str) -> Column:
    """Bucket 0..3 by the number of strictly smaller values in the group; equal values share one."""
    w = Window.partitionBy(*group)
    return F.least(F.lit(3), F.floor(4 * (F.rank().over(w.orderBy(value)) - 1) / F.count(F.lit(1)).over(w))).cast("int")


def multiplier(n: Column, wins: Column, expected: Column, cap: float) -> Column:
    """1 + cap n/(n+100) (clip((wins+10)/(expected+10), 1/4, 4) - 1)."""
    ratio = F.greatest(F.lit(0.25), F.least(F.lit(4.0), (wins + 10) / (expected + 10)))
    return 1 + cap * n / (n + 100) * (ratio - 1)
