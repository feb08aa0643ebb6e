"""Field-strength and candidate features, and their triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import average_rank

RACE = "race_id"
COMPONENTS = ["prior_win_rate", "prior_top3_rate", "prior_avg_finish_pct", "recent3_finish_pct_mean", "prior_avg_time_diff"]
BETTER_LOW = {"prior_avg_finish_pct", "recent3_finish_pct_mean", "prior_avg_time_diff"}


def row_mean(columns: list[Column]) -> tuple[Column, Column]:
    """Mean over the values that are there, and their number."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    n = F.size(there)
    return F.when(n > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / n), n


def ability(df: DataFrame) -> DataFrame:
    """Adds ability, the mean of available components (losses enter as 1 - x), and their number."""
    parts = [1 - F.col(c) if c in BETTER_LOW else F.col(c) for c in COMPONENTS if c in df.columns]
    mean, n = row_mean(parts)
    return df.withColumn("ability", mean).withColumn("components", n)


def field_strength(df: DataFrame) -> DataFrame:
    """Field mean without the own value, coverage, rank and percentile of ability in the contest, and form against the past.

    The past are earlier days of the competitor, summed per day before they are ordered.
    """
    race = Window.partitionBy(RACE)
    day = Window.partitionBy("horse_id").orderBy("dn")
    a = F.col("ability")
    own = a.isNotNull().cast("int")
    others = F.count("ability").over(race) - own
    out = df.withColumns(
        {
            "field_mean": (F.sum("ability").over(race) - F.coalesce(a, F.lit(0.0))) / F.nullif(others, F.lit(0)),
            "field_coverage": others / F.nullif(F.count(F.lit(1)).over(race) - 1, F.lit(0)),
            "ability_rank": average_rank(a, RACE, ascending=False),
            "ability_pct": average_rank(a, RACE) / F.count("ability").over(race),
        }
    )
    daily = out.groupBy("horse_id", "dn").agg(F.sum("field_mean").alias("s"), F.count("field_mean").alias("k"))
    mean = lambda first: F.try_divide(F.sum("s").over(day.rowsBetween(first, -1)), F.sum("k").over(day.rowsBetween(first, -1)))
    past = daily.select(F.col("horse_id").alias("__horse"), F.col("dn").alias("__day"), mean(-1).alias("prev_field"), mean(-3).alias("field3"), mean(-5).alias("field5"), mean(Window.unboundedPreceding).alias("field_all"))
    out = out.join(past, F.col("horse_id").eqNullSafe(F.col("__horse")) & (F.col("dn") == F.col("__day"))).drop("__horse", "__day")
    return out.withColumns({"edge": a - F.col("field_mean"), "field_trend": F.col("prev_field") - F.col("field5"), "field_step": F.col("field_mean") - F.col("field_all")})


def ratio(a: Column, b: Column) -> Column:
    """Null-safe division; a zero below is null."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def candidates(df: DataFrame) -> DataFrame:
    """Adds candidate features c_* from whatever prior columns the frame has."""
    race = Window.partitionBy(RACE)
    has = set(df.columns).issuperset
    c = F.col
    out: dict[str, Column] = {}

    def add(name: str, needs: tuple[str, ...], value: Column) -> None:
        if has(needs):
            out[f"c_{name}"] = value

    add("momentum_finish", ("recent5_finish_pct_mean", "recent3_finish_pct_mean"), c("recent5_finish_pct_mean") - c("recent3_finish_pct_mean"))
    add("momentum_time", ("recent5_time_diff_mean", "recent3_time_diff_mean"), c("recent5_time_diff_mean") - c("recent3_time_diff_mean"))
    add("log_experience", ("prior_start_count",), F.log1p("prior_start_count"))
    add("rest_band", ("days_since_last_run",), c("days_since_last_run").between(14, 70).cast("double"))
    add("log_rest", ("days_since_last_run",), F.when(c("days_since_last_run").isNotNull(), F.log1p(F.greatest(c("days_since_last_run"), F.lit(0)))))
    add("win_conversion", ("prior_win_rate", "prior_top3_rate"), ratio(c("prior_win_rate"), c("prior_top3_rate")))
    add("top2_conversion", ("prior_top2_rate", "prior_top3_rate"), ratio(c("prior_top2_rate"), c("prior_top3_rate")))
    add("win_of_top2", ("prior_win_rate", "prior_top2_rate"), ratio(c("prior_win_rate"), c("prior_top2_rate")))
    add("distance_share", ("same_distance_prior_count", "prior_start_count"), ratio(c("same_distance_prior_count"), c("prior_start_count")))
    add("track_share", ("same_track_prior_count", "prior_start_count"), ratio(c("same_track_prior_count"), c("prior_start_count")))
    add("finish_edge", ("prior_avg_finish_pct", "recent3_finish_pct_mean"), c("prior_avg_finish_pct") - c("recent3_finish_pct_mean"))
    add("time_edge", ("prior_avg_time_diff", "recent3_time_diff_mean"), c("prior_avg_time_diff") - c("recent3_time_diff_mean"))
    add("experience_field", ("prior_start_count",), ratio(c("prior_start_count"), F.avg("prior_start_count").over(race)))
    add("win_field", ("prior_win_rate",), ratio(c("prior_win_rate"), F.avg("prior_win_rate").over(race)))
    add("top3_field", ("prior_top3_rate",), ratio(c("prior_top3_rate"), F.avg("prior_top3_rate").over(race)))
    add("win_step", ("prior_win_rate",), c("prior_win_rate") - F.avg("prior_win_rate").over(race))
    add("top3_step", ("prior_top3_rate",), c("prior_top3_rate") - F.avg("prior_top3_rate").over(race))
    add("finish_step", ("prior_avg_finish_pct",), F.avg("prior_avg_finish_pct").over(race) - c("prior_avg_finish_pct"))
    add("time_step", ("prior_avg_time_diff",), F.avg("prior_avg_time_diff").over(race) - c("prior_avg_time_diff"))
    return df.withColumns(out)


def triage(coverage: Column, unique: Column, redundancy: Column, mean: Column, least: Column) -> Column:
    return F.when((coverage < 0.55) | (unique < 5) | (redundancy >= 0.98) | (mean < 0.515) | (least < 0.505), "REJECT").otherwise("KEEP")


def sigmoid_of_minus(c: Column) -> Column:
    """1 / (1 + exp(x)) on x clipped to 8 in size."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), c))))
