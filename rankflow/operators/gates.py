"""Gates: rules that count violations in one scan, name issues, and split rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: for each rule, the number of rows for which it holds; rows; status PASS or BLOCKED."""
    out = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])
    bad = F.lit(0)
    for k in rules:
        bad = bad + F.col(k)
    return out.withColumn("status", F.when(bad == 0, "PASS").otherwise("BLOCKED"))


def issues(df: DataFrame, rules: Mapping[str, Column], name: str = "issues") -> DataFrame:
    """Adds the sorted names of the rules that hold for a row."""
    return df.withColumn(name, F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()]))))


def split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without an issue, and the quarantined rest."""
    marked = issues(df, rules)
    return marked.where(F.size("issues") == 0).drop("issues"), marked.where(F.size("issues") > 0)


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds."""
    return F.coalesce(*[F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules])


def valid_conditions() -> Column:
    """Distance of digits and above zero, two-digit track other than 00, a class."""
    digits = F.col("distance").cast("string").rlike("^[0-9]+$") & (F.expr("try_cast(distance as int)") > 0)
    return digits & F.col("track").rlike("^[0-9]{2}$") & (F.col("track") != "00") & (F.trim("race_class") != "")


def eligibility(runners: DataFrame, conditions: DataFrame) -> DataFrame:
    """Per contest of `runners` (race_id, horse_id, abnormal, finish as text): rows, absent, whether more than one won, and `reason`, the first that fails.

    `conditions` has race_id, copies and valid. The reasons, in order: no_conditions,
    duplicate_conditions, invalid_conditions, duplicate_competitor, unknown_id_or_status,
    unresolved_result, no_winner; else eligible.
    """
    active, finish = ~F.col("abnormal").isin("1", "2", "3"), F.col("finish").try_cast("int")
    open_ = ~F.col("finish").rlike("^[0-9]+$") | ((finish < 1) & (F.col("abnormal") != "4"))
    g = runners.groupBy("race_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~active).alias("absent"), (F.count("horse_id") - F.count_distinct("horse_id")).alias("again"), F.count_if(F.col("horse_id").isNull() | ~F.coalesce(F.col("abnormal").rlike("^[0-7]$"), F.lit(False))).alias("unknown"),
        F.count_if(active & open_).alias("open"), F.count_if(active & (finish == 1)).alias("winners"),
    )
    c = F.col
    rules = [
        ("no_conditions", c("copies").isNull()), ("duplicate_conditions", c("copies") > 1), ("invalid_conditions", ~c("valid")), ("duplicate_competitor", c("again") > 0), ("unknown_id_or_status", c("unknown") > 0),
        ("unresolved_result", (c("absent") == c("rows")) | (c("open") > 0)), ("no_winner", c("winners") == 0),
    ]
    told = g.join(conditions, "race_id", "left")
    return told.select("race_id", "rows", "absent", (c("winners") > 1).alias("tie"), F.coalesce(first_reason(rules), F.lit("eligible")).alias("reason"))


def canonical_rules(key_count: Column, day: Column, scope: Column, key: Column, win: Column, top2: Column, top3: Column) -> dict[str, Column]:
    """Rules of a canonical row; values are text as delivered."""
    number = lambda c: c.try_cast("double")
    off = lambda c: number(c).isNull() | ~number(c).isin(0.0, 1.0)
    return {
        "null_key": key.isNull() | (F.trim(key) == ""),
        "duplicate_key": key_count > 1,
        "bad_date": F.try_to_date(day, "yyyy-MM-dd").isNull(),
        "bad_scope": number(scope).isNull() | ~number(scope).isin(1.0, 2.0),
        "bad_win": off(win),
        "bad_top2": off(top2),
        "bad_top3": off(top3),
        "not_monotone": (number(win) > number(top2)) | (number(top2) > number(top3)),
    }


def segment(df: DataFrame, spec: Mapping[str, Sequence[str]], scope: int | None = None) -> Column:
    """AND of `column IN values`, blind to case and outer spaces; a missing column or an empty list is an error."""
    for c, values in spec.items():
        if c not in df.columns or not values:
            raise ValueError(f"segment on {c!r} can't be evaluated")
    out = F.lit(True)
    for c, values in spec.items():
        out = out & F.upper(F.trim(F.col(c).cast("string"))).isin(*[str(v).strip().upper() for v in values])
    return out & (F.col("race_scope_cd") == scope) if scope is not None else out


def domain(c: Column) -> Column:
    """1, 1.0, JRA -> JRA; 2, 2.0, NAR -> NAR; all else null."""
    text = F.upper(F.trim(c.cast("string")))
    return F.when(text.isin("1", "1.0", "JRA"), "JRA").when(text.isin("2", "2.0", "NAR"), "NAR")


def before_start(day: Column, clock: Column, captured: Column, now: Column, max_age_hours: int = 24) -> Column:
    """Capture at or before now, now before the start, capture not too old; a clock of 0000 is no start."""
    start = F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmm"))
    age = F.unix_timestamp(now) - F.unix_timestamp(captured)
    return F.coalesce((clock != "0000") & (captured <= now) & (now < start) & (age <= max_age_hours * 3600), F.lit(False))


def probability_rules(p1: str, p2: str, p3: str) -> dict[str, Column]:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0.0, 1.0)
    return {"bad_p1": bad(p1), "bad_p2": bad(p2), "bad_p3": bad(p3), "not_ascending": (F.col(p1) > F.col(p2) + 1e-12) | (F.col(p2) > F.col(p3) + 1e-12)}


def same_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys are in one side only, and whether none is."""
    left = a.select(*keys).exceptAll(b.select(*keys)).agg(F.count(F.lit(1)).alias("only_left"))
    right = b.select(*keys).exceptAll(a.select(*keys)).agg(F.count(F.lit(1)).alias("only_right"))
    return left.join(right).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


OUTCOMES = ("finish", "label_win", "label_top2", "label_top3", "payout_per_100")


def result_blind(df: DataFrame, key: Sequence[str], probabilities: tuple[str, str, str], frame: str) -> DataFrame:
    """Violations of predictions that must not know results; outcome columns or missing ones are an error before any row is read."""
    seen = {c for c in df.columns if c.lower() in OUTCOMES}
    if seen:
        raise ValueError(f"outcome columns are forbidden here: {', '.join(sorted(seen))}")
    lacking = [c for c in (*key, *probabilities, frame) if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__k")).where("__k > 1").agg(F.coalesce(F.sum("__k"), F.lit(0)).alias("duplicate_key"))
    told = violations(df, probability_rules(*probabilities) | {"bad_frame": ~F.col(frame).between(1, 8)}).join(counted)
    return told.withColumn("status", F.when(F.col("duplicate_key") > 0, "BLOCKED").otherwise(F.col("status")))


def refresh(conditions: DataFrame, runners: DataFrame, first: str, through: str, observed: str) -> DataFrame:
    """Gate of a history refresh (race_id, day, created; runners with horse_id) for the days first..through: one row of counts, and status.

    Keys must be unique, both sides name the same contests, all days lie in the interval,
    which ends before the day of observation, and nothing was created after that day.
    """
    repeated = lambda df, keys, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias(name))
    alone = lambda a, b, name: a.select("race_id").distinct().join(b, "race_id", "left_anti").agg(F.count(F.lit(1)).alias(name))
    day = lambda x: F.lit(x).cast("date")
    both = conditions.select("day", "created").union(runners.select("day", "created"))
    out = F.col("day").isNull() | ~F.col("day").between(day(first), day(through))
    rows = both.agg(F.count_if(out).alias("outside_interval"), F.count_if(F.col("created") > day(observed)).alias("future_dated"))
    counts = [repeated(conditions, ["race_id"], "repeated_conditions"), repeated(runners, ["race_id", "horse_id"], "repeated_runners"), alone(conditions, runners, "without_runners"), alone(runners, conditions, "without_conditions")]
    for c in counts:  # one row each
        rows = rows.join(c)
    rows = rows.withColumn("before_observation", (day(first) <= day(through)) & (day(through) < day(observed)))
    bad = sum((F.col(c) for c in rows.columns if c != "before_observation"), F.lit(0))
    return rows.withColumn("status", F.when((bad == 0) & F.col("before_observation"), "PASS").otherwise("BLOCKED"))
