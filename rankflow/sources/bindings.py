"""Contest tables bound to the star-schema tables.

A contest is an order, its entrants are the order's suppliers (one row per order and
supplier), placed by price; an agent is the brand of the dearest part. Each binding
has its SQL beside it, as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ln

#: Days from 0001-01-01 (ordinal 1) to 1970-01-01.
EPOCH_ORDINAL = 719163


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of lineitem that a task of an exchange by contest or competitor gets.
TASK_ROWS = 250_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of such exchanges: as many as the rows ask for (counted from the files' footers), so that a task's share does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_id, day, dn, venue, race_class, domain, distance, track, grade of every contest."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("race_id"),
        F.to_date("o_orderdate").alias("day"),
        F.unix_date(F.to_date("o_orderdate")).alias("dn"),
        F.col("o_orderstatus").alias("venue"),
        F.substring("o_orderpriority", 1, 1).alias("race_class"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("domain"),
        (1000 + 200 * (F.col("o_custkey") % 8)).cast("int").alias("distance"),
        F.concat(F.lit("1"), (F.col("o_custkey") % 3).cast("string")).alias("track"),
        F.when(F.col("o_custkey") % 5 == 0, "").otherwise((F.col("o_custkey") % 4).cast("string")).alias("grade"),
    )


CONTESTS = """c AS (SELECT o_orderkey AS race_id, CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS dn, o_orderstatus AS venue,
 substr(o_orderpriority, 1, 1) AS race_class, CAST(o_orderkey % 2 + 1 AS INTEGER) AS domain, CAST(1000 + 200 * (o_custkey % 8) AS INTEGER) AS distance,
 '1' || CAST(o_custkey % 3 AS VARCHAR) AS track, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS grade FROM orders)"""


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_id, horse_id, price, agent_id, abnormal: one row per order and supplier.

    Lines move once, by contest; what is grouped by contest afterwards needs no exchange.
    """
    dear = _dearest(spark, sf_dir)
    odd = (F.col("race_id") * 7 + F.col("horse_id")) % 97
    return (
        _with_agent(spark, sf_dir, dear)
        .select("race_id", "horse_id", "price", "agent_id")
        .withColumn("abnormal", F.when(odd == 0, "1").when(odd == 1, "4").otherwise("0"))
    )


def _dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_id, horse_id, price and pk, the part, of each order and supplier's dearest line, by contest."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.col("l_suppkey").alias("horse_id"), "l_extendedprice", "l_partkey").repartition(tasks(spark, sf_dir), "race_id")
    dear = li.groupBy("race_id", "horse_id").agg(F.max(F.struct("l_extendedprice", "l_partkey")).alias("top"))
    return dear.select("race_id", "horse_id", F.col("top.l_extendedprice").alias("price"), F.col("top.l_partkey").alias("pk"))


def _with_agent(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Adds the brand of part `pk`; keys of parts are told to be unique, so that the join goes where nothing reads the brand."""
    part = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("__pk")).agg(F.max("p_brand").alias("agent_id"))
    return rows.join(part, F.col("pk") == F.col("__pk"), "left")


RUNNERS = """r0 AS (SELECT l_orderkey AS race_id, l_suppkey AS horse_id, max(struct_pack(p := l_extendedprice, k := l_partkey)) AS top FROM lineitem GROUP BY 1, 2),
r AS (SELECT race_id, horse_id, top.p AS price, p_brand AS agent_id,
 CASE (race_id * 7 + horse_id) % 97 WHEN 0 THEN '1' WHEN 1 THEN '4' ELSE '0' END AS abnormal FROM r0 LEFT JOIN part ON p_partkey = top.k)"""


def entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners with their contest's columns, finish, field size n and labels; contests of two or more."""
    race = Window.partitionBy("race_id")
    odd = (F.col("race_id") * 7 + F.col("horse_id")) % 97
    placed = (
        _dearest(spark, sf_dir)
        .withColumn("n", F.count(F.lit(1)).over(race))
        .where("n >= 2")
        .withColumn("finish", F.row_number().over(race.orderBy(F.desc("price"), "horse_id")))
        .join(contests(spark, sf_dir), "race_id")
    )
    return (
        _with_agent(spark, sf_dir, placed)
        .drop("pk", "__pk")
        .withColumn("abnormal", F.when(odd == 0, "1").when(odd == 1, "4").otherwise("0"))
        .withColumns({name: (F.col("finish") <= k).cast("int") for name, k in (("label_win", 1), ("label_top2", 2), ("label_top3", 3))})
    )


ENTRANTS = (
    CONTESTS
    + ",\n"
    + RUNNERS
    + """,
r1 AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, horse_id) AS finish FROM r),
e AS (SELECT r1.*, c.* EXCLUDE (race_id), CAST(finish <= 1 AS INTEGER) AS label_win, CAST(finish <= 2 AS INTEGER) AS label_top2, CAST(finish <= 3 AS INTEGER) AS label_top3
 FROM r1 JOIN c USING (race_id) WHERE n >= 2)"""
)


def feature_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entrants with the prior-form columns that the feature operators read.

    form = place among the field as a share (0 best), gap = log price ratio to the
    winner. Both are summed in whole units of 1e-12, so that sums do not hang on the order of
    their rows; a logarithm's last digit can decide a unit, and a unit the number of distinct means. All prior columns come from earlier days of the competitor: no row informs
    another one of its day. Rows are summed per day and condition first; these sums are
    brought together by competitor once, numbered by day, and every window runs over them
    there, so that one join attaches all prior columns.
    """
    race, own = Window.partitionBy("race_id"), Window.partitionBy("horse_id")
    e = entrants(spark, sf_dir).withColumn("form", (F.col("finish") - 1) / (F.col("n") - 1)).withColumn("gap", F.max("price").over(race) / F.col("price")).withColumn("gap", ln(F.col("gap")))
    sums = ["label_win", "label_top2", "label_top3", "form", "gap"]
    keys = ["horse_id", "distance", "track", "dn"]
    exact = lambda c: F.round(F.col(c) * 1e12).cast("long") if c in ("form", "gap") else F.col(c)
    daily = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), *[F.sum(exact(c)).alias(c) for c in sums]).repartition(tasks(spark, sf_dir), "horse_id").withColumn("nth", F.dense_rank().over(own.orderBy("dn")))
    before = lambda days, *like: Window.partitionBy("horse_id", *like).orderBy("nth").rangeBetween(-days if days else Window.unboundedPreceding, -1)
    every, last3, last5 = before(None), before(3), before(5)
    mean = lambda c, w: F.sum(c).over(w) / (1e12 if c in ("form", "gap") else 1.0) / F.sum("k").over(w)
    past = daily.select(
        *[F.col(c).alias(f"__{c}") for c in keys],
        F.coalesce(F.sum("k").over(every), F.lit(0)).alias("prior_start_count"),
        (F.col("dn") - F.max("dn").over(every)).alias("days_since_last_run"),
        mean("label_win", every).alias("prior_win_rate"),
        mean("label_top2", every).alias("prior_top2_rate"),
        mean("label_top3", every).alias("prior_top3_rate"),
        mean("form", every).alias("prior_avg_finish_pct"),
        mean("gap", every).alias("prior_avg_time_diff"),
        mean("form", last3).alias("recent3_finish_pct_mean"),
        mean("form", last5).alias("recent5_finish_pct_mean"),
        mean("gap", last3).alias("recent3_time_diff_mean"),
        mean("gap", last5).alias("recent5_time_diff_mean"),
        *[F.coalesce(F.sum("k").over(before(None, c)), F.lit(0)).alias(f"same_{c}_prior_count") for c in ("distance", "track")],
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return e.join(past, same).drop(*[f"__{c}" for c in keys])


FEATURE_BASE = (
    ENTRANTS
    + """,
f0 AS (SELECT *, (finish - 1) / (n - 1)::DOUBLE AS form, ln(max(price) OVER (PARTITION BY race_id) / price) AS gap FROM e),
fd AS (SELECT horse_id, dn, count(*) AS k, sum(label_win) AS w1, sum(label_top2) AS w2, sum(label_top3) AS w3, CAST(sum(CAST(round(form * 1e12) AS BIGINT)) AS BIGINT) AS form, CAST(sum(CAST(round(gap * 1e12) AS BIGINT)) AS BIGINT) AS gap FROM f0 GROUP BY 1, 2),
fp AS (SELECT horse_id, dn, CAST(coalesce(sum(k) OVER b, 0) AS BIGINT) AS prior_start_count, dn - lag(dn) OVER o AS days_since_last_run,
 sum(w1) OVER b / sum(k) OVER b AS prior_win_rate, sum(w2) OVER b / sum(k) OVER b AS prior_top2_rate, sum(w3) OVER b / sum(k) OVER b AS prior_top3_rate, sum(form) OVER b / 1e12 / sum(k) OVER b AS prior_avg_finish_pct, sum(gap) OVER b / 1e12 / sum(k) OVER b AS prior_avg_time_diff,
 sum(form) OVER l3 / 1e12 / sum(k) OVER l3 AS recent3_finish_pct_mean, sum(form) OVER l5 / 1e12 / sum(k) OVER l5 AS recent5_finish_pct_mean, sum(gap) OVER l3 / 1e12 / sum(k) OVER l3 AS recent3_time_diff_mean, sum(gap) OVER l5 / 1e12 / sum(k) OVER l5 AS recent5_time_diff_mean
 FROM fd WINDOW o AS (PARTITION BY horse_id ORDER BY dn), b AS (PARTITION BY horse_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l3 AS (PARTITION BY horse_id ORDER BY dn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), l5 AS (PARTITION BY horse_id ORDER BY dn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
f AS (SELECT f0.*, fp.* EXCLUDE (horse_id, dn),
 count(*) OVER (PARTITION BY horse_id, distance ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_distance_prior_count,
 count(*) OVER (PARTITION BY horse_id, track ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_track_prior_count
 FROM f0 JOIN fp USING (horse_id, dn))"""
)


def workouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contests and evidence of the point-in-time join, both from events.

    Outcomes: purchases, each an entrant of the contest of its day and stretch of 24 events.
    Evidence: views and clicks with an event day, a creation day (event time plus
    props.k hours), a center, a clock time and two measured values.
    """
    ev = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    day = F.unix_date(F.to_date("t"))
    out = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("race_row"), F.col("user_id").alias("horse_id"), day.alias("dn"), (day.cast("long") * 1_000_000_000 + F.floor(F.col("event_id") / 24)).alias("race_id"), "value")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    seen = ev.where("event_type in ('view', 'click')").select(
        F.col("user_id").alias("horse_id"),
        day.alias("wd"),
        F.unix_date(F.to_date(F.timestamp_seconds(F.unix_timestamp("t") + k * 3600))).alias("created"),
        F.when(F.col("event_type") == "view", "A").otherwise("B").alias("center"),
        F.unix_timestamp("t").alias("clock"),
        F.col("event_id").alias("wid"),
        F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("f1"),
        F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value") * 4 + F.col("event_id") % 13).alias("f4"),
    )
    return out, seen


WORKOUTS = """ev AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d FROM events),
o AS (SELECT event_id AS race_row, user_id AS horse_id, d AS dn, d * 1000000000 + event_id // 24 AS race_id, value FROM ev WHERE event_type = 'purchase'),
w AS (SELECT user_id AS horse_id, d AS wd, date_diff('day', DATE '1970-01-01', CAST(ts + to_hours(CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS INTEGER)) AS DATE)) AS created,
 CASE event_type WHEN 'view' THEN 'A' ELSE 'B' END AS center, CAST(floor(epoch(ts)) AS BIGINT) AS clock, event_id AS wid, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS f1, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 4 + event_id % 13 END AS f4 FROM ev WHERE event_type IN ('view', 'click'))"""
