"""Queries on features, splits, resampling and point-in-time evidence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import count_rows
from ..operators import features, history, metrics, pit, resample, splits
from ..registry import query
from ..sources.readers import stored
from ..sources.bindings import ENTRANTS, FEATURE_BASE, WORKOUTS, entrants, feature_base, workouts
from .rating_queries import AGENT, DAILY, P1, PL, SWAPS, THREE, base_rates, daily_deltas, swaps, three_losses

R = F.round

ABILITY = f"""{FEATURE_BASE}, a0 AS (SELECT *, list_filter([prior_win_rate, prior_top3_rate, 1 - prior_avg_finish_pct, 1 - recent3_finish_pct_mean, 1 - prior_avg_time_diff], lambda x: x IS NOT NULL) AS parts FROM f),
ab AS (SELECT *, CASE WHEN len(parts) > 0 THEN list_sum(parts) / len(parts) END AS ability, CAST(len(parts) AS INTEGER) AS components FROM a0),
fs0 AS (SELECT *, (sum(ability) OVER r - coalesce(ability, 0)) / nullif(count(ability) OVER r - CAST(ability IS NOT NULL AS INTEGER), 0) AS field_mean, (count(ability) OVER r - CAST(ability IS NOT NULL AS INTEGER)) / nullif(count(*) OVER r - 1, 0)::DOUBLE AS field_coverage,
 CASE WHEN ability IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY ability DESC NULLS LAST) + (count(*) OVER (PARTITION BY race_id, ability) - 1) / 2.0 END AS ability_rank,
 CASE WHEN ability IS NOT NULL THEN (rank() OVER (PARTITION BY race_id ORDER BY ability NULLS LAST) + (count(*) OVER (PARTITION BY race_id, ability) - 1) / 2.0) / count(ability) OVER r END AS ability_pct FROM ab WINDOW r AS (PARTITION BY race_id)),
fsd AS (SELECT horse_id, dn, sum(field_mean) AS s, count(field_mean) AS k FROM fs0 GROUP BY 1, 2),
fsp AS (SELECT horse_id, dn, sum(s) OVER l1 / nullif(sum(k) OVER l1, 0) AS prev_field, sum(s) OVER l3 / nullif(sum(k) OVER l3, 0) AS field3, sum(s) OVER l5 / nullif(sum(k) OVER l5, 0) AS field5, sum(s) OVER b / nullif(sum(k) OVER b, 0) AS field_all FROM fsd
 WINDOW l1 AS (PARTITION BY horse_id ORDER BY dn ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), l3 AS (PARTITION BY horse_id ORDER BY dn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), l5 AS (PARTITION BY horse_id ORDER BY dn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY horse_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fs AS (SELECT fs0.*, fsp.* EXCLUDE (horse_id, dn) FROM fs0 JOIN fsp USING (horse_id, dn))"""


def strength(spark, sf_dir):
    return features.field_strength(features.ability(feature_base(spark, sf_dir)))


def _rounded(name, sql_expr, column, sql_column=None):
    """A query that returns one rounded feature column per entrant."""

    def run(spark, sf_dir):
        return strength(spark, sf_dir).select("race_id", "horse_id", *[R(c, 6).alias(c) for c in column])

    run.__name__ = name
    return query(f"WITH {ABILITY} SELECT race_id, horse_id, {sql_expr} FROM fs")(run)


_cols = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
w05_leave_one_out = _rounded("w05_leave_one_out", _cols("field_mean", "field_coverage"), ["field_mean", "field_coverage"])
w06_average_rank = _rounded("w06_average_rank", _cols("ability_rank", "ability_pct"), ["ability_rank", "ability_pct"])
w07_previous_value = _rounded("w07_previous_value", _cols("prev_field"), ["prev_field"])
w08_prior_rolling_mean = _rounded("w08_prior_rolling_mean", _cols("field3", "field5"), ["field3", "field5"])


@query(f"WITH {ABILITY} SELECT race_id, horse_id, round(field_all, 6) AS field_all, round(prev_field - field5, 6) AS field_trend FROM fs")
def w09_prior_expanding_mean(spark, sf_dir):
    return strength(spark, sf_dir).select("race_id", "horse_id", R("field_all", 6).alias("field_all"), R("field_trend", 6).alias("field_trend"))


@query(f"WITH {ABILITY} SELECT race_id, horse_id, round(ability, 6) AS ability, components, round(ability - field_mean, 6) AS edge, round(field_mean - field_all, 6) AS field_step FROM fs")
def m19_field_strength(spark, sf_dir):
    return strength(spark, sf_dir).select("race_id", "horse_id", R("ability", 6).alias("ability"), "components", R("edge", 6).alias("edge"), R("field_step", 6).alias("field_step"))


_over = lambda c: f"avg({c}) OVER (PARTITION BY race_id)"
_ratio = lambda a, b: f"{a}::DOUBLE / nullif({b}, 0)"
CANDIDATE_SQL = {
    "momentum_finish": "recent5_finish_pct_mean - recent3_finish_pct_mean", "momentum_time": "recent5_time_diff_mean - recent3_time_diff_mean", "log_experience": "ln(1 + prior_start_count)",
    "rest_band": "CAST(days_since_last_run BETWEEN 14 AND 70 AS DOUBLE)", "log_rest": "CASE WHEN days_since_last_run IS NOT NULL THEN ln(1 + greatest(days_since_last_run, 0)) END",
    "win_conversion": _ratio("prior_win_rate", "prior_top3_rate"), "top2_conversion": _ratio("prior_top2_rate", "prior_top3_rate"), "win_of_top2": _ratio("prior_win_rate", "prior_top2_rate"),
    "distance_share": _ratio("same_distance_prior_count", "prior_start_count"), "track_share": _ratio("same_track_prior_count", "prior_start_count"),
    "finish_edge": "prior_avg_finish_pct - recent3_finish_pct_mean", "time_edge": "prior_avg_time_diff - recent3_time_diff_mean", "experience_field": _ratio("prior_start_count", _over("prior_start_count")),
    "win_field": _ratio("prior_win_rate", _over("prior_win_rate")), "top3_field": _ratio("prior_top3_rate", _over("prior_top3_rate")), "win_step": f"prior_win_rate - {_over('prior_win_rate')}",
    "top3_step": f"prior_top3_rate - {_over('prior_top3_rate')}", "finish_step": f"{_over('prior_avg_finish_pct')} - prior_avg_finish_pct", "time_step": f"{_over('prior_avg_time_diff')} - prior_avg_time_diff",
}


@query(f"WITH {FEATURE_BASE} SELECT race_id, horse_id, " + ", ".join(f"round({x}, 8) + 0.0 AS c_{n}" for n, x in CANDIDATE_SQL.items()) + " FROM f")
def m17_candidate_features(spark, sf_dir):
    """All nineteen candidate features."""
    return features.candidates(feature_base(spark, sf_dir)).select("race_id", "horse_id", *[(R(f"c_{x}", 8) + 0.0).alias(f"c_{x}") for x in CANDIDATE_SQL])


PLAN = [("TRAIN", "1995-01-01", "1998-12-31"), ("VALIDATION", "1999-01-01", "1999-06-30"), ("SELECTION", "1999-07-01", "1999-12-31"), ("TEST", "2000-01-01", "2000-12-31"), ("OOS", "2001-01-01", "2001-12-31")]
PLAN_SQL = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PLAN) + ") AS t(split, a, b))"


@query(f"WITH {ENTRANTS}, {PLAN_SQL} SELECT split, count(*) AS rows, count(DISTINCT race_id) AS races FROM e LEFT JOIN pl ON day BETWEEN a AND b GROUP BY 1")
def p20_split_mask(spark, sf_dir):
    e = entrants(spark, sf_dir).withColumn("split", splits.assigned(None, PLAN))
    return e.groupBy("split").agg(count_rows().alias("rows"), F.count_distinct("race_id").alias("races"))


@query(f"""WITH {FEATURE_BASE}, {PLAN_SQL} SELECT split, count(*) AS rows, count(DISTINCT race_id) AS races, count(DISTINCT horse_id) AS competitors, count(*) FILTER (domain = 1) AS jra, count(*) FILTER (domain = 2) AS nar, CAST(sum(label_win) AS BIGINT) AS wins, CAST(sum(label_top3) AS BIGINT) AS top3,
 round(avg(CAST(prior_start_count >= 1 AS INTEGER)), 6) AS p1, round(avg(CAST(prior_start_count >= 3 AS INTEGER)), 6) AS p3, round(avg(CAST(prior_start_count >= 6 AS INTEGER)), 6) AS p6 FROM f JOIN pl ON day BETWEEN a AND b GROUP BY 1""")
def a12_split_population(spark, sf_dir):
    f = feature_base(spark, sf_dir).withColumn("split", splits.assigned(None, PLAN)).where("split is not null")
    rate = lambda k: R(F.avg((F.col("prior_start_count") >= k).cast("int")), 6)
    return f.groupBy("split").agg(
        count_rows().alias("rows"), F.count_distinct("race_id").alias("races"), F.count_distinct("horse_id").alias("competitors"), F.count_if(F.col("domain") == 1).alias("jra"), F.count_if(F.col("domain") == 2).alias("nar"),
        F.sum("label_win").alias("wins"), F.sum("label_top3").alias("top3"), rate(1).alias("p1"), rate(3).alias("p3"), rate(6).alias("p6"),
    )


CUTS = f"""{ENTRANTS}, dd AS (SELECT day, count(DISTINCT race_id) AS n FROM e GROUP BY 1), cu AS (SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total FROM dd)"""


@query(f"WITH {CUTS} SELECT CAST(day AS VARCHAR) AS day, cum FROM cu")
def w14_cumulative_days(spark, sf_dir):
    d = entrants(spark, sf_dir).groupBy("day").agg(F.count_distinct("race_id").alias("n"))
    return d.select(F.col("day").cast("string").alias("day"), F.sum("n").over(Window.orderBy("day")).alias("cum"))


@query(f"WITH {CUTS}, g AS (SELECT CAST(unnest([0.45, 0.55, 0.65, 0.75, 0.85]) AS DOUBLE) AS fraction) SELECT fraction, CAST(arg_min(day, (abs(cum - fraction * total), day)) AS VARCHAR) AS cut FROM cu, g GROUP BY 1")
def w19_walk_forward_folds(spark, sf_dir):
    races = entrants(spark, sf_dir).select("race_id", "day").distinct()
    return splits.cuts(races, spark.createDataFrame([(x,) for x in (0.45, 0.55, 0.65, 0.75, 0.85)], "fraction double")).withColumn("cut", F.col("cut").cast("string"))


PROFILES = [("balanced", 0.6), ("long_train", 0.7), ("short_train", 0.5), ("long_tail", 0.55), ("late", 0.8)]
M20 = f"""{FEATURE_BASE}, dd AS (SELECT day, count(DISTINCT race_id) AS n FROM e GROUP BY 1), cu AS (SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total FROM dd), g AS (SELECT * FROM (VALUES {", ".join(f"('{n}', CAST({x} AS DOUBLE))" for n, x in PROFILES)}) AS t(profile, fraction)),
ct AS (SELECT profile, arg_min(day, (abs(cum - fraction * total), day)) AS cut FROM cu, g GROUP BY 1),
st AS (SELECT profile, cut, count(DISTINCT race_id) AS total, max(dn) - min(dn) + 1 AS span, count(DISTINCT race_id) FILTER (day <= cut) AS train, avg(CAST(prior_start_count >= 3 AS INTEGER)) FILTER (day <= cut) AS p3, count(DISTINCT race_id) FILTER (day > cut) AS races,
 least(sum(label_win) FILTER (day > cut), sum(label_top2) FILTER (day > cut), sum(label_top3) FILTER (day > cut)) AS positives, count(DISTINCT race_id) FILTER (day > cut AND domain = 1) AS d1, count(DISTINCT race_id) FILTER (day > cut AND domain = 2) AS d2 FROM f, ct GROUP BY 1, 2),
gt AS (SELECT *, least(d1, d2) AS domain, CAST(total >= 3000 AND total < 8000 AS INTEGER) + CAST(span < 365 AS INTEGER) + CAST(d1 < 100 AS INTEGER) + CAST(d2 < 100 AS INTEGER) + CAST(p3 < 0.35 AS INTEGER) AS warn,
 CAST(total < 3000 AS INTEGER) + CAST(races < 250 AS INTEGER) + CAST(positives < 100 AS INTEGER) + CAST(train < 1500 AS INTEGER) AS block FROM st),
sc AS (SELECT *, CAST(2 * races + 3 * positives + domain + 0.15 * least(train, 10000) + 500 * p3 - 25 * warn - 100000 * block AS DOUBLE) AS score FROM gt)"""


@query(f"WITH {M20} SELECT profile, CAST(cut AS VARCHAR) AS cut, train, races, CAST(positives AS BIGINT) AS positives, round(p3, 6) AS p3, warn, block, round(score, 4) AS score FROM sc")
def m20_split_profiles(spark, sf_dir):
    """Five ratio profiles with their gates, and a score from population figures alone."""
    c = F.col
    f = feature_base(spark, sf_dir).select("race_id", "day", "dn", "domain", "label_win", "label_top2", "label_top3", "prior_start_count")
    cut = splits.cuts(f.select("race_id", "day").distinct(), spark.createDataFrame(PROFILES, "profile string, fraction double")).drop("fraction")
    late, early = c("day") > c("cut"), c("day") <= c("cut")
    races = lambda w: F.count_distinct(F.when(w, c("race_id")))
    st = f.join(F.broadcast(cut)).groupBy("profile", "cut").agg(  # five rows
        F.count_distinct("race_id").alias("total"), (F.max("dn") - F.min("dn") + 1).alias("span"), races(early).alias("train"), F.avg(F.when(early, (c("prior_start_count") >= 3).cast("int"))).alias("p3"), races(late).alias("races"),
        F.least(*[F.sum(F.when(late, c(y))) for y in ("label_win", "label_top2", "label_top3")]).alias("positives"), races(late & (c("domain") == 1)).alias("d1"), races(late & (c("domain") == 2)).alias("d2"),
    )
    flag = lambda *x: sum((y.cast("int") for y in x[1:]), x[0].cast("int"))
    st = st.withColumn("warn", flag((c("total") >= 3000) & (c("total") < 8000), c("span") < 365, c("d1") < 100, c("d2") < 100, c("p3") < 0.35))
    st = st.withColumn("block", flag(c("total") < 3000, c("races") < 250, c("positives") < 100, c("train") < 1500))
    score = splits.adequacy(c("races"), c("positives"), F.least("d1", "d2"), c("train"), c("p3"), c("warn"), c("block"))
    return st.select("profile", c("cut").cast("string").alias("cut"), "train", "races", "positives", R("p3", 6).alias("p3"), "warn", "block", R(score.cast("double"), 4).alias("score"))


@query(f"WITH {M20} SELECT arg_max(profile, (round(score, 4), profile)) AS profile FROM sc WHERE block = 0")
def t08_best_split_profile(spark, sf_dir):
    return m20_split_profiles(spark, sf_dir).where("block = 0").agg(F.max_by("profile", F.struct("score", "profile")).alias("profile"))


FEATS = ["prior_win_rate", "prior_avg_time_diff", "days_since_last_run", "recent3_finish_pct_mean", "same_track_prior_count"]


EXISTING = ["prior_top3_rate", "prior_top2_rate", "prior_start_count", "prior_avg_finish_pct"]
REDUNDANT = "rp AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, '{o}' AS other, round({x}::DOUBLE, 9) AS a, round({o}::DOUBLE, 9) AS b FROM f WHERE {x} IS NOT NULL AND {o} IS NOT NULL" for x in FEATS for o in EXISTING) + """),
rr AS (SELECT feature, other, rank() OVER (PARTITION BY feature, other ORDER BY a) + (count(*) OVER (PARTITION BY feature, other, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature, other ORDER BY b) + (count(*) OVER (PARTITION BY feature, other, b) - 1) / 2.0 AS rb FROM rp),
rd AS (SELECT feature, max(abs(rho)) AS redundancy FROM (SELECT feature, other, corr(ra, rb) AS rho FROM rr GROUP BY 1, 2 HAVING count(*) >= 500) GROUP BY 1)"""


def rounded(f, *other):
    """Features and existing ones with the nine digits that the SQL reads, and `other` columns; written once."""
    return stored(f.select(*other, *[F.round(F.col(c).cast("double"), 9).alias(c) for c in sorted({*FEATS, *EXISTING})]), "features")


@query(f"WITH {FEATURE_BASE}, {REDUNDANT}, x AS (SELECT unnest({FEATS}) AS feature) SELECT feature, round(coalesce(redundancy, 0), 6) AS redundancy FROM x LEFT JOIN rd USING (feature)")
def a17_spearman(spark, sf_dir):
    """Largest absolute Spearman correlation of each feature with the existing ones, pairs of 500 rows or more."""
    return metrics.redundancy(rounded(feature_base(spark, sf_dir)), FEATS, EXISTING).select("feature", R("redundancy", 6).alias("redundancy"))


@query(f"WITH {FEATURE_BASE} " + " UNION ALL ".join(f"SELECT '{x}' AS feature, round(avg(CAST({x} IS NOT NULL AS INTEGER)), 6) AS coverage, count(DISTINCT round({x}, 9)) AS uniques FROM f" for x in FEATS))
def a18_feature_coverage(spark, sf_dir):
    f = feature_base(spark, sf_dir)
    one = f.agg(*[F.struct(R(F.avg(F.col(x).isNotNull().cast("int")), 6).alias("coverage"), F.count_distinct(F.round(x, 9)).alias("uniques")).alias(x) for x in FEATS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"{x}.coverage").alias("coverage"), F.col(f"{x}.uniques").alias("uniques")) for x in FEATS])).alias("x")).select("x.*")


M18 = f"""{FEATURE_BASE}, {PLAN_SQL}, l AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS feature, split, round({x}::DOUBLE, 9) AS v, label_win AS y FROM f JOIN pl ON day BETWEEN a AND b" for x in FEATS) + """),
k AS (SELECT *, rank() OVER (PARTITION BY feature, split ORDER BY v) + (count(*) OVER (PARTITION BY feature, split, v) - 1) / 2.0 AS r FROM l WHERE v IS NOT NULL),
u AS (SELECT feature, split, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM k GROUP BY 1, 2),
cv AS (SELECT feature, avg(CAST(v IS NOT NULL AS INTEGER)) AS coverage, count(DISTINCT v) AS uniques FROM l GROUP BY 1),
d AS (SELECT feature, avg(greatest(auc, 1 - auc)) AS mean, min(greatest(auc, 1 - auc)) AS least FROM u WHERE split IN ('VALIDATION', 'SELECTION') GROUP BY 1)"""


@query(f"WITH {M18}, {REDUNDANT} SELECT feature, round(coverage, 6) AS coverage, uniques, round(redundancy, 6) AS redundancy, round(mean, 6) AS mean_auc, CASE WHEN coverage < 0.55 OR uniques < 5 OR redundancy >= 0.98 OR mean < 0.515 OR least < 0.505 THEN 'REJECT' ELSE 'KEEP' END AS decision FROM cv JOIN d USING (feature) JOIN (SELECT feature, coalesce(redundancy, 0) AS redundancy FROM cv LEFT JOIN rd USING (feature)) USING (feature)")
def m18_feature_triage(spark, sf_dir):
    """Coverage, uniqueness, redundancy and rank quality per feature in long form; decided on VALIDATION and SELECTION."""
    base = rounded(feature_base(spark, sf_dir), "day", "label_win")
    f = base.withColumn("split", splits.assigned(None, PLAN)).where("split is not null")
    long = f.select("split", F.col("label_win").alias("y"), F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("v")) for x in FEATS])).alias("x")).select("split", "y", "x.*")
    cover = long.groupBy("feature").agg(F.avg(F.col("v").isNotNull().cast("int")).alias("coverage"), F.count_distinct("v").alias("uniques"))
    a = metrics.auc(long.where(F.col("split").isin("VALIDATION", "SELECTION")), "v", "y", ["feature", "split"]).withColumn("m", F.greatest("auc", 1 - F.col("auc")))
    d = a.groupBy("feature").agg(F.avg("m").alias("mean"), F.min("m").alias("least"))
    decision = features.triage(F.col("coverage"), F.col("uniques"), F.col("redundancy"), F.col("mean"), F.col("least"))
    return cover.join(d, "feature").join(metrics.redundancy(base, FEATS, EXISTING), "feature").select("feature", R("coverage", 6).alias("coverage"), "uniques", R("redundancy", 6).alias("redundancy"), R("mean", 6).alias("mean_auc"), decision.alias("decision"))


U = "(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"WITH {ENTRANTS}, {P1}, {DAILY} SELECT CAST((dn + 719163) // 28 AS BIGINT) AS block, count(*) AS days, CAST(sum(rows) AS BIGINT) AS rows, round(sum(delta), 6) AS delta FROM d GROUP BY 1")
def w22_calendar_blocks(spark, sf_dir):
    d = daily_deltas(spark, sf_dir)
    return d.groupBy(resample.block_of(F.col("day")).alias("block")).agg(count_rows().alias("days"), F.sum("rows").alias("rows"), R(F.sum("delta"), 6).alias("delta"))


REPS, DRAWS = 2000, 20_000
BLOCKS = f"{DAILY}, bl AS (SELECT (dn + 719163) // 28 AS block, sum(rows) AS rows, sum(delta) AS delta FROM d GROUP BY 1), nb AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS unit, count(*) OVER () AS units FROM bl)"


def blocks(spark, sf_dir):
    """28-day blocks of loss differences, numbered."""
    d = daily_deltas(spark, sf_dir).groupBy(resample.block_of(F.col("day")).alias("block")).agg(F.sum("rows").alias("rows"), F.sum("delta").alias("delta"))
    return resample.numbered(d, ["block"])


def boot(reps: int, seed: str = "boot") -> str:
    return f"""dr AS (SELECT rep, CAST(floor({U.format(key=f"'{seed}|' || rep || '|' || i")} * units) AS BIGINT) AS unit FROM (SELECT unit AS i, units FROM nb), range({reps}) AS g(rep)),
rt AS (SELECT rep, sum(delta) / sum(rows) AS ratio FROM dr JOIN nb USING (unit) GROUP BY 1)"""


@query(f"WITH {ENTRANTS}, {P1}, {BLOCKS}, {boot(REPS)} SELECT round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high FROM rt")
def m12_bootstrap_interval(spark, sf_dir):
    r = resample.bootstrap(blocks(spark, sf_dir), "delta", "rows", REPS, "boot")
    i = resample.interval(r)
    return i.select(R("low", 6).alias("low"), R("high", 6).alias("high"))


FLIP = f"""fl AS (SELECT draw, sum(delta * CASE WHEN {U.format(key="'flip|' || draw || '|' || block")} < 0.5 THEN -1 ELSE 1 END) AS flipped FROM nb, range({DRAWS}) AS g(draw) GROUP BY 1)"""


@query(f"""WITH {ENTRANTS}, {P1}, {BLOCKS}, {FLIP}, o AS (SELECT sum(delta) AS observed FROM nb)
SELECT round(any_value(observed), 6) AS observed, round(CASE WHEN any_value(observed) >= 0 THEN 1.0 ELSE (count(*) FILTER (flipped <= observed + 1e-12) + 1) / (count(*) + 1.0) END, 6) AS p FROM fl, o""")
def m13_sign_flip_test(spark, sf_dir):
    t = resample.sign_flips(blocks(spark, sf_dir), "delta", "block", DRAWS, "flip")
    return t.select(R("observed", 6).alias("observed"), R("p", 6).alias("p"))


@query(f"""WITH {ENTRANTS}, {P1}, {BLOCKS}, {boot(DRAWS)}, s AS (SELECT list_sort(list(ratio)) AS s FROM rt) SELECT round(s[1 + CAST(floor(0.025 * {DRAWS}) AS INTEGER)], 6) AS low, round(s[1 + CAST(floor(0.975 * {DRAWS}) AS INTEGER)], 6) AS high FROM s""")
def m13_block_bootstrap(spark, sf_dir):
    i = resample.floor_interval(resample.bootstrap(blocks(spark, sf_dir), "delta", "rows", DRAWS, "boot"))
    return i.select(R("low", 6).alias("low"), R("high", 6).alias("high"))


@query(f"""WITH {ENTRANTS}, {P1}, {AGENT.format(key="agent_id")}, {SWAPS}, kb AS (SELECT (dn + 719163) // 28 AS block, sum(new_hit - old_hit) AS delta, count(*) AS rows FROM k GROUP BY 1), nb AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS unit, count(*) OVER () AS units FROM kb),
{boot(DRAWS, "acc")}, s AS (SELECT list_sort(list(ratio)) AS s FROM rt) SELECT round(s[1 + CAST(floor(0.025 * {DRAWS}) AS INTEGER)], 6) + 0.0 AS low, round(s[1 + CAST(floor(0.975 * {DRAWS}) AS INTEGER)], 6) + 0.0 AS high FROM s""")
def m15_accuracy_interval(spark, sf_dir):
    """Interval of the hit-rate difference from resampled blocks of 28 days."""
    k = swaps(spark, sf_dir).groupBy(resample.block_of(F.date_from_unix_date("dn")).alias("block")).agg(F.sum(F.col("new_hit") - F.col("old_hit")).alias("delta"), count_rows().alias("rows"))
    i = resample.floor_interval(resample.bootstrap(resample.numbered(k, ["block"]), "delta", "rows", DRAWS, "acc"))
    return i.select((R("low", 6) + 0.0).alias("low"), (R("high", 6) + 0.0).alias("high"))


PAIRS = f"{WORKOUTS}, j AS (SELECT race_row, race_id, o.horse_id, dn, value, wd, created, center, clock, wid, f1, f4 FROM o JOIN w ON o.horse_id = w.horse_id AND wd BETWEEN dn - 14 AND dn - 1 AND created < dn)"


def pairs(spark, sf_dir, days=14):
    rows, seen = workouts(spark, sf_dir)
    return rows, pit.evidence(rows, seen, "horse_id", days)


@query(f"WITH {PAIRS} SELECT race_row, count(*) AS evidence, min(wd) AS first_day, max(wd) AS last_day FROM j GROUP BY 1")
def j03_point_in_time_join(spark, sf_dir):
    return pairs(spark, sf_dir)[1].groupBy("race_row").agg(count_rows().alias("evidence"), F.min("wd").cast("long").alias("first_day"), F.max("wd").cast("long").alias("last_day"))


PICK = f"""{PAIRS}, l AS (SELECT *, row_number() OVER (PARTITION BY race_row ORDER BY wd DESC, clock DESC, created DESC, center DESC, wid DESC) AS rn FROM j WHERE f1 IS NOT NULL),
c AS (SELECT race_row, race_id, horse_id, dn, center, f1 FROM l WHERE rn = 1)"""


def picks(spark, sf_dir):
    """Latest measured evidence of each row: it decides the center."""
    _, p = pairs(spark, sf_dir)
    order = [F.desc(c) for c in ("wd", "clock", "created", "center", "wid")]
    return pit.latest(p.where("f1 is not null"), ["race_row"], order), p


@query(f"WITH {PICK} SELECT race_row, center, round(f1, 6) AS f1 FROM c")
def j04_latest_evidence(spark, sf_dir):
    return picks(spark, sf_dir)[0].select("race_row", "center", R("f1", 6).alias("f1"))


@query(f"WITH {PICK} SELECT c.race_row, c.center, round(min(j.f1), 6) AS fastest FROM c JOIN j ON j.race_row = c.race_row AND j.center = c.center GROUP BY 1, 2")
def w13_fastest_at_center(spark, sf_dir):
    last, p = picks(spark, sf_dir)
    return last.select("race_row", "center").join(p.select("race_row", "center", "f1"), ["race_row", "center"]).groupBy("race_row", "center").agg(R(F.min("f1"), 6).alias("fastest"))


@query(f"WITH {PICK} SELECT race_row, CAST(least(3, floor(4 * (rank() OVER (PARTITION BY race_id, center ORDER BY f1) - 1) / count(*) OVER (PARTITION BY race_id, center))) AS INTEGER) AS quartile FROM c")
def w12_quartile(spark, sf_dir):
    return picks(spark, sf_dir)[0].select("race_row", pit.quartile(F.col("f1"), "race_id", "center").alias("quartile"))


SOURCES, WINDOWS, KINDS, CAPS = ("A", "B", "both"), (7, 14), ("presence", "count", "f4", "f1"), (0.10, 0.25)
CONFIGS = [(src, d, k, c) for src in SOURCES for d in WINDOWS for k in KINDS for c in CAPS]
_q = lambda v: f"CASE WHEN {v} IS NOT NULL THEN CAST(least(3, floor(4 * (rank() OVER (PARTITION BY race_id, source, days, {v} IS NULL ORDER BY {v}) - 1) / count({v}) OVER (PARTITION BY race_id, source, days))) AS INTEGER) END"
KEYS = f"""{PAIRS}, n0 AS (SELECT *, count(*) OVER (PARTITION BY race_id) AS n, row_number() OVER (PARTITION BY race_id ORDER BY value DESC, race_row) AS finish FROM o),
n1 AS (SELECT *, CAST(finish = 1 AS INTEGER) AS win FROM n0 WHERE n >= 2),
hb AS (SELECT race_row, (coalesce(sum(win) OVER w, 0) + 1) / (count(*) OVER w + 12.0) AS base FROM n1 WINDOW w AS (PARTITION BY horse_id ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
eb AS (SELECT n1.*, base, base / sum(base) OVER (PARTITION BY race_id) AS p FROM n1 JOIN hb USING (race_row)),
ec AS (SELECT center AS source, days, race_row, count(*) AS n, min(f1) AS f1, min(f4) AS f4 FROM j JOIN (VALUES (7), (14)) AS g(days) ON wd >= dn - days GROUP BY 1, 2, 3),
eq AS (SELECT source, days, race_row, ec.n, {_q("f1")} AS q1, {_q("f4")} AS q4 FROM ec JOIN eb USING (race_row)),
ky AS (SELECT race_row, source, days, 'presence' AS feature, 1 AS key FROM eq UNION ALL SELECT race_row, source, days, 'count', CAST(least(3, n) AS INTEGER) FROM eq UNION ALL SELECT race_row, source, days, 'f1', q1 FROM eq WHERE q1 IS NOT NULL UNION ALL SELECT race_row, source, days, 'f4', q4 FROM eq WHERE q4 IS NOT NULL)"""
MULTIPLIERS = f"""{KEYS}, kh AS (SELECT race_row, source, days, feature, count(*) OVER w AS xn, coalesce(sum(win) OVER w, 0) AS xw, coalesce(sum(p) OVER w, 0) AS xe FROM ky JOIN eb USING (race_row) WINDOW w AS (PARTITION BY source, days, feature, key ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
mu AS (SELECT race_row, source, days, feature, cap, 1 + cap * xn / (xn + 100.0) * (greatest(0.25, least(4.0, (xw + 10) / (xe + 10))) - 1) AS m FROM kh, (VALUES {", ".join(f"(CAST({c} AS DOUBLE))" for c in CAPS)}) AS g(cap)),
cf AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{src}', {d}, '{k}', CAST({c} AS DOUBLE))" for i, (src, d, k, c) in enumerate(CONFIGS))}) AS t(i, source, days, feature, cap)),
mm AS (SELECT race_row, i, cf.source, cf.days, cf.feature, cf.cap, avg(m) AS m FROM mu JOIN cf ON mu.days = cf.days AND mu.feature = cf.feature AND mu.cap = cf.cap AND (cf.source = 'both' OR cf.source = mu.source) GROUP BY race_row, i, cf.source, cf.days, cf.feature, cf.cap)"""
EXPERIMENTS = f"""{MULTIPLIERS}, st AS (SELECT eb.race_id * 64 + c.i AS race_id, eb.race_row AS horse_id, finish, base * coalesce(m, 1) AS s, eb.dn FROM eb JOIN (SELECT i FROM cf UNION ALL SELECT 63) AS c ON TRUE LEFT JOIN mm ON mm.race_row = eb.race_row AND mm.i = c.i),
p AS (SELECT race_id, horse_id, finish, s / sum(s) OVER (PARTITION BY race_id) AS p FROM st), {PL.replace("j AS (", "pj AS (").replace("FROM j ", "FROM pj ")}, {THREE},
ex AS (SELECT race_id // 64 AS race, CAST(race_id % 64 AS INTEGER) AS i, k, rows, logloss, brier, hit FROM a5 WHERE positives = least(k, rows)),
dl AS (SELECT x.i, x.k, x.race // 1000000000 AS block, x.rows, x.logloss - b.logloss AS dl, x.brier - b.brier AS db, x.hit - b.hit AS dh, x.logloss AS l FROM ex x JOIN ex b ON b.race = x.race AND b.k = x.k AND b.i = 63 WHERE x.i < 63)"""


#: Places of an entrant's keys; each holds one of four, and a key's multiplier one of the caps.
SLOTS = [(src, d, k) for src in SOURCES[:2] for d in WINDOWS for k in KINDS]


def evidence_keys(spark, sf_dir):
    """Entrants of evidence contests with base rate and share, and `keys`, one per place of SLOTS; what is missing is null.

    Evidence is summed up per entrant before it moves; contests stay together from then on.
    """
    rows, seen = workouts(spark, sf_dir)
    race = Window.partitionBy("race_id")
    b = rows.withColumn("n", F.count(F.lit(1)).over(race)).where("n >= 2").withColumn("finish", F.row_number().over(race.orderBy(F.desc("value"), "race_row"))).withColumn("win", (F.col("finish") == 1).cast("int"))
    p = pit.evidence(b.select("race_row", "race_id", "horse_id", "dn"), seen.select("horse_id", "wd", "created", "center", "f1", "f4"), "horse_id", 14)
    b = history.history(b, ["horse_id"], {"wins": F.col("win")})
    b = b.withColumn("base", history.smoothed(F.col("h_wins"), F.col("h_n"))).withColumn("p", history.share(F.col("base"), "race_id")).select("race_row", "race_id", "horse_id", "dn", "finish", "win", "base", "p")
    pair = lambda src, d: (F.col("center") == src) & (F.col("wd") >= F.col("dn") - d)
    told = F.array(*[F.struct(F.lit(src).alias("source"), F.lit(d).alias("days"), F.count_if(pair(src, d)).alias("k"), *[F.min(F.when(pair(src, d), F.col(v))).alias(v) for v in ("f1", "f4")]) for src in SOURCES[:2] for d in WINDOWS])
    c = p.groupBy("race_id", "race_row").agg(told.alias("told")).repartition("race_id").select("race_id", "race_row", F.explode("told").alias("x")).select("race_id", "race_row", "x.*").where("k > 0")
    for v in ("f1", "f4"):
        c = c.withColumn(f"has_{v}", F.col(v).isNotNull()).withColumn(f"q_{v}", F.when(F.col(v).isNotNull(), pit.quartile(F.col(v), "race_id", "source", "days", f"has_{v}")))
    values = {"presence": F.lit(1), "count": F.least(F.lit(3), F.col("k")).cast("int"), "f1": F.col("q_f1"), "f4": F.col("q_f4")}
    own = [F.max(F.when((F.col("source") == src) & (F.col("days") == d), values[k])) for src, d, k in SLOTS]
    return b.join(c.groupBy("race_id", "race_row").agg(F.array(*own).alias("keys")), ["race_id", "race_row"], "left")


def multipliers(e):
    """Adds `m`, an entrant's multiplier per configuration, null where it says nothing; over both sources the mean of those there are.

    `e` is stored. A day has at most one multiplier per place, key and cap, so days meet
    entrants as short arrays, and entrants stay where they lie.
    """
    long = e.where("keys is not null").select("dn", "win", "p", F.posexplode("keys").alias("slot", "key")).where("key is not null").withColumn("cell", F.col("slot") * 4 + F.col("key"))
    x = history.past(long, ["cell"], {"w": F.col("win"), "e": F.col("p")}, prefix="x_")
    told = F.struct("cell", F.array(*[pit.multiplier(F.col("x_n"), F.col("x_w"), F.col("x_e"), c) for c in CAPS]).alias("by_cap"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(4 * len(SLOTS) - 1)), lambda i: F.get(F.filter("told", lambda t: t["cell"] == i), F.lit(0))["by_cap"])
    days = x.groupBy(F.col("dn").alias("__dn")).agg(F.collect_list(told).alias("told")).select("__dn", cells.alias("cells"))
    one = F.flatten(F.transform("keys", lambda key, i: F.coalesce(F.get("cells", i * 4 + key), F.array(*[F.lit(None).cast("double") for _ in CAPS]))))
    half = len(SLOTS) // 2 * len(CAPS)  # those of the first source
    both = F.zip_with(F.slice("one", 1, half), F.slice("one", half + 1, half), lambda a, b: F.coalesce((a + b) / 2, a, b))
    met = e.join(F.broadcast(days), F.col("dn") == F.col("__dn"), "left").withColumn("one", one)
    return met.withColumn("m", F.concat("one", both)).drop("__dn", "cells", "one")


def configured(e):
    """A row per entrant and configuration that says something about it: the columns of `e`, config, source, days, feature, cap, m."""
    names = [F.struct(F.lit(i).alias("config"), F.lit(src).alias("source"), F.lit(d).alias("days"), F.lit(k).alias("feature"), F.lit(c).alias("cap"), F.get("m", F.lit(i)).alias("m")) for i, (src, d, k, c) in enumerate(CONFIGS)]
    return multipliers(e).withColumn("x", F.explode(F.array(*names))).drop("m").select(*[c for c in e.columns if c != "keys"], "x.*").where("m is not null")


def deltas(spark, sf_dir):
    """Per configuration i, target k and day (block): rows, losses l and differences to the strengths without evidence, summed over contests."""
    e = stored(evidence_keys(spark, sf_dir), "evidence").where("race_id is not null").repartition("race_id")
    d = metrics.factor_differences(multipliers(e), "race_id", "race_row", "finish", "base", "m", F.floor(F.col("race_id") / 1_000_000_000).alias("block"), len(CONFIGS))
    return stored(d, "deltas")


@query(f"WITH {KEYS} SELECT race_row, source, CAST(days AS INTEGER) AS days, feature, key FROM ky")
def m06_feature_keys(spark, sf_dir):
    """Presence, capped count and quartiles of two measures, per source and window."""
    keys = F.array(*[F.struct(F.lit(src).alias("source"), F.lit(d).alias("days"), F.lit(k).alias("feature"), F.get("keys", F.lit(i)).alias("key")) for i, (src, d, k) in enumerate(SLOTS)])
    return evidence_keys(spark, sf_dir).select("race_row", F.explode(keys).alias("x")).select("race_row", "x.*").where("key is not null")


@query(f"WITH {MULTIPLIERS} SELECT race_row, source, CAST(days AS INTEGER) AS days, feature, cap, round(m, 8) AS multiplier, round(m * base, 8) AS strength FROM mm JOIN eb USING (race_row)")
def m07_multiplier(spark, sf_dir):
    return configured(stored(evidence_keys(spark, sf_dir), "evidence")).select("race_row", "source", "days", "feature", "cap", R("m", 8).alias("multiplier"), R(F.col("m") * F.col("base"), 8).alias("strength"))


@query(f"WITH {EXPERIMENTS} SELECT i AS config, k, CAST(sum(rows) AS BIGINT) AS rows, round(sum(l) / sum(rows), 6) AS logloss, round(sum(dl) / sum(rows), 7) + 0.0 AS delta FROM dl GROUP BY 1, 2")
def m05_evidence_grid(spark, sf_dir):
    """All 48 configurations as rows: sources, windows, features, caps; three targets each, against none."""
    d = deltas(spark, sf_dir)
    return d.groupBy(F.col("i").alias("config"), "k").agg(F.sum("rows").alias("rows"), R(F.sum("l") / F.sum("rows"), 6).alias("logloss"), (R(F.sum("dl") / F.sum("rows"), 7) + 0.0).alias("delta"))


@query(f"WITH {MULTIPLIERS}, x AS (SELECT i, race_id, dn, abs(m - 1) > 1e-12 AS moved FROM mm JOIN eb USING (race_row)) SELECT i AS config, CAST(year(DATE '1970-01-01' + CAST(dn AS INTEGER)) AS INTEGER) AS year, count(*) AS eligible, count(DISTINCT race_id) FILTER (moved) AS changed_races FROM x GROUP BY 1, 2")
def a28_evidence_coverage(spark, sf_dir):
    """Per year and configuration: rows with evidence, and contests that it changes."""
    x = configured(stored(evidence_keys(spark, sf_dir), "evidence"))
    moved = F.when(F.abs(F.col("m") - 1) > 1e-12, F.col("race_id"))
    return x.groupBy("config", F.year(F.date_from_unix_date("dn")).alias("year")).agg(count_rows().alias("eligible"), F.count_distinct(moved).alias("changed_races"))


TESTS = f"""{EXPERIMENTS}, bd AS (SELECT i, k, block, round(sum(dl), 9) AS delta FROM dl GROUP BY 1, 2, 3), nz AS (SELECT * FROM bd WHERE delta <> 0), al AS (SELECT i, k, round(sum(dl) / sum(rows), 12) AS dl, round(sum(db) / sum(rows), 12) AS db, sum(dh) AS dh FROM dl GROUP BY 1, 2),
sg AS (SELECT draw, block, CASE WHEN {U.format(key="'evidence|' || draw || '|' || block")} < 0.5 THEN -1 ELSE 1 END AS sign FROM (SELECT DISTINCT block FROM nz), range({DRAWS}) AS g(draw)),
fl AS (SELECT i, k, draw, sum(delta * sign) AS flipped, sum(delta) AS observed FROM nz JOIN sg USING (block) GROUP BY 1, 2, 3),
pv AS (SELECT i, k, round(CASE WHEN any_value(observed) >= 0 THEN 1.0 ELSE (count(*) FILTER (flipped <= observed + 1e-9) + 1) / (count(*) + 1.0) END, 9) AS p FROM fl GROUP BY 1, 2),
te AS (SELECT al.i, al.k, dl, db, dh, coalesce(p, 1.0) AS p FROM al LEFT JOIN pv USING (i, k)), hr AS (SELECT *, row_number() OVER (ORDER BY p, i, k) AS rn, count(*) OVER () AS m FROM te), hh AS (SELECT *, max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY rn) AS ph FROM hr)"""


def evidence_tests(spark, sf_dir):
    """48 x 3 sign-flip tests over days (the events cover a month) with a nonzero difference; without one, p is 1."""
    d = deltas(spark, sf_dir)
    blocks = d.groupBy("i", "k", "block").agg(R(F.sum("dl"), 9).alias("delta")).where("delta <> 0")
    p = resample.sign_flips(blocks, "delta", "block", DRAWS, "evidence", ["i", "k"], slack=1e-9).select("i", "k", R("p", 9).alias("p"))
    means = d.groupBy("i", "k").agg(R(F.sum("dl") / F.sum("rows"), 12).alias("dl"), R(F.sum("db") / F.sum("rows"), 12).alias("db"), F.sum("dh").alias("dh"))
    return means.join(p, ["i", "k"], "left").fillna(1.0, ["p"])


@query(f"WITH {TESTS} SELECT i AS config, k, round(p, 6) AS p FROM te")
def m14_grouped_sign_flips(spark, sf_dir):
    return evidence_tests(spark, sf_dir).select(F.col("i").alias("config"), "k", R("p", 6).alias("p"))


@query(f"WITH {TESTS} SELECT i AS config, k, round(p, 6) AS p, round(ph, 6) AS p_holm FROM hh")
def w18_holm(spark, sf_dir):
    return resample.holm(evidence_tests(spark, sf_dir), "p", ["i", "k"]).select(F.col("i").alias("config"), "k", R("p", 6).alias("p"), R("p_holm", 6).alias("p_holm"))


@query(f"WITH {TESTS} SELECT i AS config, CASE WHEN NOT bool_and(dl < 0 AND db < 0) THEN 'REJECT' WHEN bool_and(dh >= 0) AND bool_and(ph < 0.05) THEN 'PROMOTE' ELSE 'KEEP' END AS decision, count(*) FILTER (dl < 0 AND db < 0) AS improved, count(*) FILTER (dh >= 0) AS safe, count(*) FILTER (ph < 0.05) AS significant FROM hh GROUP BY 1")
def m16_decision_gate(spark, sf_dir):
    """A configuration is kept if both losses of all three targets are better; promoted if also no target's hit rate falls and every adjusted test lies below one in twenty."""
    h = resample.holm(evidence_tests(spark, sf_dir), "p", ["i", "k"])
    better, safe, certain = (F.col("dl") < 0) & (F.col("db") < 0), F.col("dh") >= 0, F.col("p_holm") < 0.05
    decision = F.when(~F.bool_and(better), "REJECT").when(F.bool_and(safe) & F.bool_and(certain), "PROMOTE").otherwise("KEEP")
    return h.groupBy(F.col("i").alias("config")).agg(decision.alias("decision"), F.count_if(better).alias("improved"), F.count_if(safe).alias("safe"), F.count_if(certain).alias("significant"))


@query(f"WITH {WORKOUTS} SELECT count(*) AS rows, count(DISTINCT wid) AS distinct_rows, count(*) FILTER (f1 IS NULL) AS unmeasured, (SELECT count(*) FROM (SELECT 1 FROM w GROUP BY horse_id, clock HAVING count(*) > 1 AND count(DISTINCT center) = 1)) AS repeated, (SELECT count(*) FROM (SELECT 1 FROM w GROUP BY horse_id, clock HAVING count(DISTINCT center) > 1)) AS conflicting FROM w")
def a21_evidence_audit(spark, sf_dir):
    _, w = workouts(spark, sf_dir)
    k = w.groupBy("horse_id", "clock").agg(count_rows().alias("n"), F.count_distinct("center").alias("c"))
    return w.agg(count_rows().alias("rows"), F.count_distinct("wid").alias("distinct_rows"), F.count_if(F.col("f1").isNull()).alias("unmeasured")).join(k.agg(F.count_if((F.col("n") > 1) & (F.col("c") == 1)).alias("repeated"), F.count_if(F.col("c") > 1).alias("conflicting")))



@query(f"WITH {FEATURE_BASE} SELECT CAST(days_since_last_run BETWEEN 14 AND 70 AS DOUBLE) AS rested, count(*) AS rows, CAST(sum(label_win) AS BIGINT) AS wins FROM f GROUP BY 1")
def f28_rest_flag(spark, sf_dir):
    """Rest of 14 to 70 days as a flag; null on a first start."""
    f = feature_base(spark, sf_dir)
    return f.groupBy(F.col("days_since_last_run").between(14, 70).cast("double").alias("rested")).agg(count_rows().alias("rows"), F.sum("label_win").alias("wins"))
