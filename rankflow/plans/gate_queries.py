"""Queries on gates, audits, sources, joins and the canonical store."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import count_rows
from ..operators import canonical, gates, history, metrics, ordered
from ..registry import query
from ..sources.bindings import CONTESTS, ENTRANTS, RUNNERS, contests, entrants, runners, table
from ..sources.readers import scratch
from .rating_queries import LOSS, P1, base_rates


CANON = f"""{ENTRANTS}, k AS (SELECT CASE WHEN race_id % 211 = 0 THEN NULL WHEN race_id % 223 = 0 THEN CAST(race_id AS VARCHAR) ELSE race_id || '-' || horse_id END AS race_horse_id, race_id, horse_id,
 CASE WHEN race_id % 227 = 0 THEN 'x' ELSE strftime(day, '%Y-%m-%d') END AS race_date, CASE WHEN race_id % 229 = 0 THEN '7' ELSE CAST(domain AS VARCHAR) END AS race_scope_cd,
 CASE WHEN race_id % 233 = 0 THEN 'oops' ELSE CAST(label_win AS VARCHAR) END AS label_win, CASE WHEN race_id % 239 = 0 THEN '0' ELSE CAST(label_top2 AS VARCHAR) END AS label_top2, CAST(label_top3 AS VARCHAR) AS label_top3 FROM e),
v AS (SELECT *, race_horse_id IS NULL AS null_key, race_horse_id IS NOT NULL AND count(*) OVER (PARTITION BY race_horse_id) > 1 AS duplicate_key, TRY_CAST(race_date AS DATE) IS NULL AS bad_date,
 coalesce(TRY_CAST(race_scope_cd AS DOUBLE) NOT IN (1, 2), TRUE) AS bad_scope, coalesce(TRY_CAST(label_win AS DOUBLE) NOT IN (0, 1), TRUE) AS bad_win, coalesce(TRY_CAST(label_top2 AS DOUBLE) NOT IN (0, 1), TRUE) AS bad_top2, coalesce(TRY_CAST(label_top3 AS DOUBLE) NOT IN (0, 1), TRUE) AS bad_top3,
 coalesce(TRY_CAST(label_win AS DOUBLE) > TRY_CAST(label_top2 AS DOUBLE) OR TRY_CAST(label_top2 AS DOUBLE) > TRY_CAST(label_top3 AS DOUBLE), FALSE) AS not_monotone FROM k)"""
RULES = ("null_key", "duplicate_key", "bad_date", "bad_scope", "bad_win", "bad_top2", "bad_top3", "not_monotone")


def delivered(spark, sf_dir):
    """Entrants as text columns of a delivery, some of them damaged."""
    e = entrants(spark, sf_dir)
    off = lambda m: F.col("race_id") % m == 0
    text = lambda c: F.col(c).cast("string")
    return e.select(
        F.when(off(211), None).when(off(223), text("race_id")).otherwise(F.concat_ws("-", "race_id", "horse_id")).alias("race_horse_id"),
        "race_id",
        "horse_id",
        F.when(off(227), "x").otherwise(F.date_format("day", "yyyy-MM-dd")).alias("race_date"),
        F.when(off(229), "7").otherwise(text("domain")).alias("race_scope_cd"),
        F.when(off(233), "oops").otherwise(text("label_win")).alias("label_win"),
        F.when(off(239), "0").otherwise(text("label_top2")).alias("label_top2"),
        text("label_top3").alias("label_top3"),
    )


def canonical_checks(spark, sf_dir):
    d = delivered(spark, sf_dir)
    keys = d.where("race_horse_id is not null").groupBy("race_horse_id").agg(count_rows().alias("keys")).where("keys > 1")
    c = F.col
    return d.join(keys, "race_horse_id", "left"), gates.canonical_rules(F.coalesce("keys", F.lit(1)), c("race_date"), c("race_scope_cd"), c("race_horse_id"), c("label_win"), c("label_top2"), c("label_top3"))


@query(f"WITH {CANON} SELECT count(*) AS rows, {', '.join(f'count(*) FILTER ({r}) AS {r}' for r in RULES)}, 'BLOCKED' AS status FROM v")
def p05_canonical_validator(spark, sf_dir):
    return gates.violations(*canonical_checks(spark, sf_dir))


@query(f"""WITH {CANON} SELECT race_id, horse_id, concat_ws(',', {', '.join(f"CASE WHEN {r} THEN '{r}' END" for r in sorted(RULES))}) AS issues FROM v WHERE {' OR '.join(RULES)}""")
def p06_quarantine(spark, sf_dir):
    _, bad = gates.split(*canonical_checks(spark, sf_dir))
    return bad.select("race_id", "horse_id", F.array_join("issues", ",").alias("issues"))


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS null_key, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS bad_status, count(*) FILTER (o_totalprice < 0) AS bad_price, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM orders")
def p07_frame_contract(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rules = {"null_key": F.col("o_orderkey").isNull(), "bad_status": ~F.col("o_orderstatus").isin("F", "O", "P"), "bad_price": F.col("o_totalprice") < 0}
    again = o.groupBy("o_orderkey").agg(count_rows().alias("n")).where("n > 1").agg(count_rows().alias("repeated"))
    return gates.violations(o, rules).drop("status").join(again)


@query("SELECT count(*) AS rows, count(*) FILTER (NOT regexp_matches(lpad(CAST(event_id AS VARCHAR), 16, '0'), '^[0-9]{16}$')) AS bad_id, count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-20') AS after_window, count(*) FILTER (value IS NULL OR value < 0) AS bad_value, CASE WHEN count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-20') + count(*) FILTER (value IS NULL OR value < 0) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM events")
def p08_payload_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    want = {"event_id", "ts", "user_id", "event_type", "value", "props"}
    if set(e.columns) != want:
        raise ValueError("fields are missing or extra")
    rules = {
        "bad_id": ~F.lpad(F.col("event_id").cast("string"), 16, "0").rlike("^[0-9]{16}$"),
        "after_window": F.to_date("ts") > F.lit("2024-01-20").cast("date"),
        "bad_value": F.col("value").isNull() | (F.col("value") < 0),
    }
    return gates.violations(e, rules)


#: Conditions and results as delivered: conditions lacking or twice, runners twice, without an id or with a strange status, results open.
ELIGIBLE = f"""{CONTESTS}, {RUNNERS}, dc0 AS (SELECT race_id, distance, track, CASE WHEN race_id % 79 = 4 THEN '' ELSE race_class END AS race_class FROM c WHERE race_id % 71 <> 5),
dc AS (SELECT race_id, count(*) AS copies, bool_and(coalesce(distance > 0 AND regexp_matches(track, '^[0-9]{{2}}$') AND track <> '00' AND trim(race_class) <> '', FALSE)) AS valid FROM (SELECT * FROM dc0 UNION ALL SELECT * FROM dc0 WHERE race_id % 83 = 4) GROUP BY 1),
rr0 AS (SELECT race_id, CASE WHEN race_id % 97 = 3 AND horse_id % 2 = 0 THEN NULL ELSE horse_id END AS horse_id, CASE WHEN race_id % 103 = 7 THEN '9' ELSE abnormal END AS abnormal, CASE WHEN race_id % 101 = 6 THEN '' WHEN abnormal = '4' THEN '0' WHEN price >= 90000 THEN '1' ELSE '2' END AS finish FROM r),
g AS (SELECT race_id, count(*) AS rows, count(*) FILTER (horse_id IS NOT NULL) - count(DISTINCT horse_id) AS again, count(*) FILTER (horse_id IS NULL OR abnormal NOT IN ('0', '1', '2', '3', '4', '5', '6', '7')) AS unknown, count(*) FILTER (abnormal NOT IN ('1', '2', '3')) AS active,
 count(*) FILTER (abnormal NOT IN ('1', '2', '3') AND (NOT regexp_matches(finish, '^[0-9]+$') OR (TRY_CAST(finish AS INTEGER) < 1 AND abnormal <> '4'))) AS unresolved, count(*) FILTER (abnormal NOT IN ('1', '2', '3') AND finish = '1') AS winners FROM (SELECT * FROM rr0 UNION ALL SELECT * FROM rr0 WHERE race_id % 89 = 5) GROUP BY 1)"""


@query(f"""WITH {ELIGIBLE} SELECT CASE WHEN copies IS NULL THEN 'no_conditions' WHEN copies > 1 THEN 'duplicate_conditions' WHEN NOT valid THEN 'invalid_conditions' WHEN again > 0 THEN 'duplicate_competitor' WHEN unknown > 0 THEN 'unknown_id_or_status'
 WHEN active = 0 OR unresolved > 0 THEN 'unresolved_result' WHEN winners = 0 THEN 'no_winner' ELSE 'eligible' END AS reason, count(*) AS races, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(rows - active) AS BIGINT) AS absent, count(*) FILTER (winners > 1) AS ties FROM g LEFT JOIN dc USING (race_id) GROUP BY 1""")
def p09_eligibility_cascade(spark, sf_dir):
    """First failing reason of seven per contest; a tie (more than one winner) only excludes from scoring."""
    r = F.col("race_id")
    c = contests(spark, sf_dir).where("race_id % 71 <> 5").withColumn("race_class", F.when(r % 79 == 4, "").otherwise(F.col("race_class")))
    told = c.union(c.where("race_id % 83 = 4")).groupBy("race_id").agg(count_rows().alias("copies"), F.bool_and(F.coalesce(gates.valid_conditions(), F.lit(False))).alias("valid"))
    rows = runners(spark, sf_dir).select(
        "race_id", F.when(~((r % 97 == 3) & (F.col("horse_id") % 2 == 0)), F.col("horse_id")).alias("horse_id"), F.when(r % 103 == 7, "9").otherwise(F.col("abnormal")).alias("abnormal"),
        F.when(r % 101 == 6, "").when(F.col("abnormal") == "4", "0").when(F.col("price") >= 90000, "1").otherwise("2").alias("finish"),
    )
    return gates.eligibility(rows.union(rows.where("race_id % 89 = 5")), told).groupBy("reason").agg(count_rows().alias("races"), F.sum("rows").alias("rows"), F.sum("absent").alias("absent"), F.count_if("tie").alias("ties"))


@query(f"WITH {CONTESTS} SELECT count(*) AS rows, count(*) FILTER (distance > 0 AND track <> '00' AND trim(race_class) <> '') AS valid, count(*) FILTER (grade = '') AS no_grade FROM c")
def p10_valid_conditions(spark, sf_dir):
    return contests(spark, sf_dir).agg(count_rows().alias("rows"), F.count_if(gates.valid_conditions()).alias("valid"), F.count_if(F.col("grade") == "").alias("no_grade"))


@query(f"WITH {CONTESTS}, {RUNNERS} SELECT race_id, count(*) FILTER (abnormal NOT IN ('1', '2', '3')) AS active, count(*) FILTER (abnormal IN ('1', '2', '3')) AS non_starters FROM r GROUP BY 1")
def p11_active_entrants(spark, sf_dir):
    away = F.col("abnormal").isin("1", "2", "3")
    return runners(spark, sf_dir).groupBy("race_id").agg(F.count_if(~away).alias("active"), F.count_if(away).alias("non_starters"))


#: Faults that the cards of some contests have, as SQL; the query makes the same ones.
CARDS = f"""{CONTESTS}, {RUNNERS}, cd AS (SELECT *, CASE WHEN race_id % 59 = 4 THEN 0 WHEN race_id % 61 = 3 THEN 2 ELSE 1 END AS copies, CASE WHEN race_id % 50 = 0 THEN '0000' ELSE lpad(CAST(race_id % 26 AS VARCHAR), 2, '0') || '30' END AS start_time,
 race_id % 37 = 3 AS stale, race_id % 41 = 5 AS past, CASE WHEN race_id % 67 = 9 THEN 0 ELSE distance END AS metres, CASE WHEN race_id % 71 = 8 THEN '00' ELSE track END AS course FROM c),
ru AS (SELECT race_id, horse_id, agent_id, CASE WHEN (race_id + horse_id) % 53 = 0 THEN 1 ELSE row_number() OVER (PARTITION BY race_id ORDER BY horse_id) END AS number, (race_id + horse_id) % 47 = 2 AS no_second, horse_id % 97 = 5 AS odd_id FROM r WHERE race_id % 73 <> 6),
wk AS (SELECT race_id, horse_id, count(*) OVER (PARTITION BY horse_id ORDER BY dn RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) > 0 AS worked FROM r JOIN c USING (race_id)),
rg AS (SELECT race_id, count(*) + CAST(race_id % 31 = 7 AS INTEGER) AS registered FROM r GROUP BY race_id),
g AS (SELECT race_id, count(*) AS n, count(DISTINCT number) AS numbers, bool_or(odd_id) AS odd_id, bool_or(agent_id IS NULL) AS no_first, bool_or(no_second) AS no_second, count(*) FILTER (worked) AS eligible FROM ru JOIN wk USING (race_id, horse_id) GROUP BY 1)"""


P12 = """SELECT cd.race_id, concat_ws(',', CASE WHEN copies = 1 AND (course = '00' OR race_class = '') THEN 'bad_conditions' END, CASE WHEN copies = 1 AND metres <= 0 THEN 'bad_distance' END, CASE WHEN odd_id THEN 'bad_identity' END, CASE WHEN numbers < n THEN 'bad_number' END,
 CASE WHEN copies = 1 AND coalesce(registered, 0) < 2 THEN 'bad_registered' END, CASE WHEN copies = 1 AND (start_time = '0000' OR start_time >= '24') THEN 'bad_start_time' END, CASE WHEN copies = 1 AND venue NOT IN ('F', 'O') THEN 'bad_venue' END, CASE WHEN copies <> 1 THEN 'conditions_missing_or_repeated' END,
 CASE WHEN no_first THEN 'no_first_agent' END, CASE WHEN n IS NULL THEN 'no_runners' END, CASE WHEN no_second THEN 'no_second_agent' END, CASE WHEN copies = 1 AND registered >= 2 AND registered <> coalesce(n, 0) THEN 'registered_mismatch' END, CASE WHEN past THEN 'same_day_or_past' END, CASE WHEN stale THEN 'stale_capture' END) AS blockers,
 coalesce(eligible, 0) AS eligible, coalesce(eligible < n, FALSE) AS neutral_warning FROM cd LEFT JOIN g USING (race_id) LEFT JOIN rg USING (race_id)"""


@query(f"WITH {CARDS} {P12}")
def p12_readiness_blockers(spark, sf_dir):
    """Per contest the sorted names of what blocks it, from conditions, roster and capture; entrants with recent work, and a warning if some have none.

    A run in the fortnight before counts as work.
    """
    r, h = F.col("race_id"), F.col("horse_id")
    cards = contests(spark, sf_dir).select(
        "race_id", "dn", "venue", "race_class", F.when(r % 59 == 4, 0).when(r % 61 == 3, 2).otherwise(1).alias("copies"), F.when(r % 50 == 0, "0000").otherwise(F.concat(F.lpad((r % 26).cast("string"), 2, "0"), F.lit("30"))).alias("start_time"),
        (r % 37 == 3).alias("stale"), (r % 41 == 5).alias("past"), F.when(r % 67 == 9, 0).otherwise(F.col("distance")).alias("metres"), F.when(r % 71 == 8, "00").otherwise(F.col("track")).alias("course"),
    )
    entered = runners(spark, sf_dir).select("race_id", "horse_id", "agent_id").join(cards.select("race_id", "dn"), "race_id")
    own = Window.partitionBy("race_id")
    worked = history.history(entered, ["horse_id"], {}, days=14).withColumn("place", F.row_number().over(own.orderBy("horse_id")))
    row = worked.select("race_id", "agent_id", (F.col("h_n") > 0).alias("worked"), F.when((r + h) % 53 == 0, 1).otherwise(F.col("place")).alias("number"), ((r + h) % 47 == 2).alias("no_second"), (h % 97 == 5).alias("odd_id"))
    seen = r % 73 != 6
    kept = lambda c: F.when(seen, c)
    g = row.groupBy("race_id").agg(
        F.count(kept(F.lit(1))).alias("n"), F.count_distinct(kept(F.col("number"))).alias("numbers"), *[F.bool_or(kept(F.col(c))).alias(c) for c in ("odd_id", "no_second")], F.bool_or(kept(F.col("agent_id").isNull())).alias("no_first"),
        F.count_if(seen & F.col("worked")).alias("eligible"), (count_rows() + F.max((r % 31 == 7).cast("int"))).alias("registered"),
    )
    rows = cards.join(g, "race_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "registered": F.coalesce("registered", F.lit(0)), "one": F.col("copies") == 1})
    c = F.col
    rules = {
        "stale_capture": c("stale"), "conditions_missing_or_repeated": ~c("one"), "no_runners": c("n") == 0, "same_day_or_past": c("past"), "bad_start_time": c("one") & ((c("start_time") == "0000") | (c("start_time") >= "24")),
        "bad_registered": c("one") & (c("registered") < 2), "registered_mismatch": c("one") & (c("registered") >= 2) & (c("registered") != c("n")), "bad_distance": c("one") & (c("metres") <= 0),
        "bad_conditions": c("one") & ((c("course") == "00") | (c("race_class") == "")), "bad_venue": c("one") & ~c("venue").isin("F", "O"), "bad_number": c("numbers") < c("n"), "bad_identity": c("odd_id"), "no_first_agent": c("no_first"), "no_second_agent": c("no_second"),
    }
    return gates.issues(rows, rules, "b").select("race_id", F.array_join("b", ",").alias("blockers"), F.coalesce("eligible", F.lit(0)).alias("eligible"), F.coalesce(c("eligible") < c("n"), F.lit(False)).alias("neutral_warning"))


@query(f"""WITH {CARDS}, p12 AS ({P12}), sc AS (SELECT race_id, count(*) AS entered, count(*) FILTER (abnormal <> '0') AS off FROM r WHERE race_id % 43 <> 9 GROUP BY 1), en AS (SELECT race_id, count(*) AS rostered FROM r GROUP BY 1)
SELECT race_id, concat_ws(',', nullif(blockers, ''), CASE WHEN entered IS DISTINCT FROM rostered THEN 'status_mismatch' END, CASE WHEN off > 0 THEN 'status_not_clear' END) AS blockers FROM p12 LEFT JOIN sc USING (race_id) LEFT JOIN en USING (race_id)""")
def p14_personal_gate(spark, sf_dir):
    """The readiness blockers, and those of the status list: an entrant without a status, or with any but clear, blocks the contest."""
    r = runners(spark, sf_dir)
    status = r.where("race_id % 43 <> 9").groupBy("race_id").agg(count_rows().alias("entered"), F.count_if(F.col("abnormal") != "0").alias("off"))
    rows = p12_readiness_blockers(spark, sf_dir).join(r.groupBy("race_id").agg(count_rows().alias("rostered")), "race_id", "left").join(status, "race_id", "left")
    own = gates.issues(rows, {"status_mismatch": ~F.col("entered").eqNullSafe(F.col("rostered")), "status_not_clear": F.col("off") > 0}, "more")
    ready = F.filter(F.split("blockers", ","), lambda b: b != "")
    return own.select("race_id", F.array_join(F.array_union(ready, F.col("more")), ",").alias("blockers"))


@query("""WITH s AS (SELECT event_id, ts AS captured, ts + INTERVAL 6 HOUR AS now, CASE WHEN event_id % 50 = 0 THEN '0000' ELSE lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || '30' END AS clock FROM events)
SELECT count(*) AS rows, count(*) FILTER (clock <> '0000' AND now < strptime(strftime(captured, '%Y%m%d') || clock, '%Y%m%d%H%M')) AS before_start FROM s""")
def p13_before_start(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clock = F.when(F.col("event_id") % 50 == 0, "0000").otherwise(F.concat(F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit("30")))
    at = F.col("ts").cast("timestamp")
    ok = gates.before_start(F.date_format(at, "yyyyMMdd"), clock, at, at + F.expr("INTERVAL 6 HOUR"))
    return e.agg(count_rows().alias("rows"), F.count_if(ok).alias("before_start"))


@query(f"WITH {CONTESTS} SELECT CASE WHEN o.o_orderkey % 3 = 0 THEN NULL WHEN domain = 1 THEN 'JRA' ELSE 'NAR' END AS domain, count(*) AS rows FROM c JOIN orders o ON race_id = o_orderkey GROUP BY 1")
def p16_domain_normalisation(spark, sf_dir):
    raw = F.when(F.col("race_id") % 3 == 0, "9").when(F.col("domain") == 1, F.when(F.col("race_id") % 4 == 1, " jra ").otherwise("1.0")).otherwise(F.when(F.col("race_id") % 4 == 0, "NAR").otherwise("2"))
    return contests(spark, sf_dir).groupBy(gates.domain(raw).alias("domain")).agg(count_rows().alias("rows"))


#: Predictions as delivered: some out of range, not ascending, with a frame of 9, or twice.
BLIND = """bl0 AS (SELECT race_id, horse_id, CASE WHEN horse_id % 41 = 0 THEN 1.5 ELSE 1.0 / (n + 1) END AS p1, CASE WHEN horse_id % 43 = 0 THEN 0.0 ELSE 0.6 END AS p2, CASE WHEN horse_id % 47 = 0 THEN NULL WHEN horse_id % 37 = 0 THEN 0.55 ELSE 0.7 END AS p3, horse_id % 9 + 1 AS frame FROM e),
bl AS (SELECT *, count(*) OVER (PARTITION BY race_id, horse_id) AS k FROM (SELECT * FROM bl0 UNION ALL SELECT * FROM bl0 WHERE horse_id % 59 = 0))"""


@query(f"""WITH {ENTRANTS}, {BLIND} SELECT count(*) AS rows, count(*) FILTER (k > 1) AS duplicate_key, count(*) FILTER (p1 NOT BETWEEN 0 AND 1) AS bad_p1, count(*) FILTER (p2 NOT BETWEEN 0 AND 1) AS bad_p2, count(*) FILTER (p3 IS NULL OR p3 NOT BETWEEN 0 AND 1) AS bad_p3,
count(*) FILTER (p1 > p2 + 1e-12 OR p2 > p3 + 1e-12) AS not_ascending, count(*) FILTER (frame NOT BETWEEN 1 AND 8) AS bad_frame FROM bl""")
def p17_result_blind_gate(spark, sf_dir):
    """Predictions that carry no outcome and lack no column; ranges, order of the three targets, keys and frames are counted."""
    h = F.col("horse_id")
    d = entrants(spark, sf_dir).select(
        "race_id", "horse_id", F.when(h % 41 == 0, 1.5).otherwise(1 / (F.col("n") + 1)).alias("p1"), F.when(h % 43 == 0, 0.0).otherwise(0.6).alias("p2"), F.when(h % 47 == 0, None).when(h % 37 == 0, 0.55).otherwise(0.7).alias("p3"), (h % 9 + 1).alias("frame"),
    )
    return gates.result_blind(d.union(d.where("horse_id % 59 = 0")), ["race_id", "horse_id"], ("p1", "p2", "p3"), "frame").drop("status")


@query(f"WITH {ENTRANTS} SELECT venue, count(*) AS rows FROM e WHERE venue IN ('F', 'O') AND race_class IN ('1', '2') AND domain = 1 GROUP BY 1")
def p18_segment_filter(spark, sf_dir):
    e = entrants(spark, sf_dir).withColumnRenamed("domain", "race_scope_cd")
    return e.where(gates.segment(e, {"venue": [" f", "O"], "race_class": ["1", "2"]}, scope=1)).groupBy("venue").agg(count_rows().alias("rows"))


@query(f"""WITH {CANON}, s AS (SELECT *, bool_and(TRY_CAST(label_win AS DOUBLE) IS NOT NULL) OVER w AS known, sum(TRY_CAST(label_win AS DOUBLE)) OVER w AS wins FROM k WINDOW w AS (PARTITION BY race_id))
SELECT count(*) AS rows, count(DISTINCT race_id) AS races FROM s WHERE known AND wins = 1 AND race_scope_cd IN ('1', '2')""")
def p19_safe_population(spark, sf_dir):
    """All rows of the contest labelled, exactly one winner, known scope."""
    w = Window.partitionBy("race_id")
    y = F.col("label_win").try_cast("double")
    s = delivered(spark, sf_dir).withColumn("known", F.bool_and(y.isNotNull()).over(w)).withColumn("wins", F.sum(y).over(w))
    return s.where(F.col("known") & (F.col("wins") == 1) & F.col("race_scope_cd").isin("1", "2")).agg(count_rows().alias("rows"), F.count_distinct("race_id").alias("races"))


@query(f"WITH {CANON} SELECT race_id, bool_and(TRY_CAST(label_win AS DOUBLE) IS NOT NULL) AS all_labelled, coalesce(sum(TRY_CAST(label_win AS DOUBLE)) = 1, FALSE) AS one_winner FROM k GROUP BY race_id")
def w23_group_predicates(spark, sf_dir):
    y = F.col("label_win").try_cast("double")
    return delivered(spark, sf_dir).groupBy("race_id").agg(F.bool_and(y.isNotNull()).alias("all_labelled"), F.coalesce(F.sum(y) == 1, F.lit(False)).alias("one_winner"))


#: Entrants with history features as delivered: some labels out of order, some first starts with a history, some rows twice.
GUARD = """gd0 AS (SELECT race_id, horse_id, dn, CASE WHEN horse_id % 31 = 0 THEN 0 ELSE label_top2 END AS label_top2, label_win, label_top3, lag(dn) OVER (PARTITION BY horse_id ORDER BY dn, race_id) AS prior FROM e),
gd1 AS (SELECT *, CASE WHEN prior IS NOT NULL THEN dn - prior WHEN horse_id % 7 = 0 THEN 0 END AS history FROM gd0),
gd AS (SELECT *, count(*) OVER (PARTITION BY race_id, horse_id) AS k FROM (SELECT * FROM gd1 UNION ALL SELECT * FROM gd1 WHERE race_id % 211 = 0)),
sp AS (SELECT *, lag(stop) OVER (ORDER BY start) AS before FROM (VALUES ('TRAIN', '1992-01-01', '1995-12-31'), ('VALIDATION', '1995-12-31', '1996-12-31'), ('TEST', '1997-01-01', '1998-12-31')) AS t(split, start, stop))"""


@query(f"""WITH {ENTRANTS}, {GUARD} SELECT count(*) AS rows, count(*) FILTER (k > 1) AS duplicate_key, count(*) FILTER (label_win > label_top2 OR label_top2 > label_top3) AS label_order, count(*) FILTER (prior IS NULL) AS first_starts,
count(*) FILTER (prior IS NULL AND history IS NOT NULL) AS leaking, (SELECT count(*) FROM sp WHERE start <= before) AS overlapping_splits FROM gd""")
def p21_leakage_guard(spark, sf_dir):
    """Keys, label order, first starts that have a history all the same, and splits that overlap."""
    e = entrants(spark, sf_dir).select("race_id", "horse_id", "dn", "label_win", "label_top2", "label_top3")
    own = ordered.previous(ordered.placed(e, ["horse_id"], ["dn", "race_id"], "starts"), ["horse_id"], {"prior": "dn"})
    d = own.withColumns({"label_top2": F.when(F.col("horse_id") % 31 == 0, 0).otherwise(F.col("label_top2")), "history": F.when(F.col("prior").isNotNull(), F.col("dn") - F.col("prior")).when(F.col("horse_id") % 7 == 0, 0)})
    d = d.union(d.where("race_id % 211 = 0")).withColumn("k", count_rows().over(Window.partitionBy("race_id", "horse_id")))
    plan = [("TRAIN", "1992-01-01", "1995-12-31"), ("VALIDATION", "1995-12-31", "1996-12-31"), ("TEST", "1997-01-01", "1998-12-31")]
    over = spark.createDataFrame(plan, "split string, start string, stop string").withColumn("before", F.lag("stop").over(Window.orderBy("start"))).agg(F.count_if(F.col("start") <= F.col("before")).alias("overlapping_splits"))  # a row per split
    rules = {"duplicate_key": F.col("k") > 1, "label_order": (F.col("label_win") > F.col("label_top2")) | (F.col("label_top2") > F.col("label_top3")), "first_starts": F.col("prior").isNull(), "leaking": F.col("prior").isNull() & F.col("history").isNotNull()}
    return gates.violations(d, rules).drop("status").join(over)


@query(f"""WITH {CONTESTS}, {RUNNERS}, z AS (SELECT race_id, horse_id, abnormal, row_number() OVER (PARTITION BY race_id ORDER BY price DESC, horse_id) AS f FROM r)
SELECT CASE WHEN abnormal = '1' THEN 'NON_STARTER' WHEN abnormal = '4' THEN 'DNF' ELSE 'FINISHED' END AS result_status, count(*) AS rows, CAST(sum(CASE WHEN abnormal = '4' THEN 0 WHEN abnormal = '1' THEN NULL ELSE CAST(f = 1 AS INTEGER) END) AS BIGINT) AS wins, count(*) FILTER (abnormal = '0' AND f <= 3) AS top3 FROM z GROUP BY 1""")
def p23_label_derivation(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("price"), "horse_id")).cast("string")
    r = runners(spark, sf_dir).withColumn("finish", F.when(F.col("abnormal") == "4", "0").when(F.col("abnormal") == "1", "").otherwise(place))
    f = F.col("finish").try_cast("int")
    win = F.when(F.col("abnormal") == "4", 0).when(f.isNotNull(), (f == 1).cast("int"))
    status = F.when(F.col("abnormal") == "4", "DNF").when(f.isNull(), "NON_STARTER").otherwise("FINISHED")
    return r.groupBy(status.alias("result_status")).agg(count_rows().alias("rows"), F.sum(win).alias("wins"), F.count_if(F.coalesce(f.between(1, 3), F.lit(False))).alias("top3"))


@query("SELECT c_custkey, sha256(c_name || '|' || coalesce(c_mktsegment, '') || '|' || CAST(c_nationkey AS VARCHAR)) AS identity FROM customer")
def p24_provisional_identity(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.sha2(F.concat_ws("|", "c_name", F.coalesce("c_mktsegment", F.lit("")), F.col("c_nationkey").cast("string")), 256).alias("identity"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, round(l_quantity / 10, 1) AS odds FROM lineitem)
SELECT count(*) AS rows, count(*) FILTER (odds IS NULL) AS missing, count(*) FILTER (odds <= 1) AS bad_odds, (SELECT count(*) FROM (SELECT 1 FROM m GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated FROM m""")
def p25_market_gate(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 10, 1).alias("odds"))
    again = m.groupBy("l_orderkey", "l_linenumber").agg(count_rows().alias("k")).where("k > 1").agg(count_rows().alias("repeated"))
    return gates.violations(m, {"missing": F.col("odds").isNull(), "bad_odds": F.col("odds") <= 1}).drop("status").join(again)


#: A refresh from 1994-01-01 to 1996-12-31, observed on 1997-01-01, as delivered: conditions or runners lacking, twice, outside the interval, or created later.
REFRESH = """rf_c AS (SELECT race_id, CASE WHEN race_id % 997 = 0 THEN DATE '1997-06-01' ELSE day END AS day, CASE WHEN race_id % 499 = 0 THEN DATE '1997-02-01' ELSE day END AS created FROM c WHERE day BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND race_id % 251 <> 0),
rf_r AS (SELECT r.race_id, horse_id, day, day AS created FROM r JOIN c USING (race_id) WHERE day BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND race_id % 257 <> 0),
rc AS (SELECT * FROM rf_c UNION ALL SELECT * FROM rf_c WHERE race_id % 263 = 0), rr AS (SELECT * FROM rf_r UNION ALL SELECT * FROM rf_r WHERE horse_id % 269 = 0)"""


@query(f"""WITH {CONTESTS}, {RUNNERS}, {REFRESH} SELECT (SELECT count(*) FROM (SELECT race_id FROM rc GROUP BY 1 HAVING count(*) > 1)) AS repeated_conditions, (SELECT count(*) FROM (SELECT race_id, horse_id FROM rr GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_runners,
(SELECT count(*) FROM (SELECT race_id FROM rc EXCEPT SELECT race_id FROM rr)) AS without_runners, (SELECT count(*) FROM (SELECT race_id FROM rr EXCEPT SELECT race_id FROM rc)) AS without_conditions,
(SELECT count(*) FROM rc WHERE day NOT BETWEEN DATE '1994-01-01' AND DATE '1996-12-31') + (SELECT count(*) FROM rr WHERE day NOT BETWEEN DATE '1994-01-01' AND DATE '1996-12-31') AS outside_interval,
(SELECT count(*) FROM rc WHERE created > DATE '1997-01-01') + (SELECT count(*) FROM rr WHERE created > DATE '1997-01-01') AS future_dated, TRUE AS before_observation, 'BLOCKED' AS status""")
def p26_refresh_gate(spark, sf_dir):
    """A delivered refresh: unique keys, the same contests on both sides, its interval, no source from the future."""
    c = contests(spark, sf_dir).select("race_id", "day").where("day between date'1994-01-01' and date'1996-12-31'")
    conditions = c.where("race_id % 251 <> 0").select("race_id", F.when(F.col("race_id") % 997 == 0, F.lit("1997-06-01").cast("date")).otherwise(F.col("day")).alias("day"), F.when(F.col("race_id") % 499 == 0, F.lit("1997-02-01").cast("date")).otherwise(F.col("day")).alias("created"))
    rows = runners(spark, sf_dir).select("race_id", "horse_id").join(c, "race_id").where("race_id % 257 <> 0").withColumn("created", F.col("day"))
    return gates.refresh(conditions.union(conditions.where("race_id % 263 = 0")), rows.union(rows.where("horse_id % 269 = 0")), "1994-01-01", "1996-12-31", "1997-01-01")


@query(f"""WITH {ENTRANTS}, d AS (SELECT horse_id, dn, count(*) AS n, sum(label_win) AS w FROM e GROUP BY 1, 2),
st AS (SELECT horse_id, CASE WHEN horse_id % 13 = 4 THEN dn + 20000 ELSE dn END AS dn, n + CAST(horse_id % 11 = 3 AS INTEGER) AS n, CASE WHEN horse_id % 17 = 5 THEN NULL ELSE w END AS w, row_number() OVER (PARTITION BY horse_id ORDER BY CASE WHEN horse_id % 19 = 6 THEN -dn ELSE dn END) AS seq FROM d),
o AS (SELECT *, dn <= lag(dn) OVER (PARTITION BY horse_id ORDER BY seq) AS back FROM st),
k AS (SELECT horse_id, sum(n) AS sn, sum(w) AS sw, count(*) FILTER (w IS NULL) AS missing, max(dn) AS last, count(*) FILTER (back) AS back FROM o GROUP BY 1), t AS (SELECT horse_id, count(*) AS n, sum(label_win) AS w FROM e GROUP BY 1)
SELECT count(*) AS keys, count(*) FILTER (sn <> n OR sw IS DISTINCT FROM w) AS wrong_totals, count(*) FILTER (missing > 0) AS not_finite, count(*) FILTER (back > 0) AS unordered, count(*) FILTER (last > date_diff('day', DATE '1970-01-01', DATE '2002-01-01')) AS future_days FROM k FULL JOIN t USING (horse_id)""")
def p27_history_audit(spark, sf_dir):
    """A stored history with faults against its events: totals, missing values, order of days, days in the future."""
    h, e = F.col("horse_id"), entrants(spark, sf_dir).select("horse_id", "dn", "label_win")
    d = e.groupBy("horse_id", "dn").agg(count_rows().alias("n"), F.sum("label_win").alias("w"))
    own = Window.partitionBy("horse_id")
    stored = d.select(
        "horse_id", F.when(h % 13 == 4, F.col("dn") + 20000).otherwise(F.col("dn")).alias("dn"), (F.col("n") + (h % 11 == 3).cast("int")).alias("n"), F.when(h % 17 != 5, F.col("w")).alias("w"),
        F.row_number().over(own.orderBy(F.when(h % 19 == 6, -F.col("dn")).otherwise(F.col("dn")))).alias("seq"),
    )
    o = stored.withColumn("back", F.col("dn") <= F.lag("dn").over(own.orderBy("seq")))
    k = o.groupBy("horse_id").agg(F.sum("n").alias("sn"), F.sum("w").alias("sw"), F.count_if(F.col("w").isNull()).alias("missing"), F.max("dn").alias("last"), F.count_if(F.coalesce("back", F.lit(False))).alias("back"))
    t = e.groupBy("horse_id").agg(count_rows().alias("n"), F.sum("label_win").alias("w"))
    wrong = ~(F.col("sn").eqNullSafe(F.col("n")) & F.col("sw").eqNullSafe(F.col("w")))
    return k.join(t, "horse_id", "full_outer").agg(count_rows().alias("keys"), F.count_if(wrong).alias("wrong_totals"), F.count_if(F.col("missing") > 0).alias("not_finite"), F.count_if(F.col("back") > 0).alias("unordered"), F.count_if(F.col("last") > F.unix_date(F.lit("2002-01-01").cast("date"))).alias("future_days"))


CHAIN = """s AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER w AS line, sha256(user_id || '|' || event_id || '|' || event_type) AS sha FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE lag(sha) OVER w END AS previous, line + CAST(event_id % 89 = 0 AS INTEGER) AS seq, us - CASE WHEN event_id % 83 = 0 THEN 864000000000 ELSE 0 END AS clock FROM s WINDOW w AS (PARTITION BY user_id ORDER BY line)),
a AS (SELECT *, lag(sha) OVER w AS want, lag(clock) OVER w AS before FROM h WINDOW w AS (PARTITION BY user_id ORDER BY line))"""


def chain(spark, sf_dir):
    """Events as per-user hash chains in which some links, sequence numbers and clocks are wrong; with what each line's should be."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.sha2(F.concat_ws("|", "user_id", "event_id", "event_type"), 256).alias("sha"))
    e = e.withColumn("clock", F.col("us") - F.when(F.col("event_id") % 83 == 0, 864_000_000_000).otherwise(0))
    lines = ordered.placed(e, ["user_id"], ["us", "event_id"], "chain")
    told = ordered.previous(ordered.numbered(lines, ["user_id"], "line"), ["user_id"], {"want": "sha", "before": "clock"})
    faults = {"previous": F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.col("want")), "seq": F.col("line") + (F.col("event_id") % 89 == 0).cast("int")}
    return told.withColumns(faults)


@query(f"WITH {CHAIN} SELECT count(*) AS rows, count(*) FILTER (seq <> line) AS bad_sequence, count(*) FILTER (previous IS DISTINCT FROM want) AS broken, count(*) FILTER (clock < before) AS clock_back FROM a")
def p28_hash_chain_audit(spark, sf_dir):
    """Sequence, links and clocks of every chain; a user with most events is audited by many tasks."""
    rules = {"bad_sequence": F.col("seq") != F.col("line"), "broken": ~F.col("previous").eqNullSafe(F.col("want")), "clock_back": F.col("clock") < F.col("before")}
    return gates.violations(chain(spark, sf_dir), rules).drop("status")


@query(f"WITH {CHAIN} SELECT event_id, want AS predecessor FROM a")
def w21_chain_predecessor(spark, sf_dir):
    return chain(spark, sf_dir).select("event_id", F.col("want").alias("predecessor"))


#: A run's report by day, with faults: days out of order, days twice, deltas that don't add up, populations that differ.
RUN = f"""g0 AS (SELECT dn, count(DISTINCT race_id) AS races, count(*) AS rows, round(sum({LOSS.format(p="p", y="label_win")}), 6) AS candidate, round(sum({LOSS.format(p="(1.0::DOUBLE / n)", y="label_win")}), 6) AS baseline FROM p GROUP BY 1),
g1 AS (SELECT *, row_number() OVER (ORDER BY dn) * 10 - CASE WHEN dn % 53 = 0 THEN 25 ELSE 0 END AS line, round(candidate - baseline, 6) + CASE WHEN dn % 61 = 0 THEN 0.5 ELSE 0 END AS delta, rows - CAST(dn % 71 = 0 AS INTEGER) AS baseline_rows FROM g0),
g AS (SELECT *, lag(dn) OVER (ORDER BY line) AS before FROM (SELECT * FROM g1 UNION ALL SELECT * REPLACE (line + 1 AS line) FROM g1 WHERE dn % 101 = 0))"""


@query(f"""WITH {ENTRANTS}, {P1}, {RUN} SELECT unnest(['repeated_days', 'not_increasing', 'delta', 'population', 'races']) AS "check",
unnest([count(*) - count(DISTINCT dn), count(*) FILTER (dn <= before), count(*) FILTER (abs(delta - (candidate - baseline)) > 1e-5), count(*) FILTER (rows <> baseline_rows), (SELECT count(*) - count(DISTINCT race_id) FROM c)]) AS violations FROM g""")
def p29_run_integrity(spark, sf_dir):
    """Invariants of a run's report: unique contests and days, days that increase, deltas of candidate and baseline, equal populations."""
    y = F.col("label_win")
    per = base_rates(spark, sf_dir).groupBy("dn", "race_id").agg(count_rows().alias("n"), F.sum(metrics.log_loss(F.col("p"), y)).alias("c"), F.sum(metrics.log_loss(F.lit(1.0) / F.col("n"), y)).alias("b"))
    days = per.groupBy("dn").agg(F.sum("n").alias("rows"), F.round(F.sum("c"), 6).alias("candidate"), F.round(F.sum("b"), 6).alias("baseline"))
    own = ordered.numbered(ordered.placed(days.withColumn("run", F.lit(1)), ["run"], ["dn"], "run"), ["run"], "k")
    fault = lambda k, v: F.when(F.col("dn") % k == 0, v).otherwise(0)
    run = own.select("run", "dn", "rows", "candidate", "baseline", (F.col("k") * 10 - fault(53, 25)).alias("line"), (F.round(F.col("candidate") - F.col("baseline"), 6) + fault(61, 0.5)).alias("delta"), (F.col("rows") - fault(71, 1)).alias("baseline_rows"))
    run = run.union(run.where("dn % 101 = 0").withColumn("line", F.col("line") + 1))
    told = ordered.previous(ordered.placed(run, ["run"], ["line"], "report"), ["run"], {"before": "dn"})
    found = told.agg(
        (count_rows() - F.count_distinct("dn")).alias("repeated_days"), F.count_if(F.col("dn") <= F.col("before")).alias("not_increasing"),
        F.count_if(F.abs(F.col("delta") - (F.col("candidate") - F.col("baseline"))) > 1e-5).alias("delta"), F.count_if(F.col("rows") != F.col("baseline_rows")).alias("population"),
    ).join(contests(spark, sf_dir).agg((count_rows() - F.count_distinct("race_id")).alias("races")))
    return found.unpivot([], list(found.columns), "check", "violations")


@query(f"WITH {CANON} SELECT count(*) AS rows, count(DISTINCT race_id) AS races, count(*) FILTER (duplicate_key) AS duplicates, count(*) FILTER (not_monotone) AS label_order FROM v")
def p31_quality_audit(spark, sf_dir):
    d, rules = canonical_checks(spark, sf_dir)
    return d.agg(count_rows().alias("rows"), F.count_distinct("race_id").alias("races"), F.count_if(F.coalesce(rules["duplicate_key"], F.lit(False))).alias("duplicates"), F.count_if(F.coalesce(rules["not_monotone"], F.lit(False))).alias("label_order"))


@query(f"WITH {CONTESTS} SELECT domain, count(*) AS races, count(*) FILTER (domain = 1 AND race_class IN ('1', '2') AND distance <= 1600) AS tagged FROM c GROUP BY 1")
def p32_hypothesis_tag(spark, sf_dir):
    tag = (F.col("domain") == 1) & F.col("race_class").isin("1", "2") & (F.col("distance") <= 1600)
    return contests(spark, sf_dir).groupBy("domain").agg(count_rows().alias("races"), F.count_if(tag).alias("tagged"))


MAPPED = "SELECT CAST(o_orderkey AS VARCHAR) AS race_id, strftime(o_orderdate, '%Y-%m-%d') AS race_date, CAST(o_orderkey % 2 + 1 AS INTEGER) AS race_scope_cd, 'orders' AS provenance FROM orders"


@query(MAPPED)
def p01_contract_projection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("on"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("code"))
    return canonical.project(o, ["race_id", "race_date", "race_scope_cd", "provenance"], {"race_id": "key", "race_date": "on", "race_scope_cd": "code"}, {"provenance": "orders"})


STAGED = f"""{ENTRANTS}, base AS (SELECT race_id || '-' || horse_id AS id, race_id, CAST(finish AS INTEGER) AS finish, round(price, 2) AS price FROM e WHERE (race_id + horse_id) % 3 <> 0),
staged AS (SELECT race_id || '-' || horse_id AS id, race_id, CAST(finish AS INTEGER) AS finish, round(CASE WHEN race_id % 5 = 0 THEN price + 1 ELSE price END, 2) AS price FROM e WHERE (race_id + horse_id) % 4 <> 0)"""


def stores(spark, sf_dir):
    """An active table and a staged one with new, repeated and altered rows."""
    e = entrants(spark, sf_dir)
    s = F.col("race_id") + F.col("horse_id")
    shape = lambda d, p: d.select(F.concat_ws("-", "race_id", "horse_id").alias("id"), "race_id", F.col("finish").cast("int").alias("finish"), F.round(p, 2).alias("price"))
    base = shape(e.where(s % 3 != 0), F.col("price"))
    staged = shape(e.where(s % 4 != 0), F.when(F.col("race_id") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return base, staged


@query(f"WITH {STAGED} SELECT count(*) AS overlap FROM staged WHERE EXISTS (SELECT 1 FROM base WHERE base.id = staged.id)")
def j05_overlap_count(spark, sf_dir):
    base, staged = stores(spark, sf_dir)
    return staged.join(base, "id", "left_semi").agg(count_rows().alias("overlap"))


@query(f"""WITH {STAGED}, j AS (SELECT s.*, CASE WHEN b.id IS NULL THEN 'new' WHEN s.race_id = b.race_id AND s.finish = b.finish AND s.price = b.price THEN 'duplicate' ELSE 'conflict' END AS kind FROM staged s LEFT JOIN base b USING (id))
SELECT kind, count(*) AS rows FROM j GROUP BY 1""")
def j06_classify_staged(spark, sf_dir):
    base, staged = stores(spark, sf_dir)
    return canonical.classified(staged, base, "id", ["race_id", "finish", "price"]).groupBy("kind").agg(count_rows().alias("rows"))


@query(f"WITH {STAGED} SELECT * FROM staged WHERE id NOT IN (SELECT id FROM base)")
def j07_new_only(spark, sf_dir):
    base, staged = stores(spark, sf_dir)
    return staged.join(base, "id", "left_anti")


@query(f"WITH {STAGED} SELECT s.id, s.price AS staged_price, b.price AS base_price FROM staged s JOIN base b USING (id) WHERE s.price <> b.price OR s.finish <> b.finish")
def j08_conflicts(spark, sf_dir):
    base, staged = stores(spark, sf_dir)
    columns = ["race_id", "finish", "price"]
    own = staged.select("id", F.col("price").alias("staged_price"), canonical.signature(columns).alias("s"))
    old = base.select("id", F.col("price").alias("base_price"), canonical.signature(columns).alias("b"))
    return own.join(old, "id").where("s <> b").select("id", "staged_price", "base_price")


@query(f"WITH {STAGED} SELECT * FROM base UNION ALL SELECT * FROM staged WHERE id NOT IN (SELECT id FROM base)")
def u07_canonical_merge(spark, sf_dir):
    """Candidates merged into the published version, validated again and published in its place."""
    base, staged = stores(spark, sf_dir)

    def unique(new):
        if new.groupBy("id").agg(count_rows().alias("k")).where("id is null or k > 1").limit(1).count():
            raise ValueError("keys must be there and unique")

    v = canonical.VersionedTable(spark, scratch(spark, "merge"), unique)
    v.publish(base, "base")
    return canonical.publish_merge(v, [staged], "id", "merged")


@query(f"WITH {STAGED} SELECT 0 AS priority, count(*) AS rows FROM base UNION ALL SELECT 1, count(*) FROM staged")
def u01_tagged_union(spark, sf_dir):
    base, staged = stores(spark, sf_dir)
    both = base.withColumn("priority", F.lit(0)).unionByName(staged.withColumn("priority", F.lit(1)))
    return both.groupBy("priority").agg(count_rows().alias("rows"))


@query(f"WITH {STAGED}, u AS (SELECT *, 0 AS p FROM base UNION ALL SELECT *, 1 FROM staged), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM u) SELECT p AS priority, count(*) AS kept FROM k WHERE rn = 1 GROUP BY 1")
def w10_dedup_keep_first(spark, sf_dir):
    base, staged = stores(spark, sf_dir)
    u = base.withColumn("priority", F.lit(0)).unionByName(staged.withColumn("priority", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("priority"))
    return u.withColumn("rn", first).where("rn = 1").groupBy("priority").agg(count_rows().alias("kept"))


@query(f"WITH {STAGED}, a AS (SELECT id FROM base), b AS (SELECT id FROM staged) SELECT *, only_left = 0 AND only_right = 0 AS same FROM (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right)")
def u03_key_set_equality(spark, sf_dir):
    base, staged = stores(spark, sf_dir)
    return gates.same_sets(base, staged, ["id"])


@query(f"""WITH {STAGED}, j AS (SELECT s.race_id, CASE WHEN b.id IS NULL THEN 'new' WHEN s.finish = b.finish AND s.price = b.price THEN 'duplicate' ELSE 'conflict' END AS kind FROM staged s LEFT JOIN base b USING (id)),
g AS (SELECT race_id % 3 AS source, count(*) FILTER (kind = 'conflict') AS conflicts FROM j GROUP BY 1)
SELECT source, conflicts, CASE WHEN conflicts = 0 THEN 'CLEAR' WHEN source = 1 THEN 'RIGHTS_REVIEW' ELSE 'HELD_FOR_REVIEW' END AS decision, source = 2 AS outranks FROM g""")
def m33_conflict_triage(spark, sf_dir):
    """Conflicts per source against its contract; none is replaced on its own."""
    base, staged = stores(spark, sf_dir)
    g = canonical.classified(staged, base, "id", ["race_id", "finish", "price"]).groupBy((F.col("race_id") % 3).alias("source")).agg(F.count_if(F.col("kind") == "conflict").alias("conflicts"))
    contract = spark.createDataFrame([(0, 1.0, 1.0, "CLEARED"), (1, 2.0, 1.0, "PENDING"), (2, 2.0, 1.0, "CLEARED")], "source long, own double, incumbent double, rights string")
    decision = F.when(F.col("conflicts") == 0, "CLEAR").when(F.col("rights") != "CLEARED", "RIGHTS_REVIEW").otherwise("HELD_FOR_REVIEW")
    return g.join(F.broadcast(contract), "source").select("source", "conflicts", decision.alias("decision"), ((F.col("own") > F.col("incumbent")) & (F.col("rights") == "CLEARED")).alias("outranks"))


@query("""SELECT t.*, k.rows FROM (VALUES ('lineitem', 3::BIGINT, '', '', '', 'CONTRACT_READY'), ('orders', 2, 'label_win', 'o_missing', '', 'INCOMPLETE'), ('part', 1, 'label_win,race_date', '', 'race_id', 'INCOMPLETE'), ('nation', 0, 'label_win,race_date,race_id', '', '', 'NEEDS_CONTRACT')) AS t(source, mapped, missing_targets, missing_columns, duplicate_targets, status)
 JOIN (SELECT 'lineitem' AS source, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation) k USING (source)""")
def p03_contract_assessment(spark, sf_dir):
    """Contracts against the catalog of tables, all sources in one job, with the rows that each decision is about."""
    catalog = None
    for name in ("orders", "part", "lineitem", "nation"):
        own = table(spark, sf_dir, name)
        rows = own.agg(count_rows().alias("rows")).select(F.lit(name).alias("source"), "rows", F.explode(F.array(*[F.lit(c) for c in own.columns])).alias("col"))
        catalog = rows if catalog is None else catalog.union(rows)
    rows = [("orders", "o_orderkey", "race_id"), ("orders", "o_orderdate", "race_date"), ("orders", "o_missing", "label_win"), ("part", "p_partkey", "race_id"), ("part", "p_name", "race_id"), ("lineitem", "l_orderkey", "race_id"), ("lineitem", "l_shipdate", "race_date"), ("lineitem", "l_linenumber", "label_win")]
    contract = spark.createDataFrame(rows, "source string, col string, target string")
    known = catalog.select("source", "col", F.lit(True).alias("there"))
    every = catalog.select("source", "rows").distinct()
    joined = contract.join(known, ["source", "col"], "left")
    counts = joined.where("there").groupBy("source", "target").agg(count_rows().alias("k"))
    per = counts.groupBy("source").agg(F.collect_set("target").alias("targets"), F.array_sort(F.collect_set(F.when(F.col("k") > 1, F.col("target")))).alias("dups"))
    lost = joined.where("there is null").groupBy("source").agg(F.array_sort(F.collect_set("col")).alias("lost"))
    want = F.array(*[F.lit(x) for x in ("label_win", "race_date", "race_id")])
    none = F.array().cast("array<string>")
    out = every.join(per, "source", "left").join(lost, "source", "left").select("source", "rows", *[F.coalesce(c, none).alias(c) for c in ("targets", "dups", "lost")])
    missing = F.array_except(want, "targets")
    status = F.when((F.size("targets") == 0) & (F.size("lost") == 0), "NEEDS_CONTRACT").when((F.size(missing) > 0) | (F.size("dups") > 0) | (F.size("lost") > 0), "INCOMPLETE").otherwise("CONTRACT_READY")
    return out.select("source", "rows", F.size("targets").cast("long").alias("mapped"), F.array_join(missing, ",").alias("missing_targets"), F.array_join("lost", ",").alias("missing_columns"), F.array_join("dups", ",").alias("duplicate_targets"), status.alias("status"))

