"""Queries on histories, strengths, rank probabilities and their scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import history, metrics, ordered, rankprob, resample
from ..registry import query
from ..sources.bindings import CONTESTS, ENTRANTS, contests, entrants, tasks
from ..sources.readers import stored

R = F.round

#: Histories as the operators compute them, for the oracle.
H1 = """h AS (SELECT race_id, horse_id, count(*) OVER w AS h_n, CAST(coalesce(sum(label_win) OVER w, 0) AS BIGINT) AS h_wins FROM e
 WINDOW w AS (PARTITION BY horse_id ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING))"""
P1 = f"""{H1},
b AS (SELECT e.*, h_n, h_wins, (h_wins + 1) / (h_n + 12)::DOUBLE AS base FROM e JOIN h USING (race_id, horse_id)),
p AS (SELECT *, base / sum(base) OVER (PARTITION BY race_id) AS p FROM b)"""
LOSS = "-CASE WHEN {y} = 1 THEN ln(greatest(least({p}, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least({p}, 1 - 1e-15), 1e-15)) END"
BRIER = "(greatest(least({p}, 1 - 1e-15), 1e-15) - {y}) ** 2"
PL = """j AS (SELECT a.race_id, a.horse_id AS i, b.horse_id AS j, a.p AS pi, b.p AS pj FROM p a JOIN p b ON a.race_id = b.race_id AND a.horse_id <> b.horse_id),
pool AS (SELECT race_id, i AS j, sum(pj / greatest(1 - pi - pj, 1e-15)) AS pool FROM j GROUP BY 1, 2),
s AS (SELECT race_id, i AS horse_id, sum(pi * pj / (1 - pj)) AS second, sum(pi * pj / (1 - pj) * (pool - pi / greatest(1 - pj - pi, 1e-15))) AS third FROM j JOIN pool USING (race_id, j) GROUP BY 1, 2),
m AS (SELECT p.*, p.p AS p_win, p.p + coalesce(second, 0) AS p_top2, p.p + coalesce(second, 0) + coalesce(third, 0) AS p_top3 FROM p LEFT JOIN s USING (race_id, horse_id))"""


def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entrants with their 1095-day history, base rate and share p."""
    h = history.history(entrants(spark, sf_dir), ["horse_id"], {"wins": F.col("label_win")})
    h = h.withColumn("base", history.smoothed(F.col("h_wins"), F.col("h_n")))
    return h.withColumn("p", history.share(F.col("base"), "race_id"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rates with rank-model probabilities for one, two and three places."""
    p = base_rates(spark, sf_dir)
    return rankprob.marginals(p, keep=[c for c in p.columns if c not in ("race_id", "horse_id")])


@query(f"""WITH {ENTRANTS}, {P1}
SELECT count(*) AS rows, count(DISTINCT race_id) AS races, count(DISTINCT day) AS days,
 round(sum({LOSS.format(p="p", y="label_win")}) / count(*), 6) AS logloss, round(sum({BRIER.format(p="p", y="label_win")}) / count(*), 6) AS brier FROM p""")
def flagship_rolling_rate_scores(spark, sf_dir):
    """Bound contests, leak-free 1095-day rates, in-contest shares, mean losses."""
    p = base_rates(spark, sf_dir)
    per = p.groupBy("race_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(metrics.log_loss(F.col("p"), F.col("label_win"))).alias("l"), F.sum(metrics.brier(F.col("p"), F.col("label_win"))).alias("b"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("races"), F.count_distinct("day").alias("days"), R(F.sum("l") / F.sum("n"), 6).alias("logloss"), R(F.sum("b") / F.sum("n"), 6).alias("brier"))


@query(f"WITH {ENTRANTS}, {H1} SELECT race_id, horse_id, h_n, h_wins FROM h")
def w01_rolling_history(spark, sf_dir):
    return history.history(entrants(spark, sf_dir), ["horse_id"], {"wins": F.col("label_win")}).select("race_id", "horse_id", "h_n", "h_wins")


@query(f"""WITH {ENTRANTS} SELECT race_id, horse_id, count(*) OVER w AS h_n, CAST(coalesce(sum(label_top3) OVER w, 0) AS BIGINT) AS h_top3 FROM e
WINDOW w AS (PARTITION BY horse_id ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w02_expanding_history(spark, sf_dir):
    return history.history(entrants(spark, sf_dir), ["horse_id"], {"top3": F.col("label_top3")}, days=None).select("race_id", "horse_id", "h_n", "h_top3")


@query(f"""WITH {ENTRANTS} SELECT race_id, horse_id, round(coalesce(sum(pow(2.0, (dn - 9000) / 365.0)) OVER w / pow(2.0, (dn - 9000) / 365.0), 0), 6) AS d_n,
 round(coalesce(sum(label_win * pow(2.0, (dn - 9000) / 365.0)) OVER w / pow(2.0, (dn - 9000) / 365.0), 0), 6) AS d_wins FROM e
WINDOW w AS (PARTITION BY horse_id ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w03_decayed_history(spark, sf_dir):
    d = history.decayed(entrants(spark, sf_dir), ["horse_id"], {"wins": F.col("label_win")}, 365.0, 9000)
    return d.select("race_id", "horse_id", R("d_n", 6).alias("d_n"), R("d_wins", 6).alias("d_wins"))


@query(f"""WITH {ENTRANTS}, {P1} SELECT race_id, horse_id, count(*) OVER w AS x_n, round(coalesce(sum(p) OVER w, 0), 6) AS x_expected, CAST(coalesce(sum(label_win) OVER w, 0) AS BIGINT) AS x_wins FROM p
WINDOW w AS (PARTITION BY agent_id ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)""")
def w04_expected_wins(spark, sf_dir):
    p = history.history(base_rates(spark, sf_dir), ["agent_id"], {"expected": F.col("p"), "wins": F.col("label_win")}, prefix="x_")
    return p.select("race_id", "horse_id", "x_n", R("x_expected", 6).alias("x_expected"), "x_wins")


@query(f"WITH {ENTRANTS}, {P1} SELECT race_id, horse_id, round(base, 6) AS base, round(p, 6) AS p FROM p")
def w11_share_in_contest(spark, sf_dir):
    return base_rates(spark, sf_dir).select("race_id", "horse_id", R("base", 6).alias("base"), R("p", 6).alias("p"))


CONTEXT = """x AS (SELECT race_id, horse_id, count(*) OVER w AS c_n, coalesce(sum(label_win) OVER w, 0) AS c_wins FROM e
 WINDOW w AS (PARTITION BY horse_id, {keys} ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {ENTRANTS}, {P1}, {CONTEXT.format(keys="track, distance // 400, coalesce(nullif(grade, ''), '0'), race_class")}
SELECT race_id, horse_id, c_n, round(base * (1 - least(0.5, c_n / (c_n + 5.0))) + least(0.5, c_n / (c_n + 5.0)) * (c_wins + 24 / 12.0) / (c_n + 24.0), 6) AS strength FROM p JOIN x USING (race_id, horse_id)""")
def m01_context_strength(spark, sf_dir):
    p = base_rates(spark, sf_dir).withColumns({"band": F.floor(F.col("distance") / 400), "g": F.coalesce(F.nullif(F.col("grade"), F.lit("")), F.lit("0"))})
    c = history.history(p, ["horse_id", "track", "band", "g", "race_class"], {"wins": F.col("label_win")}, prefix="c_")
    return c.select("race_id", "horse_id", "c_n", R(history.context_blend(F.col("base"), F.col("c_wins"), F.col("c_n"), 24.0, 0.5), 6).alias("strength"))


AGENT = """a AS (SELECT race_id, horse_id, count(*) OVER w AS a_n, coalesce(sum(label_win) OVER w, 0) AS a_wins FROM e WINDOW w AS (PARTITION BY {key} ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {ENTRANTS}, {P1}, {AGENT.format(key="agent_id")},
a2 AS (SELECT race_id, horse_id, count(*) OVER w AS t_n, coalesce(sum(label_win) OVER w, 0) AS t_wins FROM e WINDOW w AS (PARTITION BY venue, race_class ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, base * (1 - 0.25 * a_n / (a_n + 100.0)) + 0.25 * a_n / (a_n + 100.0) * (a_wins + 10) / (a_n + 120.0) AS one, base * (1 - 0.25 * t_n / (t_n + 100.0)) + 0.25 * t_n / (t_n + 100.0) * (t_wins + 10) / (t_n + 120.0) AS two
 FROM p JOIN a USING (race_id, horse_id) JOIN a2 USING (race_id, horse_id))
SELECT race_id, horse_id, round(one, 9) AS first_agent, round(two, 9) AS second_agent, round((one + two) / 2, 9) AS both FROM z""")
def m02_agent_blend(spark, sf_dir):
    p = history.history(base_rates(spark, sf_dir), ["agent_id"], {"wins": F.col("label_win")}, prefix="a_")
    p = history.history(p, ["venue", "race_class"], {"wins": F.col("label_win")}, prefix="t_")
    one = history.agent_blend(F.col("base"), F.col("a_wins"), F.col("a_n"), 0.25)
    two = history.agent_blend(F.col("base"), F.col("t_wins"), F.col("t_n"), 0.25)
    return p.select("race_id", "horse_id", R(one, 9).alias("first_agent"), R(two, 9).alias("second_agent"), R((one + two) / 2, 9).alias("both"))


#: Condition candidates: context, prior strength, cap.
CONTEXTS = {"class200": ["band200", "race_class"], "class400": ["band400", "race_class"], "class800": ["band800", "race_class"], "venue_class": ["venue", "race_class"], "track_distance": ["track", "band400"]}
CONTEXT_SQL = {"class200": "distance // 200, race_class", "class400": "distance // 400, race_class", "class800": "distance // 800, race_class", "venue_class": "venue, race_class", "track_distance": "track, distance // 400"}
GRID = [(f"class{w}", s, c) for s in (12, 24) for w in (200, 400, 800) for c in (0.25, 0.5)] + [(k, 12, c) for k in ("venue_class", "track_distance") for c in (0.25, 0.5)]


def in_contexts(spark: SparkSession, sf_dir: str, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """race_id, label_win, base rate and <context>_n, <context>_wins of each context, from narrow rows."""
    e = entrants(spark, sf_dir).withColumns({f"band{w}": F.floor(F.col("distance") / w) for w in (200, 400, 800)})
    sets = {"h_": [], **{f"{k}_": CONTEXTS[k] for k in names}}
    needed = sorted({c for extra in sets.values() for c in extra} | {"race_id", "horse_id", "label_win", "dn", *keep})
    c = history.contexts(e.select(*needed), "horse_id", sets, {"wins": F.col("label_win")}, tasks=tasks(spark, sf_dir))
    return c.withColumn("base", history.smoothed(F.col("h_wins"), F.col("h_n")))


@query(f"""WITH {ENTRANTS}, {P1}, g AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {s}, CAST({c} AS DOUBLE))" for k, s, c in GRID)}) AS t(context, s, cap)),
k AS ({" UNION ALL ".join(f"SELECT race_id, horse_id, '{k}' AS context, count(*) OVER w AS c_n, coalesce(sum(label_win) OVER w, 0) AS c_wins FROM e WINDOW w AS (PARTITION BY horse_id, {x} ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)" for k, x in CONTEXT_SQL.items())}),
z AS (SELECT p.race_id, p.horse_id, label_win, context, s, cap, base * (1 - least(cap, c_n / (c_n + 5.0))) + least(cap, c_n / (c_n + 5.0)) * (c_wins + s / 12.0) / (c_n + s) AS v FROM p JOIN k USING (race_id, horse_id) JOIN g USING (context)),
q AS (SELECT *, v / sum(v) OVER (PARTITION BY race_id, context, s, cap) AS q FROM z),
l AS (SELECT context, s, cap, count(*) AS rows, round(avg({LOSS.format(p="q", y="label_win")}), 6) AS logloss FROM q GROUP BY ALL)
SELECT *, CAST(rank() OVER (ORDER BY logloss) AS INTEGER) AS place FROM l""")
def m03_candidate_grid(spark, sf_dir):
    """Sixteen condition candidates at once: one pass for all contexts, caps and strengths as columns."""
    p = in_contexts(spark, sf_dir, list(CONTEXTS))
    values = [history.context_blend(F.col("base"), F.col(f"{k}_wins"), F.col(f"{k}_n"), float(s), c) for k, s, c in GRID]
    race = Window.partitionBy("race_id")
    p = p.select("race_id", "label_win", *[v.alias(f"v{i}") for i, v in enumerate(values)])
    p = p.select("race_id", "label_win", *[(F.col(f"v{i}") / F.sum(f"v{i}").over(race)).alias(f"q{i}") for i in range(len(GRID))])
    losses = p.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(metrics.log_loss(F.col(f"q{i}"), F.col("label_win"))).alias(f"l{i}") for i in range(len(GRID))])
    long = losses.select("rows", F.explode(F.array(*[F.struct(F.lit(k).alias("context"), F.lit(s).alias("s"), F.lit(c).alias("cap"), R(F.col(f"l{i}"), 6).alias("logloss")) for i, (k, s, c) in enumerate(GRID)])).alias("x"))
    return long.select("x.*", "rows").withColumn("place", F.rank().over(Window.orderBy("logloss")))


AGENTS = [("control", "none", 0.0)] + [(f"{who}{int(100 * c)}", who, c) for who in ("first", "second", "both") for c in (0.10, 0.25)]
BLEND = "v0 * (1 - cap * {n} / ({n} + 100.0)) + cap * {n} / ({n} + 100.0) * ({w} + 10) / ({n} + 120.0)"


@query(f"""WITH {ENTRANTS}, {P1}, {AGENT.format(key="agent_id")},
a2 AS (SELECT race_id, horse_id, count(*) OVER w AS t_n, coalesce(sum(label_win) OVER w, 0) AS t_wins FROM e WINDOW w AS (PARTITION BY venue, race_class ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
k AS (SELECT race_id, horse_id, count(*) OVER w AS c_n, coalesce(sum(label_win) OVER w, 0) AS c_wins FROM e WINDOW w AS (PARTITION BY horse_id, {CONTEXT_SQL["class800"]} ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
g AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{w}', CAST({c} AS DOUBLE))" for n, w, c in AGENTS)}) AS t(config, who, cap)),
y AS (SELECT p.race_id, p.horse_id, label_win, base * (1 - least(0.5, c_n / (c_n + 5.0))) + least(0.5, c_n / (c_n + 5.0)) * (c_wins + 2.0) / (c_n + 24.0) AS v0, a_n, a_wins, t_n, t_wins FROM p JOIN k USING (race_id, horse_id) JOIN a USING (race_id, horse_id) JOIN a2 USING (race_id, horse_id)),
z AS (SELECT y.*, config, CASE who WHEN 'none' THEN v0 WHEN 'first' THEN {BLEND.format(n="a_n", w="a_wins")} WHEN 'second' THEN {BLEND.format(n="t_n", w="t_wins")} ELSE ({BLEND.format(n="a_n", w="a_wins")} + {BLEND.format(n="t_n", w="t_wins")}) / 2 END AS v FROM y, g),
q AS (SELECT *, v / sum(v) OVER (PARTITION BY race_id, config) AS q, v0 / sum(v0) OVER (PARTITION BY race_id, config) AS p0 FROM z)
SELECT config, count(*) AS rows, round(avg({LOSS.format(p="q", y="label_win")}), 6) AS logloss, round(avg({LOSS.format(p="q", y="label_win")} - ({LOSS.format(p="p0", y="label_win")})), 6) + 0.0 AS delta FROM q GROUP BY config""")
def m04_agent_grid(spark, sf_dir):
    """Seven agent configurations on the class context (strength 24, width 800, cap .5); the control has no delta."""
    p = in_contexts(spark, sf_dir, ["class800"], keep=("agent_id", "venue"))
    p = p.select("race_id", "label_win", "dn", "agent_id", "venue", "race_class", history.context_blend(F.col("base"), F.col("class800_wins"), F.col("class800_n"), 24.0, 0.5).alias("v0"))
    p = history.history(p, ["agent_id"], {"wins": F.col("label_win")}, prefix="a_")
    p = history.history(p, ["venue", "race_class"], {"wins": F.col("label_win")}, prefix="t_")
    first = lambda c: history.agent_blend(F.col("v0"), F.col("a_wins"), F.col("a_n"), c)
    second = lambda c: history.agent_blend(F.col("v0"), F.col("t_wins"), F.col("t_n"), c)
    blend = {"none": lambda c: F.col("v0"), "first": first, "second": second, "both": lambda c: (first(c) + second(c)) / 2}
    race, y = Window.partitionBy("race_id"), F.col("label_win")
    p = p.select("race_id", "label_win", *[blend[who](c).alias(name) for name, who, c in AGENTS])
    p = p.select("label_win", *[(F.col(name) / F.sum(name).over(race)).alias(name) for name, _, _ in AGENTS])
    loss = lambda name: metrics.log_loss(F.col(name), y)
    one = p.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.avg(loss(name)).alias("l"), F.avg(loss(name) - loss("control")).alias("d")).alias(name) for name, _, _ in AGENTS])
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), R(F.col(f"{name}.l"), 6).alias("logloss"), (R(F.col(f"{name}.d"), 6) + 0.0).alias("delta")) for name, _, _ in AGENTS]))
    return one.select("rows", long.alias("x")).select("x.*", "rows")


@query(f"WITH {ENTRANTS}, {P1}, {PL} SELECT race_id, horse_id, round(p_win, 6) AS p_win, round(p_top2, 6) AS p_top2, round(p_top3, 6) AS p_top3 FROM m")
def m08_rank_marginals(spark, sf_dir):
    return rankprob.marginals(base_rates(spark, sf_dir)).select("race_id", "horse_id", *[R(c, 6).alias(c) for c in ("p_win", "p_top2", "p_top3")])


@query(f"""WITH {ENTRANTS}, {P1}, {PL}, dm AS (SELECT race_id, p_win, CASE WHEN race_id % 89 = 3 THEN p_top2 * 0.5 ELSE p_top2 END AS p_top2, CASE WHEN race_id % 83 = 4 THEN NULL WHEN race_id % 79 = 5 THEN 1.5 ELSE p_top3 END AS p_top3 FROM m),
k AS (SELECT race_id, count(*) AS n, sum(p_win) AS w, sum(p_top2) AS t2, sum(p_top3) AS t3, count(*) FILTER (p_top3 IS NULL OR p_top2 IS NULL OR p_win IS NULL) AS missing, count(*) FILTER (p_win < -1e-9 OR p_win > 1 + 1e-9 OR p_top2 < -1e-9 OR p_top2 > 1 + 1e-9 OR p_top3 < -1e-9 OR p_top3 > 1 + 1e-9) AS outside, count(*) FILTER (p_top2 < p_win - 1e-9 OR p_top3 < p_top2 - 1e-9) AS falling FROM dm GROUP BY 1)
SELECT count(*) AS races, count(*) FILTER (missing > 0) AS not_finite, count(*) FILTER (outside > 0) AS outside, count(*) FILTER (falling > 0) AS falling, count(*) FILTER (abs(w - 1) > 1e-9 OR abs(t2 - least(2, n)) > 1e-9 OR abs(t3 - least(3, n)) > 1e-9) AS bad_mass FROM k""")
def p30_probability_mass(spark, sf_dir):
    """Contests with values that aren't finite, outside 0 to 1, falling over the targets, or of another mass than min(k, n), after some were damaged."""
    r = F.col("race_id")
    m = scored(spark, sf_dir).withColumn("p_top2", F.when(r % 89 == 3, F.col("p_top2") * 0.5).otherwise(F.col("p_top2")))
    m = m.withColumn("p_top3", F.when(r % 83 == 4, None).when(r % 79 == 5, 1.5).otherwise(F.col("p_top3")))
    names, far = ("p_win", "p_top2", "p_top3"), 1e-9
    out, missing, bad = F.lit(False), F.lit(False), F.lit(False)
    for k, c in enumerate(names, 1):
        out = out | (F.col(c) < -far) | (F.col(c) > 1 + far)
        missing = missing | F.col(c).isNull() | F.isnan(c)
        bad = bad | (F.abs(F.col(f"s_{c}") - F.least(F.lit(k), F.col("n"))) > far)
    falling = (F.col("p_top2") < F.col("p_win") - far) | (F.col("p_top3") < F.col("p_top2") - far)
    per = m.groupBy("race_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in names], F.bool_or(missing).alias("missing"), F.bool_or(out).alias("outside"), F.bool_or(falling).alias("falling"))
    return per.agg(F.count(F.lit(1)).alias("races"), F.count_if("missing").alias("not_finite"), F.count_if("outside").alias("outside"), F.count_if("falling").alias("falling"), F.count_if(bad).alias("bad_mass"))


@query(f"WITH {ENTRANTS}, {P1}, t AS (SELECT race_id, horse_id, pow(p, 2.3) AS x FROM p) SELECT race_id, horse_id, round(x / sum(x) OVER (PARTITION BY race_id), 6) AS p FROM t")
def m09_temperature(spark, sf_dir):
    p = base_rates(spark, sf_dir)
    return p.select("race_id", "horse_id", R(rankprob.tempered(F.col("p"), 2.3, "race_id"), 6).alias("p"))


THREE = f"""t AS (SELECT race_id, horse_id, k, CASE k WHEN 1 THEN p_win WHEN 2 THEN p_top2 ELSE p_top3 END AS q, CAST(finish <= k AS INTEGER) AS y FROM m, (VALUES (1), (2), (3)) AS g(k)),
a5 AS (SELECT race_id, k, count(*) AS rows, sum(y) AS positives, sum({LOSS.format(p="q", y="y")}) AS logloss, sum({BRIER.format(p="q", y="y")}) AS brier, arg_min(y, (-round(q, 12), horse_id)) AS hit FROM t GROUP BY 1, 2)"""


ALPHAS = [round(0.5 + 0.1 * i, 1) for i in range(26)]
P0 = P1.replace("p AS (SELECT *", "p0 AS (SELECT *")


def three_losses(p: DataFrame) -> DataFrame:
    """Rows of three_targets of (race_id, horse_id, finish, p) after the rank model."""
    m = rankprob.marginals(p, keep=["finish"]).withColumns({c: F.round(c, 12) for c in ("p_win", "p_top2", "p_top3")})
    return metrics.three_targets(m, "race_id", "horse_id", "finish", ["p_win", "p_top2", "p_top3"])


@query(f"""WITH {ENTRANTS}, {P0}, g AS (SELECT i, round(CAST(0.5 + 0.1 * i AS DOUBLE), 1) AS alpha FROM range(26) t(i)),
x0 AS (SELECT race_id * 100 + i AS race_id, horse_id, finish, pow(p, alpha) AS x FROM p0, g WHERE year(day) = 1995),
p AS (SELECT race_id, horse_id, finish, x / sum(x) OVER (PARTITION BY race_id) AS p FROM x0), {PL}, {THREE},
l AS (SELECT race_id % 100 AS i, k, sum(logloss) / sum(rows) AS l FROM a5 WHERE positives = least(k, rows) GROUP BY 1, 2), o AS (SELECT i, avg(l) AS l FROM l GROUP BY 1)
SELECT alpha, round(l, 6) AS logloss FROM o JOIN g USING (i) ORDER BY round(l, 10), abs(alpha - 1), alpha LIMIT 1""")
def m10_fit_temperature(spark, sf_dir):
    """Exponent with the least mean of three losses in the fit year; ties: nearest to one, then the smaller."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha")) for i, a in enumerate(ALPHAS)]))
    p = base_rates(spark, sf_dir).where(F.year("day") == 1995).select("race_id", "horse_id", "finish", "p", grid.alias("g"))
    p = p.select((F.col("race_id") * 100 + F.col("g.i")).alias("race_id"), "horse_id", "finish", "p", "g.alpha")
    t = three_losses(p.withColumn("p", rankprob.tempered(F.col("p"), F.col("alpha"), "race_id")).drop("alpha"))
    l = t.groupBy((F.col("race_id") % 100).alias("i"), "k").agg((F.sum("logloss") / F.sum("rows")).alias("l")).groupBy("i").agg(F.avg("l").alias("l"))
    l = l.withColumn("alpha", F.get(F.array(*[F.lit(a) for a in ALPHAS]), F.col("i").cast("int")))
    return l.agg(F.min_by(F.struct("alpha", "l"), F.struct(R("l", 10), F.abs(F.col("alpha") - 1), F.col("alpha"))).alias("x")).select("x.alpha", R("x.l", 6).alias("logloss"))


@query(f"""WITH {ENTRANTS}, {P0}, p AS (SELECT race_id * 2 AS race_id, horse_id, finish, p FROM p0 UNION ALL SELECT race_id * 2 + 1, horse_id, finish, pow(p, 1.3) / sum(pow(p, 1.3)) OVER (PARTITION BY race_id) FROM p0), {PL}, {THREE},
v AS (SELECT t.race_id % 2 AS stage, t.k, round(q, 12) AS q, y FROM t JOIN a5 USING (race_id, k) WHERE positives = least(k, rows)),
bins AS (SELECT stage, k, b, greatest(0, least(b - 1, CAST(floor(q * b) AS INTEGER))) AS bin, count(*) AS n, avg(q) AS mv, avg(y) AS mr FROM v, (VALUES (10), (20)) AS g(b) GROUP BY ALL),
ece AS (SELECT stage, k, sum(n * abs(mv - mr)) FILTER (b = 10) / sum(n) FILTER (b = 10) AS ece10, sum(n * abs(mv - mr)) FILTER (b = 20) / sum(n) FILTER (b = 20) AS ece20 FROM bins GROUP BY 1, 2),
al AS (SELECT race_id % 2 AS stage, k, sum(logloss) / sum(rows) AS logloss, sum(brier) / sum(rows) AS brier, avg(hit) AS hit_rate FROM a5 WHERE positives = least(k, rows) GROUP BY 1, 2), ae AS (SELECT * FROM al JOIN ece USING (stage, k)),
gt AS (SELECT bool_and(a.logloss < b.logloss AND a.brier < b.brier AND a.ece10 <= b.ece10 AND a.ece20 <= b.ece20) AS passed FROM ae a JOIN ae b ON a.k = b.k AND a.stage = 1 AND b.stage = 0)
SELECT CASE stage WHEN 0 THEN 'before' ELSE 'after' END AS stage, k, round(logloss, 6) AS logloss, round(brier, 6) AS brier, round(ece10, 6) AS ece10, round(ece20, 6) AS ece20, round(hit_rate, 6) AS hit_rate, passed FROM ae, gt""")
def m11_calibration_comparison(spark, sf_dir):
    """Three targets before and after tempering: losses, ECE, hit rate (which can't change), and the gate: all six means better, no ECE worse."""
    al = metrics.power_calibration(base_rates(spark, sf_dir), "race_id", "horse_id", "finish", "p", [1.0, 1.3], [10, 20])
    names = ("logloss", "brier", "ece10", "ece20")
    other = lambda c, s: F.max(F.when(F.col("stage") == s, F.col(c))).over(Window.partitionBy("k"))
    better = lambda c: other(c, 1) < other(c, 0) if c in ("logloss", "brier") else other(c, 1) <= other(c, 0)
    al = al.withColumn("good", better("logloss") & better("brier") & better("ece10") & better("ece20"))  # six rows
    al = al.withColumn("passed", F.min("good").over(Window.partitionBy()))
    return al.select(F.when(F.col("stage") == 0, "before").otherwise("after").alias("stage"), "k", *[R(c, 6).alias(c) for c in (*names, "hit_rate")], "passed")


@query(f"""WITH {ENTRANTS}, {P1} SELECT race_id, count(*) AS rows, round(sum({LOSS.format(p="p", y="label_win")}), 6) AS logloss, round(sum({BRIER.format(p="p", y="label_win")}), 6) AS brier FROM p GROUP BY race_id""")
def a01_contest_losses(spark, sf_dir):
    m = metrics.per_contest(base_rates(spark, sf_dir), ["race_id"], "p", "label_win")
    return m.select("race_id", "rows", R("logloss", 6).alias("logloss"), R("brier", 6).alias("brier"))


@query(f"""WITH {ENTRANTS}, {P1}, z AS (SELECT *, 1.0::DOUBLE / n AS u FROM p)
SELECT count(*) AS rows, count(DISTINCT race_id) AS races, count(DISTINCT day) AS days, round(avg({LOSS.format(p="p", y="label_win")}), 6) AS model, round(avg({LOSS.format(p="u", y="label_win")}), 6) AS uniform,
 round(avg({LOSS.format(p="p", y="label_win")} - ({LOSS.format(p="u", y="label_win")})), 6) AS delta FROM z""")
def a02_overall_metrics(spark, sf_dir):
    """Overall paired metrics of the model and of equal chances."""
    p = base_rates(spark, sf_dir)
    y = F.col("label_win")
    model, flat = metrics.log_loss(F.col("p"), y), metrics.log_loss(F.lit(1.0) / F.col("n"), y)
    per = p.groupBy("race_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(model).alias("m"), F.sum(flat).alias("u"))
    mean = lambda c: R(F.sum(c) / F.sum("n"), 6)
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("races"), F.count_distinct("day").alias("days"), mean("m").alias("model"), mean("u").alias("uniform"), mean(F.col("m") - F.col("u")).alias("delta"))


@query(f"""WITH {ENTRANTS}, {P1}, z AS (SELECT race_id, venue, year(day) AS y, month(day) AS m, count(*) AS n, sum({LOSS.format(p="p", y="label_win")}) AS l FROM p GROUP BY ALL)
SELECT venue, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(sum(n) AS BIGINT) AS rows, count(*) AS races, round(sum(l) / sum(n), 6) AS logloss FROM z GROUP BY GROUPING SETS ((), (m), (venue), (y))""")
def a03_grouped_metrics(spark, sf_dir):
    """Overall, by month, venue and year in one pass of grouping sets."""
    per = base_rates(spark, sf_dir).groupBy("race_id", "venue", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(metrics.log_loss(F.col("p"), F.col("label_win"))).alias("l"))
    sets = per.groupingSets([[], ["month"], ["venue"], ["year"]], "month", "venue", "year")
    return sets.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("races"), R(F.sum("l") / F.sum("n"), 6).alias("logloss")).select("venue", "year", "month", "rows", "races", "logloss")


DAILY = f"d AS (SELECT day, dn, count(*) AS rows, count(DISTINCT race_id) AS races, sum({LOSS.format(p='p', y='label_win')} - ({LOSS.format(p='(1.0::DOUBLE / n)', y='label_win')})) AS delta FROM p GROUP BY ALL)"


def daily_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: rows, races and the summed loss difference of the model to equal chances."""
    y = F.col("label_win")
    d = metrics.log_loss(F.col("p"), y) - metrics.log_loss(F.lit(1.0) / F.col("n"), y)
    per = base_rates(spark, sf_dir).groupBy("race_id", "day", "dn").agg(F.count(F.lit(1)).alias("rows"), F.sum(d).alias("delta"))
    return per.groupBy("day", "dn").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("races"), F.sum("delta").alias("delta"))


@query(f"WITH {ENTRANTS}, {P1}, {DAILY} SELECT CAST(day AS VARCHAR) AS day, CAST(rows AS BIGINT) AS rows, races, round(delta, 6) AS delta FROM d")
def a04_daily_deltas(spark, sf_dir):
    return daily_deltas(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "rows", "races", R("delta", 6).alias("delta"))


@query(f"""WITH {ENTRANTS}, {P1}, {PL}, {THREE}
SELECT k, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS races, round(sum(logloss) / sum(rows), 6) AS logloss, round(sum(brier) / sum(rows), 6) AS brier, round(avg(hit), 6) AS hit_rate
FROM a5 WHERE positives = least(k, rows) GROUP BY k""")
def a05_three_target_metrics(spark, sf_dir):
    m = scored(spark, sf_dir).withColumns({c: F.round(c, 12) for c in ("p_win", "p_top2", "p_top3")})
    t = metrics.three_targets(m, "race_id", "horse_id", "finish", ["p_win", "p_top2", "p_top3"])
    return t.groupBy("k").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("races"), R(F.sum("logloss") / F.sum("rows"), 6).alias("logloss"), R(F.sum("brier") / F.sum("rows"), 6).alias("brier"), R(F.avg("hit"), 6).alias("hit_rate"))


@query(f"""WITH {ENTRANTS}, {P1} SELECT CAST(year(day) AS INTEGER) AS year, count(*) AS rows, round(avg({LOSS.format(p="p", y="label_win")}), 6) AS logloss FROM p GROUP BY 1""")
def a06_mergeable_partials(spark, sf_dir):
    """Monthly partial sums, merged into yearly metrics without another pass over rows."""
    part = base_rates(spark, sf_dir).groupBy(F.trunc("day", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(metrics.log_loss(F.col("p"), F.col("label_win"))).alias("l"))
    return part.groupBy(F.year("month").alias("year")).agg(F.sum("n").alias("rows"), R(F.sum("l") / F.sum("n"), 6).alias("logloss"))


@query(f"""WITH {ENTRANTS}, {P1}, {DAILY}, y AS (SELECT year(day) AS y, sum(delta) AS s FROM d GROUP BY 1) SELECT count(*) AS years, count(*) FILTER (s < 0) AS improved FROM y""")
def a07_improved_years(spark, sf_dir):
    years = daily_deltas(spark, sf_dir).groupBy(F.year("day").alias("y")).agg(F.sum("delta").alias("s"))
    return years.agg(F.count(F.lit(1)).alias("years"), F.count_if(F.col("s") < 0).alias("improved"))


@query(f"""WITH {ENTRANTS}, {P1}, z AS (SELECT least(9, CAST(floor(round(p, 12) * 10) AS INTEGER)) AS bin, p, label_win FROM p)
SELECT CAST(g.bin AS INTEGER) AS bin, count(p) AS rows, round(avg(p), 6) AS mean_p, round(avg(label_win), 6) AS rate FROM range(10) g(bin) LEFT JOIN z ON z.bin = g.bin GROUP BY g.bin""")
def a13_calibration_table(spark, sf_dir):
    t = metrics.calibration(base_rates(spark, sf_dir), "p", "label_win", 10)
    return t.select("bin", "rows", R("mean_p", 6).alias("mean_p"), R("rate", 6).alias("rate"))


@query(f"""WITH {ENTRANTS}, {P1}, top AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(p, 12) DESC, horse_id) AS rn FROM p),
z AS (SELECT 'all' AS pop, p, label_win FROM p UNION ALL SELECT 'top', p, label_win FROM top WHERE rn = 1),
bb AS (SELECT pop, least(19, CAST(floor(round(p, 12) * 20) AS INTEGER)) AS bin, count(*) AS n, avg(p) AS mp, avg(label_win) AS mr FROM z GROUP BY 1, 2)
SELECT pop, round(sum(n * abs(mp - mr)) / sum(n), 6) AS ece FROM bb GROUP BY pop""")
def a13_expected_calibration_error(spark, sf_dir):
    p = base_rates(spark, sf_dir).withColumn("key", F.round("p", 12))
    top = metrics.top_pick(p, "race_id", "horse_id", "key")
    u = p.select(F.lit("all").alias("pop"), "p", "label_win").union(top.select(F.lit("top"), "p", "label_win"))
    return metrics.ece(metrics.calibration(u, "p", "label_win", 20, ["pop"]), ["pop"]).select("pop", R("ece", 6).alias("ece"))


SWAPS = f"""z AS (SELECT p.*, base * (1 - 0.25 * a_n / (a_n + 100.0)) + 0.25 * a_n / (a_n + 100.0) * (a_wins + 10) / (a_n + 120.0) AS v FROM p JOIN a USING (race_id, horse_id)),
q AS (SELECT *, v / sum(v) OVER (PARTITION BY race_id) AS q FROM z),
k AS (SELECT race_id, arg_min(horse_id, (-round(p, 12), horse_id)) AS old_id, arg_min(horse_id, (-round(q, 12), horse_id)) AS new_id, arg_min(label_win, (-round(p, 12), horse_id)) AS old_hit, arg_min(label_win, (-round(q, 12), horse_id)) AS new_hit,
 any_value(dn) AS dn, count(*) AS n, sum({LOSS.format(p="q", y="label_win")} - ({LOSS.format(p="p", y="label_win")})) AS delta FROM q GROUP BY race_id)"""


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contest: top picks of baseline and agent-blended model, hits, loss difference."""
    p = history.history(base_rates(spark, sf_dir), ["agent_id"], {"wins": F.col("label_win")}, prefix="a_")
    q = p.withColumn("q", history.share(history.agent_blend(F.col("base"), F.col("a_wins"), F.col("a_n"), 0.25), "race_id"))
    y = F.col("label_win")
    first = lambda c, by: F.min_by(c, F.struct(-F.round(by, 12), F.col("horse_id")))
    return q.groupBy("race_id").agg(
        F.first("dn").alias("dn"),
        first("horse_id", "p").alias("old_id"),
        first("horse_id", "q").alias("new_id"),
        first("label_win", "p").alias("old_hit"),
        first("label_win", "q").alias("new_hit"),
        F.count(F.lit(1)).alias("n"),
        F.sum(metrics.log_loss(F.col("q"), y) - metrics.log_loss(F.col("p"), y)).alias("delta"),
    )


@query(f"""WITH {ENTRANTS}, {P1}, {AGENT.format(key="agent_id")}, {SWAPS} SELECT count(*) AS races, count(*) FILTER (old_id <> new_id) AS swaps, count(*) FILTER (old_id <> new_id AND new_hit > old_hit) AS gains,
 count(*) FILTER (old_id <> new_id AND new_hit < old_hit) AS losses, count(*) FILTER (old_id <> new_id AND new_hit = 1 AND old_hit = 1) AS both_hit, count(*) FILTER (old_id <> new_id AND new_hit = 0 AND old_hit = 0) AS both_miss,
 CAST(sum(new_hit - old_hit) AS BIGINT) AS net FROM k""")
def a14_top_pick_swaps(spark, sf_dir):
    s = swaps(spark, sf_dir).withColumn("moved", F.col("old_id") != F.col("new_id"))
    on = lambda c: F.count_if(F.col("moved") & c)
    new, old = F.col("new_hit"), F.col("old_hit")
    return s.agg(F.count(F.lit(1)).alias("races"), F.count_if("moved").alias("swaps"), on(new > old).alias("gains"), on(new < old).alias("losses"), on((new == 1) & (old == 1)).alias("both_hit"), on((new == 0) & (old == 0)).alias("both_miss"), F.sum(new - old).cast("long").alias("net"))


@query(f"""WITH {ENTRANTS}, {P1}, {AGENT.format(key="agent_id")}, {SWAPS}, t AS (SELECT sum(delta) AS t FROM k)
SELECT old_id <> new_id AS swapped, count(*) AS races, CAST(sum(n) AS BIGINT) AS rows, round(sum(delta), 6) AS delta, round(sum(delta) / any_value(t), 4) AS share, abs(sum(sum(delta)) OVER () - any_value(t)) < 1e-6 AS adds_back FROM k, t GROUP BY 1""")
def a15_error_contribution(spark, sf_dir):
    """Share of the loss change in contests with the same and with another top pick; the two must add back to the whole."""
    k = swaps(spark, sf_dir)
    s = k.groupBy((F.col("old_id") != F.col("new_id")).alias("swapped")).agg(F.count(F.lit(1)).alias("races"), F.sum("n").alias("rows"), F.sum("delta").alias("d"))
    t = k.agg(F.sum("delta").alias("t"))
    parts = F.sum("d").over(Window.partitionBy())  # two rows
    return s.crossJoin(F.broadcast(t)).select("swapped", "races", "rows", R("d", 6).alias("delta"), R(F.col("d") / F.col("t"), 4).alias("share"), (F.abs(parts - F.col("t")) < 1e-6).alias("adds_back"))


@query(f"""WITH {ENTRANTS}, {P1}, z AS (SELECT round(p, 9) AS s, label_win AS y FROM p), rk AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM z)
SELECT CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM rk""")
def a16_rank_auc(spark, sf_dir):
    p = base_rates(spark, sf_dir).select(F.round("p", 9).alias("s"), "label_win")
    return metrics.auc(p, "s", "label_win").select("positives", "negatives", R("auc", 6).alias("auc"))


@query(f"""WITH {ENTRANTS}, {P1} SELECT race_id, arg_min(horse_id, (-round(p, 12), horse_id)) AS horse_id, arg_min(label_win, (-round(p, 12), horse_id)) AS label_win FROM p GROUP BY race_id""")
def w15_top_pick(spark, sf_dir):
    p = base_rates(spark, sf_dir).withColumn("key", F.round("p", 12))
    return metrics.top_pick(p, "race_id", "horse_id", "key").select("race_id", "horse_id", "label_win")


@query(f"""WITH {ENTRANTS}, {P1}, t AS (SELECT race_id, year(day) AS y, day, count(*) AS n FROM p GROUP BY ALL) SELECT CAST(y AS INTEGER) AS year, count(DISTINCT day) AS days, count(*) AS races, CAST(sum(n) AS BIGINT) AS rows FROM t GROUP BY y""")
def a28_yearly_coverage(spark, sf_dir):
    t = entrants(spark, sf_dir).groupBy("race_id", F.year("day").alias("year"), "day").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("year").agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("races"), F.sum("n").alias("rows"))


#: Cutoffs, and the year after each that its counts are judged on.
CUTOFFS = {"validation": "1996-01-01", "reference": "1997-01-01"}
CUTOFF = f"""co AS (SELECT * FROM (VALUES {", ".join(f"('{k}', DATE '{d}')" for k, d in CUTOFFS.items())}) AS t(period, cut)),
gn AS (SELECT period, horse_id, count(*) AS n, sum(label_win) AS w FROM e JOIN co ON day < cut GROUP BY 1, 2), lo AS (SELECT period, horse_id, track, distance // 400 AS band, race_class, count(*) AS n, sum(label_win) AS w FROM e JOIN co ON day < cut GROUP BY ALL),
st AS (SELECT e.*, period, (coalesce(gn.w, 0) + 1) / (coalesce(gn.n, 0) + 12)::DOUBLE AS base, (coalesce(lo.w, 0) + 1) / (coalesce(lo.n, 0) + 12)::DOUBLE AS own, least(0.5, coalesce(lo.n, 0) / (coalesce(lo.n, 0) + 5)::DOUBLE) AS share
 FROM e JOIN co ON day >= cut AND day < cut + INTERVAL 1 YEAR LEFT JOIN gn USING (period, horse_id) LEFT JOIN lo ON lo.period = co.period AND lo.horse_id = e.horse_id AND lo.track = e.track AND lo.band = e.distance // 400 AND lo.race_class = e.race_class),
pq AS (SELECT *, base / sum(base) OVER w AS p, ((1 - share) * base + share * own) / sum((1 - share) * base + share * own) OVER w AS q FROM st WINDOW w AS (PARTITION BY period, race_id)),
rd AS (SELECT period, race_id, any_value(day) AS day, any_value(venue) AS venue, count(*) AS rows, round(sum({LOSS.format(p="q", y="label_win")} - ({LOSS.format(p="p", y="label_win")})), 9) AS dl, round(sum({BRIER.format(p="q", y="label_win")} - ({BRIER.format(p="p", y="label_win")})), 9) AS db FROM pq GROUP BY 1, 2)"""


def cutoff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per period and contest: rows, and the loss and Brier differences of the context model to the baseline, both counted before the cutoff only."""
    e = entrants(spark, sf_dir).withColumn("band", F.floor(F.col("distance") / 400))
    local = ["horse_id", "track", "band", "race_class"]
    y, out = F.col("label_win"), None
    for period, cut in CUTOFFS.items():
        before = e.where(F.col("day") < F.lit(cut).cast("date"))
        counts = lambda keys, p: before.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}n"), F.sum("label_win").alias(f"{p}w"))  # noqa: B023, E731
        later = e.where((F.col("day") >= F.lit(cut).cast("date")) & (F.col("day") < F.add_months(F.lit(cut).cast("date"), 12)))
        t = later.join(counts(["horse_id"], "g"), "horse_id", "left").join(counts(local, "c"), local, "left").fillna(0, ["gn", "gw", "cn", "cw"])
        base, own = history.smoothed(F.col("gw"), F.col("gn")), history.smoothed(F.col("cw"), F.col("cn"))
        share = F.least(F.lit(0.5), F.col("cn") / (F.col("cn") + 5))
        t = t.withColumns({"b": base, "m": (1 - share) * base + share * own})
        t = t.withColumns({"p": history.share(F.col("b"), "race_id"), "q": history.share(F.col("m"), "race_id")})
        loss, brier = metrics.log_loss(F.col("q"), y) - metrics.log_loss(F.col("p"), y), metrics.brier(F.col("q"), y) - metrics.brier(F.col("p"), y)
        pairs = t.groupBy("race_id").agg(F.first("day").alias("day"), F.first("venue").alias("venue"), F.count(F.lit(1)).alias("rows"), R(F.sum(loss), 9).alias("dl"), R(F.sum(brier), 9).alias("db")).withColumn("period", F.lit(period))
        out = pairs if out is None else out.union(pairs)
    return stored(out, "pairs")


@query(f"""WITH {ENTRANTS}, {CUTOFF}, gr AS (SELECT *, unnest(['overall', 'month', 'venue']) AS field, unnest(['all', strftime(day, '%m'), venue]) AS value FROM rd)
SELECT period, field, value, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS races, count(DISTINCT day) AS days, round(sum(dl) / sum(rows), 7) + 0.0 AS delta_logloss, round(sum(db) / sum(rows), 7) + 0.0 AS delta_brier FROM gr GROUP BY 1, 2, 3""")
def m39_fixed_cutoff(spark, sf_dir):
    """Counts from before a cutoff alone, candidate against baseline over the year after it: as a whole, by month and by venue."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in {"overall": F.lit("all"), "month": F.date_format("day", "MM"), "venue": F.col("venue")}.items()])
    g = cutoff_pairs(spark, sf_dir).withColumn("g", F.explode(fields)).groupBy("period", "g.field", "g.value")
    mean = lambda c: R(F.sum(c) / F.sum("rows"), 7) + 0.0
    return g.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("races"), F.count_distinct("day").alias("days"), mean("dl").alias("delta_logloss"), mean("db").alias("delta_brier"))


_U = "(('0x' || substr(md5('cutoff|' || rep || '|' || i), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"""WITH {ENTRANTS}, {CUTOFF}, un AS (SELECT period, 'day' AS kind, CAST(day AS VARCHAR) AS name, sum(rows) AS rows, sum(dl) AS dl, sum(db) AS db FROM rd GROUP BY 1, 3 UNION ALL SELECT period, 'race', lpad(CAST(race_id AS VARCHAR), 20, '0'), rows, dl, db FROM rd),
nu AS (SELECT *, row_number() OVER (PARTITION BY period, kind ORDER BY name) - 1 AS unit, count(*) OVER (PARTITION BY period, kind) AS units FROM un),
dr AS (SELECT period, kind, rep, CAST(floor({_U} * units) AS BIGINT) AS unit FROM (SELECT period, kind, unit AS i, units FROM nu), range(2000) AS g(rep)),
rt AS (SELECT period, kind, rep, sum(dl) / sum(rows) AS rl, sum(db) / sum(rows) AS rb FROM dr JOIN nu USING (period, kind, unit) GROUP BY 1, 2, 3),
iv AS (SELECT period, kind, metric, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM (SELECT period, kind, unnest(['logloss', 'brier']) AS metric, unnest([rl, rb]) AS r FROM rt) GROUP BY 1, 2, 3)
SELECT period, kind AS unit, metric, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, bool_and(kind <> 'day' OR round(high, 9) < 0) OVER () AS improved FROM iv""")
def m39_cutoff_decision(spark, sf_dir):
    """Intervals of both differences by resampled days and contests; improved if all by day lie below zero in both periods."""
    rd = cutoff_pairs(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("rows", "dl", "db")]
    units = rd.groupBy("period", F.lit("day").alias("kind"), F.col("day").cast("string").alias("name")).agg(*sums).union(rd.select("period", F.lit("race"), F.lpad(F.col("race_id").cast("string"), 20, "0"), "rows", "dl", "db"))
    by = ["period", "kind"]
    numbered = ordered.numbered(ordered.placed(units, by, ["name"], "units"), by).withColumn("unit", F.col("seq") - 1)
    numbered = numbered.join(F.broadcast(units.groupBy(*by).agg(F.count(F.lit(1)).alias("units"))), by)  # four rows
    reps = resample.bootstrap_many(numbered, ["dl", "db"], "rows", 2000, "cutoff", by)
    long = reps.select(*by, F.explode(F.array(F.struct(F.lit("logloss").alias("metric"), F.col("ratio_dl").alias("r")), F.struct(F.lit("brier").alias("metric"), F.col("ratio_db").alias("r")))).alias("x")).select(*by, "x.*")
    told = resample.interval(long, [*by, "metric"], "r")
    below = F.bool_and((F.col("kind") != "day") | (R("high", 9) < 0)).over(Window.partitionBy())  # eight rows
    return told.select("period", F.col("kind").alias("unit"), "metric", (R("low", 6) + 0.0).alias("low"), (R("high", 6) + 0.0).alias("high"), below.alias("improved"))


@query(f"""WITH {ENTRANTS}, {H1} SELECT horse_id, dn, count(*) AS n, CAST(sum(label_win) AS BIGINT) AS wins FROM e GROUP BY 1, 2""")
def m35_incremental_history(spark, sf_dir):
    """A base of daily sums and a delta that revises its last days: no day counts twice."""
    e = entrants(spark, sf_dir)
    wins = {"wins": F.col("label_win")}
    base = history.daily(e.where("dn <= 9500"), ["horse_id"], wins)
    delta = history.daily(e.where("dn > 9400"), ["horse_id"], wins)
    return history.refreshed(base, delta, ["horse_id"]).select("horse_id", "dn", "n", "wins")


FUTURE = "date_diff('day', DATE '1970-01-01', DATE '2001-01-01')"
_KNOWN = f"sum(CAST(dn < {FUTURE} AS INTEGER)) OVER {{w}} AS {{k}}, sum(CASE WHEN dn < {FUTURE} THEN label_win ELSE 0 END) OVER {{w}} AS {{v}}"


@query(f"""WITH {ENTRANTS}, k AS (SELECT race_id, horse_id, dn, {_KNOWN.format(w="h", k="hk", v="hw")}, {_KNOWN.format(w="g", k="ak", v="aw")} FROM e
 WINDOW h AS (PARTITION BY horse_id ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY agent_id ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
z AS (SELECT race_id, horse_id, (coalesce(hw, 0) + 1) / (coalesce(hk, 0) + 12.0) AS base, coalesce(ak, 0) AS ak, coalesce(aw, 0) AS aw FROM k WHERE dn >= {FUTURE}),
y AS (SELECT *, base * (1 - 0.25 * ak / (ak + 100.0)) + 0.25 * ak / (ak + 100.0) * (aw + 10) / (ak + 120.0) AS adj FROM z),
x AS (SELECT *, base / sum(base) OVER (PARTITION BY race_id) AS p, adj / sum(adj) OVER (PARTITION BY race_id) AS q FROM y)
SELECT race_id, horse_id, round(p, 6) AS base, round(q, 6) AS adjusted, round(pow(q, 2.3) / sum(pow(q, 2.3)) OVER (PARTITION BY race_id), 6) AS calibrated FROM x""")
def m36_future_scores(spark, sf_dir):
    """Contests after the history's last day, each by its own window of what is known: base, agent-adjusted and calibrated chances."""
    e = entrants(spark, sf_dir).select("race_id", "horse_id", "agent_id", "dn", "label_win")
    cut = F.unix_date(F.lit("2001-01-01").cast("date"))
    known = {"k": (F.col("dn") < cut).cast("int"), "w": F.when(F.col("dn") < cut, F.col("label_win")).otherwise(0)}
    z = history.history(history.history(e, ["horse_id"], known), ["agent_id"], known, prefix="a_").where(F.col("dn") >= cut)
    z = z.withColumn("b", history.smoothed(F.col("h_w"), F.col("h_k")))
    z = z.withColumns({"p": history.share(F.col("b"), "race_id"), "q": history.share(history.agent_blend(F.col("b"), F.col("a_w"), F.col("a_k"), 0.25), "race_id")})
    return z.select("race_id", "horse_id", R("p", 6).alias("base"), R("q", 6).alias("adjusted"), R(rankprob.tempered(F.col("q"), 2.3, "race_id"), 6).alias("calibrated"))


@query(f"""WITH {ENTRANTS}, early AS (SELECT race_id, horse_id, dn, label_win, year(day) AS y FROM e WHERE day < DATE '1998-01-01'),
st AS (SELECT race_id, horse_id, count(*) OVER w AS n, CAST(coalesce(sum(CASE WHEN race_id % 101 = 7 THEN 1 - label_win ELSE label_win END) OVER w, 0) AS BIGINT) AS wins FROM early WINDOW w AS (PARTITION BY horse_id ORDER BY dn RANGE BETWEEN 1095 PRECEDING AND 1 PRECEDING)),
{H1}, x AS (SELECT early.y, h.h_n = st.n AND h.h_wins = st.wins AS same FROM early JOIN h USING (race_id, horse_id) JOIN st USING (race_id, horse_id))
SELECT CAST(y AS INTEGER) AS year, count(*) AS rows, CAST(0 AS BIGINT) AS changed_by_later_years, count(*) FILTER (NOT same) AS revised FROM x GROUP BY 1""")
def m37_replay(spark, sf_dir):
    """Strengths replayed with the later years against those stored without them, and against stored ones with other results of some contests.

    Later years may change nothing (the SQL says so); a revised result must show in the days behind it.
    """
    e = entrants(spark, sf_dir).select("race_id", "horse_id", "dn", "day", "label_win")
    wins = {"wins": F.col("label_win")}
    early = e.where(F.col("day") < F.lit("1998-01-01").cast("date"))
    keep = lambda df, n, w: df.select("race_id", "horse_id", F.col("h_n").alias(n), F.col("h_wins").alias(w))
    stored = keep(history.history(early, ["horse_id"], wins), "n1", "w1")
    other = keep(history.history(early, ["horse_id"], {"wins": F.when(F.col("race_id") % 101 == 7, 1 - F.col("label_win")).otherwise(F.col("label_win"))}), "n2", "w2")
    again = history.history(e, ["horse_id"], wins).where(F.col("day") < F.lit("1998-01-01").cast("date"))
    x = again.join(stored, ["race_id", "horse_id"], "full").join(other, ["race_id", "horse_id"], "left")
    differs = lambda n, w: F.count_if(~(F.col("h_n").eqNullSafe(F.col(n)) & F.col("h_wins").eqNullSafe(F.col(w))))
    return x.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("rows"), differs("n1", "w1").alias("changed_by_later_years"), differs("n2", "w2").alias("revised"))


@query(f"WITH {CONTESTS} SELECT count(*) AS races, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, max(day) >= DATE '1998-08-01' AS fresh FROM c")
def p15_history_freshness(spark, sf_dir):
    c = contests(spark, sf_dir)
    return c.agg(F.count(F.lit(1)).alias("races"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), (F.max("day") >= F.lit("1998-08-01").cast("date")).alias("fresh"))

