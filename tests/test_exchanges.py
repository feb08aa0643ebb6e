"""What moves between tasks, and how much of it one task gets."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankflow.operators import history, metrics, resample, strategy
from rankflow.plans import feature_queries, rating_queries, strategy_queries  # noqa: F401
from rankflow.registry import QUERIES
from rankflow.sources import bindings

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_lines(spark, monkeypatch):
    monkeypatch.setattr(bindings, "TASK_ROWS", 100)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert bindings.tasks(spark, SF) == -(-rows // 100) > spark.sparkContext.defaultParallelism
    assert f"hashpartitioning(race_id#0, {-(-rows // 100)})" in re.sub(r"race_id#\d+L?", "race_id#0", plan(bindings.entrants(spark, SF).select("race_id", "finish")))


def test_lines_move_once_and_parts_only_for_agents(spark):
    told = plan(bindings.entrants(spark, SF).select("race_id", "horse_id", "finish", "label_win"))
    assert told.count("hashpartitioning(race_id") == 1  # lines; orders are small here
    assert "p_brand" not in told
    assert "p_brand" in plan(bindings.entrants(spark, SF).select("race_id", "agent_id"))


def test_running_sums_equal_sliding_frames(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(400)).cast("int")).alias("dn"), (F.col("id") % 3).alias("v"))
    sums = history.daily(df, ["k"], {"v": F.col("v")})
    frame = Window.partitionBy("k").orderBy("dn").rangeBetween(-30, -1)
    want = sums.select("k", "dn", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(f"h_{c}") for c in ("n", "v")])
    got = history.running(sums, ["k"], ["n", "v"], 30, "dn", "h_").select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "rangeframe, -30" not in plan(history.history(df, ["k"], {"v": F.col("v")}, days=30)).lower()


def test_redundancy_moves_rows_by_value_and_not_by_pair(spark):
    pick = np.random.default_rng(5)
    names = ["a", "b", "c", "d"]
    data = [tuple(None if pick.random() < 0.2 else float(x) for x in row) for row in np.round(pick.normal(size=(900, 4)) @ pick.normal(size=(4, 4)), 1)]
    told = metrics.redundancy(spark.createDataFrame(data, ", ".join(f"{c} double" for c in names)), ["a", "b"], ["b", "c", "d"])
    assert "hashpartitioning(feature" not in plan(told)

    def rho(i, j):
        both = np.array([(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None])
        ranks = [[(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v] for v in both.T]
        return abs(np.corrcoef(*ranks)[0, 1])

    want = {"a": max(rho(0, j) for j in (1, 2, 3)), "b": max(rho(1, j) for j in (2, 3))}
    assert {r["feature"]: r["redundancy"] for r in told.collect()} == pytest.approx(want)


def test_configurations_of_evidence_move_no_rows(spark):
    e = spark.createDataFrame([(100, 1, 2, 0.1, [None, 2.0]), (100, 2, 1, 0.2, [0.5, None]), (100, 3, 3, 0.2, None), (200, 4, 1, 0.3, [1.5, 1.5]), (200, 5, 2, 0.3, [1.5, 1.5])], "race_id long, race_row long, finish int, base double, m array<double>")
    told = metrics.factor_differences(e, "race_id", "race_row", "finish", "base", "m", F.floor(F.col("race_id") / 100).alias("block"), 2)
    assert plan(told).count("hashpartitioning(race_id") == 1 and "Generate" not in plan(told)
    ways = e.select("race_id", "race_row", "finish", F.posexplode(F.array(F.lit(1.0), *[F.coalesce(F.get("m", F.lit(i)), F.lit(1.0)) for i in (0, 1)])).alias("way", "x"), "base").withColumn("s", F.col("base") * F.col("x"))
    p = ways.select((F.col("race_id") * 3 + F.col("way")).alias("race_id"), F.col("race_row").alias("horse_id"), "finish", (F.col("s") / F.sum("s").over(Window.partitionBy("race_id", "way"))).alias("p"))
    one = {(r["race_id"] // 3, r["race_id"] % 3, r["k"]): r for r in rating_queries.three_losses(p).collect()}
    got = {(r["block"] * 100, r["i"] + 1, r["k"]): r for r in told.collect()}
    assert set(got) == {key for key in one if key[1]}
    for (race, way, k), r in got.items():
        a, b = one[race, way, k], one[race, 0, k]
        assert (r["rows"], r["dh"]) == (a["rows"], a["hit"] - b["hit"])
        assert [r["l"], r["dl"], r["db"]] == pytest.approx([a["logloss"], a["logloss"] - b["logloss"], a["brier"] - b["brier"]], abs=1e-9)


def test_evidence_moves_once_per_entrant(spark):
    told = plan(feature_queries.multipliers(feature_queries.evidence_keys(spark, SF)))
    assert len(re.findall(r"hashpartitioning\(race_row|hashpartitioning\([^)]*(?:source|days|feature)", told)) == 0


def test_sign_flips_are_dealt_by_draw(spark):
    blocks = spark.createDataFrame([(t, b, (b - 3.2 - t) / 7) for t in (0, 1) for b in range(6)], "t int, block long, delta double")
    told = resample.sign_flips(blocks, "delta", "block", 500, "seed", ["t"])
    moved = re.findall(r"hashpartitioning\(([a-z_]+)[^)]*\)", re.sub(r"#\d+L?", "", plan(told)))
    assert moved.count("draw") == 1 and set(moved) <= {"draw", "block", "t"}
    sign = lambda draw, b: -1 if int(hashlib.md5(f"seed|{draw}|{b}".encode()).hexdigest()[:13], 16) / (1 << 52) < 0.5 else 1
    for r in told.collect():
        deltas = [(b - 3.2 - r["t"]) / 7 for b in range(6)]
        low = sum(sum(sign(draw, b) * x for b, x in enumerate(deltas)) <= sum(deltas) + 1e-12 for draw in range(500))
        assert r["p"] == pytest.approx(1.0 if sum(deltas) >= 0 else (low + 1) / 501)


@pytest.mark.parametrize(
    "name",
    ["j09_market_join", "m32_failure_analysis", "m28_ticket_probabilities", "m30_finish_positions", "j11_payout_completeness", "j18_omitted_opportunities", "m30_simulation_error", "m11_calibration_comparison", "m30_source_error"],
)
def test_what_a_contest_makes_stays_in_its_row(spark, name):
    moved = lambda df: re.findall(r"hashpartitioning\((?:race_id|ticket_type|horse_id)[^)]*\)", re.sub(r"#\d+L?", "", plan(df)))
    alone = moved(rating_queries.base_rates(spark, SF).select("race_id", "horse_id", "p"))
    assert len(moved(QUERIES[name](spark, SF))) == len(alone)


def test_sides_meet_in_the_row_as_in_a_join(spark):
    fair = [(1, [("WIN", "7", 0.25, 4.0), ("TOP2", "7", 0.5, 2.0)]), (2, [("WIN", "7", 0.0, None)]), (3, [])]
    market = {1: [("WIN", "7", 5.0), ("WIN", "7", 6.0), ("TOP3", "7", 5.0), ("WIN", "8", 5.0)], 2: [("WIN", "7", 3.0)], 3: [("WIN", "7", 3.0)]}
    shape = "race_id long, fair array<struct<ticket_type:string,selection:string,probability:double,fair_odds:double>>, market array<struct<ticket_type:string,selection:string,market_odds:double>>"
    rows = spark.createDataFrame([(r, f, market[r]) for r, f in fair], shape)
    got = {tuple(r) for r in strategy.market_met(rows).select("race_id", "ticket_type", "selection", "market_odds", "ev", "edge_ratio").collect()}
    assert got == {(1, "WIN", "7", 5.0, 0.25, 0.25), (1, "WIN", "7", 6.0, 0.5, 0.5), (2, "WIN", "7", 3.0, -1.0, None)}


def test_power_calibration_leaves_out_dead_heats(spark):
    e = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 1, 0.3), (1, 3, 3, 0.2), (2, 4, 1, 0.6), (2, 5, 2, 0.4)], "race_id long, horse_id long, finish int, p double")
    got = {(r["stage"], r["k"]): r for r in metrics.power_calibration(e, "race_id", "horse_id", "finish", "p", [1.0, 2.0], [10]).collect()}
    assert got[0, 1]["logloss"] == pytest.approx(-np.log(0.6)) and got[0, 1]["ece10"] == pytest.approx(0.4)  # the second contest alone
    assert got[1, 1]["brier"] == pytest.approx((0.16 / 0.52) ** 2) and got[0, 1]["hit_rate"] == 1.0
    assert got[0, 2]["hit_rate"] == 1.0 and len(got) == 6
