"""Queries over whole tables whose faults, draws and merges the SQL alone does not show."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.operators import history, metrics, strategy
from rankflow.plans import model_queries, strategy_queries
from rankflow.registry import QUERIES, SQL

from .test_queries import SF, duck, rows, same  # noqa: F401


def test_no_query_reads_a_part_of_its_table():
    cuts = ("year(day) = 1998", "event_id < 100000", "l_orderkey % 10", "l_orderkey % 20", "race_id % 16")
    assert [(n, c) for n, sql in SQL.items() for c in cuts if c in sql] == []


def test_lineage_graph_past_event_100000(spark, tmp_path):
    data = [(99_999, 1, "view"), (100_000, 2, "purchase"), (2_000_000, 2, "view")]
    spark.createDataFrame(data, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["a24_lineage_graph"](spark, str(tmp_path)).collect() == [(6, 4)]


def test_every_contest_is_sampled_and_draws_follow_the_rank_model(spark):
    fields = {2: [0.5, 0.3, 0.2], 17: [0.9, 0.1], 2**40: [0.4, 0.3, 0.2, 0.1]}
    p = spark.createDataFrame([(r, h, x) for r, own in fields.items() for h, x in enumerate(own)], "race_id long, horse_id long, p double")
    got = {(r["race_id"], r["horse_id"]): (r["wins"], r["top3"]) for r in strategy_queries.sampled(p).collect()}
    assert got == {(r["race_id"], r["horse_id"]): (r["wins"], r["top3"]) for r in strategy_queries.sampled(p.repartition(3)).collect()}
    for race, own in fields.items():
        third = dict.fromkeys(range(len(own)), 0.0)
        for order in itertools.permutations(range(len(own)), min(3, len(own))):
            chance, left = 1.0, 1.0
            for i in order:
                chance, left = chance * own[i] / left, left - own[i]
            for i in order:
                third[i] += chance
        assert sum(got[race, h][0] for h in third) == 20_000
        for h, x in enumerate(own):
            assert got[race, h][0] / 20_000 == pytest.approx(x, abs=0.015)
            assert got[race, h][1] / 20_000 == pytest.approx(third[h], abs=0.015)


def test_outcomes_merge_months_as_one_walk_would(spark):
    pick = random.Random(8)
    bets = [(s, f"{1995 + m // 12}-{m % 12 + 1:02d}-{pick.randint(1, 28):02d}", pick.randint(1, 40), pick.choice((0.0, 0.0, 0.0, 90.0, 400.0))) for s in ("a", "b") for m in range(30) for _ in range(pick.choice((0, 1, 6)))]
    bets += [("lost", f"1996-0{m}-01", 1, 0.0) for m in range(1, 8)]
    df = spark.createDataFrame(bets, "strategy string, day string, race_id long, payout double").withColumn("day", F.to_date("day"))
    got = {r["strategy"]: r for r in strategy.outcomes(df).collect()}
    for name in ("a", "b", "lost"):
        races = {}
        for s, day, race, payout in bets:
            if s == name:
                races.setdefault((day, race), []).append(payout)
        equity = peak = drop = streak = longest = 0
        for key in sorted(races):
            equity += sum(races[key]) - 100 * len(races[key])
            peak = max(peak, equity)
            drop = max(drop, peak - equity)
            streak = 0 if any(races[key]) else streak + 1
            longest = max(longest, streak)
        assert (got[name]["races"], got[name]["losing_streak"]) == (len(races), longest)
        assert got[name]["max_drawdown"] == pytest.approx(drop) and got[name]["profit"] == pytest.approx(equity)


def test_contexts_equal_histories_and_keep_null_keys(spark):
    pick = random.Random(9)
    data = [(i, pick.choice((1, 2, None)), pick.choice(("x", "y", None)), pick.randint(0, 2000), pick.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, k long, c string, dn int, win int")
    got = {r["id"]: (r["a_n"], r["a_w"], r["b_n"], r["b_w"]) for r in history.contexts(df, "k", {"a_": [], "b_": ["c"]}, {"w": F.col("win")}).collect()}
    for i, k, c, dn, _ in data:
        own = [x for x in data if x[1] == k and dn - 1095 <= x[3] < dn]
        ctx = [x for x in own if x[2] == c]
        assert got[i] == (len(own), sum(x[4] for x in own), len(ctx), sum(x[4] for x in ctx))
    one = history.history(df, ["k", "c"], {"w": F.col("win")})
    assert {r["id"]: (r["h_n"], r["h_w"]) for r in one.collect()} == {i: v[2:] for i, v in got.items()}


def test_redundancy_by_ranks(spark):
    pick = np.random.default_rng(3)
    a = np.round(pick.normal(size=700), 1)
    data = [(float(x), None if i % 9 == 0 else float(np.round(-x + pick.normal() / 4, 1)), float(pick.integers(3)), 1.0 if i < 100 else None) for i, x in enumerate(a)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")

    def rank(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    both = [(x[0], x[1]) for x in data if x[1] is not None]
    want = abs(np.corrcoef(rank([x[0] for x in both]), rank([x[1] for x in both]))[0, 1])
    got = {r["feature"]: r["redundancy"] for r in metrics.redundancy(df, ["a", "d"], ["b", "c", "d"]).collect()}
    assert got["a"] == pytest.approx(max(want, abs(np.corrcoef(rank([x[0] for x in data]), rank([x[2] for x in data]))[0, 1])))
    assert got["d"] == 0.0  # fewer than 500 pairs


def test_search_resumes_until_the_space_is_done(spark, monkeypatch):
    trained = []

    def score(df, target, name, **settings):
        trained.append((target, name, settings["depth"], settings["trees"], settings["seed"]))
        return spark.createDataFrame([("SELECTION", 5, float(len(trained))), ("TEST", 1, 0.0)], "split string, rows long, logloss double")

    monkeypatch.setattr(model_queries, "_score", score)
    monkeypatch.setattr(model_queries, "prepared", lambda *_: None)
    assert len(model_queries.SPACE) == len(set(model_queries.SPACE)) == 162
    monkeypatch.setattr(model_queries, "SPACE", model_queries.SPACE[:5])
    want = sorted(model_queries.SPACE)
    got = QUERIES["m22_resumable_search"](spark, "").collect()
    assert trained == want and [tuple(r) for r in got] == [(*p, 5, i + 1.0) for i, p in enumerate(want)]
    trained.clear()
    half = spark.createDataFrame(got[:3], model_queries.LEDGER_SHAPE)
    assert model_queries.resume(spark, None, half).count() == 5 and trained == want[3:]


def test_search_trains_and_scores(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "SPACE", model_queries.SPACE[:3])
    got = QUERIES["m22_resumable_search"](spark, SF).collect()
    assert len(got) == 3 and all(r["rows"] > 0 and 0 < r["logloss"] < 1 for r in got)


def test_models_keep_their_promises(spark):
    t = QUERIES["m21_model_tournament"](spark, SF).collect()
    for target in {r["target"] for r in t}:
        own = {r["feature_set"]: r for r in t if r["target"] == target and r["split"] == "SELECTION"}
        if own:
            champions = {r["feature_set"] for r in t if r["target"] == target and r["champion"]}
            assert len(champions) == 1 and own[champions.pop()]["logloss"] == min(r["logloss"] for r in own.values())
    p = QUERIES["m27_isotonic_predictions"](spark, SF).collect()
    assert p and all(0 <= r["win"] <= r["top2"] <= r["top3"] <= 1 and r["split"] in ("TEST", "OOS") for r in p)
    s = QUERIES["m25_specialist"](spark, SF).collect()
    assert len(s) == 3 and {r["decision"] for r in s} <= {"PROMOTE", "REJECT"} and len({r["decision"] for r in s}) == 1
