"""Thresholds, ties and sums that must not hang on the last digits or on the order of rows."""

import contextlib
import io
import itertools
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.operators import metrics, rankprob, strategy
from rankflow.plans import source_queries, strategy_queries
from rankflow.sources import bindings

from .test_queries import SF, duck  # noqa: F401


def test_unaltered_parts_keep_their_bytes_however_rows_come(spark, monkeypatch):
    def mixed(spark, sf_dir, name):  # in another order each time it is read
        rows = bindings.table(spark, sf_dir, name).select("o_orderkey", "o_totalprice")
        return rows.mapInPandas(lambda batches: (b.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "big")) for b in batches), rows.schema)

    monkeypatch.setattr(source_queries, "table", mixed)
    got = {r["part"]: r["status"] for r in source_queries.s13_part_manifest(spark, SF).collect()}
    assert got == {0: "OK", 1: "ALTERED", 2: "OK", 3: "UNLISTED", 4: "OK", 5: "ALTERED", 6: "OK", 7: "OK", 8: "MISSING"}


def test_calibration_bins_do_not_hang_on_last_digits(spark):
    df = spark.createDataFrame([(0.29999999999999993, 1), (0.30000000000000004, 0), (0.2999, 0)], "p double, y int")
    assert {r["bin"]: r["rows"] for r in metrics.calibration(df, "p", "y", 10).where("rows > 0").collect()} == {2: 1, 3: 2}


def test_shape_takes_favourites_at_the_threshold(spark):
    p = spark.createDataFrame([(1, 0.3499999999999999), (1, 0.1500000000000001), *[(1, 0.125)] * 4, (2, 0.3), (2, 0.2499999999999999), *[(2, 0.09)] * 5], "race_id long, p double")
    assert {r["race_id"]: r["shape"] for r in strategy.shape(p, "race_id", "p").collect()} == {1: "FAVOURITE", 2: "TWO_HORSE"}


def test_profiles_and_their_sql_take_tickets_at_the_threshold(spark):
    offers = [(1, "WIN", "a", 0.25, 4.08, 0.25 * 4.08 - 1), (1, "WIN", "b", 0.25, 4.08, 0.0199999999999998), (1, "WIN", "c", 0.25, 4.08, 0.0200000000000002), (1, "WIN", "d", 0.25, 4.0, 0.01)]
    shape = "race_id long, ticket_type string, selection string, probability double, odds double, ev double"
    own = spark.createDataFrame(offers, shape).withColumns({"ev": F.round("ev", 9), "probability": F.round("probability", 9)})
    got = sorted((r["strategy"], r["selection"]) for r in strategy.profiles(own).collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE ev (race_id BIGINT, ticket_type VARCHAR, selection VARCHAR, probability DOUBLE, odds DOUBLE, ev DOUBLE)")
    c.executemany("INSERT INTO ev VALUES (?, ?, ?, ?, ?, ?)", offers)
    assert sorted(c.sql(f"WITH {strategy_queries.CHOSEN} SELECT strategy, selection FROM pf").fetchall()) == got
    assert [s for k, s in got if k == "TOP_3"] == ["a", "b", "c"]


def test_omitted_tickets_at_the_threshold_count(spark, monkeypatch):
    offers = [(1, "WIN", "a", 0.0999999999999998), (1, "WIN", "b", 0.1000000000000002), (1, "WIN", "c", 0.09), (1, "WIN", "d", 0.3)]
    m = spark.createDataFrame(offers, "race_id long, ticket_type string, selection string, ev double")
    monkeypatch.setattr(strategy_queries, "market", lambda spark, sf_dir: m)
    monkeypatch.setattr(strategy_queries, "chosen", lambda spark, sf_dir: m.where("selection = 'd'"))
    assert sorted(r["selection"] for r in strategy_queries.omitted(spark, SF).collect()) == ["a", "b"]


@pytest.mark.parametrize("column", ["prior_avg_finish_pct", "recent3_finish_pct_mean", "recent5_finish_pct_mean"])
def test_prior_form_is_the_same_to_the_last_digit(spark, duck, column):  # noqa: F811
    got = bindings.feature_base(spark, SF).select("race_id", "horse_id", column).collect()
    want = duck.sql(f"WITH {bindings.FEATURE_BASE} SELECT race_id, horse_id, {column} FROM f").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_gaps_are_the_same_to_the_last_digit(spark, duck):  # noqa: F811
    got = bindings.feature_base(spark, SF).select("race_id", "horse_id", "gap").collect()
    want = duck.sql(f"WITH {bindings.FEATURE_BASE} SELECT race_id, horse_id, gap FROM f").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_draws_of_a_contest_cost_no_more_the_more_there_are():
    p = np.array([0.4, 0.3, 0.2, 0.1])
    wins, top3 = strategy_queries.drawn(np.random.Generator(np.random.Philox(key=5)), p, 10**9)
    last = [sum(p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b]) for a, b, c in itertools.permutations(set(range(4)) - {d}, 3)) for d in range(4)]
    assert (wins.sum(), top3.sum()) == (10**9, 3 * 10**9)
    assert wins / 1e9 == pytest.approx(p, abs=1e-4)
    assert top3 / 1e9 == pytest.approx(1 - np.array(last), abs=1e-4)


def test_tickets_are_pooled_within_the_row(spark):
    fields = {3: [0.6, 0.4], 4: [0.5, 0.3, 0.2], 9: [0.2, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1, 0.1]}
    p = spark.createDataFrame([(r, 7 * h + 1, x) for r, own in fields.items() for h, x in enumerate(own)], "race_id long, horse_id long, p double")
    told = rankprob.tickets(p, types=("WIN", "TOP2", "TOP3", "QUINELLA", "FRAME", "WIDE", "TRIO"))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        told.explain()
    assert not re.search(r"Aggregate\(keys=\[[^\]]*type", plan.getvalue())  # no task keeps tickets of many contests
    want = {}
    for race, own in fields.items():
        ids, n = [7 * h + 1 for h in range(len(own))], len(own)
        for x in itertools.permutations(range(n), min(3, n)):
            chance, left = 1.0, 1.0
            for i in x:
                chance, left = chance * own[i] / left if left > 1e-12 else chance, left - own[i]
            text = lambda *y: "-".join(sorted(str(ids[i]) for i in y))  # noqa: B023, E731
            a, b = x[:2]
            hit = [("WIN", text(a)), *[("TOP2", text(i)) for i in (a, b)], *[("TOP3", text(i)) for i in x], ("QUINELLA", text(a, b)), ("FRAME", "-".join(map(str, sorted(ids[i] % 8 + 1 for i in (a, b))))), ("WIDE_PROXY" if n < 4 else "WIDE", text(a, b))]
            hit += [("WIDE", text(i, x[2])) for i in (a, b) if n >= 8] + ([("TRIO", text(*x))] if n > 2 else [])
            for h in hit:
                want[race, *h] = want.get((race, *h), 0.0) + chance
    assert {tuple(r)[:3]: r["probability"] for r in told.collect()} == pytest.approx(want)


def test_shares_on_a_tie_do_not_hang_on_the_order_of_entrants(spark):
    rows = [(1201, 86, 3, 6), (1201, 19, 15, 83), (1201, 93, 2, 7), (1201, 37, 2, 3)]  # 93 has 0.2109375, 37 has 0.2671875
    for order in ((0, 1, 2, 3), (1, 2, 3, 0)):
        c = spark.createDataFrame([(*rows[i], *rows[i][2:]) for i in order], "race_id long, horse_id long, a_wins long, a_n long, b_wins long, b_n long").coalesce(1)
        got = {r["horse_id"]: (r["champion"], r["specialist"], r["score"]) for r in source_queries.aligned(c).collect()}
        assert got == {86: (0.296875,) * 3, 19: (0.225,) * 3, 93: (0.210938,) * 3, 37: (0.267188,) * 3}
