"""Operators on hand-made and generated micro tables, against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rankflow.functions import scalars
from rankflow.operators import canonical, gates, history, metrics, ordered, pit, rankprob, resample, sketches, strategy
from rankflow.operators.features import row_mean
from rankflow.plans.source_queries import scratch
from rankflow.streaming import jobs


def test_history_excludes_today_and_old_days(spark):
    pick = random.Random(1)
    rows = [(i, pick.choice("ab"), pick.randint(0, 60), pick.randint(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, key string, dn int, win int")
    got = {r["id"]: (r["h_n"], r["h_w"]) for r in history.history(df, ["key"], {"w": F.col("win")}, days=20).collect()}
    for i, k, d, _ in rows:
        past = [w for _, kk, dd, w in rows if kk == k and d - 20 <= dd < d]
        assert got[i] == (len(past), sum(past))


def test_swapping_todays_outcomes_changes_nothing_today(spark):
    rows = [(1, "a", 1, 1), (2, "b", 1, 0), (3, "a", 2, 0), (4, "b", 2, 1)]
    swapped = [(i, k, d, 1 - w if d == 2 else w) for i, k, d, w in rows]
    out = []
    for data in (rows, swapped):
        df = spark.createDataFrame(data, "id long, key string, dn int, win int")
        out.append({r["id"]: r["h_w"] for r in history.history(df, ["key"], {"w": F.col("win")}).collect()})
    assert out[0] == out[1] == {1: 0, 2: 0, 3: 1, 4: 0}


def test_decay(spark):
    df = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 10, 1), (3, "a", 20, 0)], "id long, key string, dn int, win int")
    got = {r["id"]: r["d_w"] for r in history.decayed(df, ["key"], {"w": F.col("win")}, 10.0, 10).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(0.5) and got[3] == pytest.approx(0.75)


@pytest.mark.parametrize("size", [1, 2, 3, 6])
def test_marginals_by_permutations(spark, size):
    pick = random.Random(size)
    w = [pick.random() + 0.05 for _ in range(size)]
    p = [x / sum(w) for x in w]
    want = [[0.0] * 3 for _ in p]
    for order in itertools.permutations(range(size)):
        left, q = 1.0, 1.0
        for i in order:
            q, left = q * p[i] / left if left > 1e-12 else q, left - p[i]
        for place, i in enumerate(order[:3]):
            for k in range(place, 3):
                want[i][k] += q
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(p)], "race_id long, horse_id long, p double")
    for r in rankprob.marginals(df).collect():
        assert [r["p_win"], r["p_top2"], r["p_top3"]] == pytest.approx(want[r["horse_id"]], abs=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 6])
def test_positions_by_permutations(spark, size):
    pick = random.Random(size)
    w = [pick.choice([0.001, 0.2, 1.0, 30.0]) * (pick.random() + 0.1) for _ in range(size)]
    want = [[0.0] * size for _ in w]
    for order in itertools.permutations(range(size)):
        left, q = sum(w), 1.0
        for i in order:
            q, left = q * w[i] / left, left - w[i]
        for place, i in enumerate(order):
            want[i][place] += q
    df = spark.createDataFrame([(r, i, x) for r in ("a", "b") for i, x in enumerate(w)] + [("c", 0, 0.3), ("c", 1, 0.1)], "race_id string, horse_id int, p double")
    got = {(r["race_id"], r["horse_id"], r["position"]): r["probability"] for r in rankprob.positions(df).collect()}
    assert len(got) == 2 * size * size + 4 and got["c", 0, 1] == pytest.approx(0.75, abs=1e-12)
    for r in ("a", "b"):
        for i in range(size):
            assert [got[r, i, k + 1] for k in range(size)] == pytest.approx(want[i], abs=1e-10)


def test_positions_of_a_large_field_sum_to_one_both_ways():
    import numpy as np

    table = rankprob.field_positions(np.random.default_rng(2).dirichlet([0.3] * 18, 5) + 1e-6)
    assert abs(table.sum(axis=1) - 1).max() < 1e-9 and abs(table.sum(axis=2) - 1).max() < 1e-9


def test_ensemble_weight_comes_from_selection_alone(spark):
    pick = random.Random(8)
    rows = [(d, s, pick.random(), pick.random(), pick.randint(0, 1)) for d in ("JRA", "NAR") for s in ("SELECTION", "TEST", "OOS") for _ in range(120)] + [("FEW", "SELECTION", 0.5, 0.5, 1)] * 9
    columns = "domain string, split string, c double, s double, y int"
    member = {"y": (F.col("c"), F.col("s"), F.col("y"))}
    got = {r["domain"]: r for r in strategy.ensemble(spark.createDataFrame(rows, columns), "domain", "split", member).collect()}
    mean = lambda d, part, w: sum(-math.log(q if y else 1 - q) for dd, p, c, s, y in rows if (dd, p) == (d, part) for q in [w * s + (1 - w) * c]) / 120
    assert set(got) == {"JRA", "NAR"}
    for d, r in got.items():
        best = min(range(21), key=lambda i: (round(mean(d, "SELECTION", i / 20), 10), i)) / 20
        assert r["weight"] == best and r["oos_logloss"] == pytest.approx(mean(d, "OOS", best)) and r["test_special"] == pytest.approx(mean(d, "TEST", 1.0))
    turned = [(d, s, c, p, 1 - y if s != "SELECTION" else y) for d, s, c, p, y in rows]
    assert {r["domain"]: r["weight"] for r in strategy.ensemble(spark.createDataFrame(turned, columns), "domain", "split", member).collect()} == {d: r["weight"] for d, r in got.items()}


def test_tickets_add_up(spark):
    p = [0.4, 0.3, 0.2, 0.1]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(p)] + [(2, 0, 0.5), (2, 1, 0.5)], "race_id long, horse_id long, p double")
    sums = {(r["race_id"], r["ticket_type"]): r["s"] for r in rankprob.tickets(df).groupBy("race_id", "ticket_type").agg(F.sum("probability").alias("s")).collect()}
    for k, v in {"WIN": 1, "TOP2": 2, "TOP3": 3, "EXACTA": 1, "QUINELLA": 1, "WIDE": 1, "FRAME": 1, "TRIO": 1, "TRIFECTA": 1}.items():
        assert sums[1, k] == pytest.approx(v)
    assert (2, "TRIO") not in sums and sums[2, "WIDE_PROXY"] == pytest.approx(1) and sums[2, "TOP3"] == pytest.approx(2)


def test_auc_by_pairs(spark):
    pick = random.Random(3)
    rows = [(round(pick.random(), 1), pick.randint(0, 1)) for _ in range(80)]
    got = metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_three_targets_skip_boundary_ties(spark):
    rows = [(1, i, f, 0.25, 0.5, 0.75) for i, f in enumerate((1, 1, 3, 4))]
    df = spark.createDataFrame(rows, "race_id int, horse_id int, finish int, a double, b double, c double")
    got = {r["k"]: r["positives"] for r in metrics.three_targets(df, "race_id", "horse_id", "finish", ["a", "b", "c"]).collect()}
    assert got == {2: 2, 3: 3}


def test_calibration_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 0), (0.95, 1), (1.0, 1)], "p double, y int")
    t = metrics.calibration(df, "p", "y", 10)
    assert [r["rows"] for r in t.orderBy("bin").collect()] == [1] + [0] * 8 + [2]
    assert metrics.ece(t).first()["ece"] == pytest.approx((0.05 + 2 * 0.025) / 3)


def test_bootstrap_and_holm_repeat(spark):
    units = resample.numbered(spark.createDataFrame([(i, float(i % 5 - 2), 1.0) for i in range(30)], "block int, d double, n double"), ["block"])
    a, b = (sorted(r["ratio"] for r in resample.bootstrap(units, "d", "n", 50, "s").collect()) for _ in range(2))
    assert a == b and len(set(a)) > 10 and abs(sum(a) / 50) < 0.5
    h = resample.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double"), "p", ["t"])
    assert {r["t"]: round(r["p_holm"], 6) for r in h.collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_evidence_window_and_creation(spark):
    rows = spark.createDataFrame([(1, "x", 100)], "row int, key string, dn int")
    seen = spark.createDataFrame([("x", 86, 90, 1), ("x", 85, 86, 2), ("x", 99, 99, 3), ("x", 99, 100, 4), ("x", 100, 99, 5), ("y", 95, 95, 6)], "key string, wd int, created int, id int")
    assert sorted(r["id"] for r in pit.evidence(rows, seen, "key", 14).collect()) == [1, 3]


def test_quartile_shares_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, 9.0)], "race int, v double")
    assert sorted(r["q"] for r in df.select(pit.quartile(F.col("v"), "race").alias("q")).collect()) == [0, 0, 2, 3]


def test_classify_merge_and_versions(spark):
    shape = "id string, v int"
    base = spark.createDataFrame([("a", 1), ("b", 2)], shape)
    staged = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], shape)
    assert {r["id"]: r["kind"] for r in canonical.classified(staged, base, "id", ["v"]).collect()} == {"a": "duplicate", "b": "conflict", "c": "new"}
    merged = canonical.merged([base, staged], "id")
    assert {r["id"]: r["v"] for r in merged.collect()} == {"a": 1, "b": 2, "c": None}

    def check(df):
        if df.where("id is null").count():
            raise ValueError("null key")

    v = canonical.VersionedTable(spark, scratch(spark, "test-versions"), check)
    with pytest.raises(LookupError):
        v.read()
    v.publish(base, "v1")
    v.publish(merged, "v2")
    assert v.read().count() == 3
    with pytest.raises(ValueError, match="null key"):
        v.publish(spark.createDataFrame([(None, 1)], shape), "v3")
    assert v.current() == "v2"
    v.point("v1")
    assert v.read().count() == 2


def test_of_two_publishers_one_wins(spark):
    shape = "id string, v int"
    base = spark.createDataFrame([("a", 1), ("b", 2)], shape)
    root = scratch(spark, "test-race")
    one, two = canonical.VersionedTable(spark, root), canonical.VersionedTable(spark, root)
    one.publish(base, "v1")
    seen = two.pointer()[0]
    one.publish(base, "v2")
    with pytest.raises(canonical.Conflict):
        two.publish(base, "v3", seen)
    assert two.current() == "v2" and two.pointer()[0] == 2
    with pytest.raises(ValueError, match="fewer rows"):
        two.publish(base.limit(1), "v4")
    one._fs.create(one._path(f"{root}/pointer/{3:012d}"), False).close()  # a publisher that ended before it named its version
    assert two.current() == "v2"
    more = spark.createDataFrame([("b", 9), ("c", 3)], shape)
    got = canonical.publish_merge(two, [more], "id", "v5")
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 3)} and one.pointer() == (4, "v5")
    one.point("v1")
    assert two.read().count() == 2


def test_ordered_columns_of_a_key_with_most_rows(spark):
    pick = random.Random(4)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else pick.choice("abc"), pick.choice([None, *range(50)]), i, pick.randint(-3, 9)) for i in range(2000)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, t int, i int, x int").repartition(7)
        p = ordered.placed(df, ["k"], ["t", "i"])
        assert p.where("k = 'hot'").select("__piece").distinct().count() > 4
        told = ordered.sums_before(ordered.previous(ordered.numbered(p, ["k"]), ["k"], {"before": "x", "t0": "t"}), ["k"], {"sum": "x"})
        got = {r["i"]: (r["seq"], r["before"], r["t0"], r["sum"]) for r in told.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want, state = {}, {}
    for k, t, i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        n, bx, bt, s = state.get(k, (0, None, None, 0))
        want[i] = (n + 1, bx, bt, s)
        state[k] = (n + 1, x, t, s + x)
    assert got == want


def test_auc_with_an_outlier_and_nulls(spark):
    pick = random.Random(5)
    rows = [(pick.choice([1e300, -1e300, None, *[pick.random() for _ in range(5)]]), pick.randint(0, 1)) for _ in range(300)]
    got = metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y and s is not None], [s for s, y in rows if not y and s is not None]
    assert got["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_sketches_merge_and_stay_within_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 20_011).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("b"))
    kept = sketches.sketched(df, ["a", "b"], ["part"])
    both = sketches.estimates(sketches.merged(kept, ["a", "b"]), ["a", "b"]).first()
    assert abs(both["a"] - 20_011) <= sketches.bound() * 20_011 and abs(both["b"] - 30_000) <= sketches.bound() * 30_000
    halves = sketches.merged(sketches.sketched(df.where("part < 3"), ["a"]).union(sketches.sketched(df.where("part >= 3"), ["a"])), ["a"])
    assert sketches.estimates(halves, ["a"]).first()["a"] == pytest.approx(sketches.estimates(sketches.sketched(df, ["a"]), ["a"]).first()["a"], rel=0.02)
    assert "Expand" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sketches.estimates(sketches.sketched(df.limit(0), ["a"]), ["a"]).first()["a"] == 0


def test_result_blind_and_refresh_gates(spark):
    shape = "race_id long, horse_id long, p1 double, p2 double, p3 double, frame int"
    good = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.3, 1), (1, 2, 0.1, 0.2, 0.3, 8)], shape)
    assert gates.result_blind(good, ["race_id", "horse_id"], ("p1", "p2", "p3"), "frame").first()["status"] == "PASS"
    with pytest.raises(ValueError, match="outcome"):
        gates.result_blind(good.withColumn("FINISH", F.lit(1)), ["race_id"], ("p1", "p2", "p3"), "frame")
    with pytest.raises(ValueError, match="p3"):
        gates.result_blind(good.drop("p3"), ["race_id"], ("p1", "p2", "p3"), "frame")
    r = gates.result_blind(good.union(good.limit(1)), ["race_id", "horse_id"], ("p1", "p2", "p3"), "frame").first()
    assert (r["duplicate_key"], r["status"]) == (2, "BLOCKED")
    c = spark.createDataFrame([(1, "2024-01-02", "2024-01-02"), (2, "2024-01-03", "2024-01-03")], "race_id long, day string, created string").selectExpr("race_id", "date(day) day", "date(created) created")
    h = c.selectExpr("race_id", "race_id + 1 horse_id", "day", "created")
    assert gates.refresh(c, h, "2024-01-01", "2024-01-31", "2024-02-01").first()["status"] == "PASS"
    assert gates.refresh(c, h, "2024-01-01", "2024-01-31", "2024-01-31").first()["status"] == "BLOCKED"
    r = gates.refresh(c.union(c.where("race_id = 1")), h.where("race_id = 1").union(h.where("race_id = 1").selectExpr("9L", "1L", "date'2030-01-01'", "date'2030-01-01'")), "2024-01-01", "2024-01-31", "2024-02-01").first()
    assert (r["repeated_conditions"], r["repeated_runners"], r["without_runners"], r["without_conditions"], r["outside_interval"], r["future_dated"]) == (1, 0, 1, 1, 1, 1)


def test_projection_fails_on_missing_targets(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert canonical.project(df, ["a", "b"], {"a": "x"}, {"b": "z"}).first().asDict() == {"a": 1, "b": "z"}
    with pytest.raises(ValueError, match="b"):
        canonical.project(df, ["a", "b"], {"a": "x"})


def test_gates(spark):
    df = spark.createDataFrame([(1, " jra "), (None, "2.0"), (3, "x")], "k int, d string")
    assert gates.violations(df, {"null_k": F.col("k").isNull()}).first()["status"] == "BLOCKED"
    good, bad = gates.split(df, {"null_k": F.col("k").isNull()})
    assert good.count() == 2 and bad.first()["issues"] == ["null_k"]
    assert [r[0] for r in df.select(gates.domain(F.col("d"))).collect()] == ["JRA", "NAR", None]
    with pytest.raises(ValueError, match="missing"):
        gates.segment(df, {"missing": ["x"]})
    with pytest.raises(ValueError, match="d"):
        gates.segment(df, {"d": []})


def test_before_start_boundaries(spark):
    cases = [("1200", "2026-01-01 11:59:59", True), ("1200", "2026-01-01 12:00:00", False), ("0000", "2026-01-01 11:00:00", False)]
    df = spark.createDataFrame([(c, n) for c, n, _ in cases], "clock string, now string").withColumn("now", F.to_timestamp("now"))
    ok = gates.before_start(F.lit("20260101"), F.col("clock"), F.col("now") - F.expr("INTERVAL 1 HOUR"), F.col("now"))
    assert [r[0] for r in df.select(ok).collect()] == [x for _, _, x in cases]
    old = gates.before_start(F.lit("20260103"), F.lit("1200"), F.col("now") - F.expr("INTERVAL 25 HOURS"), F.col("now"))
    ahead = gates.before_start(F.lit("20260103"), F.lit("1200"), F.col("now") + F.expr("INTERVAL 1 SECOND"), F.col("now"))
    assert not any(r[0] or r[1] for r in df.select(old, ahead).collect())


def test_partition_descriptor(spark):
    df = spark.createDataFrame([("2026-10-04", "1"), ("20240701", "2"), (None, "99")], "d string, c string")
    got = [tuple(r) for r in df.select(scalars.year_partition(F.col("d")), scalars.domain_partition(F.col("c"))).collect()]
    assert got == [("2026", "JRA"), ("2024", "NAR"), ("UNKNOWN", "UNKNOWN")]


def test_strategy_outcomes(spark):
    bets = spark.createDataFrame([("s", 1, 1, 200.0), ("s", 2, 2, 0.0), ("s", 3, 3, 0.0), ("s", 4, 4, 100.0)], "strategy string, day int, race_id int, payout double")
    r = strategy.outcomes(bets).first()
    assert (r["tickets"], r["races"], r["roi"], r["max_drawdown"], r["losing_streak"]) == (4, 4, 0.75, 200.0, 2)


def test_row_mean_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a double, b double")
    mean, n = row_mean([F.col("a"), F.col("b")])
    assert [tuple(r) for r in df.select(mean, n).collect()] == [(1.0, 1), (None, 0), (2.0, 2)]


def test_ledger_and_lineage(spark):
    path = scratch(spark, "test-ledger")
    e = spark.createDataFrame([("a", None, "b", "x"), ("a", "c", "d", "y")], "source string, parent string, output string, step string")
    assert canonical.append_ledger(spark, e, path, e.columns) == 2
    assert canonical.append_ledger(spark, e, path, e.columns) == 0
    nodes, edges = canonical.lineage(e)
    assert nodes.count() == 4 and edges.count() == 3


def test_stream_takes_up_only_what_is_new(spark):
    drop, path, check = (scratch(spark, n) for n in ("test-drop", "test-frozen", "test-check"))
    shape = "k int, at int, v int"
    stream = lambda: spark.readStream.schema(shape).parquet(drop)
    spark.createDataFrame([(1, 5, 50), (1, 4, 40)], shape).write.parquet(f"{drop}")
    jobs.freeze(stream(), "k", ["at"], path, check)
    spark.createDataFrame([(1, 1, 10), (2, 2, 20)], shape).write.mode("append").parquet(f"{drop}")
    jobs.freeze(stream(), "k", ["at"], path, check)
    got = {r["k"]: r["v"] for r in spark.read.option("basePath", path).parquet(path).collect()}
    assert got == {1: 40, 2: 20}


def test_tempering_keeps_order(spark):
    df = spark.createDataFrame([(1, 0.7), (1, 0.2), (1, 0.1)], "race int, p double")
    q = [r[0] for r in df.select(rankprob.tempered(F.col("p"), 2.0, "race")).collect()]
    assert q == pytest.approx([0.49 / 0.54, 0.04 / 0.54, 0.01 / 0.54]) and math.isclose(sum(q), 1)
