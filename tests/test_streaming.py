"""Streaming jobs over several deliveries, failures and late rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from rankflow.operators import strategy
from rankflow.plans import stream_queries
from rankflow.streaming import jobs

SCHEMA = "event_id long, value double, kind string"


def drop(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def read(spark, path, *columns):
    return sorted(tuple(r) for r in spark.read.option("basePath", path).parquet(path).select(*columns).collect())


def test_each_content_lands_once_over_all_deliveries(spark, tmp_path):
    src, good, bad, check = (str(tmp_path / n) for n in ("src", "good", "bad", "check"))
    deliveries = [[(1, 1.0, "a"), (2, -1.0, "a"), (1, 1.0, "a")], [(1, 1.0, "a"), (2, -1.0, "a"), (1, 2.0, "a"), (3, None, None)], [(3, None, None), (4, 0.0, "b")]]
    for rows in deliveries:
        drop(spark, src, rows)
        jobs.ingest(spark.readStream.schema(SCHEMA).parquet(src), {"bad": F.col("value") < 0}, good, bad, check)
    every = {r for d in deliveries for r in d}
    assert read(spark, good, "event_id", F.coalesce("value", F.lit(-9.0))) == sorted((i, -9.0 if v is None else v) for i, v, _ in every if v is None or v >= 0)
    assert read(spark, bad, "event_id", "issues") == [(2, ["bad"])]


def test_a_batch_that_fails_half_way_is_repeated_to_the_same_end(spark, tmp_path):
    src, good, bad, check = (str(tmp_path / n) for n in ("src", "good", "bad", "check"))
    ingest = lambda: jobs.ingest(spark.readStream.schema(SCHEMA).parquet(src), {"bad": F.col("value") < 0}, good, bad, check)
    drop(spark, src, [(1, 1.0, "a"), (2, -1.0, "a")])
    ingest()
    drop(spark, src, [(1, 1.0, "a"), (3, 1.0, "a"), (4, -1.0, "a")])
    real = jobs.gates.split

    def broken(batch, rules):  # the second write of the batch fails
        fine, off = real(batch, rules)
        return fine, off.withColumn("x", F.raise_error(F.lit("lost")))

    jobs.gates.split = broken
    try:
        with pytest.raises(Exception):  # noqa: B017
            ingest()
    finally:
        jobs.gates.split = real
    assert read(spark, good, "event_id") == [(1,), (3,)]  # its first write is there already
    ingest()
    assert read(spark, good, "event_id") == [(1,), (3,)] and read(spark, bad, "event_id") == [(2,), (4,)]


def test_hashes_expire_behind_the_watermark(spark, tmp_path):
    src, good, bad, check = (str(tmp_path / n) for n in ("src", "good", "bad", "check"))
    schema = "event_id long, at timestamp"
    at = lambda d: datetime.datetime(2024, 1, d)
    for rows in ([(1, at(1))], [(1, at(1)), (2, at(9))], [(2, at(9)), (3, at(10))]):
        drop(spark, src, rows, schema)
        jobs.ingest(spark.readStream.schema(schema).parquet(src), {}, good, bad, check, "at", "3 days")
    assert read(spark, good, "event_id") == [(1,), (2,), (3,)]


def test_days_close_once_and_late_rows_go_aside(spark, tmp_path):
    src, counts, aside, check = (str(tmp_path / n) for n in ("src", "counts", "aside", "check"))
    schema = "event_id long, at timestamp, kind string"
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    drops = [
        [(1, at(1, 1), "a"), (2, at(1, 3), "a"), (3, at(2, 1), "b"), (4, at(2, 1), None)],
        [(5, at(4, 1), "a"), (6, at(1, 5), "a")],  # the first day is still open
        [(7, at(1, 7), "a"), (8, at(6, 7), "a"), (9, at(3, 1), "b"), (-1, at(3, 2), "b")],  # 7 comes for a closed day
        [(10, at(20), "a"), (11, at(2), "b")],
        [(12, at(20), "a")],
    ]
    for rows in drops:
        drop(spark, src, rows, schema)
        jobs.closing_days(spark.readStream.schema(schema).parquet(src), "event_id", "at", "kind", counts, aside, check, "1 day", {"NEGATIVE": F.col("event_id") < 0}, salts=3)
    day = lambda d: (datetime.date(2024, 1, d) - datetime.date(1970, 1, 1)).days
    got = spark.read.option("basePath", counts).parquet(counts).groupBy("source", "day").agg(F.sum("n").alias("n"), F.count_distinct("batch").alias("batches"))
    want = {("a", day(1), 3, 1), ("b", day(2), 1, 1), (None, day(2), 1, 1), ("b", day(3), 1, 1), ("a", day(4), 1, 1), ("a", day(6), 1, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in spark.read.option("basePath", aside).parquet(aside).select("row_id", "reason", "day").collect()} == {(7, "LATE", day(1)), (-1, "NEGATIVE", day(3)), (11, "LATE", day(2))}


def test_market_meets_fair_tickets_on_three_keys(spark):
    fair = spark.createDataFrame([(1, "WIN", "7", 0.25, 4.0), (1, "TOP2", "7", 0.5, 2.0), (2, "WIN", "7", 0.0, None)], "race_id long, ticket_type string, selection string, probability double, fair_odds double")
    market = spark.createDataFrame([(1, "WIN", "7", 5.0), (1, "TOP3", "7", 5.0), (1, "WIN", "8", 5.0), (2, "WIN", "7", 3.0)], "race_id long, ticket_type string, selection string, market_odds double")
    meta = spark.createDataFrame([(1, "F")], "race_id long, venue string")
    structure = spark.createDataFrame([(2, 9)], "race_id long, size long")
    got = {tuple(r) for r in strategy.market_join(fair, market, meta, structure).select("race_id", "ticket_type", "ev", "edge_ratio", "profit_per_100", "venue", "size").collect()}
    assert got == {(1, "WIN", 0.25, 0.25, 25.0, "F", None), (2, "WIN", -1.0, None, -100.0, None, 9)}


def test_a_content_is_taken_once_over_polls_whatever_its_name(spark, tmp_path):
    src, ledger, out, check = (str(tmp_path / n) for n in ("src", "ledger", "out", "check"))
    schema = "path string, content string"
    hot = [(f"p{i:03}", "1,a\n2,b\n") for i in range(300)]
    polls = [[*hot[5:], ("q", "3,c")], [], [*hot[:5], ("q2", "3,c"), ("r", "4,d\n\n"), ("s", ""), ("t", None)]]
    for rows in polls:
        drop(spark, src, rows, schema)
        jobs.poll(spark.readStream.schema(schema).parquet(src), ledger, out, check)
    jobs.poll(spark.readStream.schema(schema).parquet(src), ledger, out, check)  # nothing new
    seen = spark.read.option("basePath", ledger).parquet(ledger)
    assert seen.count() == sum(map(len, polls))
    assert {r["path"] for r in seen.where("not skipped").collect()} == {"p005", "q", "r", "s", "t"}
    lines = spark.read.option("basePath", out).parquet(out).select("path", "line").collect()
    assert sorted(map(tuple, lines)) == [("p005", "1,a"), ("p005", "2,b"), ("q", "3,c"), ("r", "4,d"), ("s", "")]


def test_parcels_are_files_of_many_tasks(spark, tmp_path):
    c = spark.range(450).select((449 - F.col("id")).alias("c_custkey"), F.floor((449 - F.col("id")) / 100).alias("parcel"), F.concat(F.lit("a,"), F.col("id").cast("string")).alias("c_name"))
    rows = stream_queries.parcels(c, 7)
    assert rows.rdd.getNumPartitions() > 1  # however few bytes there are
    path = str(tmp_path / "inbox")
    rows.write.option("maxRecordsPerFile", 1).text(path)
    files = sorted((tmp_path / "inbox").glob("part-*"), key=lambda f: int(f.read_text().split(",")[1]))
    assert [f.read_text() for f in files] == ["".join(f'{k},{p},"a,{449 - k}"\n' for k in range(100 * p, min(450, 100 * p + 100))) for p in range(5)]
