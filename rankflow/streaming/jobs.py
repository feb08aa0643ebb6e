"""Structured Streaming jobs: ingest, freeze, stateful histories, joins, monitors.

Every job runs with `availableNow`: what is there is processed in batches, progress
stays in the checkpoint, and a second run takes up only what is new.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import gates

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_now(df: DataFrame, checkpoint: str, each=None, mode: str = "append", path: str | None = None) -> None:
    """Processes what is there: by `each` batch function, or to Parquet at `path`."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    started = (writer.foreachBatch(each) if each is not None else writer.format("parquet").option("path", path)).start()
    started.awaitTermination()


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values by name."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def ingest(stream: DataFrame, rules: Mapping[str, Column], good: str, bad: str, checkpoint: str, at: str | None = None, within: str | None = None) -> None:
    """Drop-folder ingest behind a gate: rows without an issue go to `good`, the rest to quarantine, each content once over all batches and runs.

    The hashes of all contents that ever came are kept as state on disk. With an event time
    `at` and a bound `within`, hashes expire once the watermark has passed them by the bound.
    Where a batch fails half-way, the next run reads the same files against the same state
    and overwrites the batch's own folders, so nothing is lost or doubled.
    """
    hashed = stream.withColumn("content", content_hash(stream.columns))
    fresh = hashed.dropDuplicates(["content"]) if at is None else hashed.withWatermark(at, within).dropDuplicatesWithinWatermark(["content"])

    def each(batch: DataFrame, number: int) -> None:
        fine, off = gates.split(batch, rules)
        fine.write.mode("overwrite").parquet(f"{good}/batch={number}")
        off.write.mode("overwrite").parquet(f"{bad}/batch={number}")

    with_rocks(stream.sparkSession, lambda: run_now(fresh, checkpoint, each))


class Deliveries(StatefulProcessor):
    """Per content: the delivery with the smallest path of the batch that brings it is taken, all others are skipped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None  # one delivery at a time is held back, however many bring the content
        for pdf in rows:
            both = pdf if best is None else pd.concat([best, pdf])
            best = both
            if len(both) > 1:
                both = both.sort_values("path")
                best = both.head(1)
                yield both.iloc[1:].assign(skipped=True)
        if best is not None:
            yield best.assign(skipped=self.seen.exists())
            self.seen.update((True,))

    def close(self) -> None:
        pass


def poll(stream: DataFrame, ledger: str, out: str, checkpoint: str) -> None:
    """Deliveries (path, content), each content taken once over all batches and runs whatever its name: rows to `out`, every delivery to `ledger`.

    Digests of contents are kept as state on disk, so a batch reads its own deliveries
    alone; a repeated batch starts from the same state and overwrites its own folders.
    """
    keyed = stream.withColumn("sha256", F.sha2("content", 256)).select("path", "sha256", "content")
    marked = keyed.groupBy("sha256").transformWithStateInPandas(Deliveries(), outputStructType="path string, sha256 string, content string, skipped boolean", outputMode="Append", timeMode="None")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        taken = batch.sparkSession.read.schema(batch.schema).parquet(f"{ledger}/batch={number}").where("not skipped")
        taken.select("path", F.explode(F.split(F.regexp_replace("content", "\n+$", ""), "\n")).alias("line")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with_rocks(stream.sparkSession, lambda: run_now(marked, checkpoint, each))


class FirstVersion(StatefulProcessor):
    """Per key: the first row by order of the batch that brings the key; later ones lose to it."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            both = pdf if first is None else pd.concat([first, pdf])
            first = both.nsmallest(1, self.order) if pd.api.types.is_numeric_dtype(both[self.order[0]]) else both.sort_values(self.order).head(1)
        if not self.seen.exists() and first is not None:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def freeze(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> None:
    """The first version of a key is kept for good, by keyed state: in a batch by order, later ones lose to what is there."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    first = stream.groupBy(key).transformWithStateInPandas(FirstVersion(order), outputStructType=fields, outputMode="Append", timeMode="None")
    with_rocks(stream.sparkSession, lambda: run_now(first, checkpoint, path=path))


def with_rocks(spark: SparkSession, run) -> None:
    """Runs a job whose operators need the RocksDB state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        run()
    finally:
        spark.conf.set(name, old)


class DayBarrierHistory(StatefulProcessor):
    """Per key: sums by day; a row sees the days of the window before its own, never its own."""

    def __init__(self, days: int = 1095):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "dn int", "n long, wins long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.sums.iterator()}  # at most the days of the window
        ids, at, fresh = [], [], {}
        for pdf in rows:
            ids.append(pdf["row_id"].to_numpy(np.int64))
            at.append(pdf["dn"].to_numpy(np.int64))
            for d, n, w in pdf.groupby("dn")["win"].agg(["size", "sum"]).itertuples():
                old = fresh.get(d, known.get(d, (0, 0)))
                fresh[d] = (old[0] + n, int(old[1] + w))
        known.update(fresh)
        days = np.array(sorted(known), np.int64)
        sums = np.concatenate([[(0, 0)], np.cumsum([known[d] for d in days.tolist()], axis=0)])
        for d, (n, w) in fresh.items():
            self.sums.updateValue((int(d),), (int(n), int(w)))
        for d in days[days < days[-1] - self.days].tolist():  # before the window of any later day
            self.sums.removeKey((int(d),))
        for own, day in zip(ids, at, strict=True):
            past = sums[np.searchsorted(days, day)] - sums[np.searchsorted(days, day - self.days)]
            yield pd.DataFrame({"row_id": own, "h_n": past[:, 0], "h_wins": past[:, 1]})

    def close(self) -> None:
        pass


def stateful_history(stream: DataFrame, key: str, days: int = 1095) -> DataFrame:
    """Rolling history of a stream of (key, row_id, dn, win) with keyed state.

    State holds the sums of the days that a later day's window can reach. Rows that come
    behind it by more than the window see what is left; emitted rows are not revised.
    """
    return stream.groupBy(key).transformWithStateInPandas(DayBarrierHistory(days), outputStructType="row_id long, h_n long, h_wins long", outputMode="Append", timeMode="None")


DAY_MS = 86_400_000


class ClosingDays(StatefulProcessor):
    """Per (source, day, salt): counts rows until the watermark passes the day's end, then emits the count once and forgets the day.

    Rows with a reason of their own, and rows of a day that is closed, come out as they are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = (key[1] + 1) * DAY_MS
        closed, n = timerValues.getCurrentWatermarkInMs() >= end, 0
        for pdf in rows:
            reason = pdf["reason"].mask(pdf["reason"].isna() & closed, "LATE")
            aside = reason.notna()
            n += int((~aside).sum())
            if aside.any():
                yield pd.DataFrame({"source": key[0], "day": key[1], "row_id": pdf["row_id"][aside], "reason": reason[aside], "n": 1})
        if n:
            if self.rows.exists():
                n += self.rows.get()[0]
            else:
                self.handle.registerTimer(end)
            self.rows.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.rows.get()[0]
        self.rows.clear()
        yield pd.DataFrame({"source": [key[0]], "day": [key[1]], "row_id": pd.array([None], dtype="Int64"), "reason": [None], "n": [n]})

    def close(self) -> None:
        pass


def closing_days(stream: DataFrame, row_id: str, at: str, by: str, counts: str, aside: str, checkpoint: str, late: str = "2 days", issues: Mapping[str, Column] | None = None, salts: int = 16) -> None:
    """Daily counts per source in append mode, and all rows they leave out, from one read of a stream.

    A day's count goes to `counts` (source, day, n; a row per salt that saw rows) once, in
    the batch in which the watermark (`late` behind the newest event) has passed its end.
    Rows with an issue, and rows that come for a closed day, go to `aside` (source, day,
    row_id, reason). Keys are salted, so a source with most rows is spread over tasks;
    state holds a number per open day, source and salt.
    """
    marked = stream.withColumn("reason", gates.first_reason(list(issues.items())) if issues else F.lit(None).cast("string"))
    keys = [F.col(by).cast("string").alias("source"), F.unix_date(F.to_date(at)).cast("long").alias("day"), F.pmod(F.xxhash64(row_id), F.lit(salts)).alias("salt")]
    # the watermark's column goes no further, as the operator itself tells rows of closed days
    rows = marked.withWatermark(at, late).select(*keys, F.col(row_id).cast("long").alias("row_id"), "reason")
    told = rows.groupBy("source", "day", "salt").transformWithStateInPandas(ClosingDays(), outputStructType="source string, day long, row_id long, reason string, n long", outputMode="Append", timeMode="EventTime")

    def each(batch: DataFrame, number: int) -> None:
        both = batch.persist()
        both.where("reason is null").select("source", "day", "n").write.mode("overwrite").parquet(f"{counts}/batch={number}")
        both.where("reason is not null").select("source", "day", "row_id", "reason").write.mode("overwrite").parquet(f"{aside}/batch={number}")
        both.unpersist()

    with_rocks(stream.sparkSession, lambda: run_now(told, checkpoint, each))


def results_after(predictions: DataFrame, results: DataFrame, key: str, within: str) -> DataFrame:
    """Stream-stream join: results (time r_at) of a key that come after its prediction (time p_at), within a bound."""
    p = predictions.withWatermark("p_at", within)
    r = results.withWatermark("r_at", within).withColumnRenamed(key, "__key")
    return p.join(r, (F.col(key) == F.col("__key")) & (F.col("r_at") > F.col("p_at")) & (F.col("r_at") <= F.col("p_at") + F.expr(f"INTERVAL {within}"))).drop("__key")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))
