"""Exact deduplication of a growing corpus by stateful streaming.

Files of documents arrive as a stream. The state, keyed by the digest of a normalised text
and kept on disk by RocksDB, holds for each digest how often it was seen, the stable
identifier (the largest doc_id) and the content locator (file and row) of the row that
stays. It has no watermark and never expires. Rows are counted per task before they reach
the state, so a text that a third of all rows hold sends it one row per task. Each batch
writes the keys it changed under its own number; a batch that is repeated after a failure
overwrites its folder, and a later run takes up only the files that are new.

A digest alone decides nothing: every further row of a digest is a hit, and a hit's bytes
are compared with those of the row that stays, fetched by its locator. Only texts of hits
take part, and Spark can split that join on a hot text. Digests whose bytes differ
somewhere are grouped again by the texts themselves.

Texts are equal if they are so after lower-casing A-Z. A null text counts as empty and
equals an empty one. Very long texts are compared whole. Of rows with equal texts that
with the largest doc_id stays; null doc_ids come before all others, and of rows with the
same doc_id that with the last file name and place stays, so exactly one does. An empty
table has no rows. Only doc_id and text are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH_BYTES = 1 << 36

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty; plain ASCII texts take the short way."""
    own = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(own) == F.length(own), F.lower(own)).otherwise(ascii_lower(own))


def _source(spark: SparkSession, path: str) -> str:
    """Type of doc_id, and text: the columns read."""
    kind = spark.read.parquet(path).schema["doc_id"].dataType
    return f"doc_id {kind.simpleString()}, text string"


def _rows(docs: DataFrame, digest: Digest) -> DataFrame:
    """Per row its normalised text, digest, and `row`: doc_id, file and place in the file."""
    text = normalised(F.col("text"))
    row = F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return docs.select(text.alias("text"), digest(text).alias("digest"), row.alias("row"))


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State on disk, with bounded memory, for queries started within."""
    rocks = "spark.sql.streaming.stateStore.rocksdb"
    own = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        f"{rocks}.boundedMemoryUsage": "true",
        f"{rocks}.maxMemoryUsageMB": "300",
        f"{rocks}.allowFAllocate": "false",  # else each partition's store reserves 4 MB, however few keys it has
    }
    old = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def observe(spark: SparkSession, path: str, state: str, digest: Digest = sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Runs the documents' files at `path` that `state` has not seen through the keyed state, in batches of about `batch_bytes`."""
    source = _source(spark, path)
    exact = f"{path[:-1]}[{path[-1]}]"  # a pattern of this path alone: a stream takes no single file by its plain name
    stream = spark.readStream.schema(source).option("maxBytesPerTrigger", batch_bytes).parquet(exact)
    kept = _rows(stream, digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("keep"))

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/updates/batch={number}")

    spark.createDataFrame([], kept.schema).write.mode("overwrite").parquet(f"{state}/updates/batch=-1")
    with _rocks(spark):
        query = kept.writeStream.option("checkpointLocation", f"{state}/checkpoint").outputMode("update").trigger(availableNow=True).foreachBatch(each).start()
        query.awaitTermination()


def groups(spark: SparkSession, state: str) -> DataFrame:
    """The state's digests that more than one row has, as they stand: digest, n, keep."""
    updates = spark.read.parquet(f"{state}/updates").where("n > 1")
    return updates.groupBy("digest").agg(F.max_by(F.struct("n", "keep"), "n").alias("last")).select("digest", "last.n", "last.keep")


def duplicates(spark: SparkSession, path: str, state: str, digest: Digest = sha256) -> DataFrame:
    """Per row of the files that `state` has seen: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.schema(_source(spark, path)).parquet(path)
    held = written(groups(spark, state), "dedup-groups")
    own = _rows(docs, digest).select("digest", "row", *([] if digest is sha256 else [sha256(F.col("text")).alias("sum")]))
    ledger = own.join(held, "digest", "left").withColumns({"n": F.coalesce("n", F.lit(1).cast("long")), "keep": F.coalesce("keep", "row")})
    ledger = written(ledger, "dedup-ledger")

    hits = ledger.where("n > 1").select("row.file", "row.place", F.col("digest").alias("of"), (F.col("row") == F.col("keep")).alias("stays"))
    found = _rows(docs, digest).select("text", "row", F.col("row.file").alias("file"), F.col("row.place").alias("place"))
    texts = written(found.join(hits, ["file", "place"]).select(F.col("of").alias("digest"), "stays", "row", "text"), "dedup-hits")
    content = texts.where("stays").select("digest", F.col("text").alias("content"))
    odd = written(texts.where("not stays").join(content, "digest").where("text <> content").select("digest").distinct(), "dedup-collisions")
    if odd.limit(1).count():  # one digest, several texts
        mixed = texts.join(odd, "digest", "left_semi")
        told = mixed.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("keep"))
        right = mixed.join(told, ["digest", "text"]).select("digest", "row", "n", "keep", *([] if digest is sha256 else [sha256(F.col("text")).alias("sum")]))
        ledger = ledger.join(odd, "digest", "left_anti").select(right.columns).union(right)
    return ledger.select(
        "row.doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep")).alias("kept"),
        F.col("digest" if digest is sha256 else "sum").alias("text_sha256"),
    )


def dedup(spark: SparkSession, path: str, digest: Digest = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """`observe` with a new state, then `duplicates`."""
    state = shared_dir(spark, "dedup-state")
    observe(spark, path, state, digest, batch_bytes)
    return duplicates(spark, path, state, digest)
