"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo `parts`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(-1))


def unused(taken: list[str], name: str) -> str:
    """`name`, made longer until no column has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def columns(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing (a local session without one), a new temporary
    folder is made once and stored in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rankflow.shared.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("rankflow.shared.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(manifest: DataFrame, most: int = 20_000) -> DataFrame:
    """Rows of a manifest, each a file to read, dealt over as many tasks; the number is fixed, so small rows aren't put together."""
    return manifest.repartition(max(1, min(manifest.count(), most)))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; usable inside tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def sample_fraction(total: int, bound: int) -> float:
    return 1.0 if total <= bound else bound / total


def hash_below(key: Column, fraction: float, salt: int) -> Column:
    """True for about `fraction` of the keys, always the same ones."""
    if fraction >= 1.0:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < int(fraction * (1 << 30))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the least node reachable.

    Each round gives a node the least label among its neighbours' and then follows
    labels one step (pointer jumping), so long chains close in few rounds. Labels are
    written after each round; only the number of changed labels reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        low = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = written(
            low.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old"),
            f"{name}-labels",
        )
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def judge_texts(docs: DataFrame, judge: Callable[[list], pd.DataFrame], fields: str, name: str) -> DataFrame:
    """All columns and `name`, a struct of `fields` that `judge` finds for a batch of texts; no column may have that name.

    Only texts go through Python; the other columns stay where they are, and no row
    is shuffled.
    """

    @F.pandas_udf(fields)
    def found(texts: pd.Series) -> pd.DataFrame:
        return judge(texts.tolist())

    return docs.select(*columns(docs.columns), found(F.col("text")).alias(name))


def map_texts(docs: DataFrame, run: Callable[[Iterator], Iterator], fields: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`run` over pandas batches of doc_id and text; its frames have doc_id and `fields`.

    Ids pass through as text, so that null and very large ones stay exact. Rows stay in
    the partitions they were read in.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id string, {fields}").withColumn("doc_id", F.col("doc_id").cast(kind))
