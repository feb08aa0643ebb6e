"""Reading and writing: files by suffix, JDBC, catalog, resumable staging, part hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables: in the shared folder that the session names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read again, for what several branches of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def relation(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, or CSV with a header and a declared schema."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV relation needs a schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def csv_to_parquet(spark: SparkSession, source: str, schema: StructType, dest: str) -> None:
    relation(spark, source, schema).write.option("compression", "zstd").parquet(dest)


def jdbc_read_only(spark: SparkSession, url: str, query: str, driver: str, timeout_s: int = 15, init: str | None = None) -> DataFrame:
    """A query through JDBC in a session of its own, read-only where the database has such a setting."""
    reader = spark.read.format("jdbc").option("url", url).option("driver", driver).option("query", query).option("queryTimeout", timeout_s)
    return (reader.option("sessionInitStatement", init) if init else reader).load()


def jdbc_partitioned(spark: SparkSession, url: str, table: str, driver: str, key: str, low: int, high: int, parts: int, after: int | None = None) -> DataFrame:
    """A table in ranges of its key, from behind a high-water mark on."""
    source = table if after is None else f"(SELECT * FROM {table} WHERE {key} > {int(after)}) staged"
    options = {"url": url, "driver": driver, "dbtable": source, "partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts, "fetchsize": 10_000}
    return spark.read.format("jdbc").options(**options).load()


def catalog(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of all frames: table_name, ordinal, name, type."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, name string, type string")


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and rows of all frames."""
    out = None
    for name, df in frames.items():
        own = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = own if out is None else out.union(own)
    return out


def discovered(spark: SparkSession, frames: Mapping[str, DataFrame], wanted: Mapping[str, Sequence[str]], keywords: Sequence[str]) -> DataFrame:
    """Per table: columns in order, their MD5 (another one tells of drift), rows, wanted columns that are missing, how many names other tables have too, and whether the table's name holds a keyword."""
    names = catalog(spark, frames)
    met = names.join(names.groupBy("name").agg(F.count(F.lit(1)).alias("tables")), "name")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), ",")  # a table's columns
    told = met.groupBy("table_name").agg(listed.alias("columns"), F.count_if(F.col("tables") > 1).alias("shared_names"))
    lacking = spark.createDataFrame([(t, ",".join(sorted(set(c) - set(frames[t].columns)))) for t, c in wanted.items() if t in frames] or [("", "")], "table_name string, missing string")
    return (
        told.join(row_counts(frames), "table_name")
        .join(lacking, "table_name", "left")
        .select("table_name", "columns", F.md5("columns").alias("digest"), "rows", F.coalesce("missing", F.lit("")).alias("missing"), "shared_names", F.col("table_name").rlike("|".join(keywords)).alias("relevant"))
    )


def high_water(spark: SparkSession, path: str, key: str):
    """Largest staged key; None before the first stage."""
    try:
        return spark.read.parquet(path).agg(F.max(key)).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def stage_after(df: DataFrame, key: str, path: str, chunk: int = 100_000) -> None:
    """Appends the rows whose key lies behind the staged ones, in order of the key and in files of at most `chunk` rows; a second run adds nothing."""
    mark = high_water(df.sparkSession, path, key)
    rows = df if mark is None else df.where(F.col(key) > mark)
    rows.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", chunk).mode("append").parquet(path)


def part_hashes(spark: SparkSession, path: str) -> DataFrame:
    """folder, file and sha256 of every Parquet part below a folder."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return parts.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
