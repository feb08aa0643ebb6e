"""Canonical store: projection by contract, classification, merge, versions with a pointer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def project(df: DataFrame, targets: Sequence[str], column_map: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Source columns under canonical names in exact order; constants where the contract has a default."""
    defaults = defaults or {}
    missing = [t for t in targets if t not in defaults and column_map.get(t) not in df.columns]
    if missing:
        raise ValueError(f"the contract leaves out {', '.join(missing)}")
    return df.select([F.col(column_map[t]).alias(t) if column_map.get(t) in df.columns else F.lit(defaults[t]).alias(t) for t in targets])


def signature(columns: Sequence[str]) -> Column:
    """MD5 of a row's values with a mark for nulls."""
    return F.md5(F.concat_ws("¦", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]))


def classified(staged: DataFrame, active: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Staged rows with `kind`: new, duplicate (same key and values) or conflict (same key, other values)."""
    known = active.select(F.col(key).alias("__key"), signature(columns).alias("__sig"))
    both = staged.withColumn("__own", signature(columns)).join(known, F.col(key) == F.col("__key"), "left")
    kind = F.when(F.col("__key").isNull(), "new").when(F.col("__own") == F.col("__sig"), "duplicate").otherwise("conflict")
    return both.withColumn("kind", kind).drop("__key", "__sig", "__own")


def merged(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in order of precedence; of rows with one key the first frame's stays."""
    tagged = None
    for i, f in enumerate(frames):
        own = f.withColumn("__priority", F.lit(i))
        tagged = own if tagged is None else tagged.unionByName(own, allowMissingColumns=True)
    others = [c for c in tagged.columns if c not in ("__priority", key)]
    first = F.row_number().over(Window.partitionBy(key).orderBy("__priority", *[F.col(c).asc_nulls_last() for c in others]))
    return tagged.withColumn("__rn", first).where("__rn = 1").drop("__rn", "__priority")


class Conflict(Exception):
    """Another publisher took the sequence number first."""


class VersionedTable:
    """Immutable Parquet versions under one folder, and pointers numbered 1, 2, ...; the last one names the current version.

    A publisher reads the last number, validates, and creates the object of the next one,
    which fails where it exists: of two publishers that started from the same number one gets
    a `Conflict`, and readers never see a version that was not validated. `check` raises
    ValueError on a bad version. A version with fewer rows than the current one is refused
    unless it is a rollback to one that was current before.
    """

    def __init__(self, spark: SparkSession, root: str, check=None):
        self.spark, self.root, self.check = spark, root.rstrip("/"), check
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, version: str) -> str:
        return f"{self.root}/version={PurePosixPath(version).name}"

    def _numbers(self) -> list[int]:
        """All numbers that were taken, also by publishers that ended before they wrote a version's name."""
        folder = self._path(f"{self.root}/pointer")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _pointers(self) -> list[tuple[int, str]]:
        if not self._numbers():
            return []
        files = self.spark.read.text(f"{self.root}/pointer", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("long").alias("n"), "value")
        return sorted((r["n"], r["value"]) for r in files.where("value <> ''").collect())  # one short row per publication

    def pointer(self) -> tuple[int, str | None]:
        """Last sequence number, and the current version; (0, None) before the first."""
        numbers, named = self._numbers(), self._pointers()
        return (numbers[-1] if numbers else 0), (named[-1][1] if named else None)

    def current(self) -> str:
        version = self.pointer()[1]
        if version is None:
            raise LookupError("no version is published")
        return version

    def read(self, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(version or self.current()))

    def publish(self, df: DataFrame, version: str, seen: int | None = None) -> None:
        """Builds a version aside, validates it and makes it current; `seen` is the number the publisher started from."""
        seen = self.pointer()[0] if seen is None else seen
        df.write.mode("errorifexists").option("compression", "zstd").parquet(self.path(version))
        self.point(version, seen)

    def point(self, version: str, seen: int | None = None) -> None:
        """Validates a version and makes it the current one; also how to roll back."""
        number, current = self.pointer()
        seen = number if seen is None else seen
        new = self.read(version)
        if self.check is not None:
            self.check(new)
        if current is not None and version not in {v for _, v in self._pointers()} and new.count() < self.read(current).count():
            raise ValueError("the new version has fewer rows")
        self._take(seen + 1, PurePosixPath(version).name)

    def _take(self, seq: int, version: str) -> None:
        """Creates the pointer of a number, which only one publisher can."""
        try:
            out = self._fs.create(self._path(f"{self.root}/pointer/{seq:012d}"), False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise Conflict(f"number {seq} is taken") from e
            raise
        out.write(bytearray(version.encode()))
        out.close()


def publish_merge(table: VersionedTable, candidates: Sequence[DataFrame], key: str, version: str) -> DataFrame:
    """Merges candidates into the current version, which has precedence, and publishes the result unless another publisher came first; returns it as readers see it."""
    seen, current = table.pointer()
    table.publish(merged([table.read(current), *candidates], key), version, seen)
    return table.read()


def append_ledger(spark: SparkSession, events: DataFrame, path: str, payload: Sequence[str]) -> int:
    """Appends events under an id of their payload (24 hex digits of SHA-256); known ids are left out. Returns the rows added."""
    own = events.withColumn("event_id", F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(payload)])), 256), 1, 24)).dropDuplicates(["event_id"])
    try:
        seen = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        own = own.join(seen, "event_id", "left_anti")
    own = own.cache()
    n = own.count()
    own.write.mode("append").parquet(path)
    own.unpersist()
    return n


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free digest of a table of any size: rows, and the sum of row hashes modulo 2^64 by halves."""
    h = F.xxhash64(*[F.col(c) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"))


def frozen(df: DataFrame, root: str) -> DataFrame:
    """`df` written once under its digest below `root`, and read back; fails if what is there reads otherwise."""
    spark = df.sparkSession
    draft = f"{root.rstrip('/')}/draft"
    df.write.mode("errorifexists").parquet(draft)
    told = spark.read.schema(df.schema).parquet(draft)
    digest = table_digest(told, told.columns).first()
    path = f"{root.rstrip('/')}/rows-{digest['rows']}-{digest['high'] % (1 << 64):016x}-{digest['low'] % (1 << 64):016x}"
    told.write.mode("errorifexists").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if table_digest(back, back.columns).first() != digest:
        raise ValueError("the snapshot changed while it was frozen")
    return back


def lineage(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of events (source, parent, output, step): source -> output and parent -> output."""
    nodes = events.select(F.explode(F.array_compact(F.array("source", "parent", "output"))).alias("node")).distinct()
    edges = events.select(F.explode(F.array("source", "parent")).alias("from"), F.col("output").alias("to"), "step").where(F.col("from").isNotNull()).distinct()
    return nodes, edges
