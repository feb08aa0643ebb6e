"""Line deduplication with DataFrame functions alone.

Texts are split at line feeds; a line's key is the line without white space at both
ends and with A-Z in lower case. Keys of at least `least` characters that two or more
documents hold keep their lines only in the smallest doc_id holding them. Other lines
stay. Keys meet as 128-bit hashes (two 64-bit hashes with different seeds).

Lines are split and hashed once: their keys are written in the shared folder without
the texts. The keys' smallest and largest doc_id come from a partial aggregate, so a line
that a third of all documents hold shuffles one row per task; the join that brings the
verdicts back is one Spark can split on a hot key. Texts are shuffled once, to meet
the places of their dropped lines, and lines are reassembled by position.

Null and empty texts are one empty line; a null text comes back empty. Very long texts
are split whole. Rows that repeat a doc_id count as one document and are treated alike.
Rows with a null doc_id count as one document whose id is larger than any other. An
empty table gives none. Extra columns may have any name and come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns, unused, written

LEAST = 10
SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, least: int = LEAST, counts: tuple[str, ...] = ("__lines", "__dropped")) -> DataFrame:
    """Per row of (doc_id, text, any others): its columns with `text` after dropping.

    `counts` names two more columns, the numbers of lines before and of lines dropped
    (longer names are taken if a column has these already); none are added if it is empty.
    """
    text = F.coalesce("text", F.lit(""))
    split = F.split(text, "\n", -1)
    doc = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))
    keyed = docs.select(doc.alias("doc"), F.xxhash64(text).alias("sum"), F.posexplode(F.transform(split, line_key)).alias("pos", "key"))
    keyed = written(keyed.where(F.length("key") >= least).select("doc", "sum", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2")), "line-keys")
    shared = keyed.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h1", "h2", "first")
    shared = written(shared, "shared-lines")  # the join then has an exchange of its own on either side, which Spark can split
    drops = (
        keyed.join(shared, ["h1", "h2"])
        .where("doc > first")
        .groupBy(F.col("doc.id").alias("doc"), "sum")
        .agg(F.collect_set("pos").alias("drop"))
    )
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*columns(others)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("key"), split.alias("all"))
    met = rows.join(drops, F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("sum")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("drop"))
    kept = F.array_join(F.when(F.col("drop").isNull(), F.col("all")).otherwise(F.transform(places, lambda i: F.get("all", i))), "\n")
    numbers = (F.size("all").cast("long"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long"))
    return met.select(
        *[kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
        *[n.alias(unused(docs.columns, name)) for n, name in zip(numbers, counts, strict=False)],
    )
