"""A training-corpus pipeline over the documents table.

Stages, in order: toxicity (rejected documents go), line deduplication, SimHash
near-duplicates (the smallest doc_id of each group stays), benchmark decontamination
(contaminated documents go), SentencePiece encoding and decoding. Each stage reads what
its predecessor wrote. All stages but the last return the columns of documents, extra ones
of any name too; n_chars follows the text. The last returns doc_id, n_tokens and digests.
A null text is empty: no stage rejects it for itself, and of several one stays, as of
other equal texts. Very long texts are judged whole; an empty table passes. Rows without a doc_id pass the first stages by their text alone and are no
group's representative unless the group has no other id. One row of each group stays,
also where ids are missing or repeated: among rows of the smallest doc_id the one with
the least hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import decontaminate, line_dedup, sentencepiece_codec, simhash, toxicity
from rankflow.llm.common import columns, table, unused, written
from rankflow.llm.queries import tokenizer_path, toxicity_scorer

ORACLE_SQL = None  # the first, third and last stage can't be written in SQL; tests/llm has brute-force versions


def _where(rows: DataFrame, docs: DataFrame, condition: str) -> DataFrame:
    return rows.where(condition).select(*columns(docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = unused(docs.columns, "found")
    return _where(toxicity.judged(docs, toxicity_scorer(spark, docs, sf_dir), found), docs, f"{found}.predicted = 0")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(docs, counts=())
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = unused(docs.columns, "found")
    return _where(decontaminate.judged(docs, table(spark, sf_dir, "benchmark"), found), docs, f"not {found}.contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_duplicates), ("decontaminate", drop_contaminated), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
