"""A training corpus from raw documents: five stages, each one operator's decisions put into effect.

Every stage takes all that its predecessor kept and returns a DataFrame with the columns of documents; the last returns
the packed pieces. Between stages the rows are written to the shared folder and read again, so no stage recomputes another
and a lost executor costs a task.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm import jaccard, packing, secrets, suffixes, toxicity
from archlens.llm.common import read_table, shared_dir, text_key, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that may not stand twice: about 45 words of prose in one-byte letters; README names what this misses.
PASSAGE = 250


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. The model learns from labelled documents of the whole table."""
    model = toxicity.fit_on_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score_documents(docs.select(COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id; rows without doc_id stay."""
    stays = jaccard.join_similar(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    keyed = docs.select(COLUMNS).withColumn("_key", text_key(text_or_empty()))
    named = keyed.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "_key"])
    return named.unionByName(keyed.where("doc_id IS NULL")).select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(suffixes.without_repeats(docs.select(COLUMNS), PASSAGE))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redact(secrets.scan(docs.select(COLUMNS), secrets.fresh_ledger(spark))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express dictionary compression, a learned model or a tokenizer; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
