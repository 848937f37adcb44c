"""Corpus preparation: stages applied one after the other to the table documents.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of documents; the last adds
the encoding. run() applies them in one plan each; a caller that writes each stage's result and rereads it gets
the same rows. Each stage takes an empty table, null in any column, repeated rows and ids, ties and extra columns as its operator's
module says; what this means for the rows is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftstone.llm import chunk_bpe, mixing, pii, quality_rules, setsketch_dedup
from siftstone.llm.queries import surrogate_key


#: Rows of an Arrow batch. The pipeline owns its session and sets this once for all of its stages: beside the writers of whole texts, batches of ten thousand
#: rows, the default, would take an executor near its memory's end.
BATCH_ROWS = "2000"


def _with_settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, and whose host does. A null text fails; a null source is a host; repeated rows stay or go together."""
    _with_settings(spark)
    return quality_rules.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, on shingles of five words: that of the smallest doc_id (rows of one id are one document,
    of which that with the smallest hash of its text stays). Rows without words are nobody's duplicate; rows without an id stay."""
    _with_settings(spark)
    return setsketch_dedup.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates, in all rows alike. A null text stays null; no row goes."""
    _with_settings(spark)
    return pii.anonymize(docs, surrogate_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Texts without words are taken by none; a null source is one of its own."""
    _with_settings(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids and digests of ids and decoded text. A null text has no ids; columns with the results' names are replaced."""
    _with_settings(spark)
    return chunk_bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("personal data", private), ("source mix", mixture), ("bpe encoding", encoded)]

#: Surrogates, hashes and ids can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
