"""A corpus pipeline over the documents table: five stages, each reading what the stage before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns that docs has; the last
returns token ids. Each stage works on all documents that the stage before it kept.

Defined results: null texts count as empty. Documents whose quality score is under 0.7 go; of near-duplicates (fingerprints
of three-word shingles within two bits, or sets of five-word shingles with a similarity of 0.8 or more, linked on and on) the
one with the smallest id stays, a row without an id only if its group has none with one; documents of which a twentieth or
more are benchmark words go; personal data are replaced by their kind in brackets, with n_chars counted anew; the rest is encoded.
Empty tables pass through. Repeated rows are near-duplicates of each other, of which one stays; of rows with one and the same
smallest id, too, only one does. Texts of any length are read whole in every stage. Columns besides doc_id, text and n_chars pass
through unread, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxsieve.llm import bpe, decontaminate, pii, quality, resemblance
from voxsieve.llm.common import fold, new_path, read_table, removed, scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
KEPT_QUALITY = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    voters = quality.fit(docs, read_table(spark, sf_dir, "labels"), fold("id", 4) != 2)
    return quality.keep(docs, voters, KEPT_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return resemblance.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold much of the benchmark."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by their kinds; texts without any stay as they are."""
    return pii.redact_column(docs, pii.fit(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs, VOCABULARY).select(F.col("id").alias("doc_id"), "n_tokens", "ids")


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("pii", without_pii), ("bpe", token_ids)]

#: The stages are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. What a stage needs besides goes when it is done, and so does the
    table that it read, but for documents; what the last stage reads stays for the returned rows."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
