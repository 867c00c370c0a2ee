"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as
the next stage's documents. All stages but the last return the columns of documents, whatever their names; columns
that a stage adds for itself have names of their own. Null, empty and very long texts, rows without an id and rows that
repeat one go through every stage; an empty table gives empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeloom.llm import bpe, leaks, neardup, quality, secrets
from ridgeloom.llm.shared import drop_staged, staged, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking, fitted to the labels of ``docs``, does not reject.

    Each row is judged by its own text: equal texts stay or go together, and a null text is judged as an empty one.
    """
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), and all that are in none.

    Rows are told apart by a key of their own, written once, not by their ids: of equal rows one stays, rows without an
    id are grouped like others, and different texts under one id all stay. Texts without a word are in no group.
    The row of a group that stays is its first as the rows are stored.
    """
    row = next(name for k in range(len(docs.columns) + 1) if (name := f"row_key_{k}") not in docs.columns)
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = neardup.classes(keyed, shingle_words=5, percent=80, id_col=row)
    return keyed.join(found.where("kept").select(row), row, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Each row is searched by its own text; a null or empty one contains nothing."""
    return leaks.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; null texts stay null."""
    return secrets.redacted(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of each row; a null or empty text has no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("tokens", to_tokens),
]

#: Learned scores, sketches and latent vectors have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
