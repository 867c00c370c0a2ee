"""The registered corpus queries and their DuckDB oracles."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeloom.llm import bpe, codes, leaks, lm, neardup, quality, quotes, rules, secrets, shards, tokenfiles, tries, urls
from ridgeloom.llm.shared import scratch_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _last(rows: DataFrame, *names: str) -> DataFrame:
    """The rows with these columns behind all others."""
    return rows.select(*[c for c in rows.columns if c not in names], *names)


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(rules.host_rules(table(spark, sf_dir, "documents")), "host_rejected")


ORACLES["op3_quality_rules"] = rules.ORACLE


@_query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


@_query
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(secrets.find(table(spark, sf_dir, "documents")).drop("found"), "n_random")


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = shards.dealt(table(spark, sf_dir, "documents"), 5)
    rows = shards.round_trip(arrivals, f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}")
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op6_sharding"] = shards.ORACLE


@_query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op8_chat_formatting"] = quotes.ORACLE


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


ORACLES["op10_url_filters"] = urls.oracle()


@_query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


ORACLES["op12_vector_codes"] = codes.ORACLE


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = tries.ORACLE


@_query
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
