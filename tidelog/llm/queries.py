"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import table
from tidelog.llm.oracle import ORACLE as ORACLE

#: The public vocabulary; a parameter of the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.secrets import secrets_of_documents

    return secrets_of_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.linededup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.decontaminate import leaks_of_documents

    return leaks_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_secrets": op2_secrets,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
}

