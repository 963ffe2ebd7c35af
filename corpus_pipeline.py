"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns the
columns of documents; the last returns the tokens' digests instead. Models and benchmarks come
from the tables beside the documents.

A stage's inner tables in the shared folder are deleted when the next stage begins, since its
result has been written by then; a result that isn't written can't be read after that.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.bpe import encode_documents
from tidelog.llm.common import drop_tables, recording, shared_path, table
from tidelog.llm.decontaminate import without_leaks
from tidelog.llm.linededup import dedup_lines
from tidelog.llm.quality import keep_good
from tidelog.llm.queries import VOCABULARY
from tidelog.llm.simhash import near_dedup


#: Inner tables of the last stage, by thread and tables' folder, so that pipelines that run at once don't meet.
_INNER: dict[tuple[int, str], list[str]] = defaultdict(list)


def inner(sf_dir: str) -> list[str]:
    return _INNER[threading.get_ident(), sf_dir]


def stage(f):
    """A stage that first deletes the inner tables of the one before it."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, inner(sf_dir))
        with recording(inner(sf_dir)):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occurred before go from the texts; documents stay."""
    return dedup_lines(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left."""
    return encode_documents(docs, VOCABULARY)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("bpe", encode)]

#: The stages hold a trained model, rolling hashes and BPE, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, f) in enumerate(STAGES):
        path = shared_path(spark, f"stage{i}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_tables(spark, before)
        before = [path]
    drop_tables(spark, inner(sf_dir))
    return docs
