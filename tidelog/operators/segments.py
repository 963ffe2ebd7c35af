"""Segments of externally framed files: indexes, tolerant scans and reductions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import with_last_seen, with_ordinal, with_running_sum
from tidelog.plans.errors import CorruptData


def segment_index(segments: DataFrame, file: str = "file", kind: str = "kind", order: str = "record_ord") -> DataFrame:
    """Segments with their index in the file and among those of their kind."""
    return with_ordinal(with_ordinal(segments, [file], order, "segment_index"), [file, kind], order, "kind_index")


def chunk_index(chunks: DataFrame, key: str = "key", order: str = "segment_index", length: str = "byte_len") -> DataFrame:
    """Chunks with their byte offset in their key's stream."""
    return with_running_sum(chunks, [key], order, length, "byte_offset")


def entries_for(index: DataFrame, key: object, column: str = "key") -> DataFrame:
    return index.where(F.col(column) == key)


def bounded(index: DataFrame, size: str = "raw_len", offset: str = "byte_offset", length: str = "byte_len") -> DataFrame:
    """The index; a window beyond its segment fails the query."""
    bad = F.raise_error(F.lit(f"[{CorruptData.__name__}] a chunk is beyond its segment"))
    return index.where(F.when(F.col(offset) + F.col(length) <= F.col(size), F.lit(True)).otherwise(bad.cast("boolean")))


def carry_forward(segments: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Segments whose missing value is that of the segment before: 'same as previous'."""
    return with_last_seen(segments, by, order, value)


def latest_properties(properties: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each property's latest value."""
    return properties.groupBy(*by).agg(F.max_by(value, order).alias(value))


def concat_values(chunks: DataFrame, by: list[str], order: str, values: str) -> DataFrame:
    """Samples (by, sample, value) of chunks' arrays joined in order, one row each: no channel is gathered in one row."""
    sized = with_running_sum(chunks.withColumn("_n", F.size(values)), by, order, "_n", "_start")
    rows = sized.select(*by, "_start", F.posexplode(values).alias("_i", "value"))
    return rows.select(*by, (F.col("_start") + F.col("_i")).alias("sample"), "value")


def reduce_segments(segments: DataFrame, by: list[str], order: str, columns: list[str], initial: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A left fold over each file's segments in order, as an SQL expression; a file is one row's memory."""
    rows = segments.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *columns))).alias("_s"))
    return rows.select(*by, F.aggregate("_s", initial, step).alias("state"))


def roll_up(findings: DataFrame, by: list[str] = (), severity: str = "severity") -> DataFrame:
    """The worst severity of findings."""
    rank = F.when(F.col(severity) == "error", 2).when(F.col(severity) == "warning", 1).otherwise(0)
    worst = findings.groupBy(*by).agg(F.max(rank).alias("_r"), F.count("*").alias("findings"))
    return worst.select(*by, F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), F.col("_r") + 1).alias("status"), "findings")
