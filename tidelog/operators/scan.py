"""Scans, positional reads and verification over an enveloped log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import with_ordinal
from tidelog.plans.envelope import META
from tidelog.plans.errors import CorruptData, UsageError, VersionMismatch
from tidelog.plans.spec import Block


def events(log: DataFrame) -> DataFrame:
    """The physical scan: every record, dead ones too."""
    return log


def blocks(log: DataFrame, block: Block | int, version: int | None = None) -> DataFrame:
    """Records of one block. Those of another version fail the query; other blocks' payloads aren't read."""
    block_id = block if isinstance(block, int) else block.id
    if isinstance(block, Block):
        version = block.version if version is None else version
        if not block.resident:
            raise UsageError("the block is reached by its chain only", block=block.name)
    found = log.where(F.col("block_id") == block_id)
    if version is None:
        return found
    wrong = F.raise_error(F.concat(F.lit(f"[{VersionMismatch.__name__}] block {block_id}: expected {version}, found "), F.col("block_version").cast("string")))
    return found.where(F.when(F.col("block_version") == version, F.lit(True)).otherwise(wrong.cast("boolean")))


def get_at(log: DataFrame, block_id: int, position: int) -> DataFrame:
    """The record at a position of a block's collection."""
    return with_ordinal(blocks(log, block_id), ["block_id"], "record_ord").where(F.col("ordinal") == position)


def index_entries(log: DataFrame, payload: tuple[str, ...] = ("payload", "value")) -> DataFrame:
    """The scan without payloads."""
    return log.drop(*payload)


def through_directory(log: DataFrame, directory: DataFrame, on: str = "record_ord") -> DataFrame:
    """Records of a directory that the caller supplies."""
    return log.join(directory.select(on).distinct(), on, "left_semi")


def find(log: DataFrame, predicate: Column) -> DataFrame:
    """The first record, in file order, that satisfies the predicate."""
    return log.where(predicate).orderBy("record_ord").limit(1)


def fill(log: DataFrame, count: int, after: int | None = None) -> DataFrame:
    """The next records after a place, in file order: a map filled step by step. The last row's place resumes it."""
    rest = log if after is None else log.where(F.col("record_ord") > after)
    return rest.orderBy("record_ord").limit(count)


def record_at(log: DataFrame, place: int) -> DataFrame:
    return log.where(F.col("record_ord") == place)


def metadata(log: DataFrame, name: str | None = None) -> DataFrame:
    """The latest value of each metadata key, or of one."""
    meta = log.where(F.col("kind") == META)
    if name is not None:
        meta = meta.where(F.col("key") == name)
    return meta.groupBy("key").agg(F.max_by("payload", "record_ord").alias("payload"))


def verify(log: DataFrame) -> DataFrame:
    """A row: records, and how many differ from their checksum."""
    return log.agg(F.count("*").alias("records"), F.sum((F.crc32("payload") != F.col("checksum")).cast("long")).alias("damaged"), F.min(F.when(F.crc32("payload") != F.col("checksum"), F.col("record_ord"))).alias("first_damaged"))


def verified(log: DataFrame) -> int:
    """The number of records, if none is damaged."""
    records, damaged, first = verify(log).head()
    if damaged:
        raise CorruptData("records differ from their checksums", damaged=damaged, first=first)
    return records


def byte_range(column: str, start: int, length: int) -> Column:
    """Bytes of a binary column; a range beyond its end fails the query."""
    bad = F.raise_error(F.lit(f"[{CorruptData.__name__}] bytes {start} to {start + length} are beyond the end"))
    return F.when(F.octet_length(column) >= start + length, F.substring(column, start + 1, length)).otherwise(bad.cast("binary"))


def tails(log: DataFrame) -> DataFrame:
    """The newest place of each block: what lets a lazy open skip the scan."""
    return log.groupBy("block_id").agg(F.max("record_ord").alias("tail"), F.max("sequence").alias("last_sequence"), F.count("*").alias("records"))
