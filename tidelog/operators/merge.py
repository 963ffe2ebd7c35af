"""Merging, compacting, replacing and migrating keyed logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.keyed import distinct_keys_ever, materialize_last, materialize_sum
from tidelog.operators.ordered import with_ordinal, with_previous
from tidelog.plans.envelope import OP, PUT, TOMBSTONE
from tidelog.plans.errors import KeyLimitExceeded, UsageError

FOLDS = {"sum": materialize_sum, "last": materialize_last}


def shards(base: DataFrame, *deltas: DataFrame) -> DataFrame:
    """One log of a base and its deltas, in that order: a later shard wins even with a lower sequence."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("shard_ord", F.lit(i)) for i, s in enumerate((base, *deltas))])


def merge(base: DataFrame, *deltas: DataFrame, fold: str = "last", keys: list[str] = ("key",), orphans: str = "raise", key_limit: int | None = None) -> DataFrame:
    """The live keys of all shards with their folded values. Tombstones take part in the fold and go after it."""
    log = shards(base, *deltas)
    if key_limit is not None:
        guard_keys(log, key_limit, keys)
    return FOLDS[fold](log, list(keys), orphans=orphans)


def compact(log: DataFrame, block_id: int, fold: str = "last", keys: list[str] = ("key",), orphans: str = "raise", key_limit: int | None = None) -> DataFrame:
    """One block's final values; other blocks aren't copied."""
    own = log.where(F.col("target_block_id") == block_id)
    if key_limit is not None:
        guard_keys(own, key_limit, keys)
    return FOLDS[fold](own, list(keys), orphans=orphans)


def guard_keys(log: DataFrame, limit: int, keys: list[str] = ("key",)) -> None:
    """Refuses a log of more keys, tombstoned ones too, before anything is written."""
    found = distinct_keys_ever(log, list(keys)).head()[0]
    if found > limit:
        raise KeyLimitExceeded("too many distinct keys", found=found, limit=limit)


def estimate(*logs: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """A row: input records, those that bear keys, at most so many keys, payload bytes. No value is decoded."""
    log = shards(*logs)
    bears = F.col("kind").isin(PUT, OP, TOMBSTONE)
    return log.agg(F.count("*").alias("records"), F.count_if(bears).alias("key_bearing"), F.count_if(F.col("kind") == PUT).alias("keys_at_most"), F.sum("stored_len").alias("bytes"), F.max("stored_len").alias("largest"))


def replace_at(log: DataFrame, block_id: int, position: int, key_column: str = "key", validate: Column | None = None, **new) -> DataFrame:
    """The log with the record at a position of a block replaced. It keeps its sequence, so a later put still wins.

    A new record for which ``validate`` doesn't hold fails the query.
    """
    if key_column in new:
        raise UsageError("a replacement keeps its key", key=new[key_column])
    placed = with_ordinal(log, ["block_id"], "record_ord", "_at")
    hit = (F.col("block_id") == block_id) & (F.col("_at") == position)
    for name, value in new.items():
        placed = placed.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    if validate is not None:
        bad = F.raise_error(F.lit(f"[{UsageError.__name__}] the replacement is refused"))
        placed = placed.where(F.when(~hit | F.coalesce(validate, F.lit(False)), F.lit(True)).otherwise(bad.cast("boolean")))
    return placed.drop("_at")


def replace_fixed(log: DataFrame, place: int, next_sequence: int, **new) -> DataFrame:
    """The log with a fixed-size record replaced in place; it takes a fresh sequence but keeps its place. A payload of another size fails the query."""
    hit = F.col("record_ord") == place
    for name, value in {**new, "sequence": next_sequence}.items():
        now = F.lit(value)
        if name == "payload":
            other = F.raise_error(F.lit(f"[{UsageError.__name__}] a fixed record keeps its size"))
            now = F.when(F.octet_length("payload") == F.octet_length(now), now).otherwise(other.cast("binary"))
        log = log.withColumn(name, F.when(hit, now).otherwise(F.col(name)))
    return log


def replace_rewrite(log: DataFrame, place: int, next_sequence: int, key_column: str = "key", **new) -> DataFrame:
    """The log with a record of any size replaced: the old one is marked dead and the new one appended at the end."""
    if key_column in new:
        raise UsageError("a replacement keeps its key", key=new[key_column])
    end = log.agg((F.max("record_ord") + 1).alias("_end"))
    fresh = log.where(F.col("record_ord") == place).crossJoin(F.broadcast(end))  # one row by one row
    for name, value in {**new, "sequence": next_sequence}.items():
        fresh = fresh.withColumn(name, F.lit(value).cast(log.schema[name].dataType))
    fresh = fresh.withColumn("record_ord", F.col("_end")).drop("_end")
    return mark_dead(log, F.col("record_ord") == place).unionByName(fresh.select(*log.columns))


def mark_dead(log: DataFrame, where: Column) -> DataFrame:
    """Flags records dead. The flag is advice: reads still see them until the log is defragmented."""
    return log.withColumn("is_dead", F.col("is_dead") | F.coalesce(where, F.lit(False)))


def defragment(log: DataFrame) -> DataFrame:
    """The log without dead records, its block chain linked anew, and its key chain where it has one (operations are on none)."""
    live = log.where(~F.col("is_dead"))
    if "prev_same_key" in log.columns:
        on_chain = F.col("kind").isin(PUT, TOMBSTONE)
        live = with_previous(live.withColumn("_on", on_chain), ["_on", "target_block_id", "key"], "record_ord", "prev_same_key")
        live = live.withColumn("prev_same_key", F.when(F.col("_on"), F.col("prev_same_key"))).drop("_on")
    return with_previous(live, ["block_id"], "record_ord", "prev_same_block")


def defragment_report(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("records"), F.count_if("is_dead").alias("dropped"), F.coalesce(F.sum(F.when(F.col("is_dead"), F.col("stored_len"))), F.lit(0)).alias("bytes_dropped"))


def migrate(log: DataFrame, block_id: int, old: int, new: int, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records of a block's old version, converted and marked as the new one; the id stays."""
    rows = log.where((F.col("block_id") == block_id) & (F.col("block_version") == old))
    return convert(rows).withColumn("block_version", F.lit(new))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fields that older records lack, at their declared defaults."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df
