"""Keyed state: latest values, lookups and ordered folds.

Latest values are a partial aggregate by key (max_by over the logical order), so a hot key is a row a task
before the shuffle. A fold of associative operations starts from each key's last put and adds what
came later. That join deals a key's operations over ``SALTS`` tasks, and what leaves it is aggregated in each
before the last shuffle, so a key with a third of the log is no task's load. Only folds that are neither associative nor
commutative bring a key's suffix together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import with_last_seen
from tidelog.plans.envelope import OP, PUT, TOMBSTONE, logical
from tidelog.plans.errors import MissingTarget, UsageError


SALTS = 16


def _no_null_keys(log: DataFrame, keys: list[str]) -> DataFrame:
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    bad = F.raise_error(F.lit(f"[{UsageError.__name__}] a key is null"))
    return log.where(F.when(null, bad.cast("boolean")).otherwise(F.lit(True)))


def states(log: DataFrame, keys: list[str] = ("key",), carry: tuple[str, ...] = ("value",)) -> DataFrame:
    """The last put or tombstone of each key: key, kind, sequence, record_ord and the carried columns."""
    keys = list(keys)
    resets = _no_null_keys(log.where(F.col("kind").isin(PUT, TOMBSTONE)), keys)
    last = resets.groupBy(*keys).agg(F.max_by(F.struct("kind", "shard_ord", "sequence", "record_ord", *carry), logical()).alias("s"))
    return last.select(*keys, "s.*")


def latest(log: DataFrame, keys: list[str] = ("key",), carry: tuple[str, ...] = ("value",)) -> DataFrame:
    """The latest put of each live key. Operations don't count."""
    return states(log, keys, carry).where(F.col("kind") == PUT).drop("kind")


def get(log: DataFrame, **key) -> DataFrame:
    """The latest put of one key; the filter reaches the scan."""
    for k, v in key.items():
        log = log.where(F.col(k) == v)
    return latest(log, list(key))


def lookup(log: DataFrame, wanted: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """Each wanted key's state: Missing, Put or Tombstone, with its place and sequence."""
    keys = list(keys)
    found = states(log.join(wanted.select(*keys).distinct(), keys, "left_semi"), keys)
    state = F.when(F.col("kind").isNull(), "Missing").when(F.col("kind") == PUT, "Put").otherwise("Tombstone")
    return wanted.select(*keys).join(found, keys, "left").select(*keys, state.alias("state"), "sequence", "record_ord")


def history(log: DataFrame) -> DataFrame:
    """Every put, of deleted keys too."""
    return log.where(F.col("kind") == PUT)


def key_tails(log: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """The newest place of each key, puts and tombstones."""
    return log.where(F.col("kind").isin(PUT, TOMBSTONE)).groupBy(*keys).agg(F.max("record_ord").alias("tail"))


def distinct_keys_ever(log: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """How many keys ever had a put or tombstone, exactly."""
    return log.where(F.col("kind").isin(PUT, TOMBSTONE)).select("target_block_id", *keys).distinct().agg(F.count("*").alias("keys_ever"))


def _live_operations(log: DataFrame, keys: list[str], orphans: str) -> tuple[DataFrame, DataFrame]:
    """(last states, operations after their key's last put)."""
    if orphans not in ("raise", "skip", "ignore"):
        raise UsageError("orphans are 'raise', 'skip' or 'ignore'", orphans=orphans)
    last = states(log, keys)
    if orphans == "raise":
        check_orphans(log, keys)
    base = last.select(*keys, F.col("kind").alias("_k"), logical().alias("_at"))
    base = base.where(F.col("_k") == PUT).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ops = log.where(F.col("kind") == OP).withColumn("_salt", F.pmod(F.xxhash64("sequence", "record_ord"), F.lit(SALTS).cast("long")))
    ops = ops.join(base, [*keys, "_salt"]).where(logical() > F.col("_at")).drop("_k", "_at", "_salt")
    return last, ops


def orphans_of(log: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """Operations that have no live put before them: the last reset, carried along each key's order, is none or a tombstone.

    The order is cut into stretches, so a hot key's records are not one task.
    """
    keys = list(keys)
    span = (log.agg(F.max("sequence")).head()[0] or 0) + 1
    rows = log.where(F.col("kind").isin(PUT, OP, TOMBSTONE)).withColumn("_o", F.col("shard_ord") * span + F.col("sequence"))
    rows = rows.withColumn("_k", F.when(F.col("kind") != OP, F.col("kind")))
    rows = with_last_seen(rows, keys, "_o", "_k", "_reset")
    return rows.where((F.col("kind") == OP) & ~F.col("_reset").eqNullSafe(PUT)).drop("_o", "_k", "_reset")


def check_orphans(log: DataFrame, keys: list[str] = ("key",)) -> None:
    if bad := orphans_of(log, keys).limit(1).collect():
        raise MissingTarget("an operation has no live record before it", key={k: bad[0][k] for k in keys}, sequence=bad[0]["sequence"])


def materialize_sum(log: DataFrame, keys: list[str] = ("key",), value: str = "value", orphans: str = "raise") -> DataFrame:
    """The current value of each live key where operations add: last put plus what came after it."""
    keys = list(keys)
    last, ops = _live_operations(log, keys, orphans)
    added = ops.groupBy(*keys).agg(F.sum(value).alias("_added"), F.count("*").alias("operations"))
    live = last.where(F.col("kind") == PUT)
    return live.join(added, keys, "left").select(*keys, (F.col(value) + F.coalesce("_added", F.lit(0))).alias(value), F.coalesce("operations", F.lit(0)).alias("operations"))


def materialize_last(log: DataFrame, keys: list[str] = ("key",), value: str = "value", orphans: str = "raise") -> DataFrame:
    """The current value of each live key where operations replace it."""
    keys = list(keys)
    last, ops = _live_operations(log, keys, orphans)
    set_to = ops.groupBy(*keys).agg(F.max_by(value, logical()).alias("_set"), F.count("*").alias("operations"))
    live = last.where(F.col("kind") == PUT)
    return live.join(set_to, keys, "left").select(*keys, F.when(F.col("operations") > 0, F.col("_set")).otherwise(F.col(value)).alias(value), F.coalesce("operations", F.lit(0)).alias("operations"))


def materialize_fold(log: DataFrame, step: Callable[[Column, Column], Column], keys: list[str] = ("key",), value: str = "value", orphans: str = "raise") -> DataFrame:
    """The current value of each live key under any ordered step (state, operation) -> state, as SQL expressions.

    Operations after a key's last put are gathered in its row, which bounds a key by one row's memory;
    use the sums above where the step allows.
    """
    keys = list(keys)
    last, ops = _live_operations(log, keys, orphans)
    gathered = ops.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(logical().alias("at"), F.col(value).alias("v")))).alias("_ops"))
    live = last.where(F.col("kind") == PUT).join(gathered, keys, "left")
    kind = log.schema[value].dataType.simpleString()
    folded = F.aggregate(F.coalesce("_ops", F.expr(f"cast(array() as array<struct<at:struct<shard_ord:int,sequence:bigint,record_ord:bigint>,v:{kind}>>)")), F.col(value), lambda s, o: step(s, o.v))
    return live.select(*keys, folded.alias(value))
