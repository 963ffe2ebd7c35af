"""The envelope: the columns that every record of a log has, and a log made from the events table.

Two orders exist and are never mixed. Physical: ``record_ord``, the place in the file (scans,
positions, chains, commit visibility). Logical: (``shard_ord``, ``sequence``, ``record_ord``) (latest
values, folds, merges). They part after a replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, OP, TOMBSTONE, META, COMMIT = "PUT", "OP", "TOMBSTONE", "META", "COMMIT"
DEFAULTS = {
    "shard_ord": "0", "sequence": "0L", "record_ord": "0L", "block_id": "0L", "block_version": "1", "flags": "0", "kind": "'PUT'",
    "target_block_id": "block_id", "stored_len": "0L", "checksum": "cast(null as bigint)", "is_dead": "false", "generation": "0L",
}
#: Block ids of the events binding, by event type.
EVENT_BLOCKS = {"signup": 10, "purchase": 20, "view": 30, "click": 40, "error": 50}


def logical(*, prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in ("shard_ord", "sequence", "record_ord")])


def enveloped(df: DataFrame) -> DataFrame:
    """The rows with whatever envelope columns they lack."""
    for name, default in DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(default))
    return df


def event_log(events: DataFrame, blocks: tuple[int, ...] | None = None) -> DataFrame:
    """Events as a log: signup and purchase put a value for the user, view and click add to it, error removes it.

    Where only some blocks are wanted, their event types are a filter that reaches the scan.
    """
    if blocks is not None:
        events = events.where(F.col("event_type").isin([t for t, b in EVENT_BLOCKS.items() if b in blocks]))
    kind = F.when(F.col("event_type").isin("signup", "purchase"), PUT).when(F.col("event_type").isin("view", "click"), OP).otherwise(TOMBSTONE)
    block = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_BLOCKS.items() for x in kv]), F.col("event_type")).cast("long")
    log = events.select(
        (F.col("event_id") % 3).cast("int").alias("shard_ord"), F.col("event_id").alias("sequence"), F.col("event_id").alias("record_ord"), block.alias("block_id"), F.lit(1).alias("block_version"), kind.alias("kind"),
        F.lit(1).cast("long").alias("target_block_id"), F.col("user_id").alias("key"), F.col("value"), F.col("ts"), F.octet_length("props").cast("long").alias("stored_len"), F.crc32("props").alias("checksum"), F.col("props").alias("payload"),
    )
    return enveloped(log)
