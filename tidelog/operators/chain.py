"""History chains, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import with_previous
from tidelog.plans.envelope import PUT, TOMBSTONE
from tidelog.plans.errors import CorruptData


def block_chain(log: DataFrame, block_id: int) -> DataFrame:
    """A block's records with the place of the one before each; ordering by place, descending, walks the chain."""
    return with_previous(log.where(F.col("block_id") == block_id), ["block_id"], "record_ord", "prev_same_block")


def key_chain(log: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """Puts and tombstones with the place of the one before each of its key. Operations are on no chain."""
    own = log.where(F.col("kind").isin(PUT, TOMBSTONE))
    return with_previous(own, ["target_block_id", *keys], "record_ord", "prev_same_key")


def walk(chain: DataFrame, link: str, start: int | None = None) -> DataFrame:
    """A chain from a place, or its end, newest first. A link that doesn't lead back fails the query."""
    if start is not None:
        chain = chain.where(F.col("record_ord") <= start)
    bad = F.raise_error(F.lit(f"[{CorruptData.__name__}] a link doesn't lead back"))
    sound = F.coalesce(F.col(link) < F.col("record_ord"), F.lit(True))
    return chain.where(F.when(sound, F.lit(True)).otherwise(bad.cast("boolean"))).orderBy(F.desc("record_ord"))
