"""What of a log is visible: commit markers, recovery, generations, snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.errors import CorruptData, StaleCursor, UsageError


def committed(log: DataFrame, marker: Column | None = None) -> DataFrame:
    """Records up to the last commit marker, by place in the file; none where no marker is."""
    marker = F.col("kind") == "COMMIT" if marker is None else marker
    end = log.where(marker).agg(F.max("record_ord").alias("_end"))
    return log.join(F.broadcast(end), F.col("record_ord") <= F.col("_end")).drop("_end")  # one row


def boundaries(log: DataFrame, every: int, by: str = "record_ord") -> DataFrame:
    """Commit points of a policy that commits after so many records: (batch, last place, records)."""
    from tidelog.operators.ordered import with_ordinal

    numbered = with_ordinal(log.withColumn("_all", F.lit(0)), ["_all"], by, "_n")
    return numbered.groupBy(F.floor(F.col("_n") / every).alias("batch")).agg(F.max(by).alias("boundary"), F.count("*").alias("records"))


def immediate(log: DataFrame, records: int | None = None, nbytes: int | None = None, when: Column | None = None) -> DataFrame:
    """The log with ``commits``: whether a boundary falls on a record.

    A boundary falls where so many records or bytes are pending since the last one, whichever rule raised that,
    or where the predicate holds. Predicate hits part the log into runs that are worked on by themselves. Records
    are counted by ordinals; bytes depend on where the boundary before fell, so a run's places and lengths, two
    numbers a record, go by in one task in order.
    """
    from tidelog.operators.ordered import with_ordinal, with_running_sum

    out = log.withColumn("_all", F.lit(0)).withColumn("_hit", F.coalesce(when, F.lit(False)) if when is not None else F.lit(False))
    out = with_running_sum(out.withColumn("_one", F.col("_hit").cast("int")), ["_all"], "record_ord", "_one", "_run") if when is not None else out.withColumn("_run", F.lit(0))
    if nbytes is None:
        hit = F.col("_hit")
        if records:
            out = with_ordinal(out, ["_run"], "record_ord", "_n")
            hit = hit | ((F.col("_n") + 1) % records == 0)
        return out.withColumn("commits", hit).drop("_all", "_hit", "_one", "_run", "_n")

    def walk(batches):
        import pyarrow as pa

        run, pending, held = None, 0, 0
        for batch in batches:
            found = []
            for r, place, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != run:
                    run, pending, held = r, 0, 0
                pending, held = pending + 1, held + (size or 0)
                if held >= nbytes or records and pending >= records:
                    found.append(place)
                    pending, held = 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["_at"])

    narrow = out.select(F.col("_run").cast("long").alias("_run"), "record_ord", "stored_len")
    found = narrow.repartition("_run").sortWithinPartitions("_run", "record_ord").mapInArrow(walk, "_at long")
    met = out.join(found, F.col("record_ord") == F.col("_at"), "left")
    return met.withColumn("commits", F.col("_hit") | F.col("_at").isNotNull()).drop("_all", "_hit", "_one", "_run", "_at")


def recover(log: DataFrame, policy: str = "strict") -> DataFrame:
    """The log under a recovery policy. A record is whole if its checksum holds; what follows a broken one is the tail."""
    broken = F.coalesce(F.crc32("payload") != F.col("checksum"), F.lit(True))
    first = log.where(broken).agg(F.min("record_ord").alias("_cut"))
    out = log.join(F.broadcast(first), how="left", on=F.lit(True))  # one row
    inside = F.col("_cut").isNull() | (F.col("record_ord") < F.col("_cut"))
    if policy == "strict":
        bad = F.raise_error(F.concat(F.lit(f"[{CorruptData.__name__}] record "), F.col("_cut").cast("string"), F.lit(" is broken")))
        return out.where(F.when(inside, F.lit(True)).otherwise(bad.cast("boolean"))).drop("_cut")
    if policy == "truncate_tail":
        return out.where(inside).drop("_cut")
    if policy == "mark_tail":
        return out.withColumn("is_dead", F.col("is_dead") | ~inside).drop("_cut")
    raise UsageError("unknown recovery policy", policy=policy)


def recovery_report(log: DataFrame) -> DataFrame:
    """A row: original and recovered length, records preserved."""
    kept = recover(log, "truncate_tail").agg(F.sum("stored_len").alias("recovered_len"), F.count("*").alias("records_preserved"))
    return log.agg(F.sum("stored_len").alias("original_len")).join(kept)  # a row by a row


def as_of(log: DataFrame, generation: int) -> DataFrame:
    """What a reader that is pinned to a generation sees."""
    return log.where(F.col("generation") <= generation)


def confirmed(log: DataFrame, pointer: int) -> DataFrame:
    """The log without generations that were never published: restores the last checkpoint."""
    return as_of(log, pointer)


def followed(log: DataFrame, old: int, new: int) -> DataFrame:
    """Records that following from one generation to a later one adds."""
    if new < old:
        raise StaleCursor("a snapshot never goes back", old=old, new=new)
    return log.where((F.col("generation") > old) & (F.col("generation") <= new))


def snapshot_lag(log: DataFrame, generation: int) -> DataFrame:
    """A row: a pinned generation, the latest one, and the records and bytes between."""
    late = F.col("generation") > generation
    return log.agg(F.lit(generation).cast("long").alias("pinned"), F.max("generation").cast("long").alias("latest"), F.count_if(late).alias("lag_records"), F.coalesce(F.sum(F.when(late, F.col("stored_len"))), F.lit(0)).alias("lag_bytes"))


@dataclass(frozen=True)
class Cursor:
    """Where a reader of one log stands. ``log_id`` is the log's own, ``published`` the id of the publication that was read."""

    log_id: str
    generation: int
    published: str = ""


def follow_events(log: DataFrame, cursor: Cursor, log_id: str, generation: int, published: str = "", block_id: int | None = None) -> tuple[Cursor, DataFrame]:
    """(the cursor moved on, records after it up to a generation, of one block or all).

    A cursor of another log is refused, and one whose generation was published anew with other contents.
    """
    if cursor.log_id != log_id:
        raise StaleCursor("the cursor belongs to another log", cursor=cursor.log_id, log=log_id)
    if cursor.generation == generation and cursor.published and published and cursor.published != published:
        raise StaleCursor("the generation was republished", generation=generation)
    new = followed(log, cursor.generation, generation)
    return Cursor(log_id, generation, published), new if block_id is None else new.where(F.col("block_id") == block_id)


@dataclass
class Snapshot:
    """A reader's handle on a growing log: pinned until it follows."""

    log: DataFrame
    generation: int
    released: bool = False

    def read(self) -> DataFrame:
        return as_of(self.log, self.generation)

    def follow(self, generation: int) -> DataFrame:
        """Adopts a later generation and returns what it adds; an error leaves the handle as it was."""
        new = followed(self.log, self.generation, generation)
        self.generation = generation
        return new

    def is_current(self) -> bool:
        return self.log.agg(F.max("generation")).head()[0] <= self.generation

    def release(self) -> None:
        """Key reads fail from now on; scans go on."""
        self.released = True

    def latest(self) -> DataFrame:
        from tidelog.operators.keyed import latest

        if self.released:
            raise StaleCursor("the snapshot was released")
        return latest(self.read())
