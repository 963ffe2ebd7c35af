"""Following a log as a stream.

Generations are what a checkpointed query's offsets are: a query that runs to the end (availableNow)
adopts all that is published and resumes from there. Latest values are kept either by the
streaming aggregate (max_by over the sequence, state by key) or by a processor whose state refuses what is older.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.plans.envelope import PUT, TOMBSTONE


def follow(spark: SparkSession, path: str, schema, block_id: int | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The stream of a log's records, of one block if given."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows if block_id is None else rows.where(F.col("block_id") == block_id)


def drain(rows: DataFrame, out: str, checkpoint: str) -> int:
    """Appends what is new since the checkpoint to a table; how many rows that was."""
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def latest_stream(rows: DataFrame, keys: list[str] = ("key",), value: str = "value") -> DataFrame:
    """The last put or tombstone of each key, as a streaming aggregate; use update or complete mode."""
    resets = rows.where(F.col("kind").isin(PUT, TOMBSTONE))
    last = resets.groupBy(*keys).agg(F.max_by(F.struct("kind", "sequence", value), "sequence").alias("s"))
    return last.select(*keys, "s.*")


def latest_with_state(rows: DataFrame, value: str = "value") -> DataFrame:
    """The same by a state of its own: (sequence, kind, value) by key, which what is older never replaces.

    Input order within a micro-batch doesn't matter.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, kind, v = state.get if state.exists else (-1, "", 0.0)
        for f in frames:
            top = f.loc[f["sequence"].idxmax()]
            if top["sequence"] > sequence:
                sequence, kind, v = int(top["sequence"]), str(top["kind"]), float(top[value])
        state.update((sequence, kind, v))
        yield pd.DataFrame({"key": [key[0]], "kind": [kind], "sequence": [sequence], value: [v]})

    resets = rows.where(F.col("kind").isin(PUT, TOMBSTONE)).select("key", "kind", "sequence", F.col(value).cast("double").alias(value))
    return resets.groupBy("key").applyInPandasWithState(step, f"key long, kind string, sequence long, {value} double", f"sequence long, kind string, {value} double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(rows: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are dropped."""
    counts = rows.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), by, "n")


def publish_each(rows: DataFrame, checkpoint: str, commit: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs a post-commit hook for each micro-batch, once it is durable; the batch number makes it idempotent."""
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a query to the end and returns its result table (for bounded results, such as tests)."""
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.table(name)
