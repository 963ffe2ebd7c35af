"""What the operators of this subpackage share: tables, the shared folder, checkpoints."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.paths import shared_path, shared_root


__all__ = ["cut", "drop_table", "drop_tables", "kept_table", "once", "partitions", "pieces", "recording", "shared_path", "shared_root", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, their lineage cut by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text"):
    """The column's text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pieces(batch, column: int, most_rows: int = 500, most_bytes: int = 1 << 20):
    """Slices of a record batch whose texts in a column come to about ``most_bytes``; a longer text has a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    upto = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        done = upto[begin - 1] if begin else 0
        end = min(max(int(np.searchsorted(upto, done + most_bytes, side="right")), begin + 1), begin + most_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def once(df: DataFrame, **columns) -> DataFrame:
    """The rows with more columns, each computed once a row however often it is used.

    A generator of one row stands between, since the optimizer would else copy an expression into
    every place, or every step of a lambda, that refers to it.
    """
    new = F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])
    return df.withColumn("_once", F.explode(F.array(new))).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_once.{k}").alias(k) for k in columns])


#: Paths of the tables that ``kept_table`` wrote, for whoever records them.
_RECORDS: list[list[str]] = []


@contextmanager
def recording(paths: list[str]):
    """Adds the tables that are kept meanwhile to a list."""
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes kept tables that nothing reads any more, wherever the shared folder lies."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def drop_table(table: DataFrame) -> None:
    """Deletes a kept table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        drop_tables(table.sparkSession, [files[0].rsplit("/", 1)[0]])


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to and read from a Parquet table in the shared folder."""
    path = shared_path(df.sparkSession, name)
    if _RECORDS:
        _RECORDS[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
