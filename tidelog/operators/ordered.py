"""Ordinals, predecessors and running sums along a log's order, without one task for a whole group.

A window over (group, order) would put all records of a group, perhaps a third of the log, in one
task. So the order is cut into stretches: each is worked on by itself, one row of it is carried over to
the later ones by a window over stretches only, and both are joined. Stretches are ranges of the order
value, so they need no sort of the whole; their width follows how densely rows lie between the least and the
greatest value (one aggregate), so orders with gaps, such as times, have stretches of as many rows on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 100_000


def _stretched(df: DataFrame, order: str, stretch: int) -> DataFrame:
    low, high, n = df.agg(F.min(order).cast("double"), F.max(order).cast("double"), F.count(order)).head()
    width = max(float(stretch), (high - low + 1) * stretch / n) if n else float(stretch)
    return df.withColumn("_s", F.floor(F.col(order) / width))


def _carried(sums: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, value.over(window))


def _join(df: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "_s"]
    right = carried.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in carried.columns if c not in keys])
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return df.join(right, condition).drop(*[f"_j{i}" for i in range(len(keys))])


def with_ordinal(df: DataFrame, by: list[str], order: str, name: str = "ordinal", stretch: int = STRETCH) -> DataFrame:
    """The rows with their position, from 0, in their group's order."""
    cut = _stretched(df, order, stretch)
    counts = cut.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    before = _carried(counts, by, F.sum("_n"), "_before").drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_s").orderBy(order))
    out = _join(cut.withColumn("_r", inside), before, by)
    return out.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_r") - 1).cast("long")).drop("_s", "_r", "_before")


def with_previous(df: DataFrame, by: list[str], order: str, name: str = "previous", stretch: int = STRETCH) -> DataFrame:
    """The rows with the order value of the row before them in their group; null for the first."""
    cut = _stretched(df, order, stretch)
    tails = cut.groupBy(*by, "_s").agg(F.max(order).alias("_tail"))
    before = _carried(tails, by, F.max("_tail"), "_before").drop("_tail")
    inside = F.lag(order).over(Window.partitionBy(*by, "_s").orderBy(order))
    out = _join(cut.withColumn("_r", inside), before, by)
    return out.withColumn(name, F.coalesce("_r", "_before")).drop("_s", "_r", "_before")


def with_running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str = "offset", stretch: int = STRETCH) -> DataFrame:
    """The rows with the sum of a value over the rows before them in their group."""
    cut = _stretched(df, order, stretch)
    sums = cut.groupBy(*by, "_s").agg(F.sum(value).alias("_sum"))
    before = _carried(sums, by, F.sum("_sum"), "_before").drop("_sum")
    inside = F.sum(value).over(Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = _join(cut.withColumn("_r", inside), before, by)
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce("_r", F.lit(0))).drop("_s", "_r", "_before")


def with_last_seen(df: DataFrame, by: list[str], order: str, value: str, name: str = "carried", stretch: int = STRETCH) -> DataFrame:
    """The rows with the last non-null value up to and with them in their group's order."""
    cut = _stretched(df, order, stretch)
    found = cut.groupBy(*by, "_s").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = _carried(found, by, F.last("_last", ignorenulls=True), "_before").drop("_last")
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "_s").orderBy(order))
    out = _join(cut.withColumn("_r", inside), before, by)
    return out.withColumn(name, F.coalesce("_r", "_before")).drop("_s", "_r", "_before")
