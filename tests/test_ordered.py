"""Stretched ordinals, predecessors, sums and carried values against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import ordered


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_equal_to_windows(spark, stretch):
    rnd = random.Random(stretch)
    places = sorted(rnd.sample(range(500), 200))
    rows = [(rnd.choice(["a", "b", None]), p, rnd.randrange(9), rnd.choice([None, float(p)])) for p in places]
    df = spark.createDataFrame(rows, "g string, o long, v long, x double")
    w = Window.partitionBy("g").orderBy("o")
    want = df.select("o", (F.row_number().over(w) - 1).alias("n"), F.lag("o").over(w).alias("p"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.last("x", ignorenulls=True).over(w).alias("c"))
    got = ordered.with_ordinal(df, ["g"], "o", "n", stretch)
    got = ordered.with_previous(got, ["g"], "o", "p", stretch)
    got = ordered.with_running_sum(got, ["g"], "o", "v", "s", stretch)
    got = ordered.with_last_seen(got, ["g"], "o", "x", "c", stretch).select("o", "n", "p", "s", "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
