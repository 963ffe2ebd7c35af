"""Supplements on rows and plans that the test tables don't have."""

import re

from tidelog.operators import relational


def lineitem(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), "l_returnflag string, l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return relational.approximate(spark, str(tmp_path))


def test_sketches_are_not_kept_for_each_order(spark, tmp_path):
    df = lineitem(spark, tmp_path, *(("AN"[i % 2], i // 3, float(i % 50)) for i in range(600)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = [x for x in re.findall(r"Aggregate\(keys=\[(.*?)\], functions=\[(.*?)\], output", plan) if "approx" in x[1]]
    assert keys and not [k for k, _ in keys if "l_orderkey" in k]
    assert sorted(map(tuple, df.collect())) == [("A", 200, True), ("N", 200, True)]


def test_flags_and_quantities_that_are_null(spark, tmp_path):
    df = lineitem(spark, tmp_path, (None, 1, 5.0), (None, 2, None), (None, None, 7.0), ("A", 3, None), ("A", 3, None), ("N", None, 1.0))
    assert {r["l_returnflag"]: (r["orders"], r["close"]) for r in df.collect()} == {None: (2, True), "A": (1, True), "N": (0, True)}
