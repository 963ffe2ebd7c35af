"""Supplements: relational operators over block tables, which Spark gives.

Block tables are DataFrames, so joins, aggregates, windows and set operations apply to them. As-of
joins and sessions are the two that need more than a call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import with_last_seen

MONEY = "decimal(18,2)"


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, name: str = "matched") -> DataFrame:
    """Each left row with the value of the last right row of its group at or before it.

    A union in order and a carried value: no row meets more than one other, and hot groups are cut into
    stretches of the order.
    """
    both = right.select(*by, on, F.col(value).alias("_v"), F.lit(0).alias("_side")).unionByName(left.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_order", F.col(on) * 2 + F.col("_side"))
    return with_last_seen(both, by, "_order", "_v", name).where(F.col("_side") == 1).drop("_side", "_v", "_order")


def sessions(events: DataFrame, by: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key: bursts of events with less than the gap between."""
    return events.groupBy(by, F.session_window(ts, gap)).agg(F.count("*").alias("events")).select(by, F.col("session_window.start").alias("start"), "events")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing(spark, sf_dir):
    price, disc, tax = (F.col(c).cast(MONEY) for c in ("l_extendedprice", "l_discount", "l_tax"))
    rows = _t(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'")
    total = lambda c, n: F.sum(c).cast("double").alias(n)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(total(F.col("l_quantity").cast(MONEY), "sum_qty"), total(price, "sum_base"), total(price * (1 - disc), "sum_disc"), total(price * (1 - disc) * (1 + tax), "sum_charge"), F.count("*").alias("n"))


def shipping_priority(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = _t(spark, sf_dir, "orders").where("o_orderdate < '1995-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = _t(spark, sf_dir, "lineitem").where("l_shipdate > '1995-03-15'").select("l_orderkey", (F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast(MONEY))).alias("r"))
    joined = li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey").agg(F.sum("r").cast("double").alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def forecast(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").where("l_shipdate >= '1994-01-01' and l_shipdate < '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return rows.agg(F.sum(F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast(MONEY)).cast("double").alias("revenue"))


def nation_volume(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")  # fixed dimension tables of 25 and 5 rows
    places = F.broadcast(n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name"))
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("r_name", "n_name").agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("volume"), F.count("*").alias("orders"))


def semi(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def anti(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def full_outer(spark, sf_dir):
    users = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    orders = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return users.join(orders, F.col("user_id") == F.col("o_custkey"), "full").select(F.coalesce("user_id", "o_custkey").alias("id"), "events", "orders")


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with each range (low inclusive, high exclusive) that holds them: both sides meet by equality in buckets of a width.

    A range goes to all buckets that it touches, so the width should be that of a usual range.
    """
    bucket = F.floor(F.col(value) / width)
    touched = F.sequence(F.floor(F.col(low) / width), F.ceil(F.col(high) / width) - 1)
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("_b", F.explode(touched))
    return points.withColumn("_b", bucket).join(spread, "_b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_b")


def range_join(spark, sf_dir):
    """Parts in overlapping price bands, as many as the highest price needs."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    last = p.agg(F.floor(F.max("p_retailprice") / 250).alias("last"))
    bands = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("band")).select("band", (F.col("band") * 250).alias("low"), (F.col("band") * 250 + 400).alias("high"))
    return in_ranges(p, bands, "p_retailprice", "low", "high", 250).groupBy("band").agg(F.count("*").alias("parts"))


def right_outer(spark, sf_dir):
    late = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return late.join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


def grouping_sets(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    sets = [[F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderpriority")], []]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def bag_operations(spark, sf_dir):
    a, b = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    tally = lambda df, op: df.groupBy("id").agg(F.count("*").alias("n")).withColumn("op", F.lit(op))
    return tally(a.intersectAll(b), "both").union(tally(a.exceptAll(b), "first"))


def sliding(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "n", "users")


def approximate(spark, sf_dir):
    """Sketches beside exact figures: the exact ones, and whether the sketch's are within 5 % (distinct) and 2 % of rank (median).

    Two aggregates: in one, the distinct count makes Spark keep both sketches for each flag and order. A flag without quantities has no median to be off.
    """
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"))
    q = rows.groupBy(F.col("l_returnflag").alias("_flag")).agg(F.approx_count_distinct("l_orderkey", 0.01).alias("about"), F.approx_percentile("l_quantity", 0.5, 1000).alias("median"))
    same = F.col("l_returnflag").eqNullSafe(F.col("_flag"))
    q = q.join(F.broadcast(exact), same).select("_flag", "about", "orders", "median")
    met = rows.join(F.broadcast(q), same)  # a row for each of a few flags
    ranks = met.groupBy("l_returnflag", "about", "orders").agg(F.avg((F.col("l_quantity") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("l_quantity") <= F.col("median")).cast("int")).alias("upto"))
    close = (F.abs(F.col("about") - F.col("orders")) <= 0.05 * F.col("orders")) & F.coalesce((F.col("below") <= 0.52) & (F.col("upto") >= 0.48), F.lit(True))
    return ranks.select("l_returnflag", "orders", close.alias("close"))


def asof(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return asof_join(e.where("event_type = 'click'").select("event_id", "user_id"), e.where("event_type = 'purchase'"), ["user_id"], "event_id", "value", "last_purchase").select("event_id", "user_id", "last_purchase")


def cube(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def rollup(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return o.rollup("y", "o_orderstatus").agg(F.count("*").alias("n"))


def distinct_count(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def ranking(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _t(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey", F.col("r").cast("long").alias("r"))


def frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _t(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.max("value").over(w.rowsBetween(-2, 0)).alias("top3"))


def set_operations(spark, sf_dir):
    a, b = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return a.intersect(b).withColumn("op", F.lit("both")).union(a.subtract(b).withColumn("op", F.lit("first"))).union(b.subtract(a).withColumn("op", F.lit("second")))


def top_k(spark, sf_dir):
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def tumbling(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessionized(spark, sf_dir):
    return sessions(_t(spark, sf_dir, "events"), "user_id", "ts")


def functions(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.upper("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.hour("ts").cast("long").alias("hour"), F.length("props").cast("long").alias("n"), F.abs(F.floor("value")).cast("long").alias("whole"))


def array_functions(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.array_max("embedding").alias("top"), F.array_min("embedding").alias("low"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


_DISC = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
SUPPLEMENTS = {
    "s_pricing": (pricing, f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base, CAST(sum({_DISC}) AS DOUBLE) AS sum_disc, CAST(sum({_DISC} * (1 + CAST(l_tax AS DECIMAL(10,2)))) AS DOUBLE) AS sum_charge, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2"),
    "s_shipping_priority": (shipping_priority, f"SELECT l_orderkey, CAST(sum({_DISC}) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15' GROUP BY 1 ORDER BY revenue DESC, l_orderkey LIMIT 10"),
    "s_forecast": (forecast, "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= '1994-01-01' AND l_shipdate < '1995-01-01' AND l_discount BETWEEN CAST(0.05 AS DOUBLE) AND CAST(0.07 AS DOUBLE) AND l_quantity < 24"),
    "s_nation_volume": (nation_volume, "SELECT r_name, n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS volume, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "s_semi_join": (semi, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "s_anti_join": (anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "s_full_join": (full_outer, "SELECT coalesce(user_id, o_custkey) AS id, events, orders FROM (SELECT user_id, count(*) AS events FROM events GROUP BY 1) FULL JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON user_id = o_custkey"),
    "s_range_join": (range_join, "SELECT band, count(*) AS parts FROM part JOIN (SELECT unnest(range(CAST(max(floor(p_retailprice / 250)) AS BIGINT) + 1)) AS band FROM part) ON p_retailprice >= band * 250 AND p_retailprice < band * 250 + 400 GROUP BY 1"),
    "s_right_join": (right_outer, "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN customer ON o_custkey = c_custkey"),
    "s_grouping_sets": (grouping_sets, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"),
    "s_bag_operations": (bag_operations, "SELECT id, count(*) AS n, 'both' AS op FROM (SELECT o_custkey AS id FROM orders INTERSECT ALL SELECT user_id FROM events) GROUP BY 1 UNION ALL SELECT id, count(*), 'first' FROM (SELECT o_custkey AS id FROM orders EXCEPT ALL SELECT user_id FROM events) GROUP BY 1"),
    "s_sliding": (sliding, "SELECT start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS start FROM events) GROUP BY 1"),
    "s_approximate": (approximate, "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS close FROM lineitem GROUP BY 1"),
    "s_asof_join": (asof, "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events QUALIFY event_type = 'click'"),
    "s_cube": (cube, "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "s_rollup": (rollup, "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)"),
    "s_distinct": (distinct_count, "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1"),
    "s_ranking": (ranking, "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 3"),
    "s_frames": (frames, "SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "s_set_operations": (set_operations, "SELECT id, 'both' AS op FROM (SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT id, 'first' FROM (SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events) UNION ALL SELECT id, 'second' FROM (SELECT user_id AS id FROM events EXCEPT SELECT o_custkey FROM orders)"),
    "s_top_k": (top_k, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "s_tumbling": (tumbling, "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "s_sessions": (sessionized, "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"),
    "s_functions": (functions, "SELECT event_id, upper(event_type) AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, hour(ts) AS hour, length(props) AS n, CAST(abs(floor(value)) AS BIGINT) AS whole FROM events"),
    "s_arrays": (array_functions, "SELECT vec_id, list_max(embedding) AS top, list_min(embedding) AS low, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings"),
}
