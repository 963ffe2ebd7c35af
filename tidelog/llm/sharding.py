"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked, all rows are sorted by fractional
rank ((rank - 1/2) / size of the source), and the order is cut into shards whose row counts differ by one
at most; so each shard holds each source in its share of the whole, to within a row.

No source, however large, is ranked in one task: ranks within a source come from hash-prefix buckets
(count the buckets, sum up, rank inside a bucket), and places in the whole order from buckets of the
fractional rank, which are even by construction. Texts never move: their size and checksum are taken at
the scan.

Defined results: a null text has no bytes (size 16, checksum 0); null is a source of its own;
rows with equal keys, and repeated rows, are dealt as rows of their own, ties broken by checksum and
size; equal texts need not share a shard; an empty table gives an empty table; other columns are
neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import cut

BUCKET = 20_000


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard), one for each document."""
    if shards < 1:
        raise ValueError("there must be a shard")
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    base = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc"),
        shuffled.alias("h"),
    )
    base = cut(base)
    n = base.count()
    buckets = max(1, -(-n // BUCKET))
    spread = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / float(16**12)
    base = base.withColumn("bucket", F.floor(spread * buckets))

    counts = base.groupBy("stratum", "bucket").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("stratum")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "bucket", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("all"))
    inside = Window.partitionBy("stratum", "bucket").orderBy("h", "key", "crc", "size")
    ranked = base.withColumn("r", F.row_number().over(inside)).join(counts, ["stratum", "bucket"])
    ranked = ranked.select("key", "size", "crc", "stratum", (F.col("r") + F.col("before")).alias("rank"), "all")
    ranked = cut(ranked.withColumn("part", (2 * F.col("rank") - 1) / (2 * F.col("all"))).withColumn("bucket", F.floor(F.col("part") * buckets)))

    sums = ranked.groupBy("bucket").agg(F.count("*").alias("rows"))  # one row for each BUCKET rows of input
    sums = sums.select("bucket", F.coalesce(F.sum("rows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("part", "stratum", "rank"))
    placed = ranked.withColumn("r", place).join(sums, "bucket").withColumn("at", F.col("r") + F.col("before") - 1)
    placed = placed.withColumn("shard", F.expr(f"at * {shards} div {max(n, 1)}"))
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
