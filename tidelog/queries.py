"""The engine's queries by name, and DuckDB SQL for each that SQL can express.

The event log binding is that of ``tidelog.plans.envelope.event_log``; commit markers are events whose
id is a multiple of 777, generations are runs of 1000 records, matrices are made of embeddings
(scan: vector, channel: position), segments of conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import chain, keyed, matrix, merge, relational, scan, segments, visibility
from tidelog.operators.ordered import with_ordinal
from tidelog.plans import spec
from tidelog.plans.envelope import event_log
from tidelog.plans.paths import shared_path
from tidelog.sources import layout, logfile
from tidelog.sources.store import LogStore
from tidelog.streaming import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The log as SQL.
LOG = """log AS (
  SELECT CAST(event_id % 3 AS INTEGER) AS shard_ord, event_id AS sequence, event_id AS record_ord, user_id AS key, value, ts, event_type, props, CAST(strlen(props) AS BIGINT) AS stored_len,
    CASE event_type WHEN 'signup' THEN 10 WHEN 'purchase' THEN 20 WHEN 'view' THEN 30 WHEN 'click' THEN 40 ELSE 50 END AS block_id,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type IN ('view', 'click') THEN 'OP' ELSE 'TOMBSTONE' END AS kind,
    event_id // 1000 AS generation
  FROM events)"""
#: The last put or tombstone of each key, and operations after a live put.
STATES = f"""{LOG}, states AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shard_ord * 0, sequence DESC) AS rn FROM log WHERE kind <> 'OP') WHERE rn = 1)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def log_of(spark: SparkSession, sf_dir: str, sharded: bool = False, blocks: tuple[int, ...] | None = None) -> DataFrame:
    log = event_log(spark.read.parquet(f"{sf_dir}/events.parquet"), blocks).withColumn("generation", F.floor(F.col("record_ord") / 1000))
    return log if sharded else log.withColumn("shard_ord", F.lit(0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell events: every cell written in generation 0 and committed in 1, every seventh cleared in 2, every 14th written anew in 3."""
    cells = matrix.cells_of_vectors(read(spark, sf_dir, "embeddings")).withColumn("o", F.col("scan") * 64 + F.col("ch"))
    ops = F.array(*[F.struct(F.lit(g).cast("long").alias("generation"), F.lit(op).alias("op"), F.lit(n).alias("n"), F.lit(k).alias("k")) for g, op, n, k in ((0, "WRITE", 1, 1), (1, "COMMIT_CELL", 1, 1), (2, "CLEAR", 7, 1), (3, "WRITE", 14, 2))])
    rows = cells.select("scan", "ch", "value", "o", F.explode(ops).alias("e")).where(F.col("o") % F.col("e.n") == 0)
    payload = F.when(F.col("e.k") == 1, F.col("value")).otherwise(F.col("value") * F.lit(2.0).cast("float")).cast("string").cast("binary")
    return rows.select("e.generation", F.col("o").alias("seq"), "e.op", "scan", "ch", payload.alias("payload"), F.crc32(F.col("value").cast("string").cast("binary")).alias("crc"))


# Scans.


@query("block_scan", f"WITH {LOG} SELECT record_ord, key, value FROM log WHERE block_id = 20")
def _(spark, sf_dir):
    return scan.blocks(log_of(spark, sf_dir, blocks=(20,)), 20, 1).select("record_ord", "key", "value")


@query("event_scan", f"WITH {LOG} SELECT record_ord, block_id, kind, key, stored_len FROM log")
def _(spark, sf_dir):
    return scan.index_entries(scan.events(log_of(spark, sf_dir))).select("record_ord", F.col("block_id").cast("int").alias("block_id"), "kind", "key", "stored_len")


@query("block_get_at", f"WITH {LOG} SELECT record_ord, key, value, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY record_ord) - 1 AS ordinal FROM log WHERE block_id = 20) WHERE ordinal = 42")
def _(spark, sf_dir):
    return scan.get_at(log_of(spark, sf_dir, blocks=(20,)), 20, 42).select("record_ord", "key", "value", "ordinal")


@query("block_ordinals", f"WITH {LOG} SELECT record_ord, CAST(block_id AS BIGINT) AS block_id, row_number() OVER (PARTITION BY block_id ORDER BY record_ord) - 1 AS ordinal FROM log")
def _(spark, sf_dir):
    return with_ordinal(log_of(spark, sf_dir), ["block_id"], "record_ord", stretch=1000).select("record_ord", "block_id", "ordinal")


@query("record_map_find", f"WITH {LOG} SELECT record_ord, key FROM log WHERE kind = 'TOMBSTONE' AND value > 50 ORDER BY record_ord LIMIT 1")
def _(spark, sf_dir):
    return scan.find(log_of(spark, sf_dir), (F.col("kind") == "TOMBSTONE") & (F.col("value") > 50)).select("record_ord", "key")


@query("record_map_fill", f"WITH {LOG} SELECT record_ord, kind FROM log WHERE record_ord > 99 ORDER BY record_ord LIMIT 50")
def _(spark, sf_dir):
    return scan.fill(log_of(spark, sf_dir), 50, after=99).select("record_ord", "kind")


@query("through_directory", f"WITH {LOG} SELECT record_ord, key, value FROM log WHERE record_ord IN (SELECT o_orderkey FROM orders)")
def _(spark, sf_dir):
    return scan.through_directory(log_of(spark, sf_dir), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_ord"))).select("record_ord", "key", "value")


@query("verify_counts", "SELECT count(*) AS records, CAST(0 AS BIGINT) AS damaged, CAST(NULL AS BIGINT) AS first_damaged FROM events")
def _(spark, sf_dir):
    return scan.verify(log_of(spark, sf_dir))


@query("block_tails", f"WITH {LOG} SELECT CAST(block_id AS BIGINT) AS block_id, max(record_ord) AS tail, max(sequence) AS last_sequence, count(*) AS records FROM log GROUP BY block_id")
def _(spark, sf_dir):
    return scan.tails(log_of(spark, sf_dir))


# Keyed state.


@query("keyed_latest", f"WITH {STATES} SELECT key, value, sequence FROM states WHERE kind = 'PUT'")
def _(spark, sf_dir):
    return keyed.latest(log_of(spark, sf_dir)).select("key", "value", "sequence")


@query("keyed_get", f"WITH {STATES} SELECT key, value FROM states WHERE kind = 'PUT' AND key = 7")
def _(spark, sf_dir):
    return keyed.get(log_of(spark, sf_dir), key=7).select("key", "value")


@query("keyed_lookup_state", f"WITH {STATES} SELECT c.c_custkey AS key, CASE WHEN s.kind IS NULL THEN 'Missing' WHEN s.kind = 'PUT' THEN 'Put' ELSE 'Tombstone' END AS state, s.sequence, s.record_ord FROM customer c LEFT JOIN states s ON s.key = c.c_custkey")
def _(spark, sf_dir):
    return keyed.lookup(log_of(spark, sf_dir), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query("keyed_history", f"WITH {LOG} SELECT record_ord, key, value FROM log WHERE kind = 'PUT'")
def _(spark, sf_dir):
    return keyed.history(log_of(spark, sf_dir)).select("record_ord", "key", "value")


@query("keyed_live_count", f"WITH {STATES} SELECT count(*) AS live FROM states WHERE kind = 'PUT'")
def _(spark, sf_dir):
    return keyed.latest(log_of(spark, sf_dir)).agg(F.count("*").alias("live"))


@query("keyed_materialized", f"WITH {STATES} SELECT s.key, round(s.value + coalesce(sum(o.value), 0), 2) AS value, count(o.key) AS operations FROM states s LEFT JOIN log o ON o.key = s.key AND o.kind = 'OP' AND o.sequence > s.sequence WHERE s.kind = 'PUT' GROUP BY s.key, s.value")
def _(spark, sf_dir):
    out = keyed.materialize_sum(log_of(spark, sf_dir), orphans="skip")
    return out.select("key", F.round("value", 2).alias("value"), "operations")


@query("keyed_folded", f"WITH {STATES}, ops AS (SELECT s.key, s.value AS base, list(o.value ORDER BY o.sequence) FILTER (WHERE o.key IS NOT NULL) AS v FROM states s LEFT JOIN log o ON o.key = s.key AND o.kind = 'OP' AND o.sequence > s.sequence WHERE s.kind = 'PUT' GROUP BY s.key, s.value) SELECT key, round(list_reduce(list_prepend(base, coalesce(v, [])), lambda a, x: a / 2 + x), 4) AS value FROM ops")
def _(spark, sf_dir):
    out = keyed.materialize_fold(log_of(spark, sf_dir), lambda s, v: s / 2 + v, orphans="skip")
    return out.select("key", F.round("value", 4).alias("value"))


@query("keyed_set_fold", f"WITH {STATES} SELECT s.key, coalesce(max_by(o.value, o.sequence), s.value) AS value, count(o.key) AS operations FROM states s LEFT JOIN log o ON o.key = s.key AND o.kind = 'OP' AND o.sequence > s.sequence WHERE s.kind = 'PUT' GROUP BY s.key, s.value")
def _(spark, sf_dir):
    return keyed.materialize_last(log_of(spark, sf_dir), orphans="skip")


@query("orphan_operations", f"WITH {LOG} SELECT o.record_ord, o.key FROM log o WHERE o.kind = 'OP' AND coalesce((SELECT max_by(r.kind, r.sequence) FROM log r WHERE r.key = o.key AND r.kind <> 'OP' AND r.sequence < o.sequence), 'none') <> 'PUT'")
def _(spark, sf_dir):
    return keyed.orphans_of(log_of(spark, sf_dir)).select("record_ord", "key")


@query("key_tails", f"WITH {LOG} SELECT key, max(record_ord) AS tail FROM log WHERE kind <> 'OP' GROUP BY key")
def _(spark, sf_dir):
    return keyed.key_tails(log_of(spark, sf_dir))


@query("distinct_keys_ever", f"WITH {LOG} SELECT count(DISTINCT key) AS keys_ever FROM log WHERE kind <> 'OP'")
def _(spark, sf_dir):
    return keyed.distinct_keys_ever(log_of(spark, sf_dir))


# Merge, compact, rewrite.

SHARDED = f"WITH {LOG}, states AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shard_ord DESC, sequence DESC) AS rn FROM log WHERE kind <> 'OP') WHERE rn = 1)"
AFTER = "o.key = s.key AND o.kind = 'OP' AND (o.shard_ord > s.shard_ord OR o.shard_ord = s.shard_ord AND o.sequence > s.sequence)"


@query("shard_merge", f"{SHARDED} SELECT s.key, round(s.value + coalesce(sum(o.value), 0), 2) AS value, count(o.key) AS operations FROM states s LEFT JOIN log o ON {AFTER} WHERE s.kind = 'PUT' GROUP BY s.key, s.value")
def _(spark, sf_dir):
    log = log_of(spark, sf_dir, sharded=True)
    base, *deltas = [log.where(F.col("shard_ord") == i) for i in range(3)]
    return merge.merge(base, *deltas, fold="sum", orphans="skip").select("key", F.round("value", 2).alias("value"), "operations")


@query("shard_compact", f"WITH {STATES} SELECT s.key, coalesce(max_by(o.value, o.sequence), s.value) AS value FROM states s LEFT JOIN log o ON o.key = s.key AND o.kind = 'OP' AND o.sequence > s.sequence WHERE s.kind = 'PUT' GROUP BY s.key, s.value")
def _(spark, sf_dir):
    return merge.compact(log_of(spark, sf_dir), 1, orphans="skip", key_limit=10**9).select("key", "value")


@query("merge_estimate", f"WITH {LOG} SELECT count(*) AS records, count(*) AS key_bearing, count(*) FILTER (WHERE kind = 'PUT') AS keys_at_most, CAST(sum(stored_len) AS BIGINT) AS bytes, max(stored_len) AS largest FROM log")
def _(spark, sf_dir):
    return merge.estimate(log_of(spark, sf_dir))


@query("replace_at", f"WITH {LOG} SELECT record_ord, sequence, CASE WHEN block_id = 10 AND n = 5 THEN 999.0 ELSE value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY record_ord) - 1 AS n FROM log)")
def _(spark, sf_dir):
    return merge.replace_at(log_of(spark, sf_dir), 10, 5, value=999.0).select("record_ord", "sequence", "value")


@query("defragment", f"WITH {LOG} SELECT record_ord, lag(record_ord) OVER (PARTITION BY block_id ORDER BY record_ord) AS prev_same_block FROM log WHERE record_ord % 5 <> 0")
def _(spark, sf_dir):
    dead = merge.mark_dead(log_of(spark, sf_dir), F.col("record_ord") % 5 == 0)
    return merge.defragment(dead).select("record_ord", "prev_same_block")


@query("defragment_report", f"WITH {LOG} SELECT count(*) AS records, count(*) FILTER (WHERE record_ord % 5 = 0) AS dropped, CAST(sum(CASE WHEN record_ord % 5 = 0 THEN stored_len ELSE 0 END) AS BIGINT) AS bytes_dropped FROM log")
def _(spark, sf_dir):
    return merge.defragment_report(merge.mark_dead(log_of(spark, sf_dir), F.col("record_ord") % 5 == 0))


@query("migrate_v1_v2", f"WITH {LOG} SELECT record_ord, CAST(2 AS INTEGER) AS block_version, value * 2 AS value FROM log WHERE block_id = 10")
def _(spark, sf_dir):
    return merge.migrate(log_of(spark, sf_dir), 10, 1, 2, lambda d: d.withColumn("value", F.col("value") * 2)).select("record_ord", "block_version", "value")


# Visibility.


@query("commit_prefix", f"WITH {LOG} SELECT record_ord, key FROM log WHERE record_ord <= (SELECT max(record_ord) FROM log WHERE record_ord % 777 = 0)")
def _(spark, sf_dir):
    return visibility.committed(log_of(spark, sf_dir), F.col("record_ord") % 777 == 0).select("record_ord", "key")


@query("commit_prefix_none", f"WITH {LOG} SELECT record_ord FROM log WHERE false")
def _(spark, sf_dir):
    return visibility.committed(log_of(spark, sf_dir)).select("record_ord")


@query("snapshot_read", f"WITH {LOG} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS rn FROM log WHERE kind <> 'OP' AND generation <= 0) WHERE rn = 1 AND kind = 'PUT'")
def _(spark, sf_dir):
    return visibility.Snapshot(log_of(spark, sf_dir), 0).latest().select("key", "value")


@query("snapshot_follow", f"WITH {LOG} SELECT record_ord, kind FROM log WHERE generation > 0 AND generation <= 5")
def _(spark, sf_dir):
    return visibility.followed(log_of(spark, sf_dir), 0, 5).select("record_ord", "kind")


@query("snapshot_lag", f"WITH {LOG} SELECT CAST(2 AS BIGINT) AS pinned, max(generation) AS latest, count(*) FILTER (WHERE generation > 2) AS lag_records, CAST(coalesce(sum(stored_len) FILTER (WHERE generation > 2), 0) AS BIGINT) AS lag_bytes FROM log")
def _(spark, sf_dir):
    return visibility.snapshot_lag(log_of(spark, sf_dir), 2)


@query("immediate_boundaries", f"WITH {LOG} SELECT batch, max(record_ord) AS boundary, count(*) AS records FROM (SELECT record_ord, (row_number() OVER (ORDER BY record_ord) - 1) // 500 AS batch FROM log) GROUP BY batch")
def _(spark, sf_dir):
    return visibility.boundaries(log_of(spark, sf_dir), 500)


#: The boundaries one after another: the first record at which enough is pending since the last, or the predicate holds.
PENDING = f"""WITH RECURSIVE {LOG}, s AS (SELECT record_ord, sum(stored_len) OVER (ORDER BY record_ord) AS upto, row_number() OVER (ORDER BY record_ord) AS n FROM log),
  b(record_ord, upto, n) AS (
    SELECT CAST(-1 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS BIGINT)
    UNION ALL
    SELECT min(s.record_ord), arg_min(s.upto, s.record_ord), arg_min(s.n, s.record_ord) FROM b JOIN s ON s.record_ord > b.record_ord AND ({{}}) HAVING count(*) > 0)
  SELECT record_ord FROM b WHERE record_ord >= 0"""


@query("immediate_records", PENDING.format("s.n - b.n >= 300 OR s.record_ord % 1000 = 0"))
def _(spark, sf_dir):
    return visibility.immediate(log_of(spark, sf_dir), records=300, when=F.col("record_ord") % 1000 == 0).where("commits").select("record_ord")


@query("immediate_bytes", PENDING.format("s.upto - b.upto >= 4096 OR s.n - b.n >= 400 OR s.record_ord % 1000 = 0"))
def _(spark, sf_dir):
    return visibility.immediate(log_of(spark, sf_dir), nbytes=4096, records=400, when=F.col("record_ord") % 1000 == 0).where("commits").select("record_ord")


@query("recover_truncated", f"WITH {LOG} SELECT record_ord FROM log WHERE record_ord < 800")
def _(spark, sf_dir):
    torn = log_of(spark, sf_dir).withColumn("payload", F.when(F.col("record_ord") >= 800, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    return visibility.recover(torn, "truncate_tail").select("record_ord")


# History.


@query("block_chain", f"WITH {LOG} SELECT record_ord, lag(record_ord) OVER (ORDER BY record_ord) AS prev_same_block FROM log WHERE block_id = 30")
def _(spark, sf_dir):
    return chain.walk(chain.block_chain(log_of(spark, sf_dir), 30), "prev_same_block").select("record_ord", "prev_same_block")


@query("key_chain", f"WITH {LOG} SELECT key, record_ord, lag(record_ord) OVER (PARTITION BY key ORDER BY record_ord) AS prev_same_key FROM log WHERE kind <> 'OP'")
def _(spark, sf_dir):
    return chain.key_chain(log_of(spark, sf_dir)).select("key", "record_ord", "prev_same_key")


# Matrices.

CELLS = "cells AS (SELECT vec_id AS scan, CAST(unnest(generate_series(0, 63)) AS BIGINT) AS ch, unnest(embedding) AS value FROM embeddings), addressed AS (SELECT *, scan * 64 + ch AS o FROM cells)"


@query("matrix_ordinal", f"WITH {CELLS} SELECT scan, ch, o AS ordinal, value FROM addressed")
def _(spark, sf_dir):
    cells = matrix.cells_of_vectors(read(spark, sf_dir, "embeddings"))
    return cells.select("scan", "ch", matrix.Dims(10_000_000, 64, 10**12).ordinal().alias("ordinal"), "value")


@query("matrix_status", f"WITH {CELLS} SELECT scan, ch, o % 7 <> 0 AS committed FROM addressed")
def _(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").count()
    return matrix.status(matrix.state(cells_log(spark, sf_dir)), matrix.Dims(vectors, 64, 10**12)).select("scan", "ch", "committed")


@query("matrix_cell_get", f"WITH {CELLS} SELECT scan, ch FROM addressed WHERE o % 7 <> 0")
def _(spark, sf_dir):
    return matrix.read_cells(matrix.state(cells_log(spark, sf_dir))).select("scan", "ch")


@query("matrix_resume", f"WITH {CELLS} SELECT count(*) FILTER (WHERE o % 7 <> 0) AS committed, count(*) AS total, 'Partial' AS signal FROM addressed")
def _(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").count()
    return matrix.resume(matrix.state(cells_log(spark, sf_dir)), matrix.Dims(vectors, 64, 10**12))


@query("matrix_as_of", f"WITH {CELLS} SELECT scan, count(*) AS committed FROM addressed GROUP BY scan")
def _(spark, sf_dir):
    return matrix.state(cells_log(spark, sf_dir), generation=1).where("committed").groupBy("scan").agg(F.count("*").alias("committed"))


@query("matrix_chunks", f"WITH {CELLS} SELECT scan // 100 AS chunk, count(*) AS cells, count(*) FILTER (WHERE o % 7 <> 0) AS committed FROM addressed GROUP BY 1")
def _(spark, sf_dir):
    state = matrix.state(cells_log(spark, sf_dir))
    return state.groupBy(matrix.chunk_of(100).alias("chunk")).agg(F.count("*").alias("cells"), F.count_if("committed").alias("committed"))


@query("matrix_changed", f"WITH {CELLS} SELECT scan, ch FROM addressed WHERE o % 7 = 0")
def _(spark, sf_dir):
    return matrix.changed(cells_log(spark, sf_dir), 1, 3)


@query("matrix_rebuild", f"WITH {CELLS} SELECT count(*) AS cells, count(*) FILTER (WHERE o % 7 <> 0) AS committed FROM addressed")
def _(spark, sf_dir):
    return matrix.rebuild(matrix.state(cells_log(spark, sf_dir))).agg(F.count("*").alias("cells"), F.count_if("committed").alias("committed"))


@query("matrix_verify_pages", f"WITH {CELLS} SELECT o // 32768 AS page, count(*) AS cells, CAST(0 AS BIGINT) AS damaged, 'None' AS action FROM addressed GROUP BY 1")
def _(spark, sf_dir):
    return matrix.verify_pages(matrix.state(cells_log(spark, sf_dir)), matrix.Dims(10_000_000, 64, 10**12))


# Segments: a conversation is a file, a turn a segment.


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("record_ord"), F.col("role").alias("kind"), F.octet_length("text").cast("long").alias("byte_len"))


@query("segment_index", "SELECT conv_id AS file, turn AS record_ord, role AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS segment_index, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS kind_index FROM conversations")
def _(spark, sf_dir):
    return segments.segment_index(turns(spark, sf_dir)).drop("byte_len")


@query("chunk_index", "SELECT conv_id AS file, turn AS record_ord, strlen(text) AS byte_len, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM conversations")
def _(spark, sf_dir):
    return segments.chunk_index(turns(spark, sf_dir), "file", "record_ord").drop("kind")


@query("segment_reduce", f"WITH {LOG} SELECT record_ord, key, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY record_ord) AS carried FROM log")
def _(spark, sf_dir):
    log = log_of(spark, sf_dir).withColumn("given", F.when(F.col("block_id") == 20, F.col("value")))
    return segments.carry_forward(log, ["key"], "record_ord", "given").select("record_ord", "key", "carried")


@query("latest_properties", f"WITH {LOG} SELECT key, CAST(block_id AS BIGINT) AS block_id, max_by(value, record_ord) AS value FROM log GROUP BY key, block_id")
def _(spark, sf_dir):
    return segments.latest_properties(log_of(spark, sf_dir), ["key", "block_id"], "record_ord", "value")


@query("concat_values", "SELECT label, v AS value, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS sample FROM (SELECT label, vec_id, CAST(unnest(generate_series(0, 63)) AS BIGINT) AS i, unnest(embedding) AS v FROM embeddings)")
def _(spark, sf_dir):
    return segments.concat_values(read(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


@query("segment_fold", "SELECT conv_id AS file, CAST(sum(strlen(text) * (turn + 1)) AS BIGINT) AS state FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("weight", F.col("byte_len") * (F.col("record_ord") + 1))
    return segments.reduce_segments(rows, ["file"], "record_ord", ["weight"], F.lit(0).cast("long"), lambda s, x: s + x.weight)


@query("report_status", f"WITH {LOG} SELECT CAST(block_id AS BIGINT) AS block_id, CASE WHEN max(value) > 100 THEN 'error' WHEN max(value) > 50 THEN 'warning' ELSE 'ok' END AS status, count(*) AS findings FROM log GROUP BY block_id")
def _(spark, sf_dir):
    found = log_of(spark, sf_dir).withColumn("severity", F.when(F.col("value") > 100, "error").when(F.col("value") > 50, "warning").otherwise("info"))
    return segments.roll_up(found, ["block_id"])


# Formats.

STATUS_BLOCK = spec.Block(1, "order_status", (spec.Field("o_orderstatus", "string"), spec.Field("o_orderpriority", "string")), keys=("o_orderstatus", "o_orderpriority"), domain=(("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))


@query("finite_key_codes", "SELECT o_orderkey, CAST((list_position(['F', 'O', 'P'], o_orderstatus) - 1) * 5 + list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1 AS INTEGER) AS code FROM orders")
def _(spark, sf_dir):
    return spec.with_codes(read(spark, sf_dir, "orders"), STATUS_BLOCK).select("o_orderkey", "code")


# Sources, sinks and streams: written to and read from the shared folder.


@query("log_file_scan", f"WITH {LOG} SELECT CAST(block_id AS BIGINT) AS block_id, count(*) AS records, CAST(sum(stored_len) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS damaged FROM log WHERE block_id = 20 GROUP BY block_id")
def _(spark, sf_dir):
    """The log written as framed files and scanned for one block, which the source skips to."""
    logfile.register(spark)
    path = shared_path(spark, "logfile")
    log = log_of(spark, sf_dir).withColumn("payload", F.col("payload").cast("binary"))
    log.write.format("tidelog").mode("append").save(path)
    rows = spark.read.format("tidelog").load(path).where("block_id = 20")
    return rows.groupBy("block_id").agg(F.count("*").alias("records"), F.sum("stored_len").alias("bytes"), F.count_if(F.crc32("payload") != F.col("checksum")).alias("damaged"))


@query("store_generations", f"WITH {LOG} SELECT CAST(shard_ord AS BIGINT) AS generation, count(*) AS records, count(*) FILTER (WHERE kind = 'PUT') AS puts FROM log GROUP BY 1")
def _(spark, sf_dir):
    """Three generations appended to a store and published one by one, then read whole."""
    kept = three_generations(spark, sf_dir)
    rows = kept.read().groupBy("generation").agg(F.count("*").alias("records"), F.count_if(F.col("kind") == "PUT").alias("puts"))
    kept.unlock()
    return rows


@query("codec_round_trip", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def _(spark, sf_dir):
    """Orders as canonical variable payloads and back."""
    fields = (spec.Field("o_orderkey", "i64"), spec.Field("o_orderstatus", "string"), spec.Field("o_custkey", "i64"))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([codec.encode_fields(fields, r) for r in b.to_pylist()], pa.binary())], ["payload"])

    packed = read(spark, sf_dir, "orders").select(*[f.name for f in fields]).mapInArrow(pack, "payload binary")
    return packed.select(codec.decode_column(F.col("payload"), fields).alias("r")).select("r.*")


@query("stream_latest", f"WITH {STATES} SELECT key, kind, sequence, value FROM states")
def _(spark, sf_dir):
    """The log followed as a stream to its end; equal to the batch answer."""
    path = shared_path(spark, "followed")
    log = log_of(spark, sf_dir).select("sequence", "key", "kind", "value")
    log.repartition(4, "sequence").write.parquet(path)
    source = follow.follow(spark, path, log.schema, files_per_batch=2)
    return follow.run_to_table(follow.latest_stream(source), f"latest_{path.rsplit('-', 1)[1]}", shared_path(spark, "offsets"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    """Counts by hour with a watermark; the input is in order, so nothing is late."""
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    counts = follow.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    name = shared_path(spark, "windows")
    table = follow.run_to_table(counts, f"windows_{name.rsplit('-', 1)[1]}", name)
    return table.withColumn("start", F.col("start").cast("timestamp_ntz"))


# Further rows of the inventory.


def torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, broken from record 800 on."""
    broken = F.when(F.col("record_ord") >= 800, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    return log_of(spark, sf_dir).withColumn("payload", broken)


@query("metadata_latest", "SELECT o_orderpriority AS key, max_by(o_orderstatus, o_orderkey) AS payload FROM orders GROUP BY 1")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_ord"), F.lit("META").alias("kind"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("payload"))
    return scan.metadata(rows)


@query("composite_latest", "SELECT o_custkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_orderstatus <> 'P'")
def _(spark, sf_dir):
    """Latest values under a key of two fields; orders of status P delete."""
    kind = F.when(F.col("o_orderstatus") == "P", "TOMBSTONE").otherwise("PUT")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", kind.alias("kind"), F.col("o_orderkey").alias("sequence"), F.col("o_orderkey").alias("record_ord"), F.lit(0).alias("shard_ord"))
    return keyed.latest(rows, ["o_custkey", "o_orderpriority"], ("o_totalprice",)).select("o_custkey", "o_orderpriority", "o_totalprice")


@query("key_walk", f"WITH {LOG} SELECT record_ord, prev_same_key FROM (SELECT key, record_ord, lag(record_ord) OVER (PARTITION BY key ORDER BY record_ord) AS prev_same_key FROM log WHERE kind <> 'OP') WHERE key = 7 AND record_ord <= 5000")
def _(spark, sf_dir):
    return chain.walk(chain.key_chain(log_of(spark, sf_dir)).where("key = 7"), "prev_same_key", start=5000).select("record_ord", "prev_same_key")


@query("shard_merge_set", f"{SHARDED} SELECT s.key, coalesce(max_by(o.value, {{'a': o.shard_ord, 'b': o.sequence}}), s.value) AS value, count(o.key) AS operations FROM states s LEFT JOIN log o ON {AFTER} WHERE s.kind = 'PUT' GROUP BY s.key, s.value")
def _(spark, sf_dir):
    log = log_of(spark, sf_dir, sharded=True)
    return merge.merge(*[log.where(F.col("shard_ord") == i) for i in range(3)], fold="last", orphans="skip", key_limit=10**9)


@query("replace_fixed", f"WITH {LOG} SELECT record_ord, CASE WHEN record_ord = 42 THEN 10000000 ELSE sequence END AS sequence, CASE WHEN record_ord = 42 THEN -1.0 ELSE value END AS value FROM log")
def _(spark, sf_dir):
    return merge.replace_fixed(log_of(spark, sf_dir), 42, 10_000_000, value=-1.0).select("record_ord", "sequence", "value")


@query("recovery_report", f"WITH {LOG} SELECT CAST(sum(stored_len) AS BIGINT) AS original_len, CAST(sum(stored_len) FILTER (WHERE record_ord < 800) AS BIGINT) AS recovered_len, count(*) FILTER (WHERE record_ord < 800) AS records_preserved FROM log")
def _(spark, sf_dir):
    return visibility.recovery_report(torn(spark, sf_dir))


@query("recover_marked", f"WITH {LOG} SELECT record_ord, record_ord >= 800 AS is_dead FROM log")
def _(spark, sf_dir):
    return visibility.recover(torn(spark, sf_dir), "mark_tail").select("record_ord", "is_dead")


@query("verify_damage", f"WITH {LOG} SELECT count(*) AS records, count(*) FILTER (WHERE record_ord >= 800) AS damaged, min(record_ord) FILTER (WHERE record_ord >= 800) AS first_damaged FROM log")
def _(spark, sf_dir):
    return scan.verify(torn(spark, sf_dir))


@query("matrix_clear_category", f"WITH {CELLS} SELECT ch, count(*) FILTER (WHERE o % 7 <> 0 AND ch >= 10) AS committed FROM addressed GROUP BY ch")
def _(spark, sf_dir):
    cells = matrix.recovery(matrix.state(cells_log(spark, sf_dir)), "Clear", F.col("ch") < 10)
    return cells.groupBy("ch").agg(F.count_if("committed").alias("committed"))


@query("matrix_copy", f"WITH {CELLS} SELECT scan, ch, o % 7 <> 0 AS copied FROM addressed")
def _(spark, sf_dir):
    """Committed cells' bytes copied over a matrix of zeros."""
    source = matrix.state(cells_log(spark, sf_dir))
    target = source.select("scan", "ch", F.lit(b"0").alias("payload"), F.lit(True).alias("committed"))
    return matrix.copy_cells(source, target).select("scan", "ch", (~F.col("committed")).alias("copied"))


CATEGORY = "['a', 'b', 'c', 'd'][ch % 4 + 1]"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells, their channels dealt over four categories."""
    letters = F.array(*[F.lit(x) for x in "abcd"])
    return matrix.state(cells_log(spark, sf_dir)).withColumn("category", F.element_at(letters, (F.col("ch") % 4 + 1).cast("int")))


def damaged(cells: DataFrame) -> DataFrame:
    """The cells with one committed payload changed, of category b."""
    return cells.withColumn("payload", F.when((F.col("scan") == 0) & (F.col("ch") == 1), F.lit(b"?")).otherwise(F.col("payload")))


@query("matrix_quarantine", f"WITH {CELLS} SELECT {CATEGORY} AS category, count(*) AS cells FROM addressed WHERE ch % 4 <> 1 GROUP BY 1")
def _(spark, sf_dir):
    """One damaged cell closes its whole category."""
    cells = damaged(categories(spark, sf_dir))
    return matrix.quarantine(cells, matrix.Dims(10_000_000, 64, 10**12)).groupBy("category").agg(F.count("*").alias("cells"))


@query("matrix_category_pages", f"WITH {CELLS} SELECT {CATEGORY} AS category, o // 32768 AS page, count(*) AS cells, count(*) FILTER (WHERE o = 1) AS damaged, CASE WHEN count(*) FILTER (WHERE o = 1) > 0 THEN 'Quarantine' ELSE 'None' END AS action FROM addressed GROUP BY 1, 2")
def _(spark, sf_dir):
    return matrix.verify_pages(damaged(categories(spark, sf_dir)), matrix.Dims(10_000_000, 64, 10**12), ("category",))


@query("matrix_recovery_actions", f"WITH {CELLS} SELECT a AS action, count(*) FILTER (WHERE a <> 'Quarantine' OR ch % 4 <> 1) AS cells, count(*) FILTER (WHERE o % 7 <> 0 AND CASE a WHEN 'None' THEN true WHEN 'Rebuild' THEN o <> 1 ELSE ch % 4 <> 1 END) AS committed FROM addressed, (VALUES ('None'), ('Clear'), ('Quarantine'), ('Rebuild')) t(a) GROUP BY 1")
def _(spark, sf_dir):
    cells, own = damaged(categories(spark, sf_dir)), F.col("category") == "b"
    parts = [matrix.recovery(cells, a, own).agg(F.lit(a).alias("action"), F.count("*").alias("cells"), F.count_if("committed").alias("committed")) for a in ("None", "Clear", "Quarantine", "Rebuild")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("matrix_cleared_count", f"WITH {CELLS} SELECT count(*) FILTER (WHERE o % 7 <> 0) AS cleared FROM addressed WHERE ch % 4 = 2")
def _(spark, sf_dir):
    return matrix.cleared_by(categories(spark, sf_dir), "c")


@query("matrix_sidecar_resume", f"WITH {CELLS}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE o % 7 <> 0) AS part FROM addressed) SELECT s.sidecar, s.signal, CASE WHEN s.whole THEN 0 ELSE part END AS committed, total FROM n, (VALUES (true, false, 'Resume'), (false, false, 'Restart'), (true, true, 'Discard'), (false, true, 'Clean')) s(sidecar, whole, signal)")
def _(spark, sf_dir):
    cells = matrix.state(cells_log(spark, sf_dir))
    dims = matrix.Dims(read(spark, sf_dir, "embeddings").count(), 64, 10**12)
    parts = [matrix.resume(c, dims, sidecar).withColumn("sidecar", F.lit(sidecar)) for c in (cells, matrix.clear(cells)) for sidecar in (True, False)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("matrix_flags", "SELECT * FROM (VALUES ('gain', CAST(NULL AS BIGINT), true), ('clipped', CAST(3 AS BIGINT), false)) t(name, ch, value)")
def _(spark, sf_dir):
    flags = spark.createDataFrame([("gain", None, False), ("clipped", 3, True)], "name string, ch long, value boolean")
    return matrix.set_flags(matrix.set_flags(flags, "gain", None, True), "clipped", 3, False)


@query("record_at", f"WITH {LOG} SELECT record_ord, key, kind FROM log WHERE record_ord = 123")
def _(spark, sf_dir):
    return scan.record_at(log_of(spark, sf_dir), 123).select("record_ord", "key", "kind")


@query("byte_range", "SELECT event_id AS record_ord, props[2:5] AS part FROM events WHERE strlen(props) >= 5")
def _(spark, sf_dir):
    log = log_of(spark, sf_dir).where("stored_len >= 5").withColumn("raw", F.col("payload").cast("binary"))
    return log.select("record_ord", F.decode(scan.byte_range("raw", 1, 4), "UTF-8").alias("part"))


@query("key_encoding", "SELECT o_orderkey, '01000000' AS block, o_custkey AS key FROM orders")
def _(spark, sf_dir):
    """Index keys, taken apart again."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [codec.encode_key(1, ("i64",), (k,)) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[:4].hex() for k in keys]), pa.array([int.from_bytes(k[4:], "little", signed=True) for k in keys], pa.int64())], ["o_orderkey", "block", "key"])

    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").mapInArrow(run, "o_orderkey long, block string, key long")


@query("blob_round_trip", "SELECT doc_id, strlen(text) AS bytes, sha256(text) AS digest FROM documents")
def _(spark, sf_dir):
    """Texts as chunked blobs and back."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            back = [codec.from_chunks(codec.to_chunks((t or "").encode(), 1 << 12)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in back], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back])], ["doc_id", "bytes", "digest"])

    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, bytes long, digest string")


def three_generations(spark: SparkSession, sf_dir: str) -> LogStore:
    kept = LogStore(spark, shared_path(spark, "store"))
    log = log_of(spark, sf_dir, sharded=True).drop("generation")
    for shard in range(3):
        kept.append(log.where(F.col("shard_ord") == shard))
        kept.sync()
    return kept


@query("store_compact", f"WITH {LOG} SELECT 'read ' || g AS what, count(*) AS records, CAST(sum(record_ord) AS BIGINT) AS places FROM log, range(4) t(g) WHERE shard_ord <= g GROUP BY g UNION ALL SELECT 'follow ' || g, count(*), CAST(sum(record_ord) AS BIGINT) FROM log, range(2) t(g) WHERE shard_ord > g GROUP BY g UNION ALL SELECT 'follow 2', 0, NULL")
def _(spark, sf_dir):
    """Three generations, compacted: what readers pinned at each see, and what following from each returns."""
    kept = three_generations(spark, sf_dir)
    kept.compact_files()
    kept.vacuum()
    tally = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("records"), F.sum("record_ord").alias("places"))
    parts = [tally(kept.read(g), f"read {g}") for g in range(4)] + [tally(kept.follow(g)[1], f"follow {g}") for g in range(3)]
    kept.unlock()
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("store_restore", f"WITH {LOG} SELECT CAST(shard_ord AS BIGINT) AS generation, count(*) AS records FROM log WHERE shard_ord <= 1 GROUP BY 1 UNION ALL SELECT 2, 1")
def _(spark, sf_dir):
    """Compacted, restored to an earlier generation, and written on."""
    kept = three_generations(spark, sf_dir)
    kept.compact_files()
    kept.restore(1)
    kept.append(log_of(spark, sf_dir).drop("generation").limit(1))
    kept.sync()
    rows = kept.read().groupBy("generation").agg(F.count("*").alias("records"))
    kept.unlock()
    return rows


@query("follow_cursor", f"WITH {LOG} SELECT record_ord FROM log WHERE generation = 2 AND block_id = 30")
def _(spark, sf_dir):
    cursor = visibility.Cursor("events", 1)
    return visibility.follow_events(log_of(spark, sf_dir), cursor, "events", 2, block_id=30)[1].select("record_ord")


@query("replace_rewrite", f"WITH {LOG} SELECT record_ord, key, value, record_ord = 10 AS is_dead FROM log UNION ALL SELECT max(record_ord) + 1, any_value(key) FILTER (WHERE record_ord = 10), 7.5, false FROM log")
def _(spark, sf_dir):
    return merge.replace_rewrite(log_of(spark, sf_dir), 10, 10**6, value=7.5).select("record_ord", "key", "value", "is_dead")


@query("defragment_key_chain", f"WITH {LOG} SELECT record_ord, CASE WHEN kind <> 'OP' THEN lag(record_ord) OVER (PARTITION BY kind <> 'OP', key ORDER BY record_ord) END AS prev_same_key FROM log WHERE record_ord % 10 <> 0")
def _(spark, sf_dir):
    log = merge.mark_dead(log_of(spark, sf_dir), F.col("record_ord") % 10 == 0)
    chained = chain.key_chain(log).select("record_ord", "prev_same_key")
    log = log.join(chained, "record_ord", "left")
    return merge.defragment(log).select("record_ord", "prev_same_key")


@query("entries_for_key", "SELECT turn AS record_ord, strlen(text) AS byte_len, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM conversations WHERE conv_id = 3")
def _(spark, sf_dir):
    index = segments.chunk_index(turns(spark, sf_dir), "file", "record_ord")
    return segments.entries_for(index, 3, "file").select("record_ord", "byte_len", "byte_offset")


@query("segment_bounds", "SELECT conv_id AS file, turn AS record_ord FROM conversations")
def _(spark, sf_dir):
    index = segments.chunk_index(turns(spark, sf_dir), "file", "record_ord").withColumn("raw_len", F.col("byte_offset") + F.col("byte_len"))
    return segments.bounded(index).select("file", "record_ord")


@query("layout_scan", "SELECT conv_id AS file, turn AS record_ord, strlen(text) AS byte_len, role AS metadata FROM conversations")
def _(spark, sf_dir):
    """Conversations written as segment files and parsed again."""
    kind = layout.Kind("turn", b"TURN", (("next_offset", "u64"), ("raw_offset", "u64"), ("place", "u32")))
    form, path = layout.Layout((kind,), b"CONV"), shared_path(spark, "layout")
    rows = read(spark, sf_dir, "conversations").repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        n, name, data = 0, None, b""

        def close():
            if name is not None:
                with store.open_output_stream(f"{root}/{name}.conv") as out:
                    out.write(data)

        for batch in batches:
            for r in batch.to_pylist():
                if r["conv_id"] != name:
                    close()
                    name, data, n = r["conv_id"], form.header, n + 1
                data += layout.write_segment(kind, {"place": r["turn"]}, r["role"].encode(), r["text"].encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    found = layout.read_segments(spark, f"{path}/*.conv", form)
    file = F.regexp_extract("file", r"(\d+)\.conv$", 1).cast("long")
    return found.select(file.alias("file"), F.col("lead_in")["place"].alias("record_ord"), F.octet_length("raw").cast("long").alias("byte_len"), F.decode("metadata", "UTF-8").alias("metadata"))


@query("bitmap_bits", "SELECT o_orderkey, o_orderkey % 64 IN (0, 3, 9, 27, 63) AS bit FROM orders")
def _(spark, sf_dir):
    bits = codec.Bitmap(64)
    for i in (0, 3, 9, 27, 63):
        bits.set(i)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(bytes(bits.data)).alias("m"))
    return rows.select("o_orderkey", codec.bit_of("m", F.col("o_orderkey") % 64).alias("bit"))


@query("read_limits", f"WITH {LOG} SELECT kind, count(*) AS records FROM log GROUP BY kind")
def _(spark, sf_dir):
    log = spec.LIMITS["standard"].meet(spec.Limits(payload=10_000)).check(log_of(spark, sf_dir))
    return log.groupBy("kind").agg(F.count("*").alias("records"))


@query("format_fields", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'order_status', CAST(0 AS INTEGER), 'o_orderstatus', 'string', true), (1, 'order_status', 1, 'o_orderpriority', 'string', true)) t(block_id, block, position, field, type, is_key)")
def _(spark, sf_dir):
    return spec.Format("TIDE", (STATUS_BLOCK,)).validate().describe(spark).select("block_id", "block", "position", "field", "type", "is_key")


@query("finite_key_domain", "SELECT CAST((a - 1) * 5 + b - 1 AS INTEGER) AS code, ['F', 'O', 'P'][a] AS o_orderstatus, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][b] AS o_orderpriority FROM range(1, 4) x(a), range(1, 6) y(b)")
def _(spark, sf_dir):
    return spec.finite_keys(spark, STATUS_BLOCK)


for _name, (_run, _sql) in relational.SUPPLEMENTS.items():
    QUERIES[_name], ORACLE[_name] = _run, _sql
