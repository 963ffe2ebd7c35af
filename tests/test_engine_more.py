"""Policies, markers, slots, indexes, cursors, locks, streams of log files, diagnosis, tagged values."""

import threading

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import keyed, matrix, merge, selftest, visibility
from tidelog.plans import spec
from tidelog.plans.envelope import enveloped
from tidelog.plans.errors import Locked, PartialWrite, SpecError, StaleCursor, UsageError
from tidelog.sources import logfile, store

KEYED = spec.Block(1, "user", (spec.Field("key", "i64"), spec.Field("value", "string")), keys=("key",), indexed=True)
PLAIN = spec.Block(2, "point", (spec.Field("value", "string"),))
ROWS = "key long, kind string, sequence long, value string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def test_store_holds_rows_to_their_blocks(spark, tmp_path):
    s = store.LogStore(spark, str(tmp_path / "a"), spec.Format("M", (KEYED, PLAIN), keyed_chain=True))
    with pytest.raises(UsageError):
        s.append(rows(spark, (1, "PUT", 0, "a")), "user")
    with pytest.raises(Exception, match="key of user is null"):
        s.put(rows(spark, (None, "PUT", 0, "a")), "user")
    with pytest.raises(UsageError):
        s.delete(rows(spark, (1, "PUT", 0, "a")), 5)
    s.put(rows(spark, (1, "PUT", 0, "a")), "user")
    with pytest.raises(PartialWrite, match="written=1"):
        s.append_batches([rows(spark, (2, "PUT", 1, "b")), rows(spark, (2, "PUT", 1, "b")).withColumn("value", F.raise_error(F.lit("no")))])
    assert s.sync() == 0 and s.read().count() == 2 and s.status()["records"] == 2


def test_commit_markers(spark, tmp_path):
    s = store.LogStore(spark, str(tmp_path / "a"), spec.Format("M", (KEYED,), commit="explicit"))
    s.append(rows(spark, (1, "PUT", 0, "a")))
    s.commit_durable()
    s.append(rows(spark, (2, "PUT", 2, "b")))
    s.sync()
    assert s.read().count() == 3 and [r["key"] for r in s.read_committed().collect()] == [1]
    t = store.LogStore(spark, str(tmp_path / "b"), spec.Format("M", (KEYED,), commit="on_flush"))
    t.append(rows(spark, (1, "PUT", 0, "a")))
    assert t.flush() == 2 and t.sync() == 0 and t.read_committed().count() == 1
    with pytest.raises(UsageError):
        t.commit()


def test_index_is_bootstrapped_or_nothing(spark, tmp_path):
    s = store.LogStore(spark, str(tmp_path / "a"))
    for g in range(3):
        s.append(rows(spark, (g, "PUT", 2 * g, f"v{g}"), (0, "PUT" if g < 2 else "TOMBSTONE", 2 * g + 1, f"w{g}")))
        s.sync()
    seen = []
    assert not s.bootstrap_index(progress=lambda g, n: seen.append((g, n)), cancelled=lambda: len(seen) > 1)
    with pytest.raises(StaleCursor):
        s.index()
    assert seen == [(0, 2), (1, 4)] and s.bootstrap_index()
    want = {r["key"]: r["kind"] for r in keyed.states(enveloped(s.read())).collect()}
    assert {r["key"]: r["kind"] for r in s.index().collect()} == want == {0: "TOMBSTONE", 1: "PUT", 2: "PUT"}
    s.append(rows(spark, (9, "PUT", 9, "x")))
    s.sync()
    with pytest.raises(StaleCursor):
        s.index()


def test_cursors_know_their_log_and_publication(spark, tmp_path):
    s = store.LogStore(spark, str(tmp_path / "a"))
    s.append(rows(spark, (1, "PUT", 0, "a")))
    s.sync()
    cursor = s.cursor()
    s.append(rows(spark, (2, "PUT", 1, "b")))
    s.sync()
    moved, new = s.follow_cursor(cursor)
    assert [r["key"] for r in new.collect()] == [2] and moved[1] == 1
    s.compact_files()
    assert s.follow_cursor(cursor)[1].count() == 1 and s.follow_cursor(moved)[1].count() == 0
    s.restore(0)
    s.append(rows(spark, (3, "PUT", 1, "c")))
    s.sync()
    with pytest.raises(StaleCursor):
        s.follow_cursor(moved)
    with pytest.raises(StaleCursor):
        store.LogStore(spark, str(tmp_path / "b")).follow_cursor(cursor)
    log = enveloped(rows(spark, (1, "PUT", 0, "a"))).withColumn("generation", F.lit(3).cast("long"))
    at, new = visibility.follow_events(log, visibility.Cursor("x", 2), "x", 3)
    assert at.generation == 3 and new.count() == 1
    with pytest.raises(StaleCursor):
        visibility.follow_events(log, visibility.Cursor("y", 2), "x", 3)
    with pytest.raises(StaleCursor):
        visibility.follow_events(log, visibility.Cursor("x", 3, "one"), "x", 3, "two")


def test_slots(spark, tmp_path):
    s = store.LogStore(spark, str(tmp_path / "a"), spec.Format("M", (PLAIN,), header_slots={"note": "rolling", "origin": "sealed", "free": "none"}))
    for name in ("note", "origin", "free"):
        s.write_slot(name, name.encode())
    s.write_slot("note", b"again")
    s.write_slot("free", None)
    assert s.slots() == {"note": b"again", "origin": b"origin"}
    for name in ("origin", "other"):
        with pytest.raises(UsageError):
            s.write_slot(name, b"x")
    with pytest.raises(SpecError):
        spec.Format("M", (PLAIN,), header_slots={"a": "glue"}).validate()


def test_one_of_many_writers_gets_the_lock(spark, tmp_path):
    stores = [store.LogStore(spark, str(tmp_path / "a")) for _ in range(12)]
    won, lost, gate = [], [], threading.Barrier(12)

    def take(s):
        gate.wait()
        try:
            s.lock()
            won.append(s)
        except Locked:
            lost.append(s)

    threads = [threading.Thread(target=take, args=(s,)) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 11
    lost[0].lock(steal=True)
    with pytest.raises(Locked):
        won[0].lock()


def test_manifests_are_numbered_once(tmp_path):
    path, gate, got = str(tmp_path / "log"), threading.Barrier(8), []

    def publish(i):
        gate.wait()
        got.append(logfile.publish(path, {"files": [f"{i}.tlog"]}))

    threads = [threading.Thread(target=publish, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(8)) and sorted(f for m in logfile.manifests(path) for f in m["files"]) == [f"{i}.tlog" for i in range(8)]
    logfile.publish(path, {"files": ["new.tlog"], "overwrite": True})
    assert [m["files"] for m in logfile.manifests(path)] == [["new.tlog"]]


def test_log_files_stream_and_are_diagnosed(spark, tmp_path):
    logfile.register(spark)
    path = str(tmp_path / "log")
    made = spark.range(50).select((F.col("id") % 3 + 1).alias("block_id"), F.lit(1).alias("block_version"), F.lit("PUT").alias("kind"), F.lit(0).alias("shard_ord"), F.col("id").alias("sequence"), F.col("id").cast("string").cast("binary").alias("payload"))
    made.coalesce(2).write.format("tidelog").mode("append").save(path)

    def drain():
        q = spark.readStream.format("tidelog").load(path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert drain() == 50
    made.limit(7).coalesce(1).write.format("tidelog").mode("append").save(path)
    assert drain() == 57 and drain() == 57
    form = spec.Format("M", (spec.Block(1, "a", (spec.Field("x", "i32"),)), spec.Block(2, "b", (spec.Field("x", "i32"),))))
    found = logfile.diagnose(spark, path, form).collect()
    assert {r["severity"] for r in found} == {"info", "warning"} and sum(r["records"] for r in found if r["severity"] == "info") == 57
    file = max((tmp_path / "log").glob("*.tlog"), key=lambda p: p.stat().st_size)
    file.write_bytes(file.read_bytes()[:-1])
    (tmp_path / "log" / (file.name + ".idx")).write_bytes(b"index")
    assert [r["file"] for r in logfile.diagnose(spark, path).collect() if r["code"] == "torn"] == [file.name]
    beside = {r["file"]: (r["present"], r["size"]) for r in logfile.sidecars(spark, path).collect()}
    assert beside[file.name] == (True, 5) and sum(p for p, _ in beside.values()) == 1


def test_tagged_values(spark):
    tags = {1: ("count", "i64"), 7: ("name", "string")}
    raw = [codec.encode_tagged(tags, "count", 5), codec.encode_tagged(tags, "name", "x")]
    assert [codec.decode_tagged(tags, r) for r in raw] == [("count", 5), ("name", "x")]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i long, raw binary")
    assert [(r["t"]["count"], r["t"]["name"]) for r in df.select("i", codec.tagged_column(F.col("raw"), tags).alias("t")).orderBy("i").collect()] == [(5, None), (None, "x")]
    with pytest.raises(SpecError):
        codec.encode_tagged(tags, "other", 1)


def test_replacements_are_checked(spark):
    log = enveloped(spark.createDataFrame([(0, 1, "a", bytearray(b"xy"), 1.0), (1, 2, "b", bytearray(b"zz"), 2.0)], "record_ord long, key long, v string, payload binary, value double")).withColumn("block_id", F.lit(5).cast("long"))
    assert merge.replace_at(log, 5, 1, validate=F.col("value") > 0, value=3.0).agg(F.sum("value")).head()[0] == 4.0
    with pytest.raises(Exception, match="replacement is refused"):
        merge.replace_at(log, 5, 1, validate=F.col("value") > 9, value=3.0).collect()
    assert bytes(merge.replace_fixed(log, 0, 9, payload=b"ab").where("record_ord = 0").head()["payload"]) == b"ab"
    with pytest.raises(Exception, match="keeps its size"):
        merge.replace_fixed(log, 0, 9, payload=b"abc").collect()


def test_damaged_cells_fail_reads(spark):
    cells = spark.createDataFrame([(0, 0, bytearray(b"a"), 1, True), (0, 1, None, 7, False)], "scan long, ch long, payload binary, crc long, committed boolean")
    with pytest.raises(Exception, match="differs from its checksum"):
        matrix.read_cells(cells).collect()
    with pytest.raises(Exception, match="no payload for a checksum"):
        matrix.rebuild(cells, strict=True).collect()


def test_self_tests(spark):
    t = selftest.SelfTest().step("spec", lambda: spec.Format("M", (PLAIN,)).validate().magic).rows("faults", spark.range(3), "warning").step("bad", lambda: spec.Format("", ()).validate())
    report = t.run(spark)
    assert [(r["step"], r["passed"], r["domain"]) for r in report.orderBy("position").collect()] == [("spec", True, None), ("faults", False, "internal"), ("bad", False, "specification")]
    assert not selftest.passed(report) and selftest.warnings(report).count() == 1 and selftest.errors(report).count() == 1


def test_a_hot_key_is_dealt_over_tasks(spark):
    """Operations meet their key's last put salted, so the aggregate by key follows a shuffle of partial sums."""
    log = enveloped(spark.createDataFrame([(1, "PUT", 0, 1.0)] + [(1, "OP", i, 1.0) for i in range(1, 400)], "key long, kind string, sequence long, value double"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = keyed.materialize_sum(log, orphans="ignore")
        assert [(r["value"], r["operations"]) for r in out.collect()] == [(400.0, 399)]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
