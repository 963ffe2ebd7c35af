"""Codecs, sources, the store, layouts, matrices and streams."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import matrix, segments
from tidelog.plans import spec
from tidelog.plans.errors import CorruptData, LimitExceeded, Locked, NotWritten, OutOfDomain, SpecError, StaleCursor
from tidelog.sources import layout, logfile, store
from tidelog.streaming import follow

CASES = {
    "u8": st.integers(0, 255), "i64": st.integers(-(2**63), 2**63 - 1), "u64": st.integers(0, 2**64 - 1), "u128": st.integers(0, 2**128 - 1), "i128": st.integers(-(2**127), 2**127 - 1), "bool": st.booleans(),
    "f64": st.floats(allow_nan=False), "string": st.text(), "bytes": st.binary(), "[u32]": st.lists(st.integers(0, 2**32 - 1)), "[i16;3]": st.lists(st.integers(-99, 99), min_size=3, max_size=3),
    "string?": st.none() | st.text(), "(u8,string)": st.tuples(st.integers(0, 255), st.text()), "{string:i32}": st.dictionaries(st.text(), st.integers(-9, 9)),
}


@pytest.mark.parametrize("wire", CASES)
def test_codec_round_trips(wire):
    @settings(max_examples=40, deadline=None)
    @given(CASES[wire])
    def run(v):
        raw = codec.encode(wire, v)
        assert codec.decode(wire, raw) == v
        with pytest.raises(CorruptData):
            codec.decode(wire, raw + b"x")

    run()


def test_codec_refuses():
    for wire, raw in (("bool", b"\2"), ("string", b"\5\0\0\0\0\0\0\0ab"), ("string", b"\1\0\0\0\0\0\0\0\xff"), ("u32", b"1")):
        with pytest.raises(CorruptData):
            codec.decode(wire, raw)
    twice = codec.encode("u64", 2) + codec.encode("string", "a") * 2
    with pytest.raises(CorruptData):
        codec.decode("{string:unit}", twice)
    with pytest.raises(OutOfDomain):
        codec.encode("u8", 256)


def test_variable_fields():
    old = (spec.Field("a", "u32"), spec.Field("b", "string"))
    new = (*old, spec.Field("c", "i32", 7, True))
    raw = codec.encode_fields(old, {"a": 1, "b": "x"})
    assert codec.decode_fields(new, raw) == {"a": 1, "b": "x", "c": 7}
    assert codec.decode_fields(old, codec.encode_fields(new, {"a": 1, "b": "x", "c": 2})) == {"a": 1, "b": "x"}
    with pytest.raises(CorruptData):
        codec.decode_fields((*old, spec.Field("d", "u8")), raw)


def test_bitmap_and_blobs(spark):
    b = codec.Bitmap(20)
    for i in (0, 7, 8, 19):
        b.set(i)
    assert [i for i in range(20) if b.get(i)] == [0, 7, 8, 19] and b.count() == 4
    with pytest.raises(OutOfDomain):
        b.get(20)
    df = spark.range(20).withColumn("m", F.lit(bytes(b.data)))
    assert [r["id"] for r in df.where(codec.bit_of("m", F.col("id"))).orderBy("id").collect()] == [0, 7, 8, 19]
    data = bytes(range(256)) * 1000
    blob = codec.to_chunks(data)
    assert codec.from_chunks(blob) == data and len(blob) < len(data)
    with pytest.raises(LimitExceeded):
        codec.from_chunks(blob, 10)
    with pytest.raises(CorruptData):
        codec.from_chunks(blob[:-1] + bytes([blob[-1] ^ 1]))


USER = spec.Block(1, "user", (spec.Field("id", "u32"), spec.Field("name", "string")), keys=("id",))


def test_format_validation(spark):
    form = spec.Format("M", (USER,)).validate()
    assert form.describe(spark).count() == 2 and form.diagnose(spark).where("severity = 'error'").count() == 0
    assert spec.Format("M", (USER,), pinned_hash=form.schema_hash()).validate()
    for bad in (spec.Format("", (USER,)), spec.Format("M", (USER, USER)), spec.Format("M", (USER,), commit="often"), spec.Format("M", (USER,), pinned_hash=1), spec.Format("M", (spec.Block(2, "k", (spec.Field("a", "u8"),), keys=("b",)),)), spec.Format("M", (spec.Block(2, "w", (spec.Field("a", "u7"),)),))):
        with pytest.raises(SpecError):
            bad.validate()
    strict = spec.Limits(records=5).meet(spec.Limits(records=3, payload=9))
    assert (strict.records, strict.payload) == (3, 9) and spec.Limits(records=5).overlay(spec.Limits(records=9)).records == 9


def test_finite_keys(spark):
    b = spec.Block(3, "frame", (spec.Field("scan", "i32"), spec.Field("color", "string")), keys=("scan", "color"), domain=((-2, -1, 0, 1), ("red", "blue")))
    codes = spec.finite_keys(spark, b).collect()
    assert [(r["code"], r["scan"], r["color"]) for r in codes][:3] == [(0, -2, "red"), (1, -2, "blue"), (2, -1, "red")] and len(codes) == 8
    with pytest.raises(Exception, match="key outside the domain"):
        spec.with_codes(spark.createDataFrame([(5, "red")], "scan int, color string"), b).collect()


def test_log_file_source(spark, tmp_path):
    logfile.register(spark)
    path = str(tmp_path / "log")
    rows = spark.range(300).select((F.col("id") % 3 + 1).alias("block_id"), F.lit(1).alias("block_version"), F.lit("PUT").alias("kind"), F.lit(0).alias("shard_ord"), F.col("id").alias("sequence"), F.col("id").cast("string").cast("binary").alias("payload"))
    rows.write.format("tidelog").mode("append").save(path)
    rows.where("block_id = 1").write.format("tidelog").mode("append").save(path)
    back = spark.read.format("tidelog").load(path)
    assert back.count() == 400 and back.where("block_id = 2").count() == 100
    assert spark.read.format("tidelog").option("generation", 0).load(path).count() == 300
    assert back.where("checksum <> crc32(payload)").count() == 0
    file = next(p for p in (tmp_path / "log").glob("*.tlog") if p.stat().st_size > 100)
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="torn"):
        spark.read.format("tidelog").load(path).count()
    assert spark.read.format("tidelog").option("recovery", "truncate_tail").load(path).count() == 399


def test_store_publishes_on_sync_only(spark, tmp_path):
    form = spec.Format("M", (USER,))
    s = store.LogStore(spark, str(tmp_path / "s"), form)
    rows = spark.createDataFrame([(1, "PUT", 0, "a"), (2, "PUT", 1, "b")], "key long, kind string, sequence long, value string")
    s.append(rows)
    assert s.flush() == 1 and s.pointer()["generation"] == -1
    assert s.sync() == 0 and s.read().count() == 2
    s.delete(rows.where("key = 1"), 2)
    assert s.read().count() == 2 and s.sync() == 1 and s.read().count() == 3
    assert s.read(0).count() == 2 and s.follow(0)[1].count() == 1
    with pytest.raises(StaleCursor):
        s.read(7)
    other = store.LogStore(spark, str(tmp_path / "s"), form)
    assert other.opened_after_crash()
    with pytest.raises(Locked):
        other.append(rows)
    other.lock(steal=True)
    other.append(rows)
    other.rollback()
    other.restore(0)
    assert other.read().count() == 2 and other.compact_files() == 1 and other.read().count() == 2
    other.unlock()


def test_layouts(spark, tmp_path):
    kind = layout.Kind("seg", b"SEG1", (("mask", "u32"), ("next_offset", "u64"), ("raw_offset", "u64")))
    form = layout.Layout((kind, layout.Kind("idx", b"IDX1", kind.fields)), b"HEAD")
    data = b"HEAD" + layout.write_segment(kind, {"mask": 5}, b"meta", b"raw!") + layout.write_segment(form.kinds[1], {"mask": 6}, b"", b"r")
    (tmp_path / "a.bin").write_bytes(data)
    got = layout.read_segments(spark, str(tmp_path / "a.bin"), form).orderBy("record_ord").collect()
    assert [(r["kind"], r["lead_in"]["mask"], bytes(r["metadata"]), bytes(r["raw"])) for r in got] == [("seg", 5, b"meta", b"raw!"), ("idx", 6, b"", b"r")]
    (tmp_path / "b.bin").write_bytes(data[:-1])
    with pytest.raises(Exception, match="tail isn't whole"):
        layout.read_segments(spark, str(tmp_path / "b.bin"), form).collect()
    assert [r["tail"] for r in layout.read_segments(spark, str(tmp_path / "b.bin"), form, strict=False).collect()] == ["Torn"]
    with pytest.raises(SpecError):
        layout.Layout((kind, layout.Kind("x", b"SEG", kind.fields))).validate()


def test_segments(spark):
    rows = spark.createDataFrame([("f", 0, [0.1, 0.2], "mV"), ("f", 1, [0.3], None)], "file string, i long, v array<double>, unit string")
    assert [(r["sample"], r["value"]) for r in segments.concat_values(rows, ["file"], "i", "v").orderBy("sample").collect()] == [(0, 0.1), (1, 0.2), (2, 0.3)]
    assert [r["carried"] for r in segments.carry_forward(rows, ["file"], "i", "unit").orderBy("i").collect()] == ["mV", "mV"]
    with pytest.raises(Exception, match="beyond its segment"):
        segments.bounded(spark.createDataFrame([(5, 3, 3)], "raw_len long, byte_offset long, byte_len long")).collect()


@pytest.mark.parametrize("seed", range(3))
def test_matrix_model(spark, seed):
    rnd, events, model, committed = random.Random(seed), [], {}, {}
    shots = {}
    for seq in range(60):
        cell, g = (rnd.randrange(4), rnd.randrange(2)), seq // 20
        op = rnd.choice([matrix.WRITE, matrix.COMMIT, matrix.CLEAR])
        if op == matrix.COMMIT and cell not in model:
            continue
        if op == matrix.WRITE:
            model[cell] = str(seq).encode()
        committed[cell] = op == matrix.COMMIT
        events.append((g, seq, op, *cell, model.get(cell) if op == matrix.WRITE else None))
        shots[g] = {c for c, on in committed.items() if on}
    df = spark.createDataFrame(events, "generation long, seq long, op string, scan long, ch long, payload binary").withColumn("crc", F.lit(None).cast("long"))
    for g, want in shots.items():
        got = matrix.read_cells(matrix.state(df, g))
        assert {(r["scan"], r["ch"]) for r in got.collect()} == want
    got = {(r["scan"], r["ch"]): bytes(r["payload"]) for r in matrix.read_cells(matrix.state(df)).collect()}
    assert got == {c: model[c] for c, on in committed.items() if on}
    assert matrix.status(matrix.state(df), matrix.Dims(4, 2)).count() == 8


def test_matrix_guards(spark):
    with pytest.raises(LimitExceeded):
        matrix.Dims(10**6, 10**6)
    df = spark.createDataFrame([(0, 0, matrix.COMMIT, 0, 0, None, None)], "generation long, seq long, op string, scan long, ch long, payload binary, crc long")
    with pytest.raises(NotWritten):
        matrix.guard_commits(df)
    with pytest.raises(Exception, match="NotCommitted"):
        matrix.read_cells(matrix.state(df.limit(0)), spark.createDataFrame([(0, 0)], "scan long, ch long")).collect()
    with pytest.raises(Exception, match="outside the matrix"):
        spark.createDataFrame([(9, 0)], "scan long, ch long").select(matrix.Dims(4, 2).ordinal()).collect()


def test_streams_equal_batches(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(9), rnd.choice(["PUT", "PUT", "TOMBSTONE", "OP"]), float(i)) for i in range(200)]
    schema = "sequence long, key long, kind string, value double"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "in")
    for i in range(3):
        df.where(F.col("sequence") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    want = {}
    for s, k, kind, _ in sorted(rows):
        if kind != "OP":
            want[k] = (s, kind)
    source = lambda: follow.follow(spark, path, df.schema, files_per_batch=1)
    got = follow.run_to_table(follow.latest_stream(source()), "latest_a", str(tmp_path / "c1"))
    assert {r["key"]: (r["sequence"], r["kind"]) for r in got.collect()} == want
    states = follow.run_to_table(follow.latest_with_state(source()), "latest_b", str(tmp_path / "c2"), "update")
    last = states.groupBy("key").agg(F.max_by(F.struct("sequence", "kind"), "sequence").alias("s"))
    assert {r["key"]: (r["s"]["sequence"], r["s"]["kind"]) for r in last.collect()} == want
    out, check = str(tmp_path / "out"), str(tmp_path / "c3")
    assert follow.drain(source(), out, check) == 200
    df.limit(5).write.mode("append").parquet(path)
    assert follow.drain(source(), out, check) == 5 and spark.read.parquet(out).count() == 205
