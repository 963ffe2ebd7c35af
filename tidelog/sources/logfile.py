"""A Spark data source for logs as files of framed records.

A file is a magic, then records: a head of fixed size (block, version, kind, shard, sequence, payload
length, payload CRC-32), then the payload. Readers take a file a partition; a filter on the block is
pushed down, so payloads of other blocks are skipped over, not read. Writers give each task's file a name
of its own and publish, when all tasks have ended, a manifest that lists them: readers see manifests only, so
neither failed tasks nor failed jobs leave anything visible.

Paths are opened through Arrow's filesystems: file, HDFS and object-store addresses.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, WriterCommitMessage

from tidelog.plans.errors import CorruptData
from tidelog.plans.paths import write_new
from tidelog.plans.spec import Format

MAGIC = b"TIDELOG1"
HEAD = "<IHBxIQII"
HEAD_SIZE = struct.calcsize(HEAD)
BATCH_BYTES, BATCH_ROWS = 1 << 22, 8192
KINDS = ("PUT", "OP", "TOMBSTONE", "META", "COMMIT")
SCHEMA = "block_id long, block_version int, kind string, shard_ord int, sequence long, record_ord long, stored_len long, checksum long, payload binary, file string"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def frame(block: int, version: int, kind: str, shard: int, sequence: int, payload: bytes) -> bytes:
    return struct.pack(HEAD, block, version, KINDS.index(kind), shard, sequence, len(payload), zlib.crc32(payload)) + payload


def manifests(path: str) -> list[dict]:
    """The published manifests in order, from the last that voids its predecessors on."""
    from pyarrow import fs

    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True))
    out = []
    for f in sorted(found, key=lambda f: f.base_name):
        if f.base_name.endswith(".json"):
            with store.open_input_stream(f.path) as s:
                out.append(json.loads(s.read()))
                if out[-1].get("overwrite"):
                    out = out[-1:]
    return out


def publish(path: str, body: dict) -> int:
    """Writes a manifest under the next free number; of writers that want one number, one gets it and the others the next."""
    from pyarrow import fs

    store, root = _open(path)
    store.create_dir(f"{root}/_manifests", recursive=True)
    taken = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/_manifests")) if f.base_name.endswith(".json")]
    number = max((int(name[:-5]) + 1 for name in taken), default=0)
    while not write_new(store, f"{root}/_manifests/{number:012d}.json", json.dumps({**body, "generation": number}).encode()):
        number += 1
    return number


@dataclass
class FilePart(InputPartition):
    file: str
    generation: int

    def __init__(self, file: str, generation: int):
        super().__init__((file, generation))
        self.file, self.generation = file, generation


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int
    nbytes: int


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.tolerant = options.get("recovery", "strict") == "truncate_tail"
        self.upto = int(options["generation"]) if "generation" in options else None
        self.block: int | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("block_id",) and self.block is None:
                self.block = f.value
            else:
                yield f

    def partitions(self):
        parts = [FilePart(f, m["generation"]) for m in manifests(self.path) if self.upto is None or m["generation"] <= self.upto for f in m["files"]]
        return parts or [FilePart("", -1)]

    def read(self, partition):
        """Record batches of about ``BATCH`` bytes or records."""
        if not partition.file:
            return
        rows, held = [], 0
        for row in self.records(partition.file):
            rows.append(row)
            held += row[6]
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def records(self, file: str):
        store, root = _open(self.path)
        with store.open_input_file(f"{root}/{file}") as f:
            size = f.size()
            if f.read(len(MAGIC)) != MAGIC:
                raise CorruptData("not a log file", file=file)
            at, n = len(MAGIC), 0
            while at < size:
                head = f.read_at(HEAD_SIZE, at)
                whole = len(head) == HEAD_SIZE
                if whole:
                    block, version, kind, shard, sequence, length, crc = struct.unpack(HEAD, head)
                    whole = at + HEAD_SIZE + length <= size and kind < len(KINDS)
                if not whole:
                    if self.tolerant:
                        return
                    raise CorruptData("a record is torn", file=file, at=at)
                if self.block is None or block == self.block:
                    payload = f.read_at(length, at + HEAD_SIZE)
                    if zlib.crc32(payload) != crc:
                        if self.tolerant:
                            return
                        raise CorruptData("a record differs from its checksum", file=file, at=at)
                    yield block, version, KINDS[kind], shard, sequence, n, length, crc, payload, file
                at += HEAD_SIZE + length
                n += 1


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in SCHEMA.split(", ")]
    columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


class LogWriter(DataSourceArrowWriter):
    """Takes block_id, block_version, kind, shard_ord, sequence and payload; other columns aren't stored."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        name, records, nbytes = f"{uuid.uuid4().hex}.tlog", 0, len(MAGIC)
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)
            for batch in iterator:
                rows = batch.select(["block_id", "block_version", "kind", "shard_ord", "sequence", "payload"]).to_pylist()
                raw = b"".join(frame(r["block_id"], r["block_version"], r["kind"], r["shard_ord"], r["sequence"], r["payload"] or b"") for r in rows)
                out.write(raw)
                records, nbytes = records + len(rows), nbytes + len(raw)
        return Written(name, records, nbytes)

    def commit(self, messages):
        body = {"id": uuid.uuid4().hex, "overwrite": self.overwrite, "files": [m.file for m in messages if m.records], "records": sum(m.records for m in messages), "bytes": sum(m.nbytes for m in messages)}
        publish(self.path, body)

    def abort(self, messages):
        store, root = _open(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.file}")


class LogStream(DataSourceStreamReader):
    """Follows a log: offsets are generations, so each manifest is read once."""

    def __init__(self, options: dict):
        self.files = LogReader(options)

    def initialOffset(self):
        return {"generation": int(self.files.upto if self.files.upto is not None else -1)}

    def latestOffset(self):
        found = manifests(self.files.path)
        return {"generation": found[-1]["generation"] if found else -1}

    def partitions(self, start, end):
        return [FilePart(f, m["generation"]) for m in manifests(self.files.path) if start["generation"] < m["generation"] <= end["generation"] for f in m["files"]]

    def read(self, partition):
        return self.files.read(partition)


class LogSource(DataSource):
    """``spark.read.format("tidelog").load(path)`` or ``spark.readStream``; register it first. A stream's option generation is where it begins, after it."""

    @classmethod
    def name(cls):
        return "tidelog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)

    def streamReader(self, schema):
        return LogStream(self.options)

    def writer(self, schema, overwrite):
        return LogWriter(self.options, overwrite)


def diagnose(spark, path: str, form: Format | None = None) -> DataFrame:
    """Rows (file, severity, code, message, records), one for each published file and finding; tasks read the files."""
    names = [(f,) for m in manifests(path) for f in m["files"]]
    versions = {(b.id, b.version) for b in form.blocks} if form else None

    def run(batches):
        import pyarrow as pa

        reader, out = LogReader({"path": path}), []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                n, strange = 0, set()
                try:
                    for row in reader.records(name):
                        n += 1
                        if versions is not None and (row[0], row[1]) not in versions:
                            strange.add((row[0], row[1]))
                    out.append((name, "info", "whole", "", n))
                except (CorruptData, OSError) as e:
                    out.append((name, "error", "torn" if "torn" in str(e) else "damaged" if isinstance(e, CorruptData) else "missing", str(e), n))
                out += [(name, "warning", "undeclared", f"block {b} version {v}", n) for b, v in sorted(strange)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["file", "severity", "code", "message", "records"])

    files = spark.createDataFrame(names or [("",)], "file string").where("file <> ''").repartition(max(1, min(len(names), 200)))
    return files.mapInArrow(run, "file string, severity string, code string, message string, records long")


def sidecars(spark, path: str, suffix: str = ".idx") -> DataFrame:
    """Rows (file, sidecar, present, size, fingerprint): each published file and the one beside it that bears its name and a suffix."""
    store, root = _open(path)
    from pyarrow import fs

    names = [(f, f + suffix) for m in manifests(path) for f in m["files"]]
    there = {f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(suffix)}

    def run(batches):
        import hashlib

        import pyarrow as pa

        mine, base = _open(path)
        for batch in batches:
            sizes, prints = [], []
            for name, present in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, n = hashlib.sha256(), 0
                if present:
                    with mine.open_input_stream(f"{base}/{name}") as f:
                        while block := f.read(1 << 20):
                            h.update(block)
                            n += len(block)
                sizes.append(n if present else None)
                prints.append(h.hexdigest() if present else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(prints, pa.string())], ["file", "sidecar", "present", "size", "fingerprint"])

    rows = spark.createDataFrame([(f, x, x in there) for f, x in names], "file string, sidecar string, present boolean")
    return rows.mapInArrow(run, "file string, sidecar string, present boolean, size long, fingerprint string")


def register(spark) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
