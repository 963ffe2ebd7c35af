"""A log store: Parquet generations behind a published pointer, for one writer and any readers.

``append`` and ``flush`` stage data that no reader sees; ``sync`` publishes it by moving one small file
into place. Readers read the pointer once and are pinned to its generation until they follow.

Every row is written with the generation that will publish it, so all files are read by one reader, whatever
their number, compaction keeps what each row belongs to, and a reader pinned before it reads the same after it.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.plans.envelope import COMMIT, OP
from tidelog.plans.errors import CorruptData, Locked, PartialWrite, StaleCursor, UsageError
from tidelog.plans.paths import write_new
from tidelog.plans.spec import Format, with_codes


class LogStore:
    def __init__(self, spark: SparkSession, path: str, form: Format | None = None):
        from pyarrow import fs

        self.spark, self.path, self.form = spark, path.rstrip("/"), form.validate() if form else None
        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.fs.create_dir(self.root, recursive=True)
        self.owner, self.staged = uuid.uuid4().hex, []

    # The pointer and the lock.

    def _read(self, name: str) -> dict | None:
        from pyarrow import fs

        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _write(self, name: str, body: dict) -> None:
        temp = f"{self.root}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps(body).encode())
        self.fs.move(temp, f"{self.root}/{name}")

    def pointer(self) -> dict:
        return self._read("_published.json") or {"generation": -1, "paths": [], "records": 0, "schema_hash": self.form.schema_hash() if self.form else 0}

    def lock(self, steal: bool = False) -> None:
        """Becomes the writer; of several at once one does. Another's lock is broken only if the caller says so."""
        body = json.dumps({"owner": self.owner}).encode()
        while not write_new(self.fs, f"{self.root}/_lock.json", body):
            held = self._read("_lock.json")
            if held and held["owner"] == self.owner:
                return
            if held and not steal:
                raise Locked("another writer holds the log", owner=held["owner"])
            if held:
                self.fs.delete_file(f"{self.root}/_lock.json")

    def unlock(self) -> None:
        if (held := self._read("_lock.json")) and held["owner"] == self.owner:
            self.fs.delete_file(f"{self.root}/_lock.json")

    def opened_after_crash(self) -> bool:
        """Whether another writer's lock is there: it was left behind, or that writer is at work still."""
        held = self._read("_lock.json")
        return held is not None and held["owner"] != self.owner

    # Writing.

    def append(self, rows: DataFrame, block: str | None = None, indexed: bool = False) -> str:
        """Stages rows; nothing is visible yet.

        Rows of a declared block are held to it: null keys and keys outside a finite domain fail the write, and an
        indexed block is only written by ``put``.
        """
        if block is not None:
            rows = self._checked(rows, block, indexed)
        self.lock()
        p = self.pointer()
        if self.form and p["schema_hash"] not in (0, self.form.schema_hash()):
            raise UsageError("the log was written by another schema", stored=p["schema_hash"])
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = rows.withColumn("generation", F.lit(p["generation"] + 1).cast("long"))
        rows.write.parquet(path)
        self.staged.append({"path": path, "low": p["generation"] + 1, "high": p["generation"] + 1, "schema": rows.schema.jsonValue()})
        return path

    def put(self, rows: DataFrame, block: str) -> str:
        """Stages rows of an indexed block."""
        return self.append(rows, block, indexed=True)

    def _checked(self, rows: DataFrame, block: str, indexed: bool) -> DataFrame:
        if not self.form:
            raise UsageError("blocks need a format", block=block)
        b = self.form.block(block)
        if self.form.chained and b.keys and not indexed and not b.indexed:
            raise UsageError("a keyed block of a chained format is written by push_keyed", block=block)
        if b.indexed != indexed:
            raise UsageError("an indexed block is written by put, others by append", block=block)
        for k in b.keys:
            bad = F.raise_error(F.lit(f"[{UsageError.__name__}] a key of {block} is null"))
            rows = rows.withColumn(k, F.when(F.col(k).isNull(), bad.cast(rows.schema[k].dataType)).otherwise(F.col(k)))
        return with_codes(rows, b).drop("code") if b.domain else rows

    def push_keyed(self, rows: DataFrame, block: str) -> str:
        """Stages rows of a keyed block of a chained format, each linked to the place of its key's record before it."""
        from tidelog.operators.ordered import with_previous

        b = self.form.block(block) if self.form else None
        if b is None or not b.keys or not self.form.chained:
            raise UsageError("push_keyed is for keyed blocks of chained formats", block=block)
        rows = self._checked(rows, block, b.indexed) if b.indexed else rows
        return self.append(with_previous(rows, list(b.keys), "record_ord", "prev_same_key"))

    def push_op(self, rows: DataFrame, target: str) -> str:
        """Stages operations on a keyed block; operations are on no chain."""
        if self.form is None or not self.form.block(target).keys:
            raise UsageError("operations need a keyed block", block=target)
        return self.append(rows.withColumn("kind", F.lit(OP)).withColumn("target_block_id", F.lit(self.form.block(target).id).cast("long")))

    def append_batches(self, frames: Iterable[DataFrame], block: str | None = None) -> int:
        """Stages batches one by one; how many. An error names how many were staged before it, and these stay."""
        n = 0
        for rows in frames:
            try:
                self.append(rows, block)
            except Exception as e:
                raise PartialWrite("a batch failed", written=n) from e
            n += 1
        return n

    def delete(self, keys: DataFrame, sequence_from: int) -> str:
        """Stages a tombstone for each key; they are numbered from a sequence on. A format with key chains refuses."""
        if self.form and self.form.keyed_chain:
            raise UsageError("a delete would leave the key chain; append a linked tombstone")
        from tidelog.operators.ordered import with_ordinal

        numbered = with_ordinal(keys.select("key").distinct().withColumn("_g", F.lit(0)), ["_g"], "key", "_n")
        return self.append(numbered.select("key", F.lit("TOMBSTONE").alias("kind"), (F.lit(sequence_from) + F.col("_n")).alias("sequence")))

    def flush(self) -> int:
        """How many batches are staged; a flush never publishes. Under the commit policy on_flush it ends with a marker."""
        if self.staged and self.form and self.form.commit == "on_flush":
            self._marker()
        return len(self.staged)

    def _marker(self) -> None:
        last = self._rows(self.staged + self.pointer()["paths"]).agg(F.max("sequence")).head()[0]
        self.append(self.spark.createDataFrame([(COMMIT, (last if last is not None else -1) + 1)], "kind string, sequence long"))

    def commit(self) -> int:
        """Stages a commit marker; for formats whose policy is explicit. Returns how many batches are staged."""
        if not self.form or self.form.commit != "explicit":
            raise UsageError("markers are written by hand under the explicit policy only", policy=self.form.commit if self.form else None)
        if self.staged:
            self._marker()
        return len(self.staged)

    def commit_durable(self) -> int:
        """A commit marker, published with what it commits."""
        self.commit()
        return self.sync()

    def read_committed(self) -> DataFrame:
        """What commit markers cover, by sequence; all of it where the policy knows no markers."""
        rows = self.read()
        if not self.form or self.form.commit not in ("on_flush", "explicit"):
            return rows
        end = rows.where(F.col("kind") == COMMIT).agg(F.max("sequence").alias("_end"))
        return rows.join(F.broadcast(end), F.col("sequence") <= F.col("_end")).where(F.col("kind") != COMMIT).drop("_end")  # one row

    def sync(self) -> int:
        """Publishes what is staged as a generation."""
        self.lock()
        p = self.pointer()
        if self.staged and self.staged[0]["low"] != p["generation"] + 1:
            raise StaleCursor("another writer published since", staged=self.staged[0]["low"], published=p["generation"])
        added = self._rows(self.staged).count() if self.staged else 0
        self._publish(p, p["paths"] + self.staged, p["generation"] + 1, p["records"] + added)
        self.staged = []
        return p["generation"] + 1

    def _publish(self, p: dict, paths: list[dict], generation: int, records: int) -> None:
        ids = {g: i for g, i in p.get("ids", {}).items() if int(g) < generation}
        name = uuid.uuid4().hex
        self._write("_published.json", {**p, "ids": {**ids, str(generation): name}, "generation": generation, "paths": paths, "records": records, "schema_hash": self.form.schema_hash() if self.form else 0, "id": name})

    def immediate(self, rows: DataFrame, boundary: Column | None = None, every: int = 1) -> int | None:
        """Appends, and publishes if so many batches are staged or a row satisfies the predicate."""
        self.append(rows)
        due = len(self.staged) >= every or boundary is not None and bool(rows.where(boundary).limit(1).count())
        return self.sync() if due else None

    def rollback(self) -> None:
        """Drops what was staged."""
        for x in self.staged:
            self.fs.delete_dir(self.root + x["path"][len(self.path) :])
        self.staged = []

    # Reading.

    def _rows(self, paths: list[dict]) -> DataFrame:
        """The rows of data folders, by one reader; fields that older ones lack are null."""
        known = {f.name: f for x in paths for f in reversed(T.StructType.fromJson(x["schema"]).fields)}
        return self.spark.read.schema(T.StructType(list(known.values()))).parquet(*[x["path"] for x in paths])

    def read(self, generation: int | None = None) -> DataFrame:
        """The log as of a generation, the published one by default, with its generation column."""
        p = self.pointer()
        upto = p["generation"] if generation is None else generation
        if upto > p["generation"]:
            raise StaleCursor("the generation isn't published", wanted=upto, published=p["generation"])
        paths = [x for x in p["paths"] if x["low"] <= upto]
        if not paths:
            raise UsageError("the log is empty")
        return self._rows(paths).where(F.col("generation") <= upto)

    def follow(self, since: int) -> tuple[int, DataFrame | None]:
        """(published generation, rows after a generation)."""
        now = self.pointer()["generation"]
        return (now, self.read().where(F.col("generation") > since)) if now > since else (now, None)

    def cursor(self) -> tuple[str, int, str]:
        """(log, generation, id of the publication): where a reader stands now."""
        p = self.pointer()
        return self.path, p["generation"], p.get("id", "")

    def follow_cursor(self, cursor: tuple[str, int, str]) -> tuple[tuple[str, int, str], DataFrame]:
        """(the cursor moved to what is published now, rows since). Refused if the log is another, or the cursor's generation was published anew."""
        log, generation, name = cursor
        p = self.pointer()
        if log != self.path:
            raise StaleCursor("the cursor belongs to another log", cursor=log, log=self.path)
        if generation >= 0 and p.get("ids", {}).get(str(generation)) != name:
            raise StaleCursor("the generation was published anew", generation=generation)
        return self.cursor(), self.read().where(F.col("generation") > generation)

    def status(self) -> dict:
        """What the writer holds and what is published."""
        p = self.pointer()
        return {"generation": p["generation"], "records": p["records"], "folders": len(p["paths"]), "staged": len(self.staged), "locked": self._read("_lock.json") is not None, "index": p.get("index", {}).get("generation")}

    def bootstrap_index(self, keys: list[str] = ("key",), value: str = "value", progress: Callable[[int, int], None] | None = None, cancelled: Callable[[], bool] = lambda: False) -> bool:
        """Derives the latest state of each key from the log, a generation at a time, and publishes it; whether it did.

        ``progress`` hears the generation and the records so far; once ``cancelled`` says so, nothing is published.
        """
        from tidelog.operators.keyed import states
        from tidelog.plans.envelope import enveloped

        self.lock()
        p, held, seen, old = self.pointer(), None, 0, []
        for g in range(p["generation"] + 1):
            if cancelled():
                break
            rows = self.read(g).where(F.col("generation") == g)
            fresh = states(enveloped(rows), list(keys), (value,)).drop("record_ord")
            both = fresh if held is None else fresh.unionByName(self.spark.read.parquet(f"{self.path}/index/{held}"))
            name, seen = uuid.uuid4().hex, seen + rows.count()
            best = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), F.struct("shard_ord", "sequence")).alias("s"))
            best.select(*keys, "s.*").write.parquet(f"{self.path}/index/{name}")
            old, held = old + ([held] if held else []), name
            if progress:
                progress(g, seen)
        else:
            if held and not cancelled():
                self._write("_published.json", {**p, "index": {"folder": held, "generation": p["generation"]}})
                for x in old:
                    self.fs.delete_dir(f"{self.root}/index/{x}")
                return True
        for x in [*old, held]:
            if x:
                self.fs.delete_dir(f"{self.root}/index/{x}")
        return False

    def index(self) -> DataFrame:
        """The published index; stale if generations came after it."""
        p = self.pointer()
        if p.get("index", {}).get("generation") != p["generation"]:
            raise StaleCursor("the index is older than the log; bootstrap it", index=p.get("index", {}).get("generation"), log=p["generation"])
        return self.spark.read.parquet(f"{self.path}/index/{p['index']['folder']}")

    # Header slots: small values beside the log.

    def slots(self) -> dict[str, bytes]:
        """The header's slots, checked against their checksums and, if sealed, against the seal."""
        held = self._read("_slots.json") or {}
        out = {}
        for name, x in held.items():
            data = base64.b64decode(x["data"])
            if x["crc"] is not None and zlib.crc32(data) != x["crc"]:
                raise CorruptData("a header slot differs from its checksum", slot=name)
            out[name] = data
        return out

    def write_slot(self, name: str, value: bytes | None) -> None:
        """Sets a declared slot, or removes it. Its integrity is none, rolling (a checksum with each write) or sealed (written once)."""
        kind = self.form.header_slots.get(name) if self.form else None
        if kind is None:
            raise UsageError("the format declares no such slot", slot=name)
        held = self._read("_slots.json") or {}
        if kind == "sealed" and name in held:
            raise UsageError("the slot is sealed", slot=name)
        self.lock()
        held.pop(name, None)
        if value is not None:
            held[name] = {"data": base64.b64encode(value).decode(), "crc": None if kind == "none" else zlib.crc32(value)}
        self._write("_slots.json", held)

    def restore(self, generation: int) -> None:
        """Makes an earlier generation the published one; compacted files that go beyond it are rewritten."""
        rows = self.read(generation)
        self.lock()
        p = self.pointer()
        kept = [x for x in p["paths"] if x["low"] <= generation]
        if any(x["high"] > generation for x in kept):
            kept = [self._rewritten(rows, kept)]
        self._publish(p, kept, generation, rows.count())

    def compact_files(self, file_bytes: int = 256 << 20) -> int:
        """Rewrites the published rows into files of about so many bytes and publishes that as a generation without rows of its own.

        Every row keeps its generation, so what a pinned reader reads and what following returns stay the
        same; the old files stay until ``vacuum``.
        """
        rows = self.read()
        self.lock()
        p = self.pointer()
        self._publish(p, [self._rewritten(rows, p["paths"], file_bytes)], p["generation"] + 1, p["records"])
        return p["generation"] + 1

    def _rewritten(self, rows: DataFrame, paths: list[dict], file_bytes: int = 256 << 20) -> dict:
        from pyarrow import fs

        size = sum(f.size or 0 for x in paths for f in self.fs.get_file_info(fs.FileSelector(self.root + x["path"][len(self.path) :])))
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition(max(1, -(-size // file_bytes))).write.parquet(path)
        return {"path": path, "low": min(x["low"] for x in paths), "high": max(x["high"] for x in paths), "schema": rows.schema.jsonValue()}

    def vacuum(self) -> int:
        """Deletes data folders that the published generation doesn't read; how many. Readers of older pointers must have moved on."""
        from pyarrow import fs

        self.lock()
        live = {x["path"].rsplit("/", 1)[-1] for x in self.pointer()["paths"] + self.staged}
        old = [f.path for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True)) if f.base_name not in live]
        for x in old:
            self.fs.delete_dir(x)
        return len(old)


def header_slots(slots: dict[str, bytes], name: str, value: bytes | None, sealed: frozenset[str] = frozenset()) -> dict[str, bytes]:
    """The editable header after a write or removal; sealed slots are refused."""
    if name in sealed:
        raise UsageError("the slot is sealed", slot=name)
    return {k: v for k, v in slots.items() if k != name} | ({} if value is None else {name: value})
