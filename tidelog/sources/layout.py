"""Externally framed files: segments of a lead-in, metadata, raw bytes and a footer.

A layout is declared by its lead-in fields, of which one is a literal that starts each segment, and by
the fields that hold the offsets of the raw part and of the next segment. Files are chains of offsets, so
a file is a task; segments come out as rows.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans.errors import CorruptData, SpecError

_SIZES = {"u8": "B", "u16": "H", "u32": "I", "u64": "Q", "i64": "q"}


@dataclass(frozen=True)
class Kind:
    """A segment kind: the literal it starts with and its lead-in fields (name, type), two of which are next and raw."""

    name: str
    literal: bytes
    fields: tuple[tuple[str, str], ...]
    next: str = "next_offset"
    raw: str = "raw_offset"

    def form(self) -> struct.Struct:
        return struct.Struct("<" + "".join(_SIZES[t] for _, t in self.fields))

    @property
    def size(self) -> int:
        return len(self.literal) + self.form().size


@dataclass(frozen=True)
class Layout:
    kinds: tuple[Kind, ...]
    header: bytes = b""

    def validate(self) -> Layout:
        for i, a in enumerate(self.kinds):
            names = [n for n, _ in a.fields]
            if not a.literal or a.next not in names or a.raw not in names:
                raise SpecError("a kind needs a literal, a next and a raw offset", kind=a.name)
            for b in self.kinds[i + 1 :]:
                if a.literal.startswith(b.literal) or b.literal.startswith(a.literal):
                    raise SpecError("two kinds can't be told apart", kinds=(a.name, b.name))
        return self


def write_segment(kind: Kind, values: dict[str, int], metadata: bytes, raw: bytes) -> bytes:
    """A segment's bytes; its offsets are computed, whatever the values say."""
    values = values | {kind.raw: len(metadata), kind.next: len(metadata) + len(raw)}
    return kind.literal + kind.form().pack(*[values[n] for n, _ in kind.fields]) + metadata + raw


def parse(layout: Layout, data: bytes) -> tuple[list[tuple], str]:
    """((kind, offset, lead-in values, metadata, raw) of each segment, how the file ends: Clean, Torn or Unknown)."""
    if not data.startswith(layout.header):
        raise CorruptData("the file's header differs")
    at, out = len(layout.header), []
    while at < len(data):
        kind = next((k for k in layout.kinds if data.startswith(k.literal, at)), None)
        if kind is None:
            return out, "Unknown"
        if at + kind.size > len(data):
            return out, "Torn"
        values = dict(zip([n for n, _ in kind.fields], kind.form().unpack_from(data, at + len(kind.literal)), strict=True))
        body, end = at + kind.size, at + kind.size + values[kind.next]
        if values[kind.raw] > values[kind.next]:
            raise CorruptData("a raw part begins after its segment", at=at)
        if end > len(data):
            return out, "Torn"
        out.append((kind.name, at, values, data[body : body + values[kind.raw]], data[body + values[kind.raw] : end]))
        at = end
    return out, "Clean"


def read_segments(spark: SparkSession, path: str, layout: Layout, strict: bool = True) -> DataFrame:
    """Rows (file, kind, record_ord, offset, lead_in, metadata, raw, tail), one for each segment.

    Strict reads fail at a tail that isn't whole; others report it in ``tail``.
    """
    layout.validate()
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, tail = parse(layout, content)
                if strict and tail != "Clean":
                    raise CorruptData("a file's tail isn't whole", file=name, tail=tail)
                rows = [(name, k, i, at, list(v.items()), m, r, tail) for i, (k, at, v, m, r) in enumerate(found)]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.int64()), pa.binary(), pa.binary(), pa.string()]
                names = ["file", "kind", "record_ord", "offset", "lead_in", "metadata", "raw", "tail"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, "file string, kind string, record_ord long, offset long, lead_in map<string,long>, metadata binary, raw binary, tail string")
