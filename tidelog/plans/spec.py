"""Formats: what blocks a log holds, their keys, versions and policies. Declared in Python, checked once."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.plans.errors import LimitExceeded, OutOfDomain, SpecError

#: Wire types by name. Unsigned types widen by a step; 128-bit integers don't fit a decimal and stay binary.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "u128": T.BinaryType(), "i128": T.BinaryType(),
    "f32": T.FloatType(), "f64": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "unit": T.NullType(),
}
RANGES = {"u8": 2**8, "u16": 2**16, "u32": 2**32, "u64": 2**64}
MAX_FINITE_KEYS = 4096


def spark_type(wire: str) -> T.DataType:
    """``T?`` is nullable elsewhere, ``[T]`` an array, ``{K:V}`` a map, ``(A,B)`` a tuple."""
    wire = wire.strip()
    if wire.endswith("?"):
        return spark_type(wire[:-1])
    if wire.startswith("[") and wire.endswith("]"):
        return T.ArrayType(spark_type(wire[1:-1].partition(";")[0]), False)
    if wire.startswith("{") and wire.endswith("}"):
        k, _, v = wire[1:-1].partition(":")
        return T.MapType(spark_type(k), spark_type(v), False)
    if wire.startswith("(") and wire.endswith(")"):
        parts = wire[1:-1].split(",")
        if not 2 <= len(parts) <= 4:
            raise SpecError("tuples have two to four parts", wire=wire)
        return T.StructType([T.StructField(f"_{i}", spark_type(p), False) for i, p in enumerate(parts, 1)])
    if wire not in TYPES:
        raise SpecError("unknown wire type", wire=wire)
    return TYPES[wire]


@dataclass(frozen=True)
class Field:
    name: str
    wire: str
    default: object = None
    defaulted: bool = False


@dataclass(frozen=True)
class Block:
    """A record type. ``keys`` are fields; ``domain`` lists each key field's legal values, if they are finite."""

    id: int
    name: str
    fields: tuple[Field, ...]
    version: int = 1
    kind: str = "variable"
    keys: tuple[str, ...] = ()
    domain: tuple[tuple, ...] = ()
    indexed: bool = False
    resident: bool = True
    immediate_records: int = 0
    immediate_bytes: int = 0

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.wire), f.wire.endswith("?")) for f in self.fields])


@dataclass(frozen=True)
class Limits:
    """Bounds on what a reader accepts; None is no bound. ``meet`` takes the stricter of two, ``overlay`` the other's where it has one."""

    records: int | None = None
    payload: int | None = None
    total: int | None = None
    cells: int | None = 16_000_000
    keys: int | None = None

    def meet(self, other: Limits) -> Limits:
        return Limits(*[min((v for v in (getattr(self, f.name), getattr(other, f.name)) if v is not None), default=None) for f in fields(self)])

    def overlay(self, other: Limits) -> Limits:
        return Limits(*[getattr(other, f.name) if getattr(other, f.name) is not None else getattr(self, f.name) for f in fields(self)])

    def check(self, log: DataFrame) -> DataFrame:
        """The log, if one aggregate over it keeps the bounds."""
        n, most, total = log.agg(F.count("*"), F.max("stored_len"), F.sum("stored_len")).head()
        for name, value, bound in (("records", n, self.records), ("payload", most, self.payload), ("total", total, self.total)):
            if bound is not None and (value or 0) > bound:
                raise LimitExceeded("a read limit is exceeded", limit=name, value=value, bound=bound)
        return log


#: Presets of limits, from the strictest.
LIMITS = {"strict": Limits(10**6, 1 << 20, 1 << 30), "standard": Limits(10**9, 1 << 26, 1 << 40), "none": Limits(cells=None)}


@dataclass(frozen=True)
class Format:
    magic: str
    blocks: tuple[Block, ...]
    version: int = 1
    endian: str = "little"
    commit: str = "none"
    integrity: str = "crc32"
    recovery: str = "strict"
    chained: bool = False
    keyed_chain: bool = False
    compression: str = "none"
    pinned_hash: int = 0
    dims: tuple[str, ...] = ()
    header_slots: dict[str, str] = field(default_factory=dict)
    limits: Limits = LIMITS["standard"]

    def block(self, name: str) -> Block:
        found = [b for b in self.blocks if b.name == name]
        if not found:
            raise SpecError("no such block", block=name)
        return found[0]

    def validate(self) -> Format:
        """The format itself, or the first thing that is wrong with it."""
        for name, value, legal in (("endian", self.endian, ("little", "big")), ("commit", self.commit, ("none", "footer", "on_flush", "explicit")), ("integrity", self.integrity, ("none", "crc32", "crc32_with_header")), ("recovery", self.recovery, ("strict", "truncate_tail", "mark_tail")), ("compression", self.compression, ("none", "zstd"))):
            if value not in legal:
                raise SpecError(f"unknown {name}", value=value, legal=legal)
        if not self.magic:
            raise SpecError("a format needs a magic")
        if bad := {k: v for k, v in self.header_slots.items() if v not in ("none", "rolling", "sealed")}:
            raise SpecError("unknown integrity of a header slot", slots=bad)
        seen: set[tuple[int, int]] = set()
        for b in self.blocks:
            if (b.id, b.version) in seen:
                raise SpecError("two blocks have one id and version", id=b.id, version=b.version)
            seen.add((b.id, b.version))
            if not 0 < b.id < 2**32 or not 0 < b.version < 2**16:
                raise SpecError("id or version out of range", block=b.name)
            names = [f.name for f in b.fields]
            if len(set(names)) != len(names):
                raise SpecError("two fields have one name", block=b.name)
            if missing := [k for k in b.keys if k not in names]:
                raise SpecError("a key is no field", block=b.name, keys=missing)
            if b.kind not in ("fixed", "variable", "matrix", "internal"):
                raise SpecError("unknown kind", block=b.name, kind=b.kind)
            if b.kind == "matrix" and not self.dims:
                raise SpecError("a matrix block needs dimensions", block=b.name)
            if b.indexed and not b.keys:
                raise SpecError("an index needs a key", block=b.name)
            if b.domain:
                size = 1
                for values in b.domain:
                    size *= len(values)
                if len(b.domain) != len(b.keys) or not 0 < size <= MAX_FINITE_KEYS:
                    raise SpecError("a key domain has a list for each key and 1 to 4096 combinations", block=b.name, size=size)
            b.schema()
        if self.pinned_hash and self.pinned_hash != (now := replace(self, pinned_hash=0).schema_hash()):
            raise SpecError("the schema differs from its pinned hash", pinned=self.pinned_hash, now=now)
        return self

    def schema_hash(self) -> int:
        """64-bit FNV-1a over everything that affects how records are read, in declared order."""
        text = repr((self.magic, self.version, self.endian, [(b.id, b.version, b.kind, b.keys, [(f.name, f.wire, f.defaulted) for f in b.fields]) for b in self.blocks]))
        h = 0xCBF29CE484222325
        for byte in text.encode():
            h = (h ^ byte) * 0x100000001B3 % 2**64
        return h

    def describe(self, spark: SparkSession) -> DataFrame:
        """A row for each field: the effective plan of the format."""
        rows = [(b.id, b.version, b.name, b.kind, i, f.name, f.wire, spark_type(f.wire).simpleString(), f.name in b.keys) for b in self.blocks for i, f in enumerate(b.fields)]
        return spark.createDataFrame(rows, "block_id long, block_version int, block string, kind string, position int, field string, wire string, type string, is_key boolean")

    def diagnose(self, spark: SparkSession) -> DataFrame:
        """Rows (severity, code, message); none but information when all is well."""
        rows = [("info", "schema_hash", f"{self.schema_hash():016x}")]
        try:
            self.validate()
        except SpecError as e:
            rows.append(("error", "invalid", str(e)))
        if self.commit == "none" and self.recovery != "strict":
            rows.append(("warning", "recovery", "without commit markers a recovered tail can't be told from a whole record"))
        if self.integrity == "none":
            rows.append(("warning", "integrity", "damage goes unnoticed"))
        return spark.createDataFrame(rows, "severity string, code string, message string")


def finite_keys(spark: SparkSession, block: Block) -> DataFrame:
    """Rows (code, key fields): the block's key domain, the last field fastest. At most 4096 rows."""
    if not block.domain:
        raise SpecError("the block's keys aren't finite", block=block.name)
    rows = [(i, *values) for i, values in enumerate(product(*block.domain))]
    wires = {f.name: f.wire for f in block.fields}
    return spark.createDataFrame(rows, T.StructType([T.StructField("code", T.IntegerType())] + [T.StructField(k, spark_type(wires[k])) for k in block.keys]))


def with_codes(df: DataFrame, block: Block) -> DataFrame:
    """The rows with the code of their key; a key outside the domain fails the query."""
    codes = F.broadcast(finite_keys(df.sparkSession, block))  # at most 4096 rows
    joined = df.join(codes, list(block.keys), "left")
    outside = F.raise_error(F.concat(F.lit(f"[{OutOfDomain.__name__}] key outside the domain: "), F.to_json(F.struct(*block.keys))))
    return joined.withColumn("code", F.when(F.col("code").isNull(), outside.cast("int")).otherwise(F.col("code")))
