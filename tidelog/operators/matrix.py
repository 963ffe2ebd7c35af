"""Matrices: cells addressed by (scan, ch), visible once committed.

A matrix is a log of cell events (generation, seq, op, scan, ch, payload, crc). Its state is the last
write, commit or clear of each cell, a partial aggregate by cell; whole-matrix reads partition by chunks of
scans, so a matrix grows along its first dimension without rewriting the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.errors import CorruptData, LimitExceeded, NotCommitted, NotWritten, OutOfDomain

WRITE, COMMIT, CLEAR = "WRITE", "COMMIT_CELL", "CLEAR"
PAGE_BITS = 32_768


@dataclass(frozen=True)
class Dims:
    scans: int
    channels: int
    max_cells: int = 16_000_000

    def __post_init__(self):
        if self.scans * self.channels > self.max_cells:
            raise LimitExceeded("too many cells", cells=self.scans * self.channels, bound=self.max_cells)

    def keyspace(self, spark: SparkSession) -> DataFrame:
        """Every cell: (ordinal, scan, ch)."""
        n = F.lit(self.channels)
        return spark.range(self.scans * self.channels).select(F.col("id").alias("ordinal"), F.floor(F.col("id") / n).alias("scan"), (F.col("id") % n).alias("ch"))

    def ordinal(self, scan: str = "scan", ch: str = "ch") -> Column:
        """A cell's ordinal; coordinates outside the matrix fail the query."""
        inside = F.col(scan).between(0, self.scans - 1) & F.col(ch).between(0, self.channels - 1)
        bad = F.raise_error(F.concat(F.lit(f"[{OutOfDomain.__name__}] cell outside the matrix: "), F.to_json(F.struct(scan, ch))))
        return F.when(inside, F.col(scan) * self.channels + F.col(ch)).otherwise(bad.cast("long"))


def cells_of_vectors(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Vectors as cells: scan is the vector, ch the position."""
    return vectors.select(F.col(key).alias("scan"), F.posexplode(values).alias("ch", "value")).withColumn("ch", F.col("ch").cast("long"))


def state(events: DataFrame, generation: int | None = None) -> DataFrame:
    """Each touched cell's payload and whether it is committed, of the events up to a generation.

    A write clears the commit, a clear the checksum too; a commit counts if it is the last event.
    """
    if generation is not None:
        events = events.where(F.col("generation") <= generation)
    order = F.struct("generation", "seq")
    written = F.when(F.col("op") == WRITE, order)
    last = events.groupBy("scan", "ch").agg(F.max_by("op", order).alias("last_op"), F.max_by("payload", written).alias("payload"), F.max_by(F.when(F.col("op") == COMMIT, F.col("crc")), F.when(F.col("op") != WRITE, order)).alias("crc"), F.max(written).isNotNull().alias("written"))
    return last.select("scan", "ch", "payload", "crc", "written", (F.col("last_op") == COMMIT).alias("committed"))


def guard_commits(events: DataFrame) -> None:
    """Refuses commits of cells that were never written."""
    bad = state(events).where(F.col("committed") & ~F.col("written")).limit(1).collect()
    if bad:
        raise NotWritten("a commit of an unwritten cell", scan=bad[0]["scan"], ch=bad[0]["ch"])


def read_cells(cells: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Payloads of committed cells; of ``wanted`` cells, an uncommitted one fails the query. So does a payload that differs from its checksum."""
    if wanted is None:
        met = cells.where("committed")
    else:
        met = wanted.select("scan", "ch").join(cells, ["scan", "ch"], "left")
        bad = F.raise_error(F.concat(F.lit(f"[{NotCommitted.__name__}] "), F.to_json(F.struct("scan", "ch"))))
        met = met.where(F.when(F.coalesce("committed", F.lit(False)), F.lit(True)).otherwise(bad.cast("boolean")))
    torn = F.raise_error(F.concat(F.lit(f"[{CorruptData.__name__}] a cell differs from its checksum: "), F.to_json(F.struct("scan", "ch"))))
    return met.where(F.when(F.col("crc").isNull() | (F.crc32("payload") == F.col("crc")), F.lit(True)).otherwise(torn.cast("boolean")))


def status(cells: DataFrame, dims: Dims) -> DataFrame:
    """Every cell of the keyspace and whether it is committed."""
    space = dims.keyspace(cells.sparkSession)
    return space.join(cells.select("scan", "ch", "committed"), ["scan", "ch"], "left").withColumn("committed", F.coalesce("committed", F.lit(False)))


def clear(cells: DataFrame, where: Column | None = None) -> DataFrame:
    """Cells with their commit and checksum gone, all or those of a predicate."""
    hit = F.lit(True) if where is None else where
    return cells.withColumn("committed", F.col("committed") & ~hit).withColumn("crc", F.when(~hit, F.col("crc")))


def clear_category(cells: DataFrame, category: str, column: str = "category") -> DataFrame:
    """The cells with one category's commits gone; this also ends its quarantine."""
    return clear(cells, F.col(column) == category)


def cleared_by(cells: DataFrame, category: str, column: str = "category") -> DataFrame:
    """A row: how many commits clearing the category takes away."""
    return cells.agg(F.count_if(F.col("committed") & (F.col(column) == category)).alias("cleared"))


def resume(cells: DataFrame, dims: Dims, sidecar: bool | None = None) -> DataFrame:
    """A row: committed and total cells, and what to do.

    None or all committed is Clean, else Partial. Where a sidecar is asked about: Discard it if none or all are
    committed, else Resume from it; without one Clean or Restart.
    """
    total = dims.scans * dims.channels
    done = cells.agg(F.count_if("committed").alias("committed"))
    whole, part = {None: ("Clean", "Partial"), True: ("Discard", "Resume"), False: ("Clean", "Restart")}[sidecar]
    signal = F.when(F.col("committed").isin(0, total), whole).otherwise(part)
    return done.select("committed", F.lit(total).cast("long").alias("total"), signal.alias("signal"))


def rebuild(cells: DataFrame, strict: bool = False) -> DataFrame:
    """The commit map by evidence: committed if, and only if, there is a checksum and the payload has it.

    ``strict`` refuses incomplete evidence: a checksum whose cell has no payload.
    """
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"[{CorruptData.__name__}] no payload for a checksum: "), F.to_json(F.struct("scan", "ch"))))
        cells = cells.where(F.when(F.col("crc").isNull() | F.col("payload").isNotNull(), F.lit(True)).otherwise(bad.cast("boolean")))
    return cells.withColumn("committed", F.coalesce(F.crc32("payload") == F.col("crc"), F.lit(False)))


def verify_pages(cells: DataFrame, dims: Dims, by: tuple[str, ...] = ()) -> DataFrame:
    """Damaged cells by page of the commit map, of each category where ``by`` names its column: (page, cells, damaged, action)."""
    page = F.floor(dims.ordinal() / PAGE_BITS)
    damaged = F.col("committed") & ~F.coalesce(F.crc32("payload") == F.col("crc"), F.lit(False))
    found = cells.groupBy(*by, page.alias("page")).agg(F.count("*").alias("cells"), F.count_if(damaged).alias("damaged"))
    return found.withColumn("action", F.when(F.col("damaged") > 0, "Quarantine").otherwise("None"))


def quarantine(cells: DataFrame, dims: Dims, category: str = "category") -> DataFrame:
    """Cells of sound categories: one damaged page makes its whole category fail closed."""
    bad = verify_pages(cells, dims, (category,)).where("damaged > 0").select(F.col(category).alias("_bad")).distinct()
    return cells.join(bad, F.col(category).eqNullSafe(F.col("_bad")), "left_anti")


def recovery(cells: DataFrame, action: str, where: Column | None = None) -> DataFrame:
    """Executes a recovery action on all cells or those of a predicate: quarantined cells are gone, so reading them fails."""
    hit = F.lit(True) if where is None else where
    return {"None": lambda c: c, "Clear": lambda c: clear(c, where), "Quarantine": lambda c: c.where(~F.coalesce(hit, F.lit(False))), "Rebuild": rebuild}[action](cells)


def changed(events: DataFrame, old: int, new: int) -> DataFrame:
    """Cells that following from one generation to another must read anew."""
    return events.where((F.col("generation") > old) & (F.col("generation") <= new)).select("scan", "ch").distinct()


def chunk_of(rows_per_chunk: int, scan: str = "scan") -> Column:
    """The chunk along the growing dimension."""
    return F.floor(F.col(scan) / rows_per_chunk)


def copy_cells(source: DataFrame, target: DataFrame) -> DataFrame:
    """Target cells with the bytes of the source's committed cells where there are such; copies aren't committed."""
    new = source.where("committed").select("scan", "ch", F.col("payload").alias("_p"))
    met = target.join(new, ["scan", "ch"], "left")
    return met.withColumn("payload", F.coalesce("_p", "payload")).withColumn("committed", F.col("committed") & F.col("_p").isNull()).drop("_p")


def set_flags(flags: DataFrame, name: str, ch: int | None, value: bool) -> DataFrame:
    """The flag table (name, ch, value) with one flag set; ``ch`` is null for single flags."""
    one = flags.sparkSession.createDataFrame([(name, ch, value)], "name string, ch long, value boolean")
    rest = flags.where(~(F.col("name").eqNullSafe(name) & F.col("ch").eqNullSafe(ch)))
    return rest.unionByName(one)


def write_aux(region: bytes, offset: int, data: bytes) -> bytes:
    """An aux region after a write; it isn't gated by commits."""
    if offset < 0 or offset + len(data) > len(region):
        raise OutOfDomain("bytes outside the region", offset=offset, length=len(data))
    return region[:offset] + data + region[offset + len(data) :]
