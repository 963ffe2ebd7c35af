"""WARC archives, index first.

Writing deals payloads to tasks, each of which writes one archive (a gzip member for each record)
into the shared folder and returns an index row for each record: archive, offset, length, URL, digest.
The index is a Parquet table; an archive of a lost or repeated attempt has a name of its own that no
committed index row bears, so attempts never mix. Reading starts from index rows, whichever are selected:
they are dealt by archive and stretch of it, sorted by offset, and near ranges are coalesced into one
read. Payload digests are verified as records are read.

Of records with equal payloads, that with the largest page_id is the response and the others revisit it.
The choice is an aggregate over digests alone; payloads are shuffled once, by a join whose hot
digests the adaptive planner may split, since archives may hold any records.

Folders are opened through Arrow's filesystems: file, HDFS and object-store addresses.

Defined results: a null html is an empty payload; a null URL an empty one; control characters and
spaces in a URL are percent-encoded in its record. Rows that tie at the largest page_id are all
responses; a null page_id is less than any other; an empty table gives an empty table; other columns
are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import partitions, shared_path

DATE = "2020-01-01T00:00:00Z"
GAP, READ, STRETCH = 64 << 10, 8 << 20, 16 << 20
INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """The bytes of a record, not compressed, and its payload digest."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
    return head + b"\r\n\r\n" + block + b"\r\n\r\n", sha


def parse(raw: bytes) -> dict:
    """Type, ids, digest and payload of a record; ``payload`` is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    of = lambda v: int(v[10:-1]) if v and v != "<urn:page:>" else None
    revisit, sha = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != sha:
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"record_type": fields["warc-type"], "page_id": of(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "payload_digest": sha, "payload_bytes": size, "refers_to": of(fields.get("warc-refers-to")), "payload": None if revisit else payload}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each page (page_id, url, html) under the folder; returns the index, read from its table."""
    import pyarrow as pa
    from pyarrow import fs

    spark = pages.sparkSession
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/archives", recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    keep = rows.groupBy("sha", "size").agg(F.max("page_id").alias("keeper"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    dealt = rows.join(keep, ["sha", "size"]).select("page_id", "url", "html", F.when(revisit, F.col("keeper")).alias("refers_to"))

    def write(batches):
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                entries = []
                for p, url, text, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = text.encode("utf-8", "surrogatepass")
                    raw, sha = record(p, url, payload, to, to is not None)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    packed = packer.compress(raw) + packer.flush()
                    if out is None:
                        out = fs.FileSystem.from_uri(folder)[0].open_output_stream(f"{path}/archives/{name}", compression=None)
                    out.write(packed)
                    entries.append((p, url, name, at, len(packed), sha, len(payload), "response" if to is None else "revisit", to))
                    at += len(packed)
                if entries:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of index rows: page_id, url, payload_digest, payload_bytes, record_type, refers_to and, if asked for, payload (binary).

    A stretch that is read at once unpacks to batches of about ``READ`` bytes, or of one record that is longer.
    """
    import pyarrow as pa
    from pyarrow import fs

    _, path = fs.FileSystem.from_uri(folder)
    names = ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    if not payloads:
        names, kinds = names[:-1], kinds[:-1]

    def made(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def stretches(batches):
        """Runs of near ranges of one archive, as (archive, [(offset, length)])."""
        name, run = None, []
        for batch in batches:
            for a, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (a != name or o - (run[-1][0] + run[-1][1]) > GAP or o + n - run[0][0] > READ):
                    yield name, run
                    run = []
                name = a
                run.append((o, n))
        if run:
            yield name, run

    def read(batches):
        store, opened, file = fs.FileSystem.from_uri(folder)[0], None, None
        for name, run in stretches(batches):
            if name != opened:
                file, opened = store.open_input_file(f"{path}/archives/{name}"), name
            first = run[0][0]
            data = file.read_at(max(o + n for o, n in run) - first, first)
            found, held = [], 0
            for o, n in run:
                r = parse(zlib.decompress(data[o - first : o - first + n], 31))
                held += len(r["payload"] or b"") if payloads else 0
                found.append([r[c] for c in names])
                if held >= READ:
                    yield made(found)
                    found, held = [], 0
            if found:
                yield made(found)

    places = selected.select("archive", "offset", "length")
    dealt = places.repartition(partitions(spark), F.col("archive"), F.expr(f"offset div {STRETCH}")).sortWithinPartitions("archive", "offset")
    schema = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
    return dealt.mapInArrow(read, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder and reads every record back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    index = write_archives(pages, folder)
    return read_records(spark, folder, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
