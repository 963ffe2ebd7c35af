"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text. Boundaries are normalised: before the normal
chunk length a boundary needs more zero bits than after it, so lengths gather around the normal
one. A boundary depends on the ``WINDOW`` bytes before it and on the last boundary, so chunks on
both sides of an edit stay the same. A fingerprint is the set of chunk digests, each weighted by
its chunk's length; likeness is the weight that one set finds in another over its own weight
(containment).

Defined results: null texts count as empty; an empty text has the empty fingerprint, which is
contained in another empty one (1.0) and in nothing else (0.0). Documents are ordered by
descending key, null keys last; rows with equal keys by text, and repeated rows follow each other.
An empty table gives an empty table. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import partitions, pieces, text_or_empty

WINDOW, SHORTEST, NORMAL, LONGEST = 32, 32, 64, 256
#: The highest bits count: they depend on the whole window. Seven zero bits before NORMAL, five after.
STRICT, EASY = np.uint32(0xFE000000), np.uint32(0xF8000000)
DIGEST = 12


def gear(seed: int = 1) -> np.ndarray:
    """A random 32-bit number for each byte."""
    rng = random.Random(seed)
    return np.array([rng.getrandbits(32) for _ in range(256)], dtype=np.uint32)


GEAR = gear()


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte. Shifted left once a byte, 32 bits hold the last 32 bytes only, so it doubles up."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def boundaries(data: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places (after which byte) that satisfy the strict and the easy mask, found block by block."""
    strict, easy = [], []
    for begin in range(0, len(data), block):
        lead = min(begin, WINDOW - 1)
        h = rolled(data[begin - lead : begin + block])[lead:]
        at = np.flatnonzero((h & EASY) == 0)
        easy.append(at + begin)
        strict.append(at[(h[at] & STRICT) == 0] + begin)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(strict or none), np.concatenate(easy or none)


def chunk_ends(n: int, strict: list[int], easy: list[int]) -> list[int]:
    """Where chunks of a text of n bytes end, from the sorted places that satisfy each mask."""
    ends, start = [], 0
    while n - start > SHORTEST:
        normal, longest = min(start + NORMAL, n), min(start + LONGEST, n)
        i = bisect_left(strict, start + SHORTEST)
        if i < len(strict) and strict[i] < normal:
            start = strict[i]
        else:
            i = bisect_left(easy, normal)
            start = easy[i] if i < len(easy) and easy[i] < longest else longest
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprints(texts: list[bytes]) -> list[dict[str, int]]:
    """The chunk digests and lengths of each text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    strict, easy = boundaries(np.frombuffer(b"".join(texts), dtype=np.uint8))
    at_easy, at_strict = np.searchsorted(easy, begins), np.searchsorted(strict, begins)
    out = []
    for i, text in enumerate(texts):
        of = lambda places, at: (places[at[i] : at[i + 1]] - begins[i] + 1).tolist()  # noqa: B023, E731
        start, found = 0, {}
        for end in chunk_ends(len(text), of(strict, at_strict), of(easy, at_easy)):
            found[xxhash.xxh3_64_hexdigest(text[start:end])[:DIGEST]] = end - start
            start = end
        out.append(found)
    return out


def written(found: dict[str, int]) -> str:
    return " ".join(f"{d}:{n}" for d, n in sorted(found.items()))


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """The part of a's weight that b holds, from 0 to 1."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, other: str) -> str:
    """The text, its last half replaced by as much of the other's start."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, extra, key, text), dealt so that the row after each in descending key order is in its part.

    Parts are ranges of the key. The first rows of each part also go, as ``extra``, to the end of
    the part before it, and those of the first part to the end of the last. The driver holds two
    numbers for each part; each text is shuffled once.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    number = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    cuts = sorted(set(docs.agg(F.percentile_approx(number, [i / n for i in range(1, n + 1)], max(10_000, 20 * n))).head()[0] or []))
    bounds = np.asarray(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(k):
        import pandas as pd

        return pd.Series(len(bounds) - np.searchsorted(bounds, k.to_numpy()))

    parts = docs.select(number.alias("k")).select(part_of("k").alias("part"), "k").groupBy("part").agg(F.max("k").alias("first")).collect()
    first = {r["part"]: r["first"] for r in parts}
    order = sorted(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    size = len(cuts) + 1
    at = lambda values: F.array(*[F.lit(values.get(p)).cast("long") for p in range(size)])[F.col("part")]
    home = F.struct(F.col("part"), F.lit(False).alias("extra"))
    away = F.struct(at(before).cast("int").alias("part"), F.lit(True).alias("extra"))
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), number.alias("k")).withColumn("part", part_of("k"))
    placed = F.explode(F.when(F.col("k") == at(first), F.array(home, away)).otherwise(F.array(home)))
    rows = rows.select("key", "text", "k", placed.alias("at")).select("at.part", "at.extra", "k", "key", "text")
    return rows.repartitionById(size, F.col("part")).sortWithinPartitions("part", "extra", F.desc("k"), "text")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", with_edited: bool = False) -> DataFrame:
    """The fingerprint of every whole text and of its edited text, and both likenesses.

    Returns ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and, with ``with_edited``, the edited text. A worker holds one batch of texts and
    the row whose successor it awaits.
    """
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def results(pairs, ids):
        """Rows for pairs of (text, fingerprint) and the next one."""
        new = [edited(a[0], b[0]) for a, b in pairs]
        raw = [x.encode() for x in new]
        prints = fingerprints(raw)
        columns = [
            [len(a[0]) for a, _ in pairs],
            [hashlib.sha256(x).hexdigest() for x in raw],
            [written(a[1]) for a, _ in pairs],
            [written(x) for x in prints],
            [likeness(a[1], x) for (a, _), x in zip(pairs, prints, strict=True)],
            [likeness(a[1], b[1]) for a, b in pairs],
        ]
        arrays = [ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(new, pa.string())] if with_edited else []), names + ["edited"] * with_edited)

    def run(batches):
        waiting = None  # (part, key as an array of one, (text, fingerprint))
        for batch in batches:
            for piece in pieces(batch, 2):
                part, extra = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                texts = piece.column(2).to_pylist()
                met = list(zip(texts, fingerprints([t.encode() for t in texts]), strict=True))
                pairs, ids = [], []
                for i, entry in enumerate(met):
                    if waiting and waiting[0] == part[i]:
                        pairs.append((waiting[2], entry))
                        ids.append(waiting[1])
                        waiting = None
                    if not extra[i]:
                        waiting = (part[i], piece.column(3).slice(i, 1), entry)
                if pairs:
                    yield results(pairs, pa.concat_arrays(ids))

    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, key, text).select("part", "extra", "text", "key").mapInArrow(run, schema + ", edited string" * with_edited)
