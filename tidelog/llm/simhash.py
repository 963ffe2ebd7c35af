"""SimHash near-duplicates with BK-trees.

``simhash_components`` (query op8): fingerprints of at most ``RADIUS`` differing bits are linked,
components follow links. Equal fingerprints are one node from the start. Trees are sharded by the
pigeonhole principle: of four 16-bit blocks one is equal in two linked fingerprints, and of four
12-bit blocks of the other 48 bits another one, so each of 16 tables keys a fingerprint by 28 of its
bits and linked fingerprints meet in a shard. A shard's BK-tree (children keyed by the integer
Hamming distance to their parent) is built where its members are, and every member follows only
the edges that the triangle inequality leaves within the radius. Trees travel to the tasks that
can match them rather than to all tasks by broadcast: a broadcast of all trees would grow with the
corpus and have every document search every tree, which is quadratic. A shard of more than
``SHARD`` members is cut into pieces that meet each other in blocks. Of the links in a shard a
spanning forest is kept, so what leaves a shard is linear in its members; components of the whole
come from rounds of large-star and small-star steps on links alone, checkpointed.

``near_dedup`` (pipeline stage): word shingles of five, similarity (Jaccard) of 0.8 or more, and of each
component of similar texts the first one stays. At that similarity 64-bit fingerprints differ in 10
bits on average, with a deviation of 3, where pigeonhole shards no longer help, so shards are keyed by the
eight least shingle hashes of a text: two texts of similarity 0.8 share none of them with probability
0.2**8. A shard's BK-tree is searched within ``WIDE`` bits, which is five deviations; texts of few shingles,
whose fingerprints part further, meet all others of few. What a search returns is verified by the least
``SKETCH`` shingle hashes, which are all hashes of most texts; of longer texts they are an estimate, and
where that comes within ``NEAR`` of the threshold (four and a half standard errors) the pair is verified by
all shingle hashes of both texts. Of a shard's links a spanning forest is kept. Shards of more than ``shard``
texts are cut into pieces; then those in which links leave more than one component compare the pieces with each
other, texts of different components only, so the size of pieces never changes the result.

Defined results: null texts count as empty; texts without words have the fingerprint zero and are
linked like any other; repeated rows and ties give a row each; a null key gives a row whose key is
null, and null keys are no component's id unless a component has no other; an empty table gives an empty
table; other columns of the input keep their names and never clash, since inner columns are
selected by position from narrow tables.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, kept_table, partitions, pieces, text_or_empty

BITS, RADIUS, WIDE = 64, 3, 24
SHARD = 20_000
ANCHORS, SKETCH, NEAR, FEW = 8, 512, 0.08, 32
#: Texts that are verified by all their hashes are found by broadcast if they are so many at most (some 10 MB).
SOUGHT = 200_000


def shingles(text: str, words: int) -> list[bytes]:
    """The text's word shingles, A-Z in lower case, repeats included; of fewer words the whole sequence."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    return [b" ".join(t) for t in zip(*(w[i:] for i in range(words)))] if len(w) > words else [b" ".join(w)]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, with seed 42."""
    found = shingles(text, words)
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in found), dtype=np.uint64, count=len(found))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints; all searches go down it together, level by level.

    Nodes are numbered in order of insertion. Children lie together, sorted by edge.
    """

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        n = len(self.values)
        parent, edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # Whole sets descend at once: of those that reach a node by an edge, the first becomes its child there.
        todo, node = np.arange(1, n), np.zeros(max(0, n - 1), dtype=np.int64)
        while len(todo):
            d = np.bitwise_count(self.values[todo] ^ self.values[node]).astype(np.int64)
            key = node * (BITS + 1) + d
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            child = todo[first]
            parent[child], edge[child] = node[first], d[first]
            rest = np.ones(len(todo), dtype=bool)
            rest[first] = False
            todo, node = todo[rest], child[which][rest]
        order = np.argsort(parent * (BITS + 1) + edge, kind="stable")
        order = order[1:] if n else order  # the root has no parent
        self.child = order
        self.at = parent[order] * (BITS + 1) + edge[order]

    def search(self, queries: np.ndarray, radius: int, block: int = 4096):
        """Yields arrays (query number, node number, distance) of all within the radius."""
        queries = queries.astype(np.uint64)
        for begin in range(0, len(queries) if len(self.values) else 0, block):
            q = np.arange(begin, min(begin + block, len(queries)))
            node = np.zeros(len(q), dtype=np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near], d[near]
                base = node * (BITS + 1)
                low = np.searchsorted(self.at, base + np.maximum(d - radius, 0))
                high = np.searchsorted(self.at, base + np.minimum(d + radius, BITS), side="right")
                width = high - low
                where = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
                q, node = np.repeat(q, width), self.child[where]


class Union:
    """Disjoint sets of numbers; the smallest stands for its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (value, smaller value of its set) that connect what the radius connects among distinct sorted values."""
    tree, sets = BKTree(values), Union(len(values))
    for q, node, _ in tree.search(values, radius):
        for a, b in zip(q[q > node].tolist(), node[q > node].tolist(), strict=True):
            sets.join(a, b)
    return [(i, r) for i in range(len(values)) if (r := sets.find(i)) != i]


def grouped(batches, key: int = 0):
    """From record batches sorted by a column, tables that each hold whole groups of it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        last = held.column(key)[-1]
        if pc.equal(held.column(key)[0], last).as_py():
            continue
        whole = pc.index(held.column(key).combine_chunks(), last).as_py()
        yield held.slice(0, whole)
        held = held.slice(whole)
    if held is not None and held.num_rows:
        yield held


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b), b < a, that connect all distinct fingerprints (column fp, long) within the radius.

    For a radius of up to 3.
    """
    import pyarrow as pa

    if not 0 <= radius <= 3:
        raise ValueError("pigeonhole shards hold for a radius of 0 to 3")
    n = partitions(prints.sparkSession)

    def keys(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            out = []
            for i in range(4):
                block = (fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)
                low = fp & np.uint64((1 << 16 * i) - 1)
                rest = low | (((fp >> np.uint64(16 * i)) >> np.uint64(16)) << np.uint64(16 * i))
                for j in range(4):
                    sub = (rest >> np.uint64(12 * j)) & np.uint64(0xFFF)
                    out.append(np.uint64((i * 4 + j) << 28) | block << np.uint64(12) | sub)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(fp.view(np.int64), 16))], ["shard", "fp"])

    members = prints.select("fp").mapInArrow(keys, "shard long, fp long")
    large = members.groupBy("shard").count().where(F.col("count") > shard).select("shard", F.ceil(F.col("count") / shard).alias("pieces"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("pieces"), F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("pieces"), F.lit(1)) - 1))
    pieces = members.join(large, "shard", "left").select("shard", "fp", own.alias("own"), other.alias("other"))
    pieces = pieces.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp")

    def links(batches):
        for t in grouped(batches):
            s, fp = t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64)
            order = np.lexsort((fp, s))
            s, fp = s[order], fp[order]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])
            s, fp = s[new], fp[new]
            begins = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            ends = np.append(begins[1:], len(s))
            a, b = [], []
            for i, j in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
                if j - i == 2:
                    if int(fp[i] ^ fp[i + 1]).bit_count() <= radius:
                        a.append(fp[i + 1])
                        b.append(fp[i])
                    continue
                for x, y in forest(fp[i:j], radius):
                    a.append(fp[i + x])
                    b.append(fp[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    dealt = pieces.repartition(n, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b): root is the least node of its component.

    Alternates large-star and small-star steps until nothing changes. Only counts come to the
    driver; each round's links are checkpointed in the shared folder.
    """
    flat = F.col("a") > F.col("b")
    edges = cut(links.where("a <> b").select(F.when(flat, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(flat, F.col("b")).otherwise(F.col("a")).alias("b")).distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def print_documents(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Rows (key, fp): each whole text's fingerprint as a signed long."""
    import pyarrow as pa

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, 1, 2000)):
            prints = [fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, "key long, fp long")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """Rows (key, fingerprint, component_id), one for each document. component_id: the least key that links reach."""
    prints = cut(print_documents(docs, key, text, words))
    nodes = prints.groupBy("fp").agg(F.min("key").alias("least"))
    found = components(link_fingerprints(nodes.select("fp"), radius))
    reached = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(reached.join(ids, "root").select("fp", "component_id"))
    word = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(known, "fp").select(F.col("key").alias(key), word.alias("fingerprint"), "component_id")


def sketch(hashes: np.ndarray, least: int = SKETCH) -> np.ndarray:
    """The least distinct values of the hashes' upper halves, sorted."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:least]


def similarity(a: np.ndarray, b: np.ndarray, least: int = SKETCH) -> tuple[float, bool]:
    """(Jaccard similarity by sketches, whether it is exact): of all hashes if neither is full, else of the union's least ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b)), True
    both = np.concatenate((a, b))
    both.sort()
    twice = np.flatnonzero(both[1:] == both[:-1])
    union, shared = len(both) - len(twice), len(twice)
    if len(a) < least and len(b) < least:
        return shared / union, True
    if union > least:
        once = np.ones(len(both), dtype=bool)
        once[twice] = False
        shared, union = int((both[twice] <= both[once][least - 1]).sum()), least
    return shared / union, False


def linked(prints: np.ndarray, sketches: list[np.ndarray], alike: float, wide: int, label: np.ndarray | None = None, side: np.ndarray | None = None, block: int = 256) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links, unsure): pairs of members.

    Links connect whatever members are alike for sure, as a spanning forest; unsure ones are the pairs that
    sketches can't decide and links leave apart. Members of one label are connected from the start, those of one
    side aren't compared.
    """
    m = len(prints)
    label = np.arange(m) if label is None else label.copy()
    links, unsure = [], []

    def meet(own: np.ndarray, radius: int) -> None:
        values, which = np.unique(prints[own], return_inverse=True)
        holders, begins = own[np.argsort(which, kind="stable")], np.searchsorted(np.sort(which), np.arange(len(values) + 1))
        tree, width = BKTree(values), np.diff(begins)
        for begin in range(0, len(own), block):
            mine, found = own[begin : begin + block], []
            for q, node, d in tree.search(prints[mine], radius):
                n = width[node]
                other = holders[np.repeat(begins[node] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                q, d = np.repeat(mine[q], n), np.repeat(d, n)
                keep = (other < q) & (label[q] != label[other])
                if side is not None:
                    keep &= side[q] != side[other]
                found.append((q[keep], other[keep], d[keep]))
            q, j, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((d, q))
            q, j = q[order], j[order]
            while len(q):  # one partner of each member in turn, nearest first, until all are connected or compared
                first = np.zeros(len(q), dtype=bool)
                first[np.unique(q, return_index=True)[1]] = True
                for x, y in zip(q[first].tolist(), j[first].tolist(), strict=True):
                    if label[x] == label[y]:
                        continue
                    value, sure = similarity(sketches[x], sketches[y])
                    if sure or abs(value - alike) > NEAR:
                        if value >= alike:
                            links.append((x, y))
                            label[label == max(label[x], label[y])] = min(label[x], label[y])
                    else:
                        unsure.append((x, y))
                rest = ~first & (label[q] != label[j])
                q, j = q[rest], j[rest]

    meet(np.arange(m), wide)
    few = np.flatnonzero(np.fromiter(map(len, sketches), dtype=np.int64, count=m) * alike < FEW)
    if len(few) > 1 and wide < BITS:
        meet(few, BITS)
    return links, [(x, y) for x, y in unsure if label[x] != label[y]]


def _similar_pairs(members: DataFrame, alike: float, wide: int) -> DataFrame:
    """Rows (a, b, sure) from rows (place, id, fp, least, label, side); label and side may be null."""
    import pyarrow as pa

    def run(batches):
        for t in grouped(batches):
            t = t.combine_chunks()
            place, ids = t.column(0).to_numpy(), t.column(1).to_pylist()
            fp, least = t.column(2).to_numpy().view(np.uint64), t.column(3)
            labels, sides = t.column(4).to_pylist(), t.column(5).to_pylist()
            edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
            out = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = [k for k in range(i, j) if k == i or ids[k] != ids[k - 1]]  # a repeated row is the same text
                if len(own) < 2:
                    continue
                sketches = [np.frombuffer(least[k].as_py(), dtype=np.uint32) for k in own]
                label = None if labels[i] is None else np.unique(np.array([labels[k] for k in own], dtype=object), return_inverse=True)[1]
                side = None if sides[i] is None else np.array([sides[k] for k in own])
                links, unsure = linked(fp[own], sketches, alike, wide, label, side)
                out += [(ids[own[x]], ids[own[y]], s) for pairs, s in ((links, True), (unsure, False)) for x, y in pairs]
            a, b, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.bool_())], ["a", "b", "sure"])

    return members.repartition("place").sortWithinPartitions("place", "id").mapInArrow(run, "a binary, b binary, sure boolean").distinct()


def _verified(unsure: DataFrame, texts: DataFrame, words: int, alike: float) -> DataFrame:
    """The pairs (a, b) whose texts, rows (id, text), are alike by all their shingle hashes."""
    import pyarrow as pa

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, 1, 100)):
            every = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.list_(pa.int64()))], ["id", "every"])

    full = kept_table(texts.mapInArrow(run, "id binary, every array<long>").dropDuplicates(["id"]), "full")
    one, two = (full.select(F.col("id").alias(f"i{x}"), F.col("every").alias(f"e{x}")) for x in "ab")
    met = unsure.join(one, F.col("a") == F.col("ia")).join(two, F.col("b") == F.col("ib"))
    shared = F.size(F.array_intersect("ea", "eb"))
    return met.where(shared >= alike * (F.size("ea") + F.size("eb") - shared)).select("a", "b")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, alike: float = 0.8, wide: int = WIDE, shard: int = 4000) -> DataFrame:
    """The documents that stay, with all columns: the first of each component of texts that are alike.

    Order is by key (null first), then by text hash. Equal word sequences are one text from the start, its
    first row stays. Components are those of all documents, whatever shards and pieces the texts met in.
    """
    import pyarrow as pa

    def digest(t: str) -> bytes:
        return xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()))

    def describe(batches):
        for batch in (p for b in batches for p in pieces(b, 2, 1000)):
            digests, prints, anchors, least = [], [], [], []
            for t in batch.column(2).to_pylist():
                h = np.unique(shingle_hashes(t, words))
                digests.append(digest(t))
                prints.append(fingerprint(h))
                anchors.append(h[:ANCHORS].view(np.int64))
                least.append(sketch(h).tobytes())
            arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(anchors, pa.list_(pa.int64())), pa.array(least, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["at", "th", "id", "fp", "anchors", "least"])

    source = docs.select(F.col(key).cast("long").alias("at"), F.xxhash64(text_or_empty(text)).alias("th"), text_or_empty(text).alias("text"))
    described = kept_table(source.mapInArrow(describe, "at long, th long, id binary, fp long, anchors array<long>, least binary"), "described")
    first = described.groupBy(F.col("id").alias("fid")).agg(F.min(F.struct("at", "th")).alias("first"))
    alive = kept_table(first.select("fid", F.col("first.at").alias("fat"), F.col("first.th").alias("fth")), "alive")
    mine = lambda d: (d["id"] == F.col("fid")) & d["at"].eqNullSafe(F.col("fat")) & (d["th"] == F.col("fth"))

    narrow = described.select("id", "at", "th", "anchors")
    pairs = narrow.join(alive, mine(narrow), "left_semi").select("id", F.explode("anchors").alias("anchor")).distinct()
    shared = pairs.groupBy(F.col("anchor").alias("a")).agg(F.ceil(F.count("*") / shard).alias("cuts"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = kept_table(pairs.join(shared, F.col("anchor") == F.col("a")).select("id", "anchor", "cuts", F.pmod(F.xxhash64("id", "anchor"), "cuts").alias("piece")), "placed")

    def met(places: DataFrame) -> DataFrame:
        """The members of places (pid, p), p being (place, label, side)."""
        per = places.groupBy("pid").agg(F.collect_list("p").alias("ps")).join(alive, F.col("pid") == F.col("fid"))
        return described.join(per, mine(described)).select(F.explode("ps").alias("p"), "id", "fp", "least").select("p.place", "id", "fp", "least", "p.label", "p.side")

    none = (F.lit(None).cast("binary").alias("label"), F.lit(None).cast("long").alias("side"))
    found = kept_table(_similar_pairs(met(placed.select(F.col("id").alias("pid"), F.struct(F.xxhash64("anchor", "piece").alias("place"), *none).alias("p"))), alike, wide), "links")
    large = placed.where("cuts > 1")
    if large.limit(1).count():
        roots = components(found.where("sure").select("a", "b"))
        parted = large.join(roots, F.col("id") == F.col("node"), "left").select("id", "anchor", "cuts", "piece", F.coalesce("root", "id").alias("label"))
        mixed = parted.groupBy(F.col("anchor").alias("ma")).agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two").select("ma")
        parted = parted.join(mixed, F.col("anchor") == F.col("ma")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).where("other <> piece")
        place = F.xxhash64("anchor", F.least("piece", "other"), F.greatest("piece", "other"), F.lit(2))
        more = _similar_pairs(met(parted.select(F.col("id").alias("pid"), F.struct(place.alias("place"), "label", F.col("piece").alias("side")).alias("p"))), alike, wide)
        found = found.unionByName(kept_table(more, "more"))
    links, unsure = found.where("sure").select("a", "b"), found.where("not sure").select("a", "b")
    if unsure.limit(1).count():
        # The few texts that sketches can't decide on are sought where texts are read, unless they are many.
        asked = unsure.select(F.explode(F.array("a", "b")).alias("qid")).distinct()
        wanted = kept_table(alive.join(asked, F.col("fid") == F.col("qid"), "left_semi"), "asked")
        wanted = F.broadcast(wanted) if wanted.count() <= SOUGHT else wanted
        texts = source.join(wanted, F.col("at").eqNullSafe(F.col("fat")) & (F.col("th") == F.col("fth"))).select(F.col("fid").alias("id"), "text")
        links = links.unionByName(_verified(unsure, texts, words, alike))
    roots = components(links)
    members = alive.join(roots, F.col("fid") == F.col("node")).select("fid", "root", F.struct("fat", "fth").alias("place"))
    least = members.groupBy(F.col("root").alias("r")).agg(F.min("place").alias("least"))
    gone = members.join(least, F.col("root") == F.col("r")).where("place <> least").select(F.col("fid").alias("gone"))

    stays = alive.join(gone, F.col("fid") == F.col("gone"), "left_anti").select(F.col("fat").alias("_sh_key"), F.col("fth").alias("_sh_text"))
    rows = docs.withColumn("_sh_at", F.col(key).cast("long")).withColumn("_sh_th", F.xxhash64(text_or_empty(text)))
    rows = rows.join(stays, F.col("_sh_at").eqNullSafe(F.col("_sh_key")) & (F.col("_sh_th") == F.col("_sh_text")), "left_semi")
    return rows.dropDuplicates(["_sh_at", "_sh_th"]).drop("_sh_at", "_sh_th")
