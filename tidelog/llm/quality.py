"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, or of ``LONGEST`` bytes where words are longer; every passage
of the whole text is encoded.
Labels are known for documents only, so gated attention learns which passages a label speaks of:
each hidden passage h gets the weight softmax(w . (tanh(V h) * sigmoid(U h))) among its document's
passages, and the document's score is the logistic of the weighted mean passage.

A passage's features are byte classes, hashed byte pairs, word lengths and repetition, so scoring is
a map over rows without a shuffle; each task holds one slice of a batch. The model is fitted from at
most ``SAMPLE`` labelled documents, chosen by a hash of their key, and all passages of these. Their
features are a table in the shared folder. If they come to ``HELD`` bytes at most, which is counted first, the
driver holds them and sums gradients block by block; if to more, each step's gradient is summed by tasks over the table, and
only the sums come to the driver.

Labels, language, source and key are never inputs of a score.

Defined results: a null or empty text is a bag of one empty passage; a null key counts as the empty
text where keys decide the fold; repeated rows get a row each; of several labels of a document
the least counts and null ones none; without labelled rows every score is 0.5; an empty table gives
an empty table; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import drop_table, kept_table, partitions, pieces, text_or_empty

PASSAGE, LONGEST, SAMPLE, HELD = 64, 2048, 3000, 64 << 20
PAIRS, HIDDEN, GATE = 96, 24, 12
FEATURES = 48 + PAIRS
THRESHOLD = 0.3
LEARNT = ("W", "b", "V", "U", "w", "c", "d")


def _classes() -> np.ndarray:
    """A class for each byte: each ASCII mark has its own, others share one by kind."""
    table = np.zeros(256, dtype=np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 1 if b < 192 else 2
        elif c.islower():
            table[b] = 3
        elif c.isupper():
            table[b] = 4
        elif c.isdigit():
            table[b] = 5
        elif b in (9, 10, 11, 12, 13, 32):
            table[b] = 6 if b == 32 else 7
        elif b in marks:
            table[b] = 8 + marks.index(b)
    return table


CLASSES = _classes()


def passages(text: str, words: int = PASSAGE) -> list[bytes]:
    """Runs of that many words, of the whole text; an empty text is one empty passage."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out, held, n = [], [], 0
    for line in lines:
        w = line.split(b" ")
        while n + len(w) >= words:
            take = words - n
            out.append(b"\n".join([*held, b" ".join(w[:take])]))
            w, held, n = w[take:], [], 0
        if w:
            held.append(b" ".join(w))
            n += len(w)
    if held and any(held):
        out.append(b"\n".join(held))
    if any(len(p) > LONGEST for p in out):
        out = [p[i : i + LONGEST] for p in out for i in range(0, max(1, len(p)), LONGEST)]
    return out or [b""]


def features(flat: list[bytes]) -> np.ndarray:
    """The features of passages; memory is about 60 times their bytes."""
    n = len(flat)
    sizes = np.fromiter(map(len, flat), dtype=np.int64, count=n)
    data = np.frombuffer(b"".join(flat), dtype=np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    x = np.zeros((n, FEATURES), dtype=np.float32)
    length = np.maximum(sizes, 1)[:, None]
    x[:, :40] = np.bincount(owner * 40 + CLASSES[data], minlength=n * 40).reshape(n, 40) / length
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        pair = (data[:-1].astype(np.int64) * 251 + data[1:] * 31) % PAIRS
        x[:, 48:] = np.bincount((owner[1:] * PAIRS + pair)[same], minlength=n * PAIRS).reshape(n, PAIRS) / length
    for i, p in enumerate(flat):
        w = p.split()
        k = max(1, len(w))
        x[i, 40] = len(set(w)) / k
        x[i, 41] = len(w) / PASSAGE
        x[i, 42] = len(p) / k / 10
        x[i, 43] = len({a + b for a, b in zip(w, w[1:], strict=False)}) / k
        x[i, 44] = max(map(len, w), default=0) / 20
    x[:, 45] = sizes == 0
    np.sqrt(x[:, :40], out=x[:, :40])
    np.sqrt(x[:, 48:], out=x[:, 48:])
    return x


def encode(texts: list[str], block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, number of passages by text); passages are encoded in blocks of bytes."""
    bags = [passages(t) for t in texts]
    flat = [p for b in bags for p in b]
    upto = np.cumsum([len(p) + 1 for p in flat])
    cuts = np.searchsorted(upto, np.arange(block, upto[-1], block)) if len(flat) else []
    edges = np.unique([0, *cuts, len(flat)])
    x = np.concatenate([np.zeros((0, FEATURES), np.float32), *(features(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))])
    return x, np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))


def start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    of = lambda a, b: rng.normal(0, (1 / a) ** 0.5, (a, b))
    return {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "W": of(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": of(HIDDEN, GATE), "U": of(HIDDEN, GATE), "w": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}


def forward(m: dict, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags, with what the gradient needs."""
    begins = np.concatenate(([0], np.cumsum(bags)[:-1]))
    z = (x - m["mean"]) * m["scale"]
    h = np.tanh(z @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), bags))
    a = e / np.repeat(np.add.reduceat(e, begins), bags)
    doc = np.add.reduceat(a[:, None] * h, begins)
    p = 1 / (1 + np.exp(-np.clip(doc @ m["c"] + m["d"], -30, 30)))
    return {"z": z, "h": h, "t": t, "g": g, "a": a, "doc": doc, "p": p}


def gradient(m: dict, f: dict, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    begins = np.concatenate(([0], np.cumsum(bags)[:-1]))
    up = (f["p"] - y) / len(y)
    by = np.repeat(up, bags)[:, None]
    dh = f["a"][:, None] * by * m["c"]
    da = (f["h"] @ m["c"]) * by[:, 0]
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begins), bags))
    gate = de[:, None] * m["w"]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = (dh + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
    return {"c": f["doc"].T @ up, "d": np.array([up.sum()]), "w": (f["t"] * f["g"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "W": f["z"].T @ dh, "b": dh.sum(axis=0)}


def blocks(bags: np.ndarray, size: int = 1 << 14):
    """(first bag, end, first passage, end) of runs of bags of about so many passages; a larger bag is a run of its own."""
    upto, a = np.concatenate(([0], np.cumsum(bags))), 0
    while a < len(bags):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + size, side="right")) - 1)
        yield a, b, upto[a], upto[b]
        a = b


def summed(m: dict, x: np.ndarray, bags: np.ndarray, y: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """The bags' part of the gradient of a mean over ``total`` bags."""
    out = {k: np.zeros_like(m[k]) for k in LEARNT}
    for a, b, i, j in blocks(bags):
        g = gradient(m, forward(m, x[i:j].astype(np.float64), bags[a:b]), bags[a:b], y[a:b])
        for k in LEARNT:
            out[k] += g[k] * ((b - a) / total)
    return out


def moments(x: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """Rows: number, sums and sums of squares of the features."""
    out = np.zeros((3, FEATURES))
    for _, _, i, j in blocks(bags):
        z = x[i:j].astype(np.float64)
        out += np.stack([np.full(FEATURES, len(z)), z.sum(axis=0), (z**2).sum(axis=0)])
    return out


def fit(measured: np.ndarray, slope, steps: int = 150, rate: float = 0.02, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Adam from a fixed start, given the features' moments and the gradient of the whole sample as a function of the model."""
    m = start()
    n, one, two = measured
    if not n.any():
        return m
    m["mean"] = one / n
    m["scale"] = 1 / (np.sqrt(np.maximum(two / n - m["mean"] ** 2, 0)) + 0.02)
    first, second = ({k: np.zeros_like(m[k]) for k in LEARNT} for _ in range(2))
    for i in range(1, steps + 1):
        g = slope(m)
        for k in LEARNT:
            step = g[k] + (decay * m[k] if m[k].ndim == 2 or k == "c" else 0)
            first[k] = 0.9 * first[k] + 0.1 * step
            second[k] = 0.99 * second[k] + 0.01 * step**2
            m[k] = m[k] - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
    return m


def held_out(key: str = "doc_id"):
    """The fold that never trains."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def _unpacked(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bags, labels) of rows (y, x)."""
    x = [np.frombuffer(r, dtype=np.float16).reshape(-1, FEATURES) for _, r in rows]
    return np.concatenate([np.zeros((0, FEATURES), np.float16), *x]), np.array([len(a) for a in x], dtype=np.int64), np.array([float(y) for y, _ in rows])


def _over(table: DataFrame, f) -> list[bytes]:
    """What a function of (features, bags, labels) returns, as bytes, for each batch of the table."""
    import pyarrow as pa

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, 1, 1000, 16 << 20)):
            yield pa.RecordBatch.from_arrays([pa.array([f(*_unpacked(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))))], pa.binary())], ["out"])

    return [bytes(r["out"]) for r in table.select("y", "x").mapInArrow(run, "out binary").collect()]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, held: int = HELD, steps: int = 150) -> dict[str, np.ndarray]:
    """A model from all passages of at most ``sample`` labelled documents outside the held-out fold."""
    import pyarrow as pa

    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "k")  # at most `sample` rows
    rows = rows.groupBy("k", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # of rows of one key one

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                x, bags = encode(part.column(1).to_pylist())
                ends = np.cumsum(bags)
                out = [x[e - n : e].astype(np.float16).tobytes() for n, e in zip(bags.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["y", "x"])

    dealt = rows.select("y", "text").repartition(partitions(docs.sparkSession))
    table = kept_table(dealt.mapInArrow(run, "y int, x binary"), "bags")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("x").cast("long")), F.lit(0))).head()
    if size <= held:
        x, bags, y = _unpacked(sorted((r["y"], bytes(r["x"])) for r in table.collect()))
        model = fit(moments(x, bags), lambda m: summed(m, x, bags, y, n), steps)
    else:
        sums = [np.frombuffer(b).reshape(3, FEATURES) for b in _over(table, lambda x, bags, y: moments(x, bags).tobytes())]

        def slope(m: dict) -> dict:
            parts = _over(table, lambda x, bags, y: b"".join(np.ascontiguousarray(g).tobytes() for g in summed(m, x, bags, y, n).values()))
            flat, out, at = np.sum([np.frombuffer(p) for p in parts], axis=0), {}, 0
            for k in LEARNT:
                out[k], at = flat[at : at + m[k].size].reshape(m[k].shape), at + m[k].size
            return out

        model = fit(np.sum(sums, axis=0), slope, steps)
    drop_table(table)
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents' ``key`` and text, with score (0 to 1) and predicted (score >= 0.3)."""
    import pyarrow as pa

    small = {k: v.astype(np.float32) for k, v in model.items()}

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                x, bags = encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(forward(small, x, bags)["p"].astype(np.float64))], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, held_out, score, predicted), one for each document."""
    return score(docs, train(docs, labels, key), key).select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns; the text isn't shuffled."""
    import pyarrow as pa

    small = {k: v.astype(np.float32) for k, v in train(docs, labels).items()}
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, at):
                x, bags = encode([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(forward(small, x, bags)["p"] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
