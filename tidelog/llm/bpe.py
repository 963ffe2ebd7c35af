"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each distinct word. A proposal is the exact BPE
result if, and only if, each of its tokens is canonical (BPE of the token's own bytes gives the
token) and each adjacent pair is compatible (BPE of the two tokens' joined bytes gives the pair).
Pairs of all proposed words are tested together, as arrays; the words that hold an incompatible
pair, and only they, are merged exactly.

The work is a map over rows without any shuffle. A worker keeps the words it has met, up to
``CACHED_WORDS``; beyond that only those of the texts at hand stay, so its memory is bounded.

Defined results: a null text counts as empty and has no tokens; repeated rows and ties give one
row each; an empty table gives an empty table; other columns of the input, whatever their names,
are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
from pyspark.sql import DataFrame

from tidelog.llm.common import pieces, text_or_empty

#: Fixed value: how the byte-level pre-tokenizer splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS, SHORT_WORD = 400_000, 100
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for a byte-level BPE vocabulary.

    ``spec`` holds ``tokens`` (bytes by id), ``merges`` (left id, right id, new id, in order of
    rank) and ``special`` (text to id). Rank and id need not agree.
    """

    def __init__(self, spec: dict):
        import regex

        self.tokens: list[bytes] = spec["tokens"]
        self.special: dict[str, int] = spec["special"]
        merges = np.asarray(spec["merges"], dtype=np.int64).reshape(-1, 3)
        n = len(self.tokens)
        self.born = np.full(n, -1, dtype=np.int64)
        self.left = np.arange(n, dtype=np.int64)
        self.right = np.arange(n, dtype=np.int64)
        self.born[merges[:, 2]] = np.arange(len(merges))
        self.left[merges[:, 2]] = merges[:, 0]
        self.right[merges[:, 2]] = merges[:, 1]
        keys = merges[:, 0] << 32 | merges[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(merges)}
        self.byte = [0] * 256
        special = set(self.special.values())
        for i, t in enumerate(self.tokens):
            if len(t) == 1 and i not in special:
                self.byte[t[0]] = i
        canonical = self._canonical(merges)
        self.match = {t: i for i, t in enumerate(self.tokens) if i not in special and (len(t) == 1 or canonical[i])}
        self.reach: dict[bytes, int] = {}
        for t in self.match:
            if len(t) > 3:
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 0))
        self.split = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.repaired = self.proposed = 0

    def _canonical(self, merges: np.ndarray) -> np.ndarray:
        """Whether BPE of a token's bytes ends in that token, for each id."""
        ok = np.zeros(len(self.tokens), dtype=bool)
        for _, _, c in merges.tolist():
            ok[c] = self.merge(self.tokens[c]) == [c]
        return ok

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair (a, b) survives BPE over its joined bytes; all pairs at once.

        Merging is replayed backwards at the border: the tokens next to it are undone, the
        younger first. The pair fails if two tokens that stood side by side there have a merge
        that comes before the merge that swallowed the left one, or not after the one that
        swallowed the right one (of two equal merges the leftmost goes first).
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        gone_x, gone_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        ok, at = np.ones(len(x), dtype=bool), np.arange(len(x))
        while len(at):
            m = self._rank_of(x, y)
            bad = (m < gone_x) & (m <= gone_y) & (m < NEVER)
            ok[at[bad]] = False
            bx, by = self.born[x], self.born[y]
            on = ~bad & ((bx >= 0) | (by >= 0))
            at, x, y, gone_x, gone_y, bx, by = (v[on] for v in (at, x, y, gone_x, gone_y, bx, by))
            undo = bx > by
            gone_x, gone_y = np.where(undo, bx, gone_x), np.where(undo, gone_y, by)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE. Long words by a heap of ranked neighbours over a linked list, n log n in the length."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        if n <= SHORT_WORD:
            return self._merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := self.rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := self.rank.get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Exact BPE over a plain list: the leftmost pair of the least rank merges, its neighbours are ranked anew."""
        rank, none = self.rank, (1 << 40, -1)
        pairs = [rank.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs and (least := min(pairs)) is not none:
            i = pairs.index(least)
            ids[i : i + 2] = [least[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match. The four bytes at a place bound how long a token there can be."""
        match, reach, out, i, n = self.match, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 4], 3))
            while (t := match.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words together and keeps the results, as little-endian ids."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.arange(len(raw)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        failing = set(word[inner[~good]].tolist())
        self.proposed += len(raw)
        self.repaired += len(failing)
        for i, (w, p) in enumerate(zip(words, proposals, strict=True)):
            self.known[w] = np.asarray(self.merge(raw[i]) if i in failing else p, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers. Special tokens' strings are special."""
        parts = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        words = [[self.split.findall(x) if i % 2 == 0 else x for i, x in enumerate(p)] for p in parts]
        new = {w for p in words for ws in p[::2] for w in ws} - self.known.keys()
        if len(self.known) + len(new) > CACHED_WORDS:  # words that came up again stay
            self.known = {w: self.known[w] for p in words for ws in p[::2] for w in ws if w in self.known}
        self.learn(list(new))
        known = self.known
        return [b"".join([b"".join(map(known.__getitem__, x)) if i % 2 == 0 else np.uint32(self.special[x]).tobytes() for i, x in enumerate(p)]) for p in words]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def read_vocabulary(path: str) -> dict:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form; read on the driver, about 2 MB. Files of other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, letters = whole["model"], byte_letters()
    split = whole.get("pre_tokenizer") or {}
    bare = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True) and not whole.get("normalizer")
    plain = not any(t.get(k) for t in whole.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or (whole.get("decoder") or {}).get("type") != "ByteLevel" or not bare or not plain or odd:
        raise ValueError(f"{path}: only byte-level BPE with its own split, no normalizer and plain added tokens is known {odd}")
    added = {t["id"]: t["content"] for t in whole.get("added_tokens", [])}
    size = 1 + max([*model["vocab"].values(), *added])
    tokens = [b""] * size
    for t, i in model["vocab"].items():
        tokens[i] = t.encode() if i in added else bytes(letters[c] for c in t)
    for i, t in added.items():
        tokens[i] = t.encode()
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {"tokens": tokens, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], "special": {t: i for i, t in added.items()}}


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns ``key``, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids (array) and
    decoded (the decoded text). The vocabulary is sent by broadcast; its size is that of the file.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        held = spec.value  # one object for all tasks of a worker, and so are the codec and the words it knows
        codec = held["codec"] = held.get("codec") or Codec(held)
        for batch in batches:
            for part in pieces(batch, 1, 2000, 4 << 20):
                ids = codec.encode_batch(part.column(1).to_pylist())
                texts = [codec.decode(x) for x in ids]
                sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
                out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(t.encode() for t in texts)]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out += [pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text_or_empty(text).alias("text")).mapInArrow(run, schema + (", ids array<long>, decoded string" if with_ids else ""))
