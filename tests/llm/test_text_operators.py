"""Operators on single texts against brute force, exact libraries and round trips."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidelog.llm import bpe, fingerprint, queries, secrets, sharding
from tidelog.llm.queries import QUERIES
from tests.llm.conftest import DATA, ODD

VOCABULARY = queries.VOCABULARY


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_the_library(codec, library, texts):
    rnd = random.Random(4)
    pool = list(texts.values()) + ["", "<|endoftext|>", "a<|endoftext|> b", "a" * 3000, " " * 500 + "x", "don't WE'LL\n\n  x", " \x1c\x85  "]
    pool += ["".join(rnd.choice("abcdeth inos'1.\n\t<|éß中😀 ") for _ in range(rnd.randrange(80))) for _ in range(400)]
    mine, theirs = codec.encode_batch(pool), library.encode_batch(pool, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in mine] == [e.ids for e in theirs]
    assert [codec.decode(x) for x in mine] == library.decode_batch([e.ids for e in theirs], skip_special_tokens=False)


def test_bpe_verification_is_exact(codec, texts):
    words = list({w.encode() for t in texts.values() for w in codec.split.findall(t)})[:4000]
    proposals = [codec.propose(w) for w in words]
    for w, p in zip(words, proposals, strict=True):
        a = np.array(p, dtype=np.int64)
        assert (codec.merge(w) == p) == bool(codec.compatible(a[:-1], a[1:]).all())


def test_bpe_query(spark, codec, texts, odd):
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe"](spark, DATA).collect()}
    ids = dict(zip(texts, codec.encode_batch(list(texts.values())), strict=True))
    assert {k: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for k, r in got.items()} == {k: (len(v) // 4, hashlib.sha256(v).hexdigest(), hashlib.sha256(texts[k].encode()).hexdigest()) for k, v in ids.items()}
    out = bpe.encode_documents(odd, VOCABULARY, with_ids=True).collect()
    assert sorted(r["decoded"] for r in out) == sorted(t or "" for _, t, _ in ODD)
    assert bpe.encode_documents(odd.limit(0), VOCABULARY).count() == 0


def test_fingerprints(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op1_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(order)
    for k, nxt in zip(order, order[1:] + order[:1], strict=True):
        a, b = texts[k], texts[nxt]
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        fa, fb, fe = fingerprint.fingerprints([a.encode(), b.encode(), e.encode()])
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(a), hashlib.sha256(e.encode()).hexdigest(), fingerprint.written(fa), fingerprint.written(fe))
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(fa, fe), fingerprint.likeness(fa, fb))


def test_fingerprint_chunks_resist_shifts():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefghij klmnop") for _ in range(20_000)).encode()
    (a,), (b,) = fingerprint.fingerprints([text]), fingerprint.fingerprints([b"inserted " + text])
    assert fingerprint.likeness(a, b) > 0.98
    begins = 0
    for n in (len(text), 3000):  # rolled in blocks as in one piece
        data = np.frombuffer(text[:n], np.uint8)
        h = fingerprint.rolled(data)
        _, easy = fingerprint.boundaries(data, block=777)
        assert easy.tolist() == np.flatnonzero((h & fingerprint.EASY) == 0).tolist()
        begins += len(easy)
    assert begins


def test_fingerprint_odd_rows(odd):
    rows = fingerprint.fingerprint_documents(odd, with_edited=True).collect()
    assert len(rows) == len(ODD) and [r["doc_id"] for r in rows].count(None) == 2
    assert fingerprint.fingerprint_documents(odd.limit(0)).count() == 0


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_secrets(spark, texts, odd):
    for r in QUERIES["op2_secrets"](spark, DATA).collect():
        assert r["spans"] == base_spans(texts[r["doc_id"]]) and r["base_sha256"] == hashlib.sha256(base_spans(texts[r["doc_id"]]).encode()).hexdigest()
    rnd = random.Random(3)
    parts = ["password", "PassWD", "secret", "ToKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeefcafe0011", "é", "𝒳", "\n", "K", "ſecret", "x", "longvalue", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "a" * 36, ".", "token=token: abcdefgh"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(800)] + ["token=abcdef " * 700]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in secrets.secrets_of_documents(df).collect():
        want = base_spans(made[r["doc_id"]])
        assert ",".join(x for x in r["spans"].split(",") if x.split(":")[0] not in ("pem", "forge")) == want
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
    assert secrets.secrets_of_documents(odd).count() == len(ODD) and secrets.secrets_of_documents(odd.limit(0)).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query("(?i:token|api_?key)[:=]*x+")
    assert frozenset({"tok", "oke", "ken"}) in q and frozenset({"api", "pik", "ike", "key"}) in q and len(q) == 3
    assert secrets.trigram_query("[0-9a-f]+") == [frozenset()] and secrets.trigram_query("(abc)?d") == [frozenset()]
    assert secrets.trigram_query("(abc){2}") == [frozenset({"abc", "bca", "cab"})]


def test_secret_scan_is_native(docs):
    plan = secrets.secrets_of_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sharding(spark, docs, texts, odd, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 30)
    rows = {r["doc_id"]: r for r in sharding.shard_documents(docs).collect()}
    by = defaultdict(list)
    for r in docs.collect():
        by[r["source"]].append((hashlib.md5(f"11:{r['doc_id']}".encode()).hexdigest(), r["doc_id"]))
    order = sorted(((2 * i + 1) / (2 * len(v)), "s" + s, i, k) for s, v in by.items() for i, (_, k) in enumerate(sorted(v)))
    n = len(order)
    for at, (*_, k) in enumerate(order):
        r, shard = rows[k], at * 40 // n
        assert (r["shard"], r["slot"], r["size"], r["text_crc32"]) == (shard, at - -(-shard * n // 40), len(texts[k].encode()) + 16, zlib.crc32(texts[k].encode()))
    got = sharding.shard_documents(odd, shards=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert sharding.shard_documents(odd.limit(0)).count() == 0
