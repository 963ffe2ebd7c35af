"""Nulls, ties, repeated rows, long texts, clashing columns and empty tables: the values that each operator gives."""

import hashlib
import random
import re
import shutil

import pytest
import xxhash

from tests.llm.conftest import DATA, ODD
from tests.llm.line_rule import deduped
from tests.llm.test_corpus_operators import simhash_of
from tests.llm.test_text_operators import base_spans
from tidelog.llm import chat, fingerprint, linededup, secrets, simhash, warc
from tidelog.llm.queries import QUERIES


def chunks_by_hand(data):
    """Content-defined chunks, byte by byte."""
    rnd = random.Random(1)
    gear = [rnd.getrandbits(32) for _ in range(256)]
    out, start = [], 0
    while start < len(data):
        end = len(data)
        if len(data) - start > 32:
            for e in range(start + 32, min(start + 256, len(data))):
                h = 0
                for b in data[e - 32 : e]:
                    h = (h * 2 + gear[b]) % 2**32
                if h >> 25 == 0 if e < start + 64 else h >> 27 == 0:
                    end = e
                    break
            else:
                end = min(start + 256, len(data))
        out.append(data[start:end])
        start = end
    return {xxhash.xxh3_64_hexdigest(c)[:12]: len(c) for c in out}


def row_by_hand(text, after):
    half = len(text) // 2
    e = text[: len(text) - half] + after[:half]
    mine, other, new = (chunks_by_hand(x.encode()) for x in (text, after, e))
    held = lambda a, b: (sum(n for d, n in a.items() if d in b) / sum(a.values())) if a else float(not b)
    name = lambda f: " ".join(f"{d}:{n}" for d, n in sorted(f.items()))
    return len(text), hashlib.sha256(e.encode()).hexdigest(), name(mine), name(new), held(mine, new), held(mine, other)


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprints_by_hand(spark, texts, odd):
    short = {k: t for k, t in texts.items() if len(t) < 3000}
    df = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    order = sorted(short, reverse=True)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in fingerprint.fingerprint_documents(df).collect()}
    assert len(got) > 50
    for k, after in list(zip(order, order[1:] + order[:1], strict=True))[::3]:
        assert got[k] == pytest.approx(row_by_hand(short[k], short[after]))
    rows = sorted(((k is not None, k or 0, t or "") for k, t, _ in ODD), key=lambda r: (not r[0], -r[1], r[2]))
    want = sorted(row_by_hand(r[2], rows[(i + 1) % len(rows)][2])[:4] for i, r in enumerate(rows))
    assert sorted(tuple(r[c] for c in COLUMNS[:4]) for r in fingerprint.fingerprint_documents(odd).collect()) == want


def test_secrets_and_prints_of_odd_rows(spark, odd):
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in secrets.secrets_of_documents(odd).collect()) == sorted((str(k), hashlib.sha256(base_spans(t).encode()).hexdigest()) for k, t, _ in ODD)
    got = sorted((str(r["doc_id"]), r["fingerprint"]) for r in simhash.simhash_components(odd).collect())
    assert got == sorted((str(k), f"{simhash_of(t or ''):016x}") for k, t, _ in ODD)


def test_line_dedup_of_odd_rows(odd):
    """Rows of one key and text are one document, and a null text stays null."""
    want = deduped({(k is not None, k or 0, t): t for k, t, _ in ODD if t})
    for r in linededup.dedup_lines(odd).collect():
        t = r["text"]
        assert t in (None, "") or t in want.values()
    long = next(r["text"] for r in linededup.dedup_lines(odd).where("doc_id = 4").collect())
    assert long == want[True, 4, ODD[-1][1]] and len(long) < len(ODD[-1][1])


def test_chats_with_long_texts_and_clashing_columns(spark):
    long = "word <|im_end|> " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long, 1, "b"), (1, 1, "assistant", None, 2, "c"), (None, None, None, "x", 3, "d")], "conv_id long, turn long, role string, text string, block long, conv string")
    rows = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(df).collect()}
    assert len(rows) == 3 and "<|im_end|>" not in rows[1, 0]["fragment"].removesuffix("<|im_end|>\n") and len(rows[1, 0]["fragment"]) > len(long)


def test_long_pages(spark):
    long = "é" * 3_000_000
    df = spark.createDataFrame([(1, "u", long, "x"), (2, "u", long, "y"), (3, "u", "a" * 9_000_000, "z")], "page_id long, url string, html string, archive string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    sha = warc.digest(long.encode())
    assert got == {1: (6_000_000, sha, "revisit", 2), 2: (6_000_000, sha, "response", None), 3: (9_000_000, warc.digest(b"a" * 9_000_000), "response", None)}


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_of_odd_and_no_rows(spark, tmp_path, rows):
    import corpus_pipeline

    whole = spark.createDataFrame([(a, b, "en", c, None if b is None else len(b), "c", 1) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long, anchor string, h long")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = whole
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), whole.schema)
        assert docs.columns == whole.columns and docs.count() <= before, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in docs.collect())


def test_native_queries_run_no_python(spark):
    for name in ("op2_secrets", "op6_line_dedup", "op7_decontaminate"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
