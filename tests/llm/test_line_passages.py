"""Line dedup: no repeated passage of over 50 words stays, whatever its lines are."""

import random
import re
import zlib

import pytest
import xxhash

import corpus_pipeline
from tests.llm.line_rule import deduped, removed, units
from tidelog.llm import linededup


def longest_repeats(texts):
    """Of each text, the most words in a row that occur in one before it."""
    out, seen = {}, set()
    for k in sorted(texts):
        w = texts[k].split()
        grams = [" ".join(w[i : i + 51]) for i in range(len(w) - 50)]
        out[k] = sum(g in seen for g in grams)
        seen |= set(grams)
    return out


def planted(rnd):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([1, 3, 6])))
    some = lambda n: [word() for _ in range(n)]

    def marked(ws, every):
        return " ".join(x + ("." if every and i % every == every - 1 else "") for i, x in enumerate(ws))

    made, k = {}, 0
    for every in (0, 60, 25, 19, 12, 7, 4):
        for n in (51, 55, 80):
            passage = marked(some(n), every)
            for _ in range(2):
                made[k] = f"{marked(some(rnd.randrange(5, 40)), every)} {passage} {marked(some(rnd.randrange(5, 40)), every)}"
                k += 1
    return made


def test_no_passage_of_over_fifty_words_stays(spark):
    made = planted(random.Random(3))
    assert sum(n > 0 for n in longest_repeats(made).values()) == len(made) // 2
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    assert not any(longest_repeats(out).values())
    assert all(out[k] == made[k] for k in made if k % 2 == 0)
    assert all(len(made[k]) - len(out[k]) >= linededup.LEAST - 1 for k in made if k % 2)
    assert out == deduped(made)


def test_whole_runs_go(spark, docs, texts):
    gone = removed(texts)
    rows = {r["doc_id"]: r for r in linededup.dedup_report(docs).collect()}
    assert sum(map(len, gone.values())) and {k: r["n_removed"] for k, r in rows.items()} == {k: len(gone[k]) for k in rows}
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert not any(longest_repeats(out).values())


def test_frequent_chunks_are_dealt_over_tasks(spark, monkeypatch):
    """A passage in every document and documents of one key, with the sample's path taken: the same rows go."""
    rnd = random.Random(4)
    passage = "This very sentence stands in every one of the documents and has enough words. And so does this one, too, my friend."
    made = {k: f"{' '.join(str(rnd.random()) for _ in range(12))}. {passage} {' '.join(str(rnd.random()) for _ in range(9))}" for k in range(60)}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    monkeypatch.setattr(linededup, "SAMPLE", 20)
    assert linededup.frequent(df, "doc_id", "text")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()} == deduped(made)
    plan = linededup.repeats(df)
    plan.collect()
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_long_lines_and_odd_characters(spark):
    rnd = random.Random(8)
    long = " ".join("".join(rnd.choice("qwrtz") for _ in range(5)) for _ in range(30_000))
    made = {0: long, 1: f"x {long[1000:40_000]} y", 2: "a\x1eb. c\x1e d? " * 9, 3: "a\x1eb. c\x1e d? " * 9, 4: "", 5: "\n\n", 6: "é𝒳 " * 200, 7: "é𝒳 " * 201}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got == deduped(made) and len(got[1]) < 1000  # ends, and tiny lines between chunks


#: Two lines of one XXH64 (seed 42) and one CRC-32.
COLLIDING = ("wWJfKvYAlliwKxf87aHQoOMEfourthAAbr0VwCUtmanymorei1FJsCQOfourthBB", "sOWq5JFjXYeGX6FcyKbKtKhifourthAAsySkxBpK3t5g2yWa22zhIypcfourthBB")


@pytest.mark.parametrize("dealt", [False, True])
def test_chunks_of_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch, dealt):
    """Different lines of equal hashes stay, and copies of either go."""
    a, b = COLLIDING
    h = xxhash.xxh64_intdigest(a, 42)
    assert a != b and h == xxhash.xxh64_intdigest(b, 42) and zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    if dealt:
        monkeypatch.setattr(linededup, "frequent", lambda *_: [h - (1 << 64) if h >> 63 else h])
    made = {0: a, 1: f"one\n{b}", 2: f"{b}\n{a}", 3: "other", 4: a, 5: f"{b}\n{b}"}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert out == deduped(made) == {0: a, 1: made[1], 2: "", 3: "other", 4: "", 5: ""}


#: A line, and two others that are together a chunk of the same hash.
ONE, TWO = "iK2ZWeqhFWCEPyYngFb51yBMWXaSCrUZoL8g5ubbbPIa84yRnBUbHoWC8FJowoRo", "WD8s7bA16J7PglOU3shVv5UTG79BG16QmtsL4F28\n9diWFCJSNcnPOOqpKJ0maxtR"


@pytest.mark.parametrize("texts", [[ONE, TWO, TWO, ONE], [TWO, ONE, ONE, TWO]])
def test_pipeline_tells_chunks_of_one_hash_and_other_numbers_of_lines_apart(spark, texts):
    a, b = (xxhash.xxh64_intdigest(x, 42) for x in TWO.split("\n"))
    assert xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) == xxhash.xxh64_intdigest(ONE, 42)
    made = dict(enumerate(texts))
    df = spark.createDataFrame([(k, t, len(t)) for k, t in made.items()], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "none").collect()}
    assert out == deduped(made) == {0: texts[0], 1: texts[1], 2: "", 3: ""}


def test_texts_are_cut_by_patterns_once(spark, docs, texts):
    """Marked texts have the same lines and ends; beyond the sample's, one step of the plan holds the patterns for texts without marks."""
    rnd = random.Random(11)
    made = list(texts.values()) + ["", "\n", " \n ", "é𝒳 " * 99 + "\n" + "x." * 99] + [" ".join(rnd.choice("ab. Cd! éé? 12 x\n tt") * rnd.randrange(1, 9) for _ in range(300)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    rows = df.selectExpr("t", f"{linededup.lines_of('t')} as parts", f"{linededup.marked('t')} as m").collect()
    assert all(re.split("[\n\x1e]", r["m"]) == r["parts"] == [x for x, _ in units(r["t"])] and r["m"].replace("\x1e", " ") == r["t"] for r in rows)
    plan = linededup.dedup_report(docs).drop("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"regexp_replace\((\w+)#", plan)) == {"text"}
    assert not re.search(r"Python|Arrow", plan)


def test_texts_that_hold_the_marks(spark):
    long = " ".join(f"w{i}x{i * 7 % 13}" for i in range(60))
    made = {0: f"{long}\x1f a. b", 1: f"{long} c. d", 2: f"{long}\x1e", 3: f"q\x1e {long}\n\x1f", 4: f"{long}\x1f a. b", 5: f"\x1f\x1f{long}. {long}\x1f"}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()} == deduped(made)
