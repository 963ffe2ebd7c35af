"""Operators that compare documents, train or write, against brute force and planted cases."""

import heapq
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidelog.llm import chat, decontaminate, linededup, quality, simhash, warc
from tidelog.llm.queries import QUERIES
from tests.llm.conftest import DATA, ODD
from tests.llm.line_rule import deduped


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def shingled(t, k):
    w = words(t)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])


def simhash_of(t):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingled(t, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_simhash_components(spark, texts, odd):
    got = {r["doc_id"]: r for r in QUERIES["op8_simhash"](spark, DATA).collect()}
    prints = {k: simhash_of(t) for k, t in texts.items()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    ids = sorted(prints)
    sets = simhash.Union(len(ids))
    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 3:
            sets.join(i, j)
    assert {k: r["component_id"] for k, r in got.items()} == {k: ids[sets.find(i)] for i, k in enumerate(ids)}
    assert simhash.simhash_components(odd).count() == len(ODD) and simhash.simhash_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [20_000, 7])
def test_links_of_planted_fingerprints(spark, shard):
    rnd = random.Random(shard)
    values = [rnd.getrandbits(64) for _ in range(60)]
    for v in values[:30]:
        for _ in range(6):
            for b in rnd.sample(range(64), rnd.randrange(1, 4)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.link_fingerprints(df, shard=shard)).collect()}
    sets = simhash.Union(len(values))
    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 3:
            sets.join(i, j)
    groups = defaultdict(set)
    for i, v in enumerate(values):
        groups[sets.find(i)].add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_bk_tree():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**12, 300, dtype=np.uint64))
    tree = simhash.BKTree(values)
    for radius in (0, 2, 5):
        got = {(q, n) for a, b, _ in tree.search(values[:50], radius, block=16) for q, n in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == {(i, j) for i in range(50) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= radius}


def kept_by_force(texts):
    """The first of each component of texts of similarity 0.8 or more."""
    ids = sorted(texts)
    sets, of = [set(shingled(texts[k], 5)) for k in ids], simhash.Union(len(ids))
    for i, j in itertools.combinations(range(len(ids)), 2):
        if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
            of.join(i, j)
    return {k for i, k in enumerate(ids) if of.find(i) == i}


@pytest.mark.parametrize("shard", [4000, 3])
def test_near_dedup(spark, odd, shard):
    rnd, rows = random.Random(1), []
    for k in range(12):
        base = [rnd.choice("lorem ipsum dolor sit amet consectetur elit sed do".split()) + str(rnd.randrange(50)) for _ in range(150)]
        for c in range(rnd.choice([1, 4, 9])):
            copy = list(base)
            for i in rnd.sample(range(150), c % 3):
                copy[i] = "changed"
            rows.append((len(rows), " ".join(copy), "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = {r["doc_id"] for r in simhash.near_dedup(df, shard=shard).collect()}
    assert kept == kept_by_force({k: t for k, t, _ in rows}) and len(kept) == 12
    left = simhash.near_dedup(odd, shard=shard)
    assert left.columns == odd.columns and simhash.near_dedup(odd.limit(0)).count() == 0
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:12]) for r in left.collect()) == [("2", "a b c"), ("2", "other text"), ("4", ODD[-1][1][:12]), ("None", ""), ("None", "x")]


def test_near_dedup_by_force(spark, docs, texts):
    assert {r["doc_id"] for r in simhash.near_dedup(docs).collect()} == kept_by_force(texts)


@pytest.mark.parametrize("shard", [3, 10, 4000])
def test_near_dedup_of_a_drifting_chain(spark, shard):
    words = [f"w{i}" for i in range(200)]
    chain = {k: " ".join(words[k : k + 120]) for k in range(60)} | {60: "quite another text of its own"}
    df = spark.createDataFrame(list(chain.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.near_dedup(df, shard=shard).collect()} == {0, 60} == kept_by_force(chain)


def test_near_dedup_of_long_texts_is_exact(spark):
    """Pairs of 1,500 words on either side of the threshold, where sketches can't tell."""
    rnd, made = random.Random(6), {}
    for p in range(12):
        base = [f"{rnd.getrandbits(40):x}" for _ in range(1500)]
        cut = round(1500 / 9 + (-1) ** p * rnd.choice([2, 5, 9]))
        made[2 * p], made[2 * p + 1] = " ".join(base), " ".join(base[:-cut] + [f"{rnd.getrandbits(40):x}" for _ in range(cut)])
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    want = kept_by_force(made)
    assert len(want) == 18 and {r["doc_id"] for r in simhash.near_dedup(df).collect()} == want


def test_near_copies_are_caught(spark):
    """Copies with a few words changed, of texts of 8 to 900 words."""
    rnd, made = random.Random(7), {}
    for _ in range(150):
        base = [f"{rnd.choice('abcdefgh')}{rnd.randrange(400)}" for _ in range(rnd.choice([8, 12, 20, 60, 200, 900]))]
        edits = len(base) // 60
        copy = [x if i not in set(rnd.sample(range(len(base)), edits)) else "edited" for i, x in enumerate(base)] + ["more"] * (len(base) < 60)
        made[len(made)], made[len(made) + 1] = " ".join(base), " ".join(copy)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    want = kept_by_force(made)
    got = {r["doc_id"] for r in simhash.near_dedup(df).collect()}
    assert len(want) < 200 and got == want


def test_line_dedup(spark, docs, texts, odd):
    want = deduped(texts)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == want and want != texts
    out = linededup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD) and out.where("text is null").count() == 2
    assert linededup.dedup_report(odd.limit(0)).count() == 0


def test_line_dedup_finds_planted_passages(spark):
    rnd = random.Random(9)
    sentence = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(8)).capitalize() + "."
    passage = "\n".join(sentence() for _ in range(16))
    made = {k: "\n".join([sentence() for _ in range(rnd.randrange(3, 9))] + ([passage] if k % 2 else []) + [sentence() for _ in range(rnd.randrange(3, 9))]) for k in range(20)}
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    assert out == deduped(made)
    assert all(out[k] == made[k] for k in made if not k % 2 or k == 1)
    assert all(len(out[k]) < len(made[k]) - len(passage) * 0.5 for k in made if k % 2 and k > 1)


def test_line_dedup_plan_is_native(docs):
    plan = linededup.chunk_rows(docs.selectExpr("doc_id as id", "1 as th", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination(spark, docs, texts, odd):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontaminate"](spark, DATA).collect()}
    exact = {(k, i) for k, t in texts.items() for i, b in bench.items() if b in t}
    assert exact and exact <= got and len(got) <= len(exact) + 3
    items = spark.createDataFrame([(1, "A train leaves Berlin with 120 passengers and after 3 hours it has gone 45 km while Anna counts 120 birds."), (2, None), (3, "short one"), (None, "x y z")], "item_id long, text string")
    changed = "bla. A train leaves Paris with 77 passengers and after 5 hours it has gone 99 km while Maria counts {} birds. the end"
    cases = spark.createDataFrame([(1, changed.format(77)), (2, changed.format(78)), (3, None), (None, "x y z"), (5, "a short one here"), (5, "a short one here"), (6, "clean text")], "doc_id long, text string")
    pairs = {(r["doc_id"], r["item_id"], r["same_slots"]) for r in decontaminate.leaks_of_documents(cases, items).collect()}
    assert pairs == {(1, 1, False), (5, 3, True), (None, None, True)}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(cases, items).collect()) == [2, 3, 6]
    assert decontaminate.without_leaks(odd, items).columns == odd.columns
    for d, b in ((cases.limit(0), items), (cases, items.limit(0))):
        assert decontaminate.leaks_of_documents(d, b).count() == 0


def test_decontamination_shuffles_a_large_benchmark(spark, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(20)))], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    assert decontaminate.leaks_of_documents(docs, items).count() == 1


def test_quality(spark, docs, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score_documents(big, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    out = quality.score_documents(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score_documents(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_quality_gradient():
    rng = np.random.default_rng(1)
    bags, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x, m = rng.normal(size=(6, quality.FEATURES)), quality.start()
    m["w"], m["c"] = rng.normal(size=quality.GATE), rng.normal(size=quality.HIDDEN)
    loss = lambda m: -np.mean(y * np.log(p := quality.forward(m, x, bags)["p"]) + (1 - y) * np.log(1 - p))
    g = quality.gradient(m, quality.forward(m, x, bags), bags, y)
    for k in ("W", "V", "U", "w", "c", "b", "d"):
        at = tuple(rng.integers(0, s) for s in m[k].shape)
        up, down = ({**m, k: m[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k][at]) < 1e-6


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r for r in QUERIES["op10_warc"](spark, DATA).collect()}
    for p in pages.collect():
        raw = p["html"].encode()
        assert (got[p["page_id"]]["payload_bytes"], got[p["page_id"]]["payload_digest"]) == (len(raw), warc.digest(raw))
    odd = spark.createDataFrame([(1, None, None), (None, "x\r\ny z", "a"), (None, None, "a"), (2, "a", "a"), (2, "a", "a"), (3, "", "b"), (4, "u", "é\r\n\r\nx"), (9, "u", "é\r\n\r\nx")], "page_id long, url string, html string")
    rows = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(odd.withColumn("archive", odd["url"])).collect())
    assert rows == sorted([("1", 0, "response", None), ("2", 1, "response", None), ("2", 1, "response", None), ("None", 1, "revisit", 2), ("None", 1, "revisit", 2), ("3", 1, "response", None), ("9", 7, "response", None), ("4", 7, "revisit", 9)])
    assert warc.round_trip(odd.limit(0)).count() == 0


def test_warc_reads_selected_records(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    some = warc.read_records(spark, folder, index.where("page_id % 7 = 0"))
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in some.collect()} == {k: v for k, v in html.items() if k % 7 == 0}


def cheapest(own):
    heap, seen = [(0, 0, 0)], set()
    while True:
        c, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(own) and s == 3:
            return c
        for r in chat.NEXT[s]:
            heapq.heappush(heap, (c + chat.INSERT, i, chat.state(r)))
        for r in chat.ROLES if i < len(own) else ():
            x = c + chat.RELABEL * (r != own[i])
            if r in chat.NEXT[s]:
                heapq.heappush(heap, (x, i + 1, chat.state(r)))
            if s == chat.state(r):
                heapq.heappush(heap, (x + chat.MERGE, i + 1, s))


def cost_of(own, plan):
    s = c = 0
    for o, (r, merged, before) in zip(own, plan, strict=True):
        for x in before:
            assert x in chat.NEXT[s]
            s, c = chat.state(x), c + chat.INSERT
        assert (s == chat.state(r)) if merged else (r in chat.NEXT[s])
        s, c = chat.state(r), c + chat.MERGE * merged + chat.RELABEL * (o != r)
    return c + chat.INSERT * len(chat.END[s])


def test_chat_repair_is_cheapest():
    for n in range(1, 5):
        for own in itertools.product((None, *chat.ROLES), repeat=n):
            assert cost_of(own, chat.repair(list(own))) == cheapest(own)


def test_chat_runs_of_any_size(spark):
    rnd, rows = random.Random(5), []
    for c in range(15):
        for t in range(rnd.choice([1, 2, 3, 9, 60])):
            rows.append((c or None, t if rnd.random() < 0.95 else None, rnd.choice(["system", "user", "assistant", " User", "gpt", None, "tool"]), rnd.choice(["hi", "", None, "<|im_end|>"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        whole[r[0]].append(chat.role_of(r[2]))
    for run in (4, 256):
        got = defaultdict(int)
        for r in chat.format_chats(df, run=run).collect():
            got[r["conv_id"]] += r["cost"]
        assert got == {k: cheapest(v) for k, v in whole.items()}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_rendering(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c <|im_end|>"), (1, 3, "human", "d")], "conv_id long, turn long, role string, text string")
    parts = [r["fragment"] for r in chat.format_chats(df).orderBy("turn").collect()]
    assert "".join(parts) == "<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\nc < |im_end|><|im_end|>\n<|im_start|>user\nd<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


def test_pipeline_equals_its_stages(spark, texts):
    import corpus_pipeline
    from tidelog.llm.bpe import Codec, read_vocabulary

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = stage(spark, docs, DATA).collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == names and {r["doc_id"] for r in rows} <= set(before)
        if stage is corpus_pipeline.line_dedup:
            assert {r["doc_id"]: r["text"] for r in rows} == deduped(before)
    left = {r["doc_id"]: r["text"] for r in rows}
    codec = Codec(read_vocabulary(corpus_pipeline.VOCABULARY))
    want = {k: len(x) // 4 for k, x in zip(left, codec.encode_batch(list(left.values())), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_quality_by_tasks_equals_the_driver(spark):
    """The gradient summed over a table gives the model that the driver fits, from all passages of long texts too."""
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["good", "fine", "text"] if k % 2 else ["$$", "%%", "buy!"]) + str(rnd.randrange(99)) for _ in range(rnd.choice([5, 70, 30_000 if k < 4 else 300])))) for k in range(60)]
    docs = spark.createDataFrame(rows + [(100, "x" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows] + [(100, 0)], "doc_id long, quality int")
    one, two = (quality.train(docs, labels, held=held, steps=6) for held in (1 << 30, 0))
    assert all(np.allclose(one[k], two[k], atol=1e-6) for k in one)
    assert len(quality.passages("x" * 300_000)) == -(-300_000 // quality.LONGEST) and max(map(len, quality.passages(rows[2][1]))) <= quality.LONGEST


def test_quality_scores_by_force(spark, docs, texts):
    """Each score against a loop over passages with the model's formulas written out."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    m = quality.train(docs, labels, steps=20)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()}
    for k in sorted(texts)[:40]:
        hidden, weights = [], []
        for p in quality.passages(texts[k] or ""):
            h = np.tanh(((quality.features([p])[0] - m["mean"]) * m["scale"]) @ m["W"] + m["b"])
            hidden.append(h)
            weights.append(float((np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"]))
        a = np.exp(np.array(weights) - max(weights))
        z = float((a / a.sum()) @ np.array(hidden) @ m["c"] + m["d"][0])
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-4
