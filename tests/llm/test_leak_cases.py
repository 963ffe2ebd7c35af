"""Decontamination: copies that edits beside them, case or context must not hide."""

import itertools
import random
import re

import regex

from tidelog.llm import decontaminate

ITEM = "A farmer who keeps 6 goats in a small shed behind the old mill feeds every goat 4 apples at dawn and then walks down to the river where the oldest goat eats 6 kg of fresh grass before the whole herd comes slowly home again at night."


def leaks(spark, item, texts):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in decontaminate.leaks_of_documents(docs, items).collect()}


def test_a_clashing_slot_hides_no_passage(spark):
    one = ITEM.replace("eats 6 kg", "eats 9 kg")
    merged = ITEM.replace("6", "5").replace("4", "5")
    gap = ITEM.replace("every goat 4 apples at dawn", "each one 8 ripe pears soon").replace("keeps 6", "keeps 7")
    clash = "A farmer who keeps 8 goats in a small shed. Then the oldest goat eats 9 kg of grass."
    assert leaks(spark, ITEM, [one, merged, gap, clash]) == {0, 1, 2}


def test_names_case_and_context(spark):
    names = "Tom has 5 apples. Tom gives 2 to Ann. Ann then eats 1. How many are left?"
    changed = "Well. Sam has 7 apples. Sam gives 3 to Eve. Eve then eats 2. How many are left?"
    mixed = "Well. Sam has 7 apples. Joe gives 3 to Eve. Max then eats 2. How many are left?"
    assert leaks(spark, names, [changed, mixed, names.upper()]) == {0, 2}
    short = "What is the capital city of the old kingdom of Spain?"
    assert leaks(spark, short, [f"Quiz night questions\n{short} Answer below.", "quiz " + short.lower(), short.upper(), short.replace("old", "new")]) == {0, 1, 2}
    assert leaks(spark, ITEM, [ITEM.upper(), ITEM.lower(), "No mark here " + ITEM]) == {0, 1, 2}


def template(text):
    """(words, template words by variant), written out by hand."""
    t = "".join(c for c in text if c not in "\x03\x04\x05")
    t = regex.sub(r"(?<=[^.!?:\s])(\s+)(?=\p{Lu}\p{Ll}+(?!\p{L}))", "\\1\x03", t)
    t = regex.sub("(^|\\s)([^\\p{L}\\p{N}\\s\x03]*)(?=\\p{Lu}\\p{Ll}+(?!\\p{L}))", "\\1\\2\x04", t)
    t = regex.sub("(\\p{N})\\s*[\x03\x04]?((?i:" + "|".join(decontaminate.UNITS) + "))(?!\\p{L})", "\\1 \x05\\2", t)
    t = regex.sub("[^\\p{L}\\p{N}\\s.,\x03\x04\x05]+|(?<!\\p{N})[.,]+|[.,]+(?!\\p{N})", "", t.lower())
    marked = [w for w in regex.split(r"\s+", t) if w.lstrip("\x03\x04\x05")]
    raw, out = [w.lstrip("\x03\x04\x05") for w in marked], [[], [], []]
    for i, w in enumerate(marked):
        figure, number = "0" <= w[:1] <= "9", raw[i] in decontaminate.NUMBERS and w[0] != "\x05"
        kind = None
        if figure:
            kind = None if i >= 7 and all("0" <= x[:1] <= "9" for x in marked[i - 7 : i]) else "<num>"
        elif w[0] == "\x05" or raw[i] in decontaminate.UNITS and i and raw[i - 1] in decontaminate.NUMBERS and not number:
            kind = "<unit>"
        elif number:
            kind = "<num>"
        for v, names in enumerate(("\x03", "", "\x03\x04")):
            out[v].append(kind or ("<name>" if w[0] in names and not figure else raw[i]))
    return raw, out


def runs(flags):
    """(begin, length) of the longest stretches of true flags."""
    at, out = None, []
    for i, f in enumerate([*flags, False]):
        if f and at is None:
            at = i
        elif not f and at is not None:
            out.append((at, i - at))
            at = None
    return out


def leaks_by_force(items, docs):
    found = set()
    for k, text in docs.items():
        raw, words = template(text)
        for name, item in items.items():
            iraw, iwords = template(item)
            size, length = min(decontaminate.WINDOW, len(iraw)), len(iraw)
            for v, shift in itertools.product(range(3), range(-length, len(raw))) if length else ():
                hits = [i for i in range(len(raw) - size + 1) if 0 <= i - shift <= length - size and words[v][i : i + size] == iwords[v][i - shift : i - shift + size]]
                if not hits:
                    continue
                low, high = hits[0], hits[-1]
                if min(len(hits) + decontaminate.WINDOW - 1, high - low + size, length) < min(decontaminate.ENOUGH, length):
                    continue
                begin, end = (max(0, shift), length + shift) if v == 1 else (low, low + min(high - low + size, length))
                pairs = [(words[v][i] == iwords[v][i - shift], iwords[v][i - shift], iraw[i - shift], raw[i]) for i in range(begin, min(end, len(raw)))]
                parts = [pairs]
                if v != 1:
                    parts += [pairs[a : a + n] for a, n in runs([p[0] for p in pairs]) if n >= decontaminate.ENOUGH]
                slots = lambda part: {(t, a, b) for hit, t, a, b in part if hit and t in ("<num>", "<unit>", "<name>")}
                sound = any(len({(t, a) for t, a, _ in slots(p)}) == len(slots(p)) for p in parts)
                if sound or any(n >= decontaminate.ENOUGH for _, n in runs([p[2] == p[3] for p in pairs])):
                    found.add((k, name))
    return found


def test_planted_questions_by_force(spark):
    """Items whose names open sentences, re-parameterised in every slot, clashing in some, cut, embedded, and clean texts."""
    rnd = random.Random(12)
    people, things = ["Alice", "Bob", "Carol", "Dave", "Eve", "Mallory"], ["apples", "pears", "plums", "coins", "stamps"]
    number = lambda: rnd.choice([str(rnd.randrange(2, 99)), f"{rnd.randrange(2, 9)}.5", "five", "seven", "twelve"])
    unit = lambda: rnd.choice(["km", "miles", "kg", "hours"])
    forms = [
        "{p} buys {n} {t} and {q} sells {m} {t} at the market near the old bridge. {p} then walks {a}{s}{u} home. How many {t} are left?",
        "{p} has {n} {t}. {q} gives {m} to {p}. {p} then eats {a}. How many {t} are left in the basket?",
        "The numbers {n} {m} {a} {n} {m} {a} {n} {m} {a} 11 stand on a sheet of paper that {p} found",
        "What does {p} pay for {n}{s}{u}?",
    ]

    def filled(form, t):
        return form.format(p=rnd.choice(people), q=rnd.choice(people), n=number(), m=number(), a=number(), u=unit(), s=rnd.choice(["", " "]), t=t)

    items = {i: filled(forms[i % 4], things[i // 4]) for i in range(12)}
    docs = {}
    for _ in range(70):
        i = rnd.randrange(12)
        body = rnd.choice([filled(forms[i % 4], things[i // 4]), items[i], items[i].upper(), items[i].replace("5", "8"), " ".join(items[i].split()[: rnd.randrange(6, 25)])])
        docs[len(docs)] = rnd.choice(["", "Well. ", "as we said before "]) + body + rnd.choice(["", " That is all.", " and so on"])
    docs |= {100 + k: " ".join(rnd.choice(things + people + ["the", "a", "of", str(k)]) for _ in range(40)) for k in range(10)}
    want = leaks_by_force(items, docs)
    rows = decontaminate.leaks_of_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len({k for k, _ in want}) > 30 and not any(k >= 100 for k, _ in want)


def test_slots_and_sentence_first_names(spark):
    item = "Alice buys 3.5 apples and Bob sells 60km of rope to five friends of the old miller down the road"
    same = {r["doc_id"]: r["same_slots"] for r in decontaminate.leaks_of_documents(spark.createDataFrame([
        (1, "Carol buys 7 apples and Dave sells 9 km of rope to seven friends of the old miller down the road"),
        (2, "Alice buys 35 apples and Bob sells 60 km of rope to five friends of the old miller down the road"),
        (3, item),
    ], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert same == {1: False, 2: False, 3: True}


def test_decontamination_of_odd_rows_is_native(spark, odd):
    items = spark.createDataFrame([(1, "word é𝒳 word é𝒳 word"), (None, None), (2, "")], "item_id long, text string")
    leaks = decontaminate.leaks_of_documents(odd, items)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} <= {(4, 1)}
    left = decontaminate.without_leaks(odd, items)
    assert left.columns == odd.columns and left.where("text is null").count() == 2 and left.count() >= len(odd.collect()) - 1
    for df in (leaks, left):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
