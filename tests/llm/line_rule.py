"""Line dedup's rule by brute force, on dictionaries of texts."""

import re
from collections import defaultdict

import xxhash

from tidelog.llm import linededup as rule


def size(line):
    return len(line.encode())


def by_hash(line):
    w = line.split(" ")
    if len(w) < rule.SPAN:
        return [line]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    h = [(x - (1 << 64) if x >> 63 else x) >> 28 for x in h]
    begins = sorted({0} | {min(range(i, i + rule.SPAN), key=lambda j: (h[j], j)) for i in range(len(w) - rule.SPAN + 1)})
    return [" ".join(w[a:b]) for a, b in zip(begins, begins[1:] + [len(w)], strict=True)]


def pieces(line):
    out = re.split(rule.CUTS["SPACES"], line)
    out = [y for x in out for y in ([x] if size(x) < rule.LONG else re.split(rule.FINER, x))]
    return [y for x in out for y in ([x] if size(x) < rule.LONG or "\x1e" in x else by_hash(x))]


def units(text):
    """(line, its end) of each line or piece."""
    out, own = [], text.split("\n")
    for j, p in enumerate(own):
        mine = pieces(p)
        out += [(x, " " if i + 1 < len(mine) else "\n" if j + 1 < len(own) else "") for i, x in enumerate(mine)]
    return out


def chunks(lines):
    for i, x in enumerate(lines):
        w = max(rule.TINY, size(x) + 1)
        alone = i > 0 and (size(lines[i - 1]) + 1 >= rule.LEAST or lines[i - 1] == x)
        if w < rule.EDGE and xxhash.xxh64_intdigest(x.encode(), 42) % rule.RARE and not alone:
            continue
        n = 1
        while w < rule.LEAST and i + n < len(lines):
            w += max(rule.TINY, size(lines[i + n]) + 1)
            n += 1
        if w >= rule.LEAST:
            yield i, n


def removed(texts):
    """Of each text the numbers of the lines that go."""
    where, gone = defaultdict(list), defaultdict(set)
    for k in sorted(texts):
        own = [x for x, _ in units(texts[k])]
        for i, n in chunks(own):
            where["\x00".join(own[i : i + n])].append((k, i, n))
    for places in where.values():
        for k, i, n in sorted(places)[1:]:
            gone[k] |= set(range(i, i + n))
    return gone


def deduped(texts):
    gone = removed(texts)
    return {k: "".join(x + e for i, (x, e) in enumerate(units(t)) if i not in gone[k]) if gone[k] else t for k, t in texts.items()}
