"""Secret scans through a trigram inverted index, by SQL functions only.

Each rule's regular expression is compiled, on the driver, to a Boolean trigram query: an OR of
ANDs of trigrams (lower case) one of which any matching text must satisfy. The index holds the
postings (trigram, text key) of the trigrams that the rules ask for; a clause's postings are
intersected by counting a key's distinct trigrams, and texts that satisfy a clause are
verified by the regular expression itself. Rules without mandatory trigrams scan every text.

The text key is a digest of the whole text, so copies share their postings. Postings are
checkpointed; the driver gets one count for each of the rules' trigrams. The rarest trigram of each
clause drives the intersection: only texts on a driving postings list can be candidates, so only
they are shuffled to meet the candidates; all other texts are scanned where they are read.

Spans count code points, end exclusive, as leftmost non-overlapping matches of each rule.

Defined results: a null text counts as empty and has no spans; repeated rows and ties give a row each; an
empty table gives an empty table; other columns of the input are neither read nor returned. A text
of many matches is handled in one row, its running offset kept in blocks, so cost stays near linear.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, text_or_empty

#: The most literal strings that one stretch of a pattern is unfolded into, and the most clauses of a rule.
UNFOLDED, CLAUSES = 64, 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` and ``group``: the match counts if that group has as many characters.

    ``scan`` may hold an equal pattern that is cheaper to run; it is what the text is scanned with.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    scan: str = ""
    base: bool = True


#: The kinds of secrets, in their order. `{24,}` over a run equals runs of 24 or more, and
#: a shorter run after AKIA holds no longer one, so both scan patterns find the same spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36}", base=False),
)

Clauses = list[frozenset[str]]
ANY: Clauses = [frozenset()]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def minimal(clauses: Clauses) -> Clauses:
    """Without clauses that another one implies."""
    out: Clauses = []
    for c in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in out):
            out.append(c)
    return out


def both(a: Clauses, b: Clauses) -> Clauses:
    """a AND b; too many clauses: the one that asks for more."""
    joined = minimal([x | y for x in a for y in b])
    return joined if len(joined) <= CLAUSES else max(a, b, key=lambda c: min(map(len, c)))


def _analyse(items) -> tuple[set[str] | None, Clauses]:
    """(the strings that a parsed pattern matches, if few; clauses that any match satisfies)."""
    run, need = {""}, ANY
    known = True

    def close():
        nonlocal run, need
        if run != {""}:
            need = both(need, minimal([trigrams(s) for s in run]))
        run = {""}

    for op, arg in items:
        strings, clauses = _one(op, arg)
        if strings is not None and len(run) * len(strings) <= UNFOLDED:
            run = {a + b for a in run for b in strings}
            continue
        known = False
        close()
        if strings is not None and len(strings) <= UNFOLDED:
            run = set(strings)
        else:
            need = both(need, clauses)
    if known:
        return run, minimal([trigrams(s) for s in run])
    close()
    return None, need


def _one(op, arg) -> tuple[set[str] | None, Clauses]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is C.IN:
        if all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(v).lower() for _, v in arg}, ANY
        return None, ANY
    if op is C.SUBPATTERN:
        return _analyse(arg[3])
    if op is C.BRANCH:
        found = [_analyse(b) for b in arg[1]]
        strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
        return strings, minimal([c for _, cs in found for c in cs])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, clauses = _analyse(inner)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else set()), ANY if low == 0 else clauses
        if strings is not None and low == high and low <= 4 and len(strings) ** low <= UNFOLDED:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, minimal([trigrams(s) for s in out])
        return None, clauses if low else ANY
    if op is C.AT:
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> Clauses:
    """OR of ANDs of lower-case trigrams; a clause without trigrams means that any text may match."""
    return _analyse(parser.parse(pattern))[1]


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end, keep): the rule's matches in a text, by the lengths of matches and of the gaps between them."""
    rx = F.lit(rule.scan or rule.pattern)
    found, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rule.scan or rule.pattern, -1)
    keep = lambda m: (F.length(m) if rule.group == 0 else F.length(F.regexp_extract(m, rule.pattern, rule.group))) >= rule.least
    steps = F.zip_with(F.transform(gaps, F.length), F.transform(found, lambda m: F.struct(F.length(m).alias("n"), keep(m).alias("keep"))), lambda g, m: F.struct(g.alias("gap"), m.n.alias("n"), m.keep.alias("keep")))
    span = "array<struct<start:int,end:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("now"), F.array().cast(f"array<{span}>").alias("done"))

    def step(acc, s):
        start = acc.at + s.gap
        end = start + F.coalesce(s.n, F.lit(0))
        now = F.when(F.coalesce(s.keep, F.lit(False)), F.concat(acc.now, F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc.now)
        full = F.size(acc.now) >= 256
        return F.struct(
            end.alias("at"),
            F.when(full, F.when(F.coalesce(s.keep, F.lit(False)), F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(span))).otherwise(now).alias("now"),
            F.when(full, F.concat(acc.done, F.array(acc.now))).otherwise(acc.done).alias("done"),
        )

    whole = F.aggregate(steps, empty, step, lambda acc: F.concat(F.flatten(acc.done), acc.now))
    return F.when(text.rlike(rule.scan or rule.pattern), whole).otherwise(F.array().cast(span))


def postings(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """The inverted index (trigram, key) of the vocabulary over the distinct texts; key: a digest of the text."""
    lower = F.lower("text")
    present = F.array_compact(F.array(*[F.when(lower.contains(t), F.lit(t)) for t in vocabulary]))
    held = docs.select(text_or_empty(text).alias("text")).select(F.md5("text").alias("key"), present.alias("trigrams"))
    # The outer form keeps the optimizer from filtering by the array's size, which would build it twice.
    return held.select(F.explode_outer("trigrams").alias("trigram"), "key").where("trigram is not null").distinct()


def candidates(index: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(key, kinds): the rules of which a text satisfies a clause, by intersecting postings."""
    terms = [(kind, i, t, len(c)) for kind, cs in queries.items() for i, c in enumerate(cs) for t in sorted(c)]
    asked = index.sparkSession.createDataFrame(terms, "kind string, clause int, trigram string, n int")
    hits = index.join(F.broadcast(asked), "trigram")  # a row for each trigram of the rules
    whole = hits.groupBy("key", "kind", "clause", "n").agg(F.count("*").alias("have")).where("have = n")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, found): per document an array of (start, ord, kind, end) in order of start, then of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: cs for k, cs in queries.items() if all(cs)}
    vocabulary = sorted({t for cs in indexed.values() for c in cs for t in c})
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def spans(kinds: Column | None) -> Column:
        out = []
        for i, r in enumerate(rules):
            if r.kind in indexed and kinds is None:
                continue
            one = F.transform(matches(F.col("text"), r), tagged(i, r.kind))
            none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
            out.append(one if r.kind not in indexed else F.when(F.array_contains(kinds, r.kind), one).otherwise(none))
        return F.sort_array(F.concat(*out)) if out else F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")

    if not vocabulary:
        return rows.select("key", "text", spans(None).alias("found"))
    index = cut(postings(docs, vocabulary, text))
    frequency = {r["trigram"]: r["count"] for r in index.groupBy("trigram").count().collect()}  # one row for each of the vocabulary
    driving = sorted({min(sorted(c), key=lambda t: frequency.get(t, 0)) for cs in indexed.values() for c in cs})
    listed = F.col("text").rlike("(?i)" + "|".join(map(re.escape, driving)))
    able = rows.where(listed).withColumn("digest", F.md5("text")).join(candidates(index, indexed).withColumnRenamed("key", "digest"), "digest", "left")
    able = able.select("key", "text", spans(F.coalesce("kinds", F.array().cast("array<string>"))).alias("found"))
    return able.union(rows.where(~listed).select("key", "text", spans(None).alias("found")))


def tagged(i: int, kind: str):
    return lambda s: F.struct(s.start.alias("start"), F.lit(i).alias("ord"), F.lit(kind).alias("kind"), s.end.alias("end"))


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def secrets_of_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_assign, n_access, n_hex, base_sha256, spans), one for each document."""
    found = scan_secrets(docs, rules, key, text)
    base = [r.kind for r in rules if r.base]
    count = lambda k: F.size(F.filter("found", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    of_base = F.filter("found", lambda s: s.kind.isin(base))
    return found.select(F.col("key").alias(key), *[count(k) for k in base], F.sha2(written(of_base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
