"""Line dedup by content-defined chunks of lines, by SQL functions only.

A text is cut into lines by what stands there alone: at line ends, after sentences and at spaces between letters of two
classes; what has ``LONG`` or more bytes then at spaces between letters of two other classes, and what is
left before the word of least hash in each ``SPAN`` words. A rolling hash goes over the line hashes: from a line
on it takes in the fewest lines that weigh ``LEAST``, a line weighing its bytes and one for its end.
Such a run is a chunk. Lines that weigh less than ``EDGE`` begin one only if their own hash is one of
``RARE`` or the line before is a chunk by itself or equal to them, so in the middle of a passage but few tiny lines stay. A
chunk that occurs elsewhere (in any document, or again in its own) is removed everywhere but at its first occurrence, in order of key, text hash and place. Cuts within a repeated passage agree but for a line
cut off at either end, so a passage of 2 * 79 + 61 + 30 = 249 bytes, which 51 words are, holds a chunk that
begins and ends in it (for one of nothing but tiny lines: but for a chance of 3/4 for each of them).

Chunk rows hold no text: a hash (XXH64 of the line hashes), the number
of lines, the document and the place. They are shuffled once, by hash; each group is ordered there, and
what isn't first goes on to its document, with the place of the one before. Chunks that a bounded sample of documents shows to be frequent
are dealt over ``SALTS`` tasks each; the firsts of those tasks are then linked to the least of them, so the
sample decides where rows go and never what is removed. Texts are cut by patterns once, then shuffled once with
their cuts marked, for all that reads them: chunks, comparison and what remains.

Then lines are compared byte for byte: each document's linked chunks go, as lines without repeats, to the document that holds those
before. Where they differ (only if hashes collide), all chunks of these hashes are grouped again by their bytes, and the
first of each of those groups stays.

A line's end (one line feed, or one space after a sentence) is not compared; it goes with its line.

Defined results: a null text counts as empty and, where nothing is removed, stays null; rows of equal
key and text count as one document and all get its result; a null key comes first; ties in key go by text
hash; an empty table gives an empty table; other columns pass through (names that begin with ``_ld`` are
reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import once, text_or_empty

#: Weights: a chunk's, a line's at least, and that of lines of which only one in ``RARE`` begins a chunk.
LEAST, TINY, EDGE, RARE = 61, 5, 30, 4
#: Lines of this many bytes are cut further; words of the windows whose least hash cuts the last of them.
LONG, SPAN = 80, 8
#: Documents that are looked at to find frequent chunks, the most such chunks, and the tasks that each is dealt over.
SAMPLE, FREQUENT, SALTS = 500, 1000, 64
#: Where texts are cut: at line ends (or within a line only), after sentences, and at spaces between letters of two classes, some one in ten of
#: an English text's; and where lines are that are still long: at spaces between those of two others.
_SPACES = "(?<=[.!?] )|(?<=[aeimquy] )(?=[bdfhjlnprtvxz])"
CUTS = {"LINES": f"[\\\\n ](?:(?<=\\\\n)|{_SPACES})", "SPACES": f" (?:{_SPACES})"}
FINER = "(?<=[bdhlnrst]) (?=[acegikmoqsuw])"
#: The record separator stands for a space at which a text is cut; the unit separator parts lines that keep their ends. Texts that
#: hold either themselves are cut anew wherever their lines are read.
MARK, UNIT = "\\u001e", "\\u001f"


def _let(name: str, value: str, body: str) -> str:
    """SQL for an expression in which a name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _by_hash(line: str) -> str:
    """SQL for a long line, marked before the word of least hash in each ``SPAN`` words.

    A word's hash ends in its place, so the least of a window tells where it stands; the least of a
    window is the lesser of two smaller ones'.
    """
    least, width = "hs", 1
    while width < SPAN:
        by = min(width, SPAN - width)
        least, width = _let("m", least, f"zip_with(m, slice(m, {by + 1}, size(m)), (p, q) -> least(p, q))"), width + by
    begins = f"array_distinct(concat(array(0), transform(slice({least}, 1, size(hs) - {SPAN - 1}), x -> cast(x & 268435455 as int))))"
    marks = f"flatten(zip_with(bs, concat(slice(bs, 2, size(bs)), array(size(ws))), (a, b) -> concat(array('{MARK}'), array_repeat('', b - a - 1))))"
    marked = f"array_join(zip_with({marks}, ws, (a, w) -> concat(a, w)), ' ')"
    begun = _let("bs", _let("hs", "transform(ws, (w, i) -> (xxhash64(w) & -268435456L) | i)", begins), marked)
    cut = _let("ws", f"split({line}, ' ')", f"if(size(ws) < {SPAN}, '{MARK}' || {line}, {begun})")
    return f"replace(substring({cut}, 2), ' {MARK}', '{MARK}')"


def lines_of(text: str, at: str = "LINES") -> str:
    """SQL for the lines of a text, long ones in pieces; a line that holds ``MARK`` isn't cut by hash."""
    fine = f"if(octet_length(y) < {LONG} or contains(y, '{MARK}'), array(y), split({_by_hash('y')}, '{MARK}'))"
    return f"flatten(transform(split({text}, '{CUTS[at]}'), x -> if(octet_length(x) < {LONG}, array(x), flatten(transform(split(x, '{FINER}'), y -> {fine})))))"


def marked(text: str) -> str:
    """SQL for a text (without ``MARK``) with each space at which ``lines_of`` cuts it marked, so that it is cut by patterns but once."""
    join = lambda each, cut, then: f"array_join(transform(split({each}, '{MARK}'), {cut} -> if(octet_length({cut}) < {LONG}, {cut}, {then})), '{MARK}')"
    long = join("l", "x", join(f"regexp_replace(x, '{FINER}', '{MARK}')", "y", _by_hash("y")))
    spaced = f"regexp_replace({text}, '{CUTS['SPACES']}', '{MARK}')"
    return f"array_join(transform(split({spaced}, '\\n'), l -> if(octet_length(l) < {LONG}, l, {long})), '\\n')"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Rows (id, th, first, n, h): chunks of documents (id, th, text), by number of the first piece and number of pieces."""
    return chunks(docs.select("id", "th", F.expr(lines_of("text")).alias("parts")))


def chunks(cut: DataFrame) -> DataFrame:
    """The same of documents (id, th, parts). Each line is a row beside its document's arrays, in compiled code that copies none of them."""
    # The fewest lines are LEAST / TINY at most; the last chunk begins where what is left weighs LEAST.
    most = -(-LEAST // TINY)
    cut = once(cut, us="transform(parts, x -> xxhash64(x))", ws=f"transform(parts, x -> greatest({TINY}, octet_length(x) + 1))").select("id", "th", "us", "ws")
    back = f"aggregate(reverse(slice(ws, -least({most}, size(ws)), {most})), struct(0 as s, 0 as k), (a, x) -> if(a.s >= {LEAST}, a, struct(a.s + x as s, a.k + 1 as k)), a -> if(a.s >= {LEAST}, size(ws) - a.k, -1))"
    lines = once(cut, last=back).select("id", "th", "us", "ws", "last", F.posexplode("ws").alias("i", "w"))
    begins = f"i <= last and (w >= {EDGE} or get(us, i) & {RARE - 1} = 0 or coalesce(get(ws, i - 1) >= {LEAST} or get(us, i) = get(us, i - 1), false))"
    # No filter on n here: pushed down, it would make the code too long to be compiled.
    weighed = lines.where(begins).select("id", "th", "us", "i", "w", *[F.expr(f"coalesce(get(ws, i + {k}), 0)").alias(f"w{k}") for k in range(1, most)])
    fewest = " ".join(f"when {' + '.join(['w', *[f'w{k}' for k in range(1, n)]])} >= {LEAST} then {n}" for n in range(1, most))
    found = weighed.select("id", "th", "us", "i", F.expr(f"case {fewest} else {most} end").alias("n"))
    return found.select("id", "th", F.expr("i + 1").alias("first"), "n", F.expr("if(n = 1, get(us, i), xxhash64(slice(us, i + 1, n)))").alias("h"))


def identity(key: str, text: str) -> list[Column]:
    """A document's id and th, neither of them null: rows without a key get the least id, and hashes before all others."""
    known, hashed = F.col(key).cast("long"), F.hash(text_or_empty(text)).cast("long")
    return [F.coalesce(known, F.lit(-(1 << 63))).alias("id"), F.when(known.isNull(), hashed - (1 << 33)).otherwise(hashed).alias("th")]


def slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*identity(key, text), text_or_empty(text).alias("text"))


def frequent(docs: DataFrame, key: str, text: str) -> list[int]:
    """Hashes of chunks that are frequent in a sample of about ``SAMPLE`` documents; ``FREQUENT`` at most."""
    total = docs.count()
    if total <= SAMPLE:
        return []
    rows = chunk_rows(slim(docs.sample(min(1.0, SAMPLE / total), seed=7), key, text)).groupBy("h").agg(F.count("*").alias("n"))
    return [r["h"] for r in rows.where("n > 3").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()]


def shuffled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All rows and columns by document (_ld_id, _ld_th), texts marked where _ld_marked says so: the one shuffle of the texts, which all that reads them shares."""
    of, th = identity(key, text)
    plain = f"not (contains(coalesce(`{text}`, ''), '{MARK}') or contains(coalesce(`{text}`, ''), '{UNIT}'))"
    new = F.expr(f"if({plain}, {marked(f'`{text}`')}, `{text}`)")
    return docs.withColumns({"_ld_id": of, "_ld_th": th, "_ld_marked": F.expr(plain), text: new}).repartition("_ld_id", "_ld_th")


def with_lines(texts: DataFrame, text: str, asked: DataFrame | None = None) -> DataFrame:
    """Rows (id, th, what is asked, parts), one for each text that is asked for; without asked, for each text."""
    # Reads all columns, as a shuffle of fewer would be another one.
    read = " + ".join(f"int(`{c}` is null)" for c in texts.columns)
    whole = F.expr(f"if({read} >= 0, coalesce(cast(`{text}` as string), ''), '')").alias("_ld_text")
    if asked is None:
        met = texts.select(F.col("_ld_id").alias("id"), F.col("_ld_th").alias("th"), "_ld_marked", whole)
    else:
        named = asked.select(*[F.col(c).alias(f"_ld_asked_{c}") for c in asked.columns])
        met = named.join(texts, (F.col("_ld_asked_id") == F.col("_ld_id")) & (F.col("_ld_asked_th") == F.col("_ld_th")))
        met = met.select(*[F.col(f"_ld_asked_{c}").alias(c) for c in asked.columns], "_ld_marked", whole)
    parts = f"if(_ld_marked, split(replace(_ld_text, '\\n', '{MARK}'), '{MARK}'), {lines_of('_ld_text')})"
    return once(met, parts=parts).drop("_ld_text", "_ld_marked")


def grouped(texts: DataFrame, text: str, hot: list[int]) -> DataFrame:
    """Chunk rows by hash and, for frequent hashes, salt: their one shuffle."""
    salt = F.when(F.col("h").isin(hot), F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)) + 1).otherwise(0) if hot else F.lit(0).cast("long")
    return chunks(with_lines(texts, text)).withColumn("salt", salt).repartition("h", "salt")


def linked(rows: DataFrame, hot: list[int]) -> DataFrame:
    """Rows (id, th, pid, pth, by, chunks): of each document the chunks (first, n) whose hash occurred before, by the
    document that has the one before and the distance there. In a group each chunk is the one before of one at most
    (the first of a dealt group: of one a task).
    """
    place = ["id", "th", "first"]
    w = Window.partitionBy("h", "salt").orderBy(*place)
    found = rows.select(*place, "n", "salt", "h", *[F.lag(x).over(w).alias(f"p{x}") for x in place])
    apart = F.expr("not (id = pid and th = pth and first = pfirst)")
    if hot:
        # What begins a dealt group's task is linked to the least of these: FREQUENT * SALTS rows at most.
        begins = F.expr("salt > 0 and pid is null")
        # Both uses read all columns, so that they share one shuffle.
        found = found.where(begins | apart).select(*place, "n", F.when(begins, F.col("h")).alias("h"), "pid", "pth", "pfirst").repartition("id", "th")
        firsts = found.groupBy(F.col("h").alias("oh")).agg(F.min(F.struct(*place, "n", "pid", "pth", "pfirst")).alias("o"))
        # Rows without h meet the row of nulls, which changes nothing; a filter would part the shuffle.
        met = found.join(F.broadcast(firsts), F.col("h").eqNullSafe(F.col("oh")), "left")
        found = met.select(*place, "n", *[F.expr(f"coalesce(p{x}, o.{x})").alias(f"p{x}") for x in place]).where(apart)
    else:
        found = found.where(apart).select(*place, "n", "pid", "pth", "pfirst").repartition("id", "th")
    return found.groupBy("id", "th", "pid", "pth", F.expr("pfirst - first").alias("by")).agg(F.collect_list(F.struct("first", "n")).alias("chunks"))


def kept_by_bytes(rows: DataFrame, runs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Rows (id, th, keeps): chunks that differ from all before them although their hashes don't; none but for colliding hashes.

    The lines of each document's linked chunks go to the document that has those before and are compared there. Groups
    of chunks that a differing document has part in are then parted by their bytes.
    """
    # Chunks of one hash may differ in their number of lines: what isn't there is left out.
    body = lambda of: f"array_join(transform(x.ls, i -> get(parts, i - 1 + {of})), '\n')"
    asked = runs.withColumn("ls", F.expr("array_distinct(flatten(transform(chunks, x -> sequence(x.first, x.first + x.n - 1))))"))
    asked = asked.groupBy("id", "th").agg(F.collect_list(F.struct("pid", "pth", "by", "ls")).alias("asks"))
    sent = with_lines(texts, text, asked).select("id", "th", F.explode(F.expr(f"transform(asks, x -> struct(x.pid, x.pth, x.by, x.ls, {body(0)} as body))")).alias("x"))
    sent = sent.select(F.col("x.pid").alias("id"), F.col("x.pth").alias("th"), F.struct(F.col("id").alias("from_id"), F.col("th").alias("from_th"), "x.by", "x.ls", "x.body").alias("x"))
    there = with_lines(texts, text, sent.groupBy("id", "th").agg(F.collect_list("x").alias("xs")))
    differing = there.select(F.explode(F.expr(f"filter(xs, x -> not (x.body <=> {body('x.by')}))")).alias("x")).select(F.col("x.from_id").alias("id"), F.col("x.from_th").alias("th")).distinct()
    # Few, as hashes hardly collide. Both uses read all columns, so that they share the shuffle of chunk rows.
    groups = rows.join(F.broadcast(differing), ["id", "th"], "left_semi").select(F.expr("if(first + n + salt > 0, h, null)").alias("h")).distinct()
    members = rows.join(F.broadcast(groups), "h", "left_semi").groupBy("id", "th").agg(F.collect_list(F.struct("first", "n", "h", "salt")).alias("xs"))
    bodies = with_lines(texts, text, members).select("id", "th", F.explode(F.expr("transform(xs, x -> struct(x.h, x.first, array_join(slice(parts, x.first, x.n), '\n') as body))")).alias("x"))
    firsts = bodies.groupBy("x.h", "x.body").agg(F.min(F.struct("id", "th", "x.first")).alias("o"))
    return firsts.groupBy("o.id", "o.th").agg(F.collect_list("o.first").alias("keeps"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """Rows (id, th, ranges): of each document, its chunks (first, n) that occurred before, byte for byte."""
    hot = frequent(docs, key, text)
    texts = shuffled(docs, key, text) if texts is None else texts
    rows = grouped(texts, text, hot)
    runs = linked(rows, hot)
    kept = kept_by_bytes(rows, runs, texts, text)
    # Reads all columns, so that it shares the shuffle of found chunks.
    by_doc = runs.groupBy("id", "th").agg(F.collect_list(F.struct("pid", "pth", "by", "chunks")).alias("runs"))
    ranges = "flatten(transform(runs, x -> x.chunks))"
    return by_doc.join(kept, ["id", "th"], "left").select("id", "th", F.expr(f"if(keeps is null, {ranges}, filter({ranges}, x -> not array_contains(keeps, x.first)))").alias("ranges"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with the texts that remain, and _ld_removed: the number of lines (pieces of long ones) removed."""
    keyed = shuffled(docs, key, text)
    by_doc = repeats(docs, key, text, keyed).select(F.col("id").alias("_ld_of"), F.col("th").alias("_ld_of_th"), F.col("ranges").alias("_ld_ranges"))
    met = keyed.join(by_doc, (F.col("_ld_id") == F.col("_ld_of")) & (F.col("_ld_th") == F.col("_ld_of_th")), "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_ld_marked", "_ld_ranges")
    whole = f"coalesce(`{text}`, '')"
    met = once(met, _ld_out="array_distinct(flatten(transform(_ld_ranges, x -> sequence(x.first, x.first + x.n - 1))))")
    ended = "transform(ps, (p, i) -> if(i + 1 < size(ps), concat(p, ' '), if(j + 1 < size(ls), concat(p, '\\n'), p)))"
    full = f"flatten({_let('ls', f"split({whole}, '\\n')", f"transform(ls, (l, j) -> {_let('ps', lines_of('l', 'SPACES'), ended)})")})"
    ends = f"split(replace(replace({whole}, '\\n', '\\n{UNIT}'), '{MARK}', ' {UNIT}'), '{UNIT}')"
    rest = _let("f", f"if(_ld_marked, {ends}, {full})", "array_join(transform(array_except(sequence(1, size(f)), _ld_out), i -> element_at(f, i)), '')")
    changed = F.col("_ld_out").isNotNull()
    new = F.when(changed, F.expr(rest)).otherwise(F.expr(f"if(_ld_marked, replace(`{text}`, '{MARK}', ' '), `{text}`)")).alias(text)
    removed = F.when(changed, F.size("_ld_out")).otherwise(0).cast("long").alias("_ld_removed")
    return met.select(*[new if c == text else F.col(f"`{c}`") for c in docs.columns], removed)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with what remains of their texts; n_chars, where there is one, follows."""
    out = without_repeats(docs, key, text).drop("_ld_removed")
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_removed, text_sha256), one for each document; n_removed counts lines and pieces of long ones."""
    out = without_repeats(docs.select(key, text), key, text)
    return out.select(key, F.col("_ld_removed").alias("n_removed"), F.sha2(text_or_empty(text), 256).alias("text_sha256"))
