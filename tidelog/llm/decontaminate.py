"""Benchmark decontamination by template canonicalisation, by SQL functions only.

Texts become templates: numbers, units after numbers and names turn into typed placeholders, other
words into lower case without marks. Figures keep their points and commas, number words are numbers, and a unit is a word
of its own even where it follows its number without a space. There are three variants: names are capitalised words within a
sentence; or nothing is a name, so that case and what stands before don't matter; or all capitalised
words are names, those that begin a sentence too. Windows of ``WINDOW`` template words are hashed and the hashes of
documents are joined with those of benchmark items, so a question is found again when only its numbers,
names or units have been changed. Hits on one diagonal (the same offset between document and item) form
an alignment, which counts as a leak if it covers ``ENOUGH`` words (or the whole item, where that is
shorter) and its slots are consistent: each value of an item's slots must always stand for one value in
the document. That is asked of the whole alignment or of a run of ``ENOUGH`` or more hit words in it that edits
bound; ``ENOUGH`` verbatim words in a row are a leak whatever stands beside them.

Windows of documents are looked at only where all their words are figures, marked or known from the items, if these have at most ``VOCABULARY``
words; no other window can be a hit. They are filtered where they are read if the benchmark has at most ``SMALL``
windows of all variants, a bound that is checked before its hashes are broadcast; beyond it both sides are
shuffled by hash. Only documents with enough hits meet their texts again to have slots compared.

Defined results: null texts count as empty; items without words match nothing, items of fewer words
than a window are one window; repeated rows of equal key and text give one pair; null keys are pairs with a null key;
null or repeated item ids are reported as they are; empty tables give empty tables; other columns are neither read nor
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, once, text_or_empty

WINDOW, ENOUGH, SMALL, VOCABULARY = 8, 13, 500_000, 20_000

#: Units that may follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "gal", "s", "sec", "min", "h", "hr", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres", "mile", "miles", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees")
#: Words that are numbers.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "half", "twice", "dozen")
#: Control characters that mark names and units while a text is cut; a text's own ones are dropped.
NAME, FIRST, UNIT = "\\u0003", "\\u0004", "\\u0005"
#: Which marks are typed as names, by variant of the template; elsewhere a marked word is a plain one.
VARIANTS = ((NAME,), (), (NAME, FIRST))


def marked_words(text: str) -> str:
    """SQL for the words of a text in lower case without marks; names and units begin with their control character.

    A name is a capitalised word within a sentence, ``FIRST`` marks any other capitalised word; a unit is one of ``UNITS``
    after a number, in any case, and a word of its own even where no space parts them. Points and commas stay within numbers.
    """
    plain = f"replace(replace(replace({text}, '{NAME}', ''), '{FIRST}', ''), '{UNIT}', '')"
    named = f"regexp_replace({plain}, '([^.!?:\\\\s])(\\\\s+)(?=\\\\p{{Lu}}\\\\p{{Ll}}+(?!\\\\p{{L}}))', '$1$2{NAME}')"
    first = f"regexp_replace({named}, '(^|\\\\s)([^\\\\p{{L}}\\\\p{{N}}\\\\s{NAME}]*)(?=\\\\p{{Lu}}\\\\p{{Ll}}+(?!\\\\p{{L}}))', '$1$2{FIRST}')"
    units = f"regexp_replace({first}, '(\\\\p{{N}})\\\\s*[{NAME}{FIRST}]?((?i:{'|'.join(UNITS)}))(?!\\\\p{{L}})', '$1 {UNIT}$2')"
    bare = f"regexp_replace(lower({units}), '[^\\\\p{{L}}\\\\p{{N}}\\\\s.,{NAME}{FIRST}{UNIT}]+|(?<!\\\\p{{N}})[.,]+|[.,]+(?!\\\\p{{N}})', '')"
    return f"filter(split({bare}, '\\\\s+'), x -> ltrim('{NAME}{FIRST}{UNIT}', x) <> '')"


def typed_words(words: str) -> str:
    """SQL for marked words with numbers and units typed; names keep their marks.

    Number words count as numbers, and a unit's word after one as a unit. In a row of ``WINDOW`` and more figures the last
    ones stay plain, so that tables meet by what they hold.
    """
    figure = lambda i: f"left(get({words}, {i}), 1) between '0' and '9'"
    several = " and ".join(f"coalesce({figure(f'i - {k}')}, false)" for k in range(1, WINDOW))
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    plain = lambda x: f"ltrim('{NAME}{FIRST}', {x})"
    unit = f"{plain('x')} in ({listed(UNITS)}) and {plain(f'get({words}, i - 1)')} in ({listed(NUMBERS)})"
    return f"transform({words}, (x, i) -> case when left(x, 1) between '0' and '9' then if({several}, x, '<num>') when left(x, 1) = '{UNIT}' then '<unit>' when {plain('x')} in ({listed(NUMBERS)}) then '<num>' when {unit} then '<unit>' else x end)"


def word_of(names: tuple[str, ...]) -> str:
    """SQL for the template word of a typed word x, where these marks are names."""
    typed = "".join(f"when left(x, 1) = '{n}' then '<name>' " for n in names)
    return f"case {typed}else ltrim('{NAME}{FIRST}', x) end" if typed else f"ltrim('{NAME}{FIRST}', x)"


def templated(df: DataFrame) -> DataFrame:
    """Rows with a column text, and: raw (words in lower case without marks), words (template words by variant)."""
    df = once(once(df, _x=marked_words("text")), _t=typed_words("_x"))
    by_variant = ", ".join(f"transform(_t, x -> {word_of(v)})" for v in VARIANTS)
    return once(df, raw=f"transform(_x, x -> ltrim('{NAME}{FIRST}{UNIT}', x))", words=f"array({by_variant})").drop("_x", "_t")


def places(size: int, known: bool) -> str:
    """SQL for the begins, from 0, of a text's windows of that many words; where words are known, of those that hold known ones only."""
    inside = " and ".join(f"get(_ok, i + {k})" for k in range(size)) if known else "true"
    return f"if(size(_x) < {size}, filter(array(0), i -> false), filter(sequence(0, size(_x) - {size}), i -> {inside}))"


def windows(size: int, at: str | None = None) -> str:
    """SQL for (i, h1, h2, ...) of each window of that many words, or of those that begin at some: its place and its hash by variant."""
    hashed = lambda v: f"xxhash64({', '.join(f'get(th{v}, i + {k})' for k in range(size))}) as h{v}"
    every = f"if(size(th1) < {size}, filter(array(0), i -> false), sequence(0, size(th1) - {size}))"
    return f"transform({at or every}, i -> struct(i + 1 as i, {', '.join(hashed(v) for v in range(1, len(VARIANTS) + 1))}))"


def by_variant() -> Column:
    """The window w as an array of (v, hash)."""
    return F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"w.h{v}").alias("hash")) for v in range(1, len(VARIANTS) + 1)])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Rows (id, th, item, words, same): leaks in documents. words: covered by the longest stretch; same: none of its slots was changed.

    th is the hash of the document's text, by which rows of equal keys differ.
    """
    items = templated(benchmark.select(F.col(item).alias("item"), text_or_empty().alias("text")).distinct()).where("size(raw) > 0")
    ths = [F.expr(f"transform(words[{v - 1}], x -> xxhash64(x))").alias(f"th{v}") for v in range(1, len(VARIANTS) + 1)]
    items = cut(items.select("item", F.xxhash64("text").alias("ith"), "raw", "words", *ths))
    sizes = sorted(r[0] for r in items.select(F.least(F.lit(WINDOW), F.size("th1"))).distinct().collect())  # WINDOW values at most
    theirs = items.select("item", "ith", F.explode(F.concat(*[_of_size(n) for n in sizes or [WINDOW]])).alias("w"))
    theirs = theirs.select("item", "ith", "w.i", F.explode(by_variant()).alias("x")).select("item", "ith", "x.v", "i", "x.hash")
    theirs = cut(theirs.withColumnRenamed("i", "j"))
    small = theirs.count() <= SMALL

    slim = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text")).withColumn("doc", F.xxhash64("text"))
    sizes = sizes or [WINDOW]
    words = [r["w"] for r in items.select(F.explode("raw").alias("w")).distinct().limit(VOCABULARY + 1).collect()]
    known = len(words) <= VOCABULARY
    mine = once(slim.select("id", "doc", "text"), _x=marked_words("text")).select("id", "doc", "_x")
    if known:
        # Words that no item has can't be in a hit, unless they are figures or marked (both begin with a character up to 9).
        listed = ", ".join(f"'{w}'" for w in sorted({*words, *NUMBERS, *UNITS}))
        mine = once(mine, _ok=f"transform(_x, x -> ascii(x) <= 57 or x in ({listed}))")
    mine = once(mine, **{f"_at{n}": places(n, known) for n in sizes})
    mine = mine.where(" or ".join(f"size(_at{n}) > 0" for n in sizes))
    mine = once(mine.select("id", "doc", "_x", *[f"_at{n}" for n in sizes]), _t=typed_words("_x")).drop("_x")
    mine = once(mine, **{f"th{v}": f"transform(_t, x -> xxhash64({word_of(names)}))" for v, names in enumerate(VARIANTS, 1)}).drop("_t")
    mine = mine.select("id", "doc", F.explode(F.concat(*[F.expr(windows(n, f"_at{n}")) for n in sizes])).alias("w"))
    # A window whose variants are one meets the items once; which variants a hit is of, the item's side says.
    hashes = F.array(*[F.col(f"w.h{v}") for v in range(1, len(VARIANTS) + 1)])
    mine = mine.select("id", "doc", "w.i", hashes.alias("hs"), F.explode(F.array_distinct(hashes)).alias("hash"))
    hits = mine.join(F.broadcast(theirs) if small else theirs, "hash").where(F.element_at("hs", F.col("v")) == F.col("hash")).select("id", "doc", "item", "ith", "v", "i", (F.col("i") - F.col("j")).alias("shift")).distinct()
    runs = hits.groupBy("id", "doc", "item", "ith", "v", "shift").agg(F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"))
    runs = runs.join(items.select("item", "ith", F.size("th1").alias("length")), _same("item", "ith", runs, items), "inner").select(runs["*"], "length")
    covered = F.least(F.col("n") + WINDOW - 1, F.col("high") - F.col("low") + F.least(F.lit(WINDOW), F.col("length")), F.col("length"))
    runs = runs.withColumn("words", covered).where(F.col("words") >= F.least(F.lit(ENOUGH), F.col("length")))

    able = cut(runs.select("id", "doc", "item", "ith", "v", "shift", "low", "high", "length", "words"))
    by_doc = able.groupBy("id", "doc").agg(F.collect_list(F.struct("item", "ith", "v", "shift", "low", "high", "length", "words")).alias("runs")).withColumnRenamed("id", "rid").withColumnRenamed("doc", "rdoc")
    met = slim.join(by_doc, F.col("id").eqNullSafe(F.col("rid")) & (F.col("doc") == F.col("rdoc"))).select("id", "doc", "text", "runs")
    met = templated(met).select("id", "doc", "raw", "words", F.explode("runs").alias("run"))
    met = met.withColumn("word", F.expr("words[run.v - 1]"))
    # Of each alignment only its own stretch of words goes on; of the plain variant, where changed names part it, all that the item spans.
    begin = "if(run.v = 2, greatest(1, run.shift + 1), run.low)"
    stretch = f"if(run.v = 2, run.length - ({begin} - run.shift - 1), least(run.high - run.low + least({WINDOW}, run.length), run.length))"
    met = met.select("id", "doc", "run", F.expr(begin).alias("begin"), F.expr(f"arrays_zip(slice(raw, {begin}, {stretch}), slice(word, {begin}, {stretch}))").alias("mine"))
    theirs = items.select(F.col("item").alias("bitem"), F.col("ith").alias("bith"), F.col("raw").alias("braw"), F.col("words").alias("bwords"))
    met = met.join(theirs, F.col("run.item").eqNullSafe(F.col("bitem")) & (F.col("run.ith") == F.col("bith")))
    met = met.withColumn("theirs", F.expr("arrays_zip(slice(braw, begin - run.shift, size(mine)), slice(bwords[run.v - 1], begin - run.shift, size(mine)))"))
    both = "zip_with(theirs, mine, (b, d) -> struct(b.`1` = d.`1` as hit, b.`1` as k, b.`0` as b, d.`0` as d))"
    met = once(met.select("id", "doc", "run", "theirs", "mine"), both=both)
    # Each row's stretches: the whole alignment, its runs of hit words, and the most verbatim words in a row.
    between = lambda test: f"transform(array(filter(sequence(0, size(both) + 1), i -> i = 0 or i = size(both) + 1 or not both[i - 1].{test})), e -> zip_with(slice(e, 1, size(e) - 1), slice(e, 2, size(e) - 1), (x, y) -> struct(x + 1 as at, y - x - 1 as n)))[0]"
    met = once(met.drop("theirs", "mine"), runs=between("hit"), plain=between("b <=> both[i - 1].d"))
    whole = "array(struct(both as s, run.words as words))"
    parts = f"transform(filter(runs, x -> run.v <> 2 and x.n >= {ENOUGH}), x -> struct(slice(both, x.at, x.n) as s, x.n as words))"
    exact = f"transform(filter(plain, x -> x.n >= {ENOUGH}), x -> struct(slice(both, x.at, x.n) as s, x.n as words))"
    slots = "array_distinct(transform(filter(x.s, y -> y.hit and y.k in ('<num>', '<unit>', '<name>')), y -> struct(y.k, y.b, y.d)))"
    met = once(met.select("id", "doc", "run", "both", "runs", "plain"), found=f"transform(concat({whole}, {parts}, {exact}), x -> struct(x.words, {slots} as pairs))")
    good = met.select("id", "doc", F.col("run.item").alias("item"), F.explode("found").alias("f"))
    good = good.where("size(array_distinct(transform(f.pairs, x -> struct(x.k, x.b)))) = size(f.pairs)")
    good = good.select("id", "doc", "item", F.col("f.words").cast("int").alias("words"), F.expr("forall(f.pairs, x -> x.b = x.d)").alias("same"))
    best = good.groupBy("id", "doc", "item").agg(F.max(F.struct("words", "same")).alias("best"))
    return best.select("id", "doc", "item", "best.words", "best.same")


def _of_size(n: int) -> Column:
    """The windows of items whose windows have n words."""
    own = f"size(th1) = {n}" if n < WINDOW else f"size(th1) >= {n}"
    return F.expr(f"if({own}, {windows(n)}, filter({windows(n)}, x -> false))")


def _same(a: str, b: str, x: DataFrame, y: DataFrame) -> Column:
    return x[a].eqNullSafe(y[a]) & (x[b] == y[b])


def leaks_of_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, item_id, n_words, same_slots): each pair of a document and a benchmark item that it holds."""
    return find_leaks(docs, benchmark, key).groupBy(F.col("id").alias(key), F.col("item").alias("item_id")).agg(F.max(F.struct("words", "same")).alias("best")).select(key, "item_id", F.col("best.words").cast("long").alias("n_words"), F.col("best.same").alias("same_slots"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all columns."""
    bad = find_leaks(docs, benchmark, key, text).select(F.col("id").alias("_dc_bad"), F.col("doc").alias("_dc_text")).distinct()
    keyed = docs.withColumn("_dc_id", F.col(key).cast("long")).withColumn("_dc_doc", F.xxhash64(text_or_empty(text)))
    return keyed.join(bad, F.col("_dc_id").eqNullSafe(F.col("_dc_bad")) & (F.col("_dc_doc") == F.col("_dc_text")), "left_anti").drop("_dc_id", "_dc_doc")
