"""Chat formatting with minimum-cost role repair.

Conversations must be words of a small automaton: an optional system turn, then user and assistant
in turn, the assistant last. A dynamic program chooses for every turn, at the least total cost,
whether it keeps its role, is relabelled, is merged into the message before it, and which empty turns
are inserted first. The repaired sequence is rendered in ChatML.

A step depends on the turn's role alone, so it is a matrix of costs between automaton states, and
a run of turns is the (min, +) product of its steps. Conversations are cut into runs of ``RUN`` turn
numbers; runs are multiplied in parallel, products are combined over levels of ``RUN`` again until a
conversation has one, and the states chosen at run borders go back down. So a conversation of any length,
even a third of all turns, is worked on by many tasks; texts are shuffled once, to be rendered.

The result has a row for each turn, with the fragment that it adds to its rendered conversation:
fragments in order, joined, are the conversation, and none needs the whole in one place.

Defined results: turns are ordered by turn (null first), role and text; repeated rows are turns of
their own; roles are compared without case and surrounding space; an unknown or null role must be
relabelled; a null text is empty; a null conversation key is a conversation; markers within texts are
broken by a space; an empty table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import kept_table

RUN = 256
#: Costs of an action.
RELABEL, MERGE, INSERT = 2, 1, 3
ROLES = ("system", "user", "assistant")
#: Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
#: Automaton: state 0 is the start, state 1 + i follows a message of ROLES[i]; the last state accepts.
NEXT = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user",)}
FAR = 1 << 40


def state(role: str) -> int:
    return 1 + ROLES.index(role)


def inserted(s: int, wanted) -> tuple[str, ...] | None:
    """The fewest empty turns after which ``wanted`` holds of the state."""
    seen, queue = {s}, [(s, ())]
    for at, path in queue:
        if wanted(at):
            return path
        for r in NEXT[at]:
            if state(r) not in seen:
                seen.add(state(r))
                queue.append((state(r), (*path, r)))
    return None


def steps(own: str | None) -> list[list[tuple | None]]:
    """[from][to] -> (cost, merged, empty turns before), for a turn of that role."""
    table: list[list[tuple | None]] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for r in ROLES:
            relabel = 0 if r == own else RELABEL
            ways = []
            if s == state(r):
                ways.append((relabel + MERGE, True, ()))
            if (path := inserted(s, lambda at: r in NEXT[at])) is not None:  # noqa: B023
                ways.append((relabel + INSERT * len(path), False, path))
            table[s][state(r)] = min(ways, key=lambda w: w[0], default=None)
    return table


STEPS = {own: steps(own) for own in (None, *ROLES)}
END = [inserted(s, lambda at: at == 3) for s in range(4)]


def role_of(raw: str | None) -> str | None:
    name = (raw or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def times(a: list[int], b: list[int]) -> list[int]:
    """(min, +) product of 4 by 4 matrices, by rows."""
    return [min(min(a[4 * i + k] + b[4 * k + j] for k in range(4)), FAR) for i in range(4) for j in range(4)]


MATRIX = {own: [(w[0] if w else FAR) for row in t for w in row] for own, t in STEPS.items()}
ONE = [0 if i == j else FAR for i in range(4) for j in range(4)]


def best_path(matrices: list[list[int]], entry: int, exit: int) -> list[int]:
    """States after each of the matrices, on the cheapest way from entry to exit; ties go to the lower state."""
    costs, back = [0 if s == entry else FAR for s in range(4)], []
    for m in matrices:
        ways = [min((costs[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
        costs = [w[0] for w in ways]
        back.append([w[1] for w in ways])
    out, at = [], exit
    for b in reversed(back):
        out.append(at)
        at = b[at]
    return out[::-1]


def repair(roles: list[str | None], entry: int = 0, exit: int | None = None) -> list[tuple[str, bool, tuple[str, ...]]]:
    """(new role, merged, empty turns before) for each turn of a run."""
    if exit is None:
        exit = last_state([MATRIX[r] for r in roles])
    out, s = [], entry
    for own, t in zip(roles, best_path([MATRIX[r] for r in roles], entry, exit), strict=True):
        _, merged, path = STEPS[own][s][t]
        out.append((ROLES[t - 1], merged, path))
        s = t
    return out


def last_state(matrices: list[list[int]]) -> int:
    """Where the cheapest way from the start ends, the empty turns at the end counted."""
    whole = ONE
    for m in matrices:
        whole = times(whole, m)
    return min(range(4), key=lambda s: (whole[s] + INSERT * len(END[s]), s))


def opening(role: str) -> str:
    return f"<|im_start|>{role}\n"


CLOSING = "<|im_end|>\n"


def fragment(first: bool, last: bool, role: str, merged: bool, before, after, text: str) -> str:
    """What a turn adds to its rendered conversation."""
    text = text.replace("<|im_", "< |im_")
    empty = lambda rs: "".join(opening(r) + CLOSING for r in rs)
    start = "\n\n" if merged else ("" if first else CLOSING) + empty(before) + opening(role)
    return start + text + (CLOSING + empty(after) if last else "")


def _runs(batches):
    """Groups (conversation, block, rows) of batches sorted by their first two columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield key, rows


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", run: int = RUN) -> DataFrame:
    """Rows (conv, turn, role, new_role, merged, inserted_before, inserted_after, cost, fragment), one for each turn."""
    import pyarrow as pa

    kind, turn_kind = chats.schema[conv].dataType.simpleString(), chats.schema[turn].dataType.simpleString()
    low = chats.agg(F.min(turn)).head()[0] or 0
    # Blocks count from 1, null turns are block 0, so that dividing by the run again and again ends in one block.
    block = F.coalesce(F.floor(F.col(turn) / run).cast("long") + (1 - min(0, low // run)), F.lit(0).cast("long"))
    rows = chats.select(F.col(conv).alias("conv"), block.alias("block"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = lambda df, *order: df.repartition("conv", "block").sortWithinPartitions("conv", "block", *order)

    def multiply(batches):
        out = []
        for (c, b), group in _runs(batches):
            whole = ONE
            for row in group:
                whole = times(whole, MATRIX[role_of(row[2])] if not isinstance(row[2], list) else row[2])
            out.append((c, b, whole))
            if len(out) == 5000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    key_type, turn_type = _arrow(chats.schema[conv].dataType), _arrow(chats.schema[turn].dataType)

    def made(out):
        c, b, m = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, key_type), pa.array(b, pa.int64()), pa.array(m, pa.list_(pa.int64()))], ["conv", "block", "m"])

    # Up: each level's products, until every conversation is one run.
    schema = f"conv {kind}, block long, m array<long>"
    levels = [kept_table(dealt(rows.select("conv", "block", "role", "turn"), F.asc_nulls_first("turn"), "role").select("conv", "block", "role").mapInArrow(multiply, schema), "runs")]
    while levels[-1].groupBy("conv").count().where("count > 1").limit(1).count():
        up = levels[-1].select("conv", F.floor(F.col("block") / run).cast("long").alias("block"), "m", F.col("block").alias("child"))
        levels.append(kept_table(dealt(up, "child").select("conv", "block", "m").mapInArrow(multiply, schema), "runs"))

    # Down: the states at the borders of each run.
    ways = [F.struct((F.element_at("m", s + 1) + INSERT * len(END[s])).alias("cost"), F.lit(s).alias("state")) for s in range(4)]
    ending = F.array_min(F.array(*ways))["state"].cast("int")

    chosen = levels[-1].select("conv", "block", F.lit(0).alias("entry"), ending.alias("exit"), F.lit(True).alias("ends"))
    for lower in reversed(levels[:-1]):
        below = lower.select("conv", F.floor(F.col("block") / run).cast("long").alias("block"), F.col("block").alias("child"), "m")
        above = chosen.withColumnsRenamed({"conv": "pconv", "block": "pblock"})
        joined = below.join(above, F.col("conv").eqNullSafe(F.col("pconv")) & (F.col("block") == F.col("pblock")))

        def descend(batches):
            def steps():
                for (c, _), group in _runs(batches):
                    path = best_path([g[3] for g in group], group[0][4], group[0][5])
                    yield from ((c, g[2], e, x, g[6] and i == len(group) - 1) for i, (g, e, x) in enumerate(zip(group, [group[0][4], *path[:-1]], path, strict=True)))

            yield from _batches(steps(), [key_type, pa.int64(), pa.int32(), pa.int32(), pa.bool_()], ["conv", "block", "entry", "exit", "ends"])

        chosen = kept_table(dealt(joined, "child").select("conv", "block", "child", "m", "entry", "exit", "ends").mapInArrow(descend, f"conv {kind}, block long, entry int, exit int, ends boolean"), "borders")

    chosen = chosen.withColumnsRenamed({"conv": "pconv", "block": "pblock"})
    met = rows.join(chosen, F.col("conv").eqNullSafe(F.col("pconv")) & (F.col("block") == F.col("pblock")))
    names = [conv, turn, role, "new_role", "merged", "inserted_before", "inserted_after", "cost", "fragment"]

    def turns(batches):
        for (c, _), group in _runs(batches):
            entry, exit, ends = group[0][5:8]
            own = [role_of(g[3]) for g in group]
            s = entry
            for i, (g, (new, merged, before)) in enumerate(zip(group, repair(own, entry, exit), strict=True)):
                last = ends and i == len(group) - 1
                after = END[exit] if last else ()
                cost = STEPS[own[i]][s][state(new)][0] + INSERT * len(after)
                yield c, g[2], g[3], new, merged, ",".join(before), ",".join(after), cost, fragment(entry == 0 and i == 0, last, new, merged, before, after, g[4])
                s = state(new)

    def render(batches):
        kinds = [key_type, turn_type, pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield from _batches(turns(batches), kinds, names)

    sorted_rows = dealt(met, F.asc_nulls_first("turn"), "role", "text").select("conv", "block", "turn", "role", "text", "entry", "exit", "ends")
    return sorted_rows.mapInArrow(render, f"`{conv}` {kind}, `{turn}` {turn_kind}, `{role}` string, new_role string, merged boolean, inserted_before string, inserted_after string, cost int, fragment string")


def _batches(rows, kinds, names, most: int = 2000, most_chars: int = 4 << 20):
    """Record batches of so many rows, or of so many characters of their last column, if that is text."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) == most or size >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
