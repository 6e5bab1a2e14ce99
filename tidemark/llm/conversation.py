"""Repair of conversations by weighted finite-state composition.

Three machines are composed: the input acceptor (a conversation's rows in order, each with its fault), the edit
transducer (keep, rerole, delete, insert) and the acceptor of well-formed role sequences `(s?(ua)+)?`. States of the
composition are (row, grammar state); only reached ones are made. The shortest path is found in topological order from
the end over (cost, labels) weights: from one state each label has one successor, so equal costs are decided by the
first label. Kept states are cost vectors less their minimum; there are few, and steps between them are remembered.

Rows are dealt by ranges of (conversation, turn), so one conversation may lie in many parts. Its parts are summed up as
cost matrices between grammar states, those are multiplied from the last part to the first, and each part is then
traced by itself. Only the digest of a whole conversation is sequential: it reads the parts' texts as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.bytes import lean
from tidemark.llm.common import CRC32_LOOKUP, crc32_sql, table

#: Costs of the edits; what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FINE, CUT, BLANK, DUPLICATE = 0, 1, 2, 3  # faults; the last two must go
#: Grammar: before anything, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The role that rerole and insert give in each state, and where they lead.
GIVEN, ONWARD = ["user", "user", "assistant", "user"], [USER, USER, ASSISTANT, USER]
ENDS = (START, ASSISTANT)
NEVER = 1 << 60
#: Characters of repaired text in a piece on its way to the digest.
PIECE = 1 << 20

Vector = tuple[int, ...]


def _inserted(costs: list[int]) -> tuple[Vector, str]:
    """Costs with inserts in front, and the states whose best edit is one ('I', else ' ')."""
    out, labels = costs[:], [" "] * 4
    for state in (USER, ASSISTANT, START, SYSTEM):
        by = INSERT + (costs if state in (USER, ASSISTANT) else out)[ONWARD[state]]
        if by < out[state]:
            out[state], labels[state] = by, "I"
    return tuple(out), "".join(labels)


class Machine:
    """Steps of the composition from the end, remembered by (costs after the row, initial, fault)."""

    def __init__(self) -> None:
        self.known: dict[tuple[Vector, str, int], tuple[Vector, int, list[str]]] = {}

    def step(self, after: Vector, initial: str, fault: int) -> tuple[Vector, int, list[str]]:
        """(costs before the row less their minimum, that minimum, the labels by which each state passes the row)."""
        if (found := self.known.get((after, initial, fault))) is None:
            extra = TRUNCATED if fault == CUT else 0
            costs, labels = [], []
            for state in range(4):
                ways = [(DELETE + after[state], "D")]
                if fault < BLANK:
                    if (to := STEP[state].get(initial)) is not None:
                        ways.append((extra + after[to], "K"))
                    ways.append((REROLE + extra + after[ONWARD[state]], "R"))
                cost, label = min(ways)
                costs.append(min(cost, NEVER)), labels.append(label)
            best, inserts = _inserted(costs)
            # An insert comes first where it costs less, or as much as K or R; it sorts after D.
            least = min(best)
            for state in range(4):
                by = INSERT + best[ONWARD[state]]
                if inserts[state] == "I" or (by == best[state] and labels[state] > "I"):
                    labels[state] = "I" + labels[state]
            found = self.known[after, initial, fault] = (tuple(c if c >= NEVER // 2 else c - least for c in best), least, labels)
        return found

    @staticmethod
    def final() -> tuple[Vector, str]:
        """Costs at the end of a conversation, and the inserts there."""
        return _inserted([0 if s in ENDS else NEVER for s in range(4)])


def backwards(machine: Machine, rows: list[tuple[str, int]], after: Vector) -> tuple[Vector, int, list[list[str]]]:
    """Costs before the rows (initial, fault), what to add to them, and each row's labels by state."""
    total, labels = 0, []
    for initial, fault in reversed(rows):
        after, least, label = machine.step(after, initial, fault)
        total += least
        labels.append(label)
    return after, total, labels[::-1]


def forwards(rows: list[tuple[str, int]], labels: list[list[str]], state: int) -> tuple[list[str], list[int], int]:
    """Each row's edits (inserts first), the state in which they begin, and the state after all."""
    edits, states = [], []
    for (initial, _), label in zip(rows, labels):
        states.append(state)
        own = ""
        while label[state][0] == "I":
            own, state = own + "I", ONWARD[state]
        own += label[state]
        state = state if label[state] == "D" else STEP[state][initial] if label[state] == "K" else ONWARD[state]
        edits.append(own)
    return edits, states, state


def closing(state: int, inserts: str) -> tuple[str, list[str]]:
    """Edits after the last row, and the lines that they add."""
    edits, lines = "", []
    while inserts[state] == "I":
        edits, state = edits + "I", (lines.append(f"{GIVEN[state]}:"), ONWARD[state])[1]
    return edits, lines


def rendered(rows: list[tuple[str, str]], edits: list[str], states: list[int], initials: list[str]) -> Iterator[str]:
    """The repaired lines of rows (role, text)."""
    for (role, text), own, state, initial in zip(rows, edits, states, initials):
        for label in own:
            if label == "I":
                yield f"{GIVEN[state]}:"
            elif label == "K":
                yield f"{role}:{text}"
            elif label == "R":
                yield f"{GIVEN[state]}:{text}"
            if label != "D":
                state = STEP[state][initial] if label == "K" else ONWARD[state]


def damage(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) damaged as op11's contract says: a row in twenty each is dropped, emptied, loses its
    stops, is repeated, or becomes the user's. A null is one space, in the damage's key too."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    new_text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    own = rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), said(role).alias("_role"), said(text).alias("_text"), way.alias("_way")).where("_way <> 0")
    copies = F.explode(F.when(F.col("_way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return own.select(F.col("_conv").alias(conv), F.col("_turn").alias(turn), F.when(F.col("_way") == 4, "user").otherwise(F.col("_role")).alias(role), new_text.alias(text), copies.alias("_copy")).drop("_copy")


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
LEGAL = ("su", "ua", "au")
NOTHING = hashlib.sha256(b"").hexdigest()


class _Part:
    """The rows of one conversation in one range, folded rows laid out, and their counts."""

    def __init__(self, conv: object, part: int, after: list[int] | None, state: int | None) -> None:
        self.conv, self.part, self.after, self.state = conv, part, after, state
        self.rows: list[tuple[str, int]] = []
        self.texts: list[tuple[str, str]] = []
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, role: str, text: str, fault: int, copies: int) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        again = BLANK if fault == BLANK else DUPLICATE
        if self.rows:
            self.counts["illegal"] += self.rows[-1][0] + initial not in LEGAL
        self.counts["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
        for f, n in ((fault, 1), (again, copies - 1)):
            if f != FINE:
                self.counts[{CUT: "truncated", BLANK: "blank", DUPLICATE: "duplicate"}[f]] += n
        self.rows += [(initial, fault)] + [(initial, again)] * (copies - 1)
        self.texts += [(role, text)] + [(role, "")] * (copies - 1)

    def traced(self, machine: Machine, after: Vector, state: int) -> tuple[list[str], list[int], int, int]:
        """Edits, the states before them, the state after all, and the cost from `state`."""
        costs, total, labels = backwards(machine, self.rows, after)
        edits, states, last = forwards(self.rows, labels, state)
        return edits, states, last, total + costs[state]

    def lines(self, edits: list[str], states: list[int]) -> Iterator[str]:
        return rendered(self.texts, edits, states, [i for i, _ in self.rows])


#: Columns that stream through a task, in order; `after` and `state` are null until they are known.
_STREAM = ["conv", "part", "role", "text", "fault", "copies", "after", "state"]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    """Rows (of _STREAM) sorted by conversation and part."""
    now = None
    for b in batches:
        for conv, part, role, text, fault, copies, after, state in zip(*[c.to_pylist() for c in b.columns]):
            if now is None or (now.conv, now.part) != (conv, part):
                if now is not None:
                    yield now
                now = _Part(conv, part, after, state)
            now.add(role, text, fault, copies)
    if now is not None:
        yield now


def _mapped(rows: DataFrame, by: list[str], schema: str, each: Callable[[_Part, Machine], Iterator[tuple]]) -> DataFrame:
    """Rows of _STREAM -> what `each` makes of each part; all rows of a part meet in one task, in order."""
    order = [F.col("conv").asc_nulls_first(), "part", F.col("turn").asc_nulls_first(), "role", "text"]
    kind = "conv {}, ".format(rows.schema["conv"].dataType.simpleString())

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out = Machine(), []
        for part in _parts(batches):
            for row in each(part, machine):
                out.append({"conv": part.conv} | dict(zip(names, row)))
                if len(out) >= 2000 or len(out[-1].get("piece", "")) > PIECE // 2:
                    yield pa.RecordBatch.from_pylist(out, shape)
                    out = []
        yield pa.RecordBatch.from_pylist(out, shape)

    typed = StructType.fromDDL(kind + schema)
    shape, names = to_arrow_schema(typed), typed.names[1:]
    return rows.repartition(*by).sortWithinPartitions(*order).select(*_STREAM).mapInArrow(task, typed)


def _whole(part: _Part, machine: Machine) -> Iterator[tuple]:
    end, inserts = machine.final()
    edits, states, last, cost = part.traced(machine, end, START)
    more, lines = closing(last, inserts)
    text = "\n".join([*part.lines(edits, states), *lines])
    yield *[part.counts[c] for c in COUNTS], cost, "".join(edits) + more, hashlib.sha256(text.encode()).hexdigest()


def _summary(part: _Part, machine: Machine) -> Iterator[tuple]:
    """Counts, the first and last initial, and the cost between each two grammar states."""
    costs = []
    for t in range(4):
        before, total, _ = backwards(machine, part.rows, tuple(0 if s == t else NEVER for s in range(4)))
        costs += [c if c >= NEVER // 2 else c + total for c in before]
    yield part.part, *[part.counts[c] for c in COUNTS], part.rows[0][0], part.rows[-1][0], costs


def _exits(part: _Part, machine: Machine) -> Iterator[tuple]:
    """Where each grammar state leads."""
    yield part.part, [part.traced(machine, tuple(part.after), s)[2] for s in range(4)]


def _pieces(part: _Part, machine: Machine) -> Iterator[tuple]:
    """The part's edits and repaired lines in pieces."""
    edits, states, _, _ = part.traced(machine, tuple(part.after), part.state)
    nth, held, size = 0, [], 0
    for line in part.lines(edits, states):
        held.append(line)
        size += len(line)
        if size > PIECE:
            yield part.part, nth, "\n".join(held), ""
            nth, held, size = nth + 1, [], 0
    yield part.part, nth, "\n".join(held), "".join(edits)


#: Columns of _behind and _entries besides the conversation.
_BEHIND = [("part", pa.int32()), ("after", pa.list_(pa.int64())), *[(c, pa.int64()) for c in (*COUNTS, "cost")]]
_ENTRIES = [("part", pa.int32()), ("state", pa.int32()), ("final", pa.int32())]


def _behind(parts: pa.Table) -> pa.Table:
    """One conversation's summaries -> for each part the costs behind it, less their minimum; and the whole's counts."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["part"])
    after, _ = Machine.final()
    counts = {c: sum(r[c] for r in rows) for c in COUNTS}
    counts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
    total, out = 0, []
    for r in reversed(rows):
        least = min(after)
        after, total = tuple(c if c >= NEVER // 2 else c - least for c in after), total + least
        out.append({"conv": r["conv"], "part": r["part"], "after": list(after)} | counts)
        after = tuple(min(NEVER, *[r["costs"][4 * t + s] + after[t] for t in range(4)]) for s in range(4))
    return pa.Table.from_pylist([x | {"cost": total + after[START]} for x in out], _schema_of(parts, _BEHIND))


def _entries(parts: pa.Table) -> pa.Table:
    """One conversation's exits -> the state in which each part begins, and that after the last (in `final`)."""
    state, out = START, []
    for r in sorted(parts.to_pylist(), key=lambda r: r["part"]):
        out.append({"conv": r["conv"], "part": r["part"], "state": state})
        state = r["exits"][state]
    return pa.Table.from_pylist([x | {"final": state} for x in out], _schema_of(parts, _ENTRIES))


def _schema_of(parts: pa.Table, rest: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([parts.schema.field("conv"), *[pa.field(*x) for x in rest]])


@lean
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (conv, piece, audit, final) in order -> (conv, audit, repaired_sha256): the digest is fed piece by piece."""
    name, sha, audit, final, any_line, begun = None, hashlib.sha256(), [], START, False, False

    def ended() -> pa.RecordBatch:
        more, lines = closing(final, Machine.final()[1])
        if lines:
            sha.update(("\n" * any_line + "\n".join(lines)).encode())
        return pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array(["".join(audit) + more], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv", "audit", "repaired_sha256"])

    for b in batches:
        kind = b.schema.field("conv").type
        for conv, piece, edits, last in zip(*[c.to_pylist() for c in b.columns]):
            if not begun or conv != name:
                if begun:
                    yield ended()
                name, sha, audit, any_line, begun = conv, hashlib.sha256(), [], False, True
            if piece:
                sha.update(("\n" * any_line + piece).encode())
                any_line = True
            audit.append(edits)
            final = last
    if begun:
        yield ended()


def repair(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation of rows: conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit,
    repaired_sha256.

    Rows are taken by turn (nulls first), ties by role and text. A null role or text counts as one space, and rows of a
    null conversation are one conversation. Repeated rows are duplicates; an empty text is blank, an empty role or one
    with another initial than s, u, a has to be changed. gaps counts the whole numbers between the turns that are
    missing. Other columns of rows may have any names. An empty table gives an empty table.

    Equal rows are folded, and what was said earlier is found by an aggregate of first turns, so a task holds a range of
    rows and never a whole large conversation. A conversation's audit, a character an edit, is one value of the result.
    """
    some = r"[^\x20\x09-\x0D]"
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    folded = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *said).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    folded = table(folded.select("*", F.when(F.col("text").rlike(some), F.sha2("text", 256)).alias("digest"), at.alias("at")), "folded")
    again = folded.where("digest is not null").groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("m")).where("m > 1").alias("again")
    f = folded.alias("f")
    joined = f.join(again, F.col("f.conv").eqNullSafe(F.col("again.conv")) & (F.col("f.role") == F.col("again.role")) & (F.col("f.digest") == F.col("again.digest")), "left")
    stops = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(F.col("f.digest").isNull(), BLANK).when(F.col("f.at") > F.col("first"), DUPLICATE).when(stops, FINE).otherwise(CUT)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = joined.select("f.conv", "f.turn", "f.role", "text", "copies", fault.alias("fault")).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = table(ranged, "ranged").withColumns({"after": F.lit(None).cast("array<long>"), "state": F.lit(None).cast("int")})

    ends = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    # Ranges of one conversation follow each other, so two conversations a part at most lie in several.
    spread = table(ends.withColumn("parts", F.count("*").over(Window.partitionBy("conv"))).where("parts > 1").select(F.col("conv").alias("c"), F.col("part").alias("p")), "spread")
    there = ranged["conv"].eqNullSafe(spread["c"]) & (ranged["part"] == spread["p"])
    split = ranged.join(spread, there, "left_semi")
    whole = _mapped(ranged.join(spread, there, "left_anti"), ["conv"], "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", _whole)

    def with_known(known: DataFrame, *names: str) -> DataFrame:
        rest = [c for c in split.columns if c not in names]
        both = split.join(known.select(F.col("conv").alias("c"), F.col("part").alias("p"), *[F.col(n).alias(f"_{n}") for n in names]), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        return both.select(*rest, *[F.col(f"_{n}").alias(n) for n in names])

    kind = "conv {}, ".format(ranged.schema["conv"].dataType.simpleString())
    by_part = ["conv", "part"]
    sums = _mapped(split, by_part, "part int, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>", _summary)
    behind = table(sums.groupBy("conv").applyInArrow(_behind, kind + "part int, after array<long>, blank long, duplicate long, truncated long, illegal long, cost long"), "behind")
    exits = _mapped(with_known(behind, "after"), by_part, "part int, exits array<int>", _exits)
    entries = table(exits.groupBy("conv").applyInArrow(_entries, kind + "part int, state int, final int"), "entries")
    known = behind.alias("b").join(entries.alias("e"), F.col("b.conv").eqNullSafe(F.col("e.conv")) & (F.col("b.part") == F.col("e.part"))).select("b.conv", "b.part", "after", "state", "final")
    pieces = _mapped(with_known(known, "after", "state"), by_part, "part int, nth int, piece string, audit string", _pieces)
    finals = entries.select(F.col("conv").alias("c"), "final").distinct()
    pieces = pieces.join(finals, F.col("conv").eqNullSafe(F.col("c"))).repartition("conv").sortWithinPartitions("conv", "part", "nth").select("conv", "piece", "audit", "final")
    digests = pieces.mapInArrow(_digests, kind + "audit string, repaired_sha256 string")
    counts = behind.groupBy("conv").agg(*[F.first(c).alias(c) for c in (*COUNTS, "cost")])
    long = counts.alias("n").join(digests.alias("d"), F.col("n.conv").eqNullSafe(F.col("d.conv"))).select("n.conv", *COUNTS, "cost", "audit", "repaired_sha256")

    turns = folded.groupBy(F.col("conv").alias("c")).agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("n"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps")
    return whole.union(long).join(turns, F.col("conv").eqNullSafe(F.col("c"))).select(F.col("conv").alias(conv), gaps, *COUNTS, "cost", "audit", "repaired_sha256")


def repair_all(original: DataFrame, rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """repair(rows) with a row for every conversation of `original`; those without rows have zeros and empty texts."""
    found = repair(rows, conv, turn, role, text).withColumnRenamed(conv, "c")
    every = original.select(F.col(conv).alias(conv)).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")}
    return every.join(found, every[conv].eqNullSafe(found["c"]), "left").select(conv, *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


def sql() -> str:
    """DuckDB SQL of op11 over `conversations`: the same shortest path as a recursive query from each last row."""
    inserted = lambda x, given: f"{{'k': {x}.k + {INSERT}, 'a': 'I' || {x}.a, 'r': list_prepend('{given}:', {x}.r)}}"
    kept = lambda to: f"{{'k': e + {to}.k, 'a': 'K' || {to}.a, 'r': list_prepend(role || ':' || text, {to}.r)}}"

    def passed(state: int) -> str:
        """The best way of `state` past the row, inserts apart."""
        keep = " ".join(f"when not gone and i = '{i}' then {kept(f's{to}')}" for i, to in STEP[state].items())
        to = f"s{ONWARD[state]}"
        rerole = f"case when not gone then {{'k': e + {REROLE} + {to}.k, 'a': 'R' || {to}.a, 'r': list_prepend('{GIVEN[state]}:' || text, {to}.r)}} end"
        drop = f"{{'k': {DELETE} + s{state}.k, 'a': 'D' || s{state}.a, 'r': s{state}.r}}"
        return f"list_min(list_filter([{drop}, case {keep} end, {rerole}], lambda x: x is not null)) as n{state}"

    better = lambda a, b: f"list_min([{a}, {b}])"
    blank, space = r"[^\x20\x09-\x0d]", r"[\x20\x09-\x0d]"
    end = lambda k, a, r: f"{{'k': {k}::bigint, 'a': '{a}', 'r': {r}::varchar[]}}"
    name = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    return rf"""
with recursive {CRC32_LOOKUP},
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql(name)} % 20 as way from conversations, lookup),
damaged as (
  select conv_id, turn, case when way = 4 then 'user' else role end as role, case when way = 1 then '' when way = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from raw, range(2) c(copy) where way <> 0 and (copy = 0 or way = 3)
), ordered as (
  select dense_rank() over (order by conv_id) as c, conv_id, turn, role, text, left(role, 1) as i, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn,
    not regexp_matches(text, '{blank}') as is_blank, regexp_matches(text, '[.!?]{space}*$') as stops
  from damaged
), told as (select *, row_number() over (partition by c, role, text order by rn) > 1 as seen from ordered),
faults as (
  select *, is_blank or seen as gone, not is_blank and not seen and not stops as cut, case when not is_blank and not seen and not stops then {TRUNCATED} else 0 end as e,
    lag(i) over (partition by c order by rn) || i as two from told
), counts as (
  select conv_id, c, max(rn) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where is_blank) as blank, count(*) filter (where seen and not is_blank) as duplicate,
    count(*) filter (where cut) as truncated, count(*) filter (where two not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id, c
), best(c, rn, s0, s1, s2, s3) as (
  select c, n + 1, {end(0, '', '[]')}, {end(2 * INSERT, 'II', "['user:', 'assistant:']")}, {end(INSERT, 'I', "['assistant:']")}, {end(0, '', '[]')} from counts
  union all
  select c, rn, {better('n0', inserted('m2', 'user'))}, {better('n1', inserted('m2', 'user'))}, m2, m3 from (
    select c, rn, n0, n1, {better('n2', inserted('n3', 'assistant'))} as m2, {better('n3', inserted('n2', 'user'))} as m3 from (
      select b.c, b.rn - 1 as rn, {', '.join(passed(s) for s in range(4))} from best b join faults f on f.c = b.c and f.rn = b.rn - 1
    )
  )
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(s0.k, 0)::bigint as cost, coalesce(s0.a, '') as audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts n on o.conv_id is not distinct from n.conv_id left join best b on b.c = n.c and b.rn = 1
"""
