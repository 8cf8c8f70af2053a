"""Structure repair of conversations by bidirectional Dijkstra over the edit lattice.

The turns of a conversation should have the roles ``(s?(ua)+)?``: an optional system turn, then user
and assistant in alternation.  A node of the lattice is (turns consumed, state), where the state
tells what the kept roles so far are: nothing, system, user or assistant.  Edges are edits:

* Keep (0) where the role's initial continues the pattern,
* Rerole (3) to the role that continues it,
* Delete (4), the only edit of a blank or duplicate turn,
* Insert (3) of an empty turn of the role that continues the pattern, anywhere;

a truncated turn that is not deleted costs 3 more.  A forward heap and a reverse heap grow towards
each other; labels are (cost, letters), and once the two least costs together exceed the best
meeting, every crossing of that cost is complete and the ASCII-least concatenation of letters is
the audit.  States follow from letters, so no label of a node is a prefix of another of equal cost,
and least prefixes and suffixes make least audits.

Turns are ordered by (turn with nulls first, role, text) through a range partitioning, so a
conversation that holds a third of all rows lies in many partitions.  Each run of a conversation
within a partition is cut into segments of ``SEGMENT`` turns.  A conversation that is one segment
inside one partition is solved at once.  Longer ones get a table of (entry state, exit state) to
(cost, audit) per segment; tables are multiplied in groups of ``FAN`` until one is left, and the
states chosen go back to the segments, which give their repaired turns.  Only the audit, one
character per turn, is ever held whole.

Null roles and texts count as one space, null turns come first and are no gaps, a null conversation
id is a conversation.  Repeated rows are duplicates of the first.  A conversation all of whose rows
are absent (``present_col`` false) has zero figures and an empty audit.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from fieldloom.llm.shared import Batches, stored
from fieldloom.session import sized_broadcast

SEGMENT = 256
SEGMENT_CHARS = 8 << 20
FAN = 64
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {q: STEP[q, NEXT_ROLE[q][0]] for q in STATES}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATION = 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
INK = "[^\\x20\\x09-\\x0D]"
GAPS = " \t\n\x0b\f\r"
Turn = tuple[str, int]  # initial of the role, fault
Node = tuple[int, int]


def _forward(turns: tuple[Turn, ...], node: Node) -> Iterator[tuple[Node, int, str]]:
    i, q = node
    yield (i, NEXT[q]), COST["I"], "I"
    if i == len(turns):
        return
    initial, fault = turns[i]
    yield (i + 1, q), COST["D"], "D"
    if fault in (SOUND, TRUNCATED):
        more = TRUNCATION if fault == TRUNCATED else 0
        yield (i + 1, NEXT[q]), COST["R"] + more, "R"
        if (q, initial) in STEP:
            yield (i + 1, STEP[q, initial]), more, "K"


def _backward(turns: tuple[Turn, ...], node: Node) -> Iterator[tuple[Node, int, str]]:
    i, r = node
    for q in STATES:
        if NEXT[q] == r:
            yield (i, q), COST["I"], "I"
    if i == 0:
        return
    initial, fault = turns[i - 1]
    yield (i - 1, r), COST["D"], "D"
    if fault in (SOUND, TRUNCATED):
        more = TRUNCATION if fault == TRUNCATED else 0
        for q in STATES:
            if NEXT[q] == r:
                yield (i - 1, q), COST["R"] + more, "R"
            if STEP.get((q, initial)) == r:
                yield (i - 1, q), more, "K"


def _no_better(cost: int, letters: str, label: tuple[int, str] | None) -> bool:
    return label is not None and label <= (cost, letters)


def cheapest_edits(turns: tuple[Turn, ...], entry: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, least audit) from state ``entry`` before the turns to one of ``ends`` behind them.

    Nodes of equal cost leave a heap in the order of turns from its origin, so that edges without
    cost are followed before the node they lead to is settled.
    """
    n = len(turns)
    ahead: dict[Node, tuple[int, str]] = {(0, entry): (0, "")}
    behind: dict[Node, tuple[int, str]] = {(n, q): (0, "") for q in ends}
    fore = [(0, 0, "", (0, entry))]
    rear = [(0, 0, "", (n, q)) for q in ends]
    heapq.heapify(rear)
    best = 0 if n == 0 and entry in ends else None
    while fore and rear and (best is None or fore[0][0] + rear[0][0] <= best):
        if fore[0][0] <= rear[0][0]:
            cost, _, letters, node = heapq.heappop(fore)
            if ahead[node] != (cost, letters):
                continue
            for to, price, letter in _forward(turns, node):
                c, text = cost + price, letters + letter
                if not _no_better(c, text, ahead.get(to)):
                    ahead[to] = (c, text)
                    heapq.heappush(fore, (c, to[0], text, to))
                    if to in behind and (best is None or c + behind[to][0] < best):
                        best = c + behind[to][0]
        else:
            cost, _, letters, node = heapq.heappop(rear)
            if behind[node] != (cost, letters):
                continue
            for to, price, letter in _backward(turns, node):
                c, text = cost + price, letter + letters
                if not _no_better(c, text, behind.get(to)):
                    behind[to] = (c, text)
                    heapq.heappush(rear, (c, n - to[0], text, to))
                    if to in ahead and (best is None or c + ahead[to][0] < best):
                        best = c + ahead[to][0]
    if best is None:
        return None
    met = (ahead[v][1] + behind[v][1] for v in ahead.keys() & behind.keys() if ahead[v][0] + behind[v][0] == best)
    return best, min(met)


@lru_cache(1 << 15)
def whole_edits(turns: tuple[Turn, ...]) -> tuple[int, str]:
    """Cheapest edits of a whole conversation; many conversations have the same roles and faults."""
    return cheapest_edits(turns, START, ENDS)


def apply_edits(rows: list[tuple[str, str]], audit: str, entry: int) -> list[tuple[str, str]]:
    """The repaired (role, text) turns of ``rows``."""
    out, at, state = [], 0, entry
    for letter in audit:
        if letter in "RI":
            out.append((NEXT_ROLE[state], rows[at][1] if letter == "R" else ""))
            state = NEXT[state]
        elif letter == "K":
            out.append(rows[at])
            state = STEP[state, rows[at][0][0]]
        at += letter != "I"
    return out


TURNS = "array<struct<role:string,text:string>>"
TABLE = "array<struct<entry:int,exit:int,cost:bigint,audit:string,states:string>>"
FIGURES = ("least bigint, most bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "first string, last string")
_PAIR = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TABLE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()),
                             ("audit", pa.string()), ("states", pa.string())]))
_FIGURES = [(n, pa.string() if n in ("first", "last") else pa.int64()) for n in
            ("least", "most", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last")]


class Segment:
    """Consecutive present turns of one conversation."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.faults: list[int] = []
        self.turns: list[int | None] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        self.faults.append(fault)
        self.turns.append(turn)
        self.chars += len(role) + len(text)

    def shape(self) -> tuple[Turn, ...]:
        return tuple((role[:1] if role[:1] in ("s", "u", "a") else "", f) for (role, _), f in zip(self.rows, self.faults))

    def figures(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [role[:1] for role, _ in self.rows]
        return {
            "least": min(known, default=None), "most": max(known, default=None), "distinct": len(set(known)),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE),
            "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL or len(a) != 1 for a, b in zip(initials, initials[1:])),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
        }

    def table(self) -> list[dict]:
        out = []
        for entry in STATES:
            for exit_ in STATES:
                found = cheapest_edits(self.shape(), entry, (exit_,))
                if found:
                    out.append({"entry": entry, "exit": exit_, "cost": found[0], "audit": found[1], "states": str(entry)})
        return out


def join_figures(a: dict, b: dict) -> dict:
    """Figures of two neighbouring stretches; turns ascend, so only the border turn may be shared."""
    meet = a["most"] is not None and a["most"] == b["least"]
    border = a["last"] is not None and b["first"] is not None
    pair = (a["last"] or "") + (b["first"] or "")
    return {
        "least": b["least"] if a["least"] is None else a["least"], "most": a["most"] if b["most"] is None else b["most"],
        "distinct": a["distinct"] + b["distinct"] - meet,
        **{n: a[n] + b[n] for n in ("blank", "duplicate", "truncated")},
        "illegal": a["illegal"] + b["illegal"] + (border and (pair not in LEGAL or len(a["last"]) != 1)),
        "first": b["first"] if a["first"] is None else a["first"], "last": a["last"] if b["last"] is None else b["last"],
    }


def join_tables(a: list[dict], b: list[dict]) -> list[dict]:
    """Cheapest edits over two neighbouring stretches, ties by the least audit."""
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    for x in a:
        for y in b:
            if x["exit"] != y["entry"]:
                continue
            new = (x["cost"] + y["cost"], x["audit"] + y["audit"], x["states"] + y["states"])
            key = (x["entry"], y["exit"])
            if key not in best or new[:2] < best[key][:2]:
                best[key] = new
    return [{"entry": q, "exit": r, "cost": c, "audit": t, "states": s} for (q, r), (c, t, s) in best.items()]


def _segments(conv_type: DataType, limit: int):
    """mapInArrow function over sorted rows, and its schema."""
    kinds = [("conv", to_arrow_type(conv_type)), ("part", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), *_FIGURES,
             ("cost", pa.int64()), ("audit", pa.string()), ("table", _TABLE), ("turns", _PAIR)]
    arrow = pa.schema(kinds)

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, arrow)

    def told(conv, part: int, seq: int, segment: Segment, whole: bool) -> dict:
        row = {"conv": conv, "part": part, "seq": seq, "whole": whole, **segment.figures()}
        if whole:
            row["cost"], row["audit"] = whole_edits(segment.shape())
            repaired = apply_edits(segment.rows, row["audit"], START)
            row["turns"] = [{"role": r, "text": t} for r, t in repaired]
        else:
            row["table"] = segment.table()
            row["turns"] = [{"role": r, "text": t} for r, t in segment.rows]
        return row

    def run(batches: Batches) -> Batches:
        part, out, size = TaskContext.get().partitionId(), [], 0
        conv, segment, seq, opening, begun, before = None, Segment(), 0, True, False, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "fault", "present")]
            for c, turn, role, text, fault, present in zip(*columns):
                if not begun:
                    conv, begun = c, True
                elif c != conv:
                    out.append(told(conv, part, seq, segment, not opening and seq == 0))
                    size += segment.chars
                    conv, segment, seq, opening = c, Segment(), 0, False
                elif len(segment.rows) >= limit or segment.chars >= SEGMENT_CHARS:
                    out.append(told(conv, part, seq, segment, False))
                    size += segment.chars
                    segment, seq = Segment(), seq + 1
                if present:
                    again = fault != BLANK and (c, turn, role, text) == before  # equal rows are neighbours
                    before = (c, turn, role, text)
                    segment.add(turn, role, text, DUPLICATE if again else fault)
                if len(out) >= 512 or size >= SEGMENT_CHARS:
                    yield pack(out)
                    out, size = [], 0
        if begun:
            out.append(told(conv, part, seq, segment, False))
            yield pack(out)

    ddl = (f"conv {conv_type.simpleString()}, part bigint, seq bigint, whole boolean, {FIGURES}, cost bigint, audit string, "
           f"table {TABLE}, turns {TURNS}")
    return run, ddl


class Repair(NamedTuple):
    """``whole``: one row per conversation solved at once, with its repaired turns.  ``long``: one row
    per other conversation, whose repaired turns are rows of ``chunks``, ordered by (part, seq)."""

    whole: DataFrame
    long: DataFrame
    chunks: DataFrame


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _gaps() -> Column:
    return F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0).cast("long")).alias("gaps")


def _faulty(rows: DataFrame) -> DataFrame:
    """``rows`` with the first fault of every turn, as far as it does not depend on an equal row."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    ink = F.col("text").rlike(INK)
    keyed = rows.withColumns({"d1": F.xxhash64("conv", "role", "text"), "d2": F.xxhash64(F.lit(1), "conv", "role", "text")})
    seen = keyed.where(F.col("present") & ink).groupBy("d1", "d2").agg(F.min(order).alias("from"), F.max(order).alias("to"))
    seen = stored(seen.where("from < to").select("d1", "d2", "from"))
    keyed = keyed.join(sized_broadcast(seen, seen.count(), 40), ["d1", "d2"], "left")
    last = F.right(F.rtrim("text", F.lit(GAPS)), F.lit(1))
    fault = (F.when(~ink, BLANK).when(F.col("from") < order, DUPLICATE)
             .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))
    return keyed.select("conv", "turn", "role", "text", "present", fault.alias("fault"))


def _multiplied(tables: DataFrame, conv: DataType, fan: int) -> DataFrame:
    """One row per conversation from its ordered tables, ``fan`` neighbours at a time."""
    ddl = f"conv {conv.simpleString()}, part bigint, seq bigint, {FIGURES}, table {TABLE}"
    arrow = pa.schema([("conv", to_arrow_type(conv)), ("part", pa.int64()), ("seq", pa.int64()), *_FIGURES, ("table", _TABLE)])
    names = [n for n, _ in _FIGURES]

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
        figures, table = {n: rows[0][n] for n in names}, rows[0]["table"]
        for row in rows[1:]:
            figures, table = join_figures(figures, row), join_tables(table, row["table"])
        part, seq = key[1].as_py(), key[2].as_py()
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "part": part, "seq": seq, **figures, "table": table}], arrow)

    rows = tables.select("conv", "part", "seq", *names, "table")
    top = rows.agg(F.max("part"), F.max("seq")).first()
    for column, most in (("seq", top[1]), ("part", top[0])):
        while most:
            rows = rows.withColumn(column, F.expr(f"{column} DIV {fan}"))
            rows = stored(rows.groupBy("conv", "part", "seq").applyInArrow(merge, ddl))
            most //= fan
    return rows


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", present_col: str | None = None, segment: int = SEGMENT, fan: int = FAN) -> Repair:
    """Cheapest repair of every conversation.

    Reports have the conversation id, gaps in the turns, turns by first fault (blank, duplicate,
    truncated), illegal neighbours, cost and audit; repaired turns are arrays of (role, text).
    Rows whose ``present_col`` is false only make sure that their conversation is reported.
    """
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"),
        F.coalesce(F.col(present_col), F.lit(True)).alias("present") if present_col else F.lit(True).alias("present"))
    conv = rows.schema["conv"].dataType
    # Bounds by the head of a text are bounds by the text; equal rows stay together.
    ordered = _faulty(rows).repartitionByRange("conv", "turn", "role", F.left("text", F.lit(16)))
    ordered = ordered.sortWithinPartitions("conv", "turn", "role", "text")
    run, ddl = _segments(conv, segment)
    cut = stored(ordered.select("conv", "turn", "role", "text", "fault", "present").mapInArrow(run, ddl))
    named = F.col("conv").alias(conv_col)
    whole = cut.where("whole").select(named, _gaps(), *REPORT[1:], "turns")

    open_ = cut.where(~F.col("whole"))
    merged = _multiplied(open_, conv, fan)
    best = F.expr(f"array_min(transform(filter(table, t -> t.entry = {START} AND t.exit IN {ENDS}), "
                  "t -> struct(t.cost AS cost, t.audit AS audit, t.states AS states, t.exit AS exit)))")
    solved = stored(merged.withColumn("best", best).select("conv", *[n for n, _ in _FIGURES], "best.*"))
    long = solved.select(named, _gaps(), *REPORT[1:])

    # The states chosen, back to the segments: (conv, place) to the states before and behind it.
    pairs = solved.select("conv", "exit", "states", F.explode(F.expr("sequence(1, length(states))")).alias("place"))
    pairs = pairs.select("conv", "place", F.expr("int(substring(states, place, 1))").alias("entry"), F.expr(
        "int(if(place = length(states), string(exit), substring(states, place + 1, 1)))").alias("exit"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("part", "seq"))
    places = open_.select("conv", "part", "seq").withColumn("place", place)
    chosen = places.alias("p").join(pairs.alias("c"), F.expr("p.conv <=> c.conv AND p.place = c.place"))
    chosen = chosen.select("p.conv", "p.part", "p.seq", "c.entry", "c.exit")
    chosen = stored(chosen)
    few = sized_broadcast(chosen, chosen.count(), 64)
    joined = open_.alias("o").join(few.alias("c"), F.expr("o.part = c.part AND o.seq = c.seq AND o.conv <=> c.conv"))
    joined = joined.select("o.conv", "o.part", "o.seq", "c.entry", "o.turns", F.expr(
        "filter(o.table, t -> t.entry = c.entry AND t.exit = c.exit)[0].audit").alias("audit"))

    arrow = pa.schema([("conv", to_arrow_type(conv)), ("part", pa.int64()), ("seq", pa.int64()), ("turns", _PAIR)])

    def mend(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                turns = apply_edits([(t["role"], t["text"]) for t in row["turns"]], row["audit"], row["entry"])
                row["turns"] = [{"role": r, "text": t} for r, t in turns]
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in arrow.names}], arrow)

    chunks = joined.mapInArrow(mend, f"conv {conv.simpleString()}, part bigint, seq bigint, turns {TURNS}")
    return Repair(whole, long, chunks.withColumnRenamed("conv", conv_col))


def digests(chunks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, repaired_sha256) of the ``role:text`` lines of chunked conversations.

    A digest is sequential by nature: the chunks of one conversation pass through one task in
    order, one chunk in memory at a time.
    """
    kind = chunks.schema[conv_col].dataType
    arrow = pa.schema([("conv", to_arrow_type(kind)), ("repaired_sha256", pa.string())])

    def run(batches: Batches) -> Batches:
        flow = ((conv, turns) for batch in batches
                for conv, turns in zip(batch.column("conv").to_pylist(), batch.column("turns")))
        for conv, group in groupby(flow, key=lambda x: x[0]):
            state, first = hashlib.sha256(), True
            for _, turns in group:
                for turn in turns.as_py():
                    state.update(f"{'' if first else chr(10)}{turn['role']}:{turn['text']}".encode())
                    first = False
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": state.hexdigest()}], arrow)

    rows = chunks.select(F.col(conv_col).alias("conv"), "part", "seq", "turns")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "turns")
    return rows.mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string").withColumnRenamed("conv", conv_col)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with rows dropped (``present`` false), emptied, stripped
    of sentence ends, repeated, or given to the user, by the digest of conversation and turn."""
    space = F.lit(" ")
    told = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(told[0], F.lit(":"), told[1])) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"),
                       copies.alias("copy")).drop("copy")
