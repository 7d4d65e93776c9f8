"""Conversation structure repair: the lightest derivation of a legal conversation, by Knuth's agenda.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Axioms are the start item and the edits that a row
offers (keep, change of role, deletion), each with a weight; an item ``(i, state)`` says that the first ``i`` rows are dealt with and
what may follow. A hyperedge takes an item and an edit of row ``i`` to an item of row ``i + 1``; inserting a turn leads from an item
to another of the same row. A weight is ``(cost, audit)``, the audit being the edits' initials so far: costs add, audits are
joined, and the lesser pair wins. That function is superior: its value is never below its arguments'. It is also monotone: of
two derivations of one item with equal cost neither audit begins with the other, as that would only add insertions, which
cost. So an item popped from the agenda is final, and the search ends with the goal.

Conversations of up to ``LIMIT`` rows are sorted and solved whole, streaming through a task. Longer ones are placed by range
partitions; each block of rows gives the lightest derivation from every state to every state, and only these tables go, block after
block, through one task. A digest over a long conversation's text streams too and never holds it.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACES, small, written

#: Rows up to which a conversation is solved whole, and rows of a block of a longer one.
LIMIT, BLOCK = 1024, 512
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
CUT_COST = 1  # a truncated row that stays
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. ``STEP[state][initial]``: the next one.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
FAULTS = ("", "blank", "duplicate", "truncated")
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string"

Weight = tuple[int, str]


def edits(initial: str, fault: int) -> list[tuple[str, str, int]]:
    """What a row offers: (letter, initial that it leaves, cost). ``fault``: a number of ``FAULTS``."""
    if fault in (1, 2):
        return [(DELETE, "", COST[DELETE])]
    extra = CUT_COST if fault == 3 else 0
    kept = [(KEEP, initial, COST[KEEP] + extra)] if initial in "sua" and initial else []
    return [*kept, *((REROLE, r, COST[REROLE] + extra) for r in "ua"), (DELETE, "", COST[DELETE])]


def lightest(rows: list[tuple[str, int]], start: int = 0, goal: tuple[int, ...] | None = FINAL) -> dict[int, Weight]:
    """Weights of the states after all ``rows`` (initial, fault), from ``start``. With a ``goal``, only of the lightest of its states."""
    n = len(rows)
    best: dict[tuple[int, int], Weight] = {(0, start): (0, "")}
    agenda: list[tuple[Weight, tuple[int, int]]] = [((0, ""), (0, start))]
    offers = [edits(*r) for r in rows]
    done: dict[int, Weight] = {}
    final: set[tuple[int, int]] = set()
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final.add(item)
        i, state = item
        if i == n:
            done[state] = weight
            if goal is not None and state in goal:
                return {state: weight}
        steps = STEP[state]
        reached = [((i, steps[r]), INSERT, COST[INSERT]) for r in "ua" if r in steps]
        if i < n:
            for letter, initial, cost in offers[i]:
                if not initial:
                    reached.append(((i + 1, state), letter, cost))
                elif initial in steps:
                    reached.append(((i + 1, steps[initial]), letter, cost))
        for to, letter, cost in reached:
            if to not in final:
                found = (weight[0] + cost, weight[1] + letter)
                if to not in best or found < best[to]:
                    best[to] = found
                    heapq.heappush(agenda, (found, to))
    return done


def applied(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The turns that ``audit`` makes of ``rows`` (role, text): inserted ones have no text."""
    source, due = iter(rows), "user"
    for letter in audit:
        role, text = ("", "") if letter == INSERT else next(source)
        if letter == DELETE:
            continue
        if letter != KEEP:
            role = due
        yield role, text
        due = "assistant" if role[:1] == "u" else "user"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``gone``: rows with planted faults, chosen by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it stays as a mark of its conversation, with ``gone``), 1 empties its text, 2 takes away its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls
    count as one space.
    """
    def held(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), held("role").alias("role"), held("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def plain(conversations: DataFrame) -> DataFrame:
    """The columns of ``damage`` from rows as they are."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, F.lit(False).alias("gone"))


def _looked_at(rows: DataFrame) -> DataFrame:
    bare = F.rtrim("text", F.lit(SPACES))
    return rows.select(
        "conv_id", "turn", "role", "text", "gone",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")).alias("key"),
        F.when(F.length(bare) == 0, 1).when(F.instr(F.lit(".!?"), F.right(bare, F.lit(1))) == 0, 3).otherwise(0).alias("fault"),
    )


ORDER = ("turn", "role", "key")


class _Case:
    """What is known of a conversation's rows so far, in order; ``rows`` and ``turns`` only as far as the caller keeps them."""

    def __init__(self):
        self.faults, self.illegal, self.distinct = [0, 0, 0, 0], 0, 0
        self.first = self.last = None  # turns
        self.initials = ["", ""]  # of the first and the last row
        self.any = False

    def row(self, turn, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.any and self.initials[1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if not self.any:
            self.initials[0] = initial
        self.initials[1], self.any = initial, True
        if turn is not None:
            self.distinct += turn != self.last or self.first is None
            self.first = turn if self.first is None else self.first
            self.last = turn

    def then(self, other: _Case) -> None:
        """Takes in what follows."""
        if not other.any:
            return
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]
        self.illegal += other.illegal + (self.any and self.initials[1] + other.initials[0] not in ("su", "ua", "au"))
        self.distinct += other.distinct - (self.first is not None and other.first == self.last)
        self.initials = [self.initials[0] if self.any else other.initials[0], other.initials[1]]
        if other.first is not None:
            self.first, self.last = (other.first if self.first is None else self.first), other.last
        self.any = True

    def counts(self) -> list[int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return [gaps, *self.faults[1:], self.illegal]


def _digest(turns: Iterable[tuple[str, str]]) -> str:
    out = hashlib.sha256()
    for k, (role, text) in enumerate(turns):
        out.update(f"{chr(10) if k else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
    return out.hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _solver(turns: bool):
    """Whole conversations that arrive sorted: a row of ``SUMMARY`` each, or their repaired turns."""
    schema = _arrow(TURNS if turns else SUMMARY)

    def solved(conv, rows: list[tuple], case: _Case) -> Iterator[tuple]:
        ((cost, audit),) = lightest([(r[0][:1], r[2]) for r in rows]).values()
        made = applied(((role, text) for role, text, _ in rows), audit)
        if turns:
            yield from ((conv, k, role, text) for k, (role, text) in enumerate(made))
        else:
            yield (conv, *case.counts(), cost, audit, _digest(made))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, open_, rows, case, seen = None, False, [], _Case(), set()
        for c, turn, role, text, gone, fault in _rows(batches):
            if open_ and c != conv:
                yield from solved(conv, rows, case)
                rows, case, seen = [], _Case(), set()
            conv, open_ = c, True
            if gone:
                continue
            fault = 1 if fault == 1 else 2 if (role, text) in seen else fault
            seen.add((role, text))
            case.row(turn, role[:1], fault)
            rows.append((role, text, fault))
        if open_:
            yield from solved(conv, rows, case)

    return lambda batches: _out(each(batches), schema)


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """The summary and the lightest derivations between all states of one block of a long conversation."""
    rows = rows.sort_values("at")
    case, given = _Case(), []
    for turn, initial, fault in zip(rows["turn"], rows["initial"], rows["fault"], strict=True):
        case.row(None if pd.isna(turn) else int(turn), initial, int(fault))
        given.append((initial, int(fault)))
    table = [lightest(given, start, None) for start in range(len(STEP))]
    conv = rows["conv_id"].iloc[0]
    return pd.DataFrame({"conv_id": pd.array([None if pd.isna(conv) else int(conv)], "Int64"), "at": [int(rows["at"].iloc[0])], "held": [pickle.dumps((vars(case), table))]})


class _Rope:
    """An audit made of the audits of blocks; those of several states share what they have in common."""

    __slots__ = ("before", "piece")

    def __init__(self, before: _Rope | None, piece: str):
        self.before, self.piece = before, piece

    def pieces(self, until: _Rope | None = None) -> str:
        held, at = [], self
        while at is not until and at is not None:
            held.append(at.piece)
            at = at.before
        return "".join(reversed(held))


def _lesser(a: tuple[int, _Rope], b: tuple[int, _Rope]) -> tuple[int, _Rope]:
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    x, y = a[1], b[1]
    while x is not y and x is not None and y is not None:
        x, y = x.before, y.before
    return a if a[1].pieces(x) <= b[1].pieces(y) else b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of long conversations in order: a conversation's counts, cost and audit."""

    def closed(conv, case: _Case, best: dict) -> tuple:
        goal = None
        for state in FINAL:
            if state in best:
                goal = best[state] if goal is None else _lesser(goal, best[state])
        return (conv, *case.counts(), goal[0], goal[1].pieces())

    def each() -> Iterator[tuple]:
        conv, case, best = None, None, {}
        for c, _, held in _rows(batches):
            if case is None or c != conv:
                if case is not None:
                    yield closed(conv, case, best)
                conv, case, best = c, _Case(), {0: (0, _Rope(None, ""))}
            seen, table = pickle.loads(held)
            other = _Case()
            vars(other).update(seen)
            case.then(other)
            after: dict = {}
            for state, (cost, rope) in best.items():
                for to, (more, audit) in table[state].items():
                    found = (cost + more, _Rope(rope, audit))
                    after[to] = found if to not in after else _lesser(after[to], found)
            best = after
        if case is not None:
            yield closed(conv, case, best)

    return _out(each(), _arrow(LONG), 20)


LONG = SUMMARY.rsplit(", ", 1)[0]


def _reader(turns: bool):
    """Rows of long conversations in order, each conversation's audit before them: digests, or repaired turns."""
    schema = _arrow(TURNS if turns else "conv_id long, repaired_sha256 string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = _rows(batches)
        held = next(rows, None)
        while held is not None:
            conv, _, _, _, audit = held
            ahead: list = [None]

            def own(conv=conv, ahead=ahead) -> Iterator[tuple[str, str]]:
                for row in rows:
                    if row[1] < 0:
                        ahead[0] = row
                        return
                    yield row[2], row[3]

            source = own()
            made = applied(source, audit)
            if turns:
                yield from ((conv, k, role, text) for k, (role, text) in enumerate(made))
            else:
                yield conv, _digest(made)
            for _ in source:  # to the next conversation
                pass
            held = ahead[0]

    return lambda batches: _out(each(batches), schema)


def _long(rows: DataFrame, block: int, turns: bool) -> DataFrame:
    order = [F.col("conv_id"), *[F.col(c).asc_nulls_first() for c in ORDER]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are told apart by where they were read, so that even these spread over partitions.
    live = rows.filter("NOT gone").withColumn("read_at", F.monotonically_increasing_id())
    live = live.repartitionByRange(parts, *order, F.col("read_at")).sortWithinPartitions(*order, "read_at")
    live = written(live.withColumn("at", F.monotonically_increasing_id()).drop("read_at", "gone"), "long_chats")
    again = live.groupBy("conv_id", "key").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first_at")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    narrow = live.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "key", "fault", "at")
    seen = narrow.join(small(written(again, "long_again")), on, "left")
    fault = F.when(F.col("fault") == 1, 1).when(F.col("at") > F.col("first_at"), 2).otherwise(F.col("fault"))
    part = F.shiftright("at", 33)
    group = [part.alias("part"), F.floor((F.col("at") - F.shiftleft(part, 33)) / block).alias("block")]
    faulty = seen.select("conv_id", "turn", "initial", fault.alias("fault"), "at", *group)
    blocks = faulty.groupBy("conv_id", "part", "block").applyInPandas(_block, "conv_id long, at long, held binary")
    ends = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_joined, LONG)
    ends = written(ends, "long_audits")
    first = ends.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    texts = live.select("conv_id", "at", "role", "text", F.lit("").alias("audit")).unionByName(first)
    read = texts.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    if turns:
        return read.mapInArrow(_reader(True), TURNS)
    digests = read.mapInArrow(_reader(False), "c long, repaired_sha256 string")
    out = ends.join(small(written(digests, "long_digests")), F.col("conv_id").eqNullSafe(F.col("c")))
    # A conversation of which no row is left has no block.
    none = written(rows.groupBy("conv_id").agg(F.bool_and("gone").alias("none")).filter("none"), "long_gone")
    empty = hashlib.sha256(b"").hexdigest()
    zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = none.select("conv_id", *zeros, F.lit("").alias("audit"), F.lit(empty).alias("repaired_sha256"))
    return out.drop("c").unionByName(none)


def _repaired(rows: DataFrame, turns: bool, limit: int, block: int) -> DataFrame:
    """Counting reads the ids alone; rows are told apart by one join with the ids of long conversations, if there are any."""
    long_ids = written(rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(F.col("conv_id").alias("c")), "long_ids")
    any_long, rows = bool(long_ids.take(1)), _looked_at(rows)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = rows.join(small(long_ids), same, "left_anti") if any_long else rows
    order = [F.col("conv_id"), *[F.col(c).asc_nulls_first() for c in ORDER]]
    short = short.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "fault")
    out = short.mapInArrow(_solver(turns), TURNS if turns else SUMMARY)
    return out.unionByName(_long(rows.join(small(long_ids), same, "left_semi"), block, turns)) if any_long else out


def summaries(rows: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """A row of ``SUMMARY`` for each conversation of ``rows`` (see ``damage`` and ``plain``), null ids being one conversation.

    A row's first fault counts: blank, duplicate (role and text stood earlier in the conversation), truncated. Rows of one turn are
    ordered by role and by the MD5 of role and text, null turns first. Without rows everything is zero or empty.
    """
    return _repaired(rows, False, limit, block)


def repaired_turns(rows: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """The turns of every repaired conversation: ``conv_id``, ``place`` from 0, ``role``, ``text`` (empty where one was put in)."""
    return _repaired(rows, True, limit, block)
