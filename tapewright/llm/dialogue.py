"""Repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation is empty, or an optional system turn and then pairs of
user and assistant: an automaton of four states (start, after system, after
user, after assistant).  A row is kept, gets another role, or is deleted, and
empty rows may be inserted; the cheapest edits are sought, and of equally cheap
ones those whose initials (D, I, K, R) come first.

Rows are sorted once by Spark, by ranges of (conversation, turn), so that one
conversation may lie in many partitions, and cut into pieces of a bounded
number of rows.  A piece is a short string of codes, one for each row.  Within a piece
forward cost vectors from the left state and backward cost vectors from the
right state meet in the middle; the crossing of least cost is taken (of equals
the one whose edits so far come first), and both halves are solved alike, so
only two vectors of four costs are held.  Where a conversation has several
pieces, each first gives its costs from any state to any other, and the same
meeting in the middle over these finds the states at its borders.

To tell which of two equally cheap ways comes first, each state at a border
carries a place among the four.  Ways to a border are compared right after a
row's own edit, so none is the beginning of another, and what follows cannot
change their order.

Edge cases: null ids, turns, roles and texts: see damaged(); rows of one turn
follow each other by role and then by the MD5 of their text; equal rows are
duplicates of the first; roles other than system, user and assistant must be
changed or deleted; the initial of a role is what counts; conversations without
rows have no edits and an empty digest; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import bounded_batches, map_batches, settle

#: Rows of a conversation in a piece: 2**PIECE at most.
PIECE = 12
FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: By state, where a role leads; and the role that an inserted or changed row has there.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@cache
def moves(code: str, costs: Costs) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """By state before, the ways over a row: (state after, cost, edits), the cheapest and first for each state after.

    code: s, u, a or o (another role); in capitals if truncated; x must be deleted.
    """
    out = []
    for begin in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(state: int, cost: int, edits: str) -> None:
            best[state] = min(best.get(state, (FAR, "")), (cost, edits))

        state, paid, edits = begin, 0, ""
        for _ in range(3):  # more insertions lead round in a circle
            offer(state, paid + costs.delete, edits + "D")
            if code != "x":
                extra = costs.truncated if code.isupper() else 0
                if code.lower() in NEXT[state]:
                    offer(NEXT[state][code.lower()], paid + extra, edits + "K")
                offer(NEXT[state][MADE[state]], paid + extra + costs.rerole, edits + "R")
            state, paid, edits = NEXT[state][MADE[state]], paid + costs.insert, edits + "I"
        out.append(tuple((s, c, e) for s, (c, e) in sorted(best.items())))
    return tuple(out)


def finish(state: int) -> str:
    """The insertions that end a conversation after its last row."""
    edits = ""
    while state not in ENDS:
        state, edits = NEXT[state][MADE[state]], edits + "I"
    return edits


Vector = list[tuple[int, int]]  # by state: cost, place among the ways to all states


def ranked(ways: dict[int, tuple[int, tuple]]) -> Vector:
    """ways: by state its cost and what orders its edits among those of the others."""
    order = {s: i for i, (s, _) in enumerate(sorted(ways.items(), key=lambda x: x[1][1]))}
    return [(ways[s][0], order[s]) if s in ways else (FAR, 9) for s in range(4)]


def forward(codes: str, start: Vector, costs: Costs) -> Vector:
    now = start
    for code in codes:
        table, ways = moves(code, costs), {}
        for state in range(4):
            paid, place = now[state]
            if paid < FAR:
                for to, cost, edits in table[state]:
                    way = (paid + cost, (place, edits))
                    if to not in ways or way < ways[to]:
                        ways[to] = way
        now = ranked(ways)
    return now


def backward(codes: str, end: list[int], costs: Costs) -> list[int]:
    now = end
    for code in reversed(codes):
        now = [min((cost + now[to] for to, cost, _ in ways), default=FAR) for ways in moves(code, costs)]
    return now


def only(state: int) -> Vector:
    return [(0, 0) if s == state else (FAR, 9) for s in range(4)]


def crossing(ahead: Vector, behind: list[int]) -> int:
    """The state where the halves meet: least cost, then the edits that come first."""
    return min((ahead[s][0] + behind[s], ahead[s][1], s) for s in range(4) if ahead[s][0] < FAR)[2]


def solve(codes: str, begin: int, end: int, costs: Costs) -> Iterator[tuple[int, str]]:
    """For each row the state before it and its edits (insertions in front, then its own), on the best way from begin to end."""
    if len(codes) == 1:
        yield begin, next(edits for to, _, edits in moves(codes, costs)[begin] if to == end)
    elif codes:
        half = len(codes) // 2
        goal = [0 if s == end else FAR for s in range(4)]
        meet = crossing(forward(codes[:half], only(begin), costs), backward(codes[half:], goal, costs))
        yield from solve(codes[:half], begin, meet, costs)
        yield from solve(codes[half:], meet, end, costs)


def tail_costs(costs: Costs) -> list[int]:
    return [costs.insert * len(finish(s)) for s in range(4)]


def borders(pieces: list[tuple[list[int], list[int]]], costs: Costs) -> list[int]:
    """States before the first piece and after each; a piece is its 16 costs and 16 places, by state before and state after."""

    def over(now: Vector, piece: tuple[list[int], list[int]]) -> Vector:
        ways: dict[int, tuple] = {}
        for s in range(4):
            for to in range(4):
                paid, cost = now[s][0], piece[0][4 * s + to]
                if paid < FAR and cost < FAR:
                    way = (paid + cost, (now[s][1], piece[1][4 * s + to]))
                    if to not in ways or way < ways[to]:
                        ways[to] = way
        return ranked(ways)

    def meet(part: list, begin: int, end: list[int]) -> list[int]:
        """States after each piece of the part."""
        if len(part) == 1:
            return [crossing(over(only(begin), part[0]), end)]
        half = len(part) // 2
        ahead, behind = only(begin), end
        for piece in part[:half]:
            ahead = over(ahead, piece)
        for piece in reversed(part[half:]):
            behind = [min(piece[0][4 * s + to] + behind[to] for to in range(4)) for s in range(4)]
        state = crossing(ahead, behind)
        goal = [0 if s == state else FAR for s in range(4)]
        return meet(part[:half], begin, goal) + meet(part[half:], state, end)

    return [START, *meet(pieces, START, tail_costs(costs))]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by crc32("conv_id:turn") % 20; nulls count as one space there and in role and text.

    0 drops a row (it stays here with gone = true), 1 empties its text, 2 takes
    `.!?` out, 3 repeats it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).cast("int")
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(shown("role"))
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """rows in the order of (conversation, turn) with seq, ascending in that order, code and fault."""
    rows = rows.withColumn("md5", F.md5(F.col("text").cast("binary")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "md5"]
    # Ranges rise from partition to partition, and so do these ids.
    rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "rows")
    first = rows.filter("not gone").groupBy("conv_id", "role", "md5").agg(F.count("*").alias("n"), F.min("seq").alias("first")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("conv"), F.col("role").alias("said_by"), F.col("md5").alias("said"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("said_by")) & (F.col("md5") == F.col("said"))
    marked = rows.join(first, same, "left").drop("conv", "said_by", "said", "md5")
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", "blank").when(F.col("seq") > F.col("first"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return settle(marked.withColumn("fault", fault).withColumn("code", code).drop("first"), "marked")


def _edits(marked: DataFrame, costs: Costs) -> DataFrame:
    """(seq, edits, made): the edits at each row (insertions before it, its own, those after the last row), and the roles they give."""
    there = marked.filter("not gone").withColumn("piece", F.shiftright("seq", PIECE))
    rows = F.sort_array(F.collect_list(F.struct("seq", "code")))
    pieces = there.groupBy("conv_id", "piece").agg(rows.alias("rows"))  # 2**PIECE rows at most
    pieces = settle(pieces.select("conv_id", "piece", F.col("rows.seq").alias("seqs"), F.array_join("rows.code", "").alias("codes")), "pieces")
    count = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("conv"))
    long = pieces.join(count, F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi").select("conv_id", "piece", "codes")

    def measured(batch: pa.RecordBatch):
        for part in _few(batch):
            out: dict[str, list] = {"cost": [], "place": []}
            for codes in part.column("codes").to_pylist():
                ways = [forward(codes, only(s), costs) for s in range(4)]
                out["cost"].append([c for w in ways for c, _ in w]), out["place"].append([p for w in ways for _, p in w])
            yield {"conv_id": part.column("conv_id"), "piece": part.column("piece")} | out

    kind = pieces.schema["conv_id"]
    measures = map_batches(long, measured, T.StructType([kind, T.StructField("piece", T.LongType()), T.StructField("cost", T.ArrayType(T.LongType())), T.StructField("place", T.ArrayType(T.LongType()))]))

    def joined(table: pa.Table) -> pa.Table:
        """Of one conversation: a row of 32 numbers for each 2**PIECE rows."""
        table = table.sort_by("piece")
        states = borders(list(zip(table["cost"].to_pylist(), table["place"].to_pylist())), costs)
        last = [False] * (len(states) - 2) + [True]
        return pa.table({"piece": table["piece"], "conv_id": table["conv_id"], "before": pa.array(states[:-1], pa.int32()), "after": pa.array(states[1:], pa.int32()), "last": last})

    known = measures.groupBy("conv_id").applyInArrow(joined, T.StructType([T.StructField("piece", T.LongType()), kind, *(T.StructField(c, T.IntegerType()) for c in ("before", "after")), T.StructField("last", T.BooleanType())]))
    known = known.select(F.col("conv_id").alias("conv"), F.col("piece").alias("of"), "before", "after", "last")
    placed = pieces.join(known, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("piece") == F.col("of")), "left").select("seqs", "codes", "before", "after", "last")

    def solved(batch: pa.RecordBatch):
        for part in _few(batch):
            out: dict[str, list] = {"seq": [], "edits": [], "made": []}
            for seqs, codes, before, after, last in zip(*(part.column(c).to_pylist() for c in range(5))):
                if before is None:  # the whole conversation
                    before, last = START, True
                    after = crossing(forward(codes, only(before), costs), tail_costs(costs))
                out["seq"] += seqs
                for i, (state, edits) in enumerate(solve(codes, before, after, costs)):
                    if last and i == len(codes) - 1:
                        edits += finish(after)
                    out["edits"].append(edits), out["made"].append(roles_made(edits, codes[i], state))
            yield out

    return map_batches(placed, solved, "seq long, edits string, made string")


def roles_made(edits: str, code: str, state: int) -> str:
    """The initials that edits give, from the state before them."""
    made = ""
    for e in edits:
        if e != "D":
            made += code.lower() if e == "K" else MADE[state]
            state = NEXT[state][made[-1]]
    return made


def _few(batch: pa.RecordBatch, rows: int = 32) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that few pieces are held as Python objects."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def repaired_rows(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """rows (conv_id, turn, role, text, and gone: not there) in order of seq with fault, edits, and made: the initials of the rows that stand afterwards."""
    marked = _sorted_rows(rows)
    return marked.join(_edits(marked, costs).withColumnRenamed("seq", "at"), F.col("seq") == F.col("at"), "left").drop("at")


class _Summary:
    """What is told of one conversation, row by row in order; texts aren't held."""

    def __init__(self, costs: Costs):
        self.costs, self.turns, self.low, self.high, self.turn = costs, 0, None, None, None
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.initial, self.cost, self.audit, self.digest, self.any = 0, None, 0, [], hashlib.sha256(), False

    def add(self, turn, role: str, text: str, fault: str | None, edits: str, made: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.audit.append(edits)
        roles = iter(made)
        for e in edits:
            self.cost += {"K": 0, "R": self.costs.rerole, "D": self.costs.delete, "I": self.costs.insert}[e]
            if e in "KR" and fault == "truncated":
                self.cost += self.costs.truncated
            if e != "D":
                named = ROLES.get(next(roles))
                line = (role if e == "K" else named) + ":" + ("" if e == "I" else text)
                self.digest.update(("\n" * self.any + line).encode())
                self.any = True

    def told(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def repair_summary(repaired: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """For each conversation its gaps in turns, faults, illegal neighbours, cost, audit, and a digest of what stands.

    A digest is one run over the conversation in order, so its rows stream
    through one task, batch by batch; only counts and the audit are held.
    """
    bounded_batches(repaired.sparkSession)
    names = ["conv_id", "turn", "role", "text", "fault", "edits", "made", "gone"]
    rows = repaired.withColumn("turn", F.col("turn").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", "seq").select(*names)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, missing = to_arrow_schema(schema), object()
        key, now = missing, None
        for batch in batches:
            done = []
            for conv, turn, role, text, fault, edits, made, gone in zip(*(c.to_pylist() for c in batch.columns)):
                if key is missing or conv != key:
                    if key is not missing:
                        done.append({"conv_id": key} | now.told())
                    key, now = conv, _Summary(costs)
                if not gone:
                    now.add(turn, role, text, fault, edits, made)
            if done:
                yield pa.RecordBatch.from_pylist(done, target)
        if key is not missing:
            yield pa.RecordBatch.from_pylist([{"conv_id": key} | now.told()], target)

    return rows.mapInArrow(run, schema)
