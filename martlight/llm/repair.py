"""Repair of conversation structure: cheapest edits that make roles alternate, by Four-Russians tables.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Edits keep a row (0), change its role
(2), delete it (3, the only choice for blank and repeated rows) or insert an empty row (2); a truncated
row that stays costs 1 more. What the rest of a conversation costs at least depends on one of four
states (nothing yet, after s, after u, after a): a vector of four costs. Differences between them are
bounded by the edits' prices, so only a few vectors remain once their minimum is taken off (VECTORS).
For each of them and each block of BLOCK row kinds the vector before the block and the cost that was
taken off are computed once (``Tables``); a conversation is processed from its end, a block per lookup.
Its edits are read off forwards: each block is expanded backwards from the vector after it, which gives
every row's own costs, and at every step the ASCII-least edit that still leads to the minimum is taken.
So the edits are the least string among all cheapest ones.

Rows are dealt out by ranges of (conversation, turn, role, digest), so a conversation that holds a third
of all rows is spread over many tasks, and cut into segments of at most SEGMENT rows or SEGMENT_BYTES.
A conversation that lies inside one task and one segment is repaired there. For the others a segment
hands on what it does to each vector and to each state; these small maps are composed per conversation,
after which every segment knows its own end vector and first state and repairs itself. Only the digest of
such a conversation is taken in one task, as SHA-256 must read its bytes in order: it streams them.

Rows are taken by turn, nulls first; rows of one turn by role, then by digest. Rows that repeat all four
columns repeat each other, so all but the first are duplicates. Nulls in role and text, and in the
damage key, stand for one space; a null conv_id is a conversation of its own. A role whose first letter
is none of s, u and a can only be changed or deleted. ``gaps`` beyond a BIGINT are the largest one.
Only conv_id, turn, role and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlight.llm.common import written

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
START, SYSTEM, USER, REPLY = range(4)
#: The state after a row of the role that each state waits for, and that role.
NEXT = (USER, USER, REPLY, USER)
WANTED = ("user", "user", "assistant", "user")
#: Where a kept row of each initial leads; missing: not allowed there.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, REPLY: USER}, "a": {USER: REPLY}, "o": {}}
#: Row kinds: an initial (o: any other), small if whole and large if truncated; x must go.
KINDS = "suaoSUAOx"
#: Costs of ending in each state: only START and REPLY are legal ends.
END = (0, 4, 2, 0)
BLOCK = 4

#: Rows and text bytes of a segment: bound what a task holds of one conversation.
SEGMENT = 4096
SEGMENT_BYTES = 4 << 20
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
STOPS = ".!?"
LARGEST = 2**63 - 1
#: Results in one Arrow batch.
RESULTS = 500


def before(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs of each state before a row of this kind, given the costs after it."""
    cut, initial = CUT * kind.isupper(), kind.lower()
    costs = []
    for state in range(4):
        choices = [DELETE + after[state]]
        if initial != "x":
            choices.append(REROLE + cut + after[NEXT[state]])
            if state in KEEP[initial]:
                choices.append(cut + after[KEEP[initial][state]])
        costs.append(min(choices))
    for _ in range(2):  # inserts before the row: at most u and a
        costs = [min(c, INSERT + costs[NEXT[state]]) for state, c in enumerate(costs)]
    return tuple(costs)


def steps(kind: str | None, state: int, own: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least edits up to and including one row (None: the end) and the state after it."""
    edits, best = "", own[state]
    while True:
        if kind is None:
            if state in (START, REPLY) and best == 0:
                return edits, state
        elif best == DELETE + after[state]:
            return edits + "D", state
        if best == INSERT + own[NEXT[state]]:
            edits, state = edits + "I", NEXT[state]
            best = own[state]
            continue
        cut, initial = CUT * kind.isupper(), kind.lower()
        if state in KEEP.get(initial, {}) and best == cut + after[KEEP[initial][state]]:
            return edits + "K", KEEP[initial][state]
        return edits + "R", NEXT[state]


class Tables:
    """All reduced vectors, and what one row and one block of BLOCK rows do to each of them."""

    def __init__(self) -> None:
        self.vectors = [END]
        found = {END: 0}
        move: list[list[int]] = []
        cost: list[list[int]] = []
        for vector in self.vectors:  # grows while it is read
            move.append([])
            cost.append([])
            for kind in KINDS:
                raw = before(kind, vector)
                least = min(raw)
                reduced = tuple(c - least for c in raw)
                if reduced not in found:
                    found[reduced] = len(self.vectors)
                    self.vectors.append(reduced)
                move[-1].append(found[reduced])
                cost[-1].append(least)
        # A block's number reads its kinds as digits, the first row's the highest.
        one_move, one_cost = np.array(move), np.array(cost)
        moves, costs, base = one_move, one_cost, len(KINDS)
        for _ in range(BLOCK - 1):
            first, rest = np.divmod(np.arange(base * len(KINDS)), base)
            mid = moves[:, rest]
            costs = costs[:, rest] + one_cost[mid, first]
            moves, base = one_move[mid, first], base * len(KINDS)
        self.one = {k: [(m[j], c[j]) for m, c in zip(move, cost)] for j, k in enumerate(KINDS)}
        self.many_moves, self.many_costs = moves.tolist(), costs.tolist()
        self.traces: dict[tuple[int, int, str], tuple[str, int]] = {}

    def step(self, vector: int, block: str) -> tuple[int, int]:
        """Vector before a block, and the cost taken off."""
        if len(block) == BLOCK:
            number = 0
            for kind in block:
                number = number * len(KINDS) + KINDS.index(kind)
            return self.many_moves[vector][number], self.many_costs[vector][number]
        total = 0
        for kind in reversed(block):
            vector, cost = self.one[kind][vector]
            total += cost
        return vector, total

    def trace(self, vector: int, state: int, block: str) -> tuple[str, int]:
        """Edits of a block and the state after it, by the vector after it and the state before it."""
        key = (vector, state, block)
        if key not in self.traces:
            costs = [self.vectors[vector]]
            for kind in reversed(block):  # every row's own costs, from the end
                costs.append(before(kind, costs[-1]))
            costs.reverse()
            edits, at = "", state
            for k, kind in enumerate(block):
                more, at = steps(kind, at, costs[k], costs[k + 1])
                edits += more
            self.traces[key] = edits, at
        return self.traces[key]

    def backward(self, vector: int, kinds: str) -> tuple[list[tuple[str, int]], int, int]:
        """Blocks with the vector after each, in order; the vector before all; the cost taken off."""
        blocks, total, end = [], 0, len(kinds)
        while end > 0:
            block = kinds[max(0, end - BLOCK) : end]
            blocks.append((block, vector))
            vector, cost = self.step(vector, block)
            total, end = total + cost, end - BLOCK
        blocks.reverse()
        return blocks, vector, total

    def forward(self, blocks: list[tuple[str, int]], state: int) -> tuple[str, int]:
        edits = []
        for block, vector in blocks:
            more, state = self.trace(vector, state, block)
            edits.append(more)
        return "".join(edits), state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """Edits after the last row."""
    return steps(None, state, END, END)[0]


def repair(kinds: str) -> tuple[int, str]:
    """Least cost and least edits of a whole conversation, given its rows' kinds."""
    own = tables()
    blocks, vector, total = own.backward(0, kinds)
    edits, state = own.forward(blocks, START)
    return total + own.vectors[vector][START], edits + closing(state)


def lines(edits: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """Repaired rows as ``role:text``; ``state`` is that before the first edit."""
    out, at = [], 0
    for edit in edits:
        if edit == "I":
            out.append(WANTED[state] + ":")
            state = NEXT[state]
            continue
        if edit == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = KEEP[roles[at][0]][state]
        elif edit == "R":
            out.append(f"{WANTED[state]}:{texts[at]}")
            state = NEXT[state]
        at += 1
    return out


# The rows, their faults and their order.

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated damage, with ``n``: how often the row is there, and
    ``digest``: the SHA-256 of role and text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault, text = F.col("_fault"), F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("_fault"))
    hurt = rows.where(fault != 0).select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    named = F.concat_ws(":", F.length("role").cast("string"), "role", "text")
    return hurt.withColumn("digest", F.unhex(F.sha2(named.cast("binary"), 256)))


def marked(rows: DataFrame) -> DataFrame:
    """The distinct rows, and before each row whose role and text came at an earlier turn a mark without
    text.

    Earlier turns are found on digests alone, and marks are joined to rows by lying next to them. Rows
    that repeat are counted map-side, so a row that is there very often is one row per split.
    """
    slim = rows.select("conv_id", "turn", "role", "digest").distinct()
    seen = slim.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times"))
    seen = seen.where("times > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = slim.join(seen, same).where(F.struct("turn") > F.col("first")).select("conv_id", "turn", "role", "digest")
    once = rows.groupBy("conv_id", "turn", "role", "text", "digest").agg(F.sum("n").alias("n"))
    return once.unionByName(later, allowMissingColumns=True)


class Segment:
    """Consecutive rows of one conversation, in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.size = conv_id, 0
        self.kinds: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_initial: str | None = None
        self.last_initial: str | None = None
        self.low = self.high = None  # first and last turn that is not null
        self.turns = 0

    def full(self) -> bool:
        return len(self.kinds) >= SEGMENT or self.size >= SEGMENT_BYTES

    def add(self, turn, role: str, text: str, duplicate: bool) -> None:
        body, initial = text.rstrip(BLANKS), role[:1]
        kind = initial if initial in ("s", "u", "a") else "o"
        if not body:
            self.blank, kind = self.blank + 1, "x"
        elif duplicate:
            self.duplicate, kind = self.duplicate + 1, "x"
        elif body[-1] not in STOPS:
            self.truncated, kind = self.truncated + 1, kind.upper()
        if self.kinds:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        else:
            self.first_initial = initial
        self.last_initial = initial
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += 1
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text if kind != "x" else "")
        self.size += len(role) + len(self.texts[-1])


COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = ("gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, LARGEST)


def _whole(part: Segment) -> dict:
    """The result of a conversation that is one segment."""
    cost, audit = repair("".join(part.kinds))
    text = "\n".join(lines(audit, START, part.roles, part.texts))
    return {name: getattr(part, name) for name in ("conv_id", *COUNTS)} | {
        "gaps": _gaps(part.low, part.high, part.turns), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    }


def _handed_on(part: Segment, task: int, number: int) -> dict:
    """A segment with its maps: per end vector the vector before it and the cost taken off; per end
    vector and first state the state after it."""
    own, kinds = tables(), "".join(part.kinds)
    moves, costs, exits = [], [], []
    for vector in range(len(own.vectors)):
        blocks, first, total = own.backward(vector, kinds)
        moves.append(first)
        costs.append(total)
        exits.extend(own.forward(blocks, state)[1] for state in range(4))
    names = ("conv_id", *COUNTS, "roles", "texts", "first_initial", "last_initial", "low", "high", "turns")
    return {name: getattr(part, name) for name in names} | {
        "task": task, "number": number, "kinds": kinds, "moves": moves, "costs": costs, "exits": exits,
    }


def _segments(schema: pa.Schema):
    """Streams sorted rows to results and segments; both have the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, first = TaskContext.get().partitionId(), 0, True
        part: Segment | None = None
        alone, mark, out = True, None, []

        def close(last: bool = False) -> Iterator[pa.RecordBatch]:
            # The first and the last conversation of a task may go on in its neighbours.
            nonlocal number, out
            if alone and not first and not last:
                out.append(_whole(part))
            else:
                number += 1
                yield pa.RecordBatch.from_pylist([_handed_on(part, task, number)], schema=schema)
            if out and (last or len(out) >= RESULTS):
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "n")]
            for conv_id, turn, role, text, digest, n in zip(*columns):
                if text is None:
                    mark = (conv_id, turn, digest)
                    continue
                if part is None:
                    part = Segment(conv_id)
                elif conv_id != part.conv_id:
                    yield from close()
                    part, alone, first = Segment(conv_id), True, False
                later = mark == (conv_id, turn, digest)
                for copy in range(n):
                    if part.full():
                        alone = False
                        yield from close()
                        part = Segment(conv_id)
                    part.add(turn, role, text, later or copy > 0)
        if part is not None:
            yield from close(last=True)

    return run


def _composed(rows: pa.Table) -> pa.Table:
    """Per segment of one conversation: its end vector and first state, and the conversation's counts."""
    own = tables()
    parts = sorted(rows.to_pylist(), key=lambda r: (r["task"], r["number"]))
    vector, total = 0, 0
    for part in reversed(parts):
        part["vector"] = vector
        total += part["costs"][vector]
        vector = part["moves"][vector]
    cost, state = total + own.vectors[vector][START], START
    sums = {name: sum(p[name] for p in parts) for name in COUNTS}
    low = high = None
    turns, initial = 0, None
    for k, part in enumerate(parts):
        part["state"] = state
        state = part["exits"][4 * part["vector"] + state]
        sums["illegal"] += k > 0 and initial + part["first_initial"] not in ("su", "ua", "au")
        initial = part["last_initial"]
        if part["low"] is not None:
            turns += part["turns"] - (part["low"] == high)
            low, high = part["low"] if low is None else low, part["high"]
    same = sums | {"cost": cost, "gaps": _gaps(low, high, turns)}
    names = ["task", "number", "vector", "state", "last", *same]
    out = [{n: (p | same).get(n, k == len(parts) - 1) for n in names} for k, p in enumerate(parts)]
    return pa.Table.from_pylist(out, schema=pa.schema([(n, _COMPOSED[n]) for n in names]))


_COMPOSED = {n: pa.int64() for n in ("number", *COUNTS, "cost", "gaps")} | {
    n: pa.int32() for n in ("task", "vector", "state")
} | {"last": pa.bool_()}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired rows of each segment."""
    own = tables()
    for batch in batches:
        edits, texts = [], []
        for row in batch.select(["kinds", "roles", "texts", "vector", "state", "last"]).to_pylist():
            blocks, _, _ = own.backward(row["vector"], row["kinds"])
            found, state = own.forward(blocks, row["state"])
            found += closing(state) if row["last"] else ""
            edits.append(found)
            texts.append("".join(f"\n{line}" for line in lines(found, row["state"], row["roles"], row["texts"])))
        keep = [batch.column(n) for n in batch.schema.names if n not in ("kinds", "roles", "texts", "vector", "state", "last")]
        names = [n for n in batch.schema.names if n not in ("kinds", "roles", "texts", "vector", "state", "last")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(edits, pa.string()), pa.array(texts, pa.string())], names=[*names, "edits", "piece"])


def _digests(schema: pa.Schema):
    """Streams pieces in order, a conversation after another, to one result each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, begun, row = None, [], None, False, None

        def finished() -> pa.RecordBatch:
            result = {n: row[n] for n in ("conv_id", *COUNTS, "cost", "gaps")}
            result |= {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([result], schema=schema)

        for batch in batches:
            for one in batch.to_pylist():
                if row is None or one["conv_id"] != now:
                    if row is not None:
                        yield finished()
                    now, audit, digest, begun = one["conv_id"], [], hashlib.sha256(), False
                row = one
                audit.append(one["edits"])
                piece = one["piece"].encode("utf-8", "surrogatepass")
                # Each line comes with the line break before it; the first one of all has none.
                digest.update(piece if begun else piece[1:])
                begun = begun or bool(piece)
        if row is not None:
            yield finished()

    return run


def _arrow(fields: T.StructType) -> pa.Schema:
    kinds = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(),
        T.ArrayType(T.StringType()): pa.list_(pa.string()), T.ArrayType(T.IntegerType()): pa.list_(pa.int32()),
        T.ArrayType(T.LongType()): pa.list_(pa.int64()),
    }
    return pa.schema([(f.name, kinds[f.dataType]) for f in fields])


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation
    after the stated damage."""
    source = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    if not isinstance(source.schema["conv_id"].dataType, (T.LongType, T.IntegerType, T.StringType)):
        raise TypeError("conv_id must be an integer or a string")
    conv = source.schema["conv_id"]
    longs = T._parse_datatype_string(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    rest = T._parse_datatype_string(
        "task int, number long, kinds string, roles array<string>, texts array<string>, moves array<int>, "
        "costs array<long>, exits array<int>, first_initial string, last_initial string, low long, high long, turns long"
    )
    mixed = T.StructType([conv, *longs.fields, *rest.fields])
    order = ["conv_id", "turn", "role", "digest", F.col("text").isNotNull()]
    ordered = marked(damaged(source)).repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(_segments(_arrow(mixed)), mixed), "segments")

    done = found.where("kinds is null").select("conv_id", *RESULT)
    parts = found.where("kinds is not null")
    maps = parts.select("conv_id", "task", "number", *COUNTS, "moves", "costs", "exits", "first_initial", "last_initial", "low", "high", "turns")
    composed = maps.groupBy("conv_id").applyInArrow(
        _composed, "task int, number long, vector int, state int, last boolean, blank long, duplicate long, "
        "truncated long, illegal long, cost long, gaps long",
    )
    own = parts.select("conv_id", "task", "number", "kinds", "roles", "texts").join(composed, ["task", "number"])
    pieces = own.mapInArrow(_pieces, T.StructType([
        *[f for f in own.schema if f.name not in ("kinds", "roles", "texts", "vector", "state", "last")],
        T.StructField("edits", T.StringType()), T.StructField("piece", T.StringType()),
    ]))
    streamed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "task", "number")
    result = T.StructType([conv, *longs.fields])
    several = streamed.mapInArrow(_digests(_arrow(result)), result)
    repaired = done.unionByName(several).withColumnRenamed("conv_id", "_conv")

    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    ids = source.select("conv_id").distinct()
    return ids.join(repaired, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(n, nothing.get(n, F.lit(0).cast("long"))).alias(n) for n in RESULT]
    )
