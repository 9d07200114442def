"""Best-fit packing of token sequences by linear grouping.

1. Every document (its ids and an end id) no longer than the capacity is one piece; a longer one is
   cut into full pieces behind a first piece that takes the remainder.
2. Lengths are integers up to the capacity, so the whole corpus is described by at most ``capacity``
   counts. On these counts the driver plans:
   a. Linear grouping: large pieces, longest first, fall into groups of equal cardinality, and each
      group's lengths are rounded up to its longest.
   b. With these few sizes, configurations (how many of each size share a sequence) are optimised: a
      linear programme over configurations, solved by column generation with an exact knapsack; whole
      multiples are used.
   c. Actual pieces take the rounded places, longest first; what they leave free stays free for later.
   d. Remaining large pieces and then the small ones, longest first, go best-fit: into the sequences
      with the least free space that holds them, or open new ones.
   Sequences that are filled alike are one run in the plan, so it stays as small as the counts.
3. Pieces are ranked within their length (in salted buckets, so that a length which a third of the
   pieces share is many small windows) and look up the run that holds their rank.

Only counts and the plan meet the driver. Null texts count as empty: one end id. Repeated rows are
packed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from martlight.llm.bpe import widened, with_columns
from martlight.llm.codec import counting_codec
from martlight.llm.common import written

CAPACITY = 2048
END_ID = 0
GROUPS = 256
#: Pieces longer than this share of the capacity are grouped; shorter ones are fitted at the end.
LARGE = 1 / 4
SALT = 256


def cut(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counting_codec(vocabulary)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            ids, bounds = own.encode_batch(batch.column(1))
            raw = memoryview(ids.astype("<u4").tobytes())
            sizes = np.diff(bounds) + 1
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (sizes - 1) % capacity + 1
            start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
            length = np.where(number == 0, first[row], capacity)
            begin = bounds[:-1][row] + start
            last = number == pieces[row] - 1
            check = []
            for at, size, ends in zip(begin.tolist(), length.tolist(), last.tolist()):
                crc = zlib.crc32(raw[4 * at : 4 * (at + size - ends)])
                check.append(zlib.crc32(end, crc) if ends else crc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start),
                 pa.array(length), pa.array(check, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, pieces), longest first, in groups of equal cardinality."""
    total = sum(counts.values())
    size, out, room = max(1, -(-total // groups)), [[]], max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            taken = min(left, room)
            out[-1].append((length, taken))
            left, room = left - taken, room - taken
    return [g for g in out if g]


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes that fits, exactly: sizes are over a quarter of the
    capacity, so it has three items at most. Every pair is tried with the best third for its rest."""
    size, value = np.append(sizes, 0), np.append(values, 0.0)
    order = np.lexsort((-value, size))
    best, holder = np.zeros(capacity + 1), np.full(capacity + 1, len(sizes))
    for k in order:
        if value[k] > best[size[k]]:
            best[size[k] :] = np.where(best[size[k] :] < value[k], value[k], best[size[k] :])
            holder[size[k] :] = np.where(best[size[k] :] == value[k], k, holder[size[k] :])
    rest = capacity - size[:, None] - size[None, :]
    worth = np.where(rest >= 0, value[:, None] + value[None, :] + best[np.maximum(rest, 0)], -1.0)
    i, j = np.unravel_index(int(np.argmax(worth)), worth.shape)
    taken = [0] * (len(sizes) + 1)
    for k in (i, j, holder[rest[i, j]]):
        taken[k] += 1
    return float(worth[i, j]), taken[:-1]


def configurations(sizes: np.ndarray, demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations and how often to use each: the optimum of the linear programme, rounded down.

    Revised simplex with column generation: the basis starts with one configuration per size, and the
    knapsack finds the configuration whose places are worth more than a sequence.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    need = np.array(demand, float)
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        worth, column = knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-9:
            break
        use, change = np.linalg.solve(basis, need), np.linalg.solve(basis, np.array(column, float))
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(np.int64)
    return [(basis[:, k].round().astype(int).tolist(), int(use[k])) for k in range(n) if use[k] > 0]


class Plan:
    """Runs of sequences filled alike, and the places (length, rank, sequence, offset, rows) in them."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.places: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = {}
        self.free: dict[int, list[tuple[int, int]]] = {}  # free space: runs (first sequence, sequences)
        self.spaces: list[int] = []  # those that have runs, ascending

    def open(self, rows: int) -> int:
        self.sequences += rows
        return self.sequences - rows

    def put(self, length: int, first: int, rows: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.places.append((length, rank, first, offset, rows))
        self.used[length] = rank + rows

    def leave(self, first: int, rows: int, offset: int) -> None:
        space = self.capacity - offset
        if space:
            if not self.free.get(space):
                insort(self.spaces, space)
            self.free.setdefault(space, []).append((first, rows))

    def best_fit(self, length: int, rows: int) -> None:
        """Pieces of one length, into the least free space that holds them, or new sequences."""
        while rows:
            at, times = bisect_left(self.spaces, length), 1
            if at < len(self.spaces):
                space = self.spaces[at]
                first, count = self.free[space].pop()
                if not self.free[space]:
                    self.spaces.pop(at)
                offset, taken = self.capacity - space, min(rows, count)
                if taken < count:
                    self.leave(first + taken, count - taken, offset)
            else:
                # New sequences, each with as many of these pieces as fit.
                times = min(self.capacity // length, rows)
                taken, offset = rows // times, 0
                first = self.open(taken)
            for _ in range(times):
                self.put(length, first, taken, offset)
                offset += length
            self.leave(first, taken, offset)
            rows -= taken * times

    def configure(self, config: list[int], times: int, queues: list[list[tuple[int, int]]]) -> None:
        """Use a configuration ``times`` times; its sequences differ where a slot's length changes."""
        slots = [_take(queues[k], times) for k, n in enumerate(config) for _ in range(n)]
        first = self.open(times)
        while times:
            rows, offset = min(slot[-1][1] for slot in slots), 0
            for slot in slots:
                length, left = slot.pop()
                self.put(length, first, rows, offset)
                offset += length
                if left > rows:
                    slot.append((length, left - rows))
            self.leave(first, rows, offset)
            first, times = first + rows, times - rows


def _take(queue: list[tuple[int, int]], rows: int) -> list[tuple[int, int]]:
    """The next pieces of a queue that ends with its longest, likewise ordered."""
    out = []
    while rows:
        length, left = queue.pop()
        taken = min(left, rows)
        out.append((length, taken))
        rows -= taken
        if left > taken:
            queue.append((length, left - taken))
    return out[::-1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Where the pieces of each length go."""
    out, left = Plan(capacity), dict(counts)
    if capacity in left:
        rows = left.pop(capacity)
        out.put(capacity, out.open(rows), rows, 0)
    large = {s: left.pop(s) for s in list(left) if s > capacity * LARGE}
    if large:
        rounded: dict[int, list[tuple[int, int]]] = {}
        for group in linear_groups(large, groups):
            # Groups that round up to one length are one size.
            rounded.setdefault(group[0][0], []).extend(group)
        sizes, queues = np.array(list(rounded)), [q[::-1] for q in rounded.values()]
        for config, times in configurations(sizes, [sum(n for _, n in q) for q in queues], capacity):
            out.configure(config, times, queues)
        for length, rows in (x for q in queues for x in q):
            left[length] = left.get(length, 0) + rows
    for length in sorted(left, reverse=True):
        out.best_fit(length, left[length])
    return out


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32)."""
    pieces = written(pieces, "pieces")  # encoded once, read for the counts and for the places
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALT)))
    buckets = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    buckets = written(buckets, "lengths")  # at most capacity * SALT rows
    counts = {r["length"]: r["rows"] for r in buckets.groupBy("length").agg(F.sum("_rows").alias("rows")).collect()}
    places = sorted(plan(counts, capacity).places)
    shared = pieces.sparkSession.sparkContext.broadcast(
        tuple(np.array(c, np.int64) for c in zip(*places)) if places else (np.zeros(0, np.int64),) * 5
    )

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("length", "_salt", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(offsets, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, first, offset, _ = shared.value
        keys = lengths << 48 | ranks
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            yield with_columns(
                batch.drop_columns(["_rank"]),
                sequence_id=pa.array(first[at] + rank - ranks[at]), offset=pa.array(offset[at]),
            )

    return ranked.mapInArrow(run, widened(pieces.schema, sequence_id=T.LongType(), offset=T.LongType()))


def pack(documents: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document's pieces."""
    return assign(cut(documents, vocabulary, capacity), capacity)
