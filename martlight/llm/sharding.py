"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is a hash of its key. Shards own many places (virtual nodes); a row belongs
to the next virtual node clockwise. Loads are bounded: a full shard's rows go on clockwise to the next
shard with room. With ``slack`` 0 the bounds add up to the number of rows, so counts differ by one at
most; with more slack fewer rows move when shards are added.

The ring is cut into 65,536 cells, each of which belongs to one virtual node. Only the cells' row
counts reach the driver (a bounded table); there the overflow is settled cell by cell, and each cell
gets a few runs "ranks a to b go to shard s, from slot t". Rows are ranked within their cell, in one
task per group of cells, and look their run up. A cell that a repeated key makes much larger than its
peers is ranked in parts, one for each split of the scan.

Null texts count as empty, null keys as one key. Repeated rows are placed one by one. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from martlight.llm.bpe import widened, with_columns

CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: A cell with over this many times the mean (and over HEAVY_ROWS) is ranked in parts.
HEAVY_TIMES = 8
HEAVY_ROWS = 10_000


def ring(shards: int, virtual_nodes: int) -> list[int]:
    """The shard that owns each cell: the next virtual node clockwise, each at a hash of its name."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            name = hashlib.sha256(f"shard {shard} node {node}".encode()).digest()
            taken.setdefault(int.from_bytes(name[:2], "big"), shard)
    owner, now = [0] * CELLS, taken[min(taken)]
    for cell in range(CELLS - 1, -1, -1):
        now = taken.get(cell, now)
        owner[cell] = now
    return owner


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def settle(counts: dict[int, int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (cell, first rank, shard, first slot) for the counts of the ring's cells.

    Rows take their own shard first, in ring order; then what is left of each cell goes on clockwise
    to the next shard with room.
    """
    free, slot, runs = list(room), [0] * len(room), []
    over: list[tuple[int, int, int]] = []

    def put(cell: int, rank: int, rows: int, shard: int) -> int:
        taken = min(rows, free[shard])
        if taken:
            runs.append((cell, rank, shard, slot[shard]))
            free[shard] -= taken
            slot[shard] += taken
        return taken

    for cell in sorted(counts):
        rows = counts[cell]
        taken = put(cell, 0, rows, owner[cell])
        if taken < rows:
            over.append((cell, taken, rows - taken))
    # Where the owner changes, in ring order: the overflow only needs to look at these.
    changes = [cell for cell in range(CELLS) if owner[cell] != owner[cell - 1]] or [0]
    for cell, rank, rows in over:
        at = bisect_right(changes, cell)
        while rows:
            shard = owner[changes[at % len(changes)]]
            taken = put(cell, rank, rows, shard)
            rank, rows, at = rank + taken, rows - taken, at + 1
            if rows and not any(free):
                raise ValueError("the shards have less room than there are rows")
    return runs


def shard_rows(
    df: DataFrame, key: str, shards: int, virtual_nodes: int = 256, slack: float = 0.0,
    grown: bool = False,
) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within a shard); existing columns so named go.

    ``grown=True`` also adds ``grown_shard``: the shard under the same law with one more shard.
    """
    # Scans are counted and numbered in the same splits: the rows of a split keep their order.
    placed = df.drop("shard", "slot", "grown_shard").withColumn(
        "_hash", F.xxhash64(F.col(key))
    ).withColumn("_cell", F.shiftrightunsigned("_hash", 64 - CELL_BITS).cast("int"))
    counted = placed.groupBy("_cell").count().collect()  # at most CELLS rows
    counts = {row["_cell"]: row["count"] for row in counted}
    total = sum(counts.values())
    heavy = [c for c, n in counts.items() if n > max(HEAVY_ROWS, HEAVY_TIMES * total / CELLS)]

    plans = [_plan(counts, n, virtual_nodes, slack, total) for n in ([shards, shards + 1] if grown else [shards])]
    part = F.when(F.col("_cell").isin(heavy), F.spark_partition_id() + 1).otherwise(0) if heavy else F.lit(0)
    # The last one settles repeated keys, so that a task that runs again ranks alike.
    order = [F.col("_hash"), F.col(key).asc_nulls_first(), F.xxhash64(*df.columns)]
    window = Window.partitionBy("_cell", "_part").orderBy(*order)
    ranked = placed.withColumn("_part", part).withColumn("_rank", F.row_number().over(window) - 1)
    if heavy:
        parts = placed.withColumn("_part", part).where(F.col("_part") > 0).groupBy("_cell", "_part").count()
        before = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = parts.select(
            "_cell", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
        )
        ranked = ranked.join(offsets, ["_cell", "_part"], "left").withColumn(
            "_rank", F.col("_rank") + F.coalesce("_before", F.lit(0))
        ).drop("_before")
    return _look_up(ranked, plans)


def _plan(counts: dict[int, int], shards: int, virtual_nodes: int, slack: float, total: int) -> tuple[np.ndarray, ...]:
    """Runs in the order of (cell, first rank)."""
    runs = sorted(settle(counts, ring(shards, virtual_nodes), capacities(total, shards, slack)))
    return tuple(np.array(column, np.int64) for column in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 4


def _look_up(ranked: DataFrame, plans: list[tuple[np.ndarray, ...]]) -> DataFrame:
    kept = ranked.drop("_hash", "_cell", "_part", "_rank").columns
    types = {"shard": T.IntegerType(), "slot": T.LongType()}
    if len(plans) > 1:
        types["grown_shard"] = T.IntegerType()
    # At most CELLS runs and a few more for each shard that overflows: a bounded broadcast.
    shared = ranked.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("_cell").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            added = {}
            for k, (cells, first, shard, slot) in enumerate(shared.value):
                # Ranks stay below 2**46: a cell and a rank make one sortable number.
                at = np.searchsorted((cells << 46) | first, (cell << 46) | rank, "right") - 1
                added["grown_shard" if k else "shard"] = pa.array(shard[at].astype(np.int32))
                if not k:
                    added["slot"] = pa.array(slot[at] + rank - first[at])
            yield with_columns(batch.select(kept), **added)

    return ranked.mapInArrow(run, widened(ranked.select(kept).schema, **types))


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Every document's shard under the law ``rows``: counts of shards differ by one at most."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    slim = documents.select(
        "doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard_rows(slim, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
