"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: the majority of the hashes of the text's word shingles. Two fingerprints
that differ in at most MOST bits are linked; linked documents form groups.

1. The 64 bits are cut into parts, correlated bits together, so that the other parts stay selective.
   Correlations come from the bits' joint counts over all distinct fingerprints.
2. Each part gets a threshold of its own, -1 (unused) or more. If the thresholds plus one add up to
   MOST + 1, two linked fingerprints agree on at least one part up to its threshold. Dynamic
   programming chooses the thresholds (and the number of parts is tried out) so that the estimated
   probes and candidates are fewest.
3. Every fingerprint is filed under its value in each used part, and probes all values within the
   part's threshold. Rows that meet under one value are candidates; their full distance is verified.

Equal fingerprints are one row throughout, so copies cost nothing. Candidates are compared in the
task, in blocks, and only the links of a spanning forest leave it: a dense group never becomes a row
per pair. Values under which many fingerprints are filed are compared in square blocks, each a group
of work of its own.

Null and empty texts have fingerprint zero, which links like any other. Null doc_ids are kept and
take the group's smallest id; a group of null ids only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlight.llm.bpe import widened, with_columns
from martlight.llm.common import written
from martlight.llm.components import components

BITS = 64
MOST = 4
WORDS = 4
SEED = 42
#: Shingles hashed at a time.
CHUNK = 200_000
#: Fingerprints filed under one value that one group of work compares; more are cut into blocks.
BLOCK = 4096
#: Candidate pairs compared at a time.
PAIRS = 1 << 21


def fingerprint(text: str | None) -> int:
    """Bit k is set if over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - WORDS + 1)
    starts, ends = start[:n].tolist(), end[min(WORDS, len(words)) - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a long (two's complement)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(text).to_pylist()], np.uint64)
            yield with_columns(batch, **{name: pa.array(found.astype(np.int64))})

    return documents.mapInArrow(run, widened(documents.schema, **{name: T.LongType()}))


def joint_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints, and for each two bits how often both are set: 4,096 numbers from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            rows += len(bits)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), rows))],
            names=["cell", "n"],
        )

    cells = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS + 1, np.int64)
    for row in cells.collect():
        out[row["cell"]] = row["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def group_bits(rows: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` equal parts; each grows by the bit most correlated with those it has."""
    share = np.diag(joint) / max(rows, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    close = np.abs(joint / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        pool = sorted(left)
        grown = [max(pool, key=lambda b: close[b, pool].max())]
        left.discard(grown[0])
        while len(grown) < size:
            pool = sorted(left)
            best = pool[int(np.argmax(close[np.ix_(pool, grown)].sum(axis=1)))]
            grown.append(best)
            left.discard(best)
        out.append(sorted(grown))
    return out


def distance_shares(share: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs within 0, 1 ... ``most`` bits on a part (bits taken as independent)."""
    law = np.zeros(len(bits) + 1)
    law[0] = 1
    for b in bits:
        differ = 2 * share[b] * (1 - share[b])
        law[1:] = law[1:] * (1 - differ) + law[:-1] * differ
        law[0] *= 1 - differ
    return np.cumsum(law)[: most + 1]


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def allocate(rows: int, share: np.ndarray, parts: list[list[int]], most: int = MOST) -> tuple[float, list[int]]:
    """Thresholds with sum(threshold + 1) = most + 1 at the least estimated cost, and that cost."""
    costs = []
    for bits in parts:
        near = distance_shares(share, bits, most)
        # Rows filed and probed, and candidates met: a row costs about a hundred times a comparison.
        costs.append([0.0] + [100.0 * rows * (1 + ball(len(bits), t)) + rows * rows * near[t] for t in range(min(most, len(bits) - 1) + 1)])
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (most + 1)
    for cost in costs:
        best = [
            min(((best[left - used][0] + cost[used], best[left - used][1] + [used - 1])
                 for used in range(min(left, len(cost) - 1) + 1)), key=lambda x: x[0])
            for left in range(most + 2)
        ]
    return best[most + 1]


def design(rows: int, joint: np.ndarray, most: int = MOST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the used parts, for the number of parts that costs least."""
    share = np.diag(joint) / max(rows, 1)
    found = []
    for parts in range(2, most + 2):
        grouped = group_bits(rows, joint, parts)
        cost, thresholds = allocate(rows, share, grouped, most)
        found.append((cost, [(b, t) for b, t in zip(grouped, thresholds) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _probe_masks(bits: list[int], threshold: int) -> np.ndarray:
    flips = [sum(1 << (63 - b) for b in chosen) for r in range(threshold + 1) for chosen in combinations(bits, r)]
    return np.array(flips, np.uint64).astype(np.int64)


def filed_and_probed(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, value, fp, probe: each fingerprint under its value (probe false) and all values near it."""
    keep = [np.array([sum(1 << (63 - b) for b in bits)], np.uint64).astype(np.int64)[0] for bits, _ in parts]
    masks = [_probe_masks(bits, threshold) for bits, threshold in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k, (mask, flips) in enumerate(zip(keep, masks)):
                value = fp & mask
                near = (value[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp) + len(near), k, np.int32)), pa.array(np.concatenate((value, near))),
                     pa.array(np.concatenate((fp, np.repeat(fp, len(flips))))),
                     pa.array(np.concatenate((np.zeros(len(fp), bool), np.ones(len(near), bool))))],
                    names=["part", "value", "fp", "probe"],
                )

    small = distinct.select("fp")
    return small.mapInArrow(run, "part int, value long, fp long, probe boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as the links given, one per node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(begin: np.ndarray, count: np.ndarray, probe: np.ndarray, filed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of probes with filed[begin : begin + count], by way of a spanning forest."""
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, at = np.cumsum(count), 0
    while at < len(probe):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        for low in range(0, int(count[at]) if stop == at + 1 else 1, PAIRS):
            n = np.minimum(count[at:stop] - low, PAIRS) if stop == at + 1 else count[at:stop]
            first = begin[at:stop] + low
            own = np.repeat(np.arange(at, stop), n)
            other = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            a, b = probe[own], filed[other]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= most) & (a < b)
            if near.any():
                left, right = np.concatenate((left, a[near])), np.concatenate((right, b[near]))
                if len(left) > PAIRS:
                    left, right = forest(left, right)
        at = stop
    return forest(left, right)


def _compare_sorted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, value, ...): compare each value's probes with what is filed under it."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> pa.RecordBatch:
        part = table["part"].to_numpy().astype(np.int64)
        value, fp, probe = table["value"].to_numpy(), table["fp"].to_numpy(), table["probe"].to_numpy()
        block = table["block"].to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(new) - 1
        filed = np.flatnonzero(~probe)
        size = np.bincount(group[filed], minlength=group[-1] + 1 if len(group) else 0)
        start = np.cumsum(size) - size
        asked = np.flatnonzero(probe)
        asked = asked[size[group[asked]] > 0]
        a, b = _links(start[group[asked]], size[group[asked]], fp[asked], fp[filed], most)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(rows, bool)
        for name in ("part", "value", "block"):
            same &= table[name].to_numpy() == table[name][-1].as_py()
        cut = int(np.argmax(same))
        if cut:
            yield flush(table.slice(0, cut))
            table = table.slice(cut)
        else:
            # One value's probes fill the chunk: compare them, keep what is filed (sorted first).
            yield flush(table)
            table = table.filter(pc.invert(table["probe"]))
        held, rows = table.to_batches(), len(table)
    if rows:
        yield flush(pa.Table.from_batches(held).combine_chunks())


def link_forest(distinct: DataFrame, parts: list[tuple[list[int], int]], most: int = MOST) -> DataFrame:
    """a, b: links between fingerprints that connect the same ones as all links within ``most`` bits."""
    rows = filed_and_probed(distinct, parts)
    # How many blocks the fingerprints filed under a value make: few values have more than one.
    sizes = (
        rows.where(~F.col("probe")).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        .select("part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    heavy = written(sizes, "heavy")
    one = F.coalesce("blocks", F.lit(1))
    dealt = rows.join(heavy, ["part", "value"], "left") if not heavy.isEmpty() else rows.withColumn("blocks", F.lit(None).cast("int"))
    # A filed row is in one block; a probe asks every block of its value.
    dealt = dealt.withColumn(
        "block", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), one - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), one).cast("int"))))
    ).select("part", "value", "block", "fp", "probe")
    dealt = dealt.repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", "probe")
    return dealt.mapInArrow(lambda batches: _compare_sorted(batches, most), "a long, b long")


def grouped(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """Distinct fingerprints with ``component``, the smallest fingerprint that links lead to."""
    parts = design(*joint_counts(distinct), most)
    linked = components(link_forest(distinct, parts, most))
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )


def near_duplicates(documents: DataFrame, text: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links lead to) of every row."""
    # Only the text's fingerprint travels on; it is written once, as several steps read it.
    marked = written(fingerprints(documents.select("doc_id", F.col(text).alias("text"))).drop("text"), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    named = grouped(distinct, most)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(smallest, "component").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    hexadecimal = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(documents).select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest id, with its own columns.

    Documents without an id stay.
    """
    firsts = near_duplicates(documents).select(F.col("component_id").alias("doc_id")).distinct()
    kept = documents.join(firsts, "doc_id", "left_semi").select(documents.columns)
    return kept.unionByName(documents.where("doc_id is null"))
