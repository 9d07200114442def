"""Hard negatives by rotated one-bit codes, exact integer scores for what the codes cannot decide.

Every vector is quantised to integers, rotated, and stored as the signs of its rotated components (one
bit each) with two numbers: its alignment, the length of its projection on the unit vector that its
signs stand for, and the length of what is left. An anchor's rotated components are cut to PLANES bits
each; popcounts of these bit planes with a code give its product with the code's unit vector, and

    score = alignment * (anchor . code) + (anchor . rest),

where by Cauchy-Schwarz the second term, and the error of the bit planes in the first, are at most a
product of lengths that are known. So every row has an interval that certainly holds its score. Rows
whose interval cannot reach the best k found so far, or misses the wanted window of scores, are left
out; the rest are scored with integers, best estimates first, so that the bar rises early. The result
equals that of scoring all pairs; the codes only save work.

Two searches are needed, as a negative's window depends on its positive's score: each goes over blocks
of rows times blocks of anchors (the stated query set), both cut by a hash of the id, so that no label,
however frequent, meets in one task. A block pair returns k rows per anchor or positive, and a window
over those merges the blocks. Codes and integers are written once to the shared folder.

Rows whose label or vector is null, or whose vector holds a null or non-finite component, take no part;
neither do rows without an id, and vectors whose quantised length is 2 ** 31 or more, as their scores
need not fit a BIGINT. Of rows that repeat an id the smallest (label, vector) counts. Vectors are
compared with vectors of their own size only; a zero or empty vector scores 0 with all. Ties go to the
smaller id. An empty table gives an empty result. Only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlight.llm.common import written

SCALE = 256
#: Bits an anchor's rotated component is cut to.
PLANES = 6
#: Components rotated together: bounds the rotation's size for any vector size.
SLICE = 512
SEED = 12
#: Rows and anchors of a block pair: bound a task's memory, not the result.
BLOCK = 8192
ANCHOR_BLOCK = 1024
#: Rows scored at first, before the bar is known; each further step takes twice as many.
FIRST = 32

CODED = "id long, label long, size int, ints binary, code binary, length double, aligned double, rest double"


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A random rotation, fixed by its size."""
    axes, _ = np.linalg.qr(np.random.default_rng([SEED, size]).standard_normal((size, size)))
    return axes


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Rotates slices of SLICE components, each by itself: products are those of the whole vectors."""
    parts = [vectors[:, k : k + SLICE] for k in range(0, vectors.shape[1], SLICE)]
    return np.hstack([p @ rotation(p.shape[1]) for p in parts]) if parts else vectors


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, padded with zeros."""
    rows, size = bits.shape
    whole = np.zeros((rows, max(1, -(-size // 64)) * 64), np.uint8)
    whole[:, :size] = bits
    return np.packbits(whole, axis=1, bitorder="little").view(np.uint64)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vector")
        sizes = np.diff(lists.offsets.to_numpy())
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            scaled = np.floor(SCALE * flat[at[rows][:, None] + np.arange(size)].reshape(len(rows), size))
            fits = (scaled * scaled).sum(axis=1) < 2.0**62
            rows, scaled = rows[fits], scaled[fits]
            turned = rotate(scaled)
            length = np.sqrt((scaled * scaled).sum(axis=1))
            aligned = np.abs(turned).sum(axis=1) / np.sqrt(max(1, size))
            rest = np.sqrt(np.maximum(0.0, length**2 - aligned**2))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)), batch.column("label").take(pa.array(rows)),
                    pa.array(np.full(len(rows), size, np.int32)),
                    pa.array([v.tobytes() for v in scaled.astype(np.int32)], pa.binary()),
                    pa.array([c.tobytes() for c in packed(turned >= 0)], pa.binary()),
                    pa.array(length), pa.array(aligned), pa.array(rest),
                ],
                names=["id", "label", "size", "ints", "code", "length", "aligned", "rest"],
            )


def coded(vectors: DataFrame) -> DataFrame:
    """Codes of (id, label, vector: array of double), in the shared folder."""
    return written(vectors.select("id", "label", "vector").mapInArrow(_encoded, CODED), "codes")


class Codes:
    """A block of coded rows as arrays."""

    def __init__(self, rows: pa.Table):
        n, size = len(rows), rows["size"][0].as_py()
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.length, self.aligned, self.rest = (rows[c].to_numpy() for c in ("length", "aligned", "rest"))
        self.ints = np.frombuffer(b"".join(rows["ints"].to_pylist()), np.int32).reshape(n, size)
        self.codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(n, -1)
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)
        # Sums of products stay below the product of lengths: a double holds them exactly up to 2 ** 53.
        self.exact = np.float64 if self.length.max(initial=0.0) < 2.0**26 else np.int64
        self.values = self.ints.astype(self.exact)

    def scores(self, places: np.ndarray, anchor: np.ndarray, length: float) -> np.ndarray:
        kind = self.exact if length < 2.0**26 else np.int64
        return (self.values[places].astype(kind, copy=False) @ anchor.astype(kind)).astype(np.int64)


class Anchor:
    """One anchor against blocks of codes."""

    def __init__(self, ints: np.ndarray):
        self.ints = ints
        turned = rotate(ints[None, :].astype(np.float64))[0]
        self.length = float(np.sqrt((turned * turned).sum()))
        self.low = float(turned.min(initial=0.0))
        self.step = (float(turned.max(initial=0.0)) - self.low) / (2**PLANES - 1) or 1.0
        cut = np.rint((turned - self.low) / self.step).astype(np.int64)
        coarse = self.low + self.step * cut
        self.total = float(coarse.sum())
        self.error = float(np.sqrt(((turned - coarse) ** 2).sum()))
        self.planes = packed((cut[None, :] >> np.arange(PLANES)[:, None]) & 1)

    def intervals(self, block: Codes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of the block's rows: no score lies outside."""
        codes, size = block.codes[places], max(1, block.ints.shape[1])
        level = np.zeros(len(places), np.int64)
        for k in range(PLANES):
            level += np.bitwise_count(codes & self.planes[k]).sum(axis=1, dtype=np.int64) << k
        along = (2 * (self.low * block.ones[places] + self.step * level) - self.total) / np.sqrt(size)
        across = np.sqrt(np.maximum(0.0, self.length**2 - np.maximum(0.0, np.abs(along) - self.error) ** 2))
        middle = block.aligned[places] * along
        # The last term covers the rounding of these doubles.
        width = block.aligned[places] * self.error + block.rest[places] * across
        width += 1e-9 * self.length * block.length[places] + 1e-6
        return middle - width, middle + width


def best(block: Codes, anchor: Anchor, places: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (least, most) of scores: the k best (score, id) among the block's ``places``."""
    if not len(places) or not windows:
        return [[] for _ in windows]
    low, high = anchor.intervals(block, places)
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    bars = [least for least, _ in windows]
    left, step = np.ones(len(places), bool), FIRST
    middle = (low + high) / 2
    # No score of this block is larger than the product of the lengths.
    ends = np.minimum([float(most) for _, most in windows], anchor.length * block.length.max(initial=0.0))
    while True:
        # A row is wanted if its interval meets a window at or above the bar of its k-th score.
        wanted = np.zeros(len(places), bool)
        for bar, (_, most) in zip(bars, windows):
            wanted |= (high >= bar) & (low <= most)
        open_rows = np.flatnonzero(wanted & left)
        if not len(open_rows):
            return found
        if len(open_rows) > step:
            # Rows near a window's upper end come first.
            gap = np.abs(middle[open_rows][:, None] - ends).min(axis=1)
            open_rows = open_rows[np.argpartition(gap, step)[:step]]
        left[open_rows] = False
        step *= 2
        scores = block.scores(places[open_rows], anchor.ints, anchor.length)
        ids = block.ids[places[open_rows]]
        for w, (least, most) in enumerate(windows):
            inside = np.flatnonzero((scores >= bars[w]) & (scores <= most))
            if not len(inside):
                continue
            order = inside[np.lexsort((ids[inside], -scores[inside]))][:k]
            merged = found[w] + [(int(scores[j]), int(ids[j])) for j in order]
            found[w] = sorted(merged, key=lambda x: (-x[0], x[1]))[:k]
            if len(found[w]) == k:
                bars[w] = max(least, found[w][-1][0])


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    if len(anchors) and len(rows):
        asked, block = Codes(anchors), Codes(rows)
        for j in range(len(asked.ids)):
            mine = np.flatnonzero((block.labels == asked.labels[j]) & (block.ids != asked.ids[j]))
            anchor = Anchor(asked.ints[j])
            top = best(block, anchor, mine, [(-(2**63), 2**63 - 1)], k)[0]
            out.extend((int(asked.ids[j]), i, s) for s, i in top)
    return _table(out, ["anchor_id", "positive_id", "positive_score"])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def window_of(score: int) -> tuple[int, int]:
    """Least and largest negative score with 50 * score <= 100 * negative <= 95 * score."""
    return -(-50 * score // 100), 95 * score // 100


def _negatives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    out: list[tuple[int, ...]] = []
    if len(anchors) and len(rows):
        asked, block = Codes(anchors), Codes(rows)
        for j, scores in enumerate(anchors["scores"].to_pylist()):
            # A score may be below zero: then no negative fits, and no window is searched.
            wanted = [s for s in scores if window_of(s)[0] <= window_of(s)[1]]
            if not wanted:
                continue
            others = np.flatnonzero(block.labels != asked.labels[j])
            found = best(block, Anchor(asked.ints[j]), others, [window_of(s) for s in wanted], k)
            for score, top in zip(wanted, found):
                out.extend((int(asked.ids[j]), score, i, s) for s, i in top)
    return _table(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])


def _block_pairs(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Every block of anchors with every block of rows, as one group each.

    The side that costs less to repeat would be the anchors, but a task must hold its groups whole:
    both are cut, and rows are repeated once per ANCHOR_BLOCK anchors.
    """
    blocks, asked = max(1, -(-n_rows // BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))

    def dealt(df: DataFrame, salt: int, parts: int, name: str, other: str, others: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
        # Named anew, or both sides would share their columns.
        df = df.select(*[F.col(c).alias(c) for c in df.columns])
        return df.withColumn(name, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    keys = ["size", "block", "asked"]
    left = dealt(anchors, 1, asked, "asked", "block", blocks)
    right = dealt(rows, 0, blocks, "block", "asked", asked)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def first_of(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are coded rows, ``anchors`` those of them that ask. An anchor's positives are its best
    rows of its own label; a positive's negatives the best rows of other labels in ``window_of``.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    near = _block_pairs(anchors, rows, n_anchors, n_rows).applyInArrow(
        lambda a, b: _positives(a, b, positives), "anchor_id long, positive_id long, positive_score long"
    )
    chosen = written(first_of(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    # Positives of one score share their negatives.
    scores = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    far = _block_pairs(anchors.join(scores, "id"), rows, n_anchors, n_rows).applyInArrow(
        lambda a, b: _negatives(a, b, negatives),
        "anchor_id long, positive_score long, negative_id long, negative_score long",
    )
    top = first_of(far, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return chosen.join(top, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """id, label, vector of the rows that take part, one per id; every seventh id has the next label."""
    value, label = F.col("embedding").cast("array<double>"), F.col("label").cast("long")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), value.alias("vector"))
        .where("id is not null and label is not null and vector is not null").where(finite)
        .withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
        .groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    )


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 50) among all rows."""
    rows = coded(labelled_vectors(embeddings))
    return mine(rows, rows.where("id % 50 = 0"))
