"""Approximate nearest neighbours by collision counting on single projections.

Every vector is projected on PROJECTIONS random directions. A block of vectors keeps one sorted array
per direction: its index. For a query, a window around the query's own projection is opened in every
array; a vector collides once for each array whose window holds it. Virtual rehashing widens all
windows by the factor GROWTH, without hashing anew, and only the newly covered ends of the arrays are
counted. Vectors with at least THRESHOLD collisions are verified: their exact distance is computed on
the original vectors. A block's search ends when its k-th verified distance is within the present
radius, for then nearly every vector within that distance has passed the threshold, or when the
windows cover the block.

Blocks hold at most about BLOCK vectors, whatever the size of the table, and are searched by blocks of
queries; each pair of blocks is one group of work and returns k rows per query, and a window over the
query merges them. A vector that a third of the rows share is spread over all blocks like any other.

Rows whose vector is null, zero, of another length than the query, or holds a null or non-finite
component take no part. Of rows with one id and different vectors the smallest vector counts; ids that
repeat count once. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROJECTIONS = 48
#: A vector at the search radius lies within a window of half width RATIO * radius with probability
#: 0.866 per direction (1.5 standard deviations of its projected distance), so it collides about 41.6
#: times out of 48, and 36 times or more with probability 0.99.
RATIO = 1.5
THRESHOLD = 36
GROWTH = 1.2
BLOCK = 8192
QUERY_BLOCK = 128
SEED = 20
#: Rows of a block that give a query its first radius.
FEW = 256


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id and vector (array of double) of the rows that take part, one per id."""
    value = F.col(embedding).cast("array<double>")
    return (
        vectors.select(F.col(vec_id).cast("long").alias("id"), value.alias("vector"))
        .where("id is not null and vector is not null")
        .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        .where(F.exists("vector", lambda x: x != 0))
        .groupBy("id").agg(F.min("vector").alias("vector"))
    )


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, PROJECTIONS))


class BlockIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.axes = directions(vectors.shape[1])
        projected = vectors @ self.axes
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        # No search begins with less: a small part of the block's spread.
        self.least = float(np.median(projected.std(axis=0))) / 16 or 1e-6

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the block's k nearest vectors that collide often enough."""
        n, centre = len(self.ids), query @ self.axes
        count = np.zeros(n, np.int16)
        low = np.array([np.searchsorted(a, c) for a, c in zip(self.sorted, centre)])
        high = low.copy()
        distance = np.full(n, np.inf)
        seen = self.ids == query_id
        left, best = int(n - seen.sum()), np.zeros(0)
        # Half the distance to the nearest of a few rows is a radius to begin with.
        near = np.sqrt(((self.vectors[:FEW] - query) ** 2).sum(axis=1))[~seen[:FEW]]
        radius = max(float(near.min(initial=np.inf)) / 2, self.least)
        if not np.isfinite(radius):
            radius = self.least
        while True:
            for j in range(PROJECTIONS):
                a, b = np.searchsorted(self.sorted[j], (centre[j] - RATIO * radius, centre[j] + RATIO * radius))
                if a < low[j]:
                    count[self.order[j, a : low[j]]] += 1
                    low[j] = a
                if b > high[j]:
                    count[self.order[j, high[j] : b]] += 1
                    high[j] = b
            new = np.flatnonzero((count >= THRESHOLD) & ~seen)
            if len(new):
                seen[new] = True
                left -= len(new)
                distance[new] = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
                best = np.sort(np.concatenate((best, distance[new])))[:k]
            if left == 0 or (len(best) == k and best[-1] <= radius):
                break
            radius *= GROWTH
        good = np.flatnonzero(distance <= (best[-1] if len(best) else -1))
        good = good[np.isfinite(distance[good])]
        top = good[np.lexsort((self.ids[good], distance[good]))][:k]
        return self.ids[top], distance[top]


def _search_blocks(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = rows["id"].to_numpy()
        flat = rows["vector"].combine_chunks().flatten().to_numpy()
        return ids, flat.reshape(len(ids), -1)

    found: list[tuple[np.ndarray, ...]] = []
    if len(queries) and len(vectors):
        index = BlockIndex(*unpack(vectors))
        for query_id, query in zip(*unpack(queries)):
            ids, distance = index.search(query_id, query, k)
            found.append((np.full(len(ids), query_id), ids, distance))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of ``vectors`` but itself (by id).

    Both inputs have (id, vector). Ties go to the smaller id.
    """
    rows, asked = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-rows // block)), max(1, -(-asked // query_block))
    size = F.size("vector").alias("size")
    held = vectors.select("id", "vector", size, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    wanted = queries.select(
        "id", "vector", size, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block")
    )
    # Keys of both sides have one type, or equal keys would not meet.
    # Each query goes to every block and each vector to every block of queries: rows * queries /
    # block size, the least a search of all blocks can move.
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ["size", "block", "query_block"]
    pairs = wanted.groupBy(*keys).cogroup(held.groupBy(*keys))
    found = pairs.applyInArrow(
        lambda left, right: _search_blocks(left, right, k), "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of every embedding whose id is divisible by 100, among all others."""
    vectors = valid_vectors(embeddings)
    return nearest(vectors, vectors.where("id % 100 = 0"), k)

