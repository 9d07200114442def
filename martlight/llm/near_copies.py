"""Near copies by the similarity of word shingles: texts of which two share at least SIMILAR of their
five-word shingles (Jaccard) are linked, and linked rows form groups.

1. Every text gets its fingerprint; those that differ in few bits are found as in ``simhash``, by the
   generalised pigeonhole principle. Texts of similarity 0.8 lie up to 13 of 64 bits apart, too far for
   its probes, so
2. every text also gets BANDS keys, each of ROWS minima of its shingles' hashes. Two texts of similarity
   s share no key with probability (1 - s**ROWS)**BANDS: 1.2e-7 at s = 0.8, less above.
3. Rows whose fingerprints are linked or that share keys, directly or through others, form a cluster.
   Only clusters travel on.
4. All pairs of a cluster are compared by their shingles themselves; a fingerprint or key alone never
   links. A pair is left out only if verified links already join its two rows.

A cluster of more than BLOCK rows is cut into blocks. All blocks first meet the same few rows; then
those outside of the largest group found so far meet everything, block by block.

Null, empty and blank texts are equal. Texts of fewer than five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlight.llm.common import fresh, written
from martlight.llm.components import components
from martlight.llm.simhash import design, fingerprint, joint_counts, link_forest

WORDS = 5
SIMILAR = 0.8
BANDS = 40
ROWS = 5
SEED = 42
#: Rows of one block, and rows that every block of a large cluster meets first.
BLOCK = 512
PIVOTS = 16
#: Shingles permuted at a time.
CHUNK = 1024

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's distinct shingles, sorted."""
    words = (text or "").encode("utf-8").lower().split()
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size).tolist(), end[WORDS - 1 :].tolist()
    if len(words) <= WORDS:
        starts, ends = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """One key for each band: a hash of the band's minima."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), CHUNK):
        np.minimum(least, (short[at : at + CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    raw, width = least.tobytes(), 4 * ROWS
    return [xxhash.xxh64_intdigest(raw[width * k : width * (k + 1)], seed=k) for k in range(BANDS)]


def _sketched(documents: DataFrame) -> DataFrame:
    """row, mark, doc_id, n, fp, bands: rows of one id and text are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [band_keys(shingles(t)) for t in texts]
            fp = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))
            flat = np.array(keys, np.uint64).reshape(-1).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("doc_id"), fp, bands], names=["mark", "doc_id", "fp", "bands"])

    rows = documents.select("mark", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.mapInArrow(run, f"mark binary, doc_id {kind}, fp bigint, bands array<bigint>")
    one = marked.groupBy("mark").agg(F.first("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    return written(one.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _joined(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join the same members as all pairs of at least SIMILAR.

    Members are compared with all others one by one, until those not yet compared are one group.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    posted = owner[np.argsort(token, kind="stable")]
    count = np.bincount(token)
    start = np.cumsum(count) - count
    first = np.cumsum(size) - size
    label, open_ = np.arange(n), np.ones(n, bool)
    while True:
        left = np.flatnonzero(open_)
        if len(left) < 2:
            return
        groups, members = np.unique(label[left], return_counts=True)
        if len(groups) == 1:
            return
        v = int(left[np.argmax(label[left] != groups[np.argmax(members)])])
        own = token[first[v] : first[v] + size[v]]
        many = count[own]
        met = posted[np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        shared = np.bincount(met, minlength=n)
        # Integers: shared / union >= 0.8 without rounding.
        near = shared * 10 >= round(SIMILAR * 10) * (size + size[v] - shared)
        open_[v] = False
        for u in np.flatnonzero(near).tolist():
            if label[u] != label[v]:
                yield v, u
                label[label == label[u]] = label[v]


def _links(members: DataFrame) -> DataFrame:
    """a, b: verified links of the rows that meet in a unit of work (cluster, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, sets = None, [], []

        def flush() -> pa.RecordBatch:
            pairs = [(rows[v], rows[u]) for v, u in _joined(sets)] if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "row", "text")]
            for *at, row, text in zip(*columns):
                if at != unit:
                    yield flush()
                    unit, rows, sets = at, [], []
                if not rows or rows[-1] != row:
                    rows.append(row)
                    sets.append(shingles(text))
        yield flush()

    dealt = members.select("cluster", "i", "j", "row", "text").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "row")
    return dealt.mapInArrow(run, "a long, b long")


def _block(blocks: str):
    return F.pmod(F.xxhash64("row"), F.col(blocks)).cast("int")


def _steps(blocks: str):
    return F.sequence(F.lit(0), F.col(blocks) - 1)


def _fingerprint_links(sketches: DataFrame) -> DataFrame:
    """a, b: links that join all rows whose fingerprints are linked, over the first row of each fingerprint."""
    distinct = written(sketches.groupBy("fp").agg(F.min("row").alias("first")), "distinct")
    found = written(link_forest(distinct, design(*joint_counts(distinct))), "fingerprint-links")
    left = distinct.select(F.col("fp").alias("a"), F.col("first").alias("left"))
    right = distinct.select(F.col("fp").alias("b"), F.col("first").alias("right"))
    between = found.join(left, "a").join(right, "b").select(F.col("left").alias("a"), F.col("right").alias("b"))
    return sketches.select("row", "fp").join(distinct, "fp").select(F.col("row").alias("a"), F.col("first").alias("b")).unionByName(between)


def _key_links(sketches: DataFrame) -> DataFrame:
    """a, b: links that join all rows which share keys, by way of the first row of each key.

    A row is linked with the smallest of its keys' first rows, and that one with the others. A large group
    has few first rows, so their links repeat from row to row and are made once; a link of every row with
    every first row would be up to BANDS a row, in every round of the components.
    """
    keys = sketches.select("row", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("row").alias("b"), F.max("row").alias("top")).where("b < top").drop("top")
    firsts = keys.join(shared, ["band", "key"]).groupBy("row").agg(F.collect_set("b").alias("firsts"))
    least = F.array_min("firsts")
    links = F.transform("firsts", lambda b: F.struct(F.when(b == least, F.col("row")).otherwise(least).alias("a"), b.alias("b")))
    return firsts.select(F.inline(links)).where("a <> b").distinct()


def groups(documents: DataFrame, sketches: DataFrame) -> DataFrame:
    """row, component: rows that verified links join; rows without links do not appear."""
    clusters = components(_key_links(sketches).unionByName(_fingerprint_links(sketches)))
    clusters = clusters.withColumnsRenamed({"node": "row", "component": "cluster"})
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "cluster").join(sketches.select("row", "mark"), "row")
    members = written(documents.select("mark", "text").join(placed, "mark").drop("mark"), "members")

    # Every row in its block; in a large cluster a few rows, the same ones, in each block.
    large = members.where("blocks > 1")
    some = not large.isEmpty()
    once = members.withColumn("i", _block("blocks")).withColumn("j", F.lit(0))
    if some:
        chosen = large.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")) == 0, F.col("row")))), 1, PIVOTS).alias("chosen"))
        pivots = large.join(chosen.select("cluster", F.explode("chosen").alias("row")), ["cluster", "row"])
        once = once.unionByName(pivots.withColumn("i", F.explode(_steps("blocks"))).withColumn("j", F.lit(0)))
    links = written(_links(once), "links")
    if not some:
        return components(links).withColumnRenamed("node", "row")
    found = components(links).withColumnRenamed("node", "row")
    labelled = large.select("cluster", "row", "blocks").join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))
    labelled = written(labelled, "labelled")
    counted = labelled.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    outside = largest.where("most < all").withColumn("others", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    outside = written(outside.select("cluster", "largest", "others"), "outside")
    if outside.isEmpty():
        return found
    rest = large.join(labelled.select("row", "component"), "row").join(outside, "cluster")
    every = rest.withColumn("i", _block("blocks")).withColumn("j", F.explode(_steps("others")))
    others = rest.where("component <> largest").withColumn("j", _block("others")).withColumn("i", F.explode(_steps("blocks")))
    more = written(_links(every.unionByName(others)), "links")
    return components(links.union(more)).withColumnRenamed("node", "row")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group stays, that of the smallest id, with its own columns.

    Rows without an id come last in their group; of rows with one id one stays.
    """
    mark = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256))
    texts = documents.select("doc_id", "text", mark.alias("mark"))
    sketches = _sketched(texts)
    found = groups(texts, sketches).join(sketches.select("row", "mark", "doc_id"), "row")
    found = written(found.select("component", "row", "mark", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("rank")), "groups")
    first = found.groupBy("component").agg(F.min("rank").alias("first"))
    dropped = found.join(first, "component").where("rank <> first").select("mark")
    own = fresh(documents, "mark")
    marked = documents.select(*[F.col(c) for c in documents.columns], mark.alias(own))
    kept = marked.join(dropped.withColumnRenamed("mark", own), own, "left_anti")
    repeated = written(sketches.where("n > 1").select(F.col("mark").alias(own)), "repeated")
    if not repeated.isEmpty():
        again = kept.join(repeated, own, "left_semi").dropDuplicates([own])
        kept = kept.join(repeated, own, "left_anti").unionByName(again)
    return kept.select(documents.columns)
