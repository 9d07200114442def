"""Exact duplicates by distributed MSD radix partitioning.

A text's key is its bytes (A-Z lower-cased) behind its length. Groups of rows are split by successive
bytes of the key, most significant first: level 0 splits by the length and the first bytes, each later
level by the next bytes of what is left, in strides that grow fourfold. A group that has one row, or
whose texts have ended, is finished; only the others go on. Rows of one finished group are equal byte
for byte: no digest decides (the one returned is for the reader).

Each level counts per (group, bytes), combined before the shuffle, so a group that holds a third of
the rows is one row per task there; its rows then look up their new group's number in a join on
unique keys, which can be split. Texts are written once, cut at the levels' strides, and a level
reads only its own column. No group is ever gathered in one place.

Null counts as empty. Of equal texts the row with the largest doc_id stays (null is smallest); of rows
that repeat an id and a text one stays. Every row is returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlight.llm.bpe import widened, with_columns
from martlight.llm.common import fresh, written

#: Bytes that levels 0, 1 ... look at; beyond them every level takes the last stride from ``rest``.
STRIDES = (64, 256, 1024, 4096, 16384)
REST_STRIDE = 65536


def normalised(texts: pa.Array) -> pa.Array:
    """Bytes of the texts with A-Z lower-cased; null is empty."""
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())


def _columns() -> list[str]:
    return [f"c{k}" for k in range(len(STRIDES))] + ["rest"]


def cut_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """row, doc_id, text_sha256, size and the text's bytes, cut at the strides (null behind its end)."""
    keyed = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = normalised(batch.column("_text")).to_pylist()
            out = {
                "text_sha256": pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string()),
                "size": pa.array([len(v) for v in values], pa.int64()),
            }
            at = 0
            for name, stride in zip(_columns(), (*STRIDES, None)):
                end = None if stride is None else at + stride
                part = [v[at:end] if not at or len(v) > at else None for v in values]
                out[name] = pa.array(part, pa.binary())
                at += stride or 0
            yield with_columns(batch.drop_columns(["_text"]), **out)

    types = {"text_sha256": T.StringType(), "size": T.LongType()} | {c: T.BinaryType() for c in _columns()}
    return keyed.mapInArrow(run, widened(keyed.drop("_text").schema, **types))


def _level(rows: DataFrame, end: int) -> DataFrame:
    """row, group, n, done of rows (row, group, size, bytes) after a split by bytes up to ``end``."""
    keys = ["group", "size", "bytes"]
    groups = rows.groupBy(*keys).agg(F.min("row").alias("_group"), F.count(F.lit(1)).alias("n"))
    found = rows.join(groups, keys).select(
        "row", "size", F.col("_group").alias("group"), "n", ((F.col("n") == 1) | (F.col("size") <= end)).alias("done")
    )
    return written(found, "level")


def groups_of_equal(cut: DataFrame) -> DataFrame:
    """row, group (one of its rows), n of every row of ``cut_texts``."""
    first = cut.select("row", F.lit(0).cast("long").alias("group"), "size", F.col("c0").alias("bytes"))
    end = STRIDES[0]
    split = _level(first, end)
    done = [split.where("done")]
    level = 1
    while True:
        left = split.where("not done").select("row", "group")
        if left.isEmpty():
            break
        if level < len(STRIDES):
            column, stride = F.col(f"c{level}"), STRIDES[level]
        else:
            column, stride = F.substring("rest", end - sum(STRIDES) + 1, REST_STRIDE), REST_STRIDE
        # Rows whose texts have not ended: all that are left, and others that no group needs.
        more = cut.where(F.col("size") > end).select("row", "size", column.alias("bytes"))
        end += stride
        split = _level(left.join(more, "row"), end)
        done.append(split.where("done"))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("row", "group", "n")


def duplicates(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    cut = written(cut_texts(documents, text), "texts")
    names = cut.select("row", "doc_id", "text_sha256")
    rows = groups_of_equal(cut).join(names, "row")
    single = rows.where("n = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    several = rows.where("n > 1")
    # The largest (doc_id, row): one row of a group that repeats an id stays.
    keep = several.groupBy("group").agg(F.max(F.struct("doc_id", "row")).alias("keep"))
    many = several.join(keep, "group").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256",
    )
    return single.union(many)


def keep_distinct(documents: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns: one of each group of equal texts."""
    found = written(duplicates(documents), "duplicates")
    kept = found.where("kept").select("doc_id", "text_sha256")
    again = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows_of(documents, kept, again)


def _rows_of(documents: DataFrame, kept: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of documents named by (doc_id, digest of the normalised text), each name once."""
    sha, key, name = fresh(documents, "sha"), fresh(documents, "key"), fresh(documents, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(v.as_buffer()).hexdigest() for v in normalised(batch.column("text"))]
            yield with_columns(batch, **{sha: pa.array(digests, pa.string())})

    named = documents.mapInArrow(run, widened(documents.schema, **{sha: T.StringType()}))

    def named_by(names: DataFrame) -> DataFrame:
        other = names.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(name))
        return named.join(other, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(name)), "left_semi")

    if again.isEmpty():
        return named_by(kept).select(documents.columns)
    once = kept.join(again, [kept.doc_id.eqNullSafe(again.doc_id), kept.text_sha256 == again.text_sha256], "left_anti")
    several = kept.join(again, [kept.doc_id.eqNullSafe(again.doc_id), kept.text_sha256 == again.text_sha256], "left_semi")
    repeated = named_by(several).dropDuplicates(["doc_id", sha])
    return named_by(once).select(documents.columns).union(repeated.select(documents.columns))
