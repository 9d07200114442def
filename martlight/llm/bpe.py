"""BPE encoding and decoding of whole texts (the method is in ``codec``).

Both operators work row by row: no shuffle, bounded batches, nothing kept between rows but a bounded
cache of words. Null and empty texts have no ids; no ids decode to the empty text. All other columns
are kept; columns that have an output's name are replaced. Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from martlight.llm.codec import codec, decoder


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added, or replaced by name, at its end."""
    keep = [k for k, name in enumerate(batch.schema.names) if name not in columns]
    return pa.RecordBatch.from_arrays(
        [batch.column(k) for k in keep] + list(columns.values()),
        names=[batch.schema.names[k] for k in keep] + list(columns),
    )


def widened(schema: T.StructType, **types: T.DataType) -> T.StructType:
    kept = [f for f in schema.fields if f.name not in types]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in types.items()])


def encoded(batch: pa.RecordBatch, vocabulary: str, text: str, ids: str) -> pa.RecordBatch:
    found, bounds = codec(vocabulary).encode_batch(batch.column(text))
    raw = memoryview(found.tobytes())
    values = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return with_columns(batch, **{ids: pa.array(values, pa.binary())})


def decoded(batch: pa.RecordBatch, vocabulary: str, ids: str, text: str) -> pa.RecordBatch:
    values = pc.fill_null(batch.column(ids), b"")
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.frombuffer(b"".join(values.to_pylist()), "<u4")
    return with_columns(batch, **{text: decoder(vocabulary).decode_batch(flat, bounds)})


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the text's token ids, little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield encoded(batch, vocabulary, text, ids)

    return df.mapInArrow(run, widened(df.schema, **{ids: T.BinaryType()}))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: what the ids stand for, special tokens included. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decoded(batch, vocabulary, ids, text)

    return df.mapInArrow(run, widened(df.schema, **{text: T.StringType()}))


def encode_decode_digest(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Both operators' work in one pass, so that ids and decoded texts need not leave the worker.
    """

    def hexadecimal(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values.cast(pa.binary()).to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = decoded(encoded(batch, vocabulary, "text", "ids"), vocabulary, "ids", "decoded")
            sizes = pc.divide(pc.binary_length(both.column("ids")).cast(pa.int64()), 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, hexadecimal(both.column("ids")), hexadecimal(both.column("decoded"))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
