"""Small tables for the tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

TEXTS = [
    None, "", " ", "the cat sat on the mat", "The Cat sat on the MAT", "the cat sat on the mat",
    "Ünïcode façade 漢字 mixed 123 <|endoftext|> text", "a  b\t\tc\n\n d ", "x" * 3000, "word " * 5000, "\x00\x01 odd bytes",
]


def documents(spark: SparkSession, texts: list | None = None, extra: bool = False) -> DataFrame:
    texts = TEXTS if texts is None else texts
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        for name in ("ids", "score", "shard", "slot", "row", "group", "n", "fp", "bytes", "length", "size", "_hash"):
            df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df


def with_nulls(spark: SparkSession) -> DataFrame:
    """Rows without an id, and rows that repeat."""
    rows = [(None, "one two three four", None, None, None), (7, None, None, None, None), (7, None, None, None, None),
            (8, "one two three four", "en", "s", 1), (8, "one two three four", "en", "s", 1), (9, "other words in here", None, "s", None)]
    return spark.createDataFrame(rows, DOCUMENTS)
