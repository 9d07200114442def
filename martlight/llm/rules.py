"""Quality rules as a bitmask ledger: measure once, decide as often as a policy changes.

``ledger`` reads every whole text once and stores the measurements together with one BIGINT whose bits
are the failed rules. A policy is a mask over these bits under a version number; applying it, comparing
two versions and asking what each rule alone costs are bitwise expressions over the ledger and never
touch a text again.

Measurements are made row by row in Arrow batches; no row meets another one, so nothing is shuffled.
All rules compare integers, so a decision never depends on rounding.

A null text has no words. Words are separated by the six ASCII blanks, and a text without words fails
``few_words``. Rows that repeat are measured each for itself; a null id stays null. Only the id and the
text are read, whatever other columns are called. An empty table gives an empty ledger, and ablations of
an empty ledger are zeros.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
LETTER = re.compile(r"[^\W\d_]")
WINDOW = 3

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words",
)


@dataclass(frozen=True)
class Rule:
    """One bit of the ledger. ``fails`` maps the measurements to a Boolean column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


# Positions are bits of stored ledgers: append, never reorder.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < 3 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 10 * m("n_words")),
    Rule("few_letters", lambda m: 100 * m("n_letter_words") < 80 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("many_words", lambda m: m("n_words") > 100_000),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """``rejects``: each of these bits rejects alone. ``counts``: more than ``allowed`` of these do."""

    version: int
    rejects: int
    counts: int = 0
    allowed: int = 0

    def rejected(self, failed: Column) -> Column:
        return (failed.bitwiseAND(self.rejects) != 0) | (F.bit_count(failed.bitwiseAND(self.counts)) > self.allowed)

    def bits(self) -> int:
        return self.rejects | self.counts


BASE = mask("few_words", "repeated_words")
#: A published version never changes; a new one is added.
POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, BASE | mask("symbols", "short_words", "long_words", "few_letters", "repeated_lines")),
    3: Policy(3, BASE | mask("symbols"), mask("short_words", "long_words", "few_letters", "repeated_lines", "many_words"), 1),
}
CURRENT = 2


def _repeat_words(codes: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of WINDOW words found at least twice."""
    if len(codes) <= WINDOW:
        return 0
    # Windows are numbered word by word: a number stays below the text's length, so the product fits.
    window = codes[: len(codes) - WINDOW + 1]
    for k in range(1, WINDOW):
        _, window = np.unique(window * kinds + codes[k : len(codes) - WINDOW + 1 + k], return_inverse=True)
    hit = np.flatnonzero(np.bincount(window)[window] > 1)
    covered = np.zeros(len(codes), bool)
    for k in range(WINDOW):
        covered[hit + k] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    seen: dict[bytes, int] = {}
    # Words are numbered as they are met: a long text is held as numbers, not as a list of words.
    found = (seen.setdefault(m.group(), len(seen)) for m in WORD.finditer(text.encode("utf-8", "surrogatepass")))
    codes = np.fromiter(found, np.int64)
    lettered = np.fromiter(
        (LETTER.search(w.decode("utf-8", "surrogatepass")) is not None for w in seen), bool, len(seen)
    )
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(codes),
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        _repeat_words(codes, len(seen)),
        len(lines),
        int(lettered[codes].sum()) if len(codes) else 0,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([measure(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(MEASURES))
        columns = [batch.column("doc_id"), *(pa.array(values[:, k]) for k in range(len(MEASURES)))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *MEASURES])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measurements of each row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = [T.StructField(m, T.LongType()) for m in MEASURES]
    return slim.mapInArrow(_measured, T.StructType([slim.schema["doc_id"], *fields]))


def failed_bits(measure_of: Callable[[str], Column] = F.col) -> Column:
    bits = [F.when(rule.fails(measure_of), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long") for rule in RULES]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``: bit k is set if rule k fails. To be stored once."""
    return measured(docs, doc_id, text).withColumn("failed", failed_bits())


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with the verdict of one policy: ``kept`` and ``policy``."""
    policy = POLICIES[version]
    return rows.withColumns({"kept": ~policy.rejected(F.col("failed")), "policy": F.lit(version)})


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """What each rule of a policy does: ``rule``, ``fails``, ``rejected_with`` (rejected rows that fail it),
    ``rescued`` (rows rejected now that are kept without it).

    The ledger is first counted by its bits: at most 2 ** len(RULES) rows leave each task, and every
    policy and every leave-one-out variant is decided on these counts.
    """
    policy, failed, n = POLICIES[version], F.col("failed"), F.col("n")
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    asked = []
    for rule in RULES:
        bit = BIT[rule.name]
        if not policy.bits() & bit:
            continue
        without = Policy(version, policy.rejects & ~bit, policy.counts & ~bit, policy.allowed)
        hit = failed.bitwiseAND(bit) != 0
        sums = {
            "fails": hit,
            "rejected_with": hit & policy.rejected(failed),
            "rescued": policy.rejected(failed) & ~without.rejected(failed),
        }
        asked.append(F.struct(
            F.lit(rule.name).alias("rule"),
            *[F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(k) for k, c in sums.items()],
        ))
    return counts.agg(F.array(*asked).alias("rules")).select(F.inline("rules"))


def patterns(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, rows without a failure, bits that some row fails and bits that all rows fail."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("failed") == 0).alias("clean"),
        F.bit_or("failed").alias("any_failed"),
        F.bit_and("failed").alias("all_failed"),
    )


def changed(rows: DataFrame, old: int, new: int) -> DataFrame:
    """Rows that two policy versions decide differently, with the bits that made the difference."""
    a, b, failed = POLICIES[old], POLICIES[new], F.col("failed")
    return rows.where(a.rejected(failed) != b.rejected(failed)).withColumns({
        "kept_before": ~a.rejected(failed),
        "kept_now": ~b.rejected(failed),
        "deciding": failed.bitwiseAND(a.bits() ^ b.bits()),
    })


def judge_documents(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger of all documents with the base rules and the verdict of a policy that holds them."""
    base = F.col("failed").bitwiseAND(BASE) != 0
    decided = apply_policy(ledger(docs), version).withColumn("base_failed", base)
    return decided.withColumn("kept", F.col("kept") & ~F.col("base_failed"))
