"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by log-count ratios.

1. A text becomes a set of n-grams: its words and word pairs, and runs of one to four word shapes
   (case, marks at the end, single marks, "same word again"). Each is an indicator, hashed to one of
   2**18 places. Shapes tell tables, shouting and repetition whatever the words are.
2. Naive Bayes: an indicator's scale is the log of the ratio between its smoothed shares in the two
   classes. N-grams in fewer than MIN_DOCS fitted texts have scale 0.
3. Support vectors: the scaled vectors (of length 1) are separated by a hinge-loss model that dual
   coordinate descent fits; a logistic curve over rows the descent has not seen turns the margin into
   a score between 0 and 1.

The model is fitted on at most SAMPLE labelled texts (a documented bound: the labelled rows whose ids
hash lowest), which the driver holds as sets of numbers. Scoring reads every whole text in its task,
with the model (1 MB) broadcast, and shuffles nothing.

Null texts score as empty texts, which have no n-grams. Labels of a text that contradict each other
count as good; null labels do not count. Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlight.llm.bpe import widened, with_columns
from martlight.llm.common import fresh

BITS = 18
SAMPLE = 12_000
CALIBRATE_SHARE = 0.25
MIN_DOCS = 5
MAX_N = 4
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3
#: Bytes of text turned into numbers at a time.
CHUNK = 2 << 20
HELD_OUT_FOLDS = 5

PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n, PRIME, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _places(*parts: np.ndarray) -> np.ndarray:
    """Mix hashes into one of 2**BITS places each."""
    total = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        total = (total ^ (part >> np.uint64(29)) ^ part) * MIX + PRIME
    return (total ^ (total >> np.uint64(31))) * MIX >> np.uint64(64 - BITS)


@dataclass
class _Words:
    """Words of texts in order: which text, polynomial sum of the bytes, and what their shapes need."""

    text: np.ndarray
    sums: np.ndarray
    length: np.ndarray
    uppers: np.ndarray
    lowers: np.ndarray
    last: np.ndarray  # the last byte and the one before it (0 if there is none)
    before: np.ndarray

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.text, self.sums, self.length, self.uppers, self.lowers, self.last, self.before

    def cut(self, start: int, stop: int | None = None) -> _Words:
        return _Words(*(c[start:stop] for c in self.columns()))

    def values(self) -> np.ndarray:
        return self.sums + self.length.astype(np.uint64)


def _words(data: np.ndarray, starts: np.ndarray) -> _Words:
    """The words of the texts that begin at ``starts`` in ``data``."""
    gap = SPACE[data]
    head = ~gap
    head[1:] &= gap[:-1]
    begins = starts[starts < len(data)]
    head[begins] = ~gap[begins]
    first = np.flatnonzero(head)
    if not len(first):
        none = np.zeros(0, np.int64)
        return _Words(none, none.astype(np.uint64), none, none, none, none, none)
    # White space counts as zero, so a word's sum may run on to the next word's first byte.
    small = LOWER[data].astype(np.uint64) + np.uint64(1)
    small[gap] = 0
    sums = np.add.reduceat(small * _powers(len(data)), first)
    length = np.add.reduceat((~gap).astype(np.int64), first)
    # Equal words at different places differ by a power of the prime: divide it out.
    back = np.full(len(data), np.uint64(pow(int(PRIME), -1, 1 << 64)), np.uint64)
    back[:1] = 1
    sums *= np.cumprod(back, dtype=np.uint64)[first]
    last = first + length - 1
    return _Words(
        np.searchsorted(starts, first, "right") - 1, sums, length,
        np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int64), first),
        np.add.reduceat(((data >= 97) & (data <= 122)).astype(np.int64), first),
        data[last].astype(np.int64), np.where(length > 1, data[np.maximum(last - 1, 0)], 0).astype(np.int64),
    )


def _one_word(a: _Words, b: _Words) -> _Words:
    """The word whose beginning is ``a`` and whose rest is ``b``."""
    power = np.uint64(pow(int(PRIME), int(a.length[0]), 1 << 64))
    return _Words(
        a.text, a.sums + power * b.sums, a.length + b.length, a.uppers + b.uppers, a.lowers + b.lowers,
        b.last, np.where(b.length > 1, b.before, a.last),
    )


def _joined_words(*parts: _Words) -> _Words:
    return _Words(*(np.concatenate(c) for c in zip(*(p.columns() for p in parts))))


def _is_letter(byte: np.ndarray) -> np.ndarray:
    return (byte >= 65) & (byte <= 90) | (byte >= 97) & (byte <= 122) | (byte >= 128)


def _shapes(words: _Words, again: np.ndarray) -> np.ndarray:
    """Case, marks at the end, single marks and "same word again" of every word."""
    end = np.where(_is_letter(words.last), 0, words.last).astype(np.uint64)
    before = np.where(_is_letter(words.before), 0, words.before).astype(np.uint64)
    return (
        end | before << np.uint64(8)
        | (words.uppers > 0).astype(np.uint64) << np.uint64(16)
        | ((words.lowers == 0) & (words.uppers > 1)).astype(np.uint64) << np.uint64(17)
        | again.astype(np.uint64) << np.uint64(18) | (words.length == 1).astype(np.uint64) << np.uint64(19)
    ) + np.uint64(1)


def _again(words: _Words) -> np.ndarray:
    value, again = words.values(), np.zeros(len(words.text), bool)
    again[1:] = (words.text[1:] == words.text[:-1]) & (value[1:] == value[:-1])
    return again


def _grams(text: np.ndarray, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """(text << BITS | place) of the n-grams of words in order."""
    found = [(text, _places(word))]
    pair = np.flatnonzero(text[1:] == text[:-1]) + 1
    found.append((text[pair], _places(word[pair - 1], word[pair])))
    for n in range(1, MAX_N + 1):
        run = np.arange(n - 1, len(text))
        run = run[text[run] == text[run - n + 1]]
        parts = [shape[run - k] for k in range(n)]
        found.append((text[run], _places(np.full(len(run), n, np.uint64), *parts)))
    return np.concatenate([t.astype(np.int64) << BITS | p.astype(np.int64) for t, p in found])


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all texts' n-grams, each once per text and ascending, and where each text begins."""
    values = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    out, counts, at = [], np.zeros(len(values), np.int64), 0
    while at < len(values):
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
        if stop == at + 1 and sizes[at] > CHUNK:
            keys = _long_text(np.frombuffer(values[at].as_buffer(), np.uint8))
        else:
            starts = np.cumsum(sizes[at:stop]) - sizes[at:stop]
            words = _words(np.frombuffer(b"".join(values.slice(at, stop - at).to_pylist()), np.uint8), starts)
            keys = np.unique(_grams(words.text, words.values(), _shapes(words, _again(words))))
        counts[at:stop] = np.bincount(keys >> BITS, minlength=stop - at)
        out.append((keys & ((1 << BITS) - 1)).astype(np.int32))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(counts)))


def _long_text(data: np.ndarray) -> np.ndarray:
    """The n-grams of one text of any length, piece by piece.

    A piece may end inside a word: its beginning is carried to the next piece, with the hashes and
    shapes of the MAX_N words before it. So the n-grams are those of the text in one piece, and memory
    does not grow with the text or its words.
    """
    found, start = np.zeros(0, np.int64), np.zeros(1, np.int64)
    open_word, value, shape = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK]
        words = _words(piece, start)
        if open_word is not None:
            if SPACE[piece[0]]:
                words = _joined_words(open_word, words)
            else:
                words = _joined_words(_one_word(open_word, words.cut(0, 1)), words.cut(1))
            open_word = None
        if at + CHUNK < len(data) and not SPACE[piece[-1]]:
            open_word, words = words.cut(-1), words.cut(0, -1)
        if not len(words.text):
            continue
        again = _again(words)
        again[0] = len(value) > 0 and value[-1] == words.values()[0]
        value, shape = np.concatenate((value, words.values())), np.concatenate((shape, _shapes(words, again)))
        found = np.union1d(found, _grams(np.zeros(len(value), np.int64), value, shape))
        value, shape = value[-MAX_N:], shape[-MAX_N:]
    return found


@dataclass(frozen=True)
class QualityModel:
    """Score = logistic(slope * margin + offset), margin = weights over the text's places / length."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        # Sums of each text on its own: a score does not depend on what shares the batch.
        some = np.diff(bounds) > 0
        product, square = np.zeros(len(some)), np.zeros(len(some))
        if some.any():
            first = bounds[:-1][some]
            product[some] = np.add.reduceat(self.weights[places].astype(np.float64), first)
            square[some] = np.add.reduceat(self.scale[places].astype(np.float64) ** 2, first)
        return product / np.sqrt(np.maximum(square, 1e-12)) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        margin = self.slope * self.margins(*indicators(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def log_count_ratios(places: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> np.ndarray:
    of_good = np.repeat(good, np.diff(bounds))
    size = 1 << BITS
    plus = np.bincount(places[of_good], minlength=size)
    minus = np.bincount(places[~of_good], minlength=size)
    # Shares of texts, not of n-grams: a class with longer texts is not favoured.
    ratio = np.log((plus + 1) / (good.sum() + 2)) - np.log((minus + 1) / ((~good).sum() + 2))
    ratio[plus + minus < MIN_DOCS] = 0
    return ratio.astype(np.float32)


def dual_coordinate_descent(
    places: np.ndarray, bounds: np.ndarray, good: np.ndarray, scale: np.ndarray, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights (already times the scale) and bias of the hinge-loss model; rows weigh by class."""
    rows = []
    for k in range(len(good)):
        at = places[bounds[k] : bounds[k + 1]]
        at = at[scale[at] != 0]
        value = scale[at].astype(np.float64)
        rows.append((at, value / max(np.sqrt((value**2).sum()), 1e-6)))
    sign = np.where(good, 1.0, -1.0)
    most = np.where(good, COST, COST * max(1.0, good.sum() / max(1, (~good).sum())) ** 0.5)
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(good))
    square = np.array([(v**2).sum() + 1.0 for _, v in rows])
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in draw.permutation(len(good)):
            at, value = rows[k]
            gradient = sign[k] * (weights[at] @ value + bias) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), most[k])
            step = (new - alpha[k]) * sign[k]
            if step:
                weights[at] += step * value
                bias += step
                alpha[k] = new
    return weights, bias


def logistic_curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, class), by Newton steps."""
    y = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    slope, offset = 1.0, 0.0
    design = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -40, 40)))
        gradient = design @ (y - p) - 1e-3 * np.array([slope, 0.0])
        hessian = (design * np.maximum(p * (1 - p), 1e-9)) @ design.T + 1e-3 * np.eye(2)
        move = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        slope, offset = slope + move[0], offset + move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(slope, 1e-6)), float(offset)


def fit(texts: pa.Array, good: np.ndarray) -> QualityModel:
    """Fit on texts in a fixed order; the last quarter only shapes the score."""
    places, bounds = indicators(texts)
    return fit_places(places, bounds, good)


def fit_places(places: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> QualityModel:
    zero = np.zeros(1 << BITS, np.float32)
    cut = len(good) - int(len(good) * CALIBRATE_SHARE)
    if len(set(good[:cut].tolist())) < 2:
        return QualityModel(zero, zero, 0.0, 1.0, 0.0)
    scale = log_count_ratios(places[: bounds[cut]], bounds[: cut + 1], good[:cut])
    weights, bias = dual_coordinate_descent(places, bounds[: cut + 1], good[:cut], scale)
    model = QualityModel(scale, (weights * scale).astype(np.float32), bias, 1.0, 0.0)
    rest = model.margins(places[bounds[cut] :], bounds[cut:] - bounds[cut])
    if len(set(good[cut:].tolist())) < 2:
        return model
    return QualityModel(scale, model.weights, bias, *logistic_curve(rest, good[cut:]))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT_FOLDS == 0


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled texts outside the held-out fold."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # ``sample`` rows of two numbers: a bounded broadcast. A repeated id counts once.
    rows = (
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_quality").alias("_quality"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, bounds = indicators(batch.column("text"))
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_quality").cast(pa.int32()), listed], names=["doc_id", "good", "places"]
            )

    got = rows.mapInArrow(run, "doc_id long, good int, places array<int>").toArrow()
    got = got.take(pc.sort_indices(pc.cast(got["doc_id"], pa.int64()))).combine_chunks()
    # The last rows shape the score: shuffle, as ids may follow the time of writing.
    got = got.take(pa.array(np.random.default_rng(11).permutation(len(got))))
    listed = got["places"].combine_chunks()
    if isinstance(listed, pa.ChunkedArray):
        listed = pa.concat_arrays(listed.chunks) if listed.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    return fit_places(
        listed.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes))), got["good"].to_numpy() == 1
    )


def score(documents: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) to every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_columns(batch, **{name: pa.array(shared.value.scores(batch.column(text)), pa.float64())})

    return documents.mapInArrow(run, widened(documents.schema, **{name: T.DoubleType()}))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with their own columns."""
    name = fresh(documents, "score")
    kept = score(documents, train(documents, labels), name=name).where(F.col(name) >= THRESHOLD)
    return kept.select(documents.columns)
