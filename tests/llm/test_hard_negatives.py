import numpy as np
import pytest

from martlight.llm import hard_negatives as h
from tests.compare import TEST_DATA, difference
from martlight.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, score string, id string, size int"


def brute(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in ints) < 2**62:
            one = ((label + 1) % 10 if i % 7 == 0 else label, v, ints)
            kept[i] = min(kept.get(i, one), one)
    out = []
    for a, (label, _, mine) in kept.items():
        if a % 50:
            continue
        scores = {b: (sum(x * y for x, y in zip(mine, o[2])), o[0]) for b, o in kept.items() if b != a and len(o[2]) == len(mine)}
        near = sorted((-s, b) for b, (s, other) in scores.items() if other == label)[:5]
        for s, p in near:
            far = sorted((-n, b) for b, (n, other) in scores.items() if other != label and 50 * -s <= 100 * n <= 95 * -s)[:3]
            out += [(a, p, k, b, -s, -n) for k, (n, b) in enumerate(far, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in h.mine_embeddings(df).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 3) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize("size", [1, 3, 64, 700])
def test_intervals_hold_every_score(size):
    draw = np.random.default_rng(size)
    vectors = np.floor(256 * draw.standard_normal((200, size))).astype(np.int32)
    turned = h.rotate(vectors.astype(float))
    assert np.allclose(turned @ turned.T, vectors.astype(float) @ vectors.T.astype(float))
    block = h.Codes.__new__(h.Codes)
    block.ints, block.codes = vectors, h.packed(turned >= 0)
    block.ones = np.bitwise_count(block.codes).sum(axis=1, dtype=np.int64)
    block.length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    block.aligned = np.abs(turned).sum(axis=1) / np.sqrt(size)
    block.rest = np.sqrt(np.maximum(0, block.length**2 - block.aligned**2))
    for k in range(20):
        low, high = h.Anchor(vectors[k]).intervals(block, np.arange(200))
        scores = vectors.astype(np.int64) @ vectors[k].astype(np.int64)
        assert (low <= scores).all() and (scores <= high).all()
        # The intervals say something: they are narrower than the product of the lengths.
        if size > 1:
            assert np.mean((high - low) / (2 * block.length * block.length[k])) < 0.8


def test_given_embeddings(spark):
    assert difference(spark, QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"], f"{TEST_DATA}/sf0.1") is None


def test_blocks_merge(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((6, 12))
    rows = [(i, (centres[i % 6] + draw.standard_normal(12)).tolist(), i % 6) for i in range(700)]
    monkeypatch.setattr(h, "BLOCK", 64)
    monkeypatch.setattr(h, "ANCHOR_BLOCK", 3)
    assert found(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0 + i % 3, 3.0], i % 2) for i in range(0, 120)]
    rows += [(50, [9.0, 9.0, 9.0], 1), (300, [1.0, 2.0], 0), (301, [1.0, 1.0], 0), (302, [0.7, 0.9], 1), (400, [], 1), (401, [], 0),
             (402, [], 1), (500, [0.0, 0.0, 0.0], 1), (501, [nan, 1.0, 1.0], 1), (502, [inf, 1.0, 1.0], 0), (503, [None, 1.0, 1.0], 0),
             (504, None, 1), (505, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (550, [-1.0, -2.0, -1.0], 0), (551, [1e30, 0.0, 0.0], 0),
             (600, [1e6, -1e6, 3e5], 1), (601, [5e5, 1.0, 1.0], 0), (602, [7e6, 7e6, 7e6], 1), (650, [7e5, 6e5, 5e5], -3)]
    assert found(frame(spark, rows)) == brute(rows)


def test_no_rows_and_no_negatives(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(50, [1.0, 1.0], 1), (51, [1.0, 1.0], 1)])) == []
