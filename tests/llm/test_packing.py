import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from martlight.llm import packing
from tests.llm.rows import TEXTS, documents, with_nulls


def settle(plan):
    """Every place of the plan, checked: sequences are filled without gaps."""
    sequences, counts = {}, Counter()
    for length, rank, first, offset, rows in plan.places:
        counts[length] += rows
        for k in range(rows):
            sequences.setdefault(first + k, []).append((offset, length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert sorted(sequences) == list(range(plan.sequences))
    return counts


def test_plans_hold_every_piece_once():
    draw = random.Random(6)
    cases = [{}, {1: 1}, {2048: 3}, {2047: 2, 1: 2}, {1500: 7, 700: 20}, {1025: 100}, {513: 9}, {512: 9}]
    cases += [Counter(draw.choices(range(1, 2049), k=n)) for n in (3, 50, 2000)]
    cases += [Counter(draw.choices(range(300, 1200), k=800)), Counter(draw.choices([5, 700, 701, 2048], k=900))]
    for counts in cases:
        assert settle(packing.plan(dict(counts))) == Counter(counts)


def test_close_to_the_lower_bound():
    draw = random.Random(7)
    counts = Counter(min(2048, 1 + int(draw.expovariate(1 / 600))) for _ in range(20000))
    used, tokens = packing.plan(dict(counts)).sequences, sum(a * b for a, b in counts.items())
    assert used <= 1.005 * -(-tokens // 2048)


def test_perfect_pairs_are_found():
    counts = Counter()
    for k in range(600, 1024):
        counts[k] += 10
        counts[2048 - k] += 10
    assert packing.plan(dict(counts)).sequences <= 1.02 * 424 * 10


def test_knapsack_is_exact():
    draw = np.random.default_rng(8)
    for _ in range(60):
        sizes = np.sort(draw.choice(np.arange(26, 101), 6, replace=False))[::-1]
        values = draw.random(6)
        best = 0.0
        for a in range(-1, 6):
            for b in range(-1, 6):
                for c in range(-1, 6):
                    some = [x for x in (a, b, c) if x >= 0]
                    if sizes[some].sum() <= 100:
                        best = max(best, values[some].sum())
        worth, taken = packing.knapsack(sizes, values, 100)
        assert abs(worth - best) < 1e-12 and abs(values @ taken - best) < 1e-12 and sizes @ taken <= 100


def test_groups_have_equal_cardinality():
    groups = packing.linear_groups({900: 5, 800: 11, 700: 2, 600: 6}, 4)
    assert [sum(n for _, n in g) for g in groups] == [6, 6, 6, 6]
    assert groups[0] == [(900, 5), (800, 1)] and groups[3] == [(600, 6)]


def check_rows(rows, texts, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for row in rows:
        pieces.setdefault(row["doc_id"], []).append(row)
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    assert sorted(pieces) == list(range(len(texts)))
    for key, text in enumerate(texts):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for n, row in enumerate(sorted(pieces[key], key=lambda r: r["piece"])):
            assert row["piece"] == n and row["start"] == at
            assert row["ids_crc32"] == zlib.crc32(ids[at : at + row["length"]].tobytes())
            assert row["length"] == capacity or n == 0
            at += row["length"]
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_documents_are_cut_and_packed(spark):
    check_rows(packing.pack(documents(spark, extra=True)).collect(), TEXTS, packing.CAPACITY)
    texts = ["some words " * k for k in range(120)]
    check_rows(packing.pack(documents(spark, texts), capacity=64).collect(), texts, 64)


def test_odd_rows(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    rows = packing.pack(with_nulls(spark)).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6
