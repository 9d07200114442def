import random

import numpy as np
import pytest
import xxhash

from martlight.llm import simhash
from martlight.llm.components import components
from tests.compare import TEST_DATA
from tests.llm.rows import TEXTS, documents, with_nulls


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_pairs(values, most=4):
    return [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= most]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_are_those_of_plain_code(monkeypatch):
    texts = TEXTS + ["ÀÉ A\x1cB c\x0bd\x0ce", "one", "one two three", "one two three four", "a b c d e " * 40]
    for chunk in (simhash.CHUNK, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_hash_is_sparks(spark):
    value = spark.sql("select xxhash64('the cat sat on') as h").first()["h"]
    assert value & (2**64 - 1) == xxhash.xxh64_intdigest(b"the cat sat on", seed=42)


def clustered(draw, groups, size, flips):
    out = set()
    for _ in range(groups):
        centre = draw.getrandbits(64)
        for _ in range(size):
            value = centre
            for bit in draw.sample(range(64), draw.randint(0, flips)):
                value ^= 1 << bit
            out.add(signed(value))
    return sorted(out)


DESIGNS = {
    "five parts": [(list(range(k, 64, 5)), 0) for k in range(5)],
    "four parts": [(list(range(0, 16)), 1)] + [(list(range(16 * k, 16 * k + 16)), 0) for k in (1, 2, 3)],
    "three parts": [(list(range(0, 21)), 1), (list(range(21, 42)), 1), (list(range(42, 64)), 0)],
    "two parts": [(list(range(0, 20)), 2), (list(range(20, 64)), 1)],
}


@pytest.mark.parametrize("name", ["five parts", "four parts", "three parts", "two parts"])
@pytest.mark.parametrize("block,chunk", [(4096, 200_000), (5, 40)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, name, block, chunk):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    values = clustered(random.Random(9), 30, 12, 4)
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = [tuple(r) for r in simhash.link_forest(distinct, DESIGNS[name]).collect()]
    assert plain_components(edges, values) == plain_components(near_pairs(values), values)


def test_a_dense_group_leaves_few_rows(spark):
    base, values = 0x0123456789ABCDEF, set()
    draw = random.Random(10)
    while len(values) < 3000:
        value = base
        for bit in draw.sample(range(12), draw.randint(0, 4)) + draw.sample(range(40, 64), 2):
            value ^= 1 << bit
        values.add(signed(value))
    values = sorted(values)
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    parts = simhash.design(*simhash.joint_counts(distinct))
    edges = [tuple(r) for r in simhash.link_forest(distinct, parts).collect()]
    assert len(edges) < 60 * len(values)
    assert plain_components(edges, values) == plain_components(near_pairs(values), values)


@pytest.mark.parametrize("rows", [0, 1, 1000, 10**6, 10**9, 10**12])
def test_every_design_obeys_the_pigeonhole_rule(rows):
    joint = np.full((64, 64), rows // 4, np.int64)
    np.fill_diagonal(joint, rows // 2)
    parts = simhash.design(rows, joint)
    assert sum(t + 1 for _, t in parts) == simhash.MOST + 1
    bits = [b for part, _ in parts for b in part]
    assert len(bits) == len(set(bits)) and set(bits) <= set(range(64))


def test_larger_tables_get_fewer_and_wider_parts():
    def used(rows):
        joint = np.full((64, 64), rows // 4, np.int64)
        np.fill_diagonal(joint, rows // 2)
        return simhash.design(rows, joint)

    assert len(used(10**5)) > len(used(10**10))


def test_thresholds_differ_where_parts_do():
    share = np.full(64, 0.5)
    share[:16] = 0.01  # nearly constant: worth nothing as a part
    parts = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    _, thresholds = simhash.allocate(10**7, share, parts)
    assert thresholds[0] == -1 and sum(t + 1 for t in thresholds) == 5


def test_correlated_bits_share_a_part():
    draw = np.random.default_rng(3)
    bits = draw.random((4000, 64)) < 0.5
    for k in range(8):
        bits[:, 8 + k] = bits[:, k]
    joint = bits.T.astype(np.int64) @ bits.astype(np.int64)
    parts = simhash.group_bits(4000, joint, 4)
    together = sum(any(k in p and k + 8 in p for p in parts) for k in range(8))
    assert together == 8 and sorted(b for p in parts for b in p) == list(range(64))


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(11)
    edges = [(k, k + 1) for k in range(0, 150)] + [(500, 600 + k) for k in range(200)] + [(5, 5), (900, 901), (901, 900)]
    edges += [(draw.randint(1000, 1200), draw.randint(1000, 1200)) for _ in range(120)]
    wanted = plain_components(edges, {n for a, b in edges if a != b for n in (a, b)})
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_given_documents_against_all_pairs(spark):
    table = spark.read.parquet(f"{TEST_DATA}/sf0.01/documents.parquet")
    fps = {r["doc_id"]: signed(plain_fingerprint(r["text"])) for r in table.collect()}
    roots = plain_components(near_pairs(sorted(set(fps.values()))), set(fps.values()))
    smallest = {}
    for doc, fp in fps.items():
        smallest[roots[fp]] = min(doc, smallest.get(roots[fp], doc))
    found = simhash.fingerprint_documents(table).collect()
    assert len(found) == len(fps)
    for row in found:
        fp = fps[row["doc_id"]]
        assert row["fingerprint"] == f"{fp & (2**64 - 1):016x}" and row["component_id"] == smallest[roots[fp]]
    assert len(set(smallest.values())) < len(fps)


def test_odd_rows(spark):
    found = {r["doc_id"]: r for r in simhash.fingerprint_documents(documents(spark, extra=True)).collect()}
    assert {found[k]["fingerprint"] for k in (0, 1, 2)} == {"0" * 16} and found[2]["component_id"] == 0
    assert found[5]["component_id"] == 3 == found[4]["component_id"]
    assert simhash.fingerprint_documents(documents(spark, [])).count() == 0
    rows = simhash.fingerprint_documents(with_nulls(spark)).collect()
    assert len(rows) == 6 and {r["component_id"] for r in rows if r["doc_id"] is None} == {8}
    kept = simhash.keep_one(documents(spark, extra=True))
    assert kept.columns == documents(spark, extra=True).columns
    assert sorted(r["doc_id"] for r in kept.collect())[:3] == [0, 3, 6]
