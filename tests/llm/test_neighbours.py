import numpy as np

from martlight.llm import neighbours
from tests.compare import TEST_DATA

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(vectors, query, k):
    found = [(float(np.sqrt(((np.array(v) - np.array(vectors[query])) ** 2).sum())), i) for i, v in vectors.items()
             if i != query and len(v) == len(vectors[query])]
    return [(i, d) for d, i in sorted(found)[:k]]


def test_recall_and_exact_distances(spark):
    table = spark.read.parquet(f"{TEST_DATA}/sf0.1/embeddings.parquet")
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in table.collect()}
    found = {}
    for row in neighbours.search_embeddings(table).collect():
        found.setdefault(row["query_id"], []).append(row)
    asked = [i for i in vectors if i % 100 == 0]
    assert sorted(found) == sorted(asked)
    hits = 0
    for query in asked:
        rows = sorted(found[query], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        exact = dict(brute(vectors, query, len(vectors)))
        for row in rows:
            assert abs(row["score"] - exact[row["vec_id"]]) < 1e-12
        hits += len({r["vec_id"] for r in rows} & {i for i, _ in brute(vectors, query, 10)})
    assert hits / (10 * len(asked)) >= 0.97


def test_blocks_merge(spark):
    draw = np.random.default_rng(2)
    data = {i: draw.normal(size=12).tolist() for i in range(600)}
    rows = spark.createDataFrame(list(data.items()), "id long, vector array<double>")
    found = neighbours.nearest(rows, rows.where("id % 50 = 0"), 5, block=64, query_block=4).collect()
    got = {}
    for row in found:
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    right = sum(len(set(got[q]) & {i for i, _ in brute(data, q, 5)}) for q in got)
    assert len(got) == 12 and len(found) == 60 and right >= 57


def test_copies_tie_by_id_and_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0], 0, "x") for i in range(1, 90)]
    rows += [(100, [1.0, 2.0, 3.0], 0, "x"), (100, [1.0, 2.0, 3.0], 1, "y"), (200, [5.0, 5.0, 5.0], 0, None),
             (300, None, 0, None), (400, [0.0, 0.0, 0.0], 0, None), (500, [1.0, None, 2.0], 0, None),
             (600, [nan, 1.0, 1.0], 0, None), (700, [inf, 1.0, 1.0], 0, None), (None, [1.0, 1.0, 1.0], 0, None),
             (800, [1.0, 2.0], 0, None), (900, [], 0, None)]
    found = neighbours.search_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for row in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert by[100] == [(i, 0.0) for i in range(1, 11)]
    assert [i for i, _ in by[200]] == list(range(1, 11))
    assert set(by) == {100, 200}  # the only vector of its length has no candidates


def test_fewer_candidates_than_asked_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 1.0], 0, ""), (1, [2.0, 1.0], 0, ""), (2, [9.0, 1.0], 0, "")], SCHEMA)
    found = neighbours.search_embeddings(few).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 1.0), (2, 8.0)]
    assert neighbours.search_embeddings(few.limit(0)).count() == 0
