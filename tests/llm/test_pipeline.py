import corpus_pipeline
from martlight.llm import exact_dedup, packing, quality, simhash
from martlight.llm.queries import ORACLES, QUERIES
from tests.compare import TEST_DATA, difference
from tests.llm.test_simhash import near_pairs, plain_components, plain_fingerprint, signed

SF = f"{TEST_DATA}/sf0.01"


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, SF)
    scores = quality.score_documents(docs, labels).where("predicted = 1")
    assert good.columns == columns
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in scores.collect())

    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    kept = {}
    for key in sorted(rows):
        kept[exact_key(rows[key])] = key
    distinct = corpus_pipeline.exact(spark, good, SF)
    assert distinct.columns == columns and sorted(r["doc_id"] for r in distinct.collect()) == sorted(kept.values())

    fps = {k: signed(plain_fingerprint(rows[k])) for k in kept.values()}
    roots = plain_components(near_pairs(sorted(set(fps.values()))), set(fps.values()))
    first = {}
    for key, fp in fps.items():
        first[roots[fp]] = min(key, first.get(roots[fp], key))
    single = corpus_pipeline.near(spark, distinct, SF)
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    last = corpus_pipeline.packed(spark, single, SF)
    assert {r["doc_id"] for r in last.collect()} == set(first.values())


def exact_key(text):
    return exact_dedup.normalised(__import__("pyarrow").array([text]))[0].as_py()


def test_run_is_the_stages_one_after_another(spark):
    found = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in found.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert ids == {r["doc_id"] for r in docs.collect()} and 0 < len(ids) < 1000
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 4
    assert packing.CAPACITY == 2048 and simhash.MOST == 4


def test_queries_equal_their_sql(spark):
    for name, sql in ORACLES.items():
        assert difference(spark, QUERIES[name], sql, SF) is None, name


def test_stages_keep_columns_with_names_of_their_own(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, base), (1, base), (2, base), (3, base + " more"), (4, None), (None, "other words"), (5, "")]
    names = ("mark", "MARK_", "_id", "_sha", "_name", "sha", "key", "name", "_score", "score", "row", "bands", "n", "cluster", "i", "j", "piece", "bytes")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, name in enumerate(names):
        docs = docs.selectExpr("*", f"concat('{k}:', doc_id) as `{name}`")
    for stage in (corpus_pipeline.quality, corpus_pipeline.exact, corpus_pipeline.similar):
        kept = stage(spark, docs, f"{TEST_DATA}/sf0.001")
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found
        for row in found:
            expected = [None if row["doc_id"] is None else f"{k}:{row['doc_id']}" for k in range(len(names))]
            assert [row[name] for name in names] == expected
    assert corpus_pipeline.packed(spark, docs, f"{TEST_DATA}/sf0.001").count() == len(rows)
    similar = corpus_pipeline.similar(spark, docs, f"{TEST_DATA}/sf0.001")
    assert sorted((r["doc_id"] or 0) for r in similar.collect()) == [0, 1, 4]
