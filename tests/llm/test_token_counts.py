import public_tokenizers
from tokenizers import Tokenizer

from martlight.llm import token_counts as counts
from tests.llm.rows import TEXTS, documents, with_nulls

VOCABULARY = "byte_bpe_50k.json"


def answers(df):
    return counts.suffix_sums(counts.histogram(counts.lengths(df, VOCABULARY)))


def plain(sizes):
    for n in set(sizes):
        least = [x for x in sizes if x >= n]
        most = sum(x <= n for x in sizes)
        yield n, (sizes.count(n), len(least), sum(least), most, most / len(sizes), sum(min(x, n) for x in sizes))


def test_answers_are_those_of_plain_code(spark):
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    texts = TEXTS + ["some more words here " * k for k in range(0, 2500, 50)]
    sizes = [len(library.encode(t or "").ids) for t in texts]
    found = {r["n_tokens"]: tuple(r)[1:] for r in answers(documents(spark, texts, extra=True)).collect()}
    assert found == dict(plain(sizes))


def test_ranges_add_up(spark, monkeypatch):
    monkeypatch.setattr(counts, "RANGE", 7)
    sizes = [k * k % 101 for k in range(400)]
    found = counts.suffix_sums(counts.histogram(spark.createDataFrame([(s,) for s in sizes], "n_tokens long")))
    assert {r["n_tokens"]: tuple(r)[1:] for r in found.collect()} == dict(plain(sizes))


def test_limits(spark):
    sizes = [0, 3, 3, 10, 50]
    table = counts.histogram(spark.createDataFrame([(s,) for s in sizes], "n_tokens long"))
    for row in counts.at_limits(table, [1, 3, 7, 10, 99]).collect():
        limit = row["context"]
        assert row["docs_at_least"] == sum(s >= limit for s in sizes)
        assert row["truncated_total"] == sum(min(s, limit) for s in sizes)


def test_odd_rows(spark):
    assert answers(documents(spark, [])).count() == 0
    assert sum(r["docs"] for r in answers(with_nulls(spark)).collect()) == 6


def test_suffix_sums_answer_limits_that_no_document_has(spark):
    sizes = [0, 3, 3, 10, 600, 2048]
    frame = spark.createDataFrame([(s,) for s in sizes], "n_tokens long")
    found = {r["n_tokens"]: tuple(r)[1:] for r in counts.suffix_sums(counts.histogram(frame), counts.LIMITS).collect()}
    assert found.keys() == set(sizes) | set(counts.LIMITS)
    for n, row in found.items():
        least, most = [x for x in sizes if x >= n], sum(x <= n for x in sizes)
        assert row == (sizes.count(n), len(least), sum(least), most, most / len(sizes), sum(min(x, n) for x in sizes))
    empty = counts.suffix_sums(counts.histogram(frame.limit(0)), counts.LIMITS)
    assert empty.count() == 0
