import hashlib
import random
import string

import pytest

from martlight.llm import exact_dedup
from tests.llm.rows import TEXTS, documents, with_nulls

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def wanted(texts):
    groups = {}
    for k, text in enumerate(texts):
        groups.setdefault((text or "").translate(LOWER), []).append(k)
    for key, ids in groups.items():
        digest = hashlib.sha256(key.encode()).hexdigest()
        for k in ids:
            yield k, max(ids), len(ids), k == max(ids), digest


def check(spark, texts):
    found = exact_dedup.duplicates(documents(spark, texts, extra=True)).collect()
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(wanted(texts))


def test_groups(spark):
    check(spark, TEXTS + ["É", "é", "THE CAT SAT ON THE MAT", "İ", "i̇"])


@pytest.mark.parametrize("seed", range(2))
def test_long_common_beginnings(spark, seed):
    draw = random.Random(seed)
    bases = ["".join(draw.choices("abc ", k=n)) for n in (63, 64, 65, 320, 1344, 5440, 21824, 21825, 90000)]
    texts = []
    for base in bases:
        texts += [base, base.upper(), base + "x", base[:-1] + "y", base]
    draw.shuffle(texts)
    check(spark, texts)


def test_texts_that_differ_only_at_the_end_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "STRIDES", (2, 4, 8))
    monkeypatch.setattr(exact_dedup, "REST_STRIDE", 16)
    texts = ["a" * n + tail for n in range(0, 120, 7) for tail in ("", "b", "c", "b")]
    check(spark, texts)


def test_odd_rows(spark):
    assert exact_dedup.duplicates(documents(spark, [])).count() == 0
    found = exact_dedup.duplicates(with_nulls(spark)).collect()
    assert len(found) == 6
    groups = {}
    for row in found:
        groups.setdefault(row["text_sha256"], []).append(row)
    for rows in groups.values():
        assert sum(r["kept"] for r in rows) == 1 and {r["group_size"] for r in rows} == {len(rows)}
    assert {r["keep_id"] for r in found} == {7, 8, 9}


def test_documents_that_stay(spark):
    df = documents(spark, TEXTS, extra=True)
    kept = exact_dedup.keep_distinct(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k for k, _, _, stays, _ in wanted(TEXTS) if stays})
    odd = exact_dedup.keep_distinct(with_nulls(spark)).collect()
    assert sorted(r["doc_id"] for r in odd) == [7, 8, 9]
    only_nulls = with_nulls(spark).where("doc_id is null")
    assert exact_dedup.keep_distinct(only_nulls).count() == 1
