import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from martlight.llm import sharding
from tests.llm.rows import TEXTS, documents, with_nulls


def gapless(rows):
    slots = {}
    for row in rows:
        slots.setdefault(row["shard"], []).append(row["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_counts_differ_by_one_and_slots_have_no_gaps(spark):
    df = spark.range(5003).withColumnRenamed("id", "key")
    found = sharding.shard_rows(df, "key", 24).collect()
    counts = Counter(r["shard"] for r in found)
    assert len(found) == 5003 and len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1
    assert gapless(found) and {r["key"] for r in found} == set(range(5003))


def test_overflow_goes_clockwise_one_row_at_a_time():
    draw = random.Random(4)
    owner = sharding.ring(5, 16)
    counts = {draw.randrange(sharding.CELLS): draw.randint(1, 9) for _ in range(300)}
    room = sharding.capacities(sum(counts.values()), 5, 0)
    free, wanted = list(room), Counter()
    late = []
    for cell in sorted(counts):
        for _ in range(counts[cell]):
            if free[owner[cell]]:
                free[owner[cell]] -= 1
                wanted[cell, owner[cell]] += 1
            else:
                late.append(cell)
    for cell in late:
        at = cell
        while not free[owner[at % sharding.CELLS]]:
            at += 1
        free[owner[at % sharding.CELLS]] -= 1
        wanted[cell, owner[at % sharding.CELLS]] += 1
    runs = sorted(sharding.settle(counts, owner, room))
    got = Counter()
    for k, (cell, rank, shard, _) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == cell else counts[cell]
        got[cell, shard] += end - rank
    assert got == wanted


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(20000).withColumnRenamed("id", "key")
    found = sharding.shard_rows(df, "key", 24, slack=0.05, grown=True)
    moved = found.where("shard <> grown_shard").count() / 20000
    into_new = found.where("grown_shard = 24").count() / 20000
    assert 0.02 < into_new and moved < 0.2


def test_a_repeated_key_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAVY_ROWS", 50)
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"), "id")
    found = sharding.shard_rows(df, "key", 7).collect()
    counts = Counter(r["shard"] for r in found)
    assert len(found) == 3000 and len({r["id"] for r in found}) == 3000 and gapless(found)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_documents_query(spark):
    found = sharding.shard_documents(documents(spark, extra=True)).collect()
    for row in found:
        raw = (TEXTS[row["doc_id"]] or "").encode()
        assert row["size"] == len(raw) + 8 and row["text_crc32"] == zlib.crc32(raw)
        assert row["law"] == "rows" and row["grown_shard"] is None and 0 <= row["shard"] < 24
    assert gapless(found)
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    assert gapless(sharding.shard_documents(with_nulls(spark)).collect())
