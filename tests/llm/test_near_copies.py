import random

import corpus_pipeline
from martlight.llm import near_copies, simhash
from tests.compare import TEST_DATA
from tests.llm.rows import documents
from tests.llm.test_simhash import plain_components


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Ids that stay, by the similarity of all pairs."""
    sets = {k: plain_shingles(t) for k, t in rows.items()}
    keys = sorted(rows)
    links = []
    for at, a in enumerate(keys):
        for b in keys[at + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 10 * small >= 8 * large and 18 * len(sets[a] & sets[b]) >= 8 * (small + large):
                links.append((a, b))
    return sorted(set(plain_components(links, keys).values()))


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_the_stage_against_all_pairs_of_given_documents(spark):
    docs = spark.read.parquet(f"{TEST_DATA}/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, f"{TEST_DATA}/sf0.01")
    assert found.columns == docs.columns
    wanted = plain_kept(rows)
    assert sorted(r["doc_id"] for r in found.collect()) == wanted
    assert 1 in wanted and not {255, 278} & set(wanted)  # similar by 0.83, seven bits apart


def test_copies_about_the_bound_in_blocks(spark, monkeypatch):
    draw = random.Random(4)
    texts = []
    for length in (40, 120, 400):
        words = [f"w{draw.randrange(10**6)}" for _ in range(length)]
        texts += [edited(draw, words, draw.randrange(length // 30 + 2)) for _ in range(50)]
    rows = dict(enumerate(texts))
    wanted = plain_kept(rows)
    assert 10 < len(wanted) < 140
    for block, pivots in ((512, 16), (7, 2)):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(near_copies, "PIVOTS", pivots)
        assert sorted(r["doc_id"] for r in near_copies.keep_one(documents(spark, texts)).collect()) == wanted


def test_repeated_and_missing_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    far = " ".join(f"v{k}" for k in range(60))
    rows = [(7, " ".join(base)), (7, near), (7, near), (7, far), (None, near), (None, "a b c"), (None, "A  b c"), (9, ""), (8, None), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.keep_one(df).collect()
    assert sorted(((r["doc_id"] or 0), len(r["text"] or "") > 5) for r in found) == [(0, False), (4, False), (7, True), (7, True)]
    assert sum(r["text"] == far for r in found) == 1
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_fingerprints_find_candidates_and_shingles_decide(spark):
    base = " ".join(f"w{k}" for k in range(60))
    texts = [base, base + " more", " ".join(f"v{k}" for k in range(60)), "a b c"]
    docs = spark.createDataFrame([(bytes([k]), t) for k, t in enumerate(texts)], "mark binary, text string")
    # No key is shared; the fingerprints of the first two differ in one bit, those of the first and third are equal.
    sketches = [(k, bytes([k]), k, 1, fp, [100 * k + b for b in range(40)]) for k, fp in enumerate((8, 9, 8, -1))]
    sketches = spark.createDataFrame(sketches, "row long, mark binary, doc_id long, n long, fp long, bands array<long>")
    found = near_copies.groups(docs, sketches)
    assert sorted((r["row"], r["component"]) for r in found.collect()) == [(0, 0), (1, 0)]


def test_fingerprint_links_and_keys_are_clustered_at_once(spark, monkeypatch):
    calls, real = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda edges: calls.append(1) or real(edges))
    monkeypatch.setattr(simhash, "components", lambda edges: calls.append(1) or real(edges))
    base = " ".join(f"w{k}" for k in range(60))
    kept = near_copies.keep_one(documents(spark, [base, base + " more", "a b c"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    assert len(calls) == 2  # candidates, verified links


def test_a_large_group_makes_few_candidate_links(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [edited(draw, words, draw.randrange(6)) for _ in range(300)] + ["a b c d e f", "a b c d e f g"]
    sketches = near_copies._sketched(spark.createDataFrame([(bytes([k % 256, k // 256]), k, t) for k, t in enumerate(texts)], "mark binary, doc_id long, text string"))
    kept = {r["row"]: list(r["bands"]) for r in sketches.collect()}
    links = [(r["a"], r["b"]) for r in near_copies._key_links(sketches).collect()]
    first = {}
    for row in sorted(kept):
        for key in enumerate(kept[row]):
            first.setdefault(key, row)
    every = {(row, first[key]) for row in kept for key in enumerate(kept[row]) if first[key] != row}
    assert plain_components(links, sorted(kept)) == plain_components(list(every), sorted(kept))
    # One link a row, and those between the rows that are a key's first.
    between = {(a, b) for a, b in links if a in set(first.values()) and b in set(first.values())}
    assert len(links) - len(between) <= len(kept) and len(links) * 3 < len(every)
