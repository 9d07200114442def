import numpy as np
import pyarrow as pa

from martlight.llm import quality
from tests.compare import TEST_DATA
from tests.llm.rows import documents, with_nulls


def plain_places(text):
    """The same n-grams, one word at a time."""
    from martlight.llm.quality import _places

    words = text.encode().split()
    u64 = lambda *x: [np.array([v & (2**64 - 1)], np.uint64) for v in x]

    def value(word):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        return (sum((b + 1) * pow(int(quality.PRIME), k, 2**64) for k, b in enumerate(low)) + len(word)) % 2**64

    def shape(k):
        w = words[k]
        letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
        upper, lower = sum(65 <= b <= 90 for b in w), sum(97 <= b <= 122 for b in w)
        end = 0 if letter(w[-1]) else w[-1]
        before = w[-2] if len(w) > 1 and not letter(w[-2]) else 0
        again = k > 0 and value(words[k - 1]) == value(w)
        return (end | before << 8 | (upper > 0) << 16 | (not lower and upper > 1) << 17 | again << 18 | (len(w) == 1) << 19) + 1

    out = set()
    for k in range(len(words)):
        out.add(int(_places(*u64(value(words[k])))[0]))
        if k:
            out.add(int(_places(*u64(value(words[k - 1]), value(words[k])))[0]))
        for n in range(1, quality.MAX_N + 1):
            if k >= n - 1:
                out.add(int(_places(*u64(n, *(shape(k - j) for j in range(n))))[0]))
    return sorted(out)


def test_indicators_are_those_of_plain_code():
    texts = ["", None, "a", "The the THE cat. Sat!! | x | y", "  gaps\n\there  ", "Ünï ß!! 漢字", "no no no no no NO"]
    places, bounds = quality.indicators(pa.array(texts))
    for k, text in enumerate(texts):
        assert places[bounds[k] : bounds[k + 1]].tolist() == plain_places(text or "")


def test_texts_of_one_batch_do_not_touch_each_other():
    whole, bounds = quality.indicators(pa.array(["ab", "cd", "", "ef gh"]))
    alone = [quality.indicators(pa.array([t]))[0].tolist() for t in ("ab", "cd", "", "ef gh")]
    assert [whole[bounds[k] : bounds[k + 1]].tolist() for k in range(4)] == alone


def test_a_very_long_text_in_pieces_has_the_same_indicators(monkeypatch):
    words = " ".join(f"w{k % 977}{'!' * (k % 3)}" for k in range(3000))
    whole = quality.indicators(pa.array([words]))[0].tolist()
    monkeypatch.setattr(quality, "CHUNK", 1000)
    assert quality.indicators(pa.array(["x", words, "y"]))[0][quality.indicators(pa.array(["x"]))[1][-1] :][: len(whole)].tolist() == whole


def test_descent_reaches_the_optimum_of_the_hinge_loss():
    draw = np.random.default_rng(1)
    rows = [np.sort(draw.choice(40, 6, replace=False)).astype(np.int32) for _ in range(60)]
    good = np.array([r[0] < 5 for r in rows])
    places, bounds = np.concatenate(rows), np.arange(0, 361, 6)
    scale = np.zeros(1 << quality.BITS, np.float32)
    scale[:40] = draw.normal(size=40)
    old, quality.EPOCHS = quality.EPOCHS, 2000
    try:
        weights, bias = quality.dual_coordinate_descent(places, bounds, good, scale)
    finally:
        quality.EPOCHS = old
    sign = np.where(good, 1.0, -1.0)
    cost = np.where(good, quality.COST, quality.COST * max(1, good.sum() / (~good).sum()) ** 0.5)

    def loss(w, b):
        total = 0.5 * ((w**2).sum() + b * b)
        for k, r in enumerate(rows):
            v = scale[r].astype(float)
            v = v / np.sqrt((v**2).sum())
            total += cost[k] * max(0, 1 - sign[k] * (w[r] @ v + b))
        return total

    best = loss(weights, bias)
    for _ in range(200):
        assert loss(weights + draw.normal(size=len(weights)) * 1e-3 * (scale != 0), bias + draw.normal() * 1e-3) >= best - 1e-6


def test_held_out_accuracy(spark):
    documents_, labels = (spark.read.parquet(f"{TEST_DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_documents(documents_, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 500
    assert (found.predicted == found.quality).mean() > 0.97
    assert found[found.quality == 1].predicted.mean() > 0.98
    assert found.score.between(0, 1).all()


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(documents(spark, extra=True), labels).collect()
    assert {r["score"] for r in found} == {0.5} and {r["predicted"] for r in found} == {1}
    assert quality.score_documents(documents(spark, []), labels.limit(0)).count() == 0
    assert quality.score_documents(with_nulls(spark), labels).count() == 6
    kept = quality.keep_good(documents(spark, extra=True), labels)
    assert kept.columns == documents(spark, extra=True).columns and kept.count() == len(found)


def test_words_and_repeats_across_cuts(monkeypatch):
    texts = ["a" * 5000 + " " + "b" * 3000 + "!! x", "no " * 700, "AB," * 900 + " y " * 40, " " * 1500 + "x" * 999 + " x", "Ünï! " * 300 + "ß" * 800]
    whole = [quality.indicators(pa.array([t]))[0].tolist() for t in texts]
    for size in (3, 64, 1000):
        monkeypatch.setattr(quality, "CHUNK", size)
        places, bounds = quality.indicators(pa.array(texts))
        assert [places[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))] == whole


def test_two_words_of_megabytes_have_ten_places():
    places, _ = quality.indicators(pa.array(["a" * 2_300_000 + " " + "b" * 2_300_000 + " short"]))
    assert len(places) == len(plain_places("aa bbb short"))


def test_scores_do_not_depend_on_the_batch():
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(["alpha", "Beta", "gamma!", "|", "the", "THE"], k)) for k in draw.integers(0, 60, 300)] + ["", None]
    model = quality.fit(pa.array(texts), np.array([("|" in (t or "")) for t in texts]))
    together = model.scores(pa.array(texts)).tolist()
    assert together == [model.scores(pa.array([t]))[0] for t in texts]
    assert together[::-1] == model.scores(pa.array(texts[::-1])).tolist()


def test_scores_of_a_table_are_those_of_plain_code(spark):
    import zlib

    docs, labels = (spark.read.parquet(f"{TEST_DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marks = {}
    for row in labels.collect():
        if row["quality"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 and row["doc_id"] in texts:
            marks[row["doc_id"]] = max(row["quality"], marks.get(row["doc_id"], 0))
    assert 0 < len(marks) < quality.SAMPLE
    order = sorted(marks)
    order = [order[k] for k in np.random.default_rng(11).permutation(len(order))]
    cut = len(order) - int(len(order) * quality.CALIBRATE_SHARE)
    sets = {k: plain_places(texts[k]) for k in texts}
    seen = {1: {}, 0: {}}
    for k in order[:cut]:
        for place in sets[k]:
            seen[marks[k] == 1][place] = seen[marks[k] == 1].get(place, 0) + 1
    n = {c: sum((marks[k] == 1) == c for k in order[:cut]) for c in (0, 1)}
    scale = np.zeros(1 << quality.BITS, np.float32)
    for place in seen[0].keys() | seen[1].keys():
        good, bad = seen[1].get(place, 0), seen[0].get(place, 0)
        if good + bad >= quality.MIN_DOCS:
            scale[place] = np.log((good + 1) / (n[1] + 2)) - np.log((bad + 1) / (n[0] + 2))
    lists = [np.array(sets[k], np.int32) for k in order[:cut]]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    weights, bias = quality.dual_coordinate_descent(
        np.concatenate(lists), bounds, np.array([marks[k] == 1 for k in order[:cut]]), scale
    )

    def margin(places):
        length = sum(float(scale[p]) ** 2 for p in places) ** 0.5
        return sum(float(np.float32(weights[p] * scale[p])) for p in places) / max(length, 1e-6) + bias

    slope, offset = quality.logistic_curve(
        np.array([margin(sets[k]) for k in order[cut:]]), np.array([marks[k] == 1 for k in order[cut:]])
    )
    for row in quality.score_documents(docs, labels).collect():
        expected = 1 / (1 + np.exp(-np.clip(slope * margin(sets[row["doc_id"]]) + offset, -60, 60)))
        assert abs(row["score"] - expected) < 1e-6
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert row["predicted"] == int(row["score"] >= 0.3)
