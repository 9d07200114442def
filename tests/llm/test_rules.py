from collections import Counter

from martlight.llm import rules
from tests.llm.rows import TEXTS, documents, with_nulls

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
MORE = TEXTS + [
    "a b c a b c a b c", "one two three", "one two three one two three", "x\ny\nx\n\n\n \n \nx", " wide blank word",
    "Line here.\r\nLine here.\r\nLine here.", "# * $ % & | < >", "12 34 56 ab", "no repeats " + " ".join(f"w{k}" for k in range(60)),
    "good words of text " + " ".join("abcdefghij"[k % 7 :] + chr(97 + k // 26) + chr(97 + k % 26) for k in range(90)),
]


def plain(text):
    text, words, word = text or "", [], ""
    for c in text + " ":
        if c in BLANKS:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), len(lines), sum(any(c.isalpha() for c in w) for w in words))


def test_measurements_are_those_of_plain_code(spark):
    found = {r["doc_id"]: tuple(r[m] for m in rules.MEASURES) for r in rules.ledger(documents(spark, MORE, extra=True)).collect()}
    assert found == {k: plain(t) for k, t in enumerate(MORE)}


def test_nulls_repeats_and_no_rows(spark):
    found = rules.judge_documents(with_nulls(spark)).collect()
    assert len(found) == 6 and all(r["base_failed"] and not r["kept"] for r in found)
    empty = documents(spark, []).where("false")
    assert rules.judge_documents(empty).count() == 0
    assert all(r["fails"] == r["rescued"] == 0 for r in rules.ablations(rules.ledger(empty)).collect())


def decide(failed, policy):
    return bool(failed & policy.rejects) or (failed & policy.counts).bit_count() > policy.allowed


def test_policies_and_ablations_equal_counting_rows(spark):
    # Every bit pattern once, and some often.
    rows = [(k, k) for k in range(1 << len(rules.RULES))] + [(1000 + k, k % 5) for k in range(100)]
    ledger = spark.createDataFrame(rows, "doc_id long, failed long")
    for version, policy in rules.POLICIES.items():
        kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(ledger, version).collect()}
        assert kept == {i: not decide(f, policy) for i, f in rows}
        found = {r["rule"]: tuple(r)[1:] for r in rules.ablations(ledger, version).collect()}
        assert set(found) == {n for n, b in rules.BIT.items() if b & policy.bits()}
        for name, bit in rules.BIT.items():
            if name not in found:
                continue
            without = rules.Policy(version, policy.rejects & ~bit, policy.counts & ~bit, policy.allowed)
            out = [f for _, f in rows if decide(f, policy)]
            assert found[name] == (
                sum(bool(f & bit) for _, f in rows), sum(bool(f & bit) for f in out), sum(not decide(f, without) for f in out))
    moved = {r["doc_id"] for r in rules.changed(ledger, 2, 3).collect()}
    assert moved == {i for i, f in rows if decide(f, rules.POLICIES[2]) != decide(f, rules.POLICIES[3])}
    whole = rules.patterns(ledger).first()
    assert (whole["n_docs"], whole["any_failed"], whole["all_failed"]) == (len(rows), 255, 0)


def test_every_rule_decides_on_its_own(spark):
    texts = {"symbols": "word# " * 1, "repeated_lines": "a line\n" * 4, "few_letters": "123 456 789", "long_words": "x" * 40}
    found = {r["doc_id"]: r["failed"] for r in rules.ledger(documents(spark, list(texts.values()))).collect()}
    for k, name in enumerate(texts):
        assert found[k] & rules.BIT[name], name
