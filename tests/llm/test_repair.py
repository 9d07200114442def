import hashlib
import itertools
import re
import zlib

import pytest

from martlight.llm import repair as r
from tests.compare import TEST_DATA

SCHEMA = "conv_id long, turn long, role string, text string, kinds string, n int, digest string"
PRICE = {"K": 0, "R": 2, "D": 3, "I": 2}


def fits(slots):
    """Whether one letter of each slot can spell a legal string: there is one of each length but 1."""
    n = len(slots)
    legal = "s" * (n % 2) + "ua" * (n // 2)
    return n != 1 and all(x in slot for x, slot in zip(legal, slots))


def brute(kinds):
    """Least (cost, edits) of all edit strings with up to two inserts in a place, by trying them."""
    best = None
    for picks in itertools.product(*["D" if k == "x" else "KRD" for k in kinds]):
        for inserts in itertools.product((0, 1, 2), repeat=len(kinds) + 1):
            slots = []
            for before, pick, kind in zip(inserts, picks, kinds):
                slots += ["ua"] * before + {"K": [kind.lower()], "R": ["ua"], "D": []}[pick]
            if not fits(slots + ["ua"] * inserts[-1]):
                continue
            edits = "".join("I" * b + p for b, p in zip(inserts, picks)) + "I" * inserts[-1]
            cost = sum(PRICE[e] for e in edits)
            cost += sum(k.isupper() and p != "D" for k, p in zip(kinds, picks))
            best = min(best or (cost, edits), (cost, edits))
    return best


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_all_short_conversations(size):
    for kinds in itertools.product(r.KINDS, repeat=size):
        assert r.repair("".join(kinds)) == brute(kinds), kinds


def test_longer_conversations_span_blocks():
    for kinds in ("ssuu", "aUxa", "oxSu", "uauu", "Aasx", "suaux", "uuauA", "xxaas"):
        assert r.repair(kinds) == brute(kinds), kinds


def test_blocks_equal_single_rows():
    own = r.tables()
    assert len(own.vectors) < 64
    kinds = "suaUxoAuuaasSOxu" * 40
    vector, total = 0, 0
    for kind in reversed(kinds):
        vector, cost = own.one[kind][vector]
        total += cost
    assert own.backward(0, kinds)[1:] == (vector, total)


def plain(rows):
    """conv_id -> result of the contract, row by row."""
    out = {}
    for conv in {x[0] for x in rows}:
        damaged = []
        for _, turn, role, text in [x for x in rows if x[0] == conv]:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(key.encode()) % 20
            if fault == 0:
                continue
            if fault == 1:
                text = ""
            if fault == 2:
                text = re.sub("[.!?]", "", text)
            if fault == 4:
                role = "user"
            damaged += [(turn, role, text)] * (2 if fault == 3 else 1)
        order = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest())
        damaged.sort(key=order)
        counts, kinds, seen = dict.fromkeys(r.COUNTS, 0), "", set()
        for turn, role, text in damaged:
            body = text.rstrip(r.BLANKS)
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not body:
                kind, counts["blank"] = "x", counts["blank"] + 1
            elif (role, text) in seen:
                kind, counts["duplicate"] = "x", counts["duplicate"] + 1
            elif body[-1] not in ".!?":
                kind, counts["truncated"] = kind.upper(), counts["truncated"] + 1
            kinds += kind
            seen.add((role, text))
        for a, b in zip(damaged, damaged[1:]):
            counts["illegal"] += a[1][:1] + b[1][:1] not in ("su", "ua", "au")
        turns = {x[0] for x in damaged} - {None}
        cost, audit = r.repair(kinds)
        text = "\n".join(r.lines(audit, r.START, [x[1] for x in damaged], [x[2] for x in damaged]))
        out[conv] = counts | {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }
    return out


def results(df):
    rows = [x.asDict() for x in r.repair_conversations(df).collect()]
    out = {x.pop("conv_id"): x for x in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_conversations(spark, sf):
    table = spark.read.parquet(f"{TEST_DATA}/sf{sf}/conversations.parquet")
    rows = [tuple(x) for x in table.select("conv_id", "turn", "role", "text").collect()]
    assert results(table) == plain(rows)


def odd_rows():
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (7, None, "user", "a."),
            (7, None, "assistant", "b"), (8, 1, "", "no role."), (8, 5, "tool", "x" * 20000), (9, 2, "user", None),
            (10, -5, "system", "  blank to some."), (10, 2**62, "user", "Far?"), (11, 1, "User", "Capital.")]
    for turn in range(300):
        rows.append((1, turn // 3, ("user", "assistant", "system", "tool")[turn * 7 % 4], ("Same.", f"Text {turn}", "", f"Ends {turn}!")[turn * 5 % 4]))
    rows += [(2, 4, "user", "again and again.")] * 200
    return rows


def test_odd_rows_and_segments(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], SCHEMA)
    assert results(df) == plain(rows)
    # The same rows when conversations are cut into small segments.
    monkeypatch.setattr(r, "SEGMENT", 7)
    cut = r._segments

    def small(schema):
        run = cut(schema)

        def inner(batches):
            r.SEGMENT = 7
            yield from run(batches)

        return inner

    monkeypatch.setattr(r, "_segments", small)
    assert results(df) == plain(rows)


def test_no_rows(spark):
    assert results(spark.createDataFrame([], SCHEMA)) == {}


def test_conversation_whose_rows_are_all_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    found = results(spark.createDataFrame([(conv, 1, "user", "Hi.", "", 1, "")], SCHEMA))
    assert found[conv] == dict.fromkeys(("gaps", *r.COUNTS, "cost"), 0) | {
        "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
