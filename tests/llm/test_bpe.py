import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from martlight.llm import bpe
from martlight.llm.codec import codec, counting_codec, decoder
from tests.llm.rows import TEXTS, documents, with_nulls

VOCABULARIES = ("word_bpe_49k.json", "byte_bpe_50k.json")
CODECS = [(codec, v) for v in VOCABULARIES] + [(counting_codec, VOCABULARIES[1])]


@lru_cache
def library(vocabulary):
    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def same(make, vocabulary, texts):
    own, lib = make(vocabulary), library(vocabulary)
    ids, bounds = own.encode_batch(pa.array(texts, pa.string()))
    decoded = decoder(vocabulary).decode_batch(ids, bounds).to_pylist()
    for k, text in enumerate(texts):
        wanted = lib.encode(text or "", add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == wanted, text
        assert decoded[k] == lib.decode(wanted, skip_special_tokens=False), text


@pytest.mark.parametrize("make,vocabulary", CODECS)
def test_ids_and_text_are_the_librarys(make, vocabulary):
    draw = random.Random(3)
    letters = list("abcdefghij  \n\t '!?.$%ABCéèñßüΣσİ1239٣½漢字ǅ\x85\x1c\x0b\xa0") + [
        "<|endoftext|>", "<|startoftext|>", "'s", "'re", "the ", "ing", "  ", " \n ", "́", "😀", "ͅ", "꟎"]
    made = ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(2000)]
    same(make, vocabulary, [*TEXTS, *made, "a" * 5000, " " * 300, "\n" * 77 + " x", "ab" * 2000, "!" * 999])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    for make, vocabulary in CODECS:
        same(make, vocabulary, [text])


def test_long_text_as_a_stream(monkeypatch):
    monkeypatch.setattr("martlight.llm.codec.LONG_TEXT", 100)
    for make, vocabulary in CODECS:
        same(make, vocabulary, ["some longer text, with  gaps. " * 30, "short", "漢字 " * 90])


def test_prefix_law_equals_merging_one_pair_at_a_time():
    own = codec("byte_bpe_50k.json")
    merges, draw = own.merges, random.Random(5)
    made = {pair: token for token, pair in merges.parts.items()}
    for _ in range(500):
        word = "".join(chr(draw.choice(b"aabbcdeehilnorst ")) for _ in range(draw.randint(1, 14)))
        ids = [own.encode_symbols(c)[0] for c in word]
        while True:
            pairs = [(merges.rank[a * merges.size + b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a * merges.size + b in merges.rank]
            if not pairs:
                break
            _, k = min(pairs)
            ids[k : k + 2] = [made[ids[k], ids[k + 1]]]
        assert own.encode_symbols(word) == ids


def test_frame_keeps_other_columns_and_replaces_its_own(spark):
    df = documents(spark, extra=True)
    found = bpe.decode(bpe.encode(df, VOCABULARIES[1]), VOCABULARIES[1]).orderBy("doc_id").collect()
    assert [r["decoded"] for r in found] == [t or "" for t in TEXTS]
    lib = library(VOCABULARIES[1])
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in found] == [lib.encode(t or "").ids for t in TEXTS]
    assert found[0]["score"] == "score" and found[3]["text"] == TEXTS[3]


def test_digest_query(spark):
    lib = library(VOCABULARIES[0])
    found = bpe.encode_decode_digest(documents(spark), VOCABULARIES[0]).collect()
    for row in found:
        ids = lib.encode(TEXTS[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = lib.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(found) == len(TEXTS)
    assert bpe.encode_decode_digest(documents(spark, []), VOCABULARIES[0]).count() == 0
    assert bpe.encode_decode_digest(with_nulls(spark), VOCABULARIES[0]).count() == 6
