"""Byte-pair encoding by dynamic programming over prefixes, and decoding, for vocabulary files.

A text is cut into words as the vocabulary's file says; each word is encoded on its own:

1. An automaton with suffix links over all vocabulary strings yields, for each position, every token
   that is a suffix of the prefix ending there.
2. Exactly one of them is the last token of that prefix's encoding: the token that is compatible with
   the last token of the prefix before it. Two tokens are compatible if encoding their joined strings
   would not merge across the border, which their merge histories tell (``Merges.stay_apart``).
3. The token is stored per prefix, and the back-pointers give the ids of the whole word.

The cost is linear in the word's length times the tokens ending at one place, however long the word
is. Words repeat, so encoded words are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: Entries a worker's two caches, of words and of token pairs, hold at most each. Full caches start
#: anew; results do not depend on them.
CACHE_ENTRIES = 300_000
#: Longer texts are encoded word by word as a stream.
LONG_TEXT = 2_000_000
END_OF_WORD = "</w>"
#: Characters below this are split by our own pattern; others by the library's, whose Unicode tables
#: decide what a letter is.
SIMPLE_BELOW = "ɐ"
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """Merge ranks and, per token, how it grew: the chain of its last and of its first parts."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b = vocab[left], vocab[right]
            self.rank.setdefault(a * self.size + b, rank)
            self.parts.setdefault(vocab[left + right], (a, b))
        self.made = {t: self.rank[a * self.size + b] for t, (a, b) in self.parts.items()}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self.known: dict[int, bool] = {}

    def _spine(self, token: int, side: int, known: dict[int, list]) -> list:
        """(part, rank that made it, rank that used it up) from the single byte up to the token."""
        if token not in known:
            chain, end = [], NEVER
            while True:
                made = self.made.get(token, -1)
                chain.append((token, made, end))
                if made < 0:
                    break
                token, end = self.parts[token][side], made
            known[chain[0][0]] = chain[::-1]
            return known[chain[0][0]]
        return known[token]

    def crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The first parts of two neighbours that would merge across their border."""
        a, b = self._spine(left, 1, self._right), self._spine(right, 0, self._left)
        i = j = 0
        while True:
            x, x_made, x_end = a[i]
            y, y_made, y_end = b[j]
            rank = self.rank.get(x * self.size + y)
            if rank is not None:
                at = max(rank, x_made, y_made)
                # Of equal ranks the left place merges first: ours is right of x's own merge.
                if at < x_end and at <= y_end:
                    return x, y
            if x_end == NEVER and y_end == NEVER:
                return None
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens stand side by side in the encoding of their joined strings."""
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        found = self.known[left * self.size + right] = self.crossing(left, right) is None
        return found

    def reachable(self) -> set[int]:
        """Tokens that encode to themselves: nothing else merges before their last merge."""
        good = {t for t in range(self.size) if t not in self.parts}
        for token in sorted(self.parts, key=self.made.get):
            a, b = self.parts[token]
            if a in good and b in good and self.crossing(a, b) == (a, b):
                good.add(token)
        return good


class Codec:
    """Encoder of one vocabulary file (``model`` BPE over byte letters).

    ``encode`` gives what the tokenizers library gives with ``add_special_tokens=False``: strings of
    special tokens in a text become their ids. A null text is an empty text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(vocab, merges)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._lower = spec["normalizer"] is not None
        self._letters = byte_letters()
        self._unmap = {ord(c): chr(b) for c, b in self._letters.items()}
        # Word-end vocabularies drop white space; the other kind gives a word the space before it.
        self.keeps_space = not self.suffix
        split = self._split_pattern(spec["pre_tokenizer"])
        self._words = regex.compile(split)
        self._odd = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
        self._match = self._automaton(vocab)
        self._known: dict[str, bytes] = {}

    @staticmethod
    def _split_pattern(pre: dict) -> str:
        if pre["type"] == "ByteLevel" and pre["use_regex"]:
            return public_tokenizers.PATTERN
        for step in pre.get("pretokenizers", ()):
            if step["type"] == "Split" and step["invert"]:
                return step["pattern"]["Regex"]
        raise ValueError(f"pre-tokenizer not supported: {pre}")

    def _symbols(self, token: str) -> str:
        """One character per byte; the last byte of a word is shifted by 256 where word ends count."""
        ended = self.suffix and token.endswith(self.suffix) and token != self.suffix
        raw = [self._letters[c] for c in (token[: -len(self.suffix)] if ended else token)]
        if ended:
            raw[-1] += 256
        return "".join(map(chr, raw))

    def _automaton(self, vocab: dict[str, int]):
        found, good = ahocorasick.Automaton(), self.merges.reachable()
        for token, i in vocab.items():
            if i in good:
                symbols = self._symbols(token)
                found.add_word(symbols, (i, len(symbols)))
        found.make_automaton()
        return found

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one word: the last token of every prefix, then back from the end."""
        n = len(symbols)
        last = [0] * (n + 1)
        size = [0] * (n + 1)
        known, apart, base = self.merges.known, self.merges.stay_apart, self.merges.size
        for end, (token, length) in self._match.iter(symbols):
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                before = last[start]
                good = known.get(before * base + token)
                if good is None:
                    good = apart(before, token)
                if not good:
                    continue
            last[end] = token
            size[end] = length
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        found = self._known.get(word)
        if found is None:
            found = self._ids(word.encode().decode("latin-1"))
            if len(word) <= 64:
                if len(self._known) >= CACHE_ENTRIES:
                    self._known.clear()
                self._known[word] = found
        return found

    def _ids(self, symbols: str) -> bytes:
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        ids = self.encode_symbols(symbols)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain_text(self, text: str) -> bytes:
        """A text without special tokens."""
        if not text:
            return b""
        if text.isascii() or max(text) < SIMPLE_BELOW:
            if self._lower:
                text = text.lower()
            if len(text) > LONG_TEXT:
                return b"".join(self._word(m[0]) for m in self._words.finditer(text))
            return b"".join(map(self._word, self._words.findall(text)))
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return b"".join(
            self._ids(word.translate(self._unmap))
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)
        )

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self._special.search(text):
            return self._plain_text(text)
        return b"".join(
            struct.pack("<I", self.special[part]) if k % 2 else self._plain_text(part)
            for k, part in enumerate(self._special.split(text))
        )

    def _piece(self, piece: str) -> bytes:
        """Ids of what stands between two spaces (with the space before it, where that counts):
        mostly a word, often with a mark behind it."""
        text = piece.lower() if self._lower else piece
        if max(text) < SIMPLE_BELOW:
            word = text[1:] if text[0] == " " else text
            if word.isalpha():
                return self._word(text)
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return self._word(text[:-1]) + self._word(text[-1])
        return self.encode(piece)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        out = list(map(self._known.get, pieces))
        for k, found in enumerate(out):
            if found is None:
                out[k] = self._piece(pieces[k]) if pieces[k] else b""
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it (one more for the end).

        Texts are cut at spaces first: such a piece never shares a word with its neighbours, unless
        white space comes before the space; those texts are encoded whole.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.greater(pc.binary_length(texts), LONG_TEXT)
        if self.keeps_space:
            whole = pc.or_(whole, pc.match_substring_regex(texts, self._odd))
        pieces = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        begins = pieces.offsets.to_numpy().astype(np.int64)
        begins = begins - begins[0]
        coded = pieces.flatten().dictionary_encode()
        space = " " if self.keeps_space else ""
        blobs = self._pieces([space + piece for piece in coded.dictionary.to_pylist()])
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if self.keeps_space or pc.any(whole).as_py():
            # The first piece of a text has no space before it.
            firsts = begins[:-1]
            own = self._pieces(pieces.flatten().take(pa.array(firsts)).to_pylist())
            for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
                own[k] = self.encode(texts[int(k)].as_py())
            codes[firsts] = len(blobs) + np.arange(len(own))
            blobs += own
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        starts = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[codes] - (ends - counts), counts) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[begins]
        return ids, bounds


class Decoder:
    """The strings of a vocabulary file's ids; holds no more than those."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        names = {i: t for t, i in spec["model"]["vocab"].items()} | special
        shown = [names.get(i, "") for i in range(max(names) + 1)]
        self._plain = spec["decoder"] is None
        if self._plain:
            self._token = pa.array(shown, pa.string())
        else:
            letters = byte_letters()
            raw = [t.encode() if i in special else bytes(map(letters.get, t)) for i, t in enumerate(shown)]
            self._token = pa.array(raw, pa.binary())

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of ids, as the library's decode with ``skip_special_tokens=False``."""
        tokens = self._token.take(pa.array(ids.astype(np.int64)))
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens)
        if self._plain:
            return pc.binary_join(listed, " ")
        joined = pc.binary_join(listed, b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # ids that end within a character
            return pa.array([b.decode("utf-8", errors="replace") for b in joined.to_pylist()], pa.string())


class CountingCodec(Codec):
    """The same ids for byte-level vocabularies without word ends, from a library's encoder.

    For operators that need ids but whose method is not encoding. Word by word, ids are vocabulary
    ranks, which holds where ids follow the order of the merges.
    """

    def __init__(self, path: str):
        super().__init__(path)
        if self.suffix or self._lower:
            raise ValueError("byte-level vocabulary without word ends expected")

    def _piece(self, piece: str) -> bytes:
        if max(piece) < SIMPLE_BELOW and "<|" not in piece:
            ids = self._ordinary(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self._known) >= CACHE_ENTRIES:
                    self._known.clear()
                self._known[piece] = found
            return found
        return self.encode(piece)

    def _ids(self, symbols: str) -> bytes:
        ids = self._match(symbols)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _automaton(self, vocab: dict[str, int]):
        ranks = {bytes(map(self._letters.get, t)): i for t, i in vocab.items()}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ordinary = own.encode_ordinary
        return lambda symbols: own._encode_single_piece(symbols.encode("latin-1"))


def _path(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


@lru_cache(maxsize=4)
def codec(vocabulary: str) -> Codec:
    """The worker's own codec of a vocabulary, by file name or path."""
    return Codec(_path(vocabulary))


@lru_cache(maxsize=4)
def decoder(vocabulary: str) -> Decoder:
    return Decoder(_path(vocabulary))


@lru_cache(maxsize=4)
def counting_codec(vocabulary: str) -> CountingCodec:
    return CountingCodec(_path(vocabulary))
