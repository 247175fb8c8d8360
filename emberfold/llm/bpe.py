"""BPE encoding by backtracking, decoding by an offset table.

`WordBpe` reads a tokenizer file of the kind "word BPE": texts are normalised (NFC, lower case), cut into pieces, and a
piece's last symbol carries an end-of-word mark. A piece is encoded left to right: an Aho-Corasick automaton over all
tokens names the longest token at a place; a token is taken if it is compatible with the one before it, which a table of
pairs tells; else its next shorter prefix token is tried, and with none left the encoder steps back over the last token.
Places from which no encoding goes on are marked, so each is left once and the work is linear in the piece. A pair is
compatible if no merge of lower rank would have crossed the border between its two tokens; that is found by undoing
merges from the border outwards, and kept. The result is that of merging pairs by rank, without doing so.

Texts are cut at ASCII white space first, as no piece spans it, and what a stretch without white space gives is kept in a
cache of bounded size; texts repeat their words, so most stretches are looked up. Special tokens are found in the raw
text, as the library does.

Decoding joins the tokens' spellings, one blank between them, from one buffer of all spellings and a table of offsets.

Defined results: a null or empty text has no ids, and no ids decode to ''. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame

from .common import with_computed

VOCABULARY = "word_bpe_49k.json"
#: Stretches kept in a cache, twice: the newer ones, and those of the last time it was full.
CACHE = 200_000
LONGEST_CACHED = 64
NO_LIMIT = 1 << 40
# Latin letters: single code points in NFC, whose case every Unicode version has alike.
_latin = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")
MARKS = string.punctuation.encode()


class Cache:
    """A dictionary of bounded size: when full, it becomes the older half, and entries used again come back.

    Keys are UTF-8, as bytes split at ASCII white space alone. A stretch of letters and marks after them has the ids of its
    lowered letters, then of the marks: pieces part there.
    """

    def __init__(self, make, size: int = CACHE):
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def _made(self, key: bytes) -> bytes:
        if key.isalpha():  # ASCII letters
            return self.make(key.decode())
        word = key.rstrip(MARKS)
        if word.isalpha():
            return self[word] + self[key[len(word) :]]
        if not key.isascii() and _latin.fullmatch(text := word.decode()):
            lowered = text.lower().encode()
            if len(word) < len(key):
                return self[lowered] + self[key[len(word) :]]
            if lowered != key:
                return self[lowered]
        return self.make(key.decode())

    def __getitem__(self, key: bytes) -> bytes:
        value = self.new.get(key)
        return self.missing(key) if value is None else value

    def missing(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self._made(key)
        self.put(key, value)
        return value

    def of_text(self, text: str | bytes) -> bytes:
        """The values of all stretches of a text, one after the other.

        A-Z are lowered at once, which the library would do stretch by stretch, unless a special token might be spelled.
        """
        data = text.encode() if isinstance(text, str) else text
        keys = (data if b"<|" in data else data.lower()).split()
        found = list(map(self.new.get, keys))
        if None in found:
            found = [self.missing(k) if v is None else v for k, v in zip(keys, found)]
        return b"".join(found)

    def put(self, key: bytes, value: bytes) -> None:
        if len(key) <= LONGEST_CACHED:
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[key] = value


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints in Latin-1, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        end, letters = model["end_of_word_suffix"], _byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.piece = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        # A symbol is a byte, or 256 + a byte that ends a word; a token is a string of symbols, shifted past NUL.
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        rank = {}
        for place, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            rank.setdefault((ids[left], ids[right]), (place, ids[left + right]))
        self.size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.place = [-1] * self.size  # the rank of the merge that makes a token; -1 for symbols
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self.merged = {}
        for (a, b), (place, made) in rank.items():
            self.merged[a, b] = place
            if self.place[made] < 0:
                self.place[made], self.halves[made] = place, (a, b)
        self.automaton, symbols = ahocorasick.Automaton(), {}
        self.length = [0] * self.size
        for token, i in ids.items():
            ends = token.endswith(end) and len(token) > len(end)
            body = [self.byte_of[c] for c in (token[: -len(end)] if ends else token)]
            if ends:
                body[-1] += 256
            symbols[i] = self.spell(body)
            self.length[i] = len(body)
            self.automaton.add_word(symbols[i], i)
        self.automaton.make_automaton()
        self.reach = max(self.length)
        whole = {s: i for i, s in symbols.items()}
        self.shorter = [-1] * self.size
        for i, s in symbols.items():
            self.shorter[i] = next((whole[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in whole), -1)
        self.compatible: dict[int, bool] = {}
        self.cache = Cache(self.encode_stretch)
        spelled = [b""] * self.size
        for token, i in (model["vocab"] | self.special).items():
            spelled[i] = token.encode() + b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    @cached_property
    def library(self) -> tokenizers.Tokenizer:
        """Loaded where a text has letters that need its normaliser."""
        return tokenizers.Tokenizer.from_file(self.path)

    @staticmethod
    def spell(symbols: list[int]) -> str:
        return "".join(chr(s + 1) for s in symbols)

    def fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between the two tokens alone."""
        key = left * self.size + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        place, halves, bound = self.place, self.halves, NO_LIMIT
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < bound:
                return False
            # Undo the later of the two merges; a merge at the border that ranks before it would have come first. Of
            # equal ranks, merges go left to right.
            if place[left] < 0 and place[right] < 0:
                return True
            if place[left] > place[right]:
                bound, left = place[left], halves[left][1]
            else:
                bound, right = place[right] + 1, halves[right][0]

    def encode_piece(self, symbols: str) -> list[int]:
        length, shorter, longest, reach = self.length, self.shorter, self.automaton.iter_long, self.reach
        open_at, taken, at, end = bytearray(b"\x01") * (len(symbols) + 1), [], 0, len(symbols)
        # The automaton is given no more than a token's reach: it would read the whole rest of the piece each time.
        token = next(longest(symbols[:reach]))[1]
        while True:
            to = at + length[token]
            if open_at[to] and (not taken or self.fits(taken[-1], token)):
                taken.append(token)
                at = to
                if at == end:
                    return taken
                token = next(longest(symbols[at : at + reach]))[1]
                continue
            token_shorter = shorter[token]
            if token_shorter >= 0:
                token = token_shorter
                continue
            open_at[at] = 0
            token = taken.pop()
            at -= length[token]

    def pieces(self, text: str) -> Iterator[bytes]:
        if text.isascii():
            yield from (p.encode() for p in self.piece.findall(text.lower()))
        elif max(text) < "ɐ":  # letters whose case and class every Unicode version has alike
            yield from (p.encode() for p in self.piece.findall(unicodedata.normalize("NFC", text).lower()))
        else:
            for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
                yield bytes(self.byte_of[c] for c in p)

    def encode_stretch(self, stretch: str) -> bytes:
        ids = []
        for part in self.special_pattern.split(stretch) if "<|" in stretch else (stretch,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self.pieces(part):
                symbols = [*piece]
                symbols[-1] += 256
                ids += self.encode_piece(self.spell(symbols))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.cache.of_text(text)

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8."""
        at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(at):
            return b""
        start = self.offsets[at]
        length = self.offsets[at + 1] - start
        ends = np.cumsum(length)
        places = np.repeat(start - (ends - length), length) + np.arange(ends[-1])
        return self.buffer[places].tobytes()[:-1]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One for each Python process; executors have the file at the same path, as it comes with an installed package."""
    return WordBpe(path)


def encode_and_decode(docs: DataFrame, text: str | Column = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the column __ef_bpe, struct<ids binary, decoded string>, to the columns to keep (all by default)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def both(texts: list[str]) -> pa.Array:
        bpe = word_bpe(path)
        ids = [bpe.encode(t) for t in texts]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([bpe.decode(i).decode("utf-8", "replace") for i in ids], pa.string())], ["ids", "decoded"])

    return with_computed(docs, "__ef_bpe", "struct<ids:binary,decoded:string>", both, text, keep)
