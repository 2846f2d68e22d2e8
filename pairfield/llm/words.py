"""Encoding with a tokenizer of the tokenizers library that drops white space.

Such a tokenizer never joins two words, so each distinct word of a batch is
encoded once and the ids are dealt out again by position. Simple words (ASCII
and Latin letters) go through the library's BPE model piece by piece, with a
cache; all others through its whole pipeline.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps, and half of the words.
CACHED = 400_000


@lru_cache(maxsize=2)
def encoder(path: str, ordinary_specials: bool = False) -> WordEncoder:
    return WordEncoder(path, ordinary_specials)


class WordEncoder:
    def __init__(self, path: str, ordinary_specials: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = ordinary_specials
        self.model = self.tokenizer.model
        with open(path) as f:
            said = json.load(f)
        self.pieces = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.simple = regex.compile("[!-~À-ÖØ-öø-ɏ]+").fullmatch
        # bytes as the letters that byte-level vocabularies write them with
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = self.known[piece] = array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def word(self, word: str) -> bytes:
        """The ids of a word, as uint16."""
        if not self.simple(word) or "<|" in word:
            ids = array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            low = word.lower()
            if low.isalpha():
                ids = self.piece(low)
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                ids = self.piece(low[:-1]) + self.piece(low[-1])
            else:
                ids = b"".join(map(self.piece, self.pieces(low)))
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def renewed(self, word: str) -> bytes:
        if (ids := self.before.get(word)) is None:
            return self.word(word)
        self.words[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) in a row, and the count of each text."""
        if len(self.known) >= CACHED:
            self.known.clear()
        if len(self.words) >= CACHED:  # words not met again since the last time are forgotten
            self.words, self.before = {}, self.words
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = parts.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        get, renewed = self.words.get, self.renewed
        # no word holds a space: one long text is split faster than an array is listed
        listed = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.string()))
        distinct = pc.binary_join(listed, " ")[0].as_py().split(" ") if len(words.dictionary) else []
        made = [renewed(w) if (ids := get(w)) is None else ids for w in distinct]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) >> 1
        ids, ends = spread(np.frombuffer(b"".join(made), np.uint16), sizes, codes)
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


def spread(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat (of these sizes) that codes name, one after the other, and where each ends."""
    n = sizes[codes]
    ends = np.cumsum(n)
    first = (np.cumsum(sizes) - sizes)[codes]
    at = np.repeat(first - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends
