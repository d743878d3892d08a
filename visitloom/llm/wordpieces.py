"""Exact token ids of a lower-casing word BPE (merges inside a word, an end mark on its last letter), word by word.

White space never lies inside a token of this kind, so a text's ids are the ids of its words in order. Words repeat, so
each Python worker keeps the ids of words it has met, up to ``keep`` of them. The merges run in tiktoken, whose lowest
rank first is the order of the merge list: the byte 0xFF, which no UTF-8 text holds, stands for the end mark, and a byte
with the mark ranks before every merge. Words beyond Latin, Greek and Cyrillic letters (where tables of Unicode differ),
with a sigma (whose lower case depends on its neighbours) or with a special token go through the tokenizers library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import regex

_END = b"\xff"
#: White space for str.split, but not for the tokenizer.
_CONTROLS = re.compile("[\x1c-\x1f]")
_SURE = "\u052f"


def _byte_of_sign() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordPieces:
    def __init__(self, path: str, keep: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix, signs = spec["model"]["end_of_word_suffix"], _byte_of_sign()
        self._specials = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in self._specials:
                body, end = (token.removesuffix(suffix), _END) if token.endswith(suffix) else (token, b"")
                ranks[bytes(signs[c] for c in body) + end] = number
        self._split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self._merge = tiktoken.Encoding("word", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._keep = keep

    def _by_library(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if any(s in word for s in self._specials):
            return self._by_library(word)
        if word.isascii():
            word = word.lower()
        elif max(word) > _SURE or "Σ" in word:
            return self._by_library(word)
        else:
            word = unicodedata.normalize("NFC", word).lower()
        out, parts = [], self._parts
        if word.isalpha():
            split = (word,)
        elif word[-1] in ",." and word[:-1].isalpha():
            split = (word[:-1], word[-1])
        else:
            split = self._split(word)
        for part in split:
            ids = parts.get(part)
            if ids is None:
                if len(parts) >= self._keep:
                    parts.clear()
                ids = parts[part] = array("I", self._merge(part.encode() + _END)).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _CONTROLS.search(text):
            return self._by_library(text)
        words, known = text.split(), self._words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) >= self._keep:
                    known.clear()
                ids = known[w] = self._word(w)
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """One for each Python worker, kept between its tasks."""
    return WordPieces(path)
