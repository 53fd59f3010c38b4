"""The tokenizers library's ids of whole texts, at a speed that fits a corpus.

A vocabulary file of the tokenizers library is read into tiktoken's merging code where both give the same ids, which the
file itself shows: every merge makes a token of its own, and the tokens' ids rise with the merges' ranks. Where it does
not, and for text that the fast way does not cover, the tokenizers library encodes.

- Byte-level files: the same splitting rule, special tokens found in the text. The rule looks ahead behind white space,
  for which tiktoken's matcher keeps a state per code point and panics at about a million; texts with white space longer
  than ``LONGEST_SPACE`` are the library's.
- Files with word ends: text is cut at spaces, which no token spans, and each distinct piece is encoded once while it is
  remembered. A word's end is written as a space behind the word, so that ``x</w>`` is the pair (x, space), and these
  pairs come first of all merges.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex

# Fixed value: the splitting rule of byte-level vocabularies of this kind.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space that is still the fast way's: 700,000 code points were fine, a million not.
LONGEST_SPACE = 100_000
_SPACE = re.compile(r"\s+")

# At single spaces only: of a run of spaces, all but the last are one unit.
_RUNS = regex.compile(r"(?<=[^ ])(?= [^ ])|(?<= )(?= [^ \p{White_Space}])", regex.V1)
# Letters whose case and composed forms are the same in every version of Unicode.
_PLAIN = regex.compile("[\x00-\u024f]*")
_WORD_END = "</w>"


def stretches(text: str) -> list[str]:
    """Cut before single spaces; joined again, the stretches are the text."""
    if "  " not in text:
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]
    return _RUNS.split(text)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a vocabulary file: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


class Encoder:
    """Ids of whole texts with one vocabulary file (no special tokens added, no truncation, no padding; a special
    token's string in the text is that token)."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs, ids = byte_signs(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.word_ends = spec["model"].get("end_of_word_suffix") == _WORD_END
        merges = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        made = [ids["".join(p)] for p in merges]
        self.same = made == sorted(set(made)) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ranks = {}
        for sign, i in ids.items():
            if sign in self.special:
                continue
            end = self.word_ends and sign.endswith(_WORD_END)
            data = bytes(signs[c] for c in sign.removesuffix(_WORD_END if end else "")) + b" " * end
            ranks[data] = i
        self.known: dict[str, bytes] = {}
        self.most = most
        if self.word_ends:
            self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ | ", mergeable_ranks=ranks, special_tokens={})
            self.gap = ids[next(c for c, b in signs.items() if b == 0x20)]
        else:
            self.fast = tiktoken.Encoding("units", pat_str=UNITS, mergeable_ranks=ranks, special_tokens=self.special)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces without spaces, for files with word ends; all plain ones in one call."""
        plain, parts = [], []
        for p in pieces:
            if self.same and "<|" not in p and (p.isascii() or _PLAIN.fullmatch(p)):
                low = (p if p.isascii() else unicodedata.normalize("NFC", p)).lower()
                plain.append(p)
                parts.append(low if low.isalpha() else " ".join(self.words.findall(low)))
            else:
                self.known[p] = self._library(p)
        # each word closes with a space, each piece with one more, which is a token of its own
        ids = self.fast.encode_to_numpy("".join([f"{x}  " if x else " " for x in parts]), disallowed_special=())
        ids = ids.astype("<u4")
        ends = np.flatnonzero(ids == self.gap).tolist()
        data, at = ids.tobytes(), 0
        for p, end in zip(plain, ends):
            self.known[p] = data[at:4 * end]
            at = 4 * end + 4

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.word_ends:
            cut = [t.split(" ") for t in texts]
            if len(self.known) > self.most:
                self.known = {}
            new = list(set().union(*cut).difference(self.known))
            self._learn(new)
            out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
            for piece in new:
                if len(piece) > 64:
                    del self.known[piece]
            return out
        if not self.same:
            return [self._library(t) for t in texts]
        return [self._units(t) for t in texts]

    def _units(self, text: str) -> bytes:
        if len(text) > LONGEST_SPACE and any(m.end() - m.start() > LONGEST_SPACE for m in _SPACE.finditer(text)):
            return self._library(text)
        if any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        ids = array("I", self.fast.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
