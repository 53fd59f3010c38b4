"""Byte-level BPE as a streaming transducer, and its inverse.

Encoding. A text is cut into units (runs of letters, of digits, of other signs, of white space) by the vocabulary
file's own splitting rule. Inside a unit, merges apply in order of rank. The transducer reads a unit from left to right
through a window of fixed size and emits a token once no later byte can change it. How many bytes have to be seen for
that follows from the merge list alone (``lookahead``):

    Bytes appended to a string change its tokens only through a merge that takes a token ``u`` at the old end. With
    ``u`` taken, a later merge that had ``u`` (or something that begins with ``u``) on its right cannot happen, which
    frees that merge's left token, and so on. Each step is a merge of later rank than the one before, so the reach to
    the left is at most the longest such chain, weighted by the bytes of the left tokens.

Tokens that end at least that far before the window's end are final, and what follows a token boundary may be
tokenized on its own. So memory is the window, whatever the length of the unit.

Decoding. Bytes of the ids go through an incremental UTF-8 machine that keeps at most three bytes; bytes that are no
UTF-8 become U+FFFD.

Cases. Null and empty texts give no tokens and the empty text. A special token's string in the text is that token.
Rows are independent: repeated rows give repeated results, null ids stay null.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from epipanel.llm.common import Memo, table_parts, texts
from epipanel.llm.pieces import UNITS, byte_signs, stretches

NEVER = 1 << 60


class Transducer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, memo: int = 400_000, window: int = 1024):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        ids = spec["model"]["vocab"]
        self.merges: dict[tuple[int, int], int] = {}  # pair -> rank
        self.made: list[int] = []  # rank -> token
        self.bytes_of: dict[int, bytes] = {}
        for sign, i in ids.items():
            self.bytes_of[i] = bytes(signs[c] for c in sign)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = rank
            self.made.append(ids[a + b])
        self.first = {signs[c]: i for c, i in ids.items() if len(c) == 1}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.lookahead = self._lookahead()
        self.window = max(window, self.lookahead + max(map(len, self.bytes_of.values())))
        self.units = regex.compile(UNITS.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.packed = Memo(self._pack, memo)
        self.packed_unit = Memo(self._unit, memo // 2)

    def _lookahead(self) -> int:
        """Bytes after a token's end that settle it: the longest chain of ever later merges, see the module's text."""
        reach: dict[bytes, int] = {}
        most = 0
        for a, b in self.merges:  # in order of rank
            left, right = self.bytes_of[a], self.bytes_of[b]
            before = max((reach.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
            chain = len(left) + before
            if chain > reach.get(left, 0):
                reach[left] = chain
            most = max(most, chain)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a byte string, by the merge list."""
        if len(data) > 48:
            return self._merge_long([self.first[b] for b in data])
        rank_of, made = self.merges.get, self.made
        parts = list(map(self.first.__getitem__, data))
        ranks = [rank_of(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            token = parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], token), NEVER)
            if i < len(ranks):
                ranks[i] = rank_of((token, parts[i + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of candidates over a linked list."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in self.merges]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (new := (parts[left], parts[right])) in self.merges:
                    heapq.heappush(heap, (self.merges[new], left, new))
        return [p for p in parts if p >= 0]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one unit, emitted once they are final; holds a window of the unit at most."""
        start = 0
        while len(data) - start > self.window:
            piece = data[start:start + self.window]
            done, settled = 0, []
            for token in self.merge(piece):
                end = done + len(self.bytes_of[token])
                if end > len(piece) - self.lookahead:
                    break
                settled.append(token)
                done = end
            yield settled
            start += done
        yield self.merge(data[start:])

    def cut_units(self, piece: str) -> list[str]:
        """Units of a stretch. The two libraries may know different versions of Unicode; where a sign is too new for the
        older of them, the tokenizers library says which class it has."""
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            return [piece[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(piece)]
        return self.units.findall(piece)

    def _pack(self, piece: str) -> bytes:
        """Little-endian ids of a stretch of text that holds whole units."""
        units = self.cut_units(piece)
        if len(units) == 1 and len(piece) <= 64:
            return self._unit(piece)
        return b"".join(map(self.packed_unit.__getitem__, units))

    def _unit(self, unit: str) -> bytes:
        data = array("I")
        for tokens in self.stream(unit.encode("utf-8", "replace")):
            data.extend(tokens)
        if sys.byteorder == "big":
            data.byteswap()
        return data.tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian 32-bit ids, in chunks; chunks end where the text has a special token or about every 4,000 stretches."""
        for part in (self.cut.split(text) if self.cut else [text]):
            if part in self.special:
                yield np.array([self.special[part]], "<u4").tobytes()
            elif part:
                pieces = stretches(part)
                for i in range(0, len(pieces), 4096):
                    yield b"".join(map(self.packed.__getitem__, pieces[i:i + 4096]))

    def decode(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text of little-endian ids, chunk by chunk."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for chunk in chunks:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(chunk, "<u4").tolist())))
        yield machine.decode(b"", final=True)


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode every whole text, decode it again, and return the digests of both: ``doc_id``, ``n_tokens``,
    ``ids_sha256``, ``decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in table_parts(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

                def told(text=text, ids_hash=ids_hash):
                    nonlocal n
                    for chunk in machine.encode(text):
                        n += len(chunk) // 4
                        ids_hash.update(chunk)
                        yield chunk

                for piece in machine.decode(told()):
                    text_hash.update(piece.encode())
                rows.append((doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in table_parts(batches, 2 << 20):
            ids = [np.frombuffer(b"".join(machine.encode(t)), "<u4").astype("i4") for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids`` (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in table_parts(batches, 2 << 20):
            out = ["".join(machine.decode([np.array(x or [], "<u4").tobytes()])) for x in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
