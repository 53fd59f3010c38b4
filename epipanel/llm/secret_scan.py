"""Secrets in text: fixed patterns, and strings that a tokenizer cannot shorten.

Kinds, in this order: ``assign`` (a keyword given a value of 8 or more characters), ``access`` (access key ids),
``hex`` (32 or more lower-case hexadecimal digits), ``random``. The first three are patterns. ``random`` takes every
run of at least 20 of the characters that keys are written in, cuts out the spans of the other kinds, and counts the
tokens of each rest of at least 20 characters under a byte-level vocabulary: words need few tokens, random strings about
one for two characters. Rests with fewer characters per token than ``ratio`` are secrets, unless they are written as
known digests (hexadecimal, of a digest's length) or identifiers (UUIDs, dates, versions, numbers joined by dashes, drawn
lines). Nothing else is asked of a run, so names in capitals that the vocabulary splits finely are taken too; the README
gives figures.

Readable words in the same run raise its ratio. So where the whole rest is not low, every stretch of whole tokens of at
least 20 characters is held against ``ratio`` as well (``_windows``), outside of the UUIDs and digests in it; a find is
widened to the separators around it. There a separator's own token does not lower the ratio, else short words joined by
``_`` would be secrets.

Positions count code points; ends are exclusive. Null and empty texts have no spans. Repeated rows and null ids stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.llm.common import table_parts, texts

KINDS = ["assign", "access", "hex", "random"]
RATIO = 2.1
MASK = "[removed]"

# The three patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST, LEAST = 8, 16, 20
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9Z-]*"  # date and time
    r"|v?[0-9]+([-_/][0-9]+)*")  # version, number

# A UUID or hexadecimal digits, between separators or ends.
_INNER = re.compile(r"(?<![A-Za-z0-9])(?:([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])")
_SEPARATORS = "+/_=-"

Span = tuple[int, int, int]  # start, kind, end


@lru_cache(2)
def _counter(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    encoding = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return lambda text: encoding.decode_tokens_bytes(encoding.encode_ordinary(text))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _rests(start: int, end: int, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """What ``taken`` (sorted) leaves of a run, where it is long enough."""
    for s, _, e in taken:
        if s < end and start < e:
            if s - start >= LEAST:
                yield start, s
            start = max(start, e)
    if end - start >= LEAST:
        yield start, end


def _known(run: str) -> bool:
    """Whether it is an identifier or a digest, perhaps between separators."""
    inner = run.strip(_SEPARATORS)
    return bool(not inner or _IDENTIFIER.fullmatch(inner) or len(inner) in DIGEST_LENGTHS and _HEXADECIMAL.fullmatch(inner))


def _windows(tokens: list[bytes], ratio: float) -> Iterator[tuple[int, int]]:
    """Stretches of whole tokens, at least ``LEAST`` characters, whose ratio is low, in order and apart: from left to
    right the one that falls short of ``ratio`` by most until nothing falls short any more, then on behind it."""
    ends, short = [0], [0.0]  # characters up to each token, and by how many they fall short of the ratio
    for token in tokens:
        ends.append(ends[-1] + len(token))
        gap = ratio - len(token)
        short.append(short[-1] + (gap if token.strip(_SEPARATORS.encode()) else min(gap, 0)))
    start = 0
    while start < len(tokens):
        low = best = None
        most, i = 1e-9, start
        for j in range(start + 1, len(ends)):
            while i < j and ends[j] - ends[i] >= LEAST:
                if low is None or short[i] < short[low]:
                    low = i
                i += 1
            if low is not None:
                gain = short[j] - short[low]
                if gain > most:
                    most, best = gain, (low, j)
                elif best and gain <= 0:
                    break
        if best is None:
            return
        yield ends[best[0]], ends[best[1]]
        start = best[1]


def _low_parts(run: str, tokens_of, ratio: float) -> Iterator[tuple[int, int]]:
    """The whole run where its ratio is low, else the parts between separators that hold a stretch whose ratio is."""
    tokens = tokens_of(run)
    if len(run) < ratio * len(tokens):
        yield 0, len(run)
        return
    start = end = 0
    for a, b in _windows(tokens, ratio):
        while a > end and run[a] not in _SEPARATORS and run[a - 1] not in _SEPARATORS:
            a -= 1
        while b < len(run) and run[b - 1] not in _SEPARATORS and run[b] not in _SEPARATORS:
            b += 1
        if a <= end and end:
            end = max(end, b)
            continue
        if end:
            yield start, end
        start, end = a, b
    if end:
        yield start, end


def _pieces(run: str) -> Iterator[tuple[int, int]]:
    """Where the run lies between UUIDs and digests."""
    at = 0
    for m in _INNER.finditer(run):
        if m[1] or len(m[0]) in DIGEST_LENGTHS:
            yield at, m.start()
            at = m.end()
    yield at, len(run)


def random_spans(text: str, taken: list[Span], tokens_of, ratio: float = RATIO) -> list[Span]:
    """Spans of the fourth kind in what ``taken`` (sorted) leaves of the text."""
    out, i = [], 0
    for m in _RUN.finditer(text):
        while i < len(taken) and taken[i][2] <= m.start():
            i += 1
        j = i
        while j < len(taken) and taken[j][0] < m.end():
            j += 1
        for start, end in _rests(m.start(), m.end(), taken[i:j]):
            run = text[start:end]
            if _known(run):
                continue
            whole = list(_low_parts(run, tokens_of, ratio))
            if whole == [(0, len(run))]:
                out.append((start, 3, end))
                continue
            for a, b in _pieces(run) if whole else ():
                if b - a >= LEAST:
                    out += [(start + a + s, 3, start + a + e) for s, e in _low_parts(run[a:b], tokens_of, ratio)
                            if not _known(run[a + s:a + e])]
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, vocabulary: str, ratio: float = RATIO) -> DataFrame:
    """Per document ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256`` (of the spans of the first three
    kinds, ``kind:start:end`` joined by commas) and ``spans`` (all of them, joined likewise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = _counter(vocabulary)
        for batch in table_parts(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                base = base_spans(text)
                more = random_spans(text, base, tokens_of, ratio)
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), len(more),
                             hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                  ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, "
                                       "base_sha256 string, spans string")


def masked(text: str, spans: list[Span], mask: str = MASK) -> str:
    """``text`` with ``mask`` for every span; overlapping spans get one."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, vocabulary: str, ratio: float = RATIO, mask: str = MASK) -> DataFrame:
    """The documents, all columns kept, with secrets masked in ``text``; null texts stay null. ``n_chars``, where there
    is one, is the length of the new text."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = _counter(vocabulary)
        for batch in table_parts(batches):
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = base + random_spans(text, base, tokens_of, ratio)
                    text = masked(text, spans, mask) if spans else text
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.record_batch(columns, names)

    found = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return found.select(names)
