"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns ``(role, text)`` to a string. Nothing else is known about it. Successive prefixes of
a conversation are rendered, and consecutive outputs are compared:

* The new output is the one before with one stretch put in at its end: that stretch is the turn's span. An end mark that the template always
  puts last (the floating tail, found once by rendering what may follow the first turn) stays behind it.
* Anything else means that the template rewrote history. The output so far is closed as one sample and the new output begins the
  next one, in which only later turns count for the loss; so each learned text is learned once, in the context it was rendered in.

Inside its span a turn's text is found by rendering the turn with two different probe letters in the text's place: what the
outputs share in front and behind is the template's.

Prefixes are not rendered from the first turn on for ever: at ``2 * window`` turns the oldest are let go, down to ``window``, and the last
turn's span must be the same without them (else an error says that the template looks further back). So work is linear in the
turns and memory holds a window of turns and the part being written, however long the conversation.

``format_conversations`` shuffles once, by ``conv_id``, and each task reads its rows in order as a stream. A conversation is rendered by
one task, because each turn needs the one before; it leaves in parts of about ``PART`` characters, cut between turns.

``marked`` is the template used by the query. A turn is ``<s>[INST]role``, a line end, the text and ``[/INST]``; a turn of the learned role is its
text and ``</s>``. In texts each backslash is doubled and a backslash is put behind the first sign of each control string, so none
is left in them; ``unescaped`` undoes it. ``parsed`` reads turns back, and ``read_back`` makes the digests of whole conversations.

Cases. Null texts are empty. A null role is written as ``\\N`` and read back as null; in digests it is empty. Turns go by ``turn`` (nulls first), ties
by role and text (nulls first), so repeated rows are repeated turns. Rows without ``conv_id`` are one conversation without id. Empty tables
give no rows. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.llm.common import table_parts

Turn = tuple[str | None, str]
Template = Callable[[list[Turn]], str]

WINDOW, PART = 4, 1 << 20
LEARNED = "assistant"

_OPEN, _CLOSE, _END = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str | None) -> str:
    return "\\N" if role is None else escaped(role).replace("\n", "\\n")


def _role_back(written: str) -> str | None:
    return None if written == "\\N" else _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], written)


def marked(turns: list[Turn]) -> str:
    """The template of the query."""
    return "".join(escaped(text) + _END if role == LEARNED else f"{_OPEN}{_role(role)}\n{escaped(text)}{_CLOSE}" for role, text in turns)


def parsed(formatted: str) -> Iterator[tuple[str | None, str, int, int]]:
    """Role, text and the text's place of each turn of what ``marked`` wrote."""
    at = 0
    while at < len(formatted):
        if formatted.startswith(_OPEN, at):
            start = formatted.index("\n", at) + 1
            end = formatted.index(_CLOSE, start)
            role, after = _role_back(formatted[at + len(_OPEN):start - 1]), end + len(_CLOSE)
        else:
            start, end = at, formatted.index(_END, at)
            role, after = LEARNED, end + len(_END)
        yield role, unescaped(formatted[start:end]), start, end
        at = after


def _shared(one: str, two: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(one), len(two))
    if one[:hi] == two[:hi]:
        return hi
    while lo + 1 < hi:  # one[:lo] is shared, one[:hi] is not
        mid = (lo + hi) // 2
        if one[lo:mid] == two[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Renderer:
    """Renders one conversation turn by turn; ``add`` tells what each turn gave."""

    def __init__(self, template: Template, window: int = WINDOW, learned: str = LEARNED):
        self.template, self.window, self.learned = template, window, learned
        self.held: list[Turn] = []
        self.output, self.tail = "", ""

    def _grown(self, before: str, after: str) -> str | None:
        """What was put in before the floating tail; None when that is not all that changed."""
        body = before[:len(before) - len(self.tail)]
        if len(after) < len(before) or not after.startswith(body) or not after.endswith(self.tail):
            return None
        return after[len(body):len(after) - len(self.tail)]

    def _find_tail(self, turn: Turn, output: str) -> None:
        """What stays behind whatever follows the first turn."""
        nexts = [self.template([turn, (role, "a")]) for role in dict.fromkeys((self.learned, "user", turn[0]))]
        tail = output[min(_shared(output, x) for x in nexts):]
        self.tail = tail if all(x.endswith(tail) for x in nexts) else ""

    def _let_go(self) -> None:
        kept = self.held[-self.window:]
        now = self.template(kept)
        old, new = self._grown(self.template(self.held[:-1]), self.output), self._grown(self.template(kept[:-1]), now)
        if old is None or old != new:
            raise ValueError(f"the template looks further back than {self.window} turns")
        self.held, self.output = kept, now

    def add(self, turn: Turn) -> tuple[bool, str, tuple[int, int] | None]:
        """Whether history was rewritten; the new text (all of it then); the place in it of the turn's text if that is learned."""
        if len(self.held) >= 2 * self.window:
            self._let_go()
        now = self.template([*self.held, turn])
        if not self.held:
            self._find_tail(turn, now)
        piece = self._grown(self.output if self.held else self.tail, now)
        rewritten = piece is None
        if rewritten:
            self.tail = self.tail if now.endswith(self.tail) else ""
            piece = now[:len(now) - len(self.tail)]
        text = None
        if turn[0] == self.learned:
            one, two = (self.template([*self.held, (turn[0], probe)]) for probe in "ab")
            start = len(now) - len(self.tail) - len(piece)
            text = (_shared(one, two) - start, len(now) - _shared(one[::-1], two[::-1]) - start)
        self.output = now
        self.held.append(turn)
        return rewritten, piece, text


PARTS = ("conv_id long, sample int, start long, formatted string, last boolean, rewritten boolean, "
         "spans array<struct<turn:long,start:long,end:long,loss_start:long,loss_end:long>>")
_SPAN = pa.list_(pa.struct([(c, pa.int64()) for c in ("turn", "start", "end", "loss_start", "loss_end")]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("sample", pa.int32()), ("start", pa.int64()), ("formatted", pa.string()),
                     ("last", pa.bool_()), ("rewritten", pa.bool_()), ("spans", _SPAN)])


def _parts(turns: Iterator[Turn], template: Template, window: int, learned: str, most: int) -> Iterator[tuple]:
    """One conversation's rows without its id."""
    renderer = Renderer(template, window, learned)
    sample, start, rewritten, pieces, spans, size = 0, 0, False, [], [], 0
    for number, turn in enumerate(turns):
        tail = renderer.tail
        again, piece, text = renderer.add(turn)
        if again:  # what came before is a sample of its own
            yield sample, start, "".join(pieces) + tail, True, rewritten, spans
            sample, start, rewritten, pieces, spans, size = sample + 1, 0, True, [], [], 0
        elif size >= most:
            yield sample, start, "".join(pieces), False, rewritten, spans
            start, pieces, spans, size = start + size, [], [], 0
        at = start + size
        spans.append({"turn": number, "start": at, "end": at + len(piece), "loss_start": at + text[0] if text else None,
                      "loss_end": at + text[1] if text else None})
        pieces.append(piece)
        size += len(piece)
    yield sample, start, "".join(pieces) + renderer.tail, True, rewritten, spans


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator]]:
    """Runs of rows with one first column, each as a stream of the other columns that must be read to its end."""
    rows = (row for batch in table_parts(batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
    ahead = next(rows, None)

    def run(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            yield ahead[1:]
            ahead = next(rows, None)

    while ahead is not None:
        yield ahead[0], run(ahead[0])


def _packed(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 512, most_size: int = 4 << 20,
            size: Callable[[tuple], int] = lambda row: 64) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= most_rows or total >= most_size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(conversations: DataFrame, template: Template = marked, window: int = WINDOW, learned: str = LEARNED,
                         most: int = PART) -> DataFrame:
    """Formatted text in parts, with spans.

    A row is a part of a sample (nearly always the only one of its conversation): where it starts in the sample, whether it is the ``last``,
    whether the sample was begun because history was ``rewritten``, and its turns' ``spans`` in the sample: the whole turn, and for turns of
    the ``learned`` role the text that counts for the loss. Rows of a task are in order of conversation, sample and start.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key, *part) for key, turns in _streams(batches) for part in _parts(turns, template, window, learned, most))
        yield from _packed(rows, _SCHEMA, size=lambda row: len(row[3]))

    c = conversations
    own = c.select(c["conv_id"].cast("long").alias("conv_id"), c["role"].cast("string").alias("role"),
                   F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"), c["turn"].cast("long").alias("turn"))
    # sorting by what is left out below, so that ties have an order
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, PARTS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _READ.split(", ")])


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of each conversation, from the formatted text of ``marked`` and its spans alone.

    ``in_order``: the rows are as :func:`format_conversations` gives them; a stored table is put in order again.
    """
    def one(parts) -> tuple:
        turns, loss, n_turns, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for start, text, spans in parts:
            for role, own, _, _ in parsed(text):
                turns.update(f"{role or ''}\n{own}\n".encode("utf-8", "surrogatepass"))
                n_turns += 1
            for span in spans:
                if span["loss_start"] is not None:
                    own = unescaped(text[span["loss_start"] - start:span["loss_end"] - start])
                    loss.update(own.encode("utf-8", "surrogatepass"))
                    n_loss += len(own)
            n_chars += len(text)
        return n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(((key, *one(parts)) for key, parts in _streams(batches)), _READ_SCHEMA)

    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "sample", "start")
    return formatted.select("conv_id", "start", "formatted", "spans").mapInArrow(run, _READ)
