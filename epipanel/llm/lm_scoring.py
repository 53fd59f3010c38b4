"""Language-model scores from a weighted backoff automaton over smoothed n-gram counts.

Model. Counts of all n-grams up to ``order`` come from the training documents. The probability of a word after a history
is smoothed by the shorter history (a hierarchical Dirichlet prior of weight ``MU``); the shortest is add-one over the
training words and one unknown::

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + MU * p(w | h')) / (c(h) + MU)        h' is h without its first word

As an automaton, every history with a count is a state. Its arcs are the words seen after it, with log10 p(w | h). Its
failure arc leads to the state of h' with weight log10(MU / (c(h) + MU)) and is taken for all other words. A text is read
once from left to right from the start state: at each token the arc, or failure arcs until one has it, adds its weight
and leads to the longest history that is a state. ``Automaton`` builds these states, arcs and failure arcs per block of texts and
walks them, many texts and stretches of long texts side by side.

Scale. The automaton grows with the corpus, so no task holds it all. Documents are dealt into blocks of about
``BLOCK_BYTES``. Each block names the n-grams it needs with its own training counts (sorted hashes, one slice per hash
range, of which there is one for each ``RANGE_BYTES`` of text); each hash range is summed over all blocks and the totals go back, in the order they came, to the blocks that asked;
a block then builds exactly the part of the automaton that its texts can reach, and reads all its texts
through it. A frequent n-gram is one entry per block, however often it occurs, so no key is hot. N-grams are told apart
by 64-bit hashes.

Tokens: A-Z in lower case, words between ASCII white space, and one end per text. Null and empty texts are the end
alone. Rows without id are held out. Repeated rows count and are scored each. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epipanel.llm.common import block_count, stage, texts, words
from epipanel.llm.hashing import hash_word, mix

ORDER, MU = 2, 300.0
BLOCK_BYTES, RANGE_BYTES, LANE = 3 << 20, 16 << 20, 512

_END, _START = np.uint64(0x656E64), np.uint64(0x7374617274)  # no word's hash but by chance
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """All tokens of a block's texts in a row. ``grams[k]`` holds at each token the key of the n-gram of k + 1 words that
    ends there; ``first`` the places of the texts' first tokens."""

    first: np.ndarray
    length: np.ndarray
    grams: list[np.ndarray]
    valid: list[np.ndarray]

    @classmethod
    def of(cls, some: list[str], order: int) -> Tokens:
        own, length = [], np.zeros(len(some), np.int64)
        for i, text in enumerate(some):
            found = words(text)
            own.append(np.fromiter(map(hash_word.__getitem__, found), np.uint64, len(found)))
            own.append(np.array([_END]))
            length[i] = len(found) + 1
        one = np.concatenate(own)
        first = np.cumsum(length) - length
        grams, valid = [one], [np.ones(len(one), bool)]
        for k in range(1, order):
            before = np.append(_START, grams[-1][:-1])
            there = np.append(False, valid[-1][:-1])
            before[first], there[first] = _START, k == 1  # longer histories do not reach over the start
            grams.append(mix(before * _STEP + one + np.uint64(k)))
            valid.append(there)
        return cls(first, length, grams, valid)

    def repeat(self, per_text: np.ndarray) -> np.ndarray:
        return np.repeat(per_text, self.length)


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and how often each occurs where ``training``."""
    distinct = np.unique(keys)
    counts = np.zeros(len(distinct), np.uint32)
    mine, n = np.unique(keys[training], return_counts=True)
    counts[np.searchsorted(distinct, mine)] = n
    return distinct, counts


def needed(tokens: Tokens, training: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and training counts of a block: of single tokens, and of the start and all longer n-grams."""
    per_token = tokens.repeat(training)
    longer = [np.full(len(training), _START)] + [g[v] for g, v in zip(tokens.grams[1:], tokens.valid[1:])]
    marks = [training] + [per_token[v] for v in tokens.valid[1:]]
    return [_counted(tokens.grams[0], per_token), _counted(np.concatenate(longer), np.concatenate(marks))]


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, so that the upper bytes, which are mostly zero, lie together and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _sliced(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash range begins among the sorted keys, and their number."""
    edges = np.array([p * ((1 << 64) // parts) for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


class Automaton:
    """The part of the automaton that a block's texts can reach.

    State 0 is the root, the empty history; the others are the block's histories with a count, the start among them. ``arcs`` holds
    ``state * words + word`` in order, with ``weight`` (log10) and ``target``. The root has an arc for every word of the block, known
    or not; ``fail`` and ``fail_weight`` lead from a state to the history without its first word.
    """

    def __init__(self, tokens: Tokens, keys: list[np.ndarray], counts: list[np.ndarray], n: int, v: int, mu: float = MU):
        names, at, self.word = np.unique(tokens.grams[0], return_index=True, return_inverse=True)
        self.words = len(names)
        own = counts[0][np.searchsorted(keys[0], names)].astype("f8")

        def count(found: np.ndarray) -> np.ndarray:
            return counts[1][np.searchsorted(keys[1], found)].astype("f8")

        # histories with a count: the start, words, and n-grams shorter than the order, each with its place in the tokens
        start = np.array([_START])
        history, seen, level = [start, names[own > 0]], [count(start), own[own > 0]], [1, 1]
        for k in range(1, len(tokens.grams) - 1):
            there = np.unique(tokens.grams[k][tokens.valid[k]])
            total = count(there)
            history.append(there[total > 0])
            seen.append(total[total > 0])
            level.append(k + 1)
        sizes = [len(h) for h in history]
        level, history, seen = np.repeat(level, sizes), np.concatenate(history), np.concatenate(seen)
        order = np.argsort(history, kind="stable")
        self._history, self._seen, self._level = history[order], seen[order], level[order]
        states = len(history) + 1
        if len(tokens.first) and self._seen[self.state(start)[0] - 1] == 0:
            self.start = 0
        else:
            self.start = int(self.state(start)[0]) if len(tokens.first) else 0
        self.fail, self.fail_weight = np.zeros(states, "i8"), np.zeros(states)
        self.fail_weight[1:] = np.log10(mu / (self._seen + mu))

        # arcs of the root, then of each longer history by way of the shorter one
        root = (own + 1) / (n + v + 1)
        arcs, weight, target = [np.arange(self.words)], [np.log10(root)], [np.where(own > 0, self.state(names), 0)]
        chance = root[self.word]  # at each token, p of its word after the history of the length at hand
        self.known, self.base = own > 0, np.log10(root)
        for k in range(1, len(tokens.grams)):
            there = tokens.valid[k]
            before = np.append(_START, tokens.grams[k - 1][:-1])
            before[tokens.first] = _START
            state = np.where(there, self.state(before), 0)
            if k < len(tokens.grams) - 1:
                reached = np.where(there, self.state(tokens.grams[k]), 0)
                shorter = self.state(tokens.grams[k - 1])
                self.fail[reached[reached > 0]] = shorter[reached > 0]
            total = np.zeros(len(there))
            total[there] = count(tokens.grams[k][there])
            held = self._seen[np.maximum(state, 1) - 1] if len(self._seen) else np.zeros(len(there))
            arc = (state > 0) & (total > 0) & (held > 0)
            chance = np.where(state > 0, np.where(arc, (total + mu * chance) / (held + mu), mu / (held + mu) * chance), chance)
            found, first = np.unique(state[arc] * self.words + self.word[arc], return_index=True)
            arcs.append(found)
            weight.append(np.log10(chance[arc][first]))
            longest = self.state(tokens.grams[k][arc][first]) if k < len(tokens.grams) - 1 else np.zeros(len(first), "i8")
            shorter = target[0][self.word[arc][first]] if k == 1 else self.state(tokens.grams[k - 1][arc][first])
            target.append(np.where(longest > 0, longest, shorter))
        arcs, weight, target = np.concatenate(arcs), np.concatenate(weight), np.concatenate(target)
        order = np.argsort(arcs, kind="stable")
        self.arcs, self.weight, self.target = arcs[order], weight[order], target[order]

    def state(self, history: np.ndarray) -> np.ndarray:
        """Numbers of the states with these histories; 0 where there is none."""
        at = np.minimum(np.searchsorted(self._history, history), max(len(self._history) - 1, 0))
        return np.where(self._history[at] == history, at + 1, 0) if len(self._history) else np.zeros(len(history), "i8")

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read a word in each of the states: the states reached and the log10 added, over failure arcs where need be."""
        state, added, open_ = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(open_):
            wanted = state[open_] * self.words + word[open_]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            hit = self.arcs[at] == wanted
            done, missed = open_[hit], open_[~hit]
            added[done] += self.weight[at[hit]]
            state[done] = self.target[at[hit]]
            added[missed] += self.fail_weight[state[missed]]
            state[missed] = self.fail[state[missed]]
            open_ = missed
        return state, added

    def read(self, tokens: Tokens, order: int, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: score, base score, tokens known.

        Many places are read side by side, each from left to right with its state carried along. A long text is read in lanes of
        ``lane`` tokens; a later lane comes in at the root some tokens earlier, enough for the state to be the one a single
        reading would have there, and counts from its own first token on.
        """
        starts = np.concatenate([np.arange(f, f + n, lane) for f, n in zip(tokens.first.tolist(), tokens.length.tolist())] or [np.zeros(0, "i8")])
        text = np.repeat(np.arange(len(tokens.first)), -(-tokens.length // lane))
        end = np.minimum(starts + lane, (tokens.first + tokens.length)[text])
        at = np.maximum(starts - (order - 1), tokens.first[text])
        state = np.where(at == tokens.first[text], self.start, 0)
        score = np.zeros(len(starts))
        by_length = np.argsort(-(end - at), kind="stable")
        steps = (end - at)[by_length]
        for i in range(int(steps[0]) if len(steps) else 0):
            live = by_length[:np.searchsorted(-steps, -i, "left")]  # lanes of more than i tokens
            here = at[live] + i
            state[live], added = self.step(state[live], self.word[here])
            score[live] += np.where(here >= starts[live], added, 0.0)
        total = lambda x: np.add.reduceat(x, tokens.first) if len(tokens.first) else np.zeros(0)
        return (np.bincount(text, score, minlength=len(tokens.first)), total(self.base[self.word]),
                total(self.known[self.word].astype(np.int64)))


def held_out(doc_id: str = "doc_id", rest: int = 2, of: int = 7):
    """True where crc32 of the id's text leaves ``rest``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == rest, F.lit(True))


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every text."""
    plain = texts(docs)
    blocks = block_count(plain, block_bytes)
    ranges = max(1, -(-blocks * block_bytes // RANGE_BYTES))
    dealt = plain.select("doc_id", "text", held_out().alias("held_out"),
                         F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def ask(group: pa.Table) -> pa.Table:
        tokens = Tokens.of(group["text"].to_pylist(), order)
        block, rows = group["block"][0].as_py(), []
        for kind, (keys, counts) in enumerate(needed(tokens, ~np.array(group["held_out"]))):
            edges = _sliced(keys, ranges)
            for part in range(ranges):
                own = slice(edges[part], edges[part + 1])
                if own.start < own.stop:
                    steps = np.diff(keys[own], prepend=np.uint64(0))
                    rows.append((part, kind, block, _planes(steps), _planes(counts[own])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["part", "kind", "block", "steps", "counts"])

    def total(group: pa.Table) -> pa.Table:
        rows = group.select(["part", "kind", "block", "steps", "counts"]).to_pylist()
        keys = [np.cumsum(_unplaned(r["steps"], np.uint64), dtype=np.uint64) for r in rows]
        counts = np.concatenate([_unplaned(r["counts"], np.uint32) for r in rows])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
        back, at, out = sums[place], 0, []
        for i, (r, own) in enumerate(zip(rows, keys)):
            # what the range adds to N and V goes with its first row
            n, v = (int(sums.sum()), int((sums > 0).sum())) if i == 0 and r["kind"] == 0 else (0, 0)
            out.append((r["block"], r["kind"], r["part"], _planes(back[at:at + len(own)]), n, v))
            at += len(own)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))],
                        ["block", "kind", "part", "totals", "n", "v"])

    asked = dealt.groupBy("block").applyInArrow(ask, "part int, kind int, block int, steps binary, counts binary")
    totals = stage(asked.groupBy("part", "kind").applyInArrow(total, "block int, kind int, part int, totals binary, n long, v long"))
    n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = Tokens.of(left["text"].to_pylist(), order)
        out = np.array(left["held_out"])
        keys = [k for k, _ in needed(tokens, ~out)]
        rows = sorted(right.select(["kind", "part", "totals"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
        counts = [np.concatenate([np.zeros(0, np.uint64), *[_unplaned(r["totals"], np.uint64) for r in rows if r["kind"] == kind]])
                  for kind in (0, 1)]
        model, base, known = Automaton(tokens, keys, counts, n, v, mu).read(tokens, order)
        return pa.table([left["doc_id"], pa.array(out), pa.array(tokens.length), pa.array(known), pa.array(np.full(len(out), n)),
                         pa.array(base), pa.array(model)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (dealt.groupBy("block").cogroup(totals.select("block", "kind", "part", "totals").groupBy("block"))
            .applyInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double"))
