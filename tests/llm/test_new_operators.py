"""Lexical search, chat formatting and whitening against brute force and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare

from epipanel.llm import chat, lexical, queries, whitening

DOCS = "doc_id long, text string, rank int, score long, terms string, question long"
WORDS = [f"w{i}" for i in range(60)] + ["Über", "naïve", "的确", "X9"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "x", None) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "item_id long, text string, doc_id long")


def ranked(docs, asked, k=10):
    """Every document scored for every item, by the formulas."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: word.findall((t or "").translate(lower))
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, length = len(own), sum(x for _, _, x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = set()
    variants = {}
    for item, text in sorted(set(asked), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        variant = variants.get(item, 0)
        variants[item] = variant + 1
        scored = []
        for i, c, size in own:
            m = 100 - 75 + (75 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, variant, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])}
    return out


def found(df):
    return sorted(((r["item_id"], r["variant"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search_is_brute_force_on_odd_rows(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(WORDS[:4] if i % 3 else WORDS, k=rng.randint(1, 40)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, " .,- "), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (903, "Über naïve 的确")]
    rows += [(904, "w1 " * 30_000 + "w59"), (905, "x" * 100_000)]
    asked = [(1, "w1 w2 w2 W3"), (2, "w59, w58; über 的确"), (3, ""), (4, None), (5, "nothing here"), (6, "w0 w1 w2 w3"), (6, "w10 w11"), (6, "w10 w11"),
             (None, "x9 naïve")]
    got = lexical.search(documents(spark, rows), items(spark, asked))
    assert found(got) == sorted(ranked(rows, asked), key=str)
    assert len(found(lexical.search(documents(spark, rows), items(spark, asked), k=3))) <= 3 * 7


def test_search_of_empty_tables(spark):
    assert lexical.search(documents(spark, []), items(spark, [(1, "a")])).count() == 0
    assert lexical.search(documents(spark, [(1, "a")]), items(spark, [])).count() == 0


def test_question_blocks(spark, monkeypatch):
    """Many small blocks of questions, and blocks of one question too large for any, give the same rows."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=20))) for i in range(60)]
    asked = [(i, " ".join(rng.choices(WORDS, k=6))) for i in range(9)]
    whole = found(lexical.search(documents(spark, rows), items(spark, asked)))
    monkeypatch.setattr(lexical, "MOST_PAIRS", 80)
    assert found(lexical.search(documents(spark, rows), items(spark, asked))) == whole
    monkeypatch.setattr(lexical, "MOST_PAIRS", 1)
    assert found(lexical.search(documents(spark, rows), items(spark, asked[:3]))) == [x for x in whole if x[0] < 3]


def _shard(rows, asked, block):
    """One shard built in this process, by the same steps."""
    questions = lexical.Questions(asked)
    spread = {}

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            spread["run"] = run
            return self

    own = [(i, Counter(t)) for i, t in rows]
    vocabulary = questions.vocabulary
    kept = [(i, [(vocabulary[t], n) for t, n in sorted(c.items(), key=lambda x: vocabulary.get(x[0], -1)) if t in vocabulary], sum(c.values()))
            for i, c in own]
    kept = [x for x in kept if x[1]]
    df = Counter(t for _, c, _ in kept for t, _ in c)
    n, length = len(own), sum(sum(c.values()) for _, c in own)
    weight = lexical.weights(n, np.array([df[i] for i in range(len(vocabulary))]))
    import pyarrow as pa
    arrays = (np.array([i for i, _, _ in kept], "i8"), np.ones(len(kept), "u1"), np.array([s for _, _, s in kept], "i8"),
              np.append(0, np.cumsum([len(c) for _, c, _ in kept])).astype("i8"), np.array([t for _, c, _ in kept for t, _ in c], "i4"),
              np.array([x for _, c, _ in kept for _, x in c], "i4"))
    batch = pa.record_batch(lexical._ints(*arrays), ["ids", "named", "sizes", "starts", "terms", "tf"])
    lexical.index(Frame(), questions, n, length, weight, block)
    row = next(spread["run"](iter([batch]))).to_pylist()[0]
    return questions, weight, lexical.Shard(row)


def test_blocks_hold_their_summaries_and_are_skipped():
    rng = random.Random(3)
    topics = [[f"t{a}_{i}".encode() for i in range(30)] for a in range(8)]
    rows = [(i, rng.choices(topics[i % 8], k=30) + [b"the"] * rng.randint(1, 3)) for i in range(1600)]
    asked = [(a, 0, dict(Counter(rng.choices(topics[a], k=12) + [b"the"]))) for a in range(8)]
    questions, weight, shard = _shard(rows, asked, 32)
    vectors = np.zeros((len(shard.ids), len(weight)), "i8")
    for d in range(len(shard.ids)):
        lo, hi = shard.starts[d], shard.starts[d + 1]
        vectors[d, shard.terms[lo:hi]] = shard.impacts[lo:hi]
    shared = questions.coordinates()
    for i, name in enumerate(shard.list_terms.tolist()):
        members = []
        for b in range(shard.list_blocks[i], shard.list_blocks[i + 1]):
            docs = shard.posts[shard.block_posts[b]:shard.block_posts[b + 1]]
            assert 0 < len(docs) <= 32
            members += docs.tolist()
            lo, hi = shard.block_sums[b], shard.block_sums[b + 1]
            summary = np.zeros(len(weight), "i8")
            summary[shard.sum_terms[lo:hi]] = shard.sum_most[lo:hi]
            want = np.zeros(len(weight), "i8")
            want[shared[name]] = vectors[docs].max(0)[shared[name]]
            assert (summary == want).all()
        assert sorted(members) == np.flatnonzero(vectors[:, name]).tolist()
    worth, blocks = np.zeros(len(weight), "i8"), len(shard.block_posts) - 1
    for own, times in zip(questions.terms, questions.times):
        docs, scores, scored = shard.top(own, weight[own] * times, worth, 10, 1)
        whole = vectors[:, own] @ (weight[own] * times)
        best = np.lexsort((shard.ids, -whole))[:10]
        assert sorted(zip(-scores, shard.ids[docs])) == sorted(zip(-whole[best], shard.ids[best]))
        lists = np.isin(shard.list_terms, own)
        assert scored < 0.5 * np.diff(shard.list_blocks)[lists].sum() < blocks
        assert not worth.any()


# Chat formatting

def chatml(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def with_end(turns):
    """Always closed by an end mark."""
    return "<s>" + "".join(f"[{r}] {t} " for r, t in turns) + "</s>"


def forgetful(turns):
    """Drops thoughts of all answers but those behind the last question."""
    last = max([i for i, (r, _) in enumerate(turns) if r == "user"], default=-1)
    return "".join(f"<{r}>{re.sub('<think>.*?</think>', '', t) if i < last else t}</{r}>" for i, (r, t) in enumerate(turns))


def counted(turns):
    """Says how many turns there were, so every output differs from the one before."""
    return f"{len(turns)}:" + chatml(turns)


TURNS = [("user", "hi <s>"), ("assistant", "</s>a\\b[INST]"), (None, ""), ("assistant", ""), ("tool\nx", "[/INST]"), ("assistant", "ab"), ("user", "a")]


def parts(turns, template, window=4, most=1 << 20):
    return list(chat._parts(iter(turns), template, window, "assistant", most))


@pytest.mark.parametrize("template", [chatml, with_end, chat.marked])
@pytest.mark.parametrize("most", [1, 1 << 20])
@pytest.mark.parametrize("window", [1, 2, 50])
def test_windows_and_parts_give_the_whole_output(template, window, most):
    turns = TURNS * 5 + [("assistant", "<"), ("assistant", "a"), ("user", "[")]
    rows = parts(turns, template, window, most)
    assert "".join(r[2] for r in rows) == template(turns)
    assert [r[3] for r in rows] == [False] * (len(rows) - 1) + [True] and not any(r[4] for r in rows)
    spans = [s for r in rows for s in r[5]]
    whole, place = template(turns), 0
    assert [s["turn"] for s in spans] == list(range(len(turns)))
    for (role, text), span in zip(turns, spans):
        assert span["start"] == (place if place or template is not with_end else 0)
        place = span["end"]
        own = None if span["loss_start"] is None else whole[span["loss_start"]:span["loss_end"]]
        want = None if role != "assistant" else chat.escaped(text) if template is chat.marked else text
        assert own == want


def test_rewritten_history_opens_a_new_sample():
    turns = [("user", "q"), ("assistant", "<think>x</think>one"), ("user", "r"), ("assistant", "<think>y</think>two"), ("assistant", "three")]
    rows = parts(turns, forgetful)
    assert [(r[0], r[4]) for r in rows] == [(0, False), (1, True)]
    assert rows[0][2] == forgetful(turns[:2]) and rows[1][2] == forgetful(turns)
    learned = [r[2][s["loss_start"]:s["loss_end"]] for r in rows for s in r[5] if s["loss_start"] is not None]
    assert learned == [t for r, t in turns if r == "assistant"]


def test_templates_that_look_far_back_are_refused():
    def numbered(turns):
        return "".join(f"{i}{r}:{t};" for i, (r, t) in enumerate(turns))

    assert parts(TURNS, numbered, 50)[0][2] == numbered(TURNS)
    with pytest.raises(ValueError):
        parts(TURNS * 3, numbered, 2)
    assert len(parts(TURNS, counted)) == len(TURNS)


@pytest.mark.parametrize("text", ["", "\\", "\\\\s", "<\\s>", "<s></s>[INST][/INST]", "<</s>", "a\nb", "[[INST]", "\\<s>\\"])
def test_escapes(text):
    written = chat.escaped(text)
    assert chat.unescaped(written) == text and not any(x in written for x in ("<s>", "</s>", "[INST]", "[/INST]"))
    for role in ("user", "assistant", text, None):
        assert [x[:2] for x in chat.parsed(chat.marked([(role, text), ("user", text)]))] == [(role, text), ("user", text)]


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "assistant", "</s>"),
            (3, 0, "assistant", "long " * 400_000), (3, 1, "user", "[INST]")] + [(4, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(3000)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, start int, spans string")
    formatted = chat.format_conversations(table, most=2000)
    for got in (chat.read_back(formatted, in_order=True), chat.read_back(formatted)):
        got = {r["conv_id"]: r for r in got.collect()}
        assert set(got) == {1, 2, 3, 4, None}
        for key, row in got.items():
            own = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: (r[0] is not None, r[0] or 0))
            text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)
            loss = "".join(t or "" for _, r, t in own if r == "assistant")
            assert (row["n_turns"], row["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
            assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert row["formatted_chars"] == len(chat.marked([(r, t or "") for _, r, t in own]))
    assert chat.format_conversations(table.limit(0)).count() == 0 == chat.read_back(chat.format_conversations(table.limit(0))).count()


# Whitening

@pytest.mark.parametrize("values", [[3.0, 1.0], [5, 5, 5, 1, 1], [1e6, 1, 1e-6, 0, 0], [2, 2, 2], list(range(40)), [0, 0], [-3, 4, 0.5, -3]])
def test_components_of_known_matrices(values):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0]
    a = (q * np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.components(a)
    size = max(1.0, np.abs(values).max())
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-13 * size * n)
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 * n and np.abs(a @ v - v * e).max() < 1e-13 * size * n
    some = whitening.components(a, 2)[0]
    assert np.allclose(some, e[:2], atol=1e-13 * size * n)


def test_polar_factor():
    a = np.random.default_rng(0).standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    e, v = np.linalg.eigh(a)
    assert np.abs(u - (v * np.sign(e)) @ v.T).max() < 1e-12


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, x string")


def whitened(rows, scale=64, most=16):
    """By the plain eigendecomposition."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(scale * float(np.float32(c))) + 1_000_000 for c in v] for i, v in good}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums, mean = len(fit), fit.sum(0), fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    keep = e > 1e-9 * e[0]
    return {i: (n, sum(int(n * a - s) ** 2 for a, s in zip(own, sums.tolist())), (np.array(own) - mean) @ v[:, keep] / np.sqrt(e[keep]),
                e[keep] / np.trace(cov)) for i, own in x.items()}


def test_whitening_is_the_plain_way(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(20) * np.arange(1, 21)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one vector very often
    rows += [(2000, None), (2001, [1.0] * 19 + [None]), (2002, [math.nan] * 20), (2003, [math.inf] * 20)]
    want = whitened(rows)
    got = {}
    for r in whitening.whiten(vectors(spark, rows)).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(want)
    signs = None
    for i, (n, deviation, white, explained) in want.items():
        own = [got[i][c] for c in range(1, 17)]
        assert {r["n"] for r in own} == {n} and {r["deviation"] for r in own} == {deviation} and {r["identity_error"] for r in own} == {own[0]["identity_error"]}
        values = np.array([r["whitened"] for r in own])
        signs = np.sign(values * white) if signs is None else signs
        assert np.allclose(values * signs, white, atol=1e-9)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9) and own[0]["identity_error"] < 1e-10


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    assert whitening.whiten(vectors(spark, [(1, []), (2, [])])).count() == 0
    flat = whitening.whiten(vectors(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (None, [2.0, 5.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in flat) == [(0, 1), (1, 1), (2, 1)] and {r["explained"] for r in flat} == {1.0}
    mixed = whitening.whiten(vectors(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [1.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in mixed) == [(1, 1, 2), (2, 1, 2), *((i, c, 3) for i in (3, 4, 5) for c in (1, 2))]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()


@pytest.mark.parametrize("name", ["op11_chat_format", "op13_lexical_search"])
def test_queries_are_their_sql(spark, duck, small, name):
    assert compare(spark, duck, queries.QUERIES[name], queries.ORACLE[name], small) is None


def test_whitening_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = whitened([(r["vec_id"], r["embedding"]) for r in rows])
    got = queries.QUERIES["op12_whitening"](spark, small).collect()
    assert len(got) == 16 * len(want)
    assert all(r["deviation"] == want[r["vec_id"]][1] for r in got)
    assert max(abs(abs(r["whitened"]) - abs(want[r["vec_id"]][2][r["component"] - 1])) for r in got) < 1e-8
    assert max(r["identity_error"] for r in got) < 1e-4
