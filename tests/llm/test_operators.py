"""The text operators against brute force, exact round trips and odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from epipanel.llm import (bpe, components, fingerprints, lm_scoring, near_dedup, packing, pieces, quality, queries,
                          secret_scan, token_files, topk, warc)
from epipanel.llm.common import words

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, part string, v double"

LONG = "x" * 30_000 + " " + "ab cd " * 3_000
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "Same text here, said twice."), (5, "Same text here, said twice."),
       (5, "Same text here, said twice."), (7, LONG), (8, "a  b   c \n d <|endoftext|> é 的 😀 ſ"), (None, "no id"), (9, "two words")]


def table(spark, rows):
    """Rows of (doc_id, text) with further columns, some of them null and named like columns the operators use."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", None, math.nan) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def packed_ids(ids):
    return np.array(ids, "<u4").tobytes()


def random_texts(n, seed=1):
    rng = random.Random(seed)
    signs = ["a", "b", " ", "  ", "\n", "'s", "'LL", "é", "É", "ñ", "1", "23", "!", "...", "<|endoftext|>", "<|startoftext|>", " ",
             "\x1c", "\x85", "😀", "the", "ING", "\t", "的", "tion", "́", "Σ", "İ", "ﬁ", "_", "​", "ſ", "²", "Ⅷ"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(n)]


# 1 language model

def brute_scores(texts, training, order, mu):
    tokens = [[*words(t or ""), "end"] for t in texts]
    counts, start = Counter(), 0
    for own, train in zip(tokens, training):
        if train:
            start += 1
            line = ["start", *own]
            for n in range(1, order + 1):
                counts.update(tuple(line[i:i + n]) for i in range(len(line) - n + 1) if n > 1 or i)
    counts[("start",)] = start
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("start",))
    v = sum(1 for g in counts if len(g) == 1 and g != ("start",))

    def p(line, i, k):
        if k == 0:
            return (counts[(line[i],)] + 1) / (n + v + 1)
        lower = p(line, i, k - 1)
        seen = counts[tuple(line[i - k:i])]
        return (counts[tuple(line[i - k:i + 1])] + mu * lower) / (seen + mu) if i - k >= 0 and seen else lower

    out = []
    for own in tokens:
        line = ["start", *own]
        out.append(tuple(sum(math.log10(p(line, i, k)) for i in range(1, len(line))) for k in (order - 1, 0)))
    return out, n, counts, tokens


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_the_models(spark, docs, rows, order):
    data = table(spark, [*rows.items(), *ODD[:5], ODD[-1], (None, "no id")])
    got = lm_scoring.score(data, order, 5.0, block_bytes=100_000)
    texts = [(r["doc_id"], r["text"]) for r in data.select("doc_id", "text").collect()]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    want, n, counts, tokens = brute_scores([t for _, t in texts], [not h for h in held], order, 5.0)
    left = sorted((str(i), h, len(own), sum(counts[(w,)] > 0 for w in own), n, round(base, 6), round(model, 6))
                  for (i, _), h, own, (model, base) in zip(texts, held, tokens, want))
    right = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6),
                    round(r["score"], 6)) for r in got.collect())
    assert [x[:5] for x in left] == [x[:5] for x in right]
    assert np.allclose([x[5:] for x in left], [x[5:] for x in right], atol=2e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_the_automaton_walks_by_hand(order):
    """States, arcs and failure arcs of a small corpus, walked one token at a time in plain Python."""
    rng = random.Random(order)
    some = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 30))) for _ in range(40)] + ["", "a b a b zz"]
    training = np.array([i % 5 != 0 for i in range(len(some))])
    tokens = lm_scoring.Tokens.of(some, order)
    asked = lm_scoring.needed(tokens, training)
    keys, counts = [k for k, _ in asked], [c.astype(np.uint64) for _, c in asked]
    n, v = int(counts[0].sum()), int((counts[0] > 0).sum())
    machine = lm_scoring.Automaton(tokens, keys, counts, n, v, 5.0)
    arcs = dict(zip(machine.arcs.tolist(), zip(machine.weight.tolist(), machine.target.tolist())))
    assert len(arcs) == len(machine.arcs) and all(w in arcs for w in range(machine.words))  # the root reads any word
    assert (machine.fail < len(machine.fail)).all() and machine.fail[0] == 0
    longest = 0
    by_hand = []
    for first, length in zip(tokens.first, tokens.length):
        state, total = machine.start, 0.0
        for word in machine.word[first:first + length].tolist():
            failed = 0
            while state * machine.words + word not in arcs:
                total += machine.fail_weight[state]
                state = int(machine.fail[state])
                failed += 1
            longest = max(longest, failed)
            weight, state = arcs[state * machine.words + word]
            total += weight
        by_hand.append(total)
    assert longest == order - 1  # one failure arc after the other
    want, *_ = brute_scores(some, training.tolist(), order, 5.0)
    assert np.allclose(by_hand, [m for m, _ in want])
    for lane in (1, 3, 512):
        assert np.allclose(machine.read(tokens, order, lane)[0], by_hand)


# 2 archives

def test_archives(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "x", ""), (5, "x\r\ny", "é" * 50_000), (None, "q", "a"),
                                   (2, "u", "a")], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.write_and_read(pages).collect())
    assert got == [("1", 1, "revisit", 2), ("2", 1, "response", None), ("2", 1, "response", None), ("3", 0, "revisit", 4),
                   ("4", 0, "response", None), ("5", 100_000, "response", None), ("None", 1, "response", None)]
    assert warc.write_and_read(pages.limit(0)).collect() == []


def test_archived_pages_come_back(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    index = warc.write(warc.with_responses(pages), f"file://{tmp_path}", archive_bytes=50_000)
    want = {r["page_id"]: r["html"] for r in pages.collect()}
    some = index.filter("page_id % 3 = 0")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(some, f"file://{tmp_path}", gap=100, with_payload=True).collect()}
    assert got == {k: v for k, v in want.items() if k % 3 == 0}


def test_ranges_join_neighbours():
    rows = [{"offset": o, "length": 10} for o in (0, 10, 25, 100, 110)]
    assert [(a, b, len(r)) for a, b, r in warc.ranges(rows, 5, 1000)] == [(0, 35, 3), (100, 120, 2)]
    assert [(a, b) for a, b, _ in warc.ranges(rows, 5, 20)] == [(0, 20), (25, 35), (100, 120)]


# 3 packing

def test_packing(odd, none, docs, rows, library):
    for data, texts in ((docs, rows.items()), (odd, ODD)):
        found = packing.pack(data, BYTES, with_ids=True).collect()
        assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
        assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and 0 < r["length"] <= 1024 for r in found)
        assert [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in found), reverse=True)
        want = Counter()
        for i, t in texts:
            ids, at = [*ids_of(library, BYTES, t), 0], 0
            for n in packing.binary_lengths(len(ids), 1024):
                want[i, at, n, zlib.crc32(packed_ids(ids[at:at + n])), len(ids)] += 1
                at += n
        assert want == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found)
    assert packing.pack(none, BYTES).collect() == []
    assert packing.binary_lengths(2 * 1024 + 5, 1024) == [1024, 1024, 4, 1]


# 4 quality

def test_quality_held_out(spark, small):
    found = queries.QUERIES["op4_quality"](spark, small).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, "t"), (4, 1, "t"), (7, 0, "t"), (99, 1, "t"), (None, 1, "t"), (9, None, "t"), (3, 1, "t"), (3, 0, "t")],
                                   "doc_id long, quality int, text string")
    ranking = quality.learn(odd, labels)
    assert len(quality.score(odd, ranking).collect()) == len(ODD)
    assert quality.score(none, ranking).collect() == []
    blank = quality.learn(none, labels)
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {quality.LEVEL}
    assert quality.keep_good(odd, blank).columns == odd.columns and quality.keep_good(odd, blank).count() == len(ODD)


def test_ranking_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_FEATURES))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(int)
    s = quality.fit(x, y).score(x)
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.98


# 5 fingerprints

def test_fingerprints(spark, odd, none, docs, rows):
    for data, texts in ((docs, list(rows.items())), (odd, ODD)):
        ordered = sorted(((i is not None, i or 0, t or "", i) for i, t in texts), key=lambda r: r[:3])
        got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
                      for r in fingerprints.with_next(data).collect())
        want = Counter()
        for (_, _, t, i), (_, _, following, _) in zip(ordered, [*ordered[1:], ordered[0]]):
            new = fingerprints.edited(t, following)
            a, b, c = (fingerprints.fingerprint(words(x)) for x in (t, new, following))
            want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(fingerprints.likeness(a, b), 9), round(fingerprints.likeness(a, c), 9)] += 1
        assert got == want
    assert fingerprints.with_next(none).collect() == []
    own = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(odd).collect()}
    assert own[4] == own[5] and own[0] == own[2] == "" and own[3] != own[9] and "\n" not in own[4]


def test_likeness_is_close_to_jaccard():
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}".encode() for _ in range(600)]
    errors = []
    for cut in range(0, 600, 20):
        other = base[:cut] + [f"v{rng.randrange(10_000)}".encode() for _ in range(600 - cut)]
        sets = [set(zip(*[x[i:] for i in range(5)])) for x in (base, other)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        errors.append(fingerprints.likeness(fingerprints.fingerprint(base), fingerprints.fingerprint(other)) - true)
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and abs(np.mean(errors)) < 0.02


# 6 near copies

def brute_components(texts, width, percent):
    sets = {i: near_dedup.shingles(t or "", width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies(spark, docs, rows, width):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = dict(rows)
    for i in range(60):  # a family whose members are at, above and below the bound from each other
        own = list(base)
        for _ in range(rng.randrange(14)):
            own[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        texts[1000 + i] = " ".join(own)
    got = near_dedup.near_copies(table(spark, list(texts.items())), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_copies_odd_rows(odd, none):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_copies(odd, 2).collect())
    assert [x for x in got if x[0] == "5"] == [("5", 4, 4, False)] * 2 and ("4", 4, 4, True) in got
    assert ("None", 1, None, True) in got and ("0", 0, 0, True) in got and ("3", 1, 3, True) in got
    kept = near_dedup.drop_near_copies(odd, 2)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "2", "3", "4", "7", "8", "9", "None"]
    assert near_dedup.near_copies(none).collect() == [] and near_dedup.drop_near_copies(none).collect() == []


def test_one_id_with_different_texts(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [rng.choices(vocabulary, k=60) for _ in range(6)]
    near = lambda t: " ".join(t[:-1] + ["changed"])
    rows = [(5, None), (5, "a real text with words enough to have shingles"), (6, "another text here"), (6, "zebra crossing unlike it")]
    rows += [(1, " ".join(base[0])), (1, " ".join(base[1])), (2, near(base[1])), (2, " ".join(base[2])), (2, " ".join(base[2])), (3, near(base[2]))]
    rows += [(9, " ".join(base[3])), (8, near(base[3])), (None, " ".join(base[3])), (None, None), (4, ""), (4, " ")]
    schema = "doc_id long, text string, _place string, key int, mark string, row string, place int"
    table_ = spark.createDataFrame([(i, t, f"keep-{n}", n, "m", "r", None) for n, (i, t) in enumerate(rows)], schema)
    kept = near_dedup.drop_near_copies(table_).collect()
    assert all(r["_place"] == f"keep-{r['key']}" and (r["mark"], r["row"], r["place"]) == ("m", "r", None) for r in kept)
    got = Counter((r["doc_id"], r["text"]) for r in kept)
    gone = {(2, near(base[1])), (3, near(base[2])), (9, " ".join(base[3]))}
    assert got == Counter(x for x in set(rows) if x not in gone)
    labels = near_dedup.near_copies(table_).collect()
    assert len(labels) == len(rows)
    assert Counter(r["component_id"] for r in labels if r["doc_id"] == 2) == Counter({1: 1, 2: 2})
    assert {r["component_id"] for r in labels if r["doc_id"] == 5} == {5} and {r["component_id"] for r in labels if r["doc_id"] == 9} == {8}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (200, 201)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}


# 7 encoding and decoding

def test_transducer_is_the_library(library):
    machine = bpe.transducer(BYTES)
    rng = random.Random(4)
    for text in random_texts(1500):
        ids = ids_of(library, BYTES, text)
        assert b"".join(machine.encode(text)) == packed_ids(ids), text
        some = [rng.randrange(50_257) for _ in range(rng.randrange(9))]
        assert "".join(machine.decode([packed_ids([i]) for i in some])) == library[BYTES].decode(some, skip_special_tokens=False)


def test_windows_change_nothing():
    machine = bpe.Transducer(BYTES, window=1)  # as small as the lookahead lets it be
    rng = random.Random(5)
    parts = [b.decode() for b in machine.bytes_of.values() if b.isalpha()]
    for _ in range(30):
        data = "".join(rng.choice(parts) for _ in range(400)).encode()
        assert list(itertools.chain(*machine.stream(data))) == machine.merge(data)
        for cut in rng.sample(range(machine.lookahead + 1, len(data)), 5):  # what is settled stays, whatever follows
            whole, so_far, at = machine.merge(data), machine.merge(data[:cut]), 0
            for a, b in zip(whole, so_far):
                at += len(machine.bytes_of[b])
                if at > cut - machine.lookahead:
                    break
                assert a == b


def test_units_of_every_sign(library):
    """Also signs that only one of the libraries knows: in a word, alone, after spaces, before an apostrophe."""
    machine = bpe.transducer(BYTES)
    signs = [chr(c) for c in range(0x80, 0x32000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(signs), 64):
        text = "".join(f"a{c}b 1{c} {c}  {c}\n{c}'s" for c in signs[i:i + 64])
        assert b"".join(machine.encode(text)) == packed_ids(ids_of(library, BYTES, text)), hex(ord(signs[i]))


def test_round_trip(odd, none, library):
    got = Counter(tuple(r) for r in bpe.round_trip(odd, BYTES).collect())
    want = Counter()
    for i, t in ODD:
        ids = ids_of(library, BYTES, t)
        want[i, len(ids), hashlib.sha256(packed_ids(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(none, BYTES).collect() == []
    back = Counter(tuple(r) for r in bpe.decode(bpe.encode(odd, BYTES), BYTES).collect())
    assert back == Counter((i, t or "") for i, t in ODD)


# 8 search

def test_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [math.nan] * 8), (303, [math.inf] * 8), (None, [9.0] * 8), (304, []), (400, [1.0] * 8),
             (5, rows[5][1])]
    data = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.search(data, data.filter("vec_id % 100 = 0"), 10).drop("variant").collect())
    ok = [(i, np.floor(1024 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in ok:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.search(data.limit(0), data.limit(0)).collect() == []


def _brute_search(rows, k):
    ok = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    asked = sorted({(i, v) for i, v in ok if i % 100 == 0})
    out = []
    for q, v in asked:
        variant = [x for x in asked if x[0] == q].index((q, v))
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, n, i, -s, variant) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_search_keeps_queries_beside_bad_rows_of_their_id(spark):
    rows = [(100, [math.nan, math.nan]), (100, [1.0, 2.0]), (100, [3.0, -2.0]), (100, [1.0, 2.0]), (100, None), (1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [-1.0, 4.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(data, data.filter("vec_id % 100 = 0"), 10).collect())
    assert got == _brute_search(rows, 10) and len(got) == 6


def test_search_is_exact_for_large_components_or_raises(spark):
    rows = [(100, [1e6, 3.0, -7.0]), (200, [2e15, -1.0, 1e-3])] + [(i, [1e8 + i, float(i % 7), -1e9]) for i in range(1, 90)] + [(95, [2e15, 0.0, 0.0])]
    fits = [r for r in rows if r[0] != 200]
    data = spark.createDataFrame(fits, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(data, data.filter("vec_id % 100 = 0"), 5).collect()) if max(abs(s[3]) for s in _brute_search(fits, 5)) < 2 ** 63 else None
    if got is not None:
        assert got == _brute_search(fits, 5)
    for bad in ([(100, [1.0, 2.0]), (1, [1e16, 1.0])], [(100, [2e15, 0.0]), (1, [2e15, 0.0])]):
        data = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="OverflowError|too large|too big"):
            topk.search(data, data.filter("vec_id % 100 = 0"), 5).collect()
    exact = [(100, [4e9, 1.0]), (1, [1e3, 5.0]), (2, [1e3, 4.0]), (3, [1e3, 6.0])]
    data = spark.createDataFrame(exact, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(data, data.filter("vec_id % 100 = 0"), 5).collect()) == _brute_search(exact, 5)


def test_search_over_several_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(0, 3000, 10)] + [(i, rng.standard_normal(12).tolist()) for i in range(5000, 5400)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    want = _brute_search(rows, 3)
    for name, value in (("BLOCK", 7), ("GROUP", 1)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(tuple(r) for r in topk.search(data, data.filter("vec_id % 100 = 0"), 3).collect()) == want



# 9 secrets

def test_secrets(spark, none):
    key = "AKIA" + "ABCDEFGH2345WXYZ"
    token = "q7Zp0Xv9Lk3Tn8Rb2Wd6"
    texts = [f"é password = 'abcdefgh1' and {key}", "hex 0123456789abcdef0123456789abcdef.", f"see {token} there", "secret: short", None, "",
             "id 123e4567-e89b-12d3-a456-426614174000 on 2024-01-01T00-00-00-0000", "an extraordinarily-long-hyphenated-compound-word",
             "token=secret=abcdefgh", "PASSWD:\"x.y-z/12345\"", f"api_key = {token}"]
    data = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in secret_scan.find(data, RANKS).collect()}
    assert got[0]["spans"] == f"assign:2:23,access:29:{29 + len(key)}" and got[1]["spans"] == "hex:4:36"
    assert got[2]["spans"] == f"random:4:{4 + len(token)}" and got[2]["n_random"] == 1
    assert [got[i]["spans"] for i in (3, 4, 5, 6, 7)] == [""] * 5
    assert got[8]["spans"] == "assign:0:21" and got[9]["n_assign"] == 1 and got[10]["n_random"] == 0
    assert got[1]["base_sha256"] == hashlib.sha256(b"hex:4:36").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(data, RANKS).collect()}
    assert clean[2] == "see [removed] there" and clean[4] is None and clean[3] == texts[3] and key not in clean[0]
    assert secret_scan.find(none, RANKS).collect() == [] and secret_scan.redact(none, RANKS).collect() == []


# 10 token files

def test_blocks():
    rng = np.random.default_rng(0)
    for n, high in itertools.product((1, 2, 700, 4096), (1, 3, 50_000, 1 << 32)):
        ids = rng.integers(0, high, n).astype("<u4")
        ids[:: 97] = (1 << 32) - 1
        assert (token_files.unpack_block(token_files.pack_block(ids)) == ids).all()
    flat = np.full(4096, 7, "<u4")
    assert len(token_files.pack_block(flat)) == 12


def test_token_files(odd, none, docs, rows, library):
    for data, texts in ((docs, list(rows.items())), (odd, ODD)):
        want, start = [], 0
        for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = [*ids_of(library, WORDS, t), 1]
            want.append((i, start, len(ids), zlib.crc32(packed_ids(ids))))
            start += len(ids)
        assert Counter(tuple(r) for r in token_files.write_and_read(data, WORDS).collect()) == Counter(want)
    assert token_files.write_and_read(none, WORDS).collect() == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_fast_ids_are_the_library(library, path):
    encoder = pieces.encoder(path)
    assert encoder.same
    texts = random_texts(1500, 2)
    for text, got in zip(texts, encoder.encode(texts)):
        assert got == packed_ids(ids_of(library, path, text)), text
