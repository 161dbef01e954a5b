import math
import random
import re
import zlib

import numpy as np
import pytest

from fleetspark.llm import compress_classifier as C
from fleetspark.llm import hmm, token_counts


def paths_likelihood(x, start, move, emit):
    """Natural log of the probability by summing over all state paths."""
    import itertools

    total, x = 0.0, [*x, hmm.BUCKETS]
    for z in itertools.product(range(len(start)), repeat=len(x)):
        p = start[z[0]] * emit[x[0], z[0]]
        for i in range(1, len(x)):
            p *= move[z[i - 1], z[i]] * emit[x[i], z[i]]
        total += p
    return math.log(total)


@pytest.fixture(scope="module")
def params():
    rng = np.random.default_rng(1)
    k = 3
    start, move, emit = rng.random(k), rng.random((k, k)), rng.random((hmm.BUCKETS + 1, k))
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def test_forward_is_exact(params):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 2, 5, 3, 6)]
    got = hmm.log_likelihood(texts, *params)
    assert np.allclose(got, [paths_likelihood(t, *params) for t in texts])


def test_expected_counts(params):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 20, n) for n in (4, 0, 2, 5)]
    k = 3
    s, m, e = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.BUCKETS + 1, k))
    total = hmm.expected_counts(texts, *params, s, m, e)
    assert total == pytest.approx(sum(paths_likelihood(t, *params) for t in texts))
    assert s.sum() == pytest.approx(4) and m.sum() == pytest.approx(11) and e.sum() == pytest.approx(15)
    # A small change of a parameter changes the likelihood by its expected count over its value.
    start, move, emit = params
    for i, j in ((0, 1), (2, 2)):
        near = move.copy()
        near[i, j] *= 1 + 1e-6
        up = sum(paths_likelihood(t, start, near, emit) for t in texts)
        assert (up - total) / 1e-6 == pytest.approx(m[i, j], rel=1e-3)


def test_hmm_query(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["The", "a", "b", "é", "c"] if i % 2 else ["x", "y", "z", "w"]) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(900, None), (901, " \n"), (None, "a b"), (5, "a")]
    history = []
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = hmm.score(df, block_words=100, history=history).collect()
    assert len(out) == len(docs) and all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = {}
    for i, t in docs:
        if not held(i):
            for w in tok(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tok(t)), sum(counts.get(w, 0) > 0 for w in tok(t)), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hmm.score(df.limit(0)).collect() == []


def greedy(symbols, first, rest):
    i = n = 0
    while i < len(symbols):
        pool = first if i == 0 else rest
        for j in range(len(symbols), i, -1):
            if symbols[i:j] in pool:
                break
        else:
            return -1
        i, n = j, n + 1
    return n


def test_longest_match_against_greedy():
    rng = random.Random(5)
    piece = lambda: tuple(rng.choices(range(3), k=rng.randint(1, 5)))
    for _ in range(1500):
        first, rest = {piece() for _ in range(rng.randint(1, 8))}, {piece() for _ in range(rng.randint(1, 8))}
        one, two = token_counts.LongestMatch(first), token_counts.LongestMatch(first, rest)
        for _ in range(6):
            s = tuple(rng.choices(range(3), k=rng.randint(0, 9)))
            assert one.count(s) == greedy(s, first, first) and two.count(s) == greedy(s, first, rest)


def test_token_counts(spark):
    pieces = [tuple(p.encode()) for p in ("a", "b", "ab", "abc", "c")] + [(*p.encode(), token_counts.END) for p in ("a", "b", "c", "bc")]
    df = spark.createDataFrame([(1, "ABC abca"), (1, "ABC abca"), (2, None), (None, ""), (3, "zz!")], "doc_id long, text string")
    out = sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.counts(df, token_counts.LongestMatch(pieces)).collect())
    # abc+END: abc is the longest match, and END alone is no piece, so greedy matching is stuck
    assert out == [("1", 2, 3, 1), ("1", 2, 3, 1), ("2", 0, 0, 0), ("3", 2, 2, 2), ("None", 0, 0, 0)]


def test_classifier(spark):
    rng = random.Random(6)
    good = ["".join(rng.choice(["the ", "of ", "and ", "reads ", "well. "]) for _ in range(60)) for _ in range(150)]
    bad = [" | ".join(rng.choice(["BUY!!", "now$$", "cheap%%"]) for _ in range(60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, ""), (None, good[0])]
    labels = [(i, 1 if i < 150 else 0, "x") for i in range(300)] + [(None, 1, "x"), (3, None, "x")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, text string")
    out = {r.doc_id: r for r in C.digest(docs, marks).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and not out[None].held_out
    assert sum(out[i].predicted == (i < 150) for i in held) >= 0.95 * len(held)
    assert C.keep_good(docs, marks).columns == docs.columns
    none = C.digest(docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_scores_against_plain_python(spark):
    """A fixed model's scores, piece by piece; a sample's bound in bytes; few texts stay near their share."""
    import zstandard

    rng = random.Random(8)
    model = C.Model(b"the cat sat on the mat and " * 60, b"BUY now$$ cheap%% " * 60, [0.3, 1.0, 0.5, -0.2, 0.1, 0.05, 0.2])
    texts = ["", None, "the cat", "BUY " * 500, "é" * 77, "".join(rng.choice("ab c\n") for _ in range(4000))]

    def plain(t):
        t = (t or "").encode()
        cut = [t[i : i + 128] for i in range(0, len(t), 128)]
        size = []
        for d in (model.good, model.bad):
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            size.append(max(1, sum(len(z.compress(x)) - 9 for x in cut)))
        g, b = size
        d, r, sure = (b - g) / (b + g), (g + b) / (2 * max(1, len(t))), min(1.0, len(t) / 400)
        z = sum(w * f for w, f in zip(model.weights, [1.0, 10 * d * sure, 10 * d * (1 - sure), 20 * d * abs(d), r, r * r, sure]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    out = C.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    assert [r.score for r in sorted(out, key=lambda r: r.doc_id)] == pytest.approx([plain(t) for t in texts])
    alone = C.fit(["the cat"], [])
    assert C.Model(alone.good, alone.bad, alone.weights).score(alone.scorer()(b"the dog")) > 0.5 and C.fit([], []).weights == [0.0] * 7
    few = [C.fit(["the cat sat on it " * 9] * n, ["BUY now$$ cheap%% " * 9] * n) for n in (1, 2, 60)]
    gaps = [m.score(m.scorer()(b"the cat sat on it " * 9)) - m.score(m.scorer()(b"BUY now$$ cheap%% " * 9)) for m in few]
    assert 0 <= gaps[0] < gaps[2] and gaps[1] < gaps[2] > 0.9
    docs = spark.createDataFrame([(i, "x" * 1000 if i == 1 else f"text {i}") for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    fitted, C.fit = C.fit, lambda good, bad: (seen.append((good, bad)), fitted(good, bad))[1]
    try:
        C.train(docs, marks, sample_bytes=60), C.train(docs, marks)
    finally:
        C.fit = fitted
    assert all(sum(map(len, t)) <= 60 and t for t in seen[0]) and "x" * 1000 in seen[1][0] and len(seen[1][0]) > len(seen[0][0])


def test_spans_of_long_texts(params, monkeypatch):
    """Long texts in spans give what they give as a whole."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 300, n) for n in (0, 3, 38, 39, 40, 41, 63, 64, 65, 300, 7)]

    def results():
        k = 3
        sums = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.BUCKETS + 1, k))
        return hmm.expected_counts(texts, *params, *sums), *sums, hmm.log_likelihood(texts, *params)

    whole = results()
    monkeypatch.setattr(hmm, "LONG", 40)
    monkeypatch.setattr(hmm, "SPAN", 8)
    monkeypatch.setattr(hmm, "FLIGHT", 100)
    for got, want in zip(results(), whole):
        assert np.allclose(got, want)


def test_classifier_edges(spark):
    """No rows, long texts learned from to their end, ties, repeated rows, null texts, columns that clash."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    noise = "".join(rng.choice("qxzj#$%&") for _ in range(70_000))
    docs, labels = [], []
    for i in range(120):
        good = i % 2 == 0
        words = " ".join(rng.choice("the cat sat on a mat and was glad of it".split()) for _ in range(60))
        junk = "".join(rng.choice("qxzj#$%& ") for _ in range(300))
        # Long texts tell what they are at their end only.
        docs.append((i, noise[:9000] * (i % 10 < 2) + (words if good else junk) * (40 if i % 10 < 2 else 1)))
        labels.append((i, int(good)))
    docs += [(0, docs[0][1]), (500, None), (501, ""), (None, "the cat")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("mine"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = C.digest(df, marks).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(tuple(r))
    assert len(rows) == len(docs) and all(len(v) == 1 for v in by.values()) and all(0 <= r.score <= 1 for r in rows)
    assert next(iter(by[500]))[2] == next(iter(by[501]))[2]
    right = sum(r.predicted == 1 - r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 120)
    assert right >= 110
    kept = C.keep_good(df, marks)
    assert kept.columns == df.columns and {r.score for r in kept.collect()} == {"mine"}
    assert C.digest(df.limit(0), marks).collect() == [] and C.digest(df, marks.limit(0)).count() == len(docs)
