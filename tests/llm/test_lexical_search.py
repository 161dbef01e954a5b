import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetspark.llm import lexical_search as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k):
    texts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in of.items():
        found = []
        for d, c in texts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs // length if length else 0)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                found.append((-s, d is not None, d if d is not None else 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def make(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "x", "X", "über", "the", "of"]
    text = lambda m: " ".join(rng.choice(vocabulary[: rng.choice((5, 66))]) + rng.choice(["", ".", "--"]) for _ in range(m))
    docs = [(d, text(rng.choice((0, 1, 5, 30, 200)))) for d in range(n)]
    docs += [(d + 1000, docs[d % 7 + 3][1]) for d in range(60)]  # ties
    docs += [(5000, None), (5001, ""), (5002, "..."), (3, docs[3][1]), (None, docs[4][1])]
    items = [(f"i{i}", text(rng.choice((1, 3, 12)))) for i in range(12)] + [("long", " ".join(vocabulary) + " " + " ".join(f"v{i}" for i in range(100)))]
    return docs, items + [("none", "nowhere to befound"), ("null", None), ("empty", ""), (None, "the of"), ("i1", "über")]


def rows(df, item="item_id", key="doc_id"):
    return sorted(((r[item], r["rank"], r[key], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,k,size", [(1, 50, 8 << 20), (2, 7, 300)])
def test_same_as_brute_force(spark, seed, k, size):
    docs, items = make(seed)
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, item string, rank int").repartition(5)
    it = spark.createDataFrame(items, "item_id string, text string")
    assert rows(L.search(df, it, k=k, pass_bytes=size)) == brute(docs, items, k)


def test_text_keys(spark):
    docs, items = make(3, 60)
    docs = [(None if d is None else f"d{d:05}", t) for d, t in docs]
    got = rows(L.search(spark.createDataFrame(docs, "k string, text string"), spark.createDataFrame(items, "item_id string, text string"), k=9, key="k"), key="k")
    expected = [(i, r, d, s) for i, r, d, s in brute([(0 if d is None else int(d[1:]) + 1, t) for d, t in docs], items, 9)]
    assert got == sorted(((i, r, None if d == 0 else f"d{d - 1:05}", s) for i, r, d, s in expected), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0
    assert L.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(TypeError):
        L.search(docs.selectExpr("doc_id / 2 AS doc_id", "text"), items)


def test_masks_are_left_out():
    """Masks below the k-th best score are never evaluated, and nothing is lost by it."""
    rng = np.random.default_rng(5)
    docs = 4000
    postings = [(np.sort(rng.choice(docs, n, replace=False)), rng.integers(1, 4, n)) for n in (3000, 1500, 300, 40)]
    weight, m = np.array([10, 200, 1500, 4000]), rng.integers(50, 400, docs)
    best = L.Best(20, np.arange(docs))
    done = L.search_block(best, np.arange(docs), np.ones(docs, bool), m, postings, weight)
    score = np.zeros(docs, np.int64)
    for (at, tf), w in zip(postings, weight):
        score[at] += w * (10**9 * tf // (1000 * tf + 20 * m[at]))
    order = np.lexsort((np.arange(docs), -score))[:20]
    assert best.key.tolist() == order.tolist() and best.score.tolist() == score[order].tolist() and done < 500
