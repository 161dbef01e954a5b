import random
import re

import numpy as np
import pytest

from fleetspark.llm import jaccard_join as J

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """{key position: (n, least key)} by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                    root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = ["", "One", "one", "a b c", "A B C", "a b c d e", None, " \t\n"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.35 or len(texts) < 20:
            w = [rng.choice(vocabulary) for _ in range(rng.choice((6, 12, 40, 90, 200)))]
            if rng.random() < 0.5:
                w[len(w) // 2 : len(w) // 2] = passage
        else:
            w = (rng.choice(texts[8:]) or "x").split()
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = rng.choice(vocabulary)
                elif rng.random() < 0.5:
                    del w[at:]
                    w = w or ["y"]
                else:
                    w.insert(at, rng.choice(vocabulary))
        texts.append(" ".join(w))
    keys = list(range(n))
    rng.shuffle(keys)
    return list(zip(keys, texts))


@pytest.mark.parametrize("often, block", [(10, 512), (4, 3)])
def test_same_as_brute_force(spark, monkeypatch, often, block):
    monkeypatch.setattr(J, "OFTEN", often)  # the hint changes no result
    monkeypatch.setattr(J, "BLOCK", block)  # nor do blocks
    rows = corpus(often)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = sorted(tuple(r) for r in J.groups(df).collect())
    assert got == brute(rows)


def test_all_pairs_share_a_signature():
    """Every linking pair of random sets meets in some signature, whatever the tier."""
    import numpy as np

    rng = np.random.default_rng(1)
    for frequent in (False, True):
        for _ in range(400):
            n = int(rng.integers(1, 120))
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            t = s.copy()
            for _ in range(int(rng.integers(0, max(2, n // 5)))):
                t = np.delete(t, rng.integers(len(t))) if rng.random() < 0.5 and len(t) > 1 else np.append(t, np.uint64(rng.integers(0, 2**63)))
            t = np.unique(t)
            same = len(np.intersect1d(s, t))
            if 100 * same < 75 * (len(s) + len(t) - same):
                continue
            of = J.Signatures(np.sort(rng.choice(s, len(s) * 3 // 4)) if frequent else np.empty(0, np.uint64)).of
            assert np.intersect1d(of(s), of(t)).size
            a, b = (np.frombuffer(J.sketch(x), np.uint8) for x in (s, t))
            if len(a) == len(b):
                assert np.bitwise_count(a ^ b).sum() <= len(s) + len(t) - 2 * same


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.groups(df).collect() == []
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (7, None, "n"), (7, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sid string")
    got = sorted((str(r[0]), r[1], str(r[2])) for r in J.groups(df).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("7", 0, "7"), ("7", 0, "7"), ("None", 2, "1")]
    kept = J.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 5


def test_frequent_elements_are_no_rows_of_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, "one two three four five six seven") for i in range(12)] + [(20, "a b c d e f")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "collect", lambda self: pytest.fail("collected as rows"))
    got = J._frequent(df, "text", 13)
    assert got.tolist() == J.shingles(b"one two three four five six seven", J._WordHashes()).tolist()


def test_ngrams_are_counted_in_packs(spark, monkeypatch):
    monkeypatch.setattr(J, "PACKED", 700)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    made, of = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a: made.append(of(self, *a)) or made[-1])
    got = J._frequent(df, "text", len(rows))
    sets = [J.shingles(None if t is None else t.encode(), J._WordHashes()) for _, t in rows]
    h, n = np.unique(np.concatenate(sets), return_counts=True)
    assert got.tolist() == h[n >= J.OFTEN].tolist() and len(got)
    # Rows between tasks follow the packs, not the n-grams.
    assert sum(len(x) for x in made[0].toArrow().column("hashes").to_pylist()) == 8 * n.sum()
    assert made[0].count() <= 256 * (3 + n.sum() // 700)


@pytest.mark.parametrize("limit", [1_300_000, 4])
def test_sets_are_shuffled_once_each(spark, monkeypatch, limit):
    """Only sets that a pass asks for move, once for their side of its pairs, and passes lose no link."""
    words = [[f"w{i}x{k}" for k in range(40)] for i in range(6)]
    texts = [" ".join(words[i % 6][: 40 - i // 6]) for i in range(36)]
    made = [J.shingles(t.encode(), J._WordHashes()) for t in texts]
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(made)], "sid long, set binary")
    pairs = [(i, j) for i in range(36) for j in range(i % 3, i, 3)]
    plans = []
    kept = J.written
    monkeypatch.setattr(J, "PAIRS", limit, raising=False)
    monkeypatch.setattr(J, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {tuple(r) for r in J._verified(spark.createDataFrame(pairs, "a long, b long"), sets, 75, 100).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert found == {(i, j) for i, j in pairs if J._linked(made[i], made[j], 75, 100)} and found
    assert len(plans) == (4 if limit == 4 else 1)
    for p in plans:
        initial = p.split("Initial Plan")[-1]
        assert initial.count("Exchange hashpartitioning(a") == 0 and initial.count("Exchange hashpartitioning(b") <= 3
