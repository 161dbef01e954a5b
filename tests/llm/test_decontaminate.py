import random
import re

from fleetspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if g := windows.get(tuple(w[k : k + n])):
                    found |= g
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), D.sha(sorted(found)), bool(hit)))
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "Été", "x1", "über", "d"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "--"]) for _ in range(n))
    items = [(i, text(rng.choice((1, 3, 9, 10, 11, 14, 25)))) for i in range(30)] + [(100, None), (101, ""), (102, "...")]
    items += [(103, items[7][1]), (11, items[3][1])]
    docs = []
    for d in range(60):
        t = text(rng.choice((0, 2, 9, 10, 30, 80)))
        if rng.random() < 0.6:
            t += "\n" + rng.choice(items)[1].__str__() + " " + text(3)
        docs.append((d, t))
    return docs + [(200, None), (201, ""), (1, docs[1][1])], items


def test_same_as_brute_force(spark):
    for seed, shard, size in ((1, 400_000, D.PASS_BYTES), (2, 40, D.PASS_BYTES), (3, 400_000, 700)):
        docs, items = make(seed)
        df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert (len(D._passes(it, "item_id", "text", size)) > 3) == (size == 700)
        found = D.decontaminate(df, it, remove=False, shard_words=shard, pass_bytes=size)
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, D.sha(list(r["items"])), r.n_hit > 0) for r in found.collect())
        assert got == brute(docs, items)
        if size == 700:  # texts without their spans, too, are those of one pass
            texts = lambda n: sorted((r.doc_id, r.clean_text or '', r.longest) for r in D.decontaminate(df, it, pass_bytes=n).collect())
            assert texts(size) == texts(D.PASS_BYTES)
        elif shard == 400_000:
            assert sorted(tuple(r) for r in D.digest(df, it).collect()) == got


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Before, {item.upper()}! after that come many more words so that most of the text stays as it was written, on and on it goes without an end in sight, and then some more of it to fill the page, which is a rather long one at that.", "x", 9), (2, item, "x", 9), (3, None, "x", 9), (4, "clean", "x", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string, n_chars long")
    out = {r.doc_id: r for r in D.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and out[1].text.startswith("Before, ! after that") and out[1].n_chars == len(out[1].text) and out[1]["items"] == "x"
    assert D.clean(df, spark.createDataFrame([], "item_id long, text string")).count() == 4


def test_null_item_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), ("x", "c d"), (None, "a b")], "item_id string, text string")
    for size in (D.PASS_BYTES, 2):
        got = {r.doc_id: (r.n_hit, r.n_items, D.sha(list(r["items"]))) for r in D.decontaminate(docs, items, pass_bytes=size).collect()}
        assert got == {1: (4, 2, D.sha(["x"])), 2: (0, 0, D.sha([]))}
