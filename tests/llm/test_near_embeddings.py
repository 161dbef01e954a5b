import numpy as np

from fleetspark.llm import near_embeddings as N


def brute(rows, threshold=0.98):
    out = []
    good = lambda k, v, l: k is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for k, v, l in rows:
        out.append([k, 0, k])
    at = [i for i, r in enumerate(rows) if good(*r)]
    link = {i: set() for i in at}
    for i in at:
        for j in at:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[x][1], np.float64) for x in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    link[i].add(j)
    for i in at:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = [rows[i][0], len(link[i]), min(rows[j][0] for j in seen)]
    return sorted((str(k), n, str(c), k is not None and k == c) for k, n, c in out)


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "LARGEST", 32)
    monkeypatch.setattr(N, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            rows.append((k, [float(x) for x in rng.standard_normal(8).astype(np.float32)], label))
            k += 3
    for label, n, noise in ((0, 90, 0.05), (1, 12, 0.02), (1, 5, 0.0)):
        center = rng.standard_normal(8)
        for _ in range(n):
            rows.append((k, [float(x) for x in (center + noise * rng.standard_normal(8)).astype(np.float32)], label))
            k -= 2 if k % 2 else -5
    rows += [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 8, 0), (9004, [1.0, None] + [0.0] * 6, 0), (9005, [float("nan")] * 8, 0), (9006, [float("inf")] + [1.0] * 7, 1), (None, rows[0][1], 0), (9007, rows[0][1], 0), (9008, [1.0] * 4, 0), (9009, [2.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    history = []
    got = N.near_duplicates(df, history=history).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)
    assert history[-1][0] == history[-1][1] > 0


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_cells_follow_each_label(spark):
    """A small label beside a large one is one cell: each of its vectors gets a full list."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 8, int(i >= 3000), 5 if i < 3000 else 0) for i in range(3060)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, dim int, label int, bits int")
    met = N._from_cells(df, 3060, range(1), 10, 0.98).where("sim is not null and a >= 3000")
    got = {r.a: r.n for r in met.groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert got == {i: 10 for i in range(3000, 3060)}


def test_search_goes_on_until_the_audit_is_whole(spark, monkeypatch):
    """More failed audits than there were rounds."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)], 0) for i in range(40)], "vec_id long, embedding array<float>, label int")
    answers = [(3, 2)] * 5 + [(3, 3)]
    monkeypatch.setattr(N, "ROUNDS", 1)
    monkeypatch.setattr(N, "_audit", lambda *a: answers.pop(0))
    history = []
    N.near_duplicates(df, history=history)
    assert history == [(3, 2)] * 5 + [(3, 3)]


def test_all_pairs_after_searches_that_miss(spark, monkeypatch):
    """Audits that always miss links end in all pairs, which equal brute force though nothing was searched for; columns that clash are left alone."""
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        centers = rng.standard_normal((12, 6))
        rows += [(1000 * label + i, [float(x) for x in (centers[i % 12] + 0.08 * rng.standard_normal(6)).astype(np.float32)], label) for i in range(90)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, id double")
    monkeypatch.setattr(N, "CELL", 8)
    monkeypatch.setattr(N, "BLOCK", 20)
    monkeypatch.setattr(N, "SEARCHES", 1)
    monkeypatch.setattr(N, "_audit", lambda *a: (3, 2))
    empty = "a long, b long, sim double"
    monkeypatch.setattr(N, "_from_cells", lambda nodes, *a: spark.createDataFrame([], empty))
    monkeypatch.setattr(N, "_descend", lambda lists, *a: spark.createDataFrame([], empty))
    got = N.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)


def test_audit_sees_rare_links(spark, monkeypatch):
    """A few pairs among many vectors: those with a near neighbour are audited too, and what isn't in one group is missed."""
    monkeypatch.setattr(N, "CELL", 32)
    monkeypatch.setattr(N, "AUDITED", 20)
    monkeypatch.setattr(N, "SLICE", 300)
    monkeypatch.setattr(N, "ABREAST", 7)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 16))
    for i in range(15):
        x[1000 + i] = x[i] + 0.03 * rng.standard_normal(16)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    history = []
    got = {r.vec_id: r.component_id for r in N.near_duplicates(df, history=history).collect()}
    assert history[-1][0] == history[-1][1] >= 20  # of the 30 ends of 15 links, 20 are asked
    assert all(got[1000 + i] == i for i in range(15))
