import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import density


def brute(pts, eps, least):
    """pts: (id, group, x, y, weight)."""
    near = {a: [b for b in pts if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= eps * eps] for a in pts}
    core = {a for a in pts if sum(b[4] for b in near[a]) >= least}
    name = {}
    for a in sorted(core):
        if a not in name:
            todo = [a]
            name[a] = a[0]
            while todo:
                for b in near[todo.pop()]:
                    if b in core and b not in name:
                        name[b] = a[0]
                        todo.append(b)
    return {a[0]: name[a] if a in core else min((name[b] for b in near[a] if b in core), default=None) for a in pts}


def cluster(spark, pts, eps, least):
    df = spark.createDataFrame([(*p, 1) for p in pts], "id long, g string, x double, y double, w double, cell int").repartition(4)
    return {r.id: r.cluster for r in density.dbscan(df, "id", eps, least, "w", ["g"]).collect()}


@pytest.mark.parametrize("few", [256, 4])
def test_same_as_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(density, "FEW", few)  # 4: cells are split, as those of many points are
    rng = random.Random(few)
    pts = []
    for i in range(420):
        kind = rng.random()
        x, y = (rng.uniform(-150, 150), rng.uniform(-150, 150)) if kind < 0.5 else (rng.gauss(40, 9), rng.gauss(0, 9)) if kind < 0.8 else (float(rng.randrange(-5, 5) * 20), float(rng.randrange(-5, 5) * 20))
        pts.append((i, rng.choice("ab"), x, y, float(rng.choice((0, 1, 1, 3)))))
    pts += [(1000 + i, "a", 20.0 * i, 300.0, 2.0) for i in range(9)]  # exactly within reach of each other
    assert cluster(spark, pts, 20.0, 6.0) == brute(pts, 20.0, 6.0)
    assert {c for c in cluster(spark, pts[-9:], 20.0, 6.0).values()} == {1001}


def test_cells_that_just_miss(spark, monkeypatch):
    """Two dense arcs whose cells are neighbours and whose points are just beyond reach, or just within it by a single pair."""
    monkeypatch.setattr(density, "FEW", 16)
    left = [(i, "a", 0.0, i * 0.01, 1.0) for i in range(300)]
    right = [(1000 + i, "a", 10.0 + 1e-7, i * 0.01, 1.0) for i in range(300)]
    assert set(cluster(spark, left + right, 10.0, 5.0).values()) == {0, 1000}
    assert set(cluster(spark, left + right + [(5000, "a", 9.999, 2.99, 1.0)], 10.0, 5.0).values()) == {0}


def test_dense_cell_makes_no_square_rows(spark, monkeypatch):
    rows = {}

    def counted(df, name, own=density.written):
        out = own(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(density, "written", counted)
    n = 100_000
    dense = spark.range(n).select("id", (F.rand(1) * 5).alias("x"), (F.rand(2) * 5).alias("y"), F.lit(1.0).alias("w"))
    edge = spark.range(n, 2 * n).select("id", (F.rand(3) * 5 + 20).alias("x"), (F.rand(4) * 5).alias("y"), F.lit(1.0).alias("w"))
    lone = spark.createDataFrame([(2 * n, 12.0, 2.0, 1.0), (2 * n + 1, 500.0, 0.0, 1.0)], "id long, x double, y double, w double")
    got = density.dbscan(dense.unionAll(edge).unionAll(lone), "id", 15.0, 50.0, "w")
    assert {r["cluster"]: r["n"] for r in got.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {0: n + n + 1, None: 1} or got.groupBy("cluster").count().count() == 3
    assert all(v <= 2 * n + 2 for v in rows.values()) and max(rows[k] for k in ("cells-near", "cells-parts", "cells-met", "cells") if k in rows) < 10_000


def test_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 3.0, "a"), (2, 1.0, 0.0, None, "a"), (3, None, 0.0, 9.0, "a"), (4, float("nan"), 0.0, 9.0, "a"), (5, 0.0, 0.0, 9.0, None), (6, 0.0, 0.0, 1.0, "b")], "id long, x double, y double, w double, g string")
    assert {r.id: r.cluster for r in density.dbscan(df, "id", 5.0, 3.0, "w", ["g"]).collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: None}
    assert density.dbscan(df.limit(0), "id", 5.0, 3.0, "w", ["g"]).count() == 0


def test_stable_zones(spark):
    rows = [(i, "m", float(i % 2), 0.0, 100.0, i % 3) for i in range(6)] + [(10 + i, "m", 500.0, float(i), 500.0, 7) for i in range(6)] + [(99, "m", 900.0, 0.0, 1.0, 1), (98, "m", None, 0.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, mine string, x double, y double, duration_s double, vehicle long")
    out = {r.id: (r.stop_cluster, r.cluster_duration_s, r.cluster_windows, r.cluster_vehicles, r.stable_zone) for r in density.stable_zones(df, "id", 5.0, 50.0, "duration_s", ["mine"], "vehicle", 500.0, 4, 2).collect()}
    assert out[0] == (0, 600.0, 6, 3, True) and out[12] == (10, 3000.0, 6, 1, False) and out[99] == out[98] == (None, 0.0, 0, 0, False)
