import datetime as dt
import os
import random
import sqlite3
import struct

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import fleetspark.plans  # noqa: F401
from fleetspark.functions import keys, scalars
from fleetspark.operators import aggregates, density, joins, ml, quality, sequence, spatial, stats
from fleetspark.plans import registry
from fleetspark.sources import files

DATA = "/root/testdata/sf0.001"


def value(x):
    return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else float(x) if isinstance(x, bool) else x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = db.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=order)
    b = sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=order)
    assert a == b


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_operational_days_and_shifts(spark):
    t = [dt.datetime(2026, 1, 5, 22, 30), dt.datetime(2026, 1, 6, 2), dt.datetime(2026, 1, 6, 10), dt.datetime(2026, 1, 6, 21, 59, 59), None]
    df = frame(spark, [(i, x) for i, x in enumerate(t)], "i int, ts timestamp_ntz")
    days = {"plus2h": [6, 6, 6, 6, None], "carry_back": [5, 5, 6, 6, None], "late_back": [4, 6, 6, 6, None], "minus22h": [5, 5, 5, 5, None]}
    for family, want in days.items():
        got = [r[0] for r in df.orderBy("i").select(F.dayofmonth(keys.op_date(F.col("ts"), family))).collect()]
        assert got == want, family
    with pytest.raises(ValueError):
        keys.op_date(F.col("ts"), "other")
    hours = [(5, 59, 59), (6, 0, 0), (13, 59, 59), (14, 0, 0), (21, 59, 59), (22, 0, 0)]
    df = frame(spark, [(i, dt.datetime(2026, 1, 1, *h)) for i, h in enumerate(hours)], "i int, ts timestamp_ntz")
    assert "".join(r[0] for r in df.orderBy("i").select(keys.shift_label(F.col("ts"))).collect()) == "CAABBC"


def test_gaps(spark):
    t0 = dt.datetime(2026, 1, 1)
    df = frame(spark, [("v", t0 + dt.timedelta(seconds=s)) for s in (0, 10, 310, 611, 7811)], "v string, ts timestamp_ntz")
    assert [r[0] for r in df.select("ts", keys.gap_seconds(["v"]).alias("g")).orderBy("ts").select("g").collect()] == [0, 10, 300, 300, 300]


def test_edges_and_fills(spark):
    df = frame(spark, list(enumerate([3.0, 3.0, 0.1, 2.5, 2.6, None, 3.0])), "i int, a double").withColumn("v", F.lit(1))
    w = sequence.ordered(["v"], ["i"])
    run = lambda c: [r[0] for r in df.select("i", c.alias("c")).orderBy("i").select("c").collect()]
    assert run(sequence.rising_edge(F.col("a") > 2.5, w)) == [True, False, False, False, True, False, True]
    assert run(sequence.rising_edge(F.col("a") > 2.5, w, False)) == [False, False, False, False, True, False, True]
    alt = frame(spark, list(enumerate([None, 1.0, None, None, 4.0, None])), "i int, a double").withColumn("v", F.lit(1))
    assert [r.a for r in sequence.interpolate(alt, "a", ["v"], ["i"], 1).orderBy("i").collect()] == [1, 1, 2, 3, 4, 4]
    assert run(scalars.clip(F.col("a"), 1.0, 2.9)) == [2.9, 2.9, 1.0, 2.5, 2.6, None, 2.9]
    assert run(sequence.forward_fill(F.col("a"), w))[5] == 2.6


def test_balance_state_and_gate(spark):
    df = frame(spark, list(enumerate("LDDLD")), "i int, e string").withColumn("v", F.lit(1))
    w = sequence.ordered(["v"], ["i"])
    got = df.select("i", sequence.running_balance(F.col("e") == "L", F.col("e") == "D", w).alias("b")).orderBy("i")
    assert [r.b for r in got.collect()] == [1, 0, 0, 0, 0]
    df = frame(spark, [(0, True, False), (1, True, False), (2, False, False), (3, False, True)], "i int, l boolean, d boolean").withColumn("v", F.lit(1))
    assert [r.loaded for r in sequence.filled_state(df, "l", "d", ["v"], ["i"]).orderBy("i").collect()] == [1, 1, 1, 0]
    df = frame(spark, list(enumerate([0.0, 500.0, 900.0, 1000.0, 1900.0])), "i int, p double").withColumn("v", F.lit(1))
    assert [r.p for r in sequence.greedy_gate(df, ["v"], ["i"], "p", 800.0).orderBy("i").collect()] == [0, 900, 1900]


def test_asof_and_trailing(spark):
    day = dt.datetime(2026, 1, 1)
    left = frame(spark, [("v", day.replace(hour=14)), ("w", day.replace(hour=14)), (None, day)], "v string, t timestamp_ntz")
    right = frame(spark, [("v", day.replace(hour=10), 1.0), ("v", day.replace(hour=14), 2.0), ("v", day.replace(hour=10), 0.5)], "v string, r timestamp_ntz, x double")
    got = lambda exact: {r.v: r.last_x for r in joins.asof_join(left, right, ["v"], "t", "r", ["x"], exact, ["x"]).collect()}
    assert got(False) == {"v": 1.0, "w": None, None: None} and got(True)["v"] == 2.0
    t = {r.v: (r.trailing_sum, r.trailing_count) for r in joins.trailing(left, right, ["v"], "t", "r", "x").collect()}
    assert t["v"] == (1.5, 2) and t["w"] == (0.0, 0)
    plan = joins.asof_join(left, right, ["v"], "t", "r", ["x"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Python" not in plan


def test_asof_matches_pandas(spark):
    rng = random.Random(1)
    at = lambda: pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=rng.randrange(3000))
    left = pd.DataFrame({"v": [rng.randrange(4) for _ in range(200)], "t": [at() for _ in range(200)], "i": range(200)}).sort_values("t")
    right = pd.DataFrame({"v": [rng.randrange(4) for _ in range(60)], "r": [at() for _ in range(60)]}).drop_duplicates().sort_values("r")
    right["x"] = range(len(right))
    want = pd.merge_asof(left, right, left_on="t", right_on="r", by="v", allow_exact_matches=False).set_index("i")["x"]
    out = joins.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["v"], "t", "r", ["x"]).collect()
    assert {r.i: r.last_x for r in out} == {i: None if pd.isna(x) else int(x) for i, x in want.items()}


def test_missing_values(spark):
    df = frame(spark, [("a", None), ("a", None), ("b", 1.0), ("b", float("nan"))], "v string, x double")
    df = files.no_nans(df)
    out = {r.v: r for r in df.groupBy("v").agg(aggregates.total(F.col("x")).alias("s"), F.stddev("x").alias("d"), F.max("x").alias("m")).collect()}
    assert (out["a"].s, out["a"].d, out["b"].s, out["b"].m) == (0.0, None, 1.0, 1.0)
    m = frame(spark, [(x,) for x in (2, 1, 2, 1, 3)], "x int").withColumn("v", F.lit(1))
    assert aggregates.mode_least(m, ["v"], "x").first().x == 1


def test_ranks(spark):
    df = frame(spark, [(10,), (20,), (20,), (30,), (None,)], "x int")
    assert sorted((r[0] for r in df.select(sequence.average_rank(F.col("x")).alias("r")).collect()), key=str) == [0.25, 0.625, 0.625, 1.0, None]


def test_history_is_leak_safe(spark):
    df = frame(spark, [("v", d, float(d)) for d in range(1, 7)], "v string, d int, y double")
    h = {r.d: r for r in joins.history_before(df, ["v"], "d", "y").collect()}
    assert h[1].history_n == 0 and h[1].history_ewma is None and h[3].history_mean == 1.5
    w = [0.75**i for i in range(5)]
    assert h[6].history_ewma == pytest.approx(sum(a * b for a, b in zip(w, (5, 4, 3, 2, 1))) / sum(w))
    f = stats.out_of_fold_mean(df.withColumn("f", F.col("d") % 2), ["v"], "f", "y")
    assert {r.d: r.oof_mean for r in f.collect()} == {1: 4, 3: 4, 5: 4, 2: 3, 4: 3, 6: 3}


def test_cycles_share_their_ends(spark):
    df = frame(spark, [(i, i in (0, 4)) for i in range(6)], "i int, e boolean").withColumn("v", F.lit(1))
    assert sorted(r.i for r in joins.cycles(df, "e", ["v"], ["i"]).collect()) == [0, 1, 2, 3, 4]


def test_spatial_against_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, i % 2, rng.uniform(-50, 400), rng.uniform(-50, 400)) for i in range(300)]
    seg = [(rng.randrange(2), *(rng.uniform(0, 350) for _ in range(4))) for _ in range(12)]

    def dist(x, y, a, b, c, d):
        n = (c - a) ** 2 + (d - b) ** 2
        t = max(0, min(1, ((x - a) * (c - a) + (y - b) * (d - b)) / n)) if n else 0
        return ((x - a - t * (c - a)) ** 2 + (y - b - t * (d - b)) ** 2) ** 0.5

    p = frame(spark, pts, "id int, m int, x double, y double")
    s = frame(spark, seg, "m int, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.inside for r in spatial.within_buffer(p, s, 20.0, "id", ["m"]).collect()}
    assert got == {i: any(k == m and dist(x, y, *z) <= 20 for k, *z in seg) for i, m, x, y in pts}
    rim = frame(spark, [(1, 0.0, 20.0), (2, 0.0, 20.01)], "id int, x double, y double")
    line = frame(spark, [(-5.0, 0.0, 5.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    assert {r.id: r.inside for r in spatial.within_buffer(rim, line, 20.0, "id").collect()} == {1: True, 2: False}


def test_dbscan_against_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, rng.uniform(0, 300), rng.uniform(0, 300), float(rng.randrange(1, 4))) for i in range(120)]
    near = {a: [b for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 400] for a in pts}
    core = {a for a in pts if sum(b[3] for b in near[a]) >= 6}
    name = {a: a[0] for a in core}
    for _ in pts:
        for a in core:
            name[a] = min(name[b] for b in near[a] if b in core)
    want = {a[0]: name[a] if a in core else min((name[b] for b in near[a] if b in core), default=None) for a in pts}
    got = density.dbscan(frame(spark, pts, "id int, x double, y double, w double"), "id", 20.0, 6.0, "w")
    assert {r.id: r.cluster for r in got.collect()} == want


def test_projection(spark):
    df = frame(spark, [(0.0, 87.0), (23.0, 86.0), (60.0, 90.0)], "lat double, lon double")
    e, n = scalars.utm(F.col("lat"), F.col("lon"))
    rows = df.select(e.alias("e"), n.alias("n")).collect()
    assert abs(rows[0].e - 500000) < 1e-6 and abs(rows[0].n) < 1e-6
    assert abs(rows[1].e - 397514.7) < 5 and abs(rows[1].n - 2543923.0) < 200  # by the series' first terms
    assert rows[2].e > 500000


def test_models(spark):
    df = frame(spark, [(g, float(i), 2.0 * i + 1, 1.0) for g in range(7) for i in range(g + 1)], "g int, x double, y double, z double")
    folds = ml.assign_group_folds(df, "g", 3)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and folds.select("fold").distinct().count() == 3
    c = {r.feature: r.coefficient for r in ml.ridge(df, ["x"], "y", 0.0).collect()}
    assert c["x"] == pytest.approx(2) and c["intercept"] == pytest.approx(1)
    got = [r.calibrated for r in ml.isotonic(df.select("x", "y"), "x", "y").orderBy("x").collect()]
    assert got == sorted(got)


def test_gates(spark):
    df = frame(spark, [(1, 1.0), (2, None)], "id int, x double")
    for broken in (lambda: quality.no_nulls(df, ["x"]), lambda: quality.same_rows(df, df.where("id = 1"), "id"), lambda: quality.rows_at_least(df, 3), lambda: quality.has_columns(df, ["y"]), lambda: quality.no_leaks(["initlev_x"], ["initlev"]), lambda: quality.same_family("plus2h", "late_back")):
        with pytest.raises(quality.GateError):
            broken()
    assert quality.same_rows(df, df, "id") is df


def test_files(spark, tmp_path):
    df = frame(spark, [(1, "a", float("nan")), (2, "b", 2.0)], "id int, s string, x double")
    df.write.parquet(str(tmp_path / "t_2026-01-01_2026-01-10.parquet"))
    found = sorted({os.path.dirname(p) for p in files.discover(spark, str(tmp_path))})
    assert files.in_window(found, "2026-01-01", "2026-01-31") == found and files.in_window(found, "2026-01-02", "2026-01-31") == []
    got = files.read_parquet(spark, found, ["id", "x", "extra"], defaults={"extra": 7.0}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, None, 7.0), (2, 2.0, 7.0)]
    files.write_csv(df, str(tmp_path / "c"), True)
    assert files.read_csv(spark, str(tmp_path / "c"), df.schema, ["id", "s"]).count() == 2
    files.write_feather(df, str(tmp_path / "f"))
    assert files.read_feather(spark, str(tmp_path / "f")).count() == 2
    assert files.write_part(df, str(tmp_path / "parts"), "day", "1") and not files.write_part(df, str(tmp_path / "parts"), "day", "1")
    assert files.resolve(df.toDF("Id No", "S", "X"), "idno") == "Id No" and files.tidy_names(df.toDF(" Id No", "S", "X")).columns == ["id_no", "s", "x"]
    assert files.by_role(["a/telemetry_1.parquet", "b/rfid.parquet"], {"t": "telemetry", "r": "rfid"})["r"] == ["b/rfid.parquet"]


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "mine.gpkg")
    line = struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 3.0, 4.0)
    multi = struct.pack("<BII", 1, 5, 1) + struct.pack("<BII6d", 1, 1002, 2, 1.0, 1.0, 9.0, 2.0, 1.0, 9.0)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('haul_road', 'geom')")
        db.execute("CREATE TABLE haul_road (geom BLOB)")
        db.executemany("INSERT INTO haul_road VALUES (?)", [(b"GP\0\1" + struct.pack("<i", 32645) + line,), (b"GP\0\3" + struct.pack("<i4d", 32645, 0, 1, 0, 1) + multi,)])
    rows = sorted(tuple(r) for r in files.read_layers(spark, path, "m").collect())
    assert rows == [("m", "haul_road", 0, 0, 0, 0.0, 0.0, 3.0, 4.0), ("m", "haul_road", 1, 0, 0, 1.0, 1.0, 2.0, 1.0)]


def test_streams_give_what_batches_give(spark, tmp_path):
    from fleetspark.sources.pings import pings
    from fleetspark.streaming import shifts

    p = pings(spark, DATA).select("vehicle", "event_id", F.col("ts").cast("timestamp").alias("ts"), "dist", "at_load", "at_dump")
    src = str(tmp_path / "in")
    p.write.parquet(src)
    stream = spark.readStream.schema(p.schema).parquet(src)
    q = shifts.shift_windows(stream, "1 day").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    key = lambda rows: sorted((r.vehicle, str(r.start), r.n) for r in rows)
    assert key(spark.sql("select * from win").collect()) == key(shifts.shift_windows(p).collect())


def test_checkpoint_folder_unset(spark, monkeypatch):
    from fleetspark import storage

    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *d: d[0] if key == "spark.checkpoint.dir" else get(self, key, *d))
    t = storage.written(spark.range(3), "t")
    assert t.count() == 3 and storage.shared_dir(spark) == storage.shared_dir(spark)
    path = storage._PATHS[t]
    storage.discard(t)
    assert not os.path.exists(path.removeprefix("file://"))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(spark)


def test_broadcast_by_bytes(spark):
    from fleetspark.storage import bounded

    df = spark.range(1000).selectExpr("id", "cast(id as string) as s")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(bounded(df)) and not hinted(bounded(df, 1000)) and hinted(bounded(df.limit(0), 0))


def test_components_with_and_without_contraction(spark, monkeypatch):
    from fleetspark.operators import graph

    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7), (None, 3)]
    root = list(range(6000))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(i, find(i)) for e in edges if e[0] is not None and e[0] != e[1] for i in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for contract in (False, True):
        got = [tuple(r) for r in graph.components(df, contract=contract).collect()]
        assert len(got) == len(want) and set(got) == want
    assert graph.components(df.limit(0), contract=True).collect() == []


def test_ranks_without_large_windows(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate([("a", 3), ("a", 1), ("a", 3), ("a", None), ("b", 5), (None, 2), ("b", 5)])]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    want = {r.i: r.w for r in df.where("g is not null").select("i", sequence.average_rank(F.col("v"), ["g"]).alias("w")).collect()}
    got = {r.i: r.r for r in sequence.average_ranks(df, "v", ["g"], "r").collect()}
    assert len(got) == len(rows) and got.pop(5) is None and got == want


def test_asof_ties_are_told_apart_by_value(spark):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", t + dt.timedelta(1))], "k string, ts timestamp")
    right = spark.createDataFrame([("a", t, -2, "x" * 30 + "b"), ("a", t, 10, "x" * 30 + "a"), ("a", t, 9, "z")], "k string, rts timestamp, n int, s string")
    take = lambda order: joins.asof_join(left, right, ["k"], "ts", "rts", ["n"], order=order).first()["last_n"]
    assert take(["n"]) == 10 and take(["s"]) == 9
    assert take(["n", "s"]) == 10 and joins.asof_join(left, right.limit(0), ["k"], "ts", "rts", ["n"], order=["n"]).first()["last_n"] is None


def test_blend_of_what_is_there(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(ml.fixed_blend(df, {"a": 0.25, "b": 0.75, "c": 9.0})).collect()] == [2.5, None]
    with pytest.raises(ValueError):
        ml.fixed_blend(df, {"c": 1.0})
