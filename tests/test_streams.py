import os
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import sequence
from fleetspark.operators.joins import trailing
from fleetspark.streaming import ordered, shifts

BASE = 1_700_000_000


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def arrivals(spark, folder, rows, schema, per):
    """One Parquet file a micro-batch of ``per`` rows, in the order of ``rows``; a stream over them, and the whole table."""
    os.makedirs(folder)
    for i in range(0, len(rows), per):
        spark.createDataFrame(rows[i : i + per], schema).coalesce(1).write.parquet(f"{folder}/batch={i:06}")
        for f in os.listdir(f"{folder}/batch={i:06}"):
            os.utime(f"{folder}/batch={i:06}/{f}", (BASE + i, BASE + i))
    kind = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/batch=*"), spark.createDataFrame(rows, schema)


def run(df, spark, name, tmp):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp}/{name}").start()
    q.awaitTermination()
    return spark.table(name).collect(), q


def shuffled(rows, by, window, seed):
    """Rows in an order in which none comes more than ``window`` seconds behind the latest before it."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: (by(r) + rng.random() * window, rng.random()))


def pings(seed=1, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k, v = rng.randrange(100), rng.choice((1, 1, 1, 2, 3))
        rows.append((v, i, BASE + rng.randrange(200) * 60, rng.choice([None, k < 30]), rng.choice([None, k >= 75, k >= 75]), rng.choice([None, float("nan"), rng.random() * 100 + i])))
    rows += [(1, n + 1, None, True, False, 1.0), (None, n + 2, BASE, True, False, 1.0)]
    return rows


SCHEMA = "vehicle long, event_id long, s long, at_load boolean, at_dump boolean, odo double"


def instants(df):
    return df.withColumn("ts", F.timestamp_seconds("s"))


LAST = [(9, 10_000, BASE + 10**6, False, False, None)]  # moves the watermark beyond all others


def test_load_states_of_shuffled_arrivals(spark, tmp_path):
    rows = shuffled([r for r in pings() if r[2]], lambda r: r[2], 3000, 2) + [r for r in pings() if not r[2]] + LAST
    stream, table = arrivals(spark, str(tmp_path / "in"), rows, SCHEMA, 60)
    got, q = run(ordered.load_states(instants(stream), "1 hour"), spark, "loads", tmp_path)
    w = sequence.ordered(["vehicle"], ["ts", "event_id"])
    batch = instants(table).where("ts IS NOT NULL AND vehicle IS NOT NULL AND vehicle <> 9").withColumn("e", sequence.load_state(F.col("at_load"), F.col("at_dump"), w))
    want = batch.select("vehicle", "event_id", F.coalesce(sequence.forward_fill(F.col("e"), w), F.lit(0)).alias("loaded"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and ordered.dropped(q) == 0
    assert {r.loaded for r in got} == {0, 1}


def test_gate_of_shuffled_arrivals(spark, tmp_path):
    rows = shuffled([r for r in pings(5) if r[2]], lambda r: r[2], 3000, 3) + LAST
    stream, table = arrivals(spark, str(tmp_path / "in"), rows, SCHEMA, 70)
    got, _ = run(ordered.gated_rows(instants(stream), 9.0, "odo", "1 hour"), spark, "gates", tmp_path)
    batch = instants(table).where("vehicle IS NOT NULL")
    want = sequence.greedy_gate(batch, ["vehicle"], ["ts", "event_id"], "odo", 9.0)
    assert sorted((r.vehicle, r.event_id) for r in got) == sorted((r.vehicle, r.event_id) for r in want.collect()) and len(got) > 5


def test_rows_that_come_too_late_are_dropped_and_counted(spark, tmp_path):
    first = [(1, i, BASE + i * 600, i % 4 == 0, i % 4 == 2, None) for i in range(24)]
    late = [(1, 100, BASE + 22 * 600 + 1, False, True, None)]  # within an hour of the latest
    too_late = [(1, 101, BASE, True, False, None), (1, 102, BASE + 600, True, False, None)]
    # what the first file moves the watermark to holds for rows of the third: it is what the second one was given out by
    second = [(2, 50 + i, BASE + 23 * 600, True, False, None) for i in range(24)]
    stream, _ = arrivals(spark, str(tmp_path / "in"), first + second + late + too_late + LAST, SCHEMA, 24)
    got, q = run(ordered.load_states(instants(stream), "1 hour"), spark, "late", tmp_path)
    own = {r.event_id: r.loaded for r in got if r.vehicle == 1}
    assert ordered.dropped(q) == 2 and set(own) == {*range(24), 100}
    assert own[21] == 1 and own[22] == own[100] == own[23] == 0 and own[0] == own[20] == 0


def test_sliding_windows_late_rows(spark, tmp_path):
    rows = [(1, i, BASE + i * 3600, None, None, 1.0) for i in range(120)]
    late, too_late = (1, 200, BASE + 100 * 3600, None, None, 5.0), (1, 201, BASE, None, None, 7.0)
    stream, table = arrivals(spark, str(tmp_path / "in"), rows + [late, too_late] + [(9, 1, BASE + 10**7, None, None, 1.0)], SCHEMA, 60)
    made = lambda d: shifts.sliding_day(instants(d).withColumn("dist", F.col("odo")), "1 day" if d.isStreaming else None)
    got, q = run(made(stream), spark, "slides", tmp_path)
    want = {(r.vehicle, r.end): (r.n, r.km) for r in made(table.where("event_id <> 201")).collect() if r.vehicle == 1}
    assert {(r.vehicle, r.end): (r.n, r.km) for r in got if r.vehicle == 1} == want
    assert ordered.dropped(q) > 0 and sum(n for n, _ in want.values()) == 121 * 3  # each row is in three windows


def test_interval_join_of_streams(spark, tmp_path):
    rng = random.Random(4)
    starts = [(v, BASE + k * 8 * 3600) for v in (1, 2, 3) for k in range(20)] + [(1, None)]
    fuel = [(rng.choice((1, 1, 2)), BASE + rng.randrange(20 * 8 * 3600) // 900 * 900, rng.choice([None, float(rng.randrange(50))])) for _ in range(80)] + [(None, BASE, 1.0)]
    end = BASE + 10**7
    s, st = arrivals(spark, str(tmp_path / "s"), shuffled(starts[:-1], lambda r: r[1], 7000, 1) + [(9, end), (9, end + 10**6)], "vehicle long, s long", 20)
    f, ft = arrivals(spark, str(tmp_path / "f"), shuffled(fuel, lambda r: r[1], 7000, 2) + [(9, end, 1.0), (9, end + 10**6, 1.0)], "vehicle long, s long, litres double", 25)
    shape = lambda a, b: (a.select("vehicle", F.timestamp_seconds("s").alias("start")), b.select("vehicle", F.timestamp_seconds("s").alias("refuel_ts"), "litres"))
    got, _ = run(ordered.trailing_refuels(*shape(s, f), watermark="2 hours"), spark, "trails", tmp_path)
    got = sorted(tuple(r) for r in got if r.vehicle != 9)
    assert got == sorted(tuple(r) for r in ordered.trailing_refuels(*shape(st, ft)).collect() if r.vehicle != 9) and len(got) == 60
    sums = {(r.vehicle, r.start): r.trailing_sum for r in trailing(*shape(st, ft.where("vehicle IS NOT NULL")), ["vehicle"], "start", "refuel_ts", "litres").collect()}
    assert {(v, t): x for v, t, _, x, _ in got} == {k: x for k, x in sums.items() if k[0] != 9}
