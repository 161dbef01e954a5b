import os
import random

import pytest
from pyspark.sql import functions as F

import fleetspark.plans  # noqa: F401
from fleetspark.operators import aggregates, ml, sequence
from fleetspark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("by", [[], ["g"]])
def test_area_under_curve_counts_pairs(spark, by):
    rng = random.Random(3)
    rows = [(i % 2, rng.choice([None, *range(9)]), rng.choice([None, True, False])) for i in range(120)] + [(2, 1, True)]
    found = {r["g"] if by else 0: r["auc"] for r in aggregates.area_under_curve(spark.createDataFrame(rows, "g int, s int, y boolean").withColumn("s", F.col("s").cast("double")), "s", "y", by, ranges=4).collect()}
    for g, auc in found.items():
        own = [r for r in rows if (not by or r[0] == g) and r[1] is not None and r[2] is not None]
        t, f = [r[1] for r in own if r[2]], [r[1] for r in own if not r[2]]
        won = [(a > b) + (a == b) / 2 for a in t for b in f]
        assert auc == (pytest.approx(sum(won) / len(won)) if won else None)
    assert set(found) == ({0, 1, 2} if by else {0})


def test_packed_folds_by_hand(spark):
    sizes = {"a": 7, "b": 5, "c": 5, "d": 3, "e": 1, None: 2}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    out = {r["g"]: r["fold"] for r in ml.pack_group_folds(df, "g", 2).distinct().collect()}
    assert out == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}
    assert ml.pack_group_folds(df.limit(0), "g", 2).count() == 0


def test_gate_takes_the_better(spark):
    df = spark.createDataFrame([(10.0, 14.0, 11.0), (20.0, 18.0, 20.0), (None, 5.0, 1.0)], "y double, raw double, c double")
    assert [r["p"] for r in ml.gated(df, "raw", "c", "y", "p", floor=2.0).orderBy("raw").collect()] == [2.0, 11.0, 20.0]
    assert [r["p"] for r in ml.gated(df, "raw", "c", "y", "p", least_gain=50.0).orderBy("raw").collect()] == [5.0, 14.0, 18.0]


def test_one_hot_keeps_training_columns(spark):
    train = spark.createDataFrame([("x",), ("y",), (None,)], "level string")
    levels = ml.one_hot_levels(train, "level")
    out = ml.aligned_one_hot(spark.createDataFrame([("y",), ("new",), (None,)], "level string"), "level", levels).collect()
    assert [tuple(r)[1:] for r in out] == [(0, 1, 0), (0, 0, 0), (0, 0, 1)]
    with pytest.raises(ValueError):
        ml.one_hot_levels(train, "level", most=1)
    odd = spark.createDataFrame([(1.5,), (float("inf"),), (float("nan"),), (None,)], "x double").select(ml.finite(F.col("x")).alias("x"))
    assert [r["x"] for r in odd.collect()] == [1.5, 0.0, 0.0, 0.0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_drift_tells_a_change(spark):
    auc = {r["comparison"]: r["auc"] for r in registry.QUERIES["drift"](spark, DATA).collect()}
    assert auc["faster"] > 0.9 > 0.7 > auc["test"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_importances_sum_to_one(spark):
    rows = registry.QUERIES["importances"](spark, DATA).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1) and [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_exact_quantiles(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 500):
        x = [rng.choice([rng.randrange(20), rng.random() * 20]) for _ in range(n)]
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        qs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
        want = df.where("not isnan(x)").agg(*(F.percentile("x", F.lit(q)).alias(c) for c, q in qs.items())).first()
        found = aggregates.exact_quantiles(df, "x", qs, ranges=8).first()
        assert [found[c] for c in qs] == [want[c] if want[c] is None else pytest.approx(want[c]) for c in qs]


def test_greedy_gate_over_batches(spark):
    rng = random.Random(7)
    rows = [(v, i, rng.choice([None, rng.random() * 5 + i * (v - 1)])) for v in (1, 2, 3) for i in range(60)] + [(4, 1, None)]
    want = set()
    for v in (1, 2, 3):
        last = float("-inf")
        for _, i, x in (r for r in rows if r[0] == v):
            if x is not None and x >= last + 2.5:
                want.add((v, i))
                last = x
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = sequence.greedy_gate(spark.createDataFrame(rows, "v int, i int, x double"), ["v"], ["i"], "x", 2.5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {(r["v"], r["i"]) for r in found} == want and len(found) == len(want)


def test_no_window_orders_a_groups_values(spark):
    """A group that holds most rows: windows over values run by range, too; those by group alone run over the ranges' totals."""
    df = spark.range(4000).select((F.col("id") % 10 > 7).cast("int").alias("g"), (F.col("id") * 7919 % 4001).cast("double").alias("x"), (F.col("id") % 3 == 0).alias("y"))
    for made, value in ((sequence.average_ranks(df, "x", ["g"], "rank"), "x"), (aggregates.area_under_curve(df, "x", "y", ["g"]), "x")):
        text = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and all("__part" in w.split("windowspecdefinition(", 1)[1].split(" ASC")[0] for w in windows if f"{value}#" in w) and any("__p#" in w for w in windows)
    assert df.count() == sequence.average_ranks(df, "x", ["g"], "rank").where("rank IS NOT NULL").count()
