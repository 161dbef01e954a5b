"""Queries of models and of their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.operators import ml
from fleetspark.sources.pings import keyed, pings, shift_totals, sql

from .registry import query

R = F.round
GRID = [(g, a) for g in (0.5, 1.0, 2.0) for a in (0.8, 1.0, 1.2)]


def table(spark, sf_dir):
    return keyed(pings(spark, sf_dir)).groupBy("vehicle", "date", "shift").agg(F.sum("dist").alias("used"), F.count("*").cast("double").alias("n"), F.avg("speed").alias("speed"), F.avg("k").alias("k"), F.avg("ignition").alias("ignition"))


FEATURES = ["n", "speed", "k", "ignition"]


@query("blend_grid", sql("SELECT g.gamma, g.alpha, round(avg(pow(dist - g.alpha * value * pow(k / 99.0::DOUBLE, g.gamma), 2)), 4) AS mse FROM (SELECT p.dist, p.k, p.speed + 100 AS value FROM pings p), (VALUES " + ", ".join(f"({g}::DOUBLE, {a}::DOUBLE)" for g, a in GRID) + ") g(gamma, alpha) GROUP BY ALL"))
def blend_grid(spark, sf_dir):
    p = pings(spark, sf_dir).select("dist", (F.col("k") / 99.0).alias("p"), (F.col("speed") + 100).alias("r"))
    return ml.blend_grid(p, "dist", "p", "r", [0.5, 1.0, 2.0], [0.8, 1.0, 1.2]).withColumn("mse", R("mse", 4))


@query("blend_weight", sql("SELECT round(greatest(0, least(1, sum((a - b) * (dist - b)) / sum((a - b) * (a - b)))), 6) AS weight FROM (SELECT dist, speed * 5 AS a, k * 5.0 AS b FROM pings)"))
def blend_weight(spark, sf_dir):
    p = pings(spark, sf_dir).select("dist", (F.col("speed") * 5).alias("a"), (F.col("k") * 5.0).alias("b"))
    return ml.blend_weight(p, "dist", "a", "b").withColumn("weight", R("weight", 6))


@query("group_folds", sql(", s AS (SELECT vehicle, row_number() OVER (ORDER BY count(*) DESC, vehicle) - 1 AS t FROM pings GROUP BY vehicle) SELECT fold, count(*) AS n FROM pings JOIN (SELECT vehicle, (CASE WHEN (t // 5) % 2 = 0 THEN t % 5 ELSE 4 - t % 5 END)::INT AS fold FROM s) USING (vehicle) GROUP BY fold"))
def group_folds(spark, sf_dir):
    return ml.assign_group_folds(pings(spark, sf_dir), "vehicle").groupBy("fold").agg(F.count("*").alias("n"))


@query("time_splits", sql("SELECT CASE WHEN day(date) <= 15 THEN 'train' WHEN day(date) <= 20 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, round(sum(used), 4) AS used FROM totals GROUP BY 1"))
def time_splits(spark, sf_dir):
    d = F.dayofmonth("date")
    split = F.when(d <= 15, "train").when(d <= 20, "valid").otherwise("test")
    return shift_totals(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"), R(F.sum("used"), 4).alias("used"))


@query("ridge_stack", sql(""", m AS (SELECT speed, dist, avg(speed) OVER () AS ms, avg(dist) OVER () AS md FROM pings), b AS (SELECT sum((speed - ms) * (dist - md)) / (sum((speed - ms) * (speed - ms)) + 10) AS b, any_value(ms) AS ms, any_value(md) AS md FROM m)
SELECT 'speed' AS feature, round(b, 5) AS coefficient FROM b UNION ALL SELECT 'intercept', round(md - b * ms, 5) FROM b"""))
def ridge_stack(spark, sf_dir):
    return ml.ridge(pings(spark, sf_dir).select("speed", "dist"), ["speed"], "dist").withColumn("coefficient", R("coefficient", 5))


@query("post_process", sql("SELECT event_id, round(least(greatest(speed - 40, 0, k / 10.0::DOUBLE), 35), 6) AS predicted FROM pings"))
def post_process(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", R(ml.post_process(F.col("speed") - 40, F.col("k") / 10, F.lit(35.0)), 6).alias("predicted"))


@query("hurdle_model")
def hurdle_model(spark, sf_dir):
    """Two-stage predictions for every shift of the last days, learned from the days before."""
    t = table(spark, sf_dir)
    return ml.hurdle(t.where(F.dayofmonth("date") <= 20), t.where(F.dayofmonth("date") > 20), FEATURES, "used", 200.0).select("vehicle", "date", "shift", "p", "r", "predicted")


@query("gbt_model")
def gbt_model(spark, sf_dir):
    t = table(spark, sf_dir)
    return ml.gbt(t.where(F.dayofmonth("date") <= 20), t.where(F.dayofmonth("date") > 20), FEATURES, "used")[0].select("vehicle", "date", "shift", "used", "predicted")


@query("isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    t = table(spark, sf_dir)
    return ml.isotonic(t, "n", "used").groupBy("n").agg(F.first("calibrated").alias("calibrated"), F.count("*").alias("rows"))


@query("kmeans_places")
def kmeans_places(spark, sf_dir):
    return ml.kmeans(pings(spark, sf_dir).where("speed < 30"), ["x", "y"])


@query("fixed_blend", sql("SELECT event_id, round(speed * 5 * (0.5::DOUBLE / 0.8) + k * 5.0 * (0.3::DOUBLE / 0.8), 6) AS predicted FROM pings"))
def fixed_blend(spark, sf_dir):
    """A blend of two of three predictions by fixed weights, as the third isn't there."""
    p = pings(spark, sf_dir).select("event_id", (F.col("speed") * 5).alias("ensemble"), (F.col("k") * 5.0).alias("stacked"))
    return p.select("event_id", R(ml.fixed_blend(p, {"ensemble": 0.5, "stacked": 0.3, "baseline": 0.2}), 6).alias("predicted"))


@query("kmeans_digest", sql("SELECT 2::BIGINT AS clusters, count(*) AS n, TRUE AS nearer FROM pings WHERE speed < 30"))
def kmeans_digest(spark, sf_dir):
    """The clusters, the points, and that these are nearer to the closest centre than three quarters of as far as to the middle of all, in squares."""
    p = pings(spark, sf_dir).where("speed < 30")
    centres = [r["centre"] for r in ml.kmeans(p, ["x", "y"]).collect()]  # one a cluster
    away = lambda x, y: F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)
    p = p.withColumns({"mx": p.agg(F.avg("x")).scalar(), "my": p.agg(F.avg("y")).scalar()})
    near, all_ = F.least(*(away(F.lit(a), F.lit(b)) for a, b in centres)), away(F.col("mx"), F.col("my"))
    return p.agg(F.lit(len(centres)).cast("long").alias("clusters"), F.count("*").alias("n"), (F.sum(near) < 0.75 * F.sum(all_)).alias("nearer"))
