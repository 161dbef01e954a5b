"""Queries of spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fleetspark.functions import scalars
from fleetspark.operators import density
from fleetspark.operators import polygons as G
from fleetspark.operators import spatial as S
from fleetspark.sources.pings import keyed, pings, sql

from .registry import query

R = F.round

#: Stand-ins for mine layers on the synthetic grid: the supplier's key places a segment.
SEGMENTS_SQL = ", seg AS (SELECT s_suppkey AS geom_id, s_suppkey % 2 AS mine, (s_suppkey * 37 % 900)::DOUBLE AS x1, (s_suppkey * 53 % 900)::DOUBLE AS y1, (s_suppkey * 37 % 900)::DOUBLE + 70 AS x2, (s_suppkey * 53 % 900)::DOUBLE + 30 AS y2 FROM supplier)"


def segments(spark, sf_dir):
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, y = (k * 37 % 900).cast("double"), (k * 53 % 900).cast("double")
    return s.select(k.alias("geom_id"), (k % 2).alias("mine"), x.alias("x1"), y.alias("y1"), (x + 70).alias("x2"), (y + 30).alias("y2"))


DIST = "sqrt(pow(x - x1 - t * 70, 2) + pow(y - y1 - t * 30, 2))"


@query("within_buffer", sql(SEGMENTS_SQL + f""", j AS (SELECT event_id, x, y, x1, y1, greatest(0, least(1, ((x - x1) * 70 + (y - y1) * 30) / 5800.0::DOUBLE)) AS t FROM pings p JOIN seg s ON s.mine = p.mine)
SELECT event_id, bool_or({DIST} <= 20) AS inside FROM j GROUP BY event_id"""))
def within_buffer(spark, sf_dir):
    p = pings(spark, sf_dir).select("event_id", "mine", "x", "y")
    return S.within_buffer(p, segments(spark, sf_dir), 20.0, "event_id", ["mine"]).select("event_id", "inside")


@query("within_rings", sql("""SELECT event_id, (x > 150 AND x < 450 AND y > 150 AND y < 650) <> (x > 350 AND x < 850 AND y > 50 AND y < 350) AS inside FROM pings"""))
def within_rings(spark, sf_dir):
    boxes = [(150.0, 150.0, 450.0, 650.0), (350.0, 50.0, 850.0, 350.0)]
    ring = [(a, b, c, b, 0) for a, b, c, d in boxes] + [(c, b, c, d, 0) for a, b, c, d in boxes] + [(c, d, a, d, 0) for a, b, c, d in boxes] + [(a, d, a, b, 0) for a, b, c, d in boxes]
    s = spark.createDataFrame(ring, "x1 double, y1 double, x2 double, y2 double, z int").drop("z")
    return S.within_rings(pings(spark, sf_dir).select("event_id", "x", "y"), s, "event_id").select("event_id", "inside")


ANCHORS_SQL = SEGMENTS_SQL + ", near AS (SELECT event_id, vehicle, geom_id AS anchor, sqrt(pow(x - x1, 2) + pow(y - y1, 2)) AS d, row_number() OVER (PARTITION BY event_id ORDER BY sqrt(pow(x - x1, 2) + pow(y - y1, 2)), geom_id) AS r FROM pings p JOIN seg s ON s.mine = p.mine AND sqrt(pow(x - x1, 2) + pow(y - y1, 2)) < 80)"


def _near(spark, sf_dir):
    anchors = segments(spark, sf_dir).select("mine", F.col("geom_id").alias("anchor"), F.col("x1").alias("ax"), F.col("y1").alias("ay"))
    return S.nearest_anchor(pings(spark, sf_dir).select("event_id", "vehicle", "mine", "x", "y"), anchors, 80.0, "event_id", ["mine"])


@query("nearest_anchor", sql(ANCHORS_SQL + " SELECT event_id, anchor, round(d, 6) AS distance FROM pings LEFT JOIN (SELECT * FROM near WHERE r = 1) n USING (event_id)"))
def nearest_anchor(spark, sf_dir):
    return _near(spark, sf_dir).select("event_id", "anchor", R("distance", 6).alias("distance"))


@query("assigned_anchor", sql(ANCHORS_SQL + " SELECT vehicle, anchor, n FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY n DESC, anchor) AS r FROM (SELECT vehicle, anchor, count(*) AS n FROM near WHERE r = 1 GROUP BY ALL)) WHERE r = 1"))
def assigned_anchor(spark, sf_dir):
    return S.assigned_anchor(_near(spark, sf_dir), "vehicle")


@query("shift_anchor", sql(""", a AS (SELECT mine, date, shift, median(x) AS ax, median(y) AS ay FROM pings WHERE at_load GROUP BY ALL) SELECT event_id, round(sqrt(pow(x - ax, 2) + pow(y - ay, 2)), 6) AS distance FROM pings JOIN a USING (mine, date, shift)"""))
def shift_anchor(spark, sf_dir):
    """Distance to the median place of all loaders of the mine and shift."""
    p = keyed(pings(spark, sf_dir))
    a = p.where("at_load").groupBy("mine", "date", "shift").agg(F.percentile("x", F.lit(0.5)).alias("ax"), F.percentile("y", F.lit(0.5)).alias("ay"))
    d = scalars.magnitude(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
    return p.join(a, ["mine", "date", "shift"]).select("event_id", R(d, 6).alias("distance"))


def utm_sql() -> str:
    """The projection in SQL, by the series in the third flattening."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    e, radius = 2 * math.sqrt(n) / (1 + n), 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    d = lambda x: f"{x!r}::DOUBLE"
    atanh = lambda x: f"(0.5::DOUBLE * ln((1 + {x}) / (1 - {x})))"
    terms = list(enumerate((n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240), 1))
    east = " + ".join(f"{d(c)} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, c in terms)
    north = " + ".join(f"{d(c)} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, c in terms)
    return sql(f""", c AS (SELECT event_id, sin(radians(23 + x / 10000)) AS s, radians(86 + y / 10000 - 87) AS lam FROM pings), q AS (SELECT *, {atanh('s')} - {d(e)} * {atanh(f'({d(e)} * s)')} AS psi FROM c),
t AS (SELECT *, (exp(psi) - exp(-psi)) / 2 AS t FROM q), g AS (SELECT *, atan2(t, cos(lam)) AS xi, sin(lam) / sqrt(1 + t * t) AS r FROM t), h AS (SELECT *, {atanh('r')} AS eta FROM g)
SELECT event_id, round(500000 + {d(radius)} * (eta + {east}), 3) AS east, round({d(radius)} * (xi + {north}), 3) AS north FROM h""")


@query("utm", utm_sql())
def utm(spark, sf_dir):
    """Transverse Mercator of places near 23 N 86 E; also tested against known points."""
    p = pings(spark, sf_dir)
    east, north = scalars.utm(23 + F.col("x") / 10000, 86 + F.col("y") / 10000)
    return p.select("event_id", R(east, 3).alias("east"), R(north, 3).alias("north"))


@query("stop_clusters")
def stop_clusters(spark, sf_dir):
    """Density clusters of each mine's stopping places, weighted by visits."""
    p = pings(spark, sf_dir).where("speed < 30").groupBy("mine", "x", "y").agg(F.count("*").cast("double").alias("w"))
    p = p.withColumn("id", (F.col("mine") * 10000 + F.col("x") / 10 + F.col("y") / 1000).cast("string"))
    p = p.withColumn("x", F.col("x") * 0.5 + F.col("y") * 0.11).withColumn("y", F.col("y") * 0.5)
    return density.dbscan(p, "id", 52.0, 3.0, "w", ["mine"]).select("id", "mine", "w", "cluster")


#: Pits by the supplier's key: a box of 250 by 180 whose top is open in one of three, with a spur across its right side.
PITS_SQL = ", pit AS (SELECT s_suppkey AS pit, s_suppkey % 3 = 0 AS gap, (s_suppkey * 37 % 600)::DOUBLE AS x0, (s_suppkey * 53 % 600)::DOUBLE AS y0 FROM supplier), c AS (SELECT count(*) AS n FROM supplier)"


def pits(spark, sf_dir):
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("pit"), (k % 3 == 0).alias("gap"), (k * 37 % 600).cast("double").alias("x"), (k * 53 % 600).cast("double").alias("y"))
    line = lambda a, b, c, d: F.struct((F.col("x") + a).alias("x1"), (F.col("y") + b).alias("y1"), (F.col("x") + c).alias("x2"), (F.col("y") + d).alias("y2"))
    box = F.array(line(0, 0, 250, 0), line(250, 0, 250, 180), line(0, 180, 0, 0))
    rest = F.when(F.col("gap"), F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).otherwise(F.array(line(250, 180, 0, 180), line(200, 90, 330, 140)))
    return s.select("pit", F.inline(F.concat(box, rest)))


@query("zone_polygons", sql(PITS_SQL + """, p AS (SELECT event_id, x - x0 AS u, y - y0 AS v, gap FROM (SELECT pings.*, vehicle % n AS pit FROM pings, c) LEFT JOIN pit USING (pit)),
d AS (SELECT *, greatest(-u, 0, u - 250) AS dx, greatest(-v, 0, v - 180) AS dy FROM p)
SELECT event_id, coalesce(CASE WHEN u IS NULL THEN FALSE WHEN gap THEN least(dx * dx + v * v, u * u + dy * dy, pow(u - 250, 2) + dy * dy) <= 40 * 40 ELSE dx * dx + dy * dy <= 20 * 20 END, FALSE) AS inside FROM d"""))
def zone_polygons(spark, sf_dir):
    """Whether each ping is in its vehicle's pit: near the area that the pit's lines close, or near the lines where they leave a gap."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.count("*")).scalar()
    p = pings(spark, sf_dir).select("event_id", "x", "y", (F.col("vehicle") % n).alias("pit"))
    return G.within_zones(p, pits(spark, sf_dir), 40.0, "event_id", ["pit"]).select("event_id", "inside")
