"""Queries of stops: windows of standing still, and the zones that they keep to."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions import keys
from fleetspark.operators import aggregates as A
from fleetspark.operators import density
from fleetspark.operators import sequence as S
from fleetspark.sources.pings import keyed, pings, sql

from .registry import query

R = F.round
ORDER = ["ts", "event_id"]
#: Speed below which a vehicle stands, and the seconds that make a window.
STANDS, LEAST = 30, 3600.0
#: Reach and weight of clusters; duration, windows and vehicles of a zone that stays.
EPS, WEIGHT, STAYS = 60.0, 4.0e6, (2.0e7, 40, 20)


def windows(spark, sf_dir):
    """Windows of standing of at least LEAST seconds, by one ordered pass a vehicle and one aggregation: 16 columns and the island's number."""
    w = S.ordered(["vehicle"], ORDER)
    p = keyed(pings(spark, sf_dir)).withColumn("slow", F.coalesce(F.col("speed") < STANDS, F.lit(False)))
    p = p.withColumns({"dt": keys.gap_seconds(["vehicle"], tiebreak="event_id", cap=86400.0), "pos": S.position(w).cast("long"), "path": S.running(F.col("dist"), w)})
    p = S.island_id(p, "slow", ["vehicle"], ORDER).where("slow").withColumn("at", F.struct(*ORDER))
    median = lambda c: F.percentile(c, F.lit(0.5))
    out = p.groupBy("vehicle", F.col("island").cast("long").alias("island")).agg(
        F.first("mine").alias("mine"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), A.last_by("date", "at").alias("date"), A.last_by("shift", "at").alias("shift"),
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.sum("dt").alias("duration_s"), median("x").alias("x_median"), median("y").alias("y_median"),
        A.first_by("path", "at").alias("start_cum_path_m"), A.last_by("path", "at").alias("end_cum_path_m"), F.avg("speed").alias("mean_speed"), F.min("speed").alias("min_speed"), F.avg("ignition").alias("ignition_share"),
    )
    return out.where(F.col("duration_s") >= LEAST)


WINDOWS_SQL = f""", s AS (SELECT *, least(greatest(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0), 0), 86400) AS dt, row_number() OVER w - 1 AS pos, sum(dist) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS path,
  coalesce(speed < {STANDS}, FALSE) AS slow, CASE WHEN lag(coalesce(speed < {STANDS}, FALSE)) OVER w IS DISTINCT FROM coalesce(speed < {STANDS}, FALSE) THEN 1 ELSE 0 END AS c FROM pings WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)),
i AS (SELECT *, (sum(c) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM s),
win AS (SELECT vehicle, island, any_value(mine) AS mine, min(ts) AS start_ts, max(ts) AS end_ts, last(date ORDER BY ts, event_id) AS date, last(shift ORDER BY ts, event_id) AS shift, min(pos) AS start_pos, max(pos) AS end_pos, sum(dt) AS duration_s,
  median(x) AS x_median, median(y) AS y_median, first(path ORDER BY ts, event_id) AS start_cum_path_m, last(path ORDER BY ts, event_id) AS end_cum_path_m, avg(speed) AS mean_speed, min(speed) AS min_speed, avg(ignition) AS ignition_share
  FROM i WHERE slow GROUP BY vehicle, island HAVING sum(dt) >= {LEAST})"""
ROUNDED = ["duration_s", "start_cum_path_m", "end_cum_path_m", "mean_speed", "ignition_share"]


@query("stop_windows", sql(WINDOWS_SQL + f" SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in ROUNDED)}) FROM win"))
def stop_windows(spark, sf_dir):
    return windows(spark, sf_dir).withColumns({c: R(F.col(c) + 1e-9, 4) for c in ROUNDED})


ZONES_SQL = WINDOWS_SQL.replace(", s AS", "s AS", 1) + f""", k AS (SELECT vehicle * 100000 + island AS id, * FROM win WHERE vehicle IS NOT NULL),
place AS (SELECT mine, x_median AS x, y_median AS y, sum(duration_s) AS w, min(id) AS id FROM k GROUP BY ALL),
near AS (SELECT p.id AS a, q.id AS b, q.w FROM place p JOIN place q ON p.mine = q.mine AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) <= {EPS * EPS}),
core AS (SELECT a FROM near GROUP BY a HAVING sum(w) >= {WEIGHT}),
link AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
named AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
label AS (SELECT a, c FROM named UNION ALL SELECT near.a, min(c) FROM near JOIN named ON named.a = near.b WHERE near.a NOT IN (SELECT a FROM core) GROUP BY near.a),
z AS (SELECT k.*, label.c AS stop_cluster FROM k JOIN place ON k.mine = place.mine AND k.x_median = place.x AND k.y_median = place.y LEFT JOIN label ON label.a = place.id),
t AS (SELECT stop_cluster, sum(duration_s) AS cluster_duration_s, count(*) AS cluster_windows, count(DISTINCT vehicle) AS cluster_vehicles FROM z WHERE stop_cluster IS NOT NULL GROUP BY ALL)
SELECT vehicle, island, stop_cluster, round(coalesce(cluster_duration_s, 0), 2) AS cluster_duration_s, coalesce(cluster_windows, 0) AS cluster_windows, coalesce(cluster_vehicles, 0) AS cluster_vehicles,
  coalesce(cluster_duration_s >= {STAYS[0]} AND cluster_windows >= {STAYS[1]} AND cluster_vehicles >= {STAYS[2]}, FALSE) AS stable_zone FROM z LEFT JOIN t USING (stop_cluster)"""


@query("stop_zones", sql(", " + ZONES_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def stop_zones(spark, sf_dir):
    """The windows' density clusters, weighted by duration, and which of them are zones that stay."""
    k = windows(spark, sf_dir).where("vehicle IS NOT NULL").withColumn("id", F.col("vehicle") * 100000 + F.col("island")).withColumnsRenamed({"x_median": "x", "y_median": "y"})
    z = density.stable_zones(k, "id", EPS, WEIGHT, "duration_s", ["mine"], "vehicle", *STAYS)
    return z.select("vehicle", "island", "stop_cluster", R("cluster_duration_s", 2).alias("cluster_duration_s"), "cluster_windows", "cluster_vehicles", "stable_zone")
