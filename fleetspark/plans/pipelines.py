"""Whole feature pipelines: one row a vehicle and shift, or day, by one pass of windows and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import keys, scalars
from fleetspark.operators import aggregates as A
from fleetspark.operators import sequence as S
from fleetspark.operators.joins import asof_join, trailing
from fleetspark.sources.pings import keyed, pings, refuels, shift_totals, sql

from .registry import query

R = F.round


def signals(p: DataFrame, by: list[str], cap: float = 86400.0, moving: float = 2.0, dump: float = 2.5) -> DataFrame:
    """Per-row signals of an ordered entity; all share one window, so one shuffle and one sort."""
    w = S.ordered(by, ["ts", "event_id"])
    p = p.withColumns({
        "dt": keys.gap_seconds(by, tiebreak="event_id", cap=cap), "d_alt": F.coalesce(S.change(F.col("k"), w), F.lit(0)).cast("double"),
        "edge": S.rising_edge(F.col("analog") > dump, w), "before": F.lag("speed").over(w),
    })
    on, fast = F.col("ignition") == 1, F.col("speed") > moving
    return p.withColumns({"on_s": F.when(on, F.col("dt")).otherwise(0.0), "moving_s": F.when(fast, F.col("dt")).otherwise(0.0), "idle_s": F.when(on & ~fast, F.col("dt")).otherwise(0.0), "stop": (F.coalesce(F.col("before") > moving, F.lit(False)) & ~fast & on).cast("int")})


def features(s: DataFrame, by: list[str]) -> DataFrame:
    """Aggregates of ``signals``."""
    s = s.withColumn("at", F.struct("ts", "event_id"))
    out = s.groupBy(*by).agg(
        F.count("*").alias("n_pings"), (F.sum("on_s") / 3600).alias("ignition_h"), (F.sum("moving_s") / 3600).alias("moving_h"), (F.sum("idle_s") / 3600).alias("idle_h"),
        (A.total(F.col("dist")) / 1000).alias("km"), F.sum(scalars.rise(F.col("d_alt"))).alias("climb_m"), F.sum(scalars.fall(F.col("d_alt"))).alias("descent_m"), (A.last_by("k", "at") - A.first_by("k", "at")).alias("net_lift"),
        F.avg("speed").alias("speed_mean"), F.stddev("speed").alias("speed_std"), F.percentile("speed", F.lit(0.5)).alias("speed_p50"), F.percentile("speed", F.lit(0.9)).alias("speed_p90"), F.max("speed").alias("speed_max"),
        F.sum("stop").alias("stop_count"), F.count_if("edge").alias("dump_edges"), F.avg("altitude").alias("altitude_mean"), F.count_if("at_load").alias("load_pings"), F.count_if("at_dump").alias("dump_pings"),
    )
    return out.withColumn("idle_fraction", scalars.ratio(F.col("idle_h"), F.col("ignition_h"))).withColumn("km_per_hour", scalars.ratio(F.col("km"), F.col("moving_h"))).withColumn("km_per_dump", scalars.ratio(F.col("km"), F.col("dump_edges"), 1.0))


ROUND = ("ignition_h moving_h idle_h km speed_mean speed_std speed_p50 speed_p90 speed_max altitude_mean idle_fraction km_per_hour km_per_dump").split()


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    # The offset takes values that stand exactly between two roundings to the same side in any engine.
    return df.withColumns({c: R(F.col(c) + 1e-9, digits) for c in ROUND})


def features_sql(by: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY ts, event_id)"
    return sql(f""", s AS (SELECT *, least(greatest(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER {w})) / 1e6, 0), 0), 86400) AS dt, coalesce(k - lag(k) OVER {w}, 0) AS da, lag(speed) OVER {w} AS before,
coalesce(analog > 2.5, FALSE) AND NOT coalesce(lag(coalesce(analog > 2.5, FALSE)) OVER {w}, FALSE) AS edge FROM pings),
g AS (SELECT {by}, count(*) AS n_pings, sum(CASE WHEN ignition = 1 THEN dt ELSE 0 END) / 3600 AS ignition_h, sum(CASE WHEN speed > 2 THEN dt ELSE 0 END) / 3600 AS moving_h, sum(CASE WHEN ignition = 1 AND speed <= 2 THEN dt ELSE 0 END) / 3600 AS idle_h,
 sum(dist) / 1000 AS km, sum(greatest(da, 0))::DOUBLE AS climb_m, sum(greatest(-da, 0))::DOUBLE AS descent_m, last(k ORDER BY ts, event_id) - first(k ORDER BY ts, event_id) AS net_lift, avg(speed) AS speed_mean, stddev_samp(speed) AS speed_std,
 quantile_cont(speed, 0.5) AS speed_p50, quantile_cont(speed, 0.9) AS speed_p90, max(speed) AS speed_max, sum((coalesce(before > 2, FALSE) AND speed <= 2 AND ignition = 1)::INT)::BIGINT AS stop_count, count(*) FILTER (WHERE edge) AS dump_edges,
 avg(altitude) AS altitude_mean, count(*) FILTER (WHERE at_load) AS load_pings, count(*) FILTER (WHERE at_dump) AS dump_pings FROM s GROUP BY ALL)
SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 5) AS {c}' for c in ROUND[:10])}), round(idle_h / (ignition_h + 1e-6) + 1e-9, 5) AS idle_fraction, round(km / (moving_h + 1e-6) + 1e-9, 5) AS km_per_hour, round(km / (dump_edges + 1.0) + 1e-9, 5) AS km_per_dump FROM g""")


SHIFT = ["vehicle", "date", "shift"]


@query("shift_features", features_sql("vehicle, date, shift"))
def shift_features(spark, sf_dir):
    return rounded(features(signals(keyed(pings(spark, sf_dir)), SHIFT), SHIFT))


@query("day_features", features_sql("vehicle, date"))
def day_features(spark, sf_dir):
    return rounded(features(signals(keyed(pings(spark, sf_dir)), SHIFT[:2]), SHIFT[:2]))


START_SQL = "date::TIMESTAMP + to_hours(CASE shift WHEN 'A' THEN 6 WHEN 'B' THEN 14 ELSE 22 END)"
TABLE_SQL = sql(f""", f AS ({features_sql('vehicle, date, shift')}), v AS (SELECT vehicle, date, shift, {START_SQL} AS start FROM f),
near AS (SELECT v.vehicle, v.date, v.shift, arg_max(litres, epoch_us(refuel_ts)::HUGEINT * 1000000000 + refuel_id) AS last_litres, max(refuel_ts) AS t, coalesce(sum(litres) FILTER (WHERE refuel_ts >= start - INTERVAL 24 HOUR), 0) AS s, count(litres) FILTER (WHERE refuel_ts >= start - INTERVAL 24 HOUR) AS c
  FROM v JOIN refuels r ON r.vehicle = v.vehicle AND refuel_ts < start GROUP BY ALL)
SELECT f.*, round(last_litres, 5) AS last_litres, round(coalesce(s, 0), 5) AS refuel_24h_sum, coalesce(c, 0) AS refuel_24h_count, round(coalesce((epoch_us({START_SQL}) - epoch_us(t)) / 3.6e9::DOUBLE, 1e6) + 1e-9, 5) AS hours_since_refuel,
  isodow(date)::INT - 1 AS dow, week(date)::INT AS iso_week, day(date)::INT AS day, month(date)::INT AS month, (isodow(date) >= 6)::INT AS is_weekend, round(used, 5) AS used
FROM f LEFT JOIN near USING (vehicle, date, shift) LEFT JOIN (SELECT vehicle, date, shift, used FROM totals) USING (vehicle, date, shift)""")


@query("shift_table", TABLE_SQL)
def shift_table(spark, sf_dir):
    """The flagship with labels, refuels before the shift and calendar: what a trainer reads."""
    f = features(signals(keyed(pings(spark, sf_dir)), SHIFT), SHIFT).withColumn("start", F.to_timestamp_ntz(F.concat_ws(" ", F.col("date").cast("string"), F.expr("CASE shift WHEN 'A' THEN '06:00:00' WHEN 'B' THEN '14:00:00' ELSE '22:00:00' END"))))
    r = refuels(spark, sf_dir)
    f = asof_join(f, r, ["vehicle"], "start", "refuel_ts", ["litres"], order=["refuel_id"])
    f = trailing(f, r, ["vehicle"], "start", "refuel_ts", "litres", prefix="refuel_24h_")
    f = f.withColumn("hours_since_refuel", F.coalesce(keys.seconds_between(F.col("last_refuel_ts"), F.col("start")) / 3600, F.lit(1e6)))
    f = f.withColumns({n: c for n, c in scalars.calendar(F.col("date")).items()})
    out = rounded(f).join(shift_totals(spark, sf_dir).select(*SHIFT, "used"), SHIFT, "left").drop("start", "last_refuel_ts")
    return out.withColumns({c: R(c, 5) for c in ("last_litres", "refuel_24h_sum", "used")}).withColumn("hours_since_refuel", R(F.col("hours_since_refuel") + 1e-9, 5))


@query("tumbling_shift", sql("SELECT vehicle, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01 06:00:00') AS start, count(*) AS n, round(sum(dist), 6) AS km FROM pings GROUP BY ALL"))
def tumbling_shift(spark, sf_dir):
    from fleetspark.streaming.shifts import shift_windows

    return shift_windows(pings(spark, sf_dir)).select("vehicle", F.col("start").cast("timestamp_ntz").alias("start"), "n", R("km", 6).alias("km"))


@query("session_gap", sql(""", s AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT *, lag(ts) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS b FROM pings))
SELECT vehicle, min(ts) AS start, count(*) AS n, round(sum(dist), 6) AS km FROM s GROUP BY vehicle, sid"""))
def session_gap(spark, sf_dir):
    from fleetspark.streaming.shifts import gap_sessions

    return gap_sessions(pings(spark, sf_dir), "4 hours").select("vehicle", F.col("start").cast("timestamp_ntz").alias("start"), "n", R("km", 6).alias("km"))


@query("sliding_day", sql(""", b AS (SELECT vehicle, dist, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01 06:00:00') AS start FROM pings)
SELECT vehicle, start + to_hours(8 * (i + 1)) AS "end", count(*) AS n, round(sum(dist), 6) AS km FROM b, (VALUES (0), (1), (2)) w(i) GROUP BY ALL"""))
def sliding_day(spark, sf_dir):
    """Counts and distance of the 24 hours up to each end of a shift."""
    from fleetspark.streaming import shifts

    return shifts.sliding_day(pings(spark, sf_dir)).select("vehicle", F.col("end").cast("timestamp_ntz").alias("end"), "n", R("km", 6).alias("km"))


@query("shift_refuels", sql(""", s AS (SELECT DISTINCT vehicle, date::TIMESTAMP + to_hours(CASE shift WHEN 'A' THEN 6 WHEN 'B' THEN 14 ELSE 22 END) AS start FROM pings)
SELECT s.vehicle, s.start, count(refuel_ts) AS n, round(coalesce(sum(litres), 0), 6) AS litres, max(refuel_ts) AS last_refuel_ts FROM s LEFT JOIN refuels r ON r.vehicle = s.vehicle AND refuel_ts >= start - INTERVAL 24 HOUR AND refuel_ts < start GROUP BY s.vehicle, s.start"""))
def shift_refuels(spark, sf_dir):
    """Refuels in the 24 hours before each shift: the interval join of two streams, on tables."""
    from fleetspark.streaming.ordered import trailing_refuels

    start = F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.when(F.col("shift") == "A", 6).when(F.col("shift") == "B", 14).otherwise(22))
    starts = keyed(pings(spark, sf_dir)).select("vehicle", start.alias("start")).distinct()
    made = trailing_refuels(starts, refuels(spark, sf_dir))
    return made.select("vehicle", F.col("start").cast("timestamp_ntz").alias("start"), "n", R("litres", 6).alias("litres"), F.col("last_refuel_ts").cast("timestamp_ntz").alias("last_refuel_ts"))
