"""Wide feature tables of shifts: all of a shift's windows share one exchange, one aggregation follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import keys, scalars
from fleetspark.operators import aggregates as A
from fleetspark.operators import sequence as S
from fleetspark.sources.pings import keyed, pings, sql

from .registry import query

R = F.round
SHIFT = ["vehicle", "date", "shift"]
W = "(PARTITION BY vehicle, date, shift ORDER BY ts, event_id)"


def sensors(p: DataFrame) -> DataFrame:
    """Stand-ins for zones and further sensors, made of the signals that pings have."""
    k, mine = F.col("k"), F.col("mine")
    return p.withColumns({
        "ob_dump": F.col("at_dump") & (mine == 0), "rom_stock": F.col("at_dump") & (mine == 1), "haul": (k >= 20) & (k < 80),
        "satellites": k % 12 + 4, "hdop": k / 50.0, "axis_x": F.col("dist") % 7, "axis_y": F.col("speed") % 5, "axis_z": (k % 3).cast("double"),
        "battery": k % 40 + 60, "angle": (k * 37 % 360).cast("double"), "voltage": F.col("analog") * 5,
    })


SENSORS_SQL = """, sensed AS (SELECT *, at_dump AND mine = 0 AS ob_dump, at_dump AND mine = 1 AS rom_stock, k >= 20 AND k < 80 AS haul, k % 12 + 4 AS satellites, k / 50.0::DOUBLE AS hdop,
dist % 7 AS axis_x, speed % 5 AS axis_y, (k % 3)::DOUBLE AS axis_z, k % 40 + 60 AS battery, (k * 37 % 360)::DOUBLE AS angle, analog * 5 AS voltage FROM pings)"""


def _hours(flag: Column) -> Column:
    return F.sum(F.when(flag, F.col("dt")).otherwise(0.0)) / 3600


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles to some digits; the offset takes values exactly between two roundings to the same side in any engine."""
    return df.select(*(R(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def shift_signals(p: DataFrame, by: list[str] = SHIFT, cap: float = 300.0, moving: float = 2.0, dump: float = 2.5) -> DataFrame:
    """Rows of an entity with what their order gives: gaps, changes, edges of signal and zones, time in the row's cell."""
    w = S.ordered(by, ["ts", "event_id"])
    p = p.withColumns({
        "dt": keys.gap_seconds(by, tiebreak="event_id", cap=cap), "rose": F.coalesce(S.change(F.col("altitude"), w), F.lit(0.0)), "edge": S.rising_edge(F.col("analog") > dump, w),
        "before": F.lag("speed").over(w), "load_edge": S.rising_edge(F.col("at_load"), w), "dump_in": S.rising_edge(F.col("at_dump"), w), "haul_edge": S.rising_edge(F.col("haul"), w),
        "cell": scalars.grid_cell(F.col("x"), F.col("y")),
    })
    on, fast = F.col("ignition") == 1, F.col("speed") > moving
    return p.withColumns({"on": on, "fast": fast, "idle": on & ~fast, "stop": F.coalesce(F.col("before") > moving, F.lit(False)) & ~fast & on})


SIGNALS_SQL = SENSORS_SQL + f""", sig AS (SELECT *, least(greatest(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0), 0), 300) AS dt, coalesce(altitude - lag(altitude) OVER w, 0) AS rose,
coalesce(analog > 2.5, FALSE) AND NOT coalesce(lag(analog) OVER w > 2.5, FALSE) AS edge, at_load AND NOT coalesce(lag(at_load) OVER w, FALSE) AS load_edge, at_dump AND NOT coalesce(lag(at_dump) OVER w, FALSE) AS dump_in,
haul AND NOT coalesce(lag(haul) OVER w, FALSE) AS haul_edge, coalesce(lag(speed) OVER w > 2, FALSE) AND speed <= 2 AND ignition = 1 AS stop, (floor(x / 50) * 1000000 + floor(y / 50))::BIGINT AS cell FROM sensed WINDOW w AS {W})"""


def _wide_aggregates() -> list[Column]:
    driven, hot = F.when(F.col("speed") > 0, F.col("speed")), F.col("analog") > 2.5
    n = lambda c, name: F.count_if(c).alias(name)
    return [
        F.count("*").alias("n_pings"), _hours(F.col("on")).alias("ignition_h"), _hours(F.col("fast")).alias("moving_h"), _hours(F.col("idle")).alias("idle_h"), (A.total(F.col("dist")) / 1000).alias("km"),
        F.avg("altitude").alias("altitude_mean"), F.stddev("altitude").alias("altitude_std"), F.max("altitude").alias("altitude_max"), F.min("altitude").alias("altitude_min"),
        (A.last_by("altitude", "at") - A.first_by("altitude", "at")).alias("net_lift"), F.sum(scalars.rise(F.col("rose"))).alias("climb_m"), F.sum(scalars.fall(F.col("rose"))).alias("descent_m"),
        F.avg(driven).alias("speed_mean"), F.stddev(driven).alias("speed_std"), F.max("speed").alias("speed_max"), *(F.percentile(driven, F.lit(q / 100)).alias(f"speed_p{q}") for q in (50, 75, 90)),
        n(F.col("stop"), "stop_count"), n(F.col("edge"), "dump_edges"), F.avg("analog").alias("signal_mean"), F.stddev("analog").alias("signal_std"), F.max("analog").alias("signal_max"), _hours(hot).alias("signal_high_h"),
        *(A.share(F.col(c)).alias(f"frac_{c}") for c in ("at_dump", "ob_dump", "rom_stock", "at_load", "haul")),
        n(F.col("edge") & F.col("ob_dump"), "edges_ob_dump"), n(F.col("edge") & F.col("rom_stock"), "edges_rom_stock"),
        F.sum("dt").alias("seconds"), F.max("cell_s").alias("top_s"), n(F.col("new_cell"), "cells"), F.avg("satellites").alias("satellites"), F.avg("hdop").alias("hdop"),
        *(F.stddev(f"axis_{a}").alias(f"std_{a}") for a in "xyz"), F.avg("battery").alias("battery_mean"), F.stddev("angle").alias("angle_std"),
        F.hour(F.min("ts")).alias("hour_start"), F.hour(F.max("ts")).alias("hour_end"),
    ]


def wide(p: DataFrame, by: list[str] = SHIFT) -> DataFrame:
    """The 49 features of a shift: motion, altitude, speed, dump signal, zones, hot spots, sensors and hours."""
    s = shift_signals(p, by)
    # The time in a cell is a window over the entity's own rows, so it needs a sort more but no exchange.
    cell = Window.partitionBy(*by, "cell")
    s = s.withColumns({"cell_s": F.sum("dt").over(cell), "new_cell": F.row_number().over(cell.orderBy("ts", "event_id")) == 1, "at": F.struct("ts", "event_id")})
    g = s.groupBy(*by).agg(*_wide_aggregates())
    c = F.col
    g = g.withColumns({x: F.coalesce(c(x), F.lit(0.0)) for x in ("speed_mean", "speed_p50", "speed_p75", "speed_p90")})
    g = g.withColumns({
        "altitude_range": c("altitude_max") - c("altitude_min"), "edges_outside": F.greatest(c("dump_edges") - c("edges_ob_dump") - c("edges_rom_stock"), F.lit(0)),
        "top_cell_share": F.when(c("seconds") > 0, scalars.ratio(c("top_s"), c("seconds"))).otherwise(0.0), "cells": F.when(c("seconds") > 0, c("cells")).otherwise(0),
        "idle_fraction": scalars.ratio(c("idle_h"), c("ignition_h")), "stop_density": scalars.ratio(c("stop_count"), c("km")), "km_per_hour": scalars.ratio(c("km"), c("ignition_h")),
        "climb_ratio": scalars.ratio(c("climb_m"), c("descent_m"), 1.0), "vibration": scalars.magnitude(c("std_x"), c("std_y"), c("std_z")),
        "speed_cv": F.when(c("speed_mean") > 0, scalars.ratio(c("speed_std"), c("speed_mean"))).otherwise(0.0), "km_per_climb": scalars.ratio(c("km"), c("climb_m"), 1.0), "km_per_dump": scalars.ratio(c("km"), c("dump_edges"), 1.0),
    })
    return g.drop("seconds", "top_s", "std_x", "std_y", "std_z")


def _double(names: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in names.split())


WIDE_SQL = sql(SIGNALS_SQL + f""", c AS (SELECT *, sum(dt) OVER (PARTITION BY vehicle, date, shift, cell) AS cell_s FROM sig),
g AS (SELECT vehicle, date, shift, count(*) AS n_pings, sum(dt * ignition) / 3600 AS ignition_h, coalesce(sum(dt) FILTER (WHERE speed > 2), 0) / 3600 AS moving_h, coalesce(sum(dt) FILTER (WHERE ignition = 1 AND speed <= 2), 0) / 3600 AS idle_h, sum(dist) / 1000 AS km,
avg(altitude) AS altitude_mean, stddev_samp(altitude) AS altitude_std, max(altitude) AS altitude_max, min(altitude) AS altitude_min, max(altitude) - min(altitude) AS altitude_range, last(altitude ORDER BY ts, event_id) - first(altitude ORDER BY ts, event_id) AS net_lift,
sum(greatest(rose, 0)) AS climb_m, sum(greatest(-rose, 0)) AS descent_m, coalesce(avg(speed) FILTER (WHERE speed > 0), 0) AS speed_mean, stddev_samp(speed) FILTER (WHERE speed > 0) AS speed_std, max(speed) AS speed_max,
{', '.join(f'coalesce(quantile_cont(speed, {q / 100}) FILTER (WHERE speed > 0), 0) AS speed_p{q}' for q in (50, 75, 90))}, count(*) FILTER (WHERE stop) AS stop_count, count(*) FILTER (WHERE edge) AS dump_edges,
avg(analog) AS signal_mean, stddev_samp(analog) AS signal_std, max(analog) AS signal_max, coalesce(sum(dt) FILTER (WHERE analog > 2.5), 0) / 3600 AS signal_high_h,
{', '.join(f'avg({z}::INT) AS frac_{z}' for z in ('at_dump', 'ob_dump', 'rom_stock', 'at_load', 'haul'))}, count(*) FILTER (WHERE edge AND ob_dump) AS edges_ob_dump, count(*) FILTER (WHERE edge AND rom_stock) AS edges_rom_stock,
sum(dt) AS seconds, max(cell_s) AS top_s, count(DISTINCT cell) AS n_cells, avg(satellites) AS satellites, avg(hdop) AS hdop, sqrt(var_samp(axis_x) + var_samp(axis_y) + var_samp(axis_z)) AS vibration, avg(battery) AS battery_mean, stddev_samp(angle) AS angle_std,
hour(min(ts))::INT AS hour_start, hour(max(ts))::INT AS hour_end FROM c GROUP BY ALL)
SELECT vehicle, date, shift, n_pings, stop_count, dump_edges, edges_ob_dump, edges_rom_stock, greatest(dump_edges - edges_ob_dump - edges_rom_stock, 0) AS edges_outside, CASE WHEN seconds > 0 THEN n_cells ELSE 0 END AS cells, hour_start, hour_end,
{_double('ignition_h moving_h idle_h km altitude_mean altitude_std altitude_max altitude_min altitude_range net_lift climb_m descent_m speed_mean speed_std speed_max speed_p50 speed_p75 speed_p90 signal_mean signal_std signal_max signal_high_h frac_at_dump frac_ob_dump frac_rom_stock frac_at_load frac_haul satellites hdop vibration battery_mean angle_std')},
round(CASE WHEN seconds > 0 THEN top_s / (seconds + 1e-6) ELSE 0 END + 1e-9, 5) AS top_cell_share, round(idle_h / (ignition_h + 1e-6) + 1e-9, 5) AS idle_fraction, round(stop_count / (km + 1e-6) + 1e-9, 5) AS stop_density, round(km / (ignition_h + 1e-6) + 1e-9, 5) AS km_per_hour,
round(climb_m / (descent_m + 1.0) + 1e-9, 5) AS climb_ratio, round(CASE WHEN speed_mean > 0 THEN speed_std / (speed_mean + 1e-6) ELSE 0 END + 1e-9, 5) AS speed_cv, round(km / (climb_m + 1.0) + 1e-9, 5) AS km_per_climb, round(km / (dump_edges + 1.0) + 1e-9, 5) AS km_per_dump FROM g""")


@query("shift_features_wide", WIDE_SQL)
def shift_features_wide(spark, sf_dir):
    return _rounded(wide(sensors(keyed(pings(spark, sf_dir)))))


def cycles(p: DataFrame, by: list[str] = SHIFT, longest: float = 300.0) -> DataFrame:
    """Features of a shift's haul cycles: times in zones, entries, speed and distance loaded and empty, and the median
    minutes from the last loading before a dump to that dump, of those within ``longest``."""
    w = S.ordered(by, ["ts", "event_id"])
    s = shift_signals(p, by).withColumns({"score": S.running_balance(F.col("load_edge"), F.col("dump_in"), w), "dumped": S.running(F.col("dump_in").cast("int"), w), "loaded_at": S.forward_fill(F.when(F.col("load_edge"), F.col("ts")), w), "at": F.struct("ts", "event_id")})
    minutes = keys.seconds_between(F.col("loaded_at"), F.col("ts")) / 60
    haul, sides = F.col("haul"), {"loaded": F.col("score") > 0, "empty": (F.col("score") == 0) & (F.col("dumped") > 0)}
    on = lambda side, x: F.when(side & haul, x)
    n = lambda c, name: F.count_if(c).alias(name)
    aggs = [F.count("*").alias("n_pings"), F.sum("dt").alias("seconds"), (A.total(F.col("dist")) / 1000).alias("km"), n(F.col("edge"), "dump_edges"), n(F.col("load_edge"), "load_entries"), n(F.col("dump_in"), "dump_entries"), n(F.col("haul_edge"), "haul_entries"), n(F.col("stop"), "stop_count")]
    aggs += [_hours(F.col(c)).alias(f"{c}_h") for c in ("at_dump", "at_load", "haul", "ob_dump", "rom_stock")]
    for name, side in sides.items():
        quick = on(side & (F.col("speed") > 2), F.col("speed"))
        aggs += [F.coalesce(F.avg(quick), F.lit(0.0)).alias(f"{name}_speed_mean"), F.coalesce(F.percentile(quick, F.lit(0.9)), F.lit(0.0)).alias(f"{name}_speed_p90"), (A.total(on(side, F.col("dist"))) / 1000).alias(f"{name}_km")]
    aggs += [F.coalesce(F.percentile(F.when(F.col("dump_in") & minutes.between(0, longest), minutes), F.lit(0.5)), F.lit(0.0)).alias("cycle_minutes_p50"), F.coalesce(F.avg("voltage"), F.lit(0.0)).alias("voltage_mean"), F.coalesce(F.max("voltage"), F.lit(0.0)).alias("voltage_max")]
    g = s.groupBy(*by).agg(*aggs).withColumn("haul_cycles", F.greatest("dump_edges", "dump_entries", "load_entries"))
    c = F.col
    g = g.withColumns({f"frac_{z}": scalars.ratio(c(f"{z}_h") * 3600, c("seconds")) for z in ("at_dump", "at_load", "haul")})
    g = g.withColumns({"km_per_cycle": scalars.ratio(c("km"), c("haul_cycles"), 1.0), "speed_ratio": scalars.ratio(c("loaded_speed_mean"), c("empty_speed_mean")), "stop_density": scalars.ratio(c("stop_count"), c("km"))})
    return g.drop("seconds")


CYCLES_SQL = sql(SIGNALS_SQL + f""", s AS (SELECT *, greatest(sum(load_edge::INT - dump_in::INT) OVER w, 0) AS score, sum(dump_in::INT) OVER w AS dumped, (epoch_us(ts) - max(CASE WHEN load_edge THEN epoch_us(ts) END) OVER w) / 6e7 AS minutes FROM sig WINDOW w AS (PARTITION BY vehicle, date, shift ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT vehicle, date, shift, count(*) AS n_pings, sum(dt) AS seconds, sum(dist) / 1000 AS km, {', '.join(f'count(*) FILTER (WHERE {a}) AS {b}' for a, b in (('edge', 'dump_edges'), ('load_edge', 'load_entries'), ('dump_in', 'dump_entries'), ('haul_edge', 'haul_entries'), ('stop', 'stop_count')))},
{', '.join(f'coalesce(sum(dt) FILTER (WHERE {z}), 0) / 3600 AS {z}_h' for z in ('at_dump', 'at_load', 'haul', 'ob_dump', 'rom_stock'))},
{', '.join(f'coalesce(avg(speed) FILTER (WHERE {x} AND haul AND speed > 2), 0) AS {s}_speed_mean, coalesce(quantile_cont(speed, 0.9) FILTER (WHERE {x} AND haul AND speed > 2), 0) AS {s}_speed_p90, coalesce(sum(dist) FILTER (WHERE {x} AND haul), 0) / 1000 AS {s}_km' for s, x in (('loaded', 'score > 0'), ('empty', 'score = 0 AND dumped > 0')))},
coalesce(median(minutes) FILTER (WHERE dump_in AND minutes BETWEEN 0 AND 300), 0) AS cycle_minutes_p50, coalesce(avg(voltage), 0) AS voltage_mean, coalesce(max(voltage), 0) AS voltage_max FROM s GROUP BY ALL), h AS (SELECT *, greatest(dump_edges, dump_entries, load_entries) AS haul_cycles FROM g)
SELECT vehicle, date, shift, n_pings, dump_edges, load_entries, dump_entries, haul_entries, stop_count, haul_cycles, {_double('km at_dump_h at_load_h haul_h ob_dump_h rom_stock_h loaded_speed_mean loaded_speed_p90 loaded_km empty_speed_mean empty_speed_p90 empty_km cycle_minutes_p50 voltage_mean voltage_max')},
{', '.join(f'round({z}_h * 3600 / (seconds + 1e-6) + 1e-9, 5) AS frac_{z}' for z in ('at_dump', 'at_load', 'haul'))}, round(km / (haul_cycles + 1.0) + 1e-9, 5) AS km_per_cycle, round(loaded_speed_mean / (empty_speed_mean + 1e-6) + 1e-9, 5) AS speed_ratio, round(stop_count / (km + 1e-6) + 1e-9, 5) AS stop_density FROM h""")


@query("shift_cycles", CYCLES_SQL)
def shift_cycles(spark, sf_dir):
    return _rounded(cycles(sensors(keyed(pings(spark, sf_dir)))))


LV = "(PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LOADED_SQL = SENSORS_SQL + f""", ev AS (SELECT *, CASE WHEN at_load THEN NULL WHEN at_dump THEN 0 WHEN lag(at_load) OVER w THEN 1 END AS ev, least(greatest(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 30), 0), 300) / 3600 AS h,
greatest(coalesce(altitude - lag(altitude) OVER w, 0), 0) AS gain, least(coalesce(abs(angle - lag(angle) OVER w), 0), 180) AS turn, at_dump AND NOT coalesce(lag(at_dump) OVER w, FALSE) AS dump_entry, NOT at_dump AND coalesce(lag(at_dump) OVER w, FALSE) AS dump_exit, NOT at_load AND coalesce(lag(at_load) OVER w, FALSE) AS load_exit
FROM sensed WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)),
st AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER {LV}, first_value(ev IGNORE NULLS) OVER {LV.replace('UNBOUNDED PRECEDING AND CURRENT ROW', 'CURRENT ROW AND UNBOUNDED FOLLOWING')}, 0) = 1 AS loaded FROM ev)"""


def load_split(p: DataFrame, by: list[str] = SHIFT) -> DataFrame:
    """Per shift, by the vehicle's load state: hours, km, gain and voltage moving loaded and empty, turns, entries and exits.
    States and gaps run over the vehicle's whole history, not only within the shift, so its rows are shuffled by vehicle once."""
    w = S.ordered(["vehicle"], ["ts", "event_id"])
    was = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    s = S.filled_state(p, "at_load", "at_dump", ["vehicle"], ["ts", "event_id"]).withColumns({
        "dt": keys.gap_seconds(["vehicle"], tiebreak="event_id", first=30.0), "gain": scalars.rise(F.coalesce(S.change(F.col("altitude"), w), F.lit(0.0))), "turn": scalars.clip(F.coalesce(F.abs(S.change(F.col("angle"), w)), F.lit(0.0)), high=180.0),
        "dump_entry": F.col("at_dump") & ~was("at_dump"), "dump_exit": ~F.col("at_dump") & was("at_dump"), "load_exit": ~F.col("at_load") & was("at_load"),
    })
    fast = F.col("speed") > 2
    aggs = [F.count("*").alias("n_pings"), F.avg("turn").alias("turn_mean"), *(F.count_if(c).alias(c) for c in ("dump_entry", "dump_exit", "load_exit"))]
    for name, side in (("loaded", (F.col("loaded") == 1) & fast), ("empty", (F.col("loaded") == 0) & fast)):
        aggs += [F.count_if(side).alias(f"{name}_pings"), _hours(side).alias(f"{name}_h"), (A.total(F.col("dist"), side) / 1000).alias(f"{name}_km"), A.total(F.col("gain"), side).alias(f"{name}_gain"), A.total(F.col("voltage"), side).alias(f"{name}_voltage")]
    return s.groupBy(*by).agg(*aggs)


@query("load_split", sql(LOADED_SQL + f"""SELECT vehicle, date, shift, count(*) AS n_pings, round(avg(turn) + 1e-9, 5) AS turn_mean, {', '.join(f'count(*) FILTER (WHERE {c}) AS {c}' for c in ('dump_entry', 'dump_exit', 'load_exit'))},
{', '.join(f'count(*) FILTER (WHERE {x}) AS {s}_pings, round(coalesce(sum(h) FILTER (WHERE {x}), 0) + 1e-9, 5) AS {s}_h, round(coalesce(sum(dist) FILTER (WHERE {x}), 0) / 1000 + 1e-9, 5) AS {s}_km, round(coalesce(sum(gain) FILTER (WHERE {x}), 0) + 1e-9, 5) AS {s}_gain, round(coalesce(sum(voltage) FILTER (WHERE {x}), 0) + 1e-9, 5) AS {s}_voltage' for s, x in (('loaded', 'loaded AND speed > 2'), ('empty', 'NOT loaded AND speed > 2')))} FROM st GROUP BY ALL"""))
def load_split_query(spark, sf_dir):
    return _rounded(load_split(sensors(keyed(pings(spark, sf_dir)))))


@query("merged_parts", sql("""SELECT vehicle, date, shift, sum(n)::BIGINT AS n, round(sum(km) + 1e-9, 6) AS km, max(speed_max) AS speed_max, round(avg(speed_mean) + 1e-9, 6) AS speed_mean FROM
(SELECT vehicle, date, shift, event_id % 3 AS part, count(*) AS n, sum(dist) / 1000 AS km, max(speed) AS speed_max, avg(speed) AS speed_mean FROM pings GROUP BY ALL) GROUP BY ALL"""))
def merged_parts(spark, sf_dir):
    """Shifts that lie in several files, here thirds of the events: sums of sums, greatest of greatest, means of means."""
    p = keyed(pings(spark, sf_dir)).withColumn("part", F.col("event_id") % 3)
    parts = p.groupBy(*SHIFT, "part").agg(F.count("*").alias("n"), (F.sum("dist") / 1000).alias("km"), F.max("speed").alias("speed_max"), F.avg("speed").alias("speed_mean"))
    return A.merge_parts(parts, SHIFT, sums=["n", "km"], greatest=["speed_max"], means=["speed_mean"]).withColumns({"km": R(F.col("km") + 1e-9, 6), "speed_mean": R(F.col("speed_mean") + 1e-9, 6)})
