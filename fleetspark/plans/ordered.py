"""Queries of windows and ordered operators, sorting and deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetspark.functions import keys
from fleetspark.operators import sequence as S
from fleetspark.sources.pings import keyed, pings, sql

from .joined import EDGES, edged
from .registry import query

R = F.round
BY, ORDER = ["vehicle"], ["ts", "event_id"]
W = "(PARTITION BY vehicle ORDER BY ts, event_id)"


def w():
    return S.ordered(BY, ORDER)


@query("lag_lead", sql(f"SELECT event_id, lag(speed) OVER w AS before, lead(speed) OVER w AS after, coalesce(lag(k) OVER w, 0) AS k_before FROM pings WINDOW w AS {W}"))
def lag_lead(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", F.lag("speed").over(w()).alias("before"), F.lead("speed").over(w()).alias("after"), F.lag("k", 1, 0).over(w()).alias("k_before"))


@query("diff_abs", sql(f"SELECT event_id, round(speed - lag(speed) OVER w, 6) AS d, CASE WHEN lag(k) OVER w IS NOT NULL THEN least(abs(k - lag(k) OVER w), 50) END AS turn FROM pings WINDOW w AS {W}"))
def diff_abs(spark, sf_dir):
    from fleetspark.functions.scalars import clip

    return pings(spark, sf_dir).select("event_id", R(S.change(F.col("speed"), w()), 6).alias("d"), clip(F.abs(S.change(F.col("k"), w())), None, 50).alias("turn"))


@query("cumsum_pos", sql(f"SELECT event_id, round(sum(dist) OVER w, 6) AS path, row_number() OVER w - 1 AS pos FROM pings WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"))
def cumsum_pos(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", R(S.running(F.col("dist"), w()), 6).alias("path"), S.position(w()).cast("long").alias("pos"))


@query("rising_edges", sql(f"SELECT vehicle, count(*) FILTER (WHERE on_ AND NOT coalesce(b, FALSE)) AS first_counts, count(*) FILTER (WHERE on_ AND NOT coalesce(b, TRUE)) AS first_not FROM (SELECT vehicle, on_, lag(on_) OVER {W} AS b FROM (SELECT *, coalesce(analog > 2.5, FALSE) AS on_ FROM pings)) GROUP BY vehicle"))
def rising_edges(spark, sf_dir):
    p = pings(spark, sf_dir).select("vehicle", S.rising_edge(F.col("analog") > 2.5, w()).alias("a"), S.rising_edge(F.col("analog") > 2.5, w(), False).alias("b"))
    return p.groupBy("vehicle").agg(F.count_if("a").alias("first_counts"), F.count_if("b").alias("first_not"))


@query("running_balance", sql("SELECT event_id, greatest(sum(at_load::INT - at_dump::INT) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS balance FROM pings"))
def running_balance(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", S.running_balance(F.col("at_load"), F.col("at_dump"), w()).cast("long").alias("balance"))


ISLANDS = f", i AS (SELECT *, sum(c) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, k < 50 AS slow, CASE WHEN lag(k < 50) OVER {W} IS DISTINCT FROM (k < 50) THEN 1 ELSE 0 END AS c FROM pings))"


@query("islands", sql(ISLANDS + " SELECT event_id, island::BIGINT AS island FROM i"))
def islands(spark, sf_dir):
    return S.island_id(pings(spark, sf_dir).withColumn("slow", F.col("k") < 50), "slow", BY, ORDER).select("event_id", F.col("island").cast("long").alias("island"))


@query("stop_sessions", sql(ISLANDS + """ SELECT vehicle, island::BIGINT AS island, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, round(median(x), 6) AS x_median, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM i WHERE slow GROUP BY ALL HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 3600"""))
def stop_sessions(spark, sf_dir):
    p = pings(spark, sf_dir).withColumn("slow", F.col("k") < 50)
    out = S.sessions(p, "slow", BY, ORDER, "ts", 3600, [R(F.percentile("x", F.lit(0.5)), 6).alias("x_median")])
    return out.withColumn("seconds", R("seconds", 6)).withColumn("island", F.col("island").cast("long"))


@query("ffill_bfill", sql("""SELECT event_id, last_value(altitude IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
first_value(altitude IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM pings"""))
def ffill_bfill(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", S.forward_fill(F.col("altitude"), w()).alias("forward"), S.backward_fill(F.col("altitude"), w()).alias("backward"))


@query("load_state", sql(f""", ev AS (SELECT *, CASE WHEN at_load THEN NULL WHEN at_dump THEN 0 WHEN lag(at_load) OVER {W} THEN 1 END AS ev FROM pings)
SELECT event_id, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(ev IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS loaded FROM ev"""))
def load_state(spark, sf_dir):
    return S.filled_state(pings(spark, sf_dir), "at_load", "at_dump", BY, ORDER).select("event_id", "loaded")


@query("rolling_median_trailing", sql("SELECT event_id, median(speed) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM pings"))
def rolling_median_trailing(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", S.rolling_median(F.col("speed"), w(), 5).alias("m"))


@query("rolling_median_centered", sql("SELECT event_id, median(speed) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM pings"))
def rolling_median_centered(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", S.rolling_median(F.col("speed"), w(), 5, True).alias("m"))


@query("rolling_mean_lag3", sql("SELECT event_id, round(avg(dist) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS m, lag(dist, 2) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS lag2 FROM pings"))
def rolling_mean_lag3(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", R(S.mean_of_previous(F.col("dist"), w()), 6).alias("m"), F.lag("dist", 2).over(w()).alias("lag2"))


@query("interpolate_limit", sql(f""", q AS (SELECT event_id, vehicle, altitude, row_number() OVER {W} AS i FROM pings),
z AS (SELECT *, max(CASE WHEN altitude IS NOT NULL THEN i END) OVER (PARTITION BY vehicle ORDER BY i ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN altitude IS NOT NULL THEN i END) OVER (PARTITION BY vehicle ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM q)
SELECT z.event_id, round(CASE WHEN z.altitude IS NOT NULL THEN z.altitude WHEN coalesce(z.i - a <= 1, FALSE) OR coalesce(b - z.i <= 1, FALSE) THEN coalesce(l.altitude + (r.altitude - l.altitude) * (z.i - a) / (b - a)::DOUBLE, l.altitude, r.altitude) END, 6) AS altitude
FROM z LEFT JOIN q l ON l.vehicle = z.vehicle AND l.i = z.a LEFT JOIN q r ON r.vehicle = z.vehicle AND r.i = z.b"""))
def interpolate_limit(spark, sf_dir):
    return S.interpolate(pings(spark, sf_dir), "altitude", BY, ORDER, 1).select("event_id", R("altitude", 6).alias("altitude"))


@query("dense_rank", sql("SELECT event_id, dense_rank() OVER (PARTITION BY vehicle ORDER BY k)::INT AS r FROM pings"))
def dense_rank(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", F.dense_rank().over(Window.partitionBy("vehicle").orderBy("k")).alias("r"))


@query("avg_rank_norm", sql("SELECT event_id, round((rank() OVER (PARTITION BY shift ORDER BY k) + (count(*) OVER (PARTITION BY shift, k) - 1) / 2.0) / count(*) OVER (PARTITION BY shift), 6) AS r FROM pings"))
def avg_rank_norm(spark, sf_dir):
    p = keyed(pings(spark, sf_dir)).select("event_id", "shift", "k")
    return S.average_ranks(p, "k", ["shift"], "r").select("event_id", R("r", 6).alias("r"))


@query("entity_deviation", sql("SELECT event_id, round(speed - avg(speed) OVER (PARTITION BY vehicle), 6) AS d FROM pings"))
def entity_deviation(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", R(S.deviation("speed", BY), 6).alias("d"))


@query("hours_since_prev", sql("SELECT refuel_id, round((epoch_us(refuel_ts) - epoch_us(lag(refuel_ts) OVER (PARTITION BY vehicle ORDER BY refuel_ts, refuel_id))) / 3.6e9, 6) AS hours FROM refuels"))
def hours_since_prev(spark, sf_dir):
    from fleetspark.sources.pings import refuels

    v = S.ordered(BY, ["refuel_ts", "refuel_id"])
    return refuels(spark, sf_dir).select("refuel_id", R(keys.seconds_between(F.lag("refuel_ts").over(v), F.col("refuel_ts")) / 3600, 6).alias("hours"))


@query("days_since_flag", sql("SELECT event_id, coalesce(greatest(date_diff('day', max(CASE WHEN at_dump THEN date END) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), date), 0), 999)::INT AS days FROM pings"))
def days_since_flag(spark, sf_dir):
    p = keyed(pings(spark, sf_dir))
    last = S.forward_fill(F.when(F.col("at_dump"), F.col("date")), w())
    return p.select("event_id", F.coalesce(F.greatest(F.datediff("date", last), F.lit(0)), F.lit(999)).alias("days"))


@query("laden_cycles", sql(f""", c AS (SELECT *, coalesce(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS cycle FROM (SELECT *, at_dump AND NOT coalesce(lead(at_dump) OVER {W}, TRUE) AS f FROM pings))
SELECT event_id, cycle, round(sum(dist) OVER (PARTITION BY vehicle, cycle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS path, sum(dist) OVER (PARTITION BY vehicle, cycle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 500 AS laden FROM c"""))
def laden_cycles(spark, sf_dir):
    falls = F.col("at_dump") & ~F.coalesce(F.lead("at_dump").over(w()), F.lit(True))
    p = pings(spark, sf_dir).withColumn("f", falls).withColumn("cycle", S.running(F.col("f").cast("int"), w()))
    path = S.running(F.col("dist"), S.ordered(["vehicle", "cycle"], ORDER))
    return p.withColumn("path", path).select("event_id", "cycle", R("path", 6).alias("path"), (F.col("path") > 500).alias("laden"))


@query("zone_entries", sql(f"SELECT vehicle, count(*) FILTER (WHERE at_load AND NOT coalesce(b, FALSE)) AS entries, count(*) FILTER (WHERE at_load AND NOT coalesce(b, TRUE)) AS later_entries FROM (SELECT *, lag(at_load) OVER {W} AS b FROM pings) GROUP BY vehicle"))
def zone_entries(spark, sf_dir):
    p = pings(spark, sf_dir).select("vehicle", S.rising_edge(F.col("at_load"), w()).alias("a"), S.rising_edge(F.col("at_load"), w(), False).alias("b"))
    return p.groupBy("vehicle").agg(F.count_if("a").alias("entries"), F.count_if("b").alias("later_entries"))


@query("stop_events", sql(f"SELECT vehicle, count(*) FILTER (WHERE before > 30 AND speed <= 30 AND ignition = 1) AS stops FROM (SELECT *, lag(speed) OVER {W} AS before FROM pings) GROUP BY vehicle"))
def stop_events(spark, sf_dir):
    p = pings(spark, sf_dir).withColumn("before", F.lag("speed").over(w()))
    return p.groupBy("vehicle").agg(F.count_if((F.col("before") > 30) & (F.col("speed") <= 30) & (F.col("ignition") == 1)).alias("stops"))


@query("greedy_gate", sql(f""", p AS (SELECT vehicle, row_number() OVER {W} AS i, sum(dist) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS path FROM pings),
g AS (SELECT vehicle, i, path FROM p WHERE i = 1 UNION ALL SELECT n.vehicle, n.i, n.path FROM (SELECT p.vehicle, p.i, p.path, row_number() OVER (PARTITION BY p.vehicle, g.i ORDER BY p.i) AS r FROM g JOIN p ON p.vehicle = g.vehicle AND p.path >= g.path + 800 AND p.i > g.i) n WHERE r = 1)
SELECT vehicle, count(*) AS n, round(sum(path), 4) AS total FROM g GROUP BY vehicle""").replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_gate(spark, sf_dir):
    p = pings(spark, sf_dir).withColumn("path", S.running(F.col("dist"), w()))
    kept = S.greedy_gate(p, BY, ORDER, "path", 800.0)
    return kept.groupBy("vehicle").agg(F.count("*").alias("n"), R(F.sum("path"), 4).alias("total"))


@query("dwell_pairs", sql(ISLANDS + """, s AS (SELECT vehicle, island, min(ts) AS a, max(ts) AS b, (row_number() OVER (PARTITION BY vehicle ORDER BY island) - 1) // 2 AS pair FROM i WHERE slow GROUP BY vehicle, island)
SELECT vehicle, pair::BIGINT AS pair, min(a) AS start_ts, max(b) AS end_ts FROM s GROUP BY vehicle, pair HAVING count(*) = 2"""))
def dwell_pairs(spark, sf_dir):
    return S.pairs_of_islands(pings(spark, sf_dir).withColumn("slow", F.col("k") < 50), "slow", BY, ORDER, "ts")


@query("cycle_features", sql(EDGES + "SELECT vehicle, count(*) AS cycles, round(avg((epoch_us(b) - epoch_us(a)) / 1e6), 6) AS mean_seconds FROM d WHERE b IS NOT NULL GROUP BY vehicle"))
def cycle_features(spark, sf_dir):
    e = edged(spark, sf_dir).where("edge").withColumn("next", F.lead("ts").over(w())).where("next is not null")
    return e.groupBy("vehicle").agg(F.count("*").alias("cycles"), R(F.avg(keys.seconds_between(F.col("ts"), F.col("next"))), 6).alias("mean_seconds"))


@query("dedup_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def dedup_last(spark, sf_dir):
    v = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("r", F.row_number().over(v)).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("worst_5pct", sql(""", r AS (SELECT event_id, shift, abs(speed - avg(speed) OVER (PARTITION BY vehicle)) AS residual FROM pings), q AS (SELECT quantile_cont(residual, 0.95) AS t FROM r)
SELECT shift, count(*) AS n, count(*) FILTER (WHERE residual >= t) AS worst FROM r, q GROUP BY shift"""))
def worst_5pct(spark, sf_dir):
    from fleetspark.operators.aggregates import exact_quantiles

    r = keyed(pings(spark, sf_dir)).select("event_id", "shift", F.abs(S.deviation("speed", BY)).alias("residual"))
    return r.withColumn("t", exact_quantiles(r, "residual", {"t": 0.95}).scalar()).groupBy("shift").agg(F.count("*").alias("n"), F.count_if(F.col("residual") >= F.col("t")).alias("worst"))
