"""Queries of aggregations and leak-safe statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetspark.functions import keys, scalars
from fleetspark.operators import aggregates as A
from fleetspark.operators import stats
from fleetspark.sources.pings import keyed, pings, refuels, shift_totals, sql

from .registry import query

R = F.round


def p_(spark, sf_dir):
    return keyed(pings(spark, sf_dir))


@query("grouped_agg", sql("SELECT vehicle, shift, count(*) AS n, count(altitude) AS n_altitude, round(sum(dist), 6) AS km, round(avg(speed) + 1e-9, 6) AS speed_mean, min(k) AS k_min, max(k) AS k_max, count(DISTINCT k) AS k_kinds FROM pings GROUP BY ALL"))
def grouped_agg(spark, sf_dir):
    return p_(spark, sf_dir).groupBy("vehicle", "shift").agg(F.count("*").alias("n"), F.count("altitude").alias("n_altitude"), R(F.sum("dist"), 6).alias("km"), R(F.avg("speed") + 1e-9, 6).alias("speed_mean"), F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.count_distinct("k").alias("k_kinds"))


@query("cond_sum", sql("SELECT vehicle, round(coalesce(sum(dist) FILTER (WHERE ignition = 1 AND speed > 30), 0), 6) AS moving, round(coalesce(sum(dist) FILTER (WHERE at_load AND at_dump), 0), 6) AS nothing FROM pings GROUP BY vehicle"))
def cond_sum(spark, sf_dir):
    return p_(spark, sf_dir).groupBy("vehicle").agg(R(A.total(F.col("dist"), (F.col("ignition") == 1) & (F.col("speed") > 30)), 6).alias("moving"), R(A.total(F.col("dist"), F.col("at_load") & F.col("at_dump")), 6).alias("nothing"))


@query("bool_frac", sql("SELECT vehicle, round(avg(at_load::INT), 6) AS load_share, round(avg((speed <= 30)::INT), 6) AS slow_share FROM pings GROUP BY vehicle"))
def bool_frac(spark, sf_dir):
    return p_(spark, sf_dir).groupBy("vehicle").agg(R(A.share(F.col("at_load")), 6).alias("load_share"), R(A.share(F.col("speed") <= 30), 6).alias("slow_share"))


QS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99_9": 0.999}


@query("quantiles", sql("SELECT vehicle, " + ", ".join(f"round(quantile_cont(speed, {q}), 6) AS speed_{n}" for n, q in QS.items()) + " FROM pings WHERE speed > 1 GROUP BY vehicle"))
def quantiles(spark, sf_dir):
    out = p_(spark, sf_dir).where("speed > 1").groupBy("vehicle").agg(*A.quantiles("speed", list(QS.values())))
    return out.select("vehicle", *(R(c, 6).alias(c) for c in out.columns[1:]))


@query("quantile_pivot", sql("SELECT shift, round(quantile_cont(dist, 0.5), 6) AS q50, round(quantile_cont(dist, 0.75), 6) AS q75, round(quantile_cont(dist, 0.9), 6) AS q90 FROM pings GROUP BY shift"))
def quantile_pivot(spark, sf_dir):
    q = p_(spark, sf_dir).groupBy("shift").agg(F.percentile("dist", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("q"))
    return q.select("shift", *(R(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q50", "q75", "q90"))))


@query("median", sql("SELECT vehicle, median(dist) AS m FROM pings GROUP BY vehicle"))
def median(spark, sf_dir):
    return p_(spark, sf_dir).groupBy("vehicle").agg(F.median("dist").alias("m"))


@query("std_var", sql("SELECT vehicle, shift, round(stddev_samp(speed), 6) AS std, round(var_pop(speed), 6) AS var, round(stddev_samp(speed) / (avg(speed) + 1e-6), 6) AS cv FROM pings GROUP BY ALL"))
def std_var(spark, sf_dir):
    return p_(spark, sf_dir).groupBy("vehicle", "shift").agg(R(F.stddev_samp("speed"), 6).alias("std"), R(F.var_pop("speed"), 6).alias("var"), R(F.stddev_samp("speed") / (F.avg("speed") + 1e-6), 6).alias("cv"))


@query("first_last", sql("""SELECT vehicle, date, first(altitude ORDER BY ts, event_id) AS a_first, last(altitude ORDER BY ts, event_id) AS a_last, first(altitude ORDER BY ts, event_id) FILTER (WHERE altitude IS NOT NULL) AS known_first,
CASE WHEN count(*) > 1 THEN last(k ORDER BY ts, event_id) - first(k ORDER BY ts, event_id) ELSE 0 END AS net FROM pings GROUP BY ALL"""))
def first_last(spark, sf_dir):
    p = p_(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return p.groupBy("vehicle", "date").agg(A.first_by("altitude", "at").alias("a_first"), A.last_by("altitude", "at").alias("a_last"), A.first_value("altitude", "at").alias("known_first"), F.when(F.count("*") > 1, A.last_by("k", "at") - A.first_by("k", "at")).otherwise(0).alias("net"))


@query("range_span", sql("SELECT vehicle, date, max(k) - min(k) AS k_range, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span FROM pings GROUP BY ALL"))
def range_span(spark, sf_dir):
    return p_(spark, sf_dir).groupBy("vehicle", "date").agg((F.max("k") - F.min("k")).alias("k_range"), R(keys.seconds_between(F.min("ts"), F.max("ts")), 6).alias("span"))


@query("mode_min", sql("SELECT vehicle, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY n DESC, event_type) AS r FROM (SELECT vehicle, event_type, count(*) AS n FROM pings GROUP BY vehicle, event_type)) WHERE r = 1"))
def mode_min(spark, sf_dir):
    return A.mode_least(p_(spark, sf_dir), ["vehicle"], "event_type")


@query("any_flag", sql("SELECT vehicle, date, max((speed > 80)::INT) AS any_fast FROM pings GROUP BY ALL"))
def any_flag(spark, sf_dir):
    return p_(spark, sf_dir).groupBy("vehicle", "date").agg(F.max((F.col("speed") > 80).cast("int")).alias("any_fast"))


@query("two_level", sql("SELECT vehicle, count(*) AS days, round(avg(km), 6) AS km_a_day, round(max(km), 6) AS km_most FROM (SELECT vehicle, date, sum(dist) AS km FROM pings GROUP BY ALL) GROUP BY vehicle"))
def two_level(spark, sf_dir):
    d = p_(spark, sf_dir).groupBy("vehicle", "date").agg(F.sum("dist").alias("km"))
    return d.groupBy("vehicle").agg(F.count("*").alias("days"), R(F.avg("km"), 6).alias("km_a_day"), R(F.max("km"), 6).alias("km_most"))


@query("top_cell_share", sql("SELECT vehicle, count(*) AS cells, round(max(w) / sum(w), 6) AS top_share FROM (SELECT vehicle, floor(x / 300) * 1000000 + floor(y / 300) AS cell, sum(dist) AS w FROM pings GROUP BY ALL) GROUP BY vehicle"))
def top_cell_share(spark, sf_dir):
    from fleetspark.functions.scalars import grid_cell

    p = p_(spark, sf_dir).withColumn("cell", grid_cell(F.col("x"), F.col("y"), 300.0))
    return A.top_share(p, ["vehicle"], "cell", F.col("dist")).withColumn("top_share", R("top_share", 6))


@query("entropy", sql("SELECT vehicle, round(sum(-p * ln(p + 1e-9)), 6) AS entropy, round(max(p), 6) AS dominant_share FROM (SELECT vehicle, w / (sum(w) OVER (PARTITION BY vehicle) + 1e-6) AS p FROM (SELECT vehicle, event_type, sum(dist) AS w FROM pings GROUP BY ALL)) GROUP BY vehicle"))
def entropy(spark, sf_dir):
    e = A.entropy(p_(spark, sf_dir), ["vehicle"], "event_type", F.col("dist"))
    return e.select("vehicle", R("entropy", 6).alias("entropy"), R("dominant_share", 6).alias("dominant_share"))


@query("global_scalars", sql("SELECT vehicle, round(avg(speed) - (SELECT avg(speed) FROM pings), 6) AS over_mean, count(*) FILTER (WHERE speed > (SELECT quantile_cont(speed, 0.95) FROM pings)) AS fast FROM pings GROUP BY vehicle"))
def global_scalars(spark, sf_dir):
    p = p_(spark, sf_dir).select("vehicle", "speed")
    p = A.with_scalars(p, m=F.avg("speed")).withColumn("q", A.exact_quantiles(p, "speed", {"q": 0.95}).scalar())
    return p.groupBy("vehicle").agg(R(F.avg("speed") - F.first("m"), 6).alias("over_mean"), F.count_if(F.col("speed") > F.col("q")).alias("fast"))


@query("exp_weighted_mean", sql("SELECT vehicle, round(sum(w * dist) / sum(w), 6) AS decayed_mean FROM (SELECT vehicle, dist, exp(-0.1 * (row_number() OVER (PARTITION BY vehicle ORDER BY ts DESC, event_id DESC) - 1)) AS w FROM pings) GROUP BY vehicle"))
def exp_weighted_mean(spark, sf_dir):
    return A.decayed_mean(pings(spark, sf_dir), ["vehicle"], ["ts", "event_id"], "dist").withColumn("decayed_mean", R("decayed_mean", 6))


@query("corr_matrix", sql("SELECT 'speed' AS feature, round(corr(speed, dist), 6) AS corr FROM pings UNION ALL SELECT 'k', round(corr(k, dist), 6) FROM pings UNION ALL SELECT 'ignition', round(corr(ignition, dist), 6) FROM pings"))
def corr_matrix(spark, sf_dir):
    return A.correlations(pings(spark, sf_dir), ["speed", "k", "ignition"], "dist").withColumn("corr", R("corr", 6))


@query("bucket_hist", sql("SELECT floor(dist / 50)::BIGINT AS bucket, count(*) AS n FROM pings GROUP BY 1"))
def bucket_hist(spark, sf_dir):
    return pings(spark, sf_dir).groupBy(F.floor(F.col("dist") / 50).alias("bucket")).agg(F.count("*").alias("n"))


@query("resample_daily", sql(", d AS (SELECT CAST(ts AS DATE) AS day, sum(dist) AS total FROM pings WHERE day(ts) NOT IN (5, 6) GROUP BY 1) SELECT CAST(g AS DATE) AS day, round(coalesce(total, 0), 6) AS total FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS g) LEFT JOIN d ON d.day = CAST(g AS DATE)"))
def resample_daily(spark, sf_dir):
    return A.resample_daily(pings(spark, sf_dir).where(~F.dayofmonth("ts").isin(5, 6)), "ts", "dist").withColumn("total", R("total", 6))


@query("fuel_balance", sql("SELECT vehicle, date, round(greatest(first(altitude ORDER BY ts, event_id) FILTER (WHERE altitude IS NOT NULL) - last(altitude ORDER BY ts, event_id) FILTER (WHERE altitude IS NOT NULL) + coalesce(sum(dist) FILTER (WHERE event_type = 'purchase'), 0), 0), 6) AS used FROM pings GROUP BY ALL HAVING count(altitude) > 0"))
def fuel_balance(spark, sf_dir):
    p = p_(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    g = p.groupBy("vehicle", "date").agg(A.first_value("altitude", "at").alias("a"), A.last_value("altitude", "at").alias("b"), F.sum(F.when(F.col("event_type") == "purchase", F.col("dist"))).alias("added"))
    return g.where("a is not null").select("vehicle", "date", R(A.fuel_balance(F.col("a"), F.col("b"), F.col("added")), 6).alias("used"))


@query("zone_counts", sql("SELECT vehicle, loads, dumps, greatest(n - loads - dumps - 5, 0) AS outside, greatest(loads, dumps) AS proxy FROM (SELECT vehicle, count(*) AS n, count(*) FILTER (WHERE at_load) AS loads, count(*) FILTER (WHERE at_dump) AS dumps FROM pings GROUP BY vehicle)"))
def zone_counts(spark, sf_dir):
    g = pings(spark, sf_dir).groupBy("vehicle").agg(F.count("*").alias("n"), F.count_if("at_load").alias("loads"), F.count_if("at_dump").alias("dumps"))
    return g.select("vehicle", "loads", "dumps", F.greatest(F.col("n") - F.col("loads") - F.col("dumps") - 5, F.lit(0)).alias("outside"), F.greatest("loads", "dumps").alias("proxy"))


@query("rmse_by_group", sql("SELECT shift, round(sqrt(avg(pow(dist - m, 2))), 6) AS rmse, round(avg(((dist > 245) = (m > 245))::INT), 6) AS accuracy FROM (SELECT *, avg(dist) OVER (PARTITION BY vehicle) AS m FROM pings) GROUP BY shift"))
def rmse_by_group(spark, sf_dir):
    p = p_(spark, sf_dir).withColumn("m", F.avg("dist").over(Window.partitionBy("vehicle")))
    return p.groupBy("shift").agg(R(A.rmse("dist", "m"), 6).alias("rmse"), R(A.share((F.col("dist") > 245) == (F.col("m") > 245)), 6).alias("accuracy"))


TRAIN = "day(date) <= 20"


@query("vehicle_history", sql(f""", tr AS (SELECT * FROM totals WHERE {TRAIN}), a AS (SELECT vehicle, shift, median(used) AS m FROM tr GROUP BY ALL), b AS (SELECT vehicle, median(used) AS m FROM tr GROUP BY ALL)
SELECT t.vehicle, t.date, t.shift, round(coalesce(a.m, b.m, (SELECT median(used) FROM tr)), 6) AS expected FROM totals t LEFT JOIN a USING (vehicle, shift) LEFT JOIN b USING (vehicle)"""))
def vehicle_history(spark, sf_dir):
    t = shift_totals(spark, sf_dir)
    train = t.where(F.dayofmonth("date") <= 20)
    fine, coarse = stats.fit_history(train, ["vehicle", "shift"], "used", "vs"), stats.fit_history(train, ["vehicle"], "used", "v")
    out = stats.apply_history(t.withColumn("g", A.exact_quantiles(train, "used", {"m": 0.5}).scalar()), [(fine, ["vehicle", "shift"], "vs"), (coarse, ["vehicle"], "v")], "median", F.col("g"), "expected")
    return out.select("vehicle", "date", "shift", R("expected", 6).alias("expected"))


@query("smoothed_mean", sql(f", tr AS (SELECT * FROM totals WHERE {TRAIN}) SELECT vehicle, round((count(used) * avg(used) + 5 * (SELECT avg(used) FROM tr)) / (count(used) + 5), 6) AS smoothed FROM tr GROUP BY vehicle"))
def smoothed_mean(spark, sf_dir):
    return stats.smoothed_mean(shift_totals(spark, sf_dir).where(F.dayofmonth("date") <= 20), ["vehicle"], "used", 5).withColumn("smoothed", R("smoothed", 6))


@query("oof_mean", sql(""", f AS (SELECT *, day(date) % 5 AS fold FROM totals)
SELECT vehicle, date, shift, round(coalesce((SELECT avg(used) FROM f b WHERE b.vehicle = f.vehicle AND b.fold <> f.fold), (SELECT avg(used) FROM f c WHERE c.fold <> f.fold)) + 1e-9, 6) AS oof_mean FROM f"""))
def oof_mean(spark, sf_dir):
    t = shift_totals(spark, sf_dir).withColumn("fold", F.dayofmonth("date") % 5)
    return stats.out_of_fold_mean(t, ["vehicle"], "fold", "used").select("vehicle", "date", "shift", R(F.col("oof_mean") + 1e-9, 6).alias("oof_mean"))


@query("physics_prior", sql("""SELECT t.vehicle, t.date, t.shift, round(t.n * coalesce(v.rate, g.rate, 46.0), 6) AS prior FROM totals t LEFT JOIN (SELECT vehicle, median(used / n) AS rate FROM totals WHERE n > 1 GROUP BY 1) v USING (vehicle), (SELECT median(used / n) AS rate FROM totals WHERE n > 1) g"""))
def physics_prior(spark, sf_dir):
    t = shift_totals(spark, sf_dir)
    rate = t.where("n > 1").withColumn("r", F.col("used") / F.col("n"))
    v = rate.groupBy("vehicle").agg(F.percentile("r", F.lit(0.5)).alias("rate"))
    return t.join(v, "vehicle", "left").withColumn("g", A.exact_quantiles(rate, "r", {"m": 0.5}).scalar()).select("vehicle", "date", "shift", R(F.col("n") * F.coalesce("rate", "g", F.lit(46.0)), 6).alias("prior"))


_SQL_DATE, _SQL_SHIFT = "CAST(t AS DATE) - CASE WHEN hour(t) < 6 THEN 1 ELSE 0 END", "CASE WHEN hour(t) >= 6 AND hour(t) < 14 THEN 'A' WHEN hour(t) >= 14 AND hour(t) < 22 THEN 'B' ELSE 'C' END"


@query("refuel_offsets", sql(f"""SELECT vehicle, {_SQL_DATE} AS date, {_SQL_SHIFT} AS shift, round(coalesce(sum(litres) FILTER (WHERE o = 0), 0), 6) AS litres_0, count(*) FILTER (WHERE o = 0) AS count_0,
round(coalesce(sum(litres) FILTER (WHERE o = 2), 0), 6) AS litres_p2, count(*) FILTER (WHERE o = 2) AS count_p2, round(coalesce(sum(litres) FILTER (WHERE o = -2), 0), 6) AS litres_m2, count(*) FILTER (WHERE o = -2) AS count_m2
FROM (SELECT vehicle, litres, o, refuel_ts + o * INTERVAL 1 MINUTE AS t FROM refuels, (VALUES (0), (2), (-2)) v(o)) GROUP BY ALL"""))
def refuel_offsets(spark, sf_dir):
    out = stats.refuel_offsets(refuels(spark, sf_dir), "refuel_ts", "litres", lambda t: [F.col("vehicle"), keys.op_date(t).alias("date"), keys.shift_label(t).alias("shift")])
    return out.select(*(R(c, 6).alias(c) if c.startswith("litres") else F.col(c) for c in out.columns))


@query("refuel_prior", sql(""", r AS (SELECT t.*, EXISTS (SELECT 1 FROM refuels q WHERE q.vehicle = t.vehicle AND CAST(q.refuel_ts AS DATE) = t.date) AS refuelled FROM totals t) SELECT vehicle, refuelled, round(avg(used) + 1e-9, 6) AS prior FROM r GROUP BY ALL"""))
def refuel_prior(spark, sf_dir):
    days = refuels(spark, sf_dir).select("vehicle", F.to_date("refuel_ts").alias("date"), F.lit(True).alias("refuelled")).distinct()
    t = shift_totals(spark, sf_dir).join(days, ["vehicle", "date"], "left").withColumn("refuelled", F.coalesce("refuelled", F.lit(False)))
    return t.groupBy("vehicle", "refuelled").agg(R(F.avg("used") + 1e-9, 6).alias("prior"))


@query("bad_day_flag", sql(", d AS (SELECT date, avg(speed) AS m FROM pings GROUP BY date) SELECT date, round(m, 6) AS day_mean, (m <= (SELECT quantile_cont(m, 0.25) FROM d))::INT AS is_low FROM d"))
def bad_day_flag(spark, sf_dir):
    return stats.low_days(p_(spark, sf_dir), "date", "speed").withColumn("day_mean", R("day_mean", 6))


@query("route_benchmark", sql(", b AS (SELECT *, floor(speed / 20) AS sb, k // 25 AS kb FROM pings) SELECT vehicle, round(avg(dist - e), 6) AS efficiency, count(*) AS n FROM (SELECT *, avg(dist) OVER (PARTITION BY sb, kb) AS e FROM b) GROUP BY vehicle"))
def route_benchmark(spark, sf_dir):
    p = pings(spark, sf_dir).withColumn("sb", F.floor(F.col("speed") / 20)).withColumn("kb", F.floor(F.col("k") / 25))
    return stats.benchmark_residual(p, ["sb", "kb"], "vehicle", "dist").withColumn("efficiency", R("efficiency", 6))


@query("fallback_cascade", sql(""", days AS (SELECT vehicle, date, sum(dist) AS used FROM pings GROUP BY ALL), h AS (SELECT a.vehicle, a.date, count(b.used) AS n, avg(b.used) AS m, sum(pow(0.75, r) * b.used) FILTER (WHERE r < 5) / sum(pow(0.75, r)) FILTER (WHERE r < 5) AS e FROM days a LEFT JOIN LATERAL
(SELECT used, row_number() OVER (ORDER BY date DESC) - 1 AS r FROM days d WHERE d.vehicle = a.vehicle AND d.date < a.date) b ON TRUE GROUP BY ALL)
SELECT vehicle, date, round(coalesce(CASE WHEN n >= 3 THEN e END, CASE WHEN n > 0 THEN 0.6 * m + 0.4 * (SELECT avg(used) FROM days) END, (SELECT median(used) FROM days)), 6) AS expected FROM h"""))
def fallback_cascade(spark, sf_dir):
    from fleetspark.operators.joins import history_before

    days = p_(spark, sf_dir).groupBy("vehicle", "date").agg(F.sum("dist").alias("used"))
    h = A.with_scalars(history_before(days, ["vehicle"], "date", "used"), g=F.avg("used")).withColumn("gm", A.exact_quantiles(days, "used", {"m": 0.5}).scalar())
    n = F.col("history_n")
    out = stats.cascade(h, "expected", (n >= 3, F.col("history_ewma")), (n > 0, 0.6 * F.col("history_mean") + 0.4 * F.col("g")), (F.lit(True), F.col("gm")))
    return out.select("vehicle", "date", R("expected", 6).alias("expected"))


@query("impute_levels", sql("SELECT event_id, round(coalesce(altitude, avg(altitude) OVER (PARTITION BY vehicle), (SELECT avg(altitude) FROM pings)), 6) AS altitude FROM pings"))
def impute_levels(spark, sf_dir):
    p = A.with_scalars(pings(spark, sf_dir), g=F.avg("altitude"))
    return p.select("event_id", R(F.coalesce("altitude", F.avg("altitude").over(Window.partitionBy("vehicle")), "g"), 6).alias("altitude"))


@query("speed_bands", sql("SELECT vehicle, date, shift, round(least(greatest(quantile_cont(speed, 0.5) / 10, 0), 1), 6) AS time_at_low_speed, round(least(greatest((quantile_cont(speed, 0.9) - 30) / 30, 0), 1), 6) AS time_at_high_speed FROM pings GROUP BY ALL"))
def speed_bands(spark, sf_dir):
    """How far a shift's median and 90th percentile of speed saturate a low and a high band."""
    q = lambda x: F.percentile("speed", F.lit(x))
    band = lambda x, low, wide: R(scalars.clip((x - low) / wide, 0.0, 1.0), 6)
    return p_(spark, sf_dir).groupBy("vehicle", "date", "shift").agg(band(q(0.5), 0.0, 10.0).alias("time_at_low_speed"), band(q(0.9), 30.0, 30.0).alias("time_at_high_speed"))


@query("describe", sql(" UNION ALL ".join(f"SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS std, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest FROM pings" for c in ("speed", "altitude", "k"))))
def describe(spark, sf_dir):
    """Counts, means, deviations and bounds of columns, in one pass and a row a column."""
    return A.described(pings(spark, sf_dir), ["speed", "altitude", "k"]).select("col", "n", R("mean", 6).alias("mean"), R("std", 6).alias("std"), "least", "greatest")
