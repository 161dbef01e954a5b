"""Queries of samples, encodings, anchors, folds, blends and evaluation beyond the plain operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions import scalars
from fleetspark.operators import aggregates as A
from fleetspark.operators import ml, stats
from fleetspark.operators import sequence as S
from fleetspark.operators import spatial as P
from fleetspark.sources.pings import keyed, pings, shift_totals, sql
from fleetspark.storage import bounded, written

from .models import FEATURES, table
from .registry import query
from .spatial import ANCHORS_SQL, _near, segments

R = F.round


@query("row_sample", sql("SELECT event_id, speed FROM pings ORDER BY md5(concat('7:', event_id::VARCHAR)), event_id LIMIT 200"))
def row_sample(spark, sf_dir):
    """A sample of 200 rows that a seed decides, the same on every run: the least by hash, found by partial top-k."""
    p = pings(spark, sf_dir).select("event_id", "speed")
    return p.orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string"))), "event_id").limit(200)


@query("aligned_one_hot", sql(""", lv AS (SELECT DISTINCT event_type AS level FROM pings WHERE day(date) <= 20 AND event_type <> 'error')
SELECT event_id, level, (event_type = level AND k % 10 <> 0)::INT AS hot, (k % 10 = 0)::INT AS missing, CASE WHEN k = 0 THEN 0.0 ELSE round(speed / k, 6) END AS pace FROM pings, lv WHERE day(date) > 20"""))
def aligned_one_hot(spark, sf_dir):
    """Test rows by the levels of training rows, in which no 'error' is; missing where altitude is; a pace over 0 gives 0."""
    p = keyed(pings(spark, sf_dir)).withColumn("level", F.when(F.col("altitude").isNotNull(), F.col("event_type")))
    levels = ml.one_hot_levels(p.where((F.dayofmonth("date") <= 20) & (F.col("event_type") != "error")), "level")
    out = ml.aligned_one_hot(p.where(F.dayofmonth("date") > 20), "level", levels)
    pace = ml.finite(R(F.try_divide("speed", F.col("k")), 6))
    rows = F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"level_{v}").alias("hot")) for v in levels))
    return out.select("event_id", F.inline(rows), F.col("level_null").alias("missing"), pace.alias("pace"))


@query("plane_round_trip", sql(", m AS (SELECT avg(23 + x / 10000) AS lat0 FROM pings) SELECT event_id, round((86 + y / 10000) * 111320.0 * cos(radians(lat0)), 3) AS east, round((23 + x / 10000) * 110540.0, 3) AS north, round(23 + x / 10000, 6) AS lat, round(86 + y / 10000, 6) AS lon FROM pings, m"))
def plane_round_trip(spark, sf_dir):
    """To the plane that touches at the mean latitude of all rows, and back."""
    p = pings(spark, sf_dir).select("event_id", (23 + F.col("x") / 10000).alias("lat"), (86 + F.col("y") / 10000).alias("lon"))
    p = A.with_scalars(p, lat0=F.avg("lat"))
    east, north = scalars.local_plane(F.col("lat"), F.col("lon"), F.col("lat0"))
    p = p.select("event_id", "lat0", east.alias("east"), north.alias("north"))
    lat, lon = scalars.from_local_plane(F.col("east"), F.col("north"), F.col("lat0"))
    return p.select("event_id", R("east", 3).alias("east"), R("north", 3).alias("north"), R(lat, 6).alias("lat"), R(lon, 6).alias("lon"))


@query("near_any_anchor", sql(""", a AS (SELECT mine, date, shift, vehicle, median(x) AS ax, median(y) AS ay FROM pings WHERE at_load AND speed < 30 GROUP BY ALL)
SELECT event_id, EXISTS (SELECT 1 FROM a WHERE a.mine = p.mine AND a.date = p.date AND a.shift = p.shift AND pow(x - ax, 2) + pow(y - ay, 2) < 32400) AS near FROM pings p"""))
def near_any_anchor(spark, sf_dir):
    """Whether any loader of the mine and shift has its median place closer than 180 m."""
    p = keyed(pings(spark, sf_dir))
    by = ["mine", "date", "shift"]
    a = p.where(F.col("at_load") & (F.col("speed") < 30)).groupBy(*by, F.col("vehicle").alias("anchor")).agg(F.percentile("x", F.lit(0.5)).alias("ax"), F.percentile("y", F.lit(0.5)).alias("ay"))
    return P.nearest_anchor(p.select("event_id", *by, "x", "y"), a, 180.0, "event_id", by).select("event_id", F.col("anchor").isNotNull().alias("near"))


@query("assigned_distance", sql(ANCHORS_SQL + """, asg AS (SELECT vehicle, anchor FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY n DESC, anchor) AS r FROM (SELECT vehicle, anchor, count(*) AS n FROM near WHERE r = 1 GROUP BY ALL)) WHERE r = 1)
SELECT event_id, round(sqrt(pow(x - x1, 2) + pow(y - y1, 2)), 6) AS distance, coalesce(sqrt(pow(x - x1, 2) + pow(y - y1, 2)) < 100, FALSE) AS at_loading FROM pings LEFT JOIN asg USING (vehicle) LEFT JOIN seg ON geom_id = anchor"""))
def assigned_distance(spark, sf_dir):
    """Distance of every ping to its vehicle's most frequent nearest anchor."""
    home = P.assigned_anchor(_near(spark, sf_dir), "vehicle").select("vehicle", "anchor")
    home = home.join(segments(spark, sf_dir).select(F.col("geom_id").alias("anchor"), "x1", "y1"), "anchor").drop("anchor")
    home = bounded(written(home, "homes"))  # a row a vehicle; the pings aren't shuffled while these are few
    d = scalars.magnitude(F.col("x") - F.col("x1"), F.col("y") - F.col("y1"))
    return pings(spark, sf_dir).join(home, "vehicle", "left").select("event_id", R(d, 6).alias("distance"), F.coalesce(d < 100, F.lit(False)).alias("at_loading"))


@query("zero_distance_cycles", sql(""", z AS (SELECT *, CASE WHEN altitude IS NULL THEN 0 ELSE dist END AS moved FROM pings), c AS (SELECT *, sum((moved = 0)::INT) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cycle FROM z)
SELECT event_id, cycle, round(sum(moved) OVER (PARTITION BY vehicle, cycle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS path FROM c"""))
def zero_distance_cycles(spark, sf_dir):
    """Cycles that begin at each row without distance, for vehicles without a dump signal."""
    order = ["ts", "event_id"]
    p = pings(spark, sf_dir).withColumn("moved", F.when(F.col("altitude").isNull(), 0.0).otherwise(F.col("dist")))
    p = p.withColumn("cycle", S.running((F.col("moved") == 0).cast("int"), S.ordered(["vehicle"], order)))
    return p.select("event_id", "cycle", R(S.running(F.col("moved"), S.ordered(["vehicle", "cycle"], order)), 6).alias("path"))


@query("packed_folds", sql(""", s AS (SELECT vehicle, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, vehicle) AS i FROM pings GROUP BY vehicle),
f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS vehicle, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
SELECT s.i, s.vehicle, (list_position(loads, list_min(loads)) - 1)::INT, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN s.n ELSE 0 END)::BIGINT[] FROM f JOIN s ON s.i = f.i + 1)
SELECT vehicle, fold FROM f WHERE i > 0""").replace("WITH ", "WITH RECURSIVE ", 1))
def packed_folds(spark, sf_dir):
    return ml.pack_group_folds(pings(spark, sf_dir).select("vehicle"), "vehicle").distinct()


BLENDS = ([0.5, 1.0, 2.0], [0.55, 0.7, 0.85], [0.8, 1.2], [0.5, 0.8])
_ROWS = [("power", 0.0, g) for g in BLENDS[0]] + [("step", e, g) for e in BLENDS[1] for g in BLENDS[2]] + [("ramp", e, 1.0) for e in BLENDS[3]]
_PR = ", b AS (SELECT dist, k / 99.0::DOUBLE AS p, speed + 100 AS r FROM pings)"


def _pr(spark, sf_dir):
    return pings(spark, sf_dir).select("dist", (F.col("k") / 99.0).alias("p"), (F.col("speed") + 100).alias("r"))


@query("blend_families", sql(_PR + "SELECT family, edge, gamma, round(avg(pow(dist - r * CASE WHEN family = 'power' THEN pow(p, gamma) WHEN family = 'ramp' THEN least(p / edge, 1) WHEN p >= edge THEN 1 ELSE pow(p, gamma) END, 2)), 4) AS mse FROM b, (VALUES " + ", ".join(f"('{f}', {e}::DOUBLE, {g}::DOUBLE)" for f, e, g in _ROWS) + ") v(family, edge, gamma) GROUP BY ALL"))
def blend_families(spark, sf_dir):
    return ml.blend_families(_pr(spark, sf_dir), "dist", "p", "r", *BLENDS).withColumn("mse", R("mse", 4))


@query("scaled_blends", sql(_PR + ", s AS (SELECT gamma, count(*) AS n, sum(dist * r * pow(p, gamma)) AS yb, sum(pow(r * pow(p, gamma), 2)) AS bb, sum(dist * dist) AS yy FROM b, (VALUES (0.5::DOUBLE), (1::DOUBLE), (2::DOUBLE)) v(gamma) GROUP BY gamma), a AS (SELECT *, least(greatest(yb / bb, 0.5), 1.5) AS a FROM s) SELECT gamma, round(a, 6) AS alpha, round((yy - 2 * a * yb + a * a * bb) / n, 4) AS mse FROM a"))
def scaled_blends(spark, sf_dir):
    out = ml.scaled_blends(_pr(spark, sf_dir), "dist", "p", "r", BLENDS[0])
    return out.select("gamma", R("alpha", 6).alias("alpha"), R("mse", 4).alias("mse"))


AUC_SQL = "(count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y))::DOUBLE"
RANK_SQL = "rank() OVER ({0} ORDER BY speed) + (count(*) OVER (PARTITION BY {1}speed) - 1) / 2.0::DOUBLE AS r"


@query("auc_by_shift", sql(f", q AS (SELECT shift, dist > 245 AS y, {RANK_SQL.format('PARTITION BY shift', 'shift, ')} FROM pings) SELECT shift, round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0::DOUBLE) / {AUC_SQL}, 6) AS auc FROM q GROUP BY shift"))
def auc_by_shift(spark, sf_dir):
    p = keyed(pings(spark, sf_dir)).select("shift", "speed", (F.col("dist") > 245).alias("y"))
    return A.area_under_curve(p, "speed", "y", ["shift"]).withColumn("auc", R("auc", 6))


@query("auc_overall", sql(f", q AS (SELECT dist > 245 AS y, {RANK_SQL.format('', '')} FROM pings) SELECT round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0::DOUBLE) / {AUC_SQL}, 6) AS auc FROM q"))
def auc_overall(spark, sf_dir):
    p = pings(spark, sf_dir).select("speed", (F.col("dist") > 245).alias("y"))
    return A.area_under_curve(p, "speed", "y").withColumn("auc", R("auc", 6))


@query("corr_pairs", sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM pings" for a, b in (("speed", "k"), ("speed", "dist"), ("speed", "altitude"), ("k", "dist"), ("k", "altitude"), ("dist", "altitude")))))
def corr_pairs(spark, sf_dir):
    return A.all_correlations(pings(spark, sf_dir), ["speed", "k", "dist", "altitude"]).withColumn("corr", R("corr", 6))


@query("calibration_gate", sql(", b AS (SELECT event_id, dist, speed * 5 AS raw, greatest(k * 5.0, 10) AS c FROM pings), g AS (SELECT sqrt(avg(pow(raw - dist, 2))) - sqrt(avg(pow(c - dist, 2))) AS gain FROM b) SELECT event_id, round(CASE WHEN gain > 0 THEN c ELSE raw END, 6) AS predicted FROM b, g"))
def calibration_gate(spark, sf_dir):
    p = pings(spark, sf_dir).select("event_id", "dist", (F.col("speed") * 5).alias("raw"), (F.col("k") * 5.0).alias("c"))
    return ml.gated(p, "raw", "c", "dist", "predicted", floor=10.0).select("event_id", R("predicted", 6).alias("predicted"))


@query("oof_stats", sql(""", f AS (SELECT *, day(date) % 5 AS fold FROM totals), c AS (SELECT DISTINCT vehicle, fold FROM f),
s AS (SELECT c.vehicle, c.fold, avg(b.used) AS m, stddev_samp(b.used) AS d, count(b.used) AS n FROM c LEFT JOIN f b ON b.vehicle = c.vehicle AND b.fold <> c.fold GROUP BY ALL)
SELECT vehicle, date, f.shift, round(m + 1e-9, 5) AS veh_mean, round(d + 1e-9, 5) AS veh_std, s.n AS veh_n FROM f JOIN s USING (vehicle, fold)"""))
def oof_stats(spark, sf_dir):
    t = shift_totals(spark, sf_dir).withColumn("fold", F.dayofmonth("date") % 5)
    out = stats.out_of_fold_stats(t, ["vehicle"], "fold", "used", "veh")
    return out.select("vehicle", "date", "shift", *(R(F.col(c) + 1e-9, 5).alias(c) for c in ("veh_mean", "veh_std")), "veh_n")


def _parts(spark, sf_dir):
    t = table(spark, sf_dir)
    return t.where(F.dayofmonth("date") <= 20), t.where(F.dayofmonth("date") > 20)


@query("day_night_experts")
def day_night_experts(spark, sf_dir):
    return ml.experts(*_parts(spark, sf_dir), FEATURES, "used", F.col("shift") == "C").select("vehicle", "date", "shift", "used", "predicted")


#: What any sound model meets: a row a test shift, no missing prediction, a smaller error than the training mean's.
DIGEST_SQL = sql("SELECT count(*) AS n, count(*) AS n_predicted, TRUE AS beats_mean FROM totals WHERE day(date) > 20")


def digest(train, predicted):
    mean = train.agg(F.avg("used")).scalar()
    d = predicted.withColumn("__m", mean)
    error = lambda c: F.avg(F.pow(F.col("used") - F.col(c), 2))
    return d.agg(F.count("*").alias("n"), F.count(F.when(~F.isnan("predicted"), F.col("predicted"))).alias("n_predicted"), (error("predicted") < error("__m")).alias("beats_mean"))


@query("gbt_digest", DIGEST_SQL)
def gbt_digest(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return digest(a, ml.gbt(a, b, FEATURES, "used")[0])


@query("hurdle_digest", DIGEST_SQL)
def hurdle_digest(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return digest(a, ml.hurdle(a, b, FEATURES, "used", 10.0, trees=8, depth=2))


@query("experts_digest", DIGEST_SQL)
def experts_digest(spark, sf_dir):
    a, b = _parts(spark, sf_dir)
    return digest(a, ml.experts(a, b, FEATURES, "used", F.col("shift") == "C"))


@query("importances")
def importances(spark, sf_dir):
    """(feature, importance) of the boosted trees, largest first."""
    a, b = _parts(spark, sf_dir)
    found = ml.gbt(a, b, FEATURES, "used")[1]
    return spark.createDataFrame(sorted(found.items(), key=lambda x: -x[1]), "feature string, importance double")
