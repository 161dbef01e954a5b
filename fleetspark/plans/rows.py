"""Queries of projections, filters and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetspark.functions import keys, scalars
from fleetspark.operators import narrow, stats
from fleetspark.sources import incremental, probe
from fleetspark.sources.files import discover
from fleetspark.sources.pings import keyed, pings, shift_totals, sql
from fleetspark.storage import shared_dir

from .registry import query

R = F.round


def r6(name):
    return F.round(name, 6).alias(name)


FAMILIES = {
    "plus2h": "CAST(ts + INTERVAL 2 HOUR AS DATE)",
    "carry_back": "CAST(ts AS DATE) - CASE WHEN hour(ts) < 6 THEN 1 ELSE 0 END",
    "late_back": "CAST(ts AS DATE) - CASE WHEN hour(ts) >= 22 THEN 1 ELSE 0 END",
    "minus22h": "CAST(ts - INTERVAL 22 HOUR AS DATE)",
}
for _i, (_family, _sql) in enumerate(FAMILIES.items(), 1):

    @query(f"op_date_f{_i}", sql(f"SELECT event_id, {_sql} AS op_day FROM pings"))
    def _op_date(spark, sf_dir, family=_family):
        return pings(spark, sf_dir).select("event_id", keys.op_date(F.col("ts"), family).alias("op_day"))


@query("shift_abc", sql("SELECT event_id, shift FROM pings"))
def shift_abc(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", keys.shift_label(F.col("ts")).alias("shift"))


@query("shift_daynight", sql("""SELECT event_id, CASE WHEN hour(ts) >= 6 AND hour(ts) < 18 THEN 'Day' ELSE 'Night' END AS d06, CASE WHEN hour(ts) >= 8 AND hour(ts) < 20 THEN 'Day' ELSE 'Night' END AS d08,
CASE WHEN hour(ts) >= 10 AND hour(ts) < 22 THEN 'Day' ELSE 'Night' END AS d10, CASE WHEN hour(ts) >= 6 AND hour(ts) < 14 THEN 'B' WHEN hour(ts) >= 14 AND hour(ts) < 22 THEN 'A' ELSE 'C' END AS swapped FROM pings"""))
def shift_daynight(spark, sf_dir):
    names = {"d06": "day_night_06", "d08": "day_night_08", "d10": "day_night_10", "swapped": "swapped"}
    return pings(spark, sf_dir).select("event_id", *(keys.shift_label(F.col("ts"), s).alias(n) for n, s in names.items()))


GAP = "epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {} ORDER BY ts, event_id))"


@query("gap_variants", sql(f"""SELECT event_id, round(least(coalesce(({GAP.format('vehicle')}) / 1e6, 0), 86400), 6) AS per_vehicle, round(least(coalesce(({GAP.format('vehicle, date, shift')}) / 1e6, 0), 86400), 6) AS per_shift,
round(least(coalesce(({GAP.format('vehicle')}) / 1e6, 30), 300), 6) AS first_30, round(least(coalesce((epoch_us(lead(ts) OVER (PARTITION BY vehicle ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6, 10), 300), 6) AS ahead FROM pings"""))
def gap_variants(spark, sf_dir):
    g = keys.gap_seconds
    return keyed(pings(spark, sf_dir)).select(
        "event_id", R(g(["vehicle"], tiebreak="event_id", cap=86400), 6).alias("per_vehicle"), R(g(["vehicle", "date", "shift"], tiebreak="event_id", cap=86400), 6).alias("per_shift"),
        R(g(["vehicle"], tiebreak="event_id", first=30), 6).alias("first_30"), R(g(["vehicle"], tiebreak="event_id", first=10, ahead=True), 6).alias("ahead"),
    )


@query("calendar", "SELECT event_id, isodow(ts)::INT - 1 AS dow, week(ts)::INT AS iso_week, day(ts)::INT AS day, month(ts)::INT AS month, (isodow(ts) >= 6)::INT AS is_weekend, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INT AS days_since FROM events")
def calendar(spark, sf_dir):
    d = F.to_date("ts")
    return pings(spark, sf_dir).select("event_id", *(c.cast("int").alias(n) for n, c in scalars.calendar(d).items()), F.datediff(d, F.lit("2024-01-01").cast("date")).alias("days_since"))


@query("clip_winsor", sql("SELECT event_id, CASE WHEN altitude IS NOT NULL THEN least(greatest(altitude, 10), 60) END AS clipped, CASE WHEN analog IS NOT NULL THEN least(analog, speed / 20) END AS by_column FROM pings"))
def clip_winsor(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", scalars.clip(F.col("altitude"), 10.0, 60.0).alias("clipped"), scalars.clip(F.col("analog"), None, F.col("speed") / 20).alias("by_column"))


@query("clip_after_filter", sql("""SELECT 'filter_first' AS way, count(*) AS n, round(avg(CASE WHEN speed <= 80 THEN least(speed, 60) END), 6) AS mean FROM pings WHERE speed <= 80
UNION ALL SELECT 'clip_first', count(*), round(avg(least(speed, 60)), 6) FROM pings WHERE least(speed, 60) <= 80"""))
def clip_after_filter(spark, sf_dir):
    p = pings(spark, sf_dir)
    clipped = scalars.clip(F.col("speed"), 0.0, 60.0)
    a = p.where("speed <= 80").select(F.lit("filter_first").alias("way"), clipped.alias("v"))
    b = p.select(F.lit("clip_first").alias("way"), clipped.alias("v")).where("v <= 80")
    return a.unionAll(b).groupBy("way").agg(F.count("*").alias("n"), R(F.avg("v"), 6).alias("mean"))


@query("eps_ratio", sql("SELECT vehicle, round(sum(dist) / (sum(speed) + 1e-6), 6) AS km_per_speed, round(sum(ignition) / (count(*) + 1.0), 6) AS ignition_share, round(stddev(speed) / (avg(speed) + 0.001), 6) AS speed_cv FROM pings GROUP BY vehicle"))
def eps_ratio(spark, sf_dir):
    return pings(spark, sf_dir).groupBy("vehicle").agg(
        R(scalars.ratio(F.sum("dist"), F.sum("speed")), 6).alias("km_per_speed"), R(scalars.ratio(F.sum("ignition"), F.count("*"), 1.0), 6).alias("ignition_share"), R(scalars.ratio(F.stddev("speed"), F.avg("speed"), 0.001), 6).alias("speed_cv")
    )


@query("interactions", sql("SELECT vehicle, date, shift, round(sum(dist) * sum(ignition), 6) AS work, round(avg(speed) * count(*), 6) AS speed_n, round(sum(dist) / (count(*) + 1.0) * max(k), 6) AS intensity FROM pings GROUP BY ALL"))
def interactions(spark, sf_dir):
    return keyed(pings(spark, sf_dir)).groupBy("vehicle", "date", "shift").agg(
        R(F.sum("dist") * F.sum("ignition"), 6).alias("work"), R(F.avg("speed") * F.count("*"), 6).alias("speed_n"), R(F.sum("dist") / (F.count("*") + 1.0) * F.max("k"), 6).alias("intensity")
    )


@query("vector_mag", sql("SELECT event_id, round(sqrt(x * x + y * y + speed * speed), 6) AS magnitude FROM pings"))
def vector_mag(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", R(scalars.magnitude(F.col("x"), F.col("y"), F.col("speed")), 6).alias("magnitude"))


@query("local_plane", sql("""SELECT event_id, round(lon * 111320.0 * cos(radians(lat0)), 3) AS east, round(lat * 110540.0, 6) AS north
FROM (SELECT event_id, 23 + x / 10000 AS lat, 86 + y / 10000 AS lon, avg(23 + x / 10000) OVER () AS lat0 FROM pings)"""))
def local_plane(spark, sf_dir):
    from fleetspark.operators.aggregates import with_scalars

    p = pings(spark, sf_dir).select("event_id", (23 + F.col("x") / 10000).alias("lat"), (86 + F.col("y") / 10000).alias("lon"))
    east, north = scalars.local_plane(F.col("lat"), F.col("lon"), F.col("lat0"))
    return with_scalars(p, lat0=F.avg("lat")).select("event_id", R(east, 3).alias("east"), R(north, 6).alias("north"))


@query("grid_cell", sql("SELECT (floor(x / 50) * 1000000 + floor(y / 50))::BIGINT AS cell, count(*) AS n FROM pings GROUP BY 1"))
def grid_cell(spark, sf_dir):
    return pings(spark, sf_dir).groupBy(scalars.grid_cell(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("n"))


@query("kinematics", sql("""SELECT event_id, round(CASE WHEN dt > 0 THEN dv / 3.6 / dt ELSE 0 END, 9) AS accel, (CASE WHEN dt > 0 THEN dv / 3.6 / dt ELSE 0 END < -0.001)::INT AS braking FROM
(SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt, speed - lag(speed) OVER w AS dv FROM pings WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id))"""))
def kinematics(spark, sf_dir):
    from fleetspark.operators.sequence import ordered

    w = ordered(["vehicle"], ["ts", "event_id"])
    dt = keys.seconds_between(F.lag("ts").over(w), F.col("ts"))
    a = scalars.acceleration(F.col("speed"), F.lag("speed").over(w), dt)
    return pings(spark, sf_dir).select("event_id", a.alias("a")).select("event_id", R("a", 9).alias("accel"), (F.col("a") < -0.001).cast("int").alias("braking"))


@query("climb_descent", sql("""SELECT vehicle, sum(greatest(d, 0))::BIGINT AS climb, sum(greatest(-d, 0))::BIGINT AS descent FROM (SELECT vehicle, k - lag(k) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS d FROM pings) WHERE d IS NOT NULL GROUP BY vehicle"""))
def climb_descent(spark, sf_dir):
    from fleetspark.operators.sequence import change, ordered

    d = pings(spark, sf_dir).select("vehicle", change(F.col("k"), ordered(["vehicle"], ["ts", "event_id"])).alias("d"))
    return d.where("d is not null").groupBy("vehicle").agg(F.sum(scalars.clip(F.col("d"), low=0)).alias("climb"), F.sum(scalars.clip(-F.col("d"), low=0)).alias("descent"))


@query("bin_right_closed", sql("SELECT CASE WHEN k > 0 AND k <= 20 THEN 0 WHEN k > 20 AND k <= 50 THEN 1 WHEN k > 50 AND k <= 99 THEN 2 END AS bin, count(*) AS n FROM pings GROUP BY 1"))
def bin_right_closed(spark, sf_dir):
    return pings(spark, sf_dir).groupBy(scalars.binned(F.col("k"), [0, 20, 50, 99]).alias("bin")).agg(F.count("*").alias("n"))


@query("bin_left_closed", sql("SELECT CASE WHEN k >= 0 AND k < 20 THEN 'low' WHEN k >= 20 AND k < 50 THEN 'mid' WHEN k >= 50 AND k < 99 THEN 'high' END AS bin, count(*) AS n FROM pings GROUP BY 1"))
def bin_left_closed(spark, sf_dir):
    return pings(spark, sf_dir).groupBy(scalars.binned(F.col("k"), [0, 20, 50, 99], False, ["low", "mid", "high"]).alias("bin")).agg(F.count("*").alias("n"))


@query("label_encode", "SELECT event_id, CASE WHEN event_type = 'view' THEN -1 ELSE (SELECT count(DISTINCT e2.event_type) FROM events e2 WHERE e2.event_type < e.event_type AND e2.event_type <> 'view')::INT END AS code FROM events e")
def label_encode(spark, sf_dir):
    from pyspark.sql import Window

    p = pings(spark, sf_dir)
    known = p.where("event_type <> 'view'").select("event_type").distinct()
    vocabulary = known.withColumn("code", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    return p.join(vocabulary, "event_type", "left").select("event_id", F.coalesce("code", F.lit(-1)).alias("code"))


@query("string_keys", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS slug, upper(c_mktsegment) AS segment, concat_ws('|', c_mktsegment, c_nationkey) AS pair, starts_with(c_mktsegment, 'BU') AS bu FROM customer")
def string_keys(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", scalars.slug(F.col("c_name")).alias("slug"), F.upper("c_mktsegment").alias("segment"), F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("pair"), F.startswith("c_mktsegment", F.lit("BU")).alias("bu"))


@query("fill_hierarchy", sql("SELECT event_id, coalesce(altitude, analog, 0) AS filled FROM pings"))
def fill_hierarchy(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", F.coalesce("altitude", "analog", F.lit(0.0)).alias("filled"))


@query("dpr_date", sql("SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN CAST(ts AS DATE) END, CAST(ts + INTERVAL 2 HOUR AS DATE)) AS day FROM pings"))
def dpr_date(spark, sf_dir):
    given = F.when(F.col("k") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
    return pings(spark, sf_dir).select("event_id", F.coalesce(given.try_cast("date"), keys.op_date(F.col("ts"), "plus2h")).alias("day"))


@query("receive_delay", sql("SELECT vehicle, round(avg(least(greatest(k * 60.0, 0), 3600)), 6) AS delay FROM pings GROUP BY vehicle"))
def receive_delay(spark, sf_dir):
    p = pings(spark, sf_dir).withColumn("received_ts", F.col("ts") + F.make_dt_interval(mins=F.col("k")))
    delay = scalars.clip(keys.seconds_between(F.col("ts"), F.col("received_ts")), 0.0, 3600.0)
    return p.groupBy("vehicle").agg(R(F.avg(delay), 6).alias("delay"))


@query("one_hot", sql("SELECT event_id, (event_type = 'click')::INT AS is_click, (event_type = 'purchase')::INT AS is_purchase, (event_type NOT IN ('click', 'purchase'))::INT AS is_other, (altitude IS NULL)::INT AS altitude_missing FROM pings"))
def one_hot(spark, sf_dir):
    level = F.col("event_type")
    return pings(spark, sf_dir).select("event_id", *((level == v).cast("int").alias(f"is_{v}") for v in ("click", "purchase")), (~level.isin("click", "purchase")).cast("int").alias("is_other"), F.col("altitude").isNull().cast("int").alias("altitude_missing"))


@query("quality_filter", sql("SELECT event_id, altitude, speed FROM pings WHERE (altitude IS NULL OR altitude <= 60) AND (analog IS NULL OR analog >= 0.5) AND speed <= 80"))
def quality_filter(spark, sf_dir):
    p = pings(spark, sf_dir)
    return p.where((F.col("altitude").isNull() | (F.col("altitude") <= 60)) & (F.col("analog").isNull() | (F.col("analog") >= 0.5)) & (F.col("speed") <= 80)).select("event_id", "altitude", "speed")


@query("date_windows", sql("SELECT count(*) AS n, min(event_id) AS a, max(event_id) AS b FROM pings WHERE day(ts) BETWEEN 1 AND 7 OR day(ts) BETWEEN 20 AND 25"))
def date_windows(spark, sf_dir):
    d = F.dayofmonth("ts")
    return pings(spark, sf_dir).where(d.between(1, 7) | d.between(20, 25)).agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))


@query("label_gate", sql("SELECT round(avg((used BETWEEN 10 AND 2000)::INT), 6) AS valid_share, count(*) FILTER (WHERE used > 0) AS positive FROM totals"))
def label_gate(spark, sf_dir):
    return shift_totals(spark, sf_dir).agg(R(F.avg(F.col("used").between(10, 2000).cast("int")), 6).alias("valid_share"), F.count_if(F.col("used") > 0).alias("positive"))


@query("having_counts", sql("SELECT vehicle, shift, count(*) AS n FROM pings GROUP BY ALL HAVING count(*) >= 5"))
def having_counts(spark, sf_dir):
    return keyed(pings(spark, sf_dir)).groupBy("vehicle", "shift").agg(F.count("*").alias("n")).where("n >= 5")


@query("missing_telemetry", sql("SELECT event_id, ((altitude IS NULL AND analog IS NULL) OR (coalesce(altitude, 0) = 0 AND coalesce(analog, 0) = 0)) AS all_missing, (altitude IS NULL OR analog IS NULL) AS any_missing FROM pings"))
def missing_telemetry(spark, sf_dir):
    c = ["altitude", "analog"]
    return pings(spark, sf_dir).select("event_id", stats.missing_row(c).alias("all_missing"), stats.missing_row(c, True).alias("any_missing"))


#: Numeric columns of lineitem by DuckDB's own types, those that vary by their values.
FEATURE_SQL = "WITH numeric_columns AS (SELECT column_name AS feature FROM (DESCRIBE lineitem) WHERE column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE')), varying AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM lineitem HAVING count(DISTINCT {c}) > 1" for c in ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_shipdate").split()) + ") SELECT feature FROM numeric_columns JOIN varying USING (feature) WHERE feature NOT LIKE '%tax%'"


@query("feature_list", FEATURE_SQL)
def feature_list(spark, sf_dir):
    """Numeric columns of lineitem that vary and don't name a forbidden thing: decided from the schema and one pass."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = stats.varying(df, stats.safe_features(df, ["tax"]))
    return df.limit(1).select(F.explode(F.array(*map(F.lit, names))).alias("feature"))


@query("timezones", sql("SELECT event_id, ts + INTERVAL 330 MINUTE AS ist FROM pings"))
def timezones(spark, sf_dir):
    return pings(spark, sf_dir).select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("ts")).alias("ist"))


@query("lenient_numbers", sql("SELECT event_id, CASE WHEN k % 5 <> 0 THEN k::DOUBLE END AS number FROM pings"))
def lenient_numbers(spark, sf_dir):
    text = F.when(F.col("k") % 5 == 0, F.lit("n/a")).otherwise(F.col("k").cast("string"))
    return pings(spark, sf_dir).select("event_id", text.try_cast("double").alias("number"))


@query("constant_probe", sql("SELECT DISTINCT vehicle, 173.4::DOUBLE AS predicted FROM pings"))
def constant_probe(spark, sf_dir):
    return pings(spark, sf_dir).select("vehicle").distinct().withColumn("predicted", F.lit(173.4))


@query("prefix_filter", sql("SELECT event_type, mine, count(*) AS n FROM pings WHERE starts_with(event_type, 'p') OR starts_with(event_type, 'c') GROUP BY ALL"))
def prefix_filter(spark, sf_dir):
    """Rows of the kinds whose names begin with one of the prefixes."""
    p = pings(spark, sf_dir).where(keys.has_prefix(F.col("event_type"), ["p", "c"]))
    return p.groupBy("event_type", "mine").agg(F.count("*").alias("n"))


NARROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("narrow_types", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS narrow, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest FROM lineitem" for c in NARROW))
def narrow_types(spark, sf_dir):
    """The narrowest types of the whole numbers of lineitem, from one pass."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return narrow.narrowest(df, NARROW).select("column", "narrow", "least", "greatest")


PROBED = ["events", "supplier", "orders"]


@query("file_probe", " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t})::BIGINT AS rows, {n} AS missing" for t, n in zip(PROBED, ("0", *["(SELECT count(*) FROM (DESCRIBE events))::INT"] * 2))))
def file_probe(spark, sf_dir):
    """Rows of tables by their files' footers, and how many of the columns of events each lacks."""
    paths = [p for t in PROBED for p in discover(spark, f"{sf_dir}/{t}.parquet")]
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    report = probe.probe(spark, paths, schema).withColumn("name", F.regexp_extract("path", r"/(\w+)\.parquet", 1))
    return report.groupBy("name").agg(F.sum("rows").alias("rows"), F.max(F.size("missing")).alias("missing"))


@query("incremental_build", sql("SELECT vehicle, round(sum(dist), 4) AS dist, count(*) AS n, min(ts) AS first, max(ts) AS last FROM pings WHERE vehicle IS NOT NULL GROUP BY vehicle"))
def incremental_build(spark, sf_dir):
    """Totals of vehicles from a build over the files of events, batch by batch, whose parts are merged."""
    at = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    parts = lambda df: df.where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("vehicle")).agg(F.sum("value").alias("dist"), F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    incremental.build(spark, f"{sf_dir}/events.parquet", schema, f"{at}/parts", f"{at}/checkpoint", parts).awaitTermination()
    return incremental.merged(spark, f"{at}/parts", ["vehicle"], ["dist", "n"], ["first"], ["last"]).select("vehicle", R("dist", 4).alias("dist"), "n", "first", "last")
