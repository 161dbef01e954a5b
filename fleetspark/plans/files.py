"""Queries of sources and sinks: what is written to the shared folder and read again equals the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetspark.sources import files
from fleetspark.sources.pings import keyed, pings, sql
from fleetspark.storage import shared_dir

from .registry import query

R = F.round


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", sql("SELECT event_type, count(*) AS n, count(altitude) AS altitudes, round(sum(dist), 4) AS dist, min(ts) AS first, max(ts) AS last, count(*) FILTER (WHERE k >= 50) AS odd FROM pings GROUP BY event_type"))
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read with its schema: missing numbers, times to the microsecond, and a column whose texts aren't numbers."""
    p = pings(spark, sf_dir).select("event_id", "ts", "event_type", "altitude", "dist", F.when(F.col("k") >= 50, F.lit("n/a")).otherwise(F.col("k").cast("string")).alias("k"))
    at = _folder(spark, "csv")
    files.write_csv(p, at)
    back = files.read_csv(spark, at, "event_id bigint, ts timestamp_ntz, event_type string, altitude double, dist double, k int")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.count("altitude").alias("altitudes"), R(F.sum("dist"), 4).alias("dist"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("k").isNull()).alias("odd"))


WEEKS = [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-21"), ("2024-01-22", "2024-01-28")]


@query("pruned_files", sql("SELECT date, count(*) AS n, round(sum(dist), 4) AS dist FROM pings WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY date"))
def pruned_files(spark, sf_dir):
    """Files named by the weeks that they hold: those of two weeks are found by name, and no other is read."""
    at = _folder(spark, "weeks")
    p = keyed(pings(spark, sf_dir)).select("date", "dist")
    span = F.lit(None).cast("string")
    for a, b in WEEKS:
        span = F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), f"{a}_{b}").otherwise(span)
    p.withColumn("span", span).where("span IS NOT NULL").write.partitionBy("span").parquet(at)
    folders = sorted({f.rsplit("/", 1)[0] for f in files.discover(spark, at)})
    chosen = files.in_window(folders, "2024-01-08", "2024-01-21")
    return files.read_parquet(spark, chosen, ["date", "dist"]).groupBy("date").agg(F.count("*").alias("n"), R(F.sum("dist"), 4).alias("dist"))


@query("aliased_columns", sql("SELECT vehicle, count(analog) AS n, round(avg(analog) + 1e-9, 5) AS analog, max(speed) AS speed, count(*) AS missing FROM pings GROUP BY vehicle"))
def aliased_columns(spark, sf_dir):
    """A table whose columns have other names: each is found by its aliases, one that isn't there is filled."""
    p = pings(spark, sf_dir).select(F.col("vehicle").alias(" Vehicle ID "), F.col("analog").alias("Analog Input 1"), F.col("speed").alias("GPS-Speed"))
    p = files.tidy_names(p)
    found = {name: files.resolve(p, *aliases) for name, aliases in {"vehicle": ["vehicle", "vehicle_id"], "analog": ["fuel level", "analog_input_1"], "speed": ["speed"], "heading": ["heading", "course"]}.items()}
    p = p.select(*(F.col(f"`{c}`").alias(name) if c else F.lit(None).cast("double").alias(name) for name, c in found.items()))
    return p.groupBy("vehicle").agg(F.count("analog").alias("n"), R(F.avg("analog") + 1e-9, 5).alias("analog"), F.max("speed").alias("speed"), F.count_if(F.col("heading").isNull()).alias("missing"))
