"""Adapters that present the event and dimension tables as fleet telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.functions.keys import op_date, shift_label


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an observation: vehicle, time, speed, ignition, signals and a place on a grid."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("event_id", F.col("user_id").alias("vehicle"), "ts", "event_type", "value", k.alias("k"))
    return e.select(
        "event_id", "vehicle", "ts", "event_type", "k",
        (F.col("value") % 90).alias("speed"),
        (F.col("event_type") != "error").cast("int").alias("ignition"),
        F.when(F.col("event_type") != "signup", F.col("k") / 25.0).alias("analog"),
        F.when(F.col("k") % 10 != 0, F.col("k").cast("double")).alias("altitude"),
        F.col("value").alias("dist"),
        (F.col("k") % 10 * 100.0).alias("x"), (F.floor(F.col("k") / 10) * 100.0).alias("y"),
        (F.col("vehicle") % 2).alias("mine"),
        (F.col("k") < 20).alias("at_load"), (F.col("k") >= 80).alias("at_dump"),
    )


def keyed(df: DataFrame, family: str = "carry_back", scheme: str = "abc") -> DataFrame:
    """Adds operational date and shift; the family goes with the rows, as tables of different families mustn't be joined."""
    return df.withColumn("date", op_date(F.col("ts"), family)).withColumn("shift", shift_label(F.col("ts"), scheme))


def refuels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refuelling events: vehicle, time, litres."""
    return pings(spark, sf_dir).where("event_type = 'purchase'").select("vehicle", F.col("ts").alias("refuel_ts"), F.col("dist").alias("litres"), F.col("event_id").alias("refuel_id"))


def shift_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: what each vehicle used in each shift."""
    return keyed(pings(spark, sf_dir)).groupBy("vehicle", "date", "shift").agg(F.sum("dist").alias("used"), F.count("*").alias("n"))


#: The same tables in DuckDB's SQL, as common table expressions.
PINGS_SQL = """
raw AS (SELECT event_id, user_id AS vehicle, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
pings AS (
  SELECT event_id, vehicle, ts, event_type, k, value % 90 AS speed, CAST(event_type <> 'error' AS INTEGER) AS ignition,
    CASE WHEN event_type <> 'signup' THEN k / 25.0::DOUBLE END AS analog, CASE WHEN k % 10 <> 0 THEN k::DOUBLE END AS altitude, value AS dist,
    (k % 10) * 100.0::DOUBLE AS x, floor(k / 10.0::DOUBLE) * 100.0::DOUBLE AS y, vehicle % 2 AS mine, k < 20 AS at_load, k >= 80 AS at_dump,
    CAST(ts AS DATE) - CASE WHEN hour(ts) < 6 THEN 1 ELSE 0 END AS date,
    CASE WHEN hour(ts) >= 6 AND hour(ts) < 14 THEN 'A' WHEN hour(ts) >= 14 AND hour(ts) < 22 THEN 'B' ELSE 'C' END AS shift
  FROM raw),
refuels AS (SELECT vehicle, ts AS refuel_ts, dist AS litres, event_id AS refuel_id FROM pings WHERE event_type = 'purchase'),
totals AS (SELECT vehicle, date, shift, sum(dist) AS used, count(*) AS n FROM pings GROUP BY ALL)
"""


def sql(body: str) -> str:
    """DuckDB SQL over those tables."""
    return f"WITH {PINGS_SQL.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"
