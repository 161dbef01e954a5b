"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions import keys
from fleetspark.operators import joins
from fleetspark.sources.pings import keyed, pings, refuels, shift_totals, sql

from .registry import query

R = F.round


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("left_join_fill", sql("SELECT c_custkey, coalesce(count(o_orderkey), 0) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"))
def left_join_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), R(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("inner_hit_rate", sql("SELECT count(*) AS n, count(h) AS hits, count(h) / count(*)::DOUBLE AS rate FROM pings LEFT JOIN (SELECT DISTINCT vehicle, date, 1 AS h FROM pings WHERE at_load) USING (vehicle, date)"))
def inner_hit_rate(spark, sf_dir):
    p = keyed(pings(spark, sf_dir))
    return joins.hit_rate(p, p.where("at_load"), ["vehicle", "date"])


@query("safe_join", "SELECT s_suppkey, s_name, s_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def safe_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    out = joins.safe_join(s, table(spark, sf_dir, "nation").withColumn("s_name", F.lit("x")), ["n_nationkey"])
    return out.select("s_suppkey", "s_name", F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")


@query("suffix_join", sql("SELECT vehicle, a.n AS n_a, b.n AS n_b, round(0.4::DOUBLE * a.n + 0.6::DOUBLE * b.n, 6) AS blend FROM (SELECT vehicle, count(*) AS n FROM pings WHERE shift = 'A' GROUP BY 1) a JOIN (SELECT vehicle, count(*) AS n FROM pings WHERE shift = 'B' GROUP BY 1) b USING (vehicle)"))
def suffix_join(spark, sf_dir):
    p = keyed(pings(spark, sf_dir))
    a, b = (p.where(F.col("shift") == s).groupBy("vehicle").agg(F.count("*").alias("n")) for s in "AB")
    return joins.suffix_join(a, b, ["vehicle"]).withColumn("blend", R(0.4 * F.col("n_a") + 0.6 * F.col("n_b"), 6))


@query("key_mapping", "SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def key_mapping(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return joins.mapped(c, "n_nationkey", table(spark, sf_dir, "nation").where("n_regionkey < 3"), "n_name", "unknown").select("c_custkey", "n_name")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


ASOF = """SELECT event_id, refuel_ts AS last_refuel_ts, litres AS last_litres, round((epoch_us(ts) - epoch_us(refuel_ts)) / 3.6e9, 6) AS hours FROM pings p LEFT JOIN LATERAL
(SELECT refuel_ts, litres FROM refuels r WHERE r.vehicle = p.vehicle AND r.refuel_ts {} p.ts ORDER BY refuel_ts DESC, refuel_id DESC LIMIT 1) ON TRUE"""


def _asof(spark, sf_dir, exact):
    p = pings(spark, sf_dir).select("event_id", "vehicle", "ts")
    out = joins.asof_join(p, refuels(spark, sf_dir), ["vehicle"], "ts", "refuel_ts", ["litres"], exact, ["refuel_id"])
    return out.select("event_id", "last_refuel_ts", "last_litres", R(keys.seconds_between(F.col("last_refuel_ts"), F.col("ts")) / 3600, 6).alias("hours"))


@query("asof_strict", sql(ASOF.format("<")))
def asof_strict(spark, sf_dir):
    return _asof(spark, sf_dir, False)


@query("asof_inclusive", sql(ASOF.format("<=")))
def asof_inclusive(spark, sf_dir):
    return _asof(spark, sf_dir, True)


@query("trailing_24h", sql("""SELECT event_id, round(coalesce(sum(litres), 0), 6) AS trailing_sum, count(litres) AS trailing_count FROM pings p LEFT JOIN refuels r
ON r.vehicle = p.vehicle AND r.refuel_ts >= p.ts - INTERVAL 24 HOUR AND r.refuel_ts < p.ts GROUP BY event_id"""))
def trailing_24h(spark, sf_dir):
    p = pings(spark, sf_dir).select("event_id", "vehicle", "ts")
    return joins.trailing(p, refuels(spark, sf_dir), ["vehicle"], "ts", "refuel_ts", "litres").select("event_id", R("trailing_sum", 6).alias("trailing_sum"), "trailing_count")


EDGES = """, e AS (SELECT *, analog > 2.5 AND NOT coalesce(lag(coalesce(analog > 2.5, FALSE)) OVER w, FALSE) AS edge FROM pings WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)),
d AS (SELECT vehicle, ts AS a, lead(ts) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS cycle FROM e WHERE edge)
"""


def edged(spark, sf_dir):
    from fleetspark.operators.sequence import ordered, rising_edge

    w = ordered(["vehicle"], ["ts", "event_id"])
    return pings(spark, sf_dir).withColumn("edge", rising_edge(F.col("analog") > 2.5, w))


@query("range_join_cycles", sql(EDGES + "SELECT d.vehicle, d.cycle, count(*) AS n, round(sum(dist), 6) AS km, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM d JOIN e ON e.vehicle = d.vehicle AND e.ts >= d.a AND e.ts <= d.b GROUP BY ALL"))
def range_join_cycles(spark, sf_dir):
    rows = joins.cycles(edged(spark, sf_dir), "edge", ["vehicle"], ["ts", "event_id"])
    return rows.groupBy("vehicle", "cycle").agg(F.count("*").alias("n"), R(F.sum("dist"), 6).alias("km"), R(keys.seconds_between(F.min("ts"), F.max("ts")), 6).alias("seconds"))


@query("position_slice", sql(""", p AS (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS pos FROM pings), q AS (SELECT vehicle, pos AS a, pos + 3 AS b FROM p WHERE k % 10 = 3)
SELECT q.vehicle, q.a, q.b, round(sum(p.dist), 6) AS total FROM q JOIN p ON p.vehicle = q.vehicle AND p.pos BETWEEN q.a AND q.b WHERE q.b <= (SELECT max(pos) FROM p p2 WHERE p2.vehicle = q.vehicle) GROUP BY ALL"""))
def position_slice(spark, sf_dir):
    from fleetspark.operators.sequence import ordered

    p = pings(spark, sf_dir).withColumn("pos", F.row_number().over(ordered(["vehicle"], ["ts", "event_id"])))
    q = p.where("k % 10 = 3").select("vehicle", F.col("pos").alias("a"), (F.col("pos") + 3).alias("b"))
    return joins.slices(p, q, ["vehicle"], "pos", "a", "b", "dist").select("vehicle", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), R("total", 6).alias("total"))


@query("load_dump_pairs", sql("""SELECT vehicle, count(*) AS n, round(median(m), 6) AS median_minutes FROM (SELECT vehicle, at_dump, (epoch_us(ts) - epoch_us(max(CASE WHEN at_load THEN ts END) OVER (PARTITION BY vehicle ORDER BY ts, event_id))) / 6e7 AS m FROM pings)
WHERE at_dump AND m >= 0 AND m <= 3000 GROUP BY vehicle"""))
def load_dump_pairs(spark, sf_dir):
    d = joins.load_dump_pairs(pings(spark, sf_dir), "at_load", "at_dump", ["vehicle"], ["ts", "event_id"], "ts", 3000)
    return d.groupBy("vehicle").agg(F.count("*").alias("n"), R(F.percentile("minutes", F.lit(0.5)), 6).alias("median_minutes"))


@query("request_fill", sql(""", q AS (SELECT row_number() OVER (ORDER BY vehicle, date, shift) AS id, * FROM (SELECT DISTINCT vehicle, date, shift FROM pings UNION SELECT DISTINCT vehicle, date + 400, shift FROM pings))
SELECT q.id, round(coalesce(t.used, h.m, (SELECT avg(used) FROM totals)), 6) AS predicted FROM q LEFT JOIN totals t USING (vehicle, date, shift) LEFT JOIN (SELECT vehicle, shift, avg(used) AS m FROM totals WHERE n > 1 GROUP BY ALL) h USING (vehicle, shift)"""))
def request_fill(spark, sf_dir):
    """A prediction for every request, those without telemetry by vehicle and shift, then by the mean of all."""
    from pyspark.sql import Window

    t = shift_totals(spark, sf_dir)
    key = ["vehicle", "date", "shift"]
    q = t.select(*key).union(t.select("vehicle", F.date_add("date", 400).alias("date"), "shift")).distinct()
    # Ids run within a vehicle, from where those of lesser vehicles end.
    sizes = q.groupBy("vehicle").agg(F.count("*").alias("n"))
    base = sizes.select("vehicle", (F.sum("n").over(Window.orderBy("vehicle")) - F.col("n")).alias("base"))
    q = q.withColumn("r", F.row_number().over(Window.partitionBy("vehicle").orderBy("date", "shift"))).join(base, "vehicle").withColumn("id", F.col("base") + F.col("r"))
    h = t.where("n > 1").groupBy("vehicle", "shift").agg(F.avg("used").alias("m"))
    out = q.join(t, key, "left").join(h, ["vehicle", "shift"], "left").withColumn("g", t.agg(F.avg("used")).scalar())
    return out.select("id", R(F.coalesce("used", "m", "g"), 6).alias("predicted"))


@query("candidate_search", sql("""SELECT candidate, sum(n)::BIGINT AS n, sum(CASE WHEN h IS NOT NULL THEN n ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN h IS NOT NULL THEN n ELSE 0 END) / sum(n)::DOUBLE AS rate FROM
(SELECT candidate, vehicle, date, shift, count(*) AS n FROM (SELECT 'carry_back' AS candidate, vehicle, date, shift FROM pings UNION ALL SELECT 'plus2h', vehicle, CAST(ts + INTERVAL 2 HOUR AS DATE), shift FROM pings UNION ALL SELECT 'minus22h', vehicle, CAST(ts - INTERVAL 22 HOUR AS DATE), shift FROM pings) GROUP BY ALL)
LEFT JOIN (SELECT vehicle, date, shift, 1 AS h FROM totals WHERE n > 1) USING (vehicle, date, shift) GROUP BY candidate"""))
def candidate_search(spark, sf_dir):
    ts, shift = F.col("ts"), keys.shift_label(F.col("ts"))
    ways = {f: [F.col("vehicle"), keys.op_date(ts, f), shift] for f in ("carry_back", "plus2h", "minus22h")}
    return joins.best_candidate(pings(spark, sf_dir), ways, ["vehicle", "date", "shift"], shift_totals(spark, sf_dir).where("n > 1"))


DAYS = ", days AS (SELECT vehicle, date, sum(dist) AS used FROM pings GROUP BY ALL)"


@query("ewma_last5", sql(DAYS + """ SELECT a.vehicle, a.date, count(b.used) AS history_n, round(avg(b.used), 6) AS history_mean, round(sum(pow(0.75, r) * b.used) FILTER (WHERE r < 5) / sum(pow(0.75, r)) FILTER (WHERE r < 5), 6) AS history_ewma FROM days a LEFT JOIN LATERAL
(SELECT used, row_number() OVER (ORDER BY date DESC) - 1 AS r FROM days d WHERE d.vehicle = a.vehicle AND d.date < a.date) b ON TRUE GROUP BY ALL"""))
def ewma_last5(spark, sf_dir):
    days = keyed(pings(spark, sf_dir)).groupBy("vehicle", "date").agg(F.sum("dist").alias("used"))
    h = joins.history_before(days, ["vehicle"], "date", "used")
    return h.select("vehicle", "date", "history_n", R("history_mean", 6).alias("history_mean"), R("history_ewma", 6).alias("history_ewma"))


@query("union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def union_all(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")), allowMissingColumns=True)


@query("distinct_keys", sql("SELECT DISTINCT vehicle, date FROM pings WHERE at_load UNION SELECT DISTINCT vehicle, date FROM pings WHERE at_dump"))
def distinct_keys(spark, sf_dir):
    p = keyed(pings(spark, sf_dir))
    return p.where("at_load").select("vehicle", "date").union(p.where("at_dump").select("vehicle", "date")).distinct()


@query("union_then_split", sql("SELECT event_id, dense_rank() OVER (ORDER BY speed)::BIGINT AS joint_rank FROM pings QUALIFY vehicle % 2 = 0"))
def union_then_split(spark, sf_dir):
    """A joint ranking of two frames, given back for one of them. Ranks come from counts of distinct values, so that no
    task sorts all rows."""
    from pyspark.sql import Window

    p = pings(spark, sf_dir)
    both = p.where("mine = 0").withColumn("src", F.lit("test")).unionByName(p.where("mine = 1").withColumn("src", F.lit("train")))
    values = both.select("speed").distinct().withColumn("part", F.floor(F.col("speed")))
    before = values.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("speed"))).join(before, "part")
    return both.where("src = 'test'").join(ranked.select("speed", (F.col("r") + F.col("base")).cast("long").alias("joint_rank")), "speed").select("event_id", "joint_rank")
