"""Joins that the engine lacks, as compositions of unions, windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that takes from the right only what the left hasn't got."""
    new = [c for c in right.columns if c in on or c not in left.columns]
    return left.join(right.select(*new), on, how)


def suffix_join(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_a", "_b"), how: str = "inner") -> DataFrame:
    """A join whose common columns get suffixes."""
    both = [c for c in a.columns if c in b.columns and c not in on]
    return a.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(b.withColumnsRenamed({c: c + suffixes[1] for c in both}), on, how)


def mapped(df: DataFrame, key: str, mapping: DataFrame, value: str, default=None) -> DataFrame:
    """Looks ``value`` up by ``key`` in a table with one row a key; ``default`` where it has none."""
    out = df.join(mapping.select(key, value), key, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def hit_rate(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the left, those with a partner, and their share."""
    keys = right.select(*on).distinct().withColumn("__hit", F.lit(1))
    return left.join(keys, on, "left").agg(F.count("*").alias("n"), F.count("__hit").alias("hits")).withColumn("rate", F.col("hits") / F.col("n"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, take: list[str], allow_exact: bool = False, order: list[str] = (), prefix: str = "last_") -> DataFrame:
    """For each left row the last right row of its entity before it (or at its time); null if there is none.

    Both sides are one stream in time; the last right row is carried forward. One shuffle by entity and one sort; right
    rows of one time are told apart by ``order``, the last of them counting.
    """
    side = 1 if allow_exact else -1
    keys = [F.col(c) for c in by]
    kept = [F.col(c) for c in left.columns]
    payload = F.struct(*(F.col(c) for c in [right_ts, *take]))
    tie = F.struct(*(F.col(c) for c in order)) if order else F.struct(F.lit(0))
    l = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast(right.select(tie.alias("o")).schema["o"].dataType).alias("__o"), F.struct(*kept).alias("__l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__r"))
    r = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(-side).alias("__s"), tie.alias("__o"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), payload.alias("__r"))
    w = Window.partitionBy(*by).orderBy("__t", "__s", "__o").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__l is not null")
    return out.select("__l.*", *(F.col(f"__r.{c}").alias(prefix + c) for c in [right_ts, *take]))


def trailing(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, value: str, seconds: int = 86400, prefix: str = "trailing_") -> DataFrame:
    """Sum and count of right values in [t - seconds, t) for each left row, by a range frame over both sides."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l = left.select(*by, micros(left_ts).alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(None).cast("double").alias("__v"))
    r = right.select(*by, micros(right_ts).alias("__t"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.col(value).cast("double").alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t").rangeBetween(-seconds * 1_000_000, -1)
    out = l.unionByName(r).withColumn(prefix + "sum", F.coalesce(F.sum("__v").over(w), F.lit(0.0))).withColumn(prefix + "count", F.count("__v").over(w))
    return out.where("__l is not null").select("__l.*", prefix + "sum", prefix + "count")


def cycles(df: DataFrame, edge: str, by: list[str], order: list[str]) -> DataFrame:
    """Assigns rows to the cycles between edges, both ends inclusive: an edge's row closes one cycle and opens the next.

    Rows before the first edge and after the last one have no cycle. Adds ``cycle``, from 1.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.sum(F.col(edge).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    all_edges = F.sum(F.col(edge).cast("int")).over(Window.partitionBy(*by))
    d = df.withColumn("__n", n).withColumn("__all", all_edges)
    d = d.withColumn("cycle", F.explode(F.when(F.col(edge), F.array(F.col("__n") - 1, F.col("__n"))).otherwise(F.array("__n"))))
    return d.where((F.col("cycle") >= 1) & (F.col("cycle") < F.col("__all"))).drop("__n", "__all")


def slices(df: DataFrame, ranges: DataFrame, by: list[str], position: str, start: str, end: str, value: str) -> DataFrame:
    """Sum of ``value`` over positions [start, end] of the entity for each range, by the difference of running sums."""
    w = Window.partitionBy(*by).orderBy(position)
    sums = df.select(*by, position, F.col(value).alias("__v"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__c"))
    first = sums.select(*by, F.col(position).alias(start), F.col("__c").alias("__c0"), F.col("__v").alias("__v0"))
    last = sums.select(*by, F.col(position).alias(end), F.col("__c").alias("__c1"))
    out = ranges.join(first, [*by, start]).join(last, [*by, end])
    return out.withColumn("total", F.col("__c1") - F.col("__c0") + F.col("__v0")).drop("__c0", "__c1", "__v0")


def load_dump_pairs(df: DataFrame, load: str, dump: str, by: list[str], order: list[str], ts: str, most_minutes: float = 300.0) -> DataFrame:
    """Each dump row with the last load at or before it, up to ``most_minutes`` back: minutes between. A load may serve many."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("load_ts", F.last(F.when(F.col(load), F.col(ts)), ignorenulls=True).over(w)).where(F.col(dump))
    d = d.withColumn("minutes", F.timestamp_diff("MICROSECOND", F.col("load_ts"), F.col(ts)) / 6e7)
    return d.where((F.col("minutes") >= 0) & (F.col("minutes") <= most_minutes))


def history_before(df: DataFrame, by: list[str], at: str, value: str, last: int = 5, alpha: float = 0.75) -> DataFrame:
    """For each row, of its entity's earlier rows (strictly before ``at``): count, mean, and the mean of the last few with
    weights that fall to ``alpha`` with each step back. One row an entity and time is expected."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    few = F.collect_list(F.col(value).cast("double")).over(Window.partitionBy(*by).orderBy(at).rowsBetween(-last, -1))
    d = df.withColumn("history_n", F.count(value).over(w)).withColumn("history_mean", F.avg(value).over(w)).withColumn("__few", few)
    weight = lambda i: F.pow(F.lit(alpha), F.size("__few") - 1 - i)
    top = F.aggregate(F.transform("__few", lambda v, i: v * weight(i)), F.lit(0.0), lambda a, v: a + v)
    bottom = F.aggregate(F.transform("__few", lambda v, i: weight(i)), F.lit(0.0), lambda a, v: a + v)
    return d.withColumn("history_ewma", F.when(F.size("__few") > 0, top / bottom)).drop("__few")


def best_candidate(df: DataFrame, candidates: dict[str, list[Column]], keys: list[str], target: DataFrame) -> DataFrame:
    """How often each way of making keys meets the target's keys: one pass over the rows, exploded by candidate."""
    ways = F.array(*(F.struct(F.lit(name).alias("candidate"), *(c.alias(k) for c, k in zip(cols, keys))) for name, cols in candidates.items()))
    rows = df.select(F.explode(ways).alias("w")).select("w.*").groupBy("candidate", *keys).agg(F.count("*").alias("n"))
    known = target.select(*keys).distinct().withColumn("__hit", F.lit(1))
    out = rows.join(known, keys, "left").groupBy("candidate").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("__hit") == 1, F.col("n")).otherwise(0)).alias("hits"))
    return out.withColumn("rate", F.col("hits") / F.col("n"))
