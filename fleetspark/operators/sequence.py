"""Operators over the ordered rows of an entity. Each takes and gives a DataFrame or a Column; order needs a tiebreak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import in_ranges


def ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def rising_edge(flag: Column, w, first_counts: bool = True) -> Column:
    """True where the flag turns true; a null is false. first_counts: whether a first row that is true is an edge."""
    now = F.coalesce(flag, F.lit(False))
    before = F.lag(now, 1).over(w)
    return now & ~F.coalesce(before, F.lit(not first_counts))


def change(x: Column, w) -> Column:
    """x less its previous value; null on the first row."""
    return x - F.lag(x).over(w)


def running(x: Column, w) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def position(w) -> Column:
    """Number of the row from 0."""
    return F.row_number().over(w) - 1


def running_balance(plus: Column, minus: Column, w) -> Column:
    """Running difference of two flags, shown no lower than 0; the balance beneath isn't reset."""
    return F.greatest(running(plus.cast("int") - minus.cast("int"), w), F.lit(0))


def island_id(df: DataFrame, flag: str, by: list[str], order: list[str], out: str = "island") -> DataFrame:
    """Numbers the runs of equal flags of an entity, from 1."""
    w = ordered(by, order)
    turned = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    return df.withColumn(out, F.when(first, 1).otherwise(turned)).withColumn(out, running(F.col(out), w))


def sessions(df: DataFrame, flag: str, by: list[str], order: list[str], ts: str, least_seconds: float = 0.0, aggs: list[Column] = ()) -> DataFrame:
    """The runs with a true flag: start, end, rows, seconds and ``aggs``, from ``least_seconds`` on."""
    runs = island_id(df, flag, by, order).where(F.col(flag))
    out = runs.groupBy(*by, "island").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n"), *aggs)
    out = out.withColumn("seconds", F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / 1e6)
    return out.where(F.col("seconds") >= least_seconds)


def forward_fill(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(x: Column, w) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def load_state(at_load: Column, at_dump: Column, w) -> Column:
    """1 loaded, 0 empty: set on leaving the loading zone, cleared in the dump zone, unknown while loading, then filled
    forward, backward and with 0."""
    left = F.coalesce(F.lag(at_load).over(w), F.lit(False)) & ~at_load
    event = F.when(at_load, F.lit(None)).when(at_dump, 0).when(left, 1)
    return event


def filled_state(df: DataFrame, at_load: str, at_dump: str, by: list[str], order: list[str], out: str = "loaded") -> DataFrame:
    """``load_state``, filled."""
    w = ordered(by, order)
    df = df.withColumn("__event", load_state(F.col(at_load), F.col(at_dump), w))
    return df.withColumn(out, F.coalesce(forward_fill(F.col("__event"), w), backward_fill(F.col("__event"), w), F.lit(0))).drop("__event")


def rolling_median(x: Column, w, rows: int, centred: bool = False) -> Column:
    """Median of the non-null values of ``rows`` rows up to this one, or around it."""
    half = rows // 2
    frame = w.rowsBetween(-half, rows - half - 1) if centred else w.rowsBetween(1 - rows, 0)
    return F.percentile(x, F.lit(0.5)).over(frame)


def mean_of_previous(x: Column, w, rows: int = 3) -> Column:
    return F.avg(x).over(w.rowsBetween(-rows, -1))


def interpolate(df: DataFrame, x: str, by: list[str], order: list[str], limit: int = 30, out: str | None = None) -> DataFrame:
    """Fills nulls on the line between their neighbours, by position; at the ends with the nearest value; nulls farther
    than ``limit`` rows from any value stay."""
    w = ordered(by, order)
    d = df.withColumn("__i", F.row_number().over(w))
    at = F.when(F.col(x).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(x).cast("double").alias("v")))
    d = d.withColumn("__a", forward_fill(at, w)).withColumn("__b", backward_fill(at, w))
    back, ahead = F.col("__i") - F.col("__a.i"), F.col("__b.i") - F.col("__i")
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * back / F.greatest(back + ahead, F.lit(1))
    near = (F.coalesce(back <= limit, F.lit(False))) | (F.coalesce(ahead <= limit, F.lit(False)))
    filled = F.when(F.col(x).isNotNull(), F.col(x).cast("double")).when(near, F.coalesce(line, F.col("__a.v"), F.col("__b.v")))
    return d.withColumn(out or x, filled).drop("__i", "__a", "__b")


def average_rank(x: Column, by: list[str] | None = None) -> Column:
    """Rank over the number of rows, ties sharing the mean of their ranks; nulls have none."""
    part = Window.partitionBy(*(by or [F.lit(0)]))
    tied = F.count(x).over(Window.partitionBy(*(by or []), x))
    rank = F.rank().over(part.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), (rank + (tied - 1) / 2.0) / F.count(x).over(part))


def average_ranks(df: DataFrame, x: str, by: list[str], out: str, ranges: int = 64) -> DataFrame:
    """``df`` with ``average_rank`` of x, for groups that may hold much of the table: rows are counted by group and value,
    values are ordered in ranges, and the ranks are joined back. Nulls of x and of ``by`` have no rank."""
    known = df.where(F.col(x).isNotNull())
    counts = in_ranges(known, known.groupBy(*by, x).agg(F.count("*").alias("__n")), x, "__n", ranges, by)
    sizes = known.groupBy(*by).agg(F.count("*").alias("__all"))
    rank = (F.col("__below") + (F.col("__n") + 1) / 2.0) / F.col("__all")
    counts = counts.join(sizes, by) if by else counts.crossJoin(F.broadcast(sizes))
    return df.join(counts.select(*by, x, rank.alias(out)), [*by, x], "left")


def deviation(x: str, by: list[str]) -> Column:
    """x less its mean over the entity."""
    return F.col(x) - F.avg(x).over(Window.partitionBy(*by))


def greedy_gate(df: DataFrame, by: list[str], order: list[str], at: str, gate: float) -> DataFrame:
    """The rows kept by walking along an entity: the first with a position, then each that is at least ``gate`` (above 0)
    beyond the last one kept; (by, order, at).

    The walk depends on all kept rows before it, so it goes over an entity's sorted rows in batches and carries the last
    kept position from one to the next: the memory of a task is a batch, whatever the length of a history. In a batch it
    jumps from kept row to kept row by search on the running maximum, which no row before the last kept one exceeds.
    """
    rows = df.select(*by, *order, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull() & ~F.isnan(at))
    rows = rows.withColumn("__e", F.xxhash64(*by)).repartition(*by).sortWithinPartitions(*by, *order)
    schema = rows.drop("__e").schema

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        entity, last = None, -np.inf
        for b in batches:
            ids, x = b.column("__e").to_numpy(), b.column(at).to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            keep = []
            for i, j in zip(starts, np.r_[starts[1:], len(ids)]):
                if entity is None or ids[i] != entity:
                    entity, last = ids[i], -np.inf
                top = np.maximum.accumulate(x[i:j])
                while (k := int(np.searchsorted(top, last + gate))) < len(top):
                    keep.append(i + k)
                    last = top[k]
            yield b.drop_columns(["__e"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(walk, schema)


def pairs_of_islands(df: DataFrame, flag: str, by: list[str], order: list[str], ts: str) -> DataFrame:
    """Dwell cycles: the first and second, third and fourth ... run with a true flag make a pair from start to end."""
    runs = sessions(df, flag, by, order, ts)
    runs = runs.withColumn("pair", F.floor((F.row_number().over(ordered(by, ["island"])) - 1) / 2))
    out = runs.groupBy(*by, "pair").agg(F.count("*").alias("n"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return out.where("n = 2").drop("n")
