"""Aggregates with the library's rules for missing values: sums of nothing are 0, means and spreads of nothing are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(x: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0.0))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def first_by(x: str, order: str) -> Column:
    """Of the row with the least ``order``, null or not."""
    return F.min_by(F.struct(x), F.col(order))[x]


def last_by(x: str, order: str) -> Column:
    return F.max_by(F.struct(x), F.col(order))[x]


def first_value(x: str, order: str) -> Column:
    """The first that isn't null."""
    return F.min_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(order)))


def last_value(x: str, order: str) -> Column:
    return F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(order)))


def quantiles(x: str, qs: list[float]) -> list[Column]:
    """Exact quantiles with linear interpolation, as p<percent>."""
    return [F.percentile(x, F.lit(q)).alias(f"{x}_p{q * 100:g}".replace(".", "_")) for q in qs]


def mode_least(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """The most frequent non-null value, the least of those that tie."""
    n = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    best = Window.partitionBy(*by).orderBy(F.desc("n"), F.col(x))
    return n.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def entropy(df: DataFrame, by: list[str], part: str, weight: Column) -> DataFrame:
    """Entropy and greatest share of an entity's weight over its parts."""
    d = df.groupBy(*by, part).agg(F.sum(weight).alias("w"))
    p = F.col("w") / (F.sum("w").over(Window.partitionBy(*by)) + 1e-6)
    d = d.withColumn("p", p)
    return d.groupBy(*by).agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-9)).alias("entropy"), F.max("p").alias("dominant_share"))


def top_share(df: DataFrame, by: list[str], cell: str, weight: Column) -> DataFrame:
    """Distinct cells of an entity, and the share of the heaviest one."""
    d = df.groupBy(*by, cell).agg(F.sum(weight).alias("w"))
    return d.groupBy(*by).agg(F.count("*").alias("cells"), (F.max("w") / F.sum("w")).alias("top_share"))


def with_scalars(df: DataFrame, **aggs: Column) -> DataFrame:
    """Adds aggregates over the whole table to each row, as scalar subqueries. For quantiles take ``exact_quantiles``."""
    return df.withColumns({n: df.agg(c).scalar() for n, c in aggs.items()})


def decayed_mean(df: DataFrame, by: list[str], order: list[str], x: str, rate: float = 0.1) -> DataFrame:
    """Mean of an entity's rows, weighing exp(-rate * rows since)."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    d = df.withColumn("__w", F.exp(-rate * (F.row_number().over(w) - 1)))
    return d.groupBy(*by).agg((F.sum(F.col("__w") * F.col(x)) / F.sum("__w")).alias("decayed_mean"))


def resample_daily(df: DataFrame, ts: str, x: str) -> DataFrame:
    """Sum of each day from the first to the last, 0 on days without rows."""
    d = df.groupBy(F.to_date(ts).alias("day")).agg(F.sum(x).alias("total"))
    days = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(d, "day", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, long."""
    row = df.agg(*(F.corr(c, target).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns))).alias("x")).select("x.*")


def fuel_balance(first: Column, last: Column, added: Column) -> Column:
    """What was used: first less last plus added, no less than 0."""
    used = first - last + F.coalesce(added, F.lit(0.0))
    return F.when(used.isNotNull(), F.greatest(used, F.lit(0.0)))


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, n, mean, std, least, greatest) of numeric columns, nulls left out: one aggregation, then a row a column."""
    made = F.array(*(F.struct(F.lit(c).alias("col"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest")) for c in columns))
    return df.agg(made.alias("rows")).select(F.inline("rows"))


def merge_parts(parts: DataFrame, by: list[str], sums: list[str] = (), greatest: list[str] = (), means: list[str] = ()) -> DataFrame:
    """One row an entity from aggregates of its parts: sums of sums, greatest of greatest, unweighted means of means."""
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in greatest), *(F.avg(c).alias(c) for c in means))


def all_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, (a, b) with a before b in the list, by one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs)).alias("rows"))
    return row.select(F.inline("rows"))


def in_ranges(df: DataFrame, counts: DataFrame, x: str, n: str, ranges: int = 64, by: list[str] = ()) -> DataFrame:
    """``counts``, a row a value of x (of each ``by``), with __below: the sum of ``n`` over lesser values of the same ``by``.

    Values are ordered within ranges that hold like shares of all rows of ``df``, so that no task orders more than about a range,
    also of a group that holds most rows; a group's totals by range are carried over. The cuts are found by a sketch, as a scalar of
    the same job."""
    cuts = df.agg(F.percentile_approx(F.col(x).cast("double"), [i / ranges for i in range(1, ranges)], F.lit(64 * ranges)).alias("c")).scalar()
    part = F.size(F.filter(F.coalesce(F.array_distinct("__cuts"), F.array().cast("array<double>")), lambda c: c < F.col(x)))
    counts = counts.withColumn("__cuts", cuts).withColumn("__part", part).drop("__cuts")
    keys = [f"__g{i}" for i in range(len(by))]
    totals = counts.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col("__part").alias("__p")).agg(F.sum(n).alias("__pn"))
    before = Window.partitionBy(*keys).orderBy("__p")
    carried = totals.select(*keys, "__p", (F.sum("__pn").over(before) - F.col("__pn")).alias("__carry"))
    same = F.col("__part") == F.col("__p")
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    below = F.col("__carry") + F.sum(n).over(Window.partitionBy(*by, "__part").orderBy(x)) - F.col(n)
    return counts.join(carried, same).withColumn("__below", below).drop("__part", "__carry", "__p", *keys)


def exact_quantiles(df: DataFrame, x: str, qs: dict[str, float], ranges: int = 64) -> DataFrame:
    """One row with exact quantiles of the whole table, interpolated between neighbours, by name; null for nothing. Values
    are counted first and ordered in ranges, where ``percentile`` over a whole table brings all values to one task."""
    d = df.select(F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    counts = d.groupBy("__x").agg(F.count("*").alias("__n"))
    counts = in_ranges(d, counts, "__x", "__n", ranges).withColumn("__last", F.greatest(d.agg(F.count("*")).scalar() - 1, F.lit(0)))
    end, last = F.col("__below") + F.col("__n"), F.first("__last")
    made, low = [], {name: F.floor(q * F.col("__last")) for name, q in qs.items()}
    for name, q in qs.items():
        lower, upper = (F.min(F.when(end > r, F.col("__x"))) for r in (low[name], F.least(low[name] + 1, F.col("__last"))))
        made.append((lower + (upper - lower) * (q * last - F.floor(q * last))).alias(name))
    return counts.agg(*made)


def area_under_curve(df: DataFrame, score: str, label: str, by: list[str] = (), ranges: int = 64) -> DataFrame:
    """(by, auc): the chance that a row with a true label scores above one with a false label, ties counting half; rows
    without score or label are left out. Rows are counted by score first, and scores are ordered in ranges."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label)).alias("__t"), F.count_if(~F.col(label)).alias("__f"))
    counts = in_ranges(df.where(F.col(score).isNotNull()), counts, score, "__f", ranges, by)
    counts = counts.withColumn("__won", F.col("__t") * (F.col("__below") + F.col("__f") / 2))
    t, f = F.sum("__t"), F.sum("__f")
    won = F.sum("__won") / F.when(t * f > 0, t * f)
    return counts.groupBy(*by).agg(won.alias("auc"))
