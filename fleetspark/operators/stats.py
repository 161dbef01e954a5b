"""Statistics of entities, fitted on training rows only and applied to any, with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_history(train: DataFrame, by: list[str], target: str, prefix: str) -> DataFrame:
    """Mean, median, spread, quantiles and count of the target by entity; one row an entity."""
    return train.where(F.col(target).isNotNull()).groupBy(*by).agg(
        F.avg(target).alias(f"{prefix}_mean"), F.percentile(target, F.lit(0.5)).alias(f"{prefix}_median"), F.stddev(target).alias(f"{prefix}_std"),
        F.percentile(target, F.lit(0.1)).alias(f"{prefix}_p10"), F.percentile(target, F.lit(0.9)).alias(f"{prefix}_p90"), F.count("*").alias(f"{prefix}_n"),
    )


def apply_history(df: DataFrame, levels: list[tuple[DataFrame, list[str], str]], stat: str, default: Column, out: str) -> DataFrame:
    """Takes ``stat`` from the first level that knows the row's entity, else ``default``."""
    names = []
    for table, by, prefix in levels:
        df = df.join(table.select(*by, f"{prefix}_{stat}"), by, "left")
        names.append(f"{prefix}_{stat}")
    return df.withColumn(out, F.coalesce(*names, default)).drop(*names)


def smoothed_mean(train: DataFrame, by: list[str], target: str, k: float, out: str = "smoothed") -> DataFrame:
    """(n * mean + k * mean of all) / (n + k) by entity."""
    whole = train.agg(F.avg(target)).scalar()
    d = train.groupBy(*by).agg(F.count(target).alias("__n"), F.avg(target).alias("__m"))
    return d.select(*by, ((F.col("__n") * F.coalesce("__m", F.lit(0.0)) + k * whole) / (F.col("__n") + k)).alias(out))


def out_of_fold_mean(df: DataFrame, by: list[str], fold: str, target: str, out: str = "oof_mean") -> DataFrame:
    """The entity's mean over the other folds, the other folds' mean where it has no rows there: totals less the fold's. Rows
    are summed by entity and fold before they are shuffled, and the few sums are joined back."""
    keys = [f"__k{i}" for i in range(len(by))]
    parts = df.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(fold).alias("__f")).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    whole, every = Window.partitionBy(*keys), parts.groupBy("__f").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    every = every.withColumns({"ts": parts.agg(F.sum("s")).scalar(), "tn": parts.agg(F.sum("n")).scalar()})
    every = every.select(F.col("__f").alias("__e"), ((F.col("ts") - F.coalesce("fs", F.lit(0.0))) / F.when(F.col("tn") != F.col("fn"), F.col("tn") - F.col("fn"))).alias("__rest"))
    s, n = F.coalesce("s", F.lit(0.0)), F.col("n")
    own = parts.select(*keys, "__f", (F.sum(s).over(whole) - s).alias("__s"), (F.sum(n).over(whole) - n).alias("__n"))
    means = own.join(every, F.col("__f") == F.col("__e"), "left").select(*keys, "__f", F.coalesce(F.col("__s") / F.when(F.col("__n") != 0, F.col("__n")), F.col("__rest")).alias("__m"))
    same = F.col(fold).eqNullSafe(F.col("__f"))
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return df.drop(out).join(means, same, "left").withColumn(out, F.col("__m")).drop("__m", "__f", *keys)


def cascade(df: DataFrame, out: str, *steps: tuple[Column, Column]) -> DataFrame:
    """The value of the first step whose condition holds and whose value isn't null."""
    return df.withColumn(out, F.coalesce(*(F.when(ok, value) for ok, value in steps)))


def refuel_offsets(refuels: DataFrame, ts: str, litres: str, keys, minutes: tuple[int, ...] = (0, 2, -2)) -> DataFrame:
    """Litres and count of refuels by key, with times moved by each offset: one pass, then a column pair an offset.

    keys: a function from the moved time column to the key columns.
    """
    moved = refuels.withColumn("__o", F.explode(F.array(*map(F.lit, minutes)))).withColumn("__t", F.col(ts) + F.make_dt_interval(mins=F.col("__o")))
    cols = keys(F.col("__t"))
    name = lambda m: f"{'p' if m > 0 else 'm' if m < 0 else ''}{abs(m)}"
    aggs = []
    for m in minutes:
        here = F.col("__o") == m
        aggs += [F.coalesce(F.sum(F.when(here, F.col(litres))), F.lit(0.0)).alias(f"litres_{name(m)}"), F.count_if(here).alias(f"count_{name(m)}")]
    return moved.groupBy(*cols).agg(*aggs)


def low_days(df: DataFrame, day: str, x: str, q: float = 0.25) -> DataFrame:
    """Days and whether their mean is no higher than the q-quantile of days' means."""
    d = df.groupBy(day).agg(F.avg(x).alias("day_mean"))
    limit = d.agg(F.percentile("day_mean", F.lit(q))).scalar()
    return d.select(day, "day_mean", (F.col("day_mean") <= limit).cast("int").alias("is_low"))


def benchmark_residual(df: DataFrame, bins: list[str], entity: str, target: str) -> DataFrame:
    """Entity's mean residual against the mean of its bins."""
    expected = df.groupBy(*bins).agg(F.avg(target).alias("expected"))
    d = df.join(expected, bins).withColumn("residual", F.col(target) - F.col("expected"))
    return d.groupBy(entity).agg(F.avg("residual").alias("efficiency"), F.count("*").alias("n"))


def missing_row(columns: list[str], any_null: bool = False) -> Column:
    """Whether a row has no telemetry: all columns null or all zero; or, with any_null, any of them null."""
    if any_null:
        out = F.lit(False)
        for c in columns:
            out = out | F.col(c).isNull()
        return out
    nothing, zero = F.lit(True), F.lit(True)
    for c in columns:
        nothing, zero = nothing & F.col(c).isNull(), zero & (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0)
    return nothing | zero


def safe_features(df: DataFrame, forbidden: list[str], also_in: DataFrame | None = None) -> list[str]:
    """Numeric columns whose names hold none of the forbidden words, and that the other table has too."""
    kinds = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    names = [c for c, t in df.dtypes if t.startswith(kinds) and not any(w in c.lower() for w in forbidden)]
    return names if also_in is None else [c for c in names if c in also_in.columns]


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one value: one pass over the table."""
    row = df.agg(*(F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def out_of_fold_stats(df: DataFrame, by: list[str], fold: str, target: str, prefix: str) -> DataFrame:
    """Mean, spread and count of the entity's target over the other folds: sums by entity and fold, totals less the fold's,
    joined back; null where the other folds have too few rows."""
    parts = df.groupBy(*by, fold).agg(F.count(target).alias("n"), F.coalesce(F.sum(target), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col(target) * F.col(target)), F.lit(0.0)).alias("q"))
    whole = Window.partitionBy(*by)
    rest = parts.select(*by, fold, *((F.sum(c).over(whole) - F.col(c)).alias(c) for c in "nsq"))
    mean = F.col("s") / F.when(F.col("n") > 0, F.col("n"))
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1))
    rest = rest.select(*by, fold, mean.alias(f"{prefix}_mean"), spread.alias(f"{prefix}_std"), F.col("n").alias(f"{prefix}_n"))
    return df.join(rest, [*by, fold], "left")
