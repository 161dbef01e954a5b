"""Models of the library: folds, hurdle, blends, stacking, calibration, clusters. Fits run in Spark; what comes back to the
driver is coefficients and fold tables, whose size doesn't follow the rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_group_folds(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Folds that keep a group together: groups by size, in turns to and fro over the folds, so that sizes stay alike."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    turn = F.row_number().over(Window.orderBy(F.desc("__n"), group)) - 1
    lap, at = F.floor(turn / k), F.pmod(turn, F.lit(k))
    folds = sizes.select(group, F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias(out))
    return df.join(folds, group)


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Features as a vector; nulls as 0."""
    return VectorAssembler(inputCols=features, outputCol=out).transform(df.fillna(0.0, features))


def hurdle(train: DataFrame, test: DataFrame, features: list[str], target: str, active: float = 10.0, trees: int = 15, depth: int = 4) -> DataFrame:
    """p, the probability that the target exceeds ``active``; r, its value if so; predicted, their product."""
    a = assembled(train, features).withColumn("__active", (F.col(target) > active).cast("double"))
    c = GBTClassifier(labelCol="__active", maxIter=trees, maxDepth=depth, seed=1).fit(a)
    r = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, seed=1, predictionCol="r").fit(a.where("__active = 1"))
    out = r.transform(c.transform(assembled(test, features)).withColumn("p", F.element_at(_array("probability"), 2)).drop("prediction", "rawPrediction", "probability"))
    return out.withColumn("predicted", F.greatest(F.col("p") * F.col("r"), F.lit(0.0))).drop("features")


def _array(vector: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


def gbt(train: DataFrame, test: DataFrame, features: list[str], target: str, trees: int = 15, depth: int = 4):
    """(predictions of boosted trees, importance of each feature)."""
    model = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=depth, seed=1, predictionCol="predicted").fit(assembled(train, features))
    return model.transform(assembled(test, features)).drop("features"), dict(zip(features, model.featureImportances.toArray().tolist()))


def blend_grid(df: DataFrame, target: str, p: str, r: str, gammas: list[float], alphas: list[float]) -> DataFrame:
    """Mean squared error of alpha * r * p^gamma for each pair of parameters: one pass, one group a pair."""
    grid = F.explode(F.array(*(F.struct(F.lit(float(g)).alias("gamma"), F.lit(float(a)).alias("alpha")) for g in gammas for a in alphas)))
    d = df.select(target, p, r, grid.alias("g")).select("g.*", F.pow(F.col(target) - F.col("g.alpha") * F.col(r) * F.pow(F.col(p), F.col("g.gamma")), 2).alias("e"))
    return d.groupBy("gamma", "alpha").agg(F.avg("e").alias("mse"))


def blend_weight(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """The weight of a against b, within 0 and 1, of least squared error: in closed form, one pass."""
    d = F.col(a) - F.col(b)
    w = F.sum(d * (F.col(target) - F.col(b))) / F.sum(d * d)
    return df.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)).alias("weight"))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 10.0) -> DataFrame:
    """(feature, coefficient) of a ridge regression, the intercept, which isn't penalised, as 'intercept'.

    The normal equations are summed in one pass; only their (features + 1) squared numbers come to the driver.
    """
    import numpy as np

    cols = [*features, target]
    means = df.agg(*(F.avg(c).alias(c) for c in cols))
    m = means.first()
    centred = [F.col(c) - F.lit(m[c]) for c in cols]
    sums = df.agg(*(F.sum(x * y) for i, x in enumerate(centred) for y in centred[i:])).first()
    g, k = np.zeros((len(cols), len(cols))), 0
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            g[i, j] = g[j, i] = sums[k]
            k += 1
    b = np.linalg.solve(g[:-1, :-1] + alpha * np.eye(len(features)), g[:-1, -1])
    rows = [(f, float(c)) for f, c in zip(features, b)] + [("intercept", float(m[target] - sum(c * m[f] for f, c in zip(features, b))))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def isotonic(df: DataFrame, score: str, target: str, out: str = "calibrated", to: DataFrame | None = None) -> DataFrame:
    """Monotone calibration of a score, fitted on ``df`` and given to ``to``, or to it; beyond the fitted range the ends hold."""
    m = IsotonicRegression(featuresCol=score, labelCol=target, predictionCol=out).fit(df)
    return m.transform(df if to is None else to)


def kmeans(df: DataFrame, features: list[str], k: int = 2, seed: int = 1) -> DataFrame:
    """(cluster, centre) of k-means."""
    m = KMeans(k=k, seed=seed).fit(assembled(df, features))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(sorted(map(tuple, m.clusterCenters())))]
    return df.sparkSession.createDataFrame(rows, "cluster int, centre array<double>")


def post_process(p: Column, floor: Column | None = None, ceiling: Column | None = None) -> Column:
    """Predictions no lower than 0 and the floor, no higher than the ceiling."""
    out = F.greatest(p, F.lit(0.0)) if floor is None else F.greatest(p, F.lit(0.0), floor)
    return out if ceiling is None else F.least(out, ceiling)


def fixed_blend(df: DataFrame, weights: dict[str, float]) -> Column:
    """The weighted mean of the predictions that ``df`` has, weights made to sum to one over those; null where one is null."""
    there = {c: w for c, w in weights.items() if c in df.columns}
    if not there:
        raise ValueError("no prediction to blend")
    total = sum(there.values())
    out = F.lit(0.0)
    for c, w in there.items():
        out = out + F.col(c) * F.lit(w / total)
    return out


def pack_group_folds(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Folds that keep a group together: groups by size, each to the lightest fold so far, the least of those that tie.

    Each step hangs on all before it, so one fold over an array of (size, group): for groups by the hundred thousand at
    most, such as vehicles; ``assign_group_folds`` deals out more."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    rows = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__g").alias("g")))).alias("rows"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("loads"), F.array().cast("array<int>").alias("folds"))

    def step(acc, r):
        at = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        loads = F.transform(acc["loads"], lambda x, i: F.when(i == at, x - r["n"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(acc["folds"], F.array(at)).alias("folds"))

    folds = rows.select(F.inline(F.arrays_zip("rows.g", F.aggregate("rows", start, step, lambda a: a["folds"]).alias(out)))).toDF(group, out)
    return df.join(folds, group)


def blend_families(df: DataFrame, target: str, p: str, r: str, gammas: list[float], steps: list[float], step_gammas: list[float], ramps: list[float]) -> DataFrame:
    """(family, edge, gamma, mse) of monotone blends of a probability (within 0 and 1) and a value (0 or more): r * p^gamma;
    the same below an edge and r from it on; r times p / edge up to 1. One pass, one group a blend."""
    blends = [("power", 0.0, g) for g in gammas] + [("step", e, g) for e in steps for g in step_gammas] + [("ramp", e, 1.0) for e in ramps]
    grid = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(float(e)).alias("edge"), F.lit(float(g)).alias("gamma")) for f, e, g in blends)))
    d = df.select(target, F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0)).alias("__p"), F.greatest(F.col(r), F.lit(0.0)).alias("__r"), grid.alias("g")).select("*", "g.*")
    power = F.pow("__p", "gamma")
    weight = F.when(F.col("family") == "power", power).when(F.col("family") == "ramp", F.least(F.col("__p") / F.col("edge"), F.lit(1.0))).when(F.col("__p") >= F.col("edge"), 1.0).otherwise(power)
    return d.groupBy("family", "edge", "gamma").agg(F.avg(F.pow(F.col(target) - F.col("__r") * weight, 2)).alias("mse"))


def scaled_blends(df: DataFrame, target: str, p: str, r: str, gammas: list[float], low: float = 0.5, high: float = 1.5) -> DataFrame:
    """(gamma, alpha, mse) of alpha * r * p^gamma, alpha by least squares within bounds: from sums, in one pass."""
    grid = F.explode(F.array(*(F.lit(float(g)) for g in gammas)))
    d = df.select(F.col(target).alias("__y"), grid.alias("gamma"), F.col(p).alias("__p"), F.col(r).alias("__r"))
    base = F.greatest(F.col("__r"), F.lit(0.0)) * F.pow(F.greatest(F.least(F.col("__p"), F.lit(1.0)), F.lit(0.0)), F.col("gamma"))
    d = d.withColumn("__b", base).groupBy("gamma").agg(F.count("*").alias("n"), F.sum(F.col("__y") * F.col("__b")).alias("yb"), F.sum(F.col("__b") * F.col("__b")).alias("bb"), F.sum(F.col("__y") * F.col("__y")).alias("yy"))
    d = d.where("bb > 1e-12").withColumn("alpha", F.least(F.greatest(F.col("yb") / F.col("bb"), F.lit(low)), F.lit(high)))
    a = F.col("alpha")
    return d.select("gamma", "alpha", ((F.col("yy") - 2 * a * F.col("yb") + a * a * F.col("bb")) / F.col("n")).alias("mse"))


def gated(df: DataFrame, raw: str, calibrated: str, target: str, out: str, least_gain: float = 0.0, floor: float | None = None, gate: DataFrame | None = None) -> DataFrame:
    """The calibrated prediction, no lower than ``floor``, if it lowers the root mean squared error over the rows with a
    target, of ``gate`` or else of ``df``, by more than ``least_gain``; else the raw one."""
    c = F.col(calibrated) if floor is None else F.greatest(F.col(calibrated), F.lit(floor))
    error = lambda x: F.sqrt(F.avg(F.pow(x - F.col(target), 2)))
    gain = (df if gate is None else gate).agg((error(F.col(raw)) - error(c)).alias("gain")).scalar()
    return df.withColumn("__gain", gain).withColumn(out, F.when(F.col("__gain") > least_gain, c).otherwise(F.col(raw))).drop("__gain")


def experts(train: DataFrame, test: DataFrame, features: list[str], target: str, night: Column, trees: int = 10, depth: int = 4) -> DataFrame:
    """Predictions of boosted trees for day rows, and for night rows by others whose residuals a third model learns."""
    fit = lambda d, y: GBTRegressor(labelCol=y, maxIter=trees, maxDepth=depth, seed=1, predictionCol="predicted").fit(d)
    a, b = assembled(train.where(night), features), assembled(test, features)
    day, dark = fit(assembled(train.where(~night), features), target), fit(a, target)
    left = dark.transform(a).withColumn("__left", F.col(target) - F.col("predicted")).drop("predicted")
    rest = fit(left, "__left").setPredictionCol("__rest")
    lit = day.transform(b.where(~night)).drop("features")
    unlit = rest.transform(dark.transform(b.where(night))).withColumn("predicted", F.col("predicted") + F.col("__rest")).drop("__rest", "features")
    return lit.unionByName(unlit)


def one_hot_levels(train: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The levels of a column in the training rows, ordered; no more than ``most``, as each becomes a column."""
    levels = [r[0] for r in train.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return sorted(levels)


def aligned_one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A column a training level and one for nulls, whatever levels ``df`` has; others give zeros."""
    x = F.col(column).cast("string")
    made = {f"{column}_{v}": x.eqNullSafe(v).cast("int") for v in levels} | {f"{column}_null": x.isNull().cast("int")}
    return df.withColumns(made)


def finite(x: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.lit(0.0))
