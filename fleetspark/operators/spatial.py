"""Spatial joins on a plane in metres, by a grid: pieces of geometry go to the cells that they reach, points to their own
cell, and an equi-join on mine and cell leaves few pairs for the exact distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.storage import bounded, written


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def segment_cells(segments: DataFrame, reach: float, size: float) -> DataFrame:
    """Segments (x1, y1, x2, y2) by each grid cell that their box, widened by ``reach``, meets."""
    d = segments.withColumn("__cx", F.explode(_cells(F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach, size)))
    return d.withColumn("__cy", F.explode(_cells(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach, size)))


def point_segment_distance(x: Column, y: Column) -> Column:
    """Distance from a point to the segment x1, y1, x2, y2 of the row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.when(length > 0, length)))).otherwise(0.0)
    return F.sqrt(F.pow(x - F.col("x1") - t * dx, 2) + F.pow(y - F.col("y1") - t * dy, 2))


def _shared(points: DataFrame, found: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``points`` with what was ``found`` for their places (by, x, y), nothing where the key is null. The points aren't
    shuffled while the places are few, by their bytes."""
    p, f = points.alias("p"), bounded(written(found, "places")).alias("f")
    on = F.col(f"p.{key}").isNotNull()
    for c in (*by, "x", "y"):
        on &= F.col(f"p.{c}") == F.col(f"f.{c}")
    return p.join(f, on, "left").select("p.*", *(f"f.{c}" for c in found.columns if c not in (*by, "x", "y")))


def within_buffer(points: DataFrame, segments: DataFrame, radius: float, key: str, by: list[str] = (), out: str = "inside") -> DataFrame:
    """Whether each point lies within ``radius`` of any segment of its ``by``; a point on the rim is inside.

    Points of one place share their answer and equal segments are one, so that copies of either make no more pairs.
    """
    size = max(radius * 4, 1.0)
    cells = segment_cells(segments.select(*by, "x1", "y1", "x2", "y2").distinct(), radius, size)
    p = points.select(*by, "x", "y").distinct().withColumn("__cx", F.floor(F.col("x") / size)).withColumn("__cy", F.floor(F.col("y") / size))
    hit = p.join(cells, [*by, "__cx", "__cy"])
    hit = hit.where(point_segment_distance(F.col("x"), F.col("y")) <= radius).select(*by, "x", "y").distinct().withColumn(out, F.lit(True))
    return _shared(points, hit, key, by).withColumn(out, F.coalesce(out, F.lit(False)))


def within_rings(points: DataFrame, segments: DataFrame, key: str, by: list[str] = (), out: str = "inside", size: float = 100.0) -> DataFrame:
    """Whether each point lies in closed rings, given as their segments: an odd number of them crosses the ray to the right.

    Points and segments meet by rows of the grid, as a ray reaches any cell to its right.
    """
    s = segments.withColumn("__cy", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)))
    p = points.select(key, *by, F.col("x").alias("__x"), F.col("y").alias("__y")).withColumn("__cy", F.floor(F.col("__y") / size))
    j = p.join(s, [*by, "__cy"]).where((F.col("y1") > F.col("__y")) != (F.col("y2") > F.col("__y")))
    cross = j.where(F.col("__x") < (F.col("x2") - F.col("x1")) * (F.col("__y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = cross.groupBy(key).agg((F.count("*") % 2 == 1).alias(out))
    return points.join(odd, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def nearest_anchor(points: DataFrame, anchors: DataFrame, radius: float, key: str, by: list[str] = (), anchor: str = "anchor") -> DataFrame:
    """The nearest anchor (ax, ay) closer than ``radius`` and its distance; null if there is none. Ties: the least anchor.

    Points of one place share their answer, and of anchors of one place only the least can be it, so that copies of either
    make no more pairs.
    """
    least = anchors.groupBy(*by, "ax", "ay").agg(F.min(anchor).alias(anchor))
    spread = least.withColumn("__cx", F.explode(F.array(*(F.floor(F.col("ax") / radius) + i for i in (-1, 0, 1)))))
    spread = spread.withColumn("__cy", F.explode(F.array(*(F.floor(F.col("ay") / radius) + i for i in (-1, 0, 1)))))
    p = points.select(*by, "x", "y").distinct().withColumn("__cx", F.floor(F.col("x") / radius)).withColumn("__cy", F.floor(F.col("y") / radius))
    j = p.join(spread, [*by, "__cx", "__cy"]).withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2)))
    best = j.where(F.col("distance") < radius).groupBy(*by, "x", "y").agg(F.min(F.struct("distance", anchor)).alias("__b"))
    return _shared(points, best.select(*by, "x", "y", f"__b.{anchor}", "__b.distance"), key, by)


def assigned_anchor(near: DataFrame, entity: str, anchor: str = "anchor") -> DataFrame:
    """Each entity's most frequent nearest anchor; the least of those that tie."""
    n = near.where(F.col(anchor).isNotNull()).groupBy(entity, anchor).agg(F.count("*").alias("n"))
    w = Window.partitionBy(entity).orderBy(F.desc("n"), anchor)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
