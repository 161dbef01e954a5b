"""Areas from open lines: segments are cut where they meet, the rings that close are found, and points are tested against
them. All by joins on a grid, windows around a node and components, so the lines of many layers go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.storage import discard, written

from .graph import components
from .spatial import _cells, segment_cells, within_buffer

ENDS = ["x1", "y1", "x2", "y2"]
#: Of a segment's length: how near to its ends a place counts as the end.
NEAR_END = 1e-9


def noded(segments: DataFrame, by: list[str] = (), size: float = 100.0, digits: int = 6) -> DataFrame:
    """(by, x1, y1, x2, y2): the pieces of the segments of each ``by`` between the places where they meet, each once, with the
    lesser end first. Coordinates are rounded; segments without length, with nulls or with numbers that aren't finite are left out."""
    number = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    s = segments.where(number("x1") & number("y1") & number("x2") & number("y2"))
    for c in by:
        s = s.where(F.col(c).isNotNull())
    s = s.select(*by, *(F.round(F.col(c).cast("double"), digits).alias(c) for c in ENDS)).where("x1 <> x2 OR y1 <> y2")
    flip = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    s = s.select(*by, *(F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ENDS, ["x2", "y2", "x1", "y1"]))).distinct()
    s = written(s.withColumn("id", F.monotonically_increasing_id()), "segments")
    cells = segment_cells(s, 0.0, size)
    other = cells.select(*by, "__cx", "__cy", F.col("id").alias("o"), *(F.col(c).alias(f"o{c}") for c in ENDS))
    pairs = cells.join(other, [*by, "__cx", "__cy"]).where("id < o").dropDuplicates(["id", "o"])
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    gx, gy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    pairs = pairs.withColumns({"c": dx * ey - dy * ex, "a": gx * ey - gy * ex, "b": gx * dy - gy * dx})
    scale = F.sqrt((dx * dx + dy * dy) * (ex * ex + ey * ey))
    crossing = F.abs("c") > 1e-12 * scale
    t, u = F.when(crossing, F.col("a") / F.col("c")), F.when(crossing, F.col("b") / F.col("c"))
    within = (t >= -NEAR_END) & (t <= 1 + NEAR_END) & (u >= -NEAR_END) & (u <= 1 + NEAR_END)
    # one place a pair, an end of one of them where it is one
    end = lambda r, i, j: F.when(F.abs(r) <= NEAR_END, F.struct(F.col(f"{i}x1").alias("x"), F.col(f"{i}y1").alias("y"))).when(F.abs(r - 1) <= NEAR_END, F.struct(F.col(f"{i}x2").alias("x"), F.col(f"{i}y2").alias("y")))
    met = F.struct(F.round(F.col("x1") + t * dx, digits).alias("x"), F.round(F.col("y1") + t * dy, digits).alias("y"))
    met = pairs.where(crossing & within).withColumn("at", F.coalesce(end(t, "", 0), end(u, "o", 0), met))
    # segments along one line cut each other at their ends
    along = pairs.where(~crossing & (F.abs(gx * dy - gy * dx) <= 1e-9 * F.sqrt(dx * dx + dy * dy) * F.greatest(F.lit(1.0), F.sqrt(gx * gx + gy * gy))))
    at = lambda i, k: F.struct(F.col(f"{i}x{k}").alias("x"), F.col(f"{i}y{k}").alias("y"))
    cuts = met.select("id", "at").unionAll(met.select(F.col("o").alias("id"), "at"))
    cuts = cuts.unionAll(along.select("id", F.explode(F.array(at("o", 1), at("o", 2))).alias("at"))).unionAll(along.select(F.col("o").alias("id"), F.explode(F.array(at("", 1), at("", 2))).alias("at")))
    # places in order along the segment; those of other segments of its line may be beyond its ends
    part = lambda p: ((p["x"] - F.col("x1")) * dx + (p["y"] - F.col("y1")) * dy) / (dx * dx + dy * dy)
    cuts = s.join(cuts, "id").select(*by, "id", part(F.col("at")).alias("t"), "at").where(f"t > {NEAR_END} AND t < 1 - {NEAR_END}")
    ends = s.select(*by, "id", F.inline(F.array(F.struct(F.lit(0.0).alias("t"), at("", 1).alias("at")), F.struct(F.lit(1.0).alias("t"), at("", 2).alias("at")))))
    w = Window.partitionBy("id").orderBy("t", "at")
    steps = cuts.unionByName(ends).withColumn("to", F.lead("at").over(w)).where("to IS NOT NULL AND at <> to")
    low, high = F.least("at", "to"), F.greatest("at", "to")
    return steps.select(*by, low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2")).distinct()


def polygonise(segments: DataFrame, by: list[str] = (), size: float = 100.0, digits: int = 6) -> DataFrame:
    """(by, face, x1, y1, x2, y2, area): the directed sides of the areas that the segments of each ``by`` close, interior to the left.

    Every piece has two sides. Where a side ends, the next is the first to the right of the way back; sides that follow
    each other go around one area, clockwise around the outside. Pieces with both sides in one area end nowhere or only
    join others; they bound nothing and are left out. Rings inside an area are areas of their own, and aren't cut out of it. face is the least
    number of its sides.
    """
    edges = written(noded(segments, by, size, digits).withColumn("e", F.monotonically_increasing_id()), "pieces")
    there = edges.select(*by, (2 * F.col("e")).alias("h"), *ENDS)
    back = edges.select(*by, (2 * F.col("e") + 1).alias("h"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    sides = there.unionByName(back)
    around = Window.partitionBy(*by, "x1", "y1").orderBy(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), "h")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = sides.withColumn("next", F.coalesce(F.lag("h").over(around), F.last("h").over(whole)))
    links = turned.select(F.col("h").bitwiseXOR(F.lit(1)).alias("a"), F.col("next").alias("b"))
    face = components(links, contract=True).select(F.col("node").alias("h"), F.col("root").alias("face"))
    sides = written(sides.join(face, "h"), "sides")
    other = sides.select(F.col("h").bitwiseXOR(F.lit(1)).alias("h"), F.col("face").alias("f2"))
    kept = sides.join(other, "h").where("face <> f2").drop("f2")
    # areas are summed from a corner of each area, so that large coordinates don't drown them
    corner = kept.groupBy("face").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"))
    x1, y1, x2, y2 = (F.col(a) - F.col(b) for a, b in zip(ENDS, ["x0", "y0", "x0", "y0"]))
    area = kept.join(corner, "face").groupBy("face").agg((F.sum(x1 * y2 - x2 * y1) / 2).alias("area")).where("area > 0")
    out = written(kept.join(area, "face").select(*by, "face", *ENDS, "area"), "faces")
    discard(edges, sides)
    return out


def within_faces(points: DataFrame, faces: DataFrame, key: str, by: list[str] = (), out: str = "inside", size: float = 100.0) -> DataFrame:
    """Whether each point lies in any area of its ``by``: an odd number of the area's sides crosses the ray to the right."""
    s = faces.withColumn("__cy", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)))
    p = points.select(key, *by, F.col("x").alias("__x"), F.col("y").alias("__y")).withColumn("__cy", F.floor(F.col("__y") / size))
    j = p.join(s, [*by, "__cy"]).where((F.col("y1") > F.col("__y")) != (F.col("y2") > F.col("__y")))
    cross = j.where(F.col("__x") < (F.col("x2") - F.col("x1")) * (F.col("__y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hit = cross.groupBy(key, "face").agg(F.count("*").alias("n")).where("n % 2 = 1").select(key).distinct().withColumn(out, F.lit(True))
    return points.drop(out).join(hit, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def within_zones(points: DataFrame, segments: DataFrame, radius: float, key: str, by: list[str], out: str = "inside", size: float = 100.0, digits: int = 6) -> DataFrame:
    """Whether each point lies in the zone of its ``by``: within half the radius of the areas that its lines close; where
    none closes, within the radius of the lines. Points without a place, and of a ``by`` without lines or null, are outside; key tells points apart."""
    faces = polygonise(segments, by, size, digits)
    closed = faces.select(*by).distinct()
    inner = within_faces(points, faces, key, by, "__in", size).select(key, "__in")
    rim = within_buffer(points.select(key, *by, "x", "y"), faces.select(*by, *ENDS).distinct(), radius / 2, key, by, "__rim").select(key, "__rim")
    open_lines = segments.join(closed, by, "left_anti").select(*by, *ENDS).dropna()
    near = within_buffer(points.select(key, *by, "x", "y"), open_lines, radius, key, by, "__near").select(key, "__near")
    made: Column = F.col("__in") | F.col("__rim") | F.col("__near")
    return points.drop(out).join(inner, key).join(rim, key).join(near, key).withColumn(out, made).drop("__in", "__rim", "__near")


