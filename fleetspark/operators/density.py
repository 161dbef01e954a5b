"""Density clusters of points on a plane, and places that stay.

The plane is dealt into cells so small that all points of one are within reach of each other. A cell whose weights reach
the least weight needs no pairs: all its points are core. Only points of lighter cells are compared, and only with cells
that they reach in part. Two cells are linked if any of their core points are within reach; boxes around the points decide
that where they can, boxes around ever smaller parts where they can't, and pairs of points only where few are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.storage import discard, written

from .graph import components

#: Pairs of points between two parts of cells that are simply compared; how often parts are split before they are in any case.
FEW, SPLITS = 256, 12
BOX = ["lx", "ly", "hx", "hy"]


def _box(x: str = "x", y: str = "y") -> list[Column]:
    return [F.min(x).alias("lx"), F.min(y).alias("ly"), F.max(x).alias("hx"), F.max(y).alias("hy")]


def _gaps(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance between two boxes."""
    zero = F.lit(0.0)
    apart = lambda i: F.greatest(zero, b[i] - a[i + 2], a[i] - b[i + 2])
    span = lambda i: F.greatest(b[i + 2] - a[i], a[i + 2] - b[i])
    return apart(0) * apart(0) + apart(1) * apart(1), span(0) * span(0) + span(1) * span(1)


def _linked(cells: DataFrame, core: DataFrame, eps: float, side: float) -> DataFrame:
    """(a, b): cells, by id, with core points within reach of each other. cells: id, by, cx, cy, n and the box of its core points; core: id, x, y."""
    by = [c for c in cells.columns if c not in ("id", "cx", "cy", "n", *BOX)]
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    steps = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in half))
    a = cells.withColumn("s", F.explode(steps)).select(*by, (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), F.col("id").alias("a"), F.col("n").alias("na"), *(F.col(c).alias(f"a{c}") for c in BOX))
    b = cells.select(*by, "cx", "cy", F.col("id").alias("b"), F.col("n").alias("nb"), *(F.col(c).alias(f"b{c}") for c in BOX))
    near, far = _gaps([F.col(f"a{c}") for c in BOX], [F.col(f"b{c}") for c in BOX])
    reach = eps * eps
    judged = a.join(b, [*by, "cx", "cy"]).where(near <= reach).withColumn("sure", far <= reach)
    judged = written(judged.select("a", "b", "na", "nb", "sure"), "cells-near")
    found = [judged.where("sure").select("a", "b")]
    open_ = judged.where("NOT sure").select("a", "b", (F.col("na") * F.col("nb")).alias("n"), *(F.lit(0).cast("long").alias(c) for c in ("asx", "asy", "bsx", "bsy")))
    for level in range(SPLITS + 1):
        few = open_ if level == SPLITS else open_.where(F.col("n") <= FEW)
        part = side / 4**level
        parted = core.withColumn("sx", F.floor(F.col("rx") / part)).withColumn("sy", F.floor(F.col("ry") / part))
        pa, pb = (parted.select(F.col("id").alias(s), F.col("sx").alias(f"{s}sx"), F.col("sy").alias(f"{s}sy"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")) for s in "ab")
        at = few if level else few.drop("asx", "asy", "bsx", "bsy")
        pairs = at.join(pa, ["a", "asx", "asy"] if level else ["a"]).join(pb, ["b", "bsx", "bsy"] if level else ["b"])
        found.append(written(pairs.where(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= reach).select("a", "b").distinct(), "cells-met"))
        if level == SPLITS:
            break
        done = reduce(DataFrame.unionAll, found)
        rest = open_.where(F.col("n") > FEW).join(done, ["a", "b"], "left_anti")
        finer = side / 4 ** (level + 1)
        boxes = core.withColumn("sx", F.floor(F.col("rx") / finer)).withColumn("sy", F.floor(F.col("ry") / finer)).groupBy("id", "sx", "sy").agg(F.count("*").alias("k"), *_box())
        up = lambda c: F.floor(F.col(c) / 4) if level else F.lit(0).cast("long")  # noqa: E731, B023
        child = lambda s: boxes.select(F.col("id").alias(s), up("sx").alias(f"{s}sx"), up("sy").alias(f"{s}sy"), F.col("sx").alias(f"{s}tx"), F.col("sy").alias(f"{s}ty"), F.col("k").alias(f"{s}k"), *(F.col(c).alias(s + c) for c in BOX))  # noqa: E731, B023
        finer_pairs = rest.join(child("a"), ["a", "asx", "asy"]).join(child("b"), ["b", "bsx", "bsy"]).where(near <= reach).withColumn("sure", far <= reach)
        finer_pairs = written(finer_pairs.select("a", "b", (F.col("ak") * F.col("bk")).alias("n"), F.col("atx").alias("asx"), F.col("aty").alias("asy"), F.col("btx").alias("bsx"), F.col("bty").alias("bsy"), "sure"), "cells-parts")
        sure = finer_pairs.where("sure").select("a", "b").distinct()
        found.append(sure)
        open_ = finer_pairs.where("NOT sure").drop("sure").join(sure, ["a", "b"], "left_anti")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionAll, found).distinct()


def dbscan(points: DataFrame, key: str, eps: float, least_weight: float, weight: str, by: list[str] = (), out: str = "cluster") -> DataFrame:
    """``points`` with density clusters: a point is core if the weights within ``eps``, its own included, reach
    ``least_weight``; cores within ``eps`` are one cluster, named by its least key; other points join the least cluster of a
    core within reach, or none (null).

    key tells points apart; weights are 0 or more, a null counts 0; points without a place, or of a null ``by``, have no cluster. A
    cell of any number of points makes no pairs of its own; points of cells lighter than ``least_weight`` are paired with the points of cells that
    they reach in part. A column named ``out`` gives way.
    """
    side, reach = eps / 2**0.5 * (1 - 1e-9), eps * eps
    there = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    p = points.where(there("x") & there("y"))
    for c in by:
        p = p.where(F.col(c).isNotNull())
    # by other names, so that none clashes
    p = p.select(F.col(key).alias("k"), *(F.col(c).alias(f"g{i}") for i, c in enumerate(by)), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"))
    by_ = [f"g{i}" for i in range(len(by))]
    p = p.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    cells = written(p.groupBy(*by_, "cx", "cy").agg(F.sum("w").alias("cw"), *_box()).withColumn("cell", F.monotonically_increasing_id()), "cells")
    p = written(p.join(cells.select(*by_, "cx", "cy", "cell", (F.col("cw") >= least_weight).alias("heavy")), [*by_, "cx", "cy"]), "cell-points")
    light = p.where("NOT heavy")
    around = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    seen = light.select("k", *by_, "x", "y", "cx", "cy", around.alias("s")).select("k", *by_, F.col("x").alias("px"), F.col("y").alias("py"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    near, far = _gaps([F.col(c) for c in ("px", "py", "px", "py")], [F.col(c) for c in BOX])
    seen = seen.join(cells, [*by_, "cx", "cy"]).where(near <= reach).select("k", "px", "py", "cell", "cw", (far <= reach).alias("whole"))
    seen = written(seen, "cell-reach")
    partly = seen.where("NOT whole").join(p.select("cell", F.col("k").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("w").alias("qw")), "cell")
    partly = written(partly.where(F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2) <= reach).select("k", "cell", "q", "qw"), "cell-pairs")
    weights = seen.where("whole").select("k", F.col("cw").alias("w")).unionAll(partly.select("k", F.col("qw").alias("w"))).groupBy("k").agg(F.sum("w").alias("w"))
    core = p.where("heavy").unionByName(light.join(weights.where(F.col("w") >= least_weight).select("k"), "k", "left_semi"))
    core = written(core.select("k", *by_, "cx", "cy", "cell", "x", "y", (F.col("x") - F.col("cx") * side).alias("rx"), (F.col("y") - F.col("cy") * side).alias("ry")), "core-points")
    held = core.groupBy(F.col("cell").alias("id"), *by_, "cx", "cy").agg(F.count("*").alias("n"), *_box())
    links = _linked(written(held, "core-cells"), core.select(F.col("cell").alias("id"), "x", "y", "rx", "ry"), eps, side)
    roots = components(links, contract=True).select(F.col("node").alias("cell"), "root")
    rooted = core.select("k", "cell").join(roots, "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    named = written(rooted.groupBy("root").agg(F.min("k").alias("c")).join(rooted.select("cell", "root").distinct(), "root").select("cell", "c"), "core-clusters")
    # all core points of a cell are of one cluster; a cell that is reached as a whole is reached in its core points
    rim = seen.where("whole").join(named, "cell").select("k", "c").unionAll(partly.join(core.select(F.col("k").alias("q")), "q", "left_semi").join(named, "cell").select("k", "c"))
    rim = rim.groupBy("k").agg(F.min("c").alias("c")).join(core.select("k"), "k", "left_anti")
    clusters = written(core.join(named, "cell").select("k", "c").unionByName(rim).select(F.col("k").alias(key), F.col("c").alias(out)), "clusters")
    discard(seen, partly, p, cells, core, named)
    return points.drop(out).join(clusters, key, "left")


def stable_zones(windows: DataFrame, key: str, eps: float, least_weight: float, weight: str, by: list[str], vehicle: str, min_duration: float, min_windows: int, min_vehicles: int) -> DataFrame:
    """``windows`` (with x and y) with their cluster, weighted by duration, what it holds in all and whether it is a zone that stays:
    stop_cluster (null for none), cluster_duration_s, cluster_windows, cluster_vehicles (0 for none), stable_zone.

    A zone stays if its windows' duration, their number and that of their vehicles reach the least ones. Clusters' totals are
    partial aggregates, joined back."""
    d = dbscan(windows.drop("stop_cluster"), key, eps, least_weight, weight, by, "stop_cluster")
    of = d.where("stop_cluster IS NOT NULL").groupBy("stop_cluster").agg(F.sum(weight).alias("cluster_duration_s"), F.count("*").alias("cluster_windows"), F.count_distinct(vehicle).alias("cluster_vehicles"))
    d = d.drop("cluster_duration_s", "cluster_windows", "cluster_vehicles", "stable_zone").join(of, "stop_cluster", "left").fillna(0, ["cluster_duration_s", "cluster_windows", "cluster_vehicles"])
    stays = F.col("stop_cluster").isNotNull() & (F.col("cluster_duration_s") >= min_duration) & (F.col("cluster_windows") >= min_windows) & (F.col("cluster_vehicles") >= min_vehicles)
    return d.withColumn("stable_zone", stays)
