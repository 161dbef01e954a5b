import os
import random

import pytest

import fleetspark.plans  # noqa: F401
from fleetspark.operators import spatial
from fleetspark.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def copies(rng, n):
    """Points on few places, many to a place, some without one; the last has no key."""
    return [(i, i % 2, *rng.choice([(rng.randrange(5) * 100.0, rng.randrange(5) * 100.0), (rng.random() * 400, None)])) for i in range(n)] + [(None, 0, 0.0, 0.0)]


def test_nearest_anchor_of_copies(spark):
    rng = random.Random(6)
    points = copies(rng, 400)
    anchors = [(i, i % 2, rng.randrange(9) * 50.0, rng.randrange(9) * 50.0) for i in rng.sample(range(1000), 300)]
    p = spark.createDataFrame(points, "id int, m int, x double, y double")
    a = spark.createDataFrame(anchors, "anchor int, m int, ax double, ay double")
    found = spatial.nearest_anchor(p, a, 80.0, "id", ["m"])
    for r in found.collect():
        near = [(((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5, i) for i, m, x, y in anchors if m == r.m] if r.id is not None and r.y is not None else []
        assert (r.distance, r.anchor) == min((d for d in near if d[0] < 80), default=(None, None))
    assert found.count() == len(points) and found.columns == ["id", "m", "x", "y", "anchor", "distance"]
    # The points meet the answers of their places; they are neither shuffled nor paired with anchors themselves.
    assert "Exchange hashpartitioning" not in plan(found) and "__cx" not in plan(found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_assigned_distance_shuffles_no_pings(spark):
    assert "Exchange hashpartitioning" not in plan(registry.QUERIES["assigned_distance"](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_assigned_anchor_pairs_places_only(spark):
    assert "__cx" not in plan(registry.QUERIES["assigned_anchor"](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_near_any_anchor_pairs_places_only(spark):
    found = plan(registry.QUERIES["near_any_anchor"](spark, DATA))
    assert "__cx" not in found and "Exchange hashpartitioning" not in found


def test_within_buffer_of_copies(spark):
    rng = random.Random(8)
    points = copies(rng, 300)
    lines = [(i % 2, x := rng.randrange(9) * 50.0, y := rng.randrange(9) * 50.0, x + 70, y) for i in range(6)] * 40
    p = spark.createDataFrame(points, "id int, m int, x double, y double")
    found = spatial.within_buffer(p, spark.createDataFrame(lines, "m int, x1 double, y1 double, x2 double, y2 double"), 20.0, "id", ["m"])
    for r in found.collect():
        near = r.id is not None and r.y is not None and any(m == r.m and (r.x - min(max(r.x, a), c)) ** 2 + (r.y - b) ** 2 <= 400 for m, a, b, c, _ in lines)
        assert r.inside == near
    assert found.count() == len(points) and "Exchange hashpartitioning" not in plan(found) and "__cx" not in plan(found)
