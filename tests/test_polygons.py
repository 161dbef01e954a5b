import math
import random

import pytest

from fleetspark.operators import polygons as P


def lines(spark, rows):
    return spark.createDataFrame([("m", *map(float, r)) for r in rows], "mine string, x1 double, y1 double, x2 double, y2 double")


def ring(*points):
    return [(*a, *b) for a, b in zip(points, [*points[1:], points[0]])]


def outside(segments, n):
    """Unit squares of the lattice that the outside reaches without crossing a segment."""
    walls = set()
    for x1, y1, x2, y2 in segments:
        if x1 == x2:
            walls |= {("v", x1, y) for y in range(min(y1, y2), max(y1, y2))}
        else:
            walls |= {("h", x, y1) for x in range(min(x1, x2), max(x1, x2))}
    seen, todo = {(-1, -1)}, [(-1, -1)]
    while todo:
        x, y = todo.pop()
        for nx, ny, wall in ((x + 1, y, ("v", x + 1, y)), (x - 1, y, ("v", x, y)), (x, y + 1, ("h", x, y + 1)), (x, y - 1, ("h", x, y))):
            if -1 <= nx <= n and -1 <= ny <= n and wall not in walls and (nx, ny) not in seen:
                seen.add((nx, ny))
                todo.append((nx, ny))
    return seen


@pytest.mark.parametrize("seed,size", [(1, 100.0), (2, 3.0)])
def test_random_arrangements(spark, seed, size):
    rng, n = random.Random(seed), 14
    segments = []
    for _ in range(26):
        a, b, c = rng.randrange(n + 1), rng.randrange(n + 1), rng.randrange(n + 1)
        segments.append((c, a, c, b) if rng.random() < 0.5 else (a, c, b, c))
    segments += segments[:3]  # repeated, and some without length
    points = [(x * 100 + y, "m", x + 0.5, y + 0.5) for x in range(-1, n + 1) for y in range(-1, n + 1)]
    faces = P.polygonise(lines(spark, segments), ["mine"], size)
    got = P.within_faces(spark.createDataFrame(points, "id long, mine string, x double, y double"), faces, "id", ["mine"], size=size)
    free = outside(segments, n)
    assert {r.id for r in got.where("NOT inside").collect()} == {i for i, _, x, y in points if (math.floor(x), math.floor(y)) in free}
    whole = sum(r.area for r in faces.select("face", "area").distinct().collect())
    assert whole >= (n + 2) ** 2 - len(free) - 1e-6  # areas inside others count twice


def areas(spark, rows):
    return sorted(round(r.area, 6) for r in P.polygonise(lines(spark, rows), ["mine"]).select("face", "area").distinct().collect())


def test_shapes(spark):
    square = ring((0, 0), (4, 0), (4, 4), (0, 4))
    assert areas(spark, square) == [16.0]
    assert areas(spark, ring((0, 0), (4, 4), (4, 0), (0, 4))) == [4.0, 4.0]  # a figure of eight
    assert areas(spark, square[:3]) == [] and areas(spark, [(0, 0, 1, 1)]) == [] and areas(spark, []) == []
    assert areas(spark, [*square, (2, 2, 9, 9), (9, 9, 12, 9), (0, 0, -3, -3)]) == [16.0]  # ends that lead nowhere
    assert areas(spark, [*square, *ring((6, 0), (8, 0), (8, 2), (6, 2)), (4, 1, 6, 1)]) == [4.0, 16.0]  # a way between two rings
    assert areas(spark, [*square, *ring((1, 1), (2, 1), (2, 2), (1, 2))]) == [1.0, 16.0]  # a ring in a ring
    assert areas(spark, [*square, (0, 2, 4, 2), (-1, 2, 2, 2), (2, -1, 2, 5)]) == [4.0] * 4  # along each other and across
    assert areas(spark, [(0, 0, 4, 0), (1, 0, 6, 0), (0, 0, 0, 3), (0, 3, 6, 0)]) == [9.0]
    far = [tuple(c + 4e6 for c in s) for s in square]
    assert areas(spark, far) == [16.0]


def test_zones_with_fallback(spark):
    closed, unclosed = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((0, 0), (10, 0), (10, 10), (0, 10))[:3]
    rows = [("a", *map(float, s)) for s in closed] + [("b", *map(float, s)) for s in unclosed] + [("a", None, 1.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0), ("a", float("nan"), 0.0, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "mine string, x1 double, y1 double, x2 double, y2 double")
    points = [(1, "a", 5.0, 5.0), (2, "a", 11.0, 5.0), (3, "a", 11.6, 5.0), (4, "b", 5.0, 5.0), (5, "b", 12.9, 5.0), (6, "b", -2.9, 5.0), (7, "c", 5.0, 5.0), (8, None, 0.0, 0.0), (9, "a", None, 1.0), (10, "a", 11.5, 5.0)]
    p = spark.createDataFrame(points, "id long, mine string, x double, y double")
    got = {r.id: r.inside for r in P.within_zones(p, s, 3.0, "id", ["mine"]).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: False, 9: False, 10: True}
    assert P.within_zones(p.limit(0), s, 3.0, "id", ["mine"]).count() == 0
    assert P.within_zones(p, s.limit(0), 3.0, "id", ["mine"]).where("inside").count() == 0
