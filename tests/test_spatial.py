import random

from conftest import rows

from cindermap.operators.spatial import assign_polygon, attach_scores

SHAPE = "geoid string, ring array<struct<lon:double,lat:double>>"
SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]


def assign(spark, polygons, points, cell=0.5):
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    return dict(rows(assign_polygon(p, spark.createDataFrame(polygons, SHAPE), cell=cell), "id", "geoid"))


def test_inside_outside_edges_and_gaps(spark):
    polygons = [("b", SQUARE), ("a", [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0)]), ("t", [(10.0, 0.0), (12.0, 0.0), (11.0, 3.0), (10.0, 0.0)])]
    points = [(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 2.0, 1.0), (4, 0.0, 0.0), (5, 1.0, 2.0), (6, 5.0, 1.0), (7, None, 1.0), (8, 1.0, None),
              (9, 11.0, 1.0), (10, 10.1, 2.0), (11, 11.0, 3.0), (12, -1.0, 2.0)]
    assert assign(spark, polygons, points) == {1: "b", 2: "a", 3: "a", 4: "b", 5: "b", 6: None, 7: None, 8: None, 9: "t", 10: None, 11: "t", 12: None}


def test_repeated_and_missing_ids(spark):
    polygons = spark.createDataFrame([("A", SQUARE), ("B", [(x + 5, y) for x, y in SQUARE])], SHAPE)
    cases = spark.createDataFrame([("c1", 1.0, 1.0), ("c1", 6.0, 1.0), (None, 6.0, 1.0), (None, None, 1.0)], "case_num string, lon double, lat double")
    assert rows(assign_polygon(cases, polygons), "case_num", "lon", "geoid") == [(None, None, None), (None, 6.0, "B"), ("c1", 1.0, "A"), ("c1", 6.0, "B")]


def test_concave_ring(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    assert assign(spark, [("c", ring)], [(1, 2.0, 0.5), (2, 2.0, 2.0), (3, 0.5, 3.0), (4, 3.5, 3.0)]) == {1: "c", 2: None, 3: "c", 4: "c"}


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_random_points_against_brute_force(spark):
    r = random.Random(3)
    polygons = []
    for i in range(40):
        cx, cy = r.uniform(-5, 5), r.uniform(-5, 5)
        polygons.append((f"{i:02d}", [(cx + r.uniform(0.2, 1), cy), (cx, cy + r.uniform(0.2, 1)), (cx - r.uniform(0.2, 1), cy), (cx, cy - r.uniform(0.2, 1))]))
    points = [(i, r.uniform(-6, 6), r.uniform(-6, 6)) for i in range(1500)]
    points += [(i, 0.123, 0.456) for i in range(1500, 2500)]  # a hot spot
    want = {i: min((g for g, ring in polygons if inside(ring, x, y)), default=None) for i, x, y in points}
    assert assign(spark, polygons, points, cell=0.7) == want
    assert sum(v is not None for v in want.values()) > 200


def test_scores_onto_shapes(spark):
    shapes = spark.createDataFrame([("a", SQUARE), ("b", SQUARE)], SHAPE)
    scores = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "county string, s double")
    assert rows(attach_scores(shapes, scores, "county"), "geoid", "s") == [("a", 1.0), ("b", None)]


def test_a_large_ring_has_no_more_cells_than_a_small_one(spark):
    import math

    from cindermap.operators.spatial import shape_cells

    r = random.Random(8)
    large = [(90 * math.cos(t / 200 * 2 * math.pi) * r.uniform(0.7, 1), 80 * math.sin(t / 200 * 2 * math.pi) * r.uniform(0.7, 1)) for t in range(200)]
    small = [(f"s{i:02d}", [(x, y), (x + 0.3, y), (x + 0.2, y + 0.4)]) for i, (x, y) in enumerate((r.uniform(-90, 90), r.uniform(-80, 80)) for _ in range(30))]
    polygons = [("large", large), *small]
    cells = shape_cells(spark.createDataFrame(polygons, SHAPE), 0.1).groupBy("__geoid").agg({"inner": "count", "level": "max"})
    assert max(n for _, n, _ in rows(cells, "__geoid", "count(inner)", "max(level)")) <= 110
    points = [(i, r.uniform(-95, 95), r.uniform(-85, 85)) for i in range(1000)]
    points += [(1000 + i, x + 0.17, y + 0.1) for i, (_, ((x, y), *_)) in enumerate(small)]
    want = {i: min((g for g, ring in polygons if inside(ring, x, y)), default=None) for i, x, y in points}
    assert assign(spark, polygons, points, cell=0.1) == want
    assert sum(v == "large" for v in want.values()) > 300


def test_no_polygons_and_no_points(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lon double, lat double")
    shapes = spark.createDataFrame([("a", SQUARE)], SHAPE)
    assert rows(assign_polygon(p, shapes.limit(0)), "id", "geoid") == [(1, None)]
    assert assign_polygon(p.limit(0), shapes).count() == 0
