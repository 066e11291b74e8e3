import math
import random

import numpy as np
import pytest

from wayloom.operators import spatial


def brute(rows, metres):
    rows = list({r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and -180 <= r[1] <= 180 and -90 <= r[2] <= 90})
    out = set()
    for i, (k, x, y) in enumerate(rows):
        for l, u, v in rows[:i]:
            if k != l and float(spatial.great_circle(np.array([x]), np.array([y]), np.array([u]), np.array([v]))[0]) <= metres:
                out.add((min(k, l), max(k, l)))
    return out


def cloud(seed, n):
    rng = random.Random(seed)
    towns = [(10.0, 50.0), (179.9999, 14.0), (-179.99995, 14.0), (30.0, 89.99995), (-100.0, 89.99996), (0.0, -90.0), (0.0, 0.0), (45.0, 45.0)]
    return [(f"v{i}", max(-180.0, min(180.0, x + rng.gauss(0, 2e-4))), max(-90.0, min(90.0, y + rng.gauss(0, 1e-4)))) for i in range(n) for x, y in [rng.choice(towns)]]


@pytest.mark.parametrize("leaf", [15, 100_000])
def test_near_equals_brute_force(spark, leaf):
    rows = cloud(leaf, 700) + [("v1", 10.0, 50.0), ("dup", 10.0, 50.0), ("dup", 10.0, 50.0), ("nul", None, 50.0), ("nan", math.nan, 1.0), ("out", 999.0, 0.0), (None, 10.0, 50.0), ("east", 180.0, 14.0), ("west", -180.0, 14.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    got = [(r.key_a, r.key_b) for r in spatial.near_pairs(df, "id", "x", "y", 10.0, leaf_points=leaf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([r for r in rows if r[1] is None or not math.isnan(r[1])], 10.0)
    assert ("east", "west") in got


def test_crowded_leaf_is_cut_into_chunks(spark):
    rows = [(f"k{i:04d}", 5.0, 5.0) for i in range(300)]
    got = spatial.near_pairs(spark.createDataFrame(rows, "id string, x double, y double"), "id", "x", "y", 1.0, leaf_points=10)
    assert got.count() == 300 * 299 // 2
    far = [(f"k{i:04d}", 5.0 + 1e-3 * (i % 40), 5.0) for i in range(300)]
    got = {(r.key_a, r.key_b) for r in spatial.near_pairs(spark.createDataFrame(far, "id string, x double, y double"), "id", "x", "y", 120.0, leaf_points=8).collect()}
    assert got == brute(far, 120.0)


def test_near_empty(spark):
    assert spatial.near_pairs(spark.createDataFrame([], "id string, x double, y double"), "id", "x", "y", 10.0).count() == 0


AREAS = [
    ("square", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), ("two", "  multipolygon(((20 0,30 0,30 10,20 10,20 0)) , ((40 0, 50 0, 50 10, 40 10)))"),
    ("over", "Polygon((5 5,25 5,25 8,5 8,5 5))"), ("null", None), ("junk", "POINT (1 1)"), ("", "POLYGON EMPTY"), (None, "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("square", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
]


@pytest.mark.parametrize("leaf", [20_000, 2])
def test_inside(spark, leaf):
    points = [(1, 1.0, 1.0), (2, 5.0, 5.5), (3, 22.0, 6.0), (4, 45.0, 5.0), (5, 35.0, 5.0), (6, None, 1.0), (7, math.nan, 1.0), (8, math.inf, 1.0), (None, 1.0, 1.0), (9, 7.0, 7.0), (9, 7.0, 7.0)]
    df = spark.createDataFrame(points, "edge long, x double, y double")
    areas = spark.createDataFrame(AREAS, "area string, wkt string")
    got = sorted(tuple(r) for r in spatial.inside_regions(df, "edge", "x", "y", areas, "area", "wkt", leaf_points=leaf).collect())
    assert got == [(1, "square"), (2, "over"), (3, "over"), (3, "two"), (4, "two"), (9, "over"), (9, "over"), (9, "square"), (9, "square")]
    assert spatial.inside_regions(df.limit(0), "edge", "x", "y", areas, "area", "wkt", leaf_points=leaf).count() == 0
    assert spatial.inside_regions(df, "edge", "x", "y", areas.limit(0), "area", "wkt", leaf_points=leaf).count() == 0
    assert spatial.inside_regions(df, "edge", "x", "y", areas.withColumnRenamed("area", "edge"), "edge", "wkt", leaf_points=leaf).columns == ["edge", "edge_"]


def test_rtree_equals_scan():
    rng = np.random.default_rng(1)
    lo = rng.uniform(0, 1, (1000, 2))
    hi = lo + rng.uniform(0, 0.05, (1000, 2))
    tree = spatial.RTree(lo[:, 0], lo[:, 1], hi[:, 0], hi[:, 1])
    q, e = tree.query(lo[:50, 0], lo[:50, 1], hi[:50, 0], hi[:50, 1])
    want = {(i, j) for i in range(50) for j in range(1000) if (lo[j] <= hi[i]).all() and (hi[j] >= lo[i]).all()}
    assert set(zip(q.tolist(), e.tolist())) == want
    assert len(spatial.RTree(*np.empty((4, 0))).query(lo[:2, 0], lo[:2, 1], hi[:2, 0], hi[:2, 1])[0]) == 0


def test_pairs_of_far_points_are_bounded():
    """Points far from everything hold all of it in their circles; a padded entry of the tree is never the nearest."""
    import numpy as np

    from wayloom.operators.spatial import RTree

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=5000) ** 3, rng.normal(size=5000) ** 3
    tree = RTree(x, y, x, y)
    px, py = rng.normal(size=300) ** 3, rng.normal(size=300) ** 3
    nearest = np.hypot(px[:, None] - x, py[:, None] - y)
    got = nearest[np.arange(300), tree.near_one(px, py)]
    assert np.mean(got <= nearest.min(1) * 1.5 + 1e-12) > 0.95
    assert tree.query(px - 99, py - 99, px + 99, py + 99, most=100_000) is None
    q, _ = tree.query(px[:1] - 99, py[:1] - 99, px[:1] + 99, py[:1] + 99, most=10)
    assert len(q) == np.sum((abs(x - px[0]) <= 99) & (abs(y - py[0]) <= 99))


def test_matching_a_few_points_at_a_time(spark, monkeypatch):
    from wayloom.operators import match

    v = spark.createDataFrame([(f"v{i:03d}", float(i % 17), float(i % 13)) for i in range(300)], "id string, x double, y double")
    p = spark.createDataFrame([(i, 900.0 + i, -400.0) for i in range(40)], "k int, x double, y double")
    want = sorted(map(tuple, match.points_to_vertices(p, "k", "x", "y", v).collect()))
    monkeypatch.setattr(match, "MAX_PAIRS", 50)
    assert sorted(map(tuple, match.points_to_vertices(p, "k", "x", "y", v).collect())) == want and len(want) == 40
