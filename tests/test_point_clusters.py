"""Hierarchical clusters against one loop over all points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestead.operators import point_clusters as C

SCHEMA = "id long, latitude double, longitude double, is_active boolean"


@pytest.fixture(scope="module")
def points(spark):
    """Dense and sparse places around corners of tiles (longitude 0 and 11.25, latitude 0 and others), some twice, some not shown."""
    r, rows = random.Random(3), []
    for k, (lat, lng, wide) in enumerate([(0.0, 0.0, 0.004), (48.92, 11.25, 0.01), (48.92, 11.25, 3.0), (-40.97, 179.9, 0.05), (55.0, -90.0, 30.0)]):
        rows += [(1000 * k + n, lat + r.uniform(-wide, wide), lng + r.uniform(-wide, wide), True) for n in range(40)]
    rows += [(9000 + n, *rows[5 * n][1:]) for n in range(12)]
    rows += [(9100, 1.0, 1.0, False), (9101, None, 1.0, True), (9102, 89.99, 0.0, True), (9103, 90.0, 0.0, True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, finest, coarsest, radius, least):
    """Rows (id, h, x, y, cnt, splits) by the loop; {zoom: {id: (x, y, cnt, splits, parent)}}."""
    level, out = {r[0]: r for r in rows}, {}
    for zoom in range(finest, coarsest - 1, -1):
        limit, free, order = radius / (512 * 2**zoom), dict(level), sorted(level.values(), key=lambda p: (p[1], p[0]))
        parent, fresh = {}, {}
        for p in order:
            if p[0] not in free:
                continue
            near = [q for q in free.values() if (q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2 <= limit * limit]
            for q in near:
                del free[q[0]]
            n = sum(q[4] for q in near)
            if len(near) == 1 or n < least:
                for q in near:
                    fresh[q[0]], parent[q[0]] = q, q[0]
                continue
            mean = lambda i, near=near, n=n: round(sum(q[i] * q[4] for q in near) / n, 12)
            fresh[p[0]] = (p[0], p[1], mean(2), mean(3), n, zoom + 1)
            parent |= {q[0]: p[0] for q in near}
        if zoom < finest:
            out[zoom + 1] = {k: (*p[2:], parent[k]) for k, p in level.items()}
        level = fresh
    out[coarsest] = {k: (*p[2:], None) for k, p in level.items()}
    return out


@pytest.mark.parametrize(("finest", "coarsest", "radius", "least"), [(16, 0, 220.0, 2), (6, 3, 90.0, 4)])
def test_equals_one_loop(points, finest, coarsest, radius, least):
    wanted = brute([tuple(r) for r in C.places(points).select("id", "h", "x", "y", "cnt", "splits_at").collect()], finest, coarsest, radius, least)
    found = {}
    for r in C.hierarchy(points, finest, coarsest, radius, least).collect():
        found.setdefault(r.zoom, {})[r.id] = (r.x, r.y, r.cnt, r.splits_at, r.parent)
    assert sorted(found) == sorted(wanted)
    for zoom, rows in wanted.items():
        assert found[zoom].keys() == rows.keys()
        for k, row in rows.items():
            assert found[zoom][k][2:] == row[2:] and math.dist(found[zoom][k][:2], row[:2]) < 1e-11
        assert sum(p[2] for p in rows.values()) == 214
    assert found[coarsest].keys() != found[finest].keys()


def test_rows_of_a_dense_place_stay_in_proportion(spark):
    """All points in one cell meet one candidate each, not each other."""
    rows = spark.range(4000).select("id", (50 + F.rand(1) * 1e-4).alias("latitude"), (14 + F.rand(2) * 1e-4).alias("longitude"), F.lit(True).alias("is_active"))
    r, side = C._side(10, C.RADIUS)
    celled = C._celled(C.places(rows), side)
    first = celled.groupBy("cx", "cy").agg(F.min(F.struct("h", "id", "x", "y")).alias("m")).select("m.*", "cx", "cy")
    assert C._near(celled, first, r).count() <= 25 * 4000
    assert C.hierarchy(rows, 10, 10).count() <= 4


def test_empty_and_views(spark, points):
    assert C.hierarchy(points.limit(0), 3, 0).collect() == []
    box = (-90.0, -180.0, 90.0, 180.0)
    assert {r.kind for r in C.shown(points, box, 17).collect()} == {"listing"}
    assert C.shown(points.where("id < 30"), box, 2).count() == 30
    levels = C.hierarchy(points, 4, 2)
    whole = C.shown(points, box, 3, levels).collect()
    assert sum(r.cnt for r in whole) == 214 and {r.kind for r in whole} <= {"cluster", "listing"}
    assert sum(r.cnt for r in C.shown(points, box, 14).collect()) == 214
