"""Hierarchical clusters of points: all zooms from 16 to 0, each from the one above it.

At a zoom, points are taken in a fixed order; a point that is not taken yet becomes a centre and takes all points within
the radius that are not taken. That is the first maximal independent set in that order, and it is found in rounds instead
of one by one: a point becomes a centre as soon as no undecided point before it lies within the radius, which takes those around
it out. The order is that of hashed ids, which keeps the number of rounds to a few, whatever the places. Points then
join the first centre within the radius, and a cluster goes into the next zoom as one point at its weighted mean.

All points of a grid cell (side: the radius / 1.43, so that a cell's diagonal is within the radius) exclude each other. Hence a
round has one candidate a cell and a zoom one centre a cell, and joining them with the points of the 25 cells around
meets each point at most 25 times: rows grow with the points, not with the pairs in a dense place, and no cell's points
are gathered. Means are rounded, so that the order of additions does not move a point over the radius.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .markers import located

#: Radius in pixels of tiles of EXTENT pixels, zooms, and the least number of listings in a cluster.
RADIUS, EXTENT, FINEST, COARSEST, LEAST = 220.0, 512.0, 16, 0, 2
#: Digits of a place on the unit square of the projection (0.04 mm).
DIGITS = 12


def projected(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Web mercator on the unit square; beyond its edge, the edge."""
    s = F.sin(F.radians(latitude))
    y = F.lit(0.5) - F.lit(0.25) * F.log((1 + s) / (1 - s)) / F.lit(math.pi)
    return longitude / 360 + 0.5, F.when(latitude >= 90, 0.0).when(latitude <= -90, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def unprojected(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(2 * F.atan(F.exp((1 - 2 * y) * math.pi))) - 90, (x - 0.5) * 360


def places(listings: DataFrame) -> DataFrame:
    """Points of the listings that are shown on the map; those of one place are one point, named by the least id."""
    at = located(listings).groupBy("latitude", "longitude").agg(F.count("*").alias("cnt"), F.min("id").alias("id"))
    x, y = projected(F.col("latitude"), F.col("longitude"))
    return at.select("id", F.xxhash64("id").alias("h"), F.round(x, DIGITS).alias("x"), F.round(y, DIGITS).alias("y"), "cnt", F.when(F.col("cnt") > 1, FINEST + 1).alias("splits_at"))


def _side(zoom: int, radius: float) -> tuple[float, float]:
    r = radius / (EXTENT * 2**zoom)
    return r, r / 1.43


def _celled(points: DataFrame, side: float) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})


def _around(centres: DataFrame) -> DataFrame:
    """(c: struct, cx, cy): each centre under the 25 cells within two of its own."""
    steps = [F.lit(k) for k in range(-2, 3)]
    c = F.struct("h", "id", "x", "y").alias("c")
    wide = centres.select(c, F.explode(F.transform(F.array(*steps), lambda d: F.col("cx") + d)).alias("cx"), "cy")
    return wide.select("c", "cx", F.explode(F.transform(F.array(*steps), lambda d: F.col("cy") + d)).alias("cy"))


def _near(points: DataFrame, centres: DataFrame, r: float) -> DataFrame:
    """Points with the centres within the radius."""
    met = points.join(_around(centres), ["cx", "cy"])
    dx, dy = F.col("x") - F.col("c.x"), F.col("y") - F.col("c.y")
    return met.where(dx * dx + dy * dy <= r * r)


def centres(points: DataFrame, r: float, stage: Stage) -> DataFrame:
    """The centres of a zoom (id, h, x, y, cx, cy), in rounds; each round writes those that are still undecided."""
    undecided, found = points.select("id", "h", "x", "y", "cx", "cy"), []
    while True:
        first = undecided.groupBy("cx", "cy").agg(F.min(F.struct("h", "id", "x", "y")).alias("m")).select("m.*", "cx", "cy")
        near = _near(undecided, first, r)
        blocked = near.where(F.struct("h", "id") < F.struct("c.h", "c.id")).select(F.col("c.id").alias("id"))
        fresh = stage.put(first.join(blocked, "id", "left_anti"))
        found.append(fresh)
        seen = Observation()
        left = undecided.join(_near(undecided, fresh, r).select("id"), "id", "left_anti")
        undecided = stage.put(left.observe(seen, F.count("*").alias("n")))
        if not seen.get["n"]:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def zoomed_out(points: DataFrame, zoom: int, stage: Stage, radius: float = RADIUS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The points of a zoom from those of the next finer one, and which of them (``id``) went into which (``parent``)."""
    r, side = _side(zoom, radius)
    points = _celled(points, side)
    first = F.min(F.struct("c.h", "c.id")).alias("first")
    joined = _near(points, centres(points, r, stage), r).groupBy("id").agg(first)
    members = stage.put(points.drop("cx", "cy").join(joined, "id").withColumn("parent", F.col("first.id")).drop("first"))
    if least > 2:  # groups of fewer stay as they are
        few = members.groupBy("parent").agg(F.sum("cnt").alias("n")).where(F.col("n") < least).select("parent", F.lit(True).alias("few"))
        members = stage.put(members.join(few, "parent", "left").withColumn("parent", F.when(F.col("few"), F.col("id")).otherwise(F.col("parent"))).drop("few"))
    mean = lambda c: F.when(F.count("*") == 1, F.first(c)).otherwise(F.round(F.sum(F.col(c) * F.col("cnt")) / F.sum("cnt"), DIGITS)).alias(c)
    splits = F.when(F.count("*") > 1, zoom + 1).otherwise(F.first("splits_at")).alias("splits_at")
    made = members.groupBy(F.col("parent").alias("id")).agg(mean("x"), mean("y"), splits, F.sum("cnt").alias("cnt"))
    return stage.put(made.withColumn("h", F.xxhash64("id"))), members.select("id", "parent")


def _level(levels: DataFrame | None, level: DataFrame) -> DataFrame:
    return level if levels is None else levels.unionByName(level)


def hierarchy(listings: DataFrame, finest: int = FINEST, coarsest: int = COARSEST, radius: float = RADIUS, least: int = LEAST) -> DataFrame:
    """(zoom, id, cnt, latitude, longitude, x, y, splits_at, parent) of all points from the finest zoom to the coarsest.

    ``id`` is the centre's; ``splits_at`` the least zoom at which the cluster is several markers (null for one listing);
    ``parent`` the point of the next coarser zoom that it is part of.
    """
    stage = Stage(listings.sparkSession, "clusters")
    points, out, columns = stage.put(places(listings)), None, ["id", "cnt", "x", "y", "splits_at"]
    for zoom in range(finest, coarsest - 1, -1):
        finer = points
        points, parents = zoomed_out(finer, zoom, stage, radius, least)
        if zoom < finest:
            out = _level(out, finer.select(F.lit(zoom + 1).alias("zoom"), *columns).join(parents, "id", "left"))
        if points.limit(2).count() < 2:  # one point stays as it is
            for same in range(zoom, coarsest, -1):
                out = _level(out, points.select(F.lit(same).alias("zoom"), *columns, F.col("id").alias("parent")))
            break
    out = _level(out, points.select(F.lit(coarsest).alias("zoom"), *columns, F.lit(None).cast("long").alias("parent")))
    latitude, longitude = unprojected(F.col("x"), F.col("y"))
    return out.withColumns({"latitude": latitude, "longitude": longitude})


def viewport(levels: DataFrame, zoom: int, box: tuple[float, float, float, float]) -> DataFrame:
    """The markers of a zoom within (south, west, north, east)."""
    inside = F.col("latitude").between(box[0], box[2]) & F.col("longitude").between(box[1], box[3])
    return levels.where((F.col("zoom") == zoom) & inside)


#: Most listings that are shown one by one, listings below which a filtered map shows them so, and most that a filtered map clusters.
SINGLE, FEW, FILTERED = 5000, 50, 50_000


def shown(listings: DataFrame, box: tuple[float, float, float, float], zoom: int, levels: DataFrame | None = None) -> DataFrame:
    """(kind, id, cnt, latitude, longitude) of what the map shows: listings from zoom 17 on, else clusters.

    Without ``levels`` the listings are a filter's result: few of them are shown one by one, more are clustered as they are.
    """
    inside = F.col("latitude").between(box[0], box[2]) & F.col("longitude").between(box[1], box[3])
    rows = located(listings).where(inside)
    if zoom > FINEST or levels is None and rows.limit(FEW + 1).count() <= FEW:
        return rows.orderBy("id").limit(SINGLE).select(F.lit("listing").alias("kind"), "id", F.lit(1).cast("long").alias("cnt"), "latitude", "longitude")
    found = levels if levels is not None else hierarchy(rows.orderBy("id").limit(FILTERED), FINEST, max(COARSEST, zoom))
    return viewport(found, max(COARSEST, zoom), box).select(F.when(F.col("cnt") > 1, "cluster").otherwise("listing").alias("kind"), "id", "cnt", "latitude", "longitude")
