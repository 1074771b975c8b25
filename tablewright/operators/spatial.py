"""Joins of points with areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import geo


def point_in_polygon_join(points: DataFrame, areas: DataFrame, xy: tuple[str, str], polygon: str, cell: float) -> DataFrame:
    """Pairs of a point and an area that holds it.

    Areas are listed in every grid cell of their bounding box; a point looks in its
    own cell only. Choose ``cell`` near the size of a typical area. Equal points and
    equal areas are matched once.
    """
    x, y = xy
    to_cell = lambda c: F.floor(c / F.lit(cell))
    b = geo.bounding_box(F.col(polygon))
    shapes = (
        areas.select(F.col(polygon).alias("__poly")).distinct()
        .withColumn("__box", geo.bounding_box(F.col("__poly")))
        .withColumn("__cx", F.explode(F.sequence(to_cell(F.col("__box.x2")), to_cell(F.col("__box.x1")))))
        .withColumn("__cy", F.explode(F.sequence(to_cell(F.col("__box.y2")), to_cell(F.col("__box.y1")))))
    )
    spots = points.select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct().withColumn("__cx", to_cell(F.col("__x"))).withColumn("__cy", to_cell(F.col("__y")))
    p = geo.point(F.col("__x"), F.col("__y"))
    hits = (
        spots.join(shapes, ["__cx", "__cy"]).filter(geo.box_contains_point(F.col("__box"), p) & geo.polygon_contains(F.col("__poly"), p))
        .select("__x", "__y", "__poly")
    )
    left = points.withColumn("__x", F.col(x)).withColumn("__y", F.col(y))
    right = areas.withColumn("__poly", F.col(polygon))
    return left.join(hits, ["__x", "__y"]).join(right, "__poly").drop("__x", "__y", "__poly")
