"""Joins by distance on shared grid cells.

One side is filed under its cell, the other under its cell and the eight around it; cells are at
least as wide as the radius, so an equi-join on the cell sees every pair within it, and the exact
distance decides. Catalyst gets an ordinary equi-join. Filing makes several rows of one, which the planner's
estimates leave out, so these joins are never broadcast; AQE splits a crowded cell.
"""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.functions.geo import DEGREE_M, distance_m


def cell_degrees(radius_m: float, max_abs_lat: float) -> tuple[float, float]:
    """Cell height and width in degrees for a radius, up to a latitude."""
    high = radius_m / DEGREE_M * 1.05
    return high, high / max(cos(radians(min(max_abs_lat, 85.0))), 0.05)


def near(left: DataFrame, right: DataFrame, radius_m: float, max_abs_lat: float = 60.0, on: list[str] | None = None) -> DataFrame:
    """Pairs of left and right rows (columns lon, lat on both; else distinct names) within a radius, with distance_m.

    right's lon and lat come back as lon_r and lat_r. on: further columns that must be equal.
    """
    high, wide = cell_degrees(radius_m, max_abs_lat)
    ls = left.withColumns({"cell_x": F.floor(F.col("lon") / wide), "cell_y": F.floor(F.col("lat") / high)})
    rs = right.withColumnsRenamed({"lon": "lon_r", "lat": "lat_r"})
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    rs = rs.withColumn("cell_x", F.explode(F.transform(around, lambda d: F.floor(F.col("lon_r") / wide) + d)))
    rs = rs.withColumn("cell_y", F.explode(F.transform(around, lambda d: F.floor(F.col("lat_r") / high) + d)))
    pairs = ls.join(rs.hint("merge"), ["cell_x", "cell_y", *(on or [])])
    pairs = pairs.withColumn("distance_m", distance_m(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r")))
    return pairs.filter(F.col("distance_m") <= radius_m).drop("cell_x", "cell_y")


def self_pairs(points: DataFrame, radius_m: float, key: str = "id", max_abs_lat: float = 60.0) -> DataFrame:
    """a, b (a < b), distance_m for points(key, lon, lat) within a radius."""
    own = points.select(F.col(key).alias("a"), "lon", "lat")
    other = points.select(F.col(key).alias("b"), "lon", "lat")
    return near(own, other, radius_m, max_abs_lat).filter("a < b").select("a", "b", "distance_m")


def nearest_k(left: DataFrame, right: DataFrame, radius_m: float, k: int, left_key: str, right_key: str) -> DataFrame:
    """For each left row the k nearest right ones within a radius, ties (within a millimetre) by right_key, with `rank`."""
    order = Window.partitionBy(left_key).orderBy(F.round("distance_m", 3), right_key)
    return near(left, right, radius_m).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def areas_near(points: DataFrame, areas: DataFrame, radius_m: float, measure: Column, inside: Column, on: list[str] | None = None) -> DataFrame:
    """Points with areas(west, south, east, north, rings) within a radius of them. on: further columns that must be equal.

    Areas are filed under all cells that their box, grown by the radius, touches; measure and
    inside are Columns over the joined row (points' lon and lat, areas' rings).
    """
    high, wide = cell_degrees(radius_m, 60.0)
    xs = F.sequence(F.floor((F.col("west") - wide) / wide), F.floor((F.col("east") + wide) / wide))
    ys = F.sequence(F.floor((F.col("south") - high) / high), F.floor((F.col("north") + high) / high))
    filed = areas.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))
    own = points.withColumns({"cell_x": F.floor(F.col("lon") / wide), "cell_y": F.floor(F.col("lat") / high)})
    found = own.join(filed.hint("merge"), ["cell_x", "cell_y", *(on or [])]).drop("cell_x", "cell_y")
    return found.withColumns({"distance_m": measure, "inside": inside}).filter(F.col("distance_m") <= radius_m)


