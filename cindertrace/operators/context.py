"""What is mapped around observations: snapshots as of a time, candidates, and how far they explain a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.functions import geo
from cindertrace.operators.rules import first_match
from cindertrace.operators.spatial import areas_near

# How far candidates are looked for, and how many are kept.
CONTEXT_M, MOST_CANDIDATES, MOST_FEATURES = 2000.0, 50, 2000


def covering(points: DataFrame, boxes: DataFrame, radius_m: Column) -> DataFrame:
    """points(lon, lat, ...) with each of boxes(west, south, east, north, ...) that covers the circle around them.

    Boxes are filed under the whole degrees that they touch, so this is an equi-join; they are a few
    degrees wide at most.
    """
    xs, ys = F.sequence(F.floor("west"), F.floor("east")), F.sequence(F.floor("south"), F.floor("north"))
    filed = boxes.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))
    own = points.withColumns({"_x": F.floor("lon"), "_y": F.floor("lat")})
    return own.join(filed, ["_x", "_y"]).drop("_x", "_y").filter(geo.box_covers_circle(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("lon"), F.col("lat"), radius_m))


def newest_snapshot(points: DataFrame, snapshots: DataFrame, key: str, radius_m: Column, received_by: Column | None = None) -> DataFrame:
    """key, snapshot_id, base_at: the newest snapshot that covers each point's circle and was received by a time.

    Ties go to the lesser snapshot_id. Points without one are left out.
    """
    found = covering(points, snapshots, radius_m)
    if received_by is not None:
        found = found.filter(F.col("received_at") <= received_by)
    best = found.groupBy(key).agg(F.max_by(F.struct("snapshot_id", "base_at"), F.struct("base_at", -F.col("snapshot_id"))).alias("s"))
    return best.select(key, "s.snapshot_id", "s.base_at")


def candidates(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Mapped areas of a point's own snapshot within CONTEXT_M of points(key, lon, lat, radius_m, snapshot_id), nearest first.

    The areas' rings are as polygons.built() gives them.
    Adds to the areas' columns: distance_m, inside (the point lies in it), relation, overlap (the share of
    the support circle that it takes, where it reaches it), rank (to MOST_CANDIDATES) and truncated.
    """
    lon, lat, rings = F.col("lon"), F.col("lat"), F.col("rings")
    found = areas_near(points, areas, CONTEXT_M, geo.ring_distance_m(lon, lat, rings), geo.in_rings(lon, lat, rings), ["snapshot_id"])
    found = found.withColumn("inside", F.round("distance_m", 3) == 0)  # on an edge is inside
    reached = F.col("distance_m") <= F.col("radius_m")
    found = found.withColumns({"relation": F.when(reached, "INSIDE_SUPPORT").otherwise("NEARBY"), "overlap": F.when(reached, F.round(geo.circle_overlap(lon, lat, F.col("radius_m"), rings, True), 4))})
    own = Window.partitionBy(key)
    found = found.withColumns({"rank": F.row_number().over(own.orderBy(F.round("distance_m", 3), "fac_id")), "truncated": F.count("*").over(own) > MOST_CANDIDATES})
    return found.filter(F.col("rank") <= MOST_CANDIDATES)


def association(inside: Column, found: Column, covered: Column) -> Column:
    """inside, found: how many candidates reach the support, and how many there are."""
    return first_match((~covered, "CONTEXT_NOT_COVERED"), (F.coalesce(inside, F.lit(0)) > 1, "MULTIPLE_MAPPED_FEATURES"), (F.coalesce(inside, F.lit(0)) == 1, "SINGLE_MAPPED_FEATURE"), (F.coalesce(found, F.lit(0)) > 0, "NEARBY_ONLY"), otherwise="NO_MAPPED_FEATURE_NEARBY")


def timing(base_at: Column, as_of: Column) -> Column:
    """Was the map already in this state then?"""
    return F.when(base_at > as_of, "RETROSPECTIVE").when(base_at.isNotNull(), "PRIOR_STATE")


def summary(found: DataFrame, key: str) -> DataFrame:
    """key, mapped, thermal, near_thermal, types, flare, candidates: what the rules and features need of candidates()."""
    inside = F.col("relation") == "INSIDE_SUPPORT"
    hot = inside & F.col("thermal_candidate")
    document = F.struct("rank", "fac_id", "facility_type", "primary_tag", F.round("distance_m", 1).alias("distance_m"), "inside", "overlap", "relation", "thermal_candidate")
    return found.groupBy(key).agg(
        F.count_if(inside).alias("mapped"), F.count_if(hot).alias("thermal"), F.count_if(~inside & F.col("thermal_candidate")).alias("near_thermal"), F.count("*").alias("found"),
        F.array_sort(F.collect_set(F.when(hot, F.col("facility_type")))).alias("types"), F.coalesce(F.bool_or(hot & (F.col("primary_tag") == "man_made=flare")), F.lit(False)).alias("flare"),
        F.bool_or("truncated").alias("truncated"), F.array_sort(F.collect_list(document)).alias("candidates"),
    )


def feature_layer(features: DataFrame, box: tuple[float, float, float, float], most: int = MOST_FEATURES) -> DataFrame:
    """Mapped features whose box meets a window: at most `most`, and whether there are more (one more is read)."""
    own = tuple(F.col(c) for c in ("west", "south", "east", "north"))
    some = features.filter(geo.boxes_overlap(own, tuple(map(F.lit, box)))).orderBy("fac_id").limit(most + 1)
    every = Window.partitionBy()  # of most + 1 rows
    return some.withColumns({"truncated": F.count("*").over(every) > most, "_n": F.row_number().over(every.orderBy("fac_id"))}).filter(F.col("_n") <= most).drop("_n")
