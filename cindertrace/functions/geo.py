"""Scalar geography as Column expressions: local WGS84 scale, distances, boxes, tiles."""

from __future__ import annotations

from math import pi

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis and squared eccentricity.
A, E2 = 6378137.0, 0.00669437999014
#: Metres in a degree that a prefilter may count on anywhere.
DEGREE_M = 111_000.0


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres in a degree of latitude and of longitude at a latitude."""
    phi = F.radians(lat)
    w = F.sqrt(1 - E2 * F.pow(F.sin(phi), F.lit(2)))
    return pi / 180 * A * (1 - E2) / (w * w * w), pi / 180 * A * F.cos(phi) / w


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points (a few kilometres), by the scale at their middle latitude."""
    north, east = metres_per_degree((lat1 + lat2) / 2)
    return F.sqrt(F.pow((lat1 - lat2) * north, F.lit(2)) + F.pow((lon1 - lon2) * east, F.lit(2)))


def in_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """For (west, south, east, north)."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_covers_circle(west: Column, south: Column, east: Column, north: Column, lon: Column, lat: Column, radius_m: Column | float) -> Column:
    up, across = metres_per_degree(lat)
    dy, dx = radius_m / up, radius_m / across
    return (lon - dx >= west) & (lon + dx <= east) & (lat - dy >= south) & (lat + dy <= north)


def support_radius_m(scan_km: Column, track_km: Column) -> Column:
    """Half a pixel's diagonal and 100 m; a nominal pixel where a side is unknown."""
    known = scan_km.isNotNull() & track_km.isNotNull()
    nominal = F.lit(0.375)
    return 500 * F.hypot(F.when(known, scan_km).otherwise(nominal), F.when(known, track_km).otherwise(nominal)) + 100


def support_basis(scan_km: Column, track_km: Column) -> Column:
    return F.when(scan_km.isNotNull() & track_km.isNotNull(), "SCAN_TRACK").otherwise("NOMINAL")


def tile_id(lon: Column, lat: Column) -> Column:
    """The name of the 3-degree tile by its south-west corner, as N21E069."""
    y, x = (F.floor(lat / 3) * 3).cast("int"), (F.floor(lon / 3) * 3).cast("int")
    return F.concat(F.when(y >= 0, "N").otherwise("S"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x >= 0, "E").otherwise("W"), F.lpad(F.abs(x).cast("string"), 3, "0"))


def circle_polygon(lon: Column, lat: Column, radius_m: Column, corners: int = 32) -> Column:
    """A closed ring of (lon, lat) around a point."""
    up, across = metres_per_degree(lat)
    turn = F.sequence(F.lit(0), F.lit(corners))
    return F.transform(turn, lambda k: F.struct(F.round(lon + radius_m * F.cos(k * 2 * pi / corners) / across, 7).alias("lon"), F.round(lat + radius_m * F.sin(k * 2 * pi / corners) / up, 7).alias("lat")))


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd containment of a point in rings (arrays of (lon, lat), closed): holes count out."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring) - 1
        edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
        hit = F.filter(edge, lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]))
        return F.when(n >= 3, F.size(hit)).otherwise(0)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, x: s + x) % 2 == 1


def ring_distance_m(lon: Column, lat: Column, rings: Column) -> Column:
    """Metres to the nearest edge of rings, on the plane around the point; 0 inside."""
    up, across = metres_per_degree(lat)

    def edge_distance(a: Column, b: Column) -> Column:
        ax, ay = (a["lon"] - lon) * across, (a["lat"] - lat) * up
        bx, by = (b["lon"] - lon) * across, (b["lat"] - lat) * up
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
        return F.sqrt(F.pow(ax + t * dx, F.lit(2)) + F.pow(ay + t * dy, F.lit(2)))

    def nearest(ring: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: edge_distance(F.get(ring, i), F.get(ring, i + 1))))

    return F.when(in_rings(lon, lat, rings), F.lit(0.0)).otherwise(F.array_min(F.transform(rings, nearest)))


def circle_overlap(lon: Column, lat: Column, radius_m: Column, rings: Column, valid: bool = False) -> Column:
    """The share of a circle that lies in a polygon, from 0 to 1.

    Rings are taken by the even-odd rule, in any order and direction. valid: they are as polygons.built()
    gives them (outer ones counter-clockwise, holes clockwise), or a single ring, so that need not be done here.

    On the plane around the point, each edge adds the signed area between itself, clipped to the circle,
    and the centre: sectors where it runs outside, triangles where it runs inside.
    """
    from cindertrace.functions.polygons import built

    rings = rings if valid else F.when(F.size(rings) == 1, rings).otherwise(F.coalesce(built(F.when(F.size(rings) > 1, rings)), F.array().cast("array<array<struct<lon:double,lat:double>>>")))
    up, across = metres_per_degree(lat)
    square = radius_m * radius_m
    zero, one = F.lit(0.0), F.lit(1.0)

    def sector(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        return square / 2 * F.atan2(ax * by - ay * bx, ax * bx + ay * by)

    # one step a lambda, so that each value is worked out once
    def line(ring: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return F.struct(((a["lon"] - lon) * across).alias("ax"), ((a["lat"] - lat) * up).alias("ay"), ((b["lon"] - lon) * across).alias("bx"), ((b["lat"] - lat) * up).alias("by"))

    def meet(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        size, along = dx * dx + dy * dy, e["ax"] * dx + e["ay"] * dy
        return F.struct(e.alias("e"), dx.alias("dx"), dy.alias("dy"), size.alias("size"), along.alias("along"), (along * along - size * (e["ax"] * e["ax"] + e["ay"] * e["ay"] - square)).alias("root"))

    def clip(m: Column) -> Column:
        reach = F.sqrt(F.greatest(m["root"], zero))
        return F.struct(m.alias("m"), F.greatest((-m["along"] - reach) / m["size"], zero).alias("t"), F.least((-m["along"] + reach) / m["size"], one).alias("u"))

    def ends(c: Column) -> Column:
        e, m = c["m"]["e"], c["m"]
        return F.struct(c.alias("c"), (e["ax"] + c["t"] * m["dx"]).alias("px"), (e["ay"] + c["t"] * m["dy"]).alias("py"), (e["ax"] + c["u"] * m["dx"]).alias("qx"), (e["ay"] + c["u"] * m["dy"]).alias("qy"))

    def swept(x: Column) -> Column:
        e, m = x["c"]["m"]["e"], x["c"]["m"]
        cut = sector(e["ax"], e["ay"], x["px"], x["py"]) + (x["px"] * x["qy"] - x["py"] * x["qx"]) / 2 + sector(x["qx"], x["qy"], e["bx"], e["by"])
        return F.when(m["size"] <= 0, 0.0).when((m["root"] <= 0) | (x["c"]["t"] >= x["c"]["u"]), sector(e["ax"], e["ay"], e["bx"], e["by"])).otherwise(cut)

    def area(ring: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: line(ring, i))
        for step in (meet, clip, ends, swept):
            steps = F.transform(steps, step)
        return F.aggregate(steps, zero, lambda s, x: s + x)

    total = F.aggregate(F.transform(rings, area), zero, lambda s, x: s + x)  # holes count down
    inside = F.when(F.size(rings) == 1, F.abs(total)).otherwise(total)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside / (pi * square)))


def convex_hull(points: Column) -> Column:
    """The hull of an array of (lon, lat) as an array, counter-clockwise from the least point: one point, two, or a ring (not closed)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<struct<lon:double,lat:double>>")
    def hull(rows: pa.Array) -> pa.Array:
        def one(own) -> list | None:
            if own is None:
                return None
            sides: list[list] = [[], []]
            ordered = sorted({(p["lon"], p["lat"]) for p in own})
            for side, run in zip(sides, (ordered, ordered[::-1]), strict=True):
                for p in run:
                    while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                        side.pop()
                    side.append(p)
            return [{"lon": x, "lat": y} for x, y in (ordered if len(ordered) < 2 else sides[0][:-1] + sides[1][:-1])]

        kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
        return pa.array([one(x) for x in rows.to_pylist()], kind)

    return hull(points)


def hull_centroid(hull: Column) -> Column:
    """(lon, lat) of the centre of a hull: of its points where it has no area, of its area otherwise."""
    n = F.size(hull)
    first = F.get(hull, 0)
    x = lambda i: F.get(hull, i)["lon"] - first["lon"]
    y = lambda i: F.get(hull, i)["lat"] - first["lat"]

    def total(value) -> Column:
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + value(i, (i + 1) % n))

    twice = total(lambda i, j: x(i) * y(j) - x(j) * y(i))
    lon = total(lambda i, j: (x(i) + x(j)) * (x(i) * y(j) - x(j) * y(i))) / (3 * twice)
    lat = total(lambda i, j: (y(i) + y(j)) * (x(i) * y(j) - x(j) * y(i))) / (3 * twice)
    plain = F.struct((total(lambda i, j: x(i)) / n + first["lon"]).alias("lon"), (total(lambda i, j: y(i)) / n + first["lat"]).alias("lat"))
    return F.when((n < 3) | (twice == 0), plain).otherwise(F.struct((lon + first["lon"]).alias("lon"), (lat + first["lat"]).alias("lat")))
