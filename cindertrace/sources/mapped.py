"""Mapped features: type rules, power context, geometry from elements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrace.functions.polygons import built
from cindertrace.operators.rules import first_match
from cindertrace.shipping import ship


def tag(tags: Column, key: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))))


def facility_type(tags: Column) -> Column:
    industrial, made, power, product, landuse = (tag(tags, k) for k in ("industrial", "man_made", "power", "product", "landuse"))
    lng = (industrial == "lng") | (product == "lng") | (tag(tags, "content") == "lng") | (tag(tags, "substance") == "lng")
    return first_match(
        (lng | (industrial == "lng_terminal"), "LNG"),
        (industrial.isin("refinery", "oil_refinery", "oil") | ((made == "works") & product.isin("oil", "petroleum", "petrol", "diesel")), "REFINERY"),
        (industrial.isin("chemical", "petrochemical"), "PETROCHEMICAL"),
        (industrial.isin("steel", "steelmaking", "steelworks", "iron_works", "metallurgy") | product.isin("steel", "iron"), "STEEL"),
        (power.isin("plant", "generator"), "POWER"),
        ((landuse == "quarry") | industrial.isin("mine", "mining", "quarry") | (made == "mineshaft"), "MINE"),
        (((industrial != "") & (industrial != "yes")) | (made == "kiln"), "OTHER"),
        otherwise="UNKNOWN",
    )


def primary_tag(tags: Column) -> Column:
    keys = ("man_made", "power", "industrial", "landuse")
    return F.coalesce(*[F.when(F.map_contains_key(tags, k), F.concat(F.lit(f"{k}="), F.element_at(tags, F.lit(k)))) for k in keys], F.lit("unknown"))


def name_of(tags: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(tags, F.lit("name:en")), F.lit("")), F.nullif(F.try_element_at(tags, F.lit("name")), F.lit("")))


def thermal_candidate(tags: Column) -> Column:
    """False for power sites whose sources are all renewable, or photovoltaic."""

    def either(key: str) -> Column:
        return F.coalesce(F.nullif(F.try_element_at(tags, F.lit(f"plant:{key}")), F.lit("")), F.nullif(F.try_element_at(tags, F.lit(f"generator:{key}")), F.lit("")))

    power = F.coalesce(F.try_element_at(tags, F.lit("power")), F.lit("")).isin("plant", "generator")
    parts = F.filter(F.transform(F.split(F.coalesce(either("source"), F.lit("")), ";"), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    renewable = (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin("solar", "wind", "hydro", "tidal", "wave"))
    return ~power | ~(renewable | (F.coalesce(either("method"), F.lit("")) == "photovoltaic"))


# The fuels that count as thermal.
THERMAL_FUELS = ("Coal", "Gas", "Oil", "Biomass", "Petcoke", "Cogeneration", "Waste")


def registry_plants(rows: DataFrame, country: str = "IND") -> DataFrame:
    """id, name, fuel, capacity_mw, year, lon, lat of a country's thermal plants; what is no number is null, what has no place is left out."""
    number = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).try_cast("double")
    own = rows.filter((F.col("country") == country) & F.col("primary_fuel").isin(*THERMAL_FUELS))
    out = own.select("id", F.substring(F.trim("name"), 1, 200).alias("name"), F.col("primary_fuel").alias("fuel"), number("capacity_mw").alias("capacity_mw"), number("commissioning_year").alias("year"), number("longitude").alias("lon"), number("latitude").alias("lat"))
    return out.filter(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))


RINGS = "array<array<struct<lon:double,lat:double>>>"
ELEMENT = "array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>>>"


def ring_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring, in square degrees around its first point (none for points on one line)."""
    o = F.get(ring, 0)
    x, y = (lambda i: F.get(ring, i)["lon"] - o["lon"]), (lambda i: F.get(ring, i)["lat"] - o["lat"])
    twice = F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, i: s + x(i) * y(i + 1) - x(i + 1) * y(i))
    return F.when((F.size(ring) < 4) | (F.abs(twice) < 1e-14), F.lit(0.0)).otherwise(twice)


def stitched(lines: Column) -> Column:
    """Closed rings from an array of lines that meet at their ends, whichever way they run; null if an end is left."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<array<struct<lon:double,lat:double>>>")
    def join(rows: pa.Array) -> pa.Array:
        def one(own) -> list | None:
            if own is None:
                return None
            left = [[(p["lon"], p["lat"]) for p in line] for line in own if line is not None and len(line) > 1]
            rings = []
            while left:
                ring = left.pop(0)
                while ring[0] != ring[-1]:
                    k = next((k for k, x in enumerate(left) if ring[-1] in (x[0], x[-1])), None)
                    if k is None:
                        return None
                    x = left.pop(k)
                    ring += (x if x[0] == ring[-1] else x[::-1])[1:]
                rings.append([{"lon": x, "lat": y} for x, y in ring])
            return rings or None

        kind = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
        return pa.array([one(x) for x in rows.to_pylist()], kind)

    return join(lines)


def payload_problem(payload: Column, most: int = 20_000) -> Column:
    """Why a map download cannot be used: no list of elements, cut short by the server, no base time, too many."""
    parsed = F.from_json(payload, F.lit("struct<elements:array<struct<type:string>>,remark:string,osm3s:struct<timestamp_osm_base:string>>"))
    n = F.size(parsed["elements"])
    return (
        F.when(parsed["elements"].isNull(), "NO_ELEMENTS").when(F.coalesce(parsed["remark"].contains("runtime error"), F.lit(False)), "INCOMPLETE")
        .when(F.try_to_timestamp(parsed["osm3s"]["timestamp_osm_base"]).isNull(), "NO_BASE_TIME").when(n > most, "TOO_MANY_ELEMENTS")
    )


def elements(payloads: DataFrame) -> DataFrame:
    """One row for each element of payload(json): type, id, tags, rings, lon, lat, reason; the first of an id stays.

    rings are a valid polygon's (polygons.built), however the element draws it.
    """
    ship(payloads.sparkSession)
    parsed = payloads.select(F.from_json("json", f"struct<elements:{ELEMENT}>").alias("p"))
    rows = parsed.select(F.posexplode("p.elements").alias("at", "e")).select("at", "e.*")
    rows = rows.groupBy("type", "id").agg(F.min_by(F.struct("lat", "lon", "tags", "geometry", "members"), "at").alias("e")).select("type", "id", "e.*")
    closed = (F.size("geometry") >= 4) & (F.try_element_at("geometry", F.lit(1)) == F.try_element_at("geometry", F.lit(-1)))
    kinds = F.coalesce(F.try_element_at("tags", F.lit("type")), F.lit("")).isin("multipolygon", "boundary")
    lines = F.transform(F.filter("members", lambda m: (m["type"] == "way") & m["role"].isin("outer", "inner", "")), lambda m: m["geometry"])
    none = F.lit(None).cast("array<array<struct<lon:double,lat:double>>>")
    rings = F.when((F.col("type") == "way") & closed, F.array("geometry")).when((F.col("type") == "relation") & kinds & (F.size(lines) > 0), lines).otherwise(none)
    rows = rows.withColumn("rings", rings)
    rows = rows.withColumn("rings", F.when(F.col("type") == "relation", stitched(F.col("rings"))).otherwise(F.col("rings")))
    rows = rows.withColumn("area", built(F.when(~F.exists(F.flatten("rings"), lambda p: p["lon"].isNull() | p["lat"].isNull()), F.col("rings"))))
    points = F.flatten("rings")
    outside = F.exists(points, lambda p: p["lon"].isNull() | p["lat"].isNull() | (F.abs(p["lon"]) > 180) | (F.abs(p["lat"]) > 90))
    reason = (
        F.when((F.col("type") == "node") & (F.col("lat").isNull() | F.col("lon").isNull()), "MISSING_COORDINATE")
        .when((F.col("type") == "node") & ((F.abs("lat") > 90) | (F.abs("lon") > 180)), "COORDINATE_OUT_OF_RANGE")
        .when((F.col("type") == "relation") & F.exists(F.coalesce("members", F.array().cast("array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>")), lambda m: (m["type"] == "way") & m["geometry"].isNull()), "INCOMPLETE_RELATION")
        .when((F.col("type") == "way") & F.col("rings").isNull(), "OPEN_WAY")
        .when((F.col("type") == "relation") & (~kinds | (F.size(lines) == 0) | lines.isNull()), "UNSUPPORTED_RELATION")
        .when((F.col("type") == "relation") & F.col("rings").isNull(), "OPEN_RING")
        .when((F.col("type") != "node") & outside, "COORDINATE_OUT_OF_RANGE")
        .when((F.col("type") != "node") & ~F.coalesce(F.exists("area", lambda r: F.abs(ring_area(r)) > 0), F.lit(False)), "INVALID_GEOMETRY")
    )
    return rows.select("type", "id", "tags", F.col("area").alias("rings"), "lon", "lat", reason.alias("reason"))
