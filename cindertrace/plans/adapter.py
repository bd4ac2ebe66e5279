"""The driver's tables seen as the domain's: for Spark as DataFrames, for the oracle as common table expressions.

Users sit about two kilometres apart, and one user's points lie within 400 m of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Reads what is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def obs(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        return self.read("events").select(
            e.alias("obs_id"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("acquired_at"),
            u.alias("place"),
            (69.5 + 0.02 * (u % 50) + 0.0005 * (e % 7)).alias("lon"),
            (22.0 + 0.02 * F.floor(u / 50) + 0.0005 * (e % 5)).alias("lat"),
            F.when(e % 11 != 0, F.col("value")).alias("frp_mw"),
            F.lit("N20").alias("satellite"),
            F.when(F.col("event_type").isin("click", "view"), "D").otherwise("N").alias("daynight"),
            F.when(e % 3 == 0, "SP").otherwise("NRT").alias("product"),
            F.element_at(F.array(F.lit("l"), F.lit("n"), F.lit("h")), (e % 3 + 1).cast("int")).alias("confidence"),
            (300 + F.col("value") % 60).alias("i4"),
            (280 + e % 20).cast("double").alias("i5"),
        )

    def archive(self) -> DataFrame:
        """obs() with the columns that only features and assessments need."""
        e = F.col("event_id")
        more = self.read("events").select(
            e.alias("obs_id"), F.when(e % 4 != 0, 0.3 + e % 9 * 0.05).alias("scan"), F.when(e % 4 != 0, 0.4 + e % 5 * 0.05).alias("track"), F.when(e % 6 != 0, e % 4).alias("nasa_type"),
            F.when(e % 4 != 3, F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.make_dt_interval(F.lit(0), (e % 5).cast("int") * 12)).alias("available_at"),
        )
        return self.obs().join(more.hint("merge"), "obs_id")  # as many rows as obs(), in few bytes of a file

    def passes(self) -> DataFrame:
        """Retrievals with the box that was asked for."""
        k = F.col("o_orderkey")
        start = F.date_add(F.lit("2023-08-01").cast("date"), (k * 7 % 185).cast("int"))
        west = 69.4 + 0.15 * (k % 8)
        return self.read("orders").select(
            k.alias("run_id"), start.alias("start_date"), F.date_add(start, (k % 4).cast("int")).alias("end_date"),
            F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise("FAILED").alias("status"), F.when(k % 5 == 0, "LIVE").otherwise("HISTORICAL_REPLAY").alias("mode"),
            F.when(k % 7 == 0, "SP").otherwise("NRT").alias("product"), (k % 6 == 0).cast("long").alias("rejected_rows"), F.date_add(start, (k % 30).cast("int")).cast("timestamp").alias("received_at"),
            west.alias("west"), F.lit(21.9).alias("south"), (west + 0.45).alias("east"), F.lit(23.5).alias("north"),
        )

    def snapshots(self) -> DataFrame:
        """States of the map, each over a box."""
        k = F.col("n_nationkey").cast("long")
        base = F.date_add(F.lit("2023-10-01").cast("date"), (k * 6).cast("int"))
        west = 69.3 + 0.1 * (k % 7)
        return self.read("nation").filter("n_nationkey % 5 != 4").select(k.alias("snapshot_id"), base.cast("timestamp").alias("base_at"), F.date_add(base, (3 + k % 3 * 30).cast("int")).cast("timestamp").alias("received_at"), west.alias("west"), F.lit(21.8).alias("south"), (west + 0.6).alias("east"), (22.3 + 0.2 * (k % 3)).alias("north"))

    def areas(self) -> DataFrame:
        """Facilities as squares, with what their tags say."""
        k, x, y = F.col("fac_id"), F.col("lon"), F.col("lat")
        h = 0.0005 * (1 + k % 4)
        corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
        ring = F.array(*[F.struct((x + a * h).alias("lon"), (y + b * h).alias("lat")) for a, b in corners])
        tags = F.when(k % 5 == 0, "man_made=flare").when(k % 5 == 1, "man_made=chimney").when(k % 5 == 2, "man_made=kiln").otherwise("industrial=yes")
        return self.facilities().select(k, "facility_type", tags.alias("primary_tag"), ((F.col("facility_type") != "POWER") | (k % 2 == 1)).alias("thermal_candidate"), F.array(ring).alias("rings"), (x - h).alias("west"), (y - h).alias("south"), (x + h).alias("east"), (y + h).alias("north"))

    def pixels(self) -> DataFrame:
        """Land-cover codes around places (by supplier number)."""
        k, p = F.col("l_suppkey"), F.col("l_partkey")
        at = F.when((k % 4 == 0) & (p % 3 > 0), 4).when((k % 4 == 1) & (p % 3 > 0), 1).otherwise(p % 6 + 1)
        return self.read("lineitem").select(k.alias("id"), F.element_at(F.array(*map(F.lit, (10, 20, 30, 40, 50, 7))), at.cast("int")).alias("code"), (p % 5 < 4).alias("close"))

    def runs(self) -> DataFrame:
        """Retrievals: a place and up to four days, some failed or with rejected rows."""
        k = F.col("o_orderkey")
        start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int"))
        return self.read("orders").select(
            k.alias("run_id"),
            (F.col("o_custkey") % 60).alias("place"),
            start.alias("start_date"),
            F.date_add(start, (k % 4).cast("int")).alias("end_date"),
            F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise("FAILED").alias("status"),
            F.when(k % 5 == 0, "LIVE").otherwise("HISTORICAL_REPLAY").alias("mode"),
            F.when(k % 7 == 0, "SP").otherwise("NRT").alias("product"),
        )

    def receipts(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") + 1).cast("long").alias("row_number"), F.col("l_partkey").alias("obs_id"))

    def facilities(self) -> DataFrame:
        k = F.col("s_suppkey")
        kinds = F.array(*map(F.lit, ("LNG", "REFINERY", "PETROCHEMICAL", "STEEL", "POWER", "MINE", "OTHER", "UNKNOWN")))
        return self.read("supplier").select(k.alias("fac_id"), (69.504 + 0.02 * (k % 50)).alias("lon"), (22.003 + 0.02 * F.floor(k / 50)).alias("lat"), F.element_at(kinds, F.col("s_nationkey") % 8 + 1).alias("facility_type"))

    def plants(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(k.alias("plant_id"), (69.49 + 0.007 * (k % 150)).alias("lon"), (21.99 + 0.007 * F.floor(k / 150)).alias("lat"), F.col("c_mktsegment").alias("fuel"))

    def places(self) -> DataFrame:
        return self.obs().groupBy("place").agg(F.min_by("lon", "obs_id").alias("lon"), F.min_by("lat", "obs_id").alias("lat"))

    def sites(self) -> DataFrame:
        """Places moved into threes with gaps between: the second lies within 2 km of the first, the third within 3 km of the second."""
        u = F.col("user_id")
        v = u % 50
        own = self.read("events").select(u.alias("site")).distinct().withColumn("user_id", F.col("site"))
        return own.select("site", F.concat(F.lit("r"), (F.floor(v / 3) % 4).cast("string")).alias("region_id"), (69.5 + 0.08 * F.floor(v / 3) + F.when(v % 3 == 0, 0.0).when(v % 3 == 1, 0.015).otherwise(0.0405)).alias("lon"), (22.0 + 0.08 * F.floor(u / 50)).alias("lat"))

    def site_plants(self) -> DataFrame:
        """Registered plants between the second and the third site of a three; those of two kinds only are known."""
        k = F.col("c_custkey")
        v = k % 50
        return self.read("customer").filter(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY")).select(k.alias("fac_id"), (69.5 + 0.08 * F.floor(v / 3) + 0.02775).alias("lon"), (22.0 + 0.08 * F.floor(k / 50)).alias("lat"))

    def site_areas(self) -> DataFrame:
        """Mapped areas beside the first sites of threes."""
        k = F.col("s_suppkey")
        v = k % 50
        return self.read("supplier").select(k.alias("fac_id"), (69.5 + 0.08 * F.floor(v / 3) + 0.004).alias("lon"), (22.0 + 0.08 * F.floor(k / 50)).alias("lat"))

    def cases(self) -> DataFrame:
        k = F.col("event_id")
        return self.read("events").select(k.alias("id"), F.concat(F.lit("r"), (F.col("user_id") % 6).cast("string")).alias("region_id"), F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("split_group"), (k % 2 + 1).alias("review_slots"), F.when(k % 5 == 0, "INDUSTRIAL").alias("silver"), F.when(k % 7 == 0, "UNKNOWN").when(k % 7 < 4, "AGRICULTURAL_BURN").alias("weak"))

    def reviews(self) -> DataFrame:
        """The lines of an order, all of them, as reviews of the case of its number."""
        q = F.col("l_quantity").cast("long")
        label = F.when(q % 4 == 0, "INDUSTRIAL").when(q % 4 == 1, "INDUSTRIAL").when(q % 4 == 2, "VEGETATION_FIRE").otherwise("UNRESOLVED")
        line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
        return self.read("lineitem").withColumn("k", F.row_number().over(line)).select(
            F.col("l_orderkey").alias("id"), F.col("k").cast("long").alias("seq"), F.when(F.col("l_returnflag") == "R", "ADJUDICATOR").otherwise("REVIEWER").alias("role"),
            label.alias("source_label"), F.when(q % 3 == 0, "HIGH").when(q % 3 == 1, "MEDIUM").otherwise("LOW").alias("certainty"), (q % 2 == 0).alias("inside"), (F.col("l_suppkey") % 2 == 0).alias("qualifies"),
        )

    def predictions(self) -> DataFrame:
        k, p = F.col("l_orderkey"), (F.col("l_quantity") * 2 - 1) / 100
        return self.read("lineitem").select(k.alias("id"), ((F.col("l_partkey") + F.col("l_linenumber")) % 2).cast("int").alias("y"), p.alias("p"), (p >= 0.5).cast("int").alias("pred"), (F.col("l_suppkey") % 10).alias("grp"))


#: The same tables in SQL.
CTE = {
    "obs": """obs AS (SELECT event_id AS obs_id, date_trunc('hour', ts) AS acquired_at, user_id AS place,
  CAST(69.5 + 0.02*(user_id % 50) + 0.0005*(event_id % 7) AS DOUBLE) AS lon,
  CAST(22.0 + 0.02*floor(user_id / 50) + 0.0005*(event_id % 5) AS DOUBLE) AS lat,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS frp_mw, 'N20' AS satellite,
  CASE WHEN event_type IN ('click','view') THEN 'D' ELSE 'N' END AS daynight,
  CASE WHEN event_id % 3 = 0 THEN 'SP' ELSE 'NRT' END AS product, CASE event_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'n' ELSE 'h' END AS confidence,
  300 + value % 60 AS i4, CAST(280 + event_id % 20 AS DOUBLE) AS i5 FROM events)""",
    "archive": """archive AS (SELECT o.*, CASE WHEN event_id % 4 <> 0 THEN 0.3::DOUBLE + event_id % 9 * 0.05::DOUBLE END AS scan, CASE WHEN event_id % 4 <> 0 THEN 0.4::DOUBLE + event_id % 5 * 0.05::DOUBLE END AS track,
  CASE WHEN event_id % 6 <> 0 THEN event_id % 4 END AS nasa_type, CASE WHEN event_id % 4 <> 3 THEN date_trunc('hour', ts) + to_hours(event_id % 5 * 12) END AS available_at FROM obs o JOIN events e ON e.event_id = o.obs_id)""",
    "passes": """passes AS (SELECT o_orderkey AS run_id, DATE '2023-08-01' + CAST(o_orderkey * 7 % 185 AS INTEGER) AS start_date, DATE '2023-08-01' + CAST(o_orderkey * 7 % 185 + o_orderkey % 4 AS INTEGER) AS end_date,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'PARTIAL' ELSE 'FAILED' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'LIVE' ELSE 'HISTORICAL_REPLAY' END AS mode, CASE WHEN o_orderkey % 7 = 0 THEN 'SP' ELSE 'NRT' END AS product,
  CAST(o_orderkey % 6 = 0 AS BIGINT) AS rejected_rows, CAST(DATE '2023-08-01' + CAST(o_orderkey * 7 % 185 + o_orderkey % 30 AS INTEGER) AS TIMESTAMP) AS received_at,
  69.4::DOUBLE + 0.15::DOUBLE * (o_orderkey % 8) AS west, 21.9::DOUBLE AS south, 69.4::DOUBLE + 0.15::DOUBLE * (o_orderkey % 8) + 0.45::DOUBLE AS east, 23.5::DOUBLE AS north FROM orders)""",
    "snapshots": """snapshots AS (SELECT CAST(n_nationkey AS BIGINT) AS snapshot_id, CAST(DATE '2023-10-01' + CAST(n_nationkey * 6 AS INTEGER) AS TIMESTAMP) AS base_at, CAST(DATE '2023-10-01' + CAST(n_nationkey * 6 + 3 + n_nationkey % 3 * 30 AS INTEGER) AS TIMESTAMP) AS received_at,
  69.3::DOUBLE + 0.1::DOUBLE * (n_nationkey % 7) AS west, 21.8::DOUBLE AS south, 69.3::DOUBLE + 0.1::DOUBLE * (n_nationkey % 7) + 0.6::DOUBLE AS east, 22.3::DOUBLE + 0.2::DOUBLE * (n_nationkey % 3) AS north FROM nation WHERE n_nationkey % 5 <> 4)""",
    "areas": """areas AS (SELECT fac_id, facility_type, CASE fac_id % 5 WHEN 0 THEN 'man_made=flare' WHEN 1 THEN 'man_made=chimney' WHEN 2 THEN 'man_made=kiln' ELSE 'industrial=yes' END AS primary_tag, facility_type <> 'POWER' OR fac_id % 2 = 1 AS thermal_candidate,
  lon - h AS west, lat - h AS south, lon + h AS east, lat + h AS north FROM (SELECT *, 0.0005::DOUBLE * (1 + fac_id % 4) AS h FROM facilities))""",
    "pixels": """pixels AS (SELECT l_suppkey AS id, ([10, 20, 30, 40, 50, 7])[CAST(CASE WHEN l_suppkey % 4 = 0 AND l_partkey % 3 > 0 THEN 4 WHEN l_suppkey % 4 = 1 AND l_partkey % 3 > 0 THEN 1 ELSE l_partkey % 6 + 1 END AS INTEGER)] AS code, l_partkey % 5 < 4 AS close FROM lineitem)""",
    "runs": """runs AS (SELECT o_orderkey AS run_id, o_custkey % 60 AS place, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS start_date,
  DATE '2024-01-01' + CAST(o_orderkey % 30 + o_orderkey % 4 AS INTEGER) AS end_date,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'PARTIAL' ELSE 'FAILED' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 'LIVE' ELSE 'HISTORICAL_REPLAY' END AS mode, CASE WHEN o_orderkey % 7 = 0 THEN 'SP' ELSE 'NRT' END AS product FROM orders)""",
    "receipts": "receipts AS (SELECT l_orderkey AS run_id, CAST(l_linenumber + 1 AS BIGINT) AS row_number, l_partkey AS obs_id FROM lineitem)",
    "facilities": """facilities AS (SELECT s_suppkey AS fac_id, 69.504::DOUBLE + 0.02::DOUBLE*(s_suppkey % 50) AS lon, 22.003::DOUBLE + 0.02::DOUBLE*floor(s_suppkey / 50) AS lat,
  (['LNG','REFINERY','PETROCHEMICAL','STEEL','POWER','MINE','OTHER','UNKNOWN'])[s_nationkey % 8 + 1] AS facility_type FROM supplier)""",
    "plants": """plants AS (SELECT c_custkey AS plant_id, 69.49::DOUBLE + 0.007::DOUBLE*(c_custkey % 150) AS lon, 21.99::DOUBLE + 0.007::DOUBLE*floor(c_custkey / 150) AS lat, c_mktsegment AS fuel FROM customer)""",
    "places": "places AS (SELECT place, arg_min(lon, obs_id) AS lon, arg_min(lat, obs_id) AS lat FROM obs GROUP BY place)",
    "sites": """sites AS (SELECT user_id AS site, 'r' || CAST(floor(user_id % 50 / 3) % 4 AS BIGINT) AS region_id, 69.5::DOUBLE + 0.08::DOUBLE * floor(user_id % 50 / 3) + CASE user_id % 50 % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.015::DOUBLE ELSE 0.0405::DOUBLE END AS lon, 22.0::DOUBLE + 0.08::DOUBLE * floor(user_id / 50) AS lat FROM (SELECT DISTINCT user_id FROM events))""",
    "site_plants": """site_plants AS (SELECT c_custkey AS fac_id, 69.5::DOUBLE + 0.08::DOUBLE * floor(c_custkey % 50 / 3) + 0.02775::DOUBLE AS lon, 22.0::DOUBLE + 0.08::DOUBLE * floor(c_custkey / 50) AS lat FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY'))""",
    "site_areas": """site_areas AS (SELECT s_suppkey AS fac_id, 69.5::DOUBLE + 0.08::DOUBLE * floor(s_suppkey % 50 / 3) + 0.004::DOUBLE AS lon, 22.0::DOUBLE + 0.08::DOUBLE * floor(s_suppkey / 50) AS lat FROM supplier)""",
    "cases": """cases AS (SELECT event_id AS id, 'r' || (user_id % 6) AS region_id, 'g' || user_id AS split_group, event_id % 2 + 1 AS review_slots,
  CASE WHEN event_id % 5 = 0 THEN 'INDUSTRIAL' END AS silver, CASE WHEN event_id % 7 = 0 THEN 'UNKNOWN' WHEN event_id % 7 < 4 THEN 'AGRICULTURAL_BURN' END AS weak FROM events)""",
    "reviews": """reviews AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS seq, CASE WHEN l_returnflag = 'R' THEN 'ADJUDICATOR' ELSE 'REVIEWER' END AS role,
  CASE WHEN l_quantity::BIGINT % 4 < 2 THEN 'INDUSTRIAL' WHEN l_quantity::BIGINT % 4 = 2 THEN 'VEGETATION_FIRE' ELSE 'UNRESOLVED' END AS source_label,
  CASE l_quantity::BIGINT % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS certainty, l_quantity::BIGINT % 2 = 0 AS inside, l_suppkey % 2 = 0 AS qualifies
  FROM lineitem)""",
    "predictions": """predictions AS (SELECT l_orderkey AS id, CAST((l_partkey + l_linenumber) % 2 AS INTEGER) AS y, (l_quantity * 2 - 1) / 100 AS p,
  CAST((l_quantity * 2 - 1) / 100 >= 0.5 AS INTEGER) AS pred, l_suppkey % 10 AS grp FROM lineitem)""",
}


def sql(tables: str, rest: str) -> str:
    return "WITH " + ",\n".join(CTE[t] for t in tables.split()) + "\n" + rest


def distance_sql(a: str, b: str) -> str:
    """functions.geo.distance_m between two aliases."""
    w = f"sqrt(1 - 0.00669437999014 * pow(sin(radians(({a}.lat + {b}.lat) / 2)), 2))"
    north = f"(pi() / 180 * 6378137.0 * (1 - 0.00669437999014) / ({w} * {w} * {w}))"
    east = f"(pi() / 180 * 6378137.0 * cos(radians(({a}.lat + {b}.lat) / 2)) / {w})"
    return f"sqrt(pow(({a}.lat - {b}.lat) * {north}, 2) + pow(({a}.lon - {b}.lon) * {east}, 2))"


def scale_sql(lat: str) -> tuple[str, str]:
    """functions.geo.metres_per_degree."""
    w = f"sqrt(1 - 0.00669437999014 * pow(sin(radians({lat})), 2))"
    return f"(pi() / 180 * 6378137.0 * (1 - 0.00669437999014) / ({w} * {w} * {w}))", f"(pi() / 180 * 6378137.0 * cos(radians({lat})) / {w})"


def covers_sql(box: str, point: str, radius: str) -> str:
    """functions.geo.box_covers_circle."""
    up, across = scale_sql(f"{point}.lat")
    return f"({point}.lon - {radius} / {across} >= {box}.west AND {point}.lon + {radius} / {across} <= {box}.east AND {point}.lat - {radius} / {up} >= {box}.south AND {point}.lat + {radius} / {up} <= {box}.north)"
