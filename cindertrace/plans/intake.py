"""Queries over what comes in and goes out: files, maps, registries, runs, packages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrace.functions import geo
from cindertrace.operators import episodes, landcover, runs
from cindertrace.operators.spatial import near
from cindertrace.plans.adapter import Tables, distance_sql, sql
from cindertrace.registry import register
from cindertrace.shipping import ship
from cindertrace.sources import detections, exports, mapped, requests


def pick(k: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def pick_sql(k: str, *values: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST(({k}) % {len(values)} + 1 AS INTEGER)]"


REGION_ROWS = ", ".join(f"('{r}', {w!r}::DOUBLE, {s!r}::DOUBLE, {e!r}::DOUBLE, {n!r}::DOUBLE)" for r, w, s, e, n in requests.REGIONS)


@register(sql("obs", f"SELECT region, count(obs_id) AS n, CAST(epoch(max(acquired_at)) AS DOUBLE) AS last_at FROM (VALUES {REGION_ROWS}) v(region, w, s, e, n0) LEFT JOIN obs ON lon BETWEEN w AND e AND lat BETWEEN s AND n0 GROUP BY region"))
def region_catalogue(t: Tables) -> DataFrame:
    """The named regions and what is known of each."""
    boxes = requests.regions(t.spark)
    inside = geo.in_box(F.col("lon"), F.col("lat"), *(F.col(c) for c in ("west", "south", "east", "north")))
    found = t.obs().join(F.broadcast(boxes), inside).groupBy("region").agg(F.count("*").alias("n"), F.unix_timestamp(F.max("acquired_at")).cast("double").alias("last_at"))
    return boxes.select("region").join(found, "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"), "last_at")


OUTCOMES = "WITH i AS (SELECT l_partkey AS id, l_linenumber % 2 AS payload, l_orderkey * 10 + l_linenumber AS row_number, l_orderkey % 50 AS run_id FROM lineitem), k AS (SELECT p_partkey AS id, 1 AS payload FROM part WHERE p_partkey % 3 = 0), r AS (SELECT i.*, k.payload AS known, row_number() OVER (PARTITION BY id ORDER BY row_number) AS n, first_value(i.payload) OVER (PARTITION BY id ORDER BY row_number) AS first FROM i LEFT JOIN k USING (id)), o AS (SELECT id, run_id, row_number, CASE WHEN payload <> coalesce(known, first) THEN 'SOURCE_REVISION_CONFLICT' WHEN n = 1 AND known IS NULL THEN 'INSERTED' ELSE 'DUPLICATE' END AS outcome FROM r)"


def outcomes(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 2).alias("payload"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"))
    known = t.read("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit(1).alias("payload"))
    return detections.ingest(known, rows).withColumn("run_id", F.floor(F.col("row_number") / 10) % 50)


@register(OUTCOMES + ", x AS (SELECT run_id, outcome FROM o UNION ALL SELECT o_orderkey % 50, 'REJECTED' FROM orders WHERE o_orderkey % 50 > 30 AND o_custkey % 9 = 0) SELECT run_id, count(*) AS total_rows, count(*) FILTER (outcome IN ('INSERTED', 'DUPLICATE')) AS accepted_rows, count(*) FILTER (outcome = 'INSERTED') AS inserted_rows, count(*) FILTER (outcome = 'DUPLICATE') AS duplicate_rows, count(*) FILTER (outcome IN ('REJECTED', 'SOURCE_REVISION_CONFLICT')) AS rejected_rows, CASE WHEN count(*) FILTER (outcome IN ('REJECTED', 'SOURCE_REVISION_CONFLICT')) > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status FROM x GROUP BY run_id")
def run_ledger(t: Tables) -> DataFrame:
    rejected = t.read("orders").filter("o_orderkey % 50 > 30 AND o_custkey % 9 = 0").select((F.col("o_orderkey") % 50).alias("run_id"))
    return detections.ledger(outcomes(t), rejected)


@register(OUTCOMES + " SELECT run_id, row_number, id FROM o WHERE outcome <> 'SOURCE_REVISION_CONFLICT'")
def ingest_receipts(t: Tables) -> DataFrame:
    return detections.receipts(outcomes(t))


@register("WITH r AS (SELECT event_id % 97 AS id, " + pick_sql("event_id", "22.30", "22.3", "22.31") + " AS la, " + pick_sql("event_id // 3", "5", "5.0", "6", "") + " AS frp, " + pick_sql("event_id // 5", "n", "l") + " AS conf FROM events) SELECT id, count(*) AS n, count(DISTINCT (la::DOUBLE, coalesce(CASE WHEN frp <> '' THEN frp::DOUBLE END, -1), conf)) AS revisions FROM r GROUP BY id")
def payload_revisions(t: Tables) -> DataFrame:
    """How many revisions of each observation came: the same values spelt otherwise are one."""
    k = F.col("event_id")
    rows = t.read("events").select(
        (k % 97).alias("id"), pick(k, "22.30", "22.3", "22.31").alias("latitude"), F.lit("69.8").alias("longitude"), F.lit("310").alias("bright_ti4"), F.lit("295").alias("bright_ti5"), F.lit("0.4").alias("scan"), F.lit("0.5").alias("track"),
        pick(F.floor(k / 3), "5", "5.0", "6", "").alias("frp"), pick(F.floor(k / 5), "n", "l").alias("confidence"), F.lit("N20").alias("satellite"), F.lit("VIIRS").alias("instrument"), F.lit("2.0").alias("version"), F.lit("D").alias("daynight"), F.lit("2024-01-02").cast("timestamp").alias("acquired_at"),
    )
    return rows.withColumn("h", detections.payload_hash()).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("h").alias("revisions"))


CLOCKS = "WITH c AS (SELECT o_orderkey AS id, TIMESTAMP '2024-01-01' AS acquired, CASE WHEN o_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(o_custkey % 5 - 1) END AS published, CASE WHEN o_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(o_custkey % 7) END AS available, TIMESTAMP '2024-01-01' + to_hours(o_custkey % 9) AS ingested, " + pick_sql("o_custkey // 2", "KNOWN", "UNKNOWN", "GUESSED") + " AS ev FROM orders)"


@register(CLOCKS + " SELECT id, coalesce(CASE ev WHEN 'KNOWN' THEN available IS NOT NULL WHEN 'UNKNOWN' THEN available IS NULL ELSE false END AND coalesce(published, acquired) >= acquired AND coalesce(available, published, acquired) >= coalesce(published, acquired) AND ingested >= coalesce(available, acquired), false) AS in_order, coalesce(ev = 'KNOWN' AND available <= TIMESTAMP '2024-01-01 03:00:00', false) AS known FROM c")
def clock_checks(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    zero = F.lit("2024-01-01").cast("timestamp")
    after = lambda h: zero + F.make_dt_interval(F.lit(0), h.cast("int"))
    rows = t.read("orders").select(F.col("o_orderkey").alias("id"), F.when(c % 3 == 0, after(c % 5 - 1)).alias("published"), F.when(c % 4 != 0, after(c % 7)).alias("available"), after(c % 9).alias("ingested"), pick(F.floor(c / 2), "KNOWN", "UNKNOWN", "GUESSED").alias("ev"))
    as_of = F.lit("2024-01-01 03:00:00").cast("timestamp")
    return rows.select("id", detections.clocks_in_order(zero, F.col("published"), F.col("available"), F.col("ingested"), F.col("ev")).alias("in_order"), detections.known_as_of(zero, F.col("available"), F.col("ev"), as_of).alias("known"))


PAYLOADS = ['{"elements":[{"type":"node"}],"osm3s":{"timestamp_osm_base":"2024-01-01T00:00:00Z"}}', '{"osm3s":{"timestamp_osm_base":"2024-01-01T00:00:00Z"}}', '{"elements":[],"remark":"runtime error: out of memory","osm3s":{"timestamp_osm_base":"2024-01-01T00:00:00Z"}}', '{"elements":[],"osm3s":{"timestamp_osm_base":"once"}}', '{"elements":[{"type":"way"},{"type":"way"},{"type":"way"}],"osm3s":{"timestamp_osm_base":"2024-01-01T00:00:00Z"}}', "no json"]


@register("WITH p AS (SELECT p_partkey AS id, TRY_CAST(" + pick_sql("p_partkey", *PAYLOADS) + """ AS JSON) AS t FROM part) SELECT id, CASE WHEN coalesce(json_type(t, '$.elements'), '') <> 'ARRAY' THEN 'NO_ELEMENTS' WHEN coalesce(json_extract_string(t, '$.remark'), '') LIKE '%runtime error%' THEN 'INCOMPLETE'
 WHEN TRY_CAST(json_extract_string(t, '$.osm3s.timestamp_osm_base') AS TIMESTAMPTZ) IS NULL THEN 'NO_BASE_TIME' WHEN json_array_length(t, '$.elements') > 2 THEN 'TOO_MANY_ELEMENTS' END AS problem FROM p""")
def map_payloads(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.read("part").select(k.alias("id"), mapped.payload_problem(pick(k, *PAYLOADS), 2).alias("problem"))


#: A ring closes if lines meet in twos at every corner; around its middle a square's sides add up to its area.
SIDES = """WITH sq AS (SELECT s_suppkey AS id, s_suppkey % 5 AS kind, 0.5::DOUBLE * (1 + s_suppkey % 4) AS h FROM supplier), sides AS (SELECT id, h, a * h AS ax, b * h AS ay, c * h AS bx, d * h AS "by" FROM sq, (VALUES (1, -1, -1, 1, -1), (2, 1, 1, 1, -1), (3, 1, 1, -1, 1), (4, -1, -1, -1, 1)) v(n, a, b, c, d) WHERE kind < 4 OR n < 4),
 ends AS (SELECT id, ax AS x, ay AS y FROM sides UNION ALL SELECT id, bx, "by" FROM sides), corners AS (SELECT id, x, y, count(*) AS n FROM ends GROUP BY ALL), closed AS (SELECT id, bool_and(n = 2) AS ok FROM corners GROUP BY id), areas AS (SELECT id, round(sum(abs(ax * "by" - bx * ay)), 6) AS twice_area FROM sides GROUP BY id)
 SELECT id, CASE WHEN ok THEN 1 END AS rings, CASE WHEN ok THEN twice_area END AS twice_area FROM closed JOIN areas USING (id)"""


@register(SIDES)
def stitched_rings(t: Tables) -> DataFrame:
    """Squares whose sides come as lines in any order and direction; every fifth lacks one."""
    ship(t.spark)
    k = F.col("fac_id")
    h = 0.5 * (1 + k % 4)

    def line(*corners: tuple[int, int]) -> Column:
        return F.array(*[F.struct((10 + a * h).alias("lon"), (20 + b * h).alias("lat")) for a, b in corners])

    sides = [line((-1, -1), (1, -1)), line((1, 1), (1, -1)), line((1, 1), (-1, 1)), line((-1, -1), (-1, 1))]
    shuffled = F.when(k % 5 == 0, F.array(*sides)).when(k % 5 == 1, F.array(sides[2], sides[0], sides[3], sides[1])).when(k % 5 == 2, F.array(sides[3], sides[1], sides[0], sides[2])).when(k % 5 == 3, F.array(line((-1, -1), (1, -1), (1, 1)), sides[3], sides[2])).otherwise(F.array(*sides[:3]))
    rows = t.facilities().select(k.alias("id"), mapped.stitched(shuffled).alias("r"))
    return rows.select("id", F.when(F.col("r").isNotNull(), F.size("r")).alias("rings"), F.round(F.abs(mapped.ring_area(F.get("r", 0))), 6).alias("twice_area"))


PLANT = "WITH p AS (SELECT c_custkey AS id, c_name AS name, " + pick_sql("c_custkey", "IND", "IND", "USA") + " AS country, " + pick_sql("c_custkey // 2", "Coal", "Solar", "Gas", "Hydro", "Waste") + " AS fuel, " + pick_sql("c_custkey // 3", "100", " 25.5 ", "", "n/a") + " AS mw, " + pick_sql("c_custkey // 5", "22.5", "95", "x") + " AS lat FROM customer)"


@register(PLANT + " SELECT id, fuel, TRY_CAST(trim(mw) AS DOUBLE) AS capacity_mw, TRY_CAST(lat AS DOUBLE) AS lat FROM p WHERE country = 'IND' AND fuel IN ('Coal', 'Gas', 'Waste') AND TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90")
def registry_plants(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.read("customer").select(k.alias("id"), F.col("c_name").alias("name"), pick(k, "IND", "IND", "USA").alias("country"), pick(F.floor(k / 2), "Coal", "Solar", "Gas", "Hydro", "Waste").alias("primary_fuel"), pick(F.floor(k / 3), "100", " 25.5 ", "", "n/a").alias("capacity_mw"), F.lit("1999").alias("commissioning_year"), F.lit("70").alias("longitude"), pick(F.floor(k / 5), "22.5", "95", "x").alias("latitude"))
    return mapped.registry_plants(rows).select("id", "fuel", "capacity_mw", "lat")


REGION = "'r' || (place % 6)"


@register(sql("obs", f"SELECT {REGION} AS region, CAST(CAST(acquired_at AS DATE) AS VARCHAR) AS day FROM obs GROUP BY ALL HAVING count(DISTINCT product) > 1"))
def overlap_days(t: Tables) -> DataFrame:
    return runs.overlap_days(by_region(t)).withColumn("day", F.col("day").cast("string"))


def by_region(t: Tables) -> DataFrame:
    return t.obs().withColumn("region", F.concat(F.lit("r"), (F.col("place") % 6).cast("string")))


DIGEST = "h AS (SELECT region, sha256(CAST(obs_id AS VARCHAR)) AS h FROM {0}), d AS (SELECT region, count(*) AS n, substr(h, 1, 4) AS block, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY region, substr(h, 1, 4)), f AS (SELECT region, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY block)) AS input_sha256 FROM d GROUP BY region)"


@register(sql("obs", f", x AS (SELECT {REGION} AS region, * FROM obs WHERE NOT ({REGION} IN ('r0', 'r1', 'r2') AND product = 'NRT')), " + DIGEST.format("x") + ", o AS (SELECT DISTINCT region FROM (SELECT region, CAST(acquired_at AS DATE) AS day FROM x GROUP BY ALL HAVING count(DISTINCT product) > 1)) SELECT region, n, input_sha256, CASE WHEN n > 20000 THEN 'REFUSED_SIZE' WHEN region IN (SELECT region FROM o) THEN 'REFUSED_OVERLAP' WHEN region = 'r1' THEN 'UNCHANGED' ELSE 'BUILD' END AS action FROM f"))
def run_plan(t: Tables) -> DataFrame:
    """Three regions have one product; one of them is as it was in an earlier run."""
    own = by_region(t).filter(~(F.col("region").isin("r0", "r1", "r2") & (F.col("product") == "NRT")))
    none = t.spark.createDataFrame([], "region string, input_sha256 string, latest timestamp")
    earlier = runs.plan(own.filter("region IN ('r1', 'r2')").filter("region = 'r1' OR obs_id % 2 = 0"), none).select("region", "input_sha256", F.lit(None).cast("timestamp").alias("latest"))
    return runs.plan(own, earlier)


@register(sql("obs", f", x AS (SELECT {REGION} AS region, * FROM obs), m AS (SELECT region, max(acquired_at) AS newest FROM x WHERE obs_id % 4 <> 0 GROUP BY region) SELECT region, count(*) AS late, CAST(epoch(min(acquired_at)) AS BIGINT) AS earliest FROM x JOIN m USING (region) WHERE obs_id % 4 = 0 AND acquired_at < newest GROUP BY region"))
def late_by_region(t: Tables) -> DataFrame:
    own = by_region(t)
    return runs.late(own, own.filter("obs_id % 4 != 0")).withColumn("earliest", F.unix_timestamp("earliest"))


@register(sql("passes", "SELECT 'r' || (run_id % 14) AS region, run_id FROM passes WHERE status = 'SUCCEEDED' QUALIFY row_number() OVER (PARTITION BY run_id % 14 ORDER BY received_at DESC, run_id DESC) = 1"))
def newest_runs(t: Tables) -> DataFrame:
    rows = t.passes().select(F.concat(F.lit("r"), (F.col("run_id") % 14).cast("string")).alias("region"), "run_id", "status", F.col("received_at").alias("completed_at"))
    return runs.newest_runs(rows).select("region", "run_id")


@register(sql("passes", "SELECT run_id, product, CAST(start_date AS VARCHAR) AS start_date FROM passes WHERE west <= 69.9 AND south <= 22.0 AND east >= 70.0 AND north >= 22.5 AND start_date <= DATE '2024-01-10' AND end_date >= DATE '2024-01-01' ORDER BY received_at DESC, run_id DESC LIMIT 1"))
def newest_overlapping_run(t: Tables) -> DataFrame:
    return runs.newest_overlapping(t.passes(), (69.9, 22.0, 70.0, 22.5), "2024-01-01", "2024-01-10").select("run_id", "product", F.col("start_date").cast("string").alias("start_date"))


SES = ", g AS (SELECT *, CASE WHEN acquired_at - lag(acquired_at) OVER w > INTERVAL 24 HOUR OR lag(acquired_at) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY place ORDER BY acquired_at, obs_id)), ses AS (SELECT *, CAST(sum(new) OVER (PARTITION BY place ORDER BY acquired_at, obs_id) AS BIGINT) AS session_no FROM g), ev AS (SELECT place || '-' || session_no AS event_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, min(acquired_at) AS started_at, max(acquired_at) AS ended_at, count(*) AS n FROM ses GROUP BY place, session_no)"


def events(t: Tables) -> DataFrame:
    return episodes.sessions(t.obs(), "place").withColumn("event_id", F.concat_ws("-", "place", "session_no"))


@register(sql("obs", SES + ", x AS (SELECT * FROM ev WHERE west <= 70.2 AND east >= 69.6 AND south <= 22.4 AND north >= 22.0 AND started_at < TIMESTAMP '2024-01-20' AND ended_at >= TIMESTAMP '2024-01-05') SELECT event_id, n, CAST(epoch(started_at) AS BIGINT) AS started_at, (SELECT count(*) FROM x) > 200 AS truncated FROM x ORDER BY started_at DESC, event_id LIMIT 200"))
def event_list(t: Tables) -> DataFrame:
    """Events that meet a window, newest first; the cap of 200 is told of."""
    found = runs.events_in(runs.extents(events(t), "event_id"), (69.6, 22.0, 70.2, 22.4), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 200)
    return found.select("event_id", "n", F.unix_timestamp("started_at").alias("started_at"), "truncated")


@register(sql("obs", SES + ", y AS (SELECT place || '-' || session_no AS event_id, obs_id, acquired_at FROM ses) SELECT event_id, count(*) AS n, string_agg(CAST(obs_id AS VARCHAR), ',' ORDER BY acquired_at, obs_id) AS members, CAST(epoch(min(acquired_at)) AS BIGINT) AS first FROM y GROUP BY event_id"))
def event_details(t: Tables) -> DataFrame:
    found = runs.details(events(t), "event_id")
    return found.select("event_id", F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda m: m["obs_id"].cast("string")), ",").alias("members"), F.unix_timestamp("first").alias("first"))


@register(sql("obs", SES + " SELECT obs_id, place || '-' || session_no AS event_id FROM ses WHERE obs_id % 50 = 7"))
def event_of_observation(t: Tables) -> DataFrame:
    """The events of the observations that were asked for."""
    asked = t.obs().filter("obs_id % 50 = 7").select("obs_id")
    return events(t).join(asked, "obs_id", "left_semi").select("obs_id", "event_id")


@register(sql("passes", ", f AS (SELECT product, start_date, end_date, sha256(CAST(run_id % 7 AS VARCHAR)) AS sha256, received_at, status FROM passes), g AS (SELECT product, start_date, end_date, sha256, min(received_at) AS received_at, min(status) AS status, count(*) AS files FROM f GROUP BY ALL) SELECT product, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, sha256, CAST(epoch(received_at) AS BIGINT) AS received_at, status, files, count(*) OVER (PARTITION BY product, start_date, end_date) > 1 AS shared FROM g"))
def package_runs(t: Tables) -> DataFrame:
    rows = t.passes().withColumn("sha256", F.sha2((F.col("run_id") % 7).cast("string"), 256))
    return exports.package_runs(rows).withColumns({"start_date": F.col("start_date").cast("string"), "end_date": F.col("end_date").cast("string"), "received_at": F.unix_timestamp("received_at")})


@register("WITH n AS (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS sha, CASE WHEN p_partkey % 3 = 0 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END AS said FROM part WHERE p_partkey % 5 <> 0), f AS (SELECT 'f' || p_partkey AS path, sha256(CAST(p_partkey AS VARCHAR)) AS sha FROM part) SELECT path, CASE WHEN said IS NULL THEN 'NO_SIDECAR' WHEN TRY_CAST(said AS TIMESTAMPTZ) IS NULL THEN 'UNREADABLE_TIME' ELSE 'USABLE' END AS use FROM f LEFT JOIN n USING (sha)")
def sidecar_use(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    sha = F.sha2(k.cast("string"), 256).alias("sha256")
    notes = t.read("part").filter(k % 5 != 0).select(sha, F.when(k % 3 == 0, "yesterday").otherwise("2024-01-02T03:04:05Z").alias("retrieved_at"))
    return exports.with_sidecars(t.read("part").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), sha), notes).select("path", "use")


@register(sql("obs archive", "SELECT CAST(obs_id AS BIGINT) AS observation_id, strftime(acquired_at, '%Y-%m-%dT%H:%M:%SZ') AS acquired_at_utc, round(500 * sqrt(coalesce(scan, 0.375) * coalesce(scan, 0.375) + coalesce(track, 0.375) * coalesce(track, 0.375)) + 100, 1) AS pixel_support_radius_m, CASE WHEN scan IS NULL THEN 'NOMINAL_VIIRS_I_BAND' ELSE 'SCAN_TRACK' END AS pixel_support_basis, round(frp_mw, 6) AS frp_mw, CASE WHEN obs_id % 3 = 0 THEN NULL ELSE i5 END AS brightness_i5_k, 'UNKNOWN' AS historical_availability, obs_id % 100 + 2 AS raw_row_number, 'from ' || product AS source_attribution FROM archive"))
def export_records(t: Tables) -> DataFrame:
    """The 25 columns of an export; a number that is none is null."""
    e = F.col("obs_id")
    rows = t.archive().withColumns({"i5": F.when(e % 3 == 0, float("nan")).otherwise(F.col("i5")), "version": F.lit("2.0"), "file_sha256": F.sha2(e.cast("string"), 256), "row_number": e % 100 + 2, "run_id": e % 9, "received_at": F.lit("2024-02-01").cast("timestamp")})
    found = exports.records(rows, "HISTORICAL_REPLAY", "from ")
    assert found.columns == exports.RECORD
    return found.select("observation_id", "acquired_at_utc", "pixel_support_radius_m", "pixel_support_basis", F.round("frp_mw", 6).alias("frp_mw"), "brightness_i5_k", "historical_availability", "raw_row_number", "source_attribution")


POINTS = "WITH p AS (SELECT event_id AS id, (event_id * 37 % 1200) / 100.0::DOUBLE + 60 AS lon, (event_id * 53 % 17400) / 100.0::DOUBLE - 87 AS lat, CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 6000 ELSE 1000 END::DOUBLE AS radius_m FROM events), q AS (SELECT *, floor(lon / 3) * 3 AS w, floor(lat / 3) * 3 AS s, 1.05::DOUBLE * radius_m / "


def points(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.read("events").select(e.alias("id"), ((e * 37 % 1200) / 100.0 + 60).alias("lon"), ((e * 53 % 17400) / 100.0 - 87).alias("lat"), F.when(e % 8 == 0, 0.0).when(e % 8 == 1, 6000.0).otherwise(1000.0).alias("radius_m"))


W = "sqrt(1 - 0.00669437999014 * pow(sin(radians(lat)), 2))"
UP, ACROSS = f"(pi() / 180 * 6378137.0 * (1 - 0.00669437999014) / ({W} * {W} * {W}))", f"(pi() / 180 * 6378137.0 * cos(radians(lat)) / {W})"


@register(POINTS + f"{UP} AS dy, 1.05::DOUBLE * radius_m / {ACROSS} AS dx FROM p) SELECT id, (lon - dx < w OR lon + dx > w + 3 OR lat - dy < s OR lat + dy > s + 3) AS clipped, CASE WHEN NOT (radius_m > 0 AND radius_m <= 5000) THEN 'RADIUS' WHEN abs(lat) >= 85 THEN 'LATITUDE' END AS reason, CASE WHEN NOT (radius_m > 0 AND radius_m <= 5000) OR abs(lat) >= 85 THEN 'FAILED' WHEN id % 6 = 3 THEN 'DONE' ELSE 'READ' END AS step FROM q")
def landcover_plan(t: Tables) -> DataFrame:
    done = t.read("events").filter("event_id % 6 = 3").select(F.col("event_id").alias("id"))
    return landcover.plan(points(t), done).select("id", "clipped", "reason", "step")


@register(sql("pixels", "SELECT id, count(*) AS pixels, count(*) FILTER (code = 7) AS unrecognised, round(count(*) FILTER (code <> 7) / count(*), 6) AS valid_fraction, CASE WHEN count(*) FILTER (code <> 7) / count(*) >= 0.5 THEN 'OK' ELSE 'INSUFFICIENT' END AS status FROM pixels GROUP BY id"))
def landcover_status(t: Tables) -> DataFrame:
    return landcover.pixel_summary(t.pixels(), "id").select("id", "pixels", "unrecognised", "valid_fraction", "status")


@register(sql("pixels", ", s AS (SELECT id, round(sum(n) FILTER (code <> 7) / sum(n), 6) AS valid FROM (SELECT id, code, count(*) AS n FROM pixels GROUP BY ALL) GROUP BY id), stored AS (SELECT id, CASE WHEN id % 4 = 1 THEN valid + 0.1 ELSE valid END AS valid FROM s) SELECT s.id FROM s JOIN stored USING (id) WHERE s.valid IS DISTINCT FROM stored.valid"))
def landcover_restore(t: Tables) -> DataFrame:
    """Saved summaries that a second reading does not give: every fourth was changed."""
    again = landcover.pixel_summary(t.pixels(), "id").select("id", F.col("valid_fraction").alias("valid"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fractions")))).alias("fractions"))
    stored = again.withColumn("valid", F.when(F.col("id") % 4 == 1, F.col("valid") + 0.1).otherwise(F.col("valid")))
    return landcover.not_restored(stored, again)


@register(sql("obs facilities places", f", c AS (SELECT p.place, f.fac_id, f.facility_type FROM places p JOIN facilities f ON abs(p.lat - f.lat) < 0.05 AND abs(p.lon - f.lon) < 0.05 AND {distance_sql('p', 'f')} <= 2000) SELECT f.fac_id, f.facility_type FROM facilities f WHERE (f.fac_id, f.facility_type) IN (SELECT (fac_id, facility_type) FROM c)"))
def cited_features(t: Tables) -> DataFrame:
    """The mapped features that any candidate list names, by two keys."""
    named = near(t.places(), t.facilities(), 2000.0).select("fac_id", "facility_type").distinct()
    return t.facilities().join(named, ["fac_id", "facility_type"], "left_semi").select("fac_id", "facility_type")


@register(sql("obs", "SELECT obs_id, round(frp_mw, 6) AS frp_mw, daynight FROM obs WHERE i4 > 310"))
def payload_fields(t: Tables) -> DataFrame:
    """Fields read out of a JSON payload."""
    held = t.obs().select("obs_id", F.to_json(F.struct("frp_mw", "i4", F.struct("daynight").alias("pass"))).alias("payload"))
    field = lambda path: F.get_json_object("payload", path)
    return held.filter(field("$.i4").cast("double") > 310).select("obs_id", F.round(field("$.frp_mw").cast("double"), 6).alias("frp_mw"), field("$.pass.daynight").alias("daynight"))


@register(sql("passes", "SELECT run_id FROM passes WHERE west = 69.4::DOUBLE AND south = 21.9::DOUBLE AND east = 69.4::DOUBLE + 0.45::DOUBLE AND north = 23.5::DOUBLE"))
def runs_of_region(t: Tables) -> DataFrame:
    """Retrievals whose box is exactly a region's."""
    return t.passes().filter((F.col("west") == 69.4) & (F.col("south") == 21.9) & (F.col("east") == F.lit(69.4) + 0.45) & (F.col("north") == 23.5)).select("run_id")
