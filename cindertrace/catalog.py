"""The registry of queries over the driver's tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.functions import geo
from cindertrace.operators import components as comp
from cindertrace.operators import episodes, features, history, labels, landcover, rules, spatial
from cindertrace.plans.adapter import Tables, distance_sql, scale_sql, sql
from cindertrace.plans.raw import RAW, raw_rows
from cindertrace.registry import ORACLE, QUERIES, Query, register
from cindertrace.sources import detections, exports, mapped

AS_OF, FIRST, LAST = "2024-01-28", "2024-01-01", "2024-01-30"


def epoch(c: str) -> Column:
    return F.unix_timestamp(c).alias(c)


OVERPASS = """, o AS (SELECT place, acquired_at, satellite, daynight, greatest(max(frp_mw), 0.0) AS frp FROM obs WHERE frp_mw IS NOT NULL GROUP BY ALL)"""
STATS = OVERPASS + """, mid AS (SELECT place, satellite, daynight, count(*) AS n, median(frp) AS med, quantile_disc(frp, 0.1) AS a, quantile_disc(frp, 0.9) AS z, median(ln(1 + frp)) AS m FROM o GROUP BY ALL)
, stats AS (SELECT place, satellite, daynight, any_value(n) AS n, round(any_value(med), 3) AS median_frp, round(any_value(a), 3) AS p10, round(any_value(z), 3) AS p90, round(any_value(m), 5) AS median_log1p,
  round(median(abs(ln(1 + frp) - m)), 5) AS mad_log1p FROM o JOIN mid USING (place, satellite, daynight) GROUP BY place, satellite, daynight)"""


@register(sql("obs", STATS.removeprefix(", ").join([", ", " SELECT * FROM stats"])))
def robust_baseline(t: Tables) -> DataFrame:
    return history.robust_stats(history.overpass_max(t.obs(), "place"), "place", "satellite", "daynight")


@register(sql("obs", OVERPASS + " SELECT place, CAST(epoch(acquired_at) AS BIGINT) AS acquired_at, satellite, daynight, round(frp, 6) AS frp FROM o"))
def overpass_max(t: Tables) -> DataFrame:
    return history.overpass_max(t.obs(), "place").select("place", epoch("acquired_at"), "satellite", "daynight", F.round("frp", 6).alias("frp"))


BOX = (69.6, 22.0, 70.2, 22.4)


def in_window(o: DataFrame) -> DataFrame:
    return o.filter(geo.in_box(F.col("lon"), F.col("lat"), *map(F.lit, BOX)) & (F.col("acquired_at") >= "2024-01-05") & (F.col("acquired_at") < "2024-01-20"))


WINDOW_SQL = f"lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} AND acquired_at >= '2024-01-05' AND acquired_at < '2024-01-20'"


@register(sql("obs runs receipts", f"SELECT obs_id, CAST(epoch(acquired_at) AS BIGINT) AS acquired_at, lon, lat FROM obs o WHERE {WINDOW_SQL} AND EXISTS (SELECT 1 FROM receipts r JOIN runs USING (run_id) WHERE r.obs_id = o.obs_id AND mode = 'HISTORICAL_REPLAY' AND status IN ('SUCCEEDED', 'PARTIAL'))"))
def observation_window(t: Tables) -> DataFrame:
    ok = t.receipts().join(t.runs().filter("mode = 'HISTORICAL_REPLAY' AND status IN ('SUCCEEDED', 'PARTIAL')"), "run_id", "left_semi")
    return in_window(t.obs()).join(ok, "obs_id", "left_semi").select("obs_id", epoch("acquired_at"), "lon", "lat")


@register(sql("obs", f"SELECT obs_id, CAST(epoch(acquired_at) AS BIGINT) AS acquired_at FROM obs WHERE {WINDOW_SQL} ORDER BY acquired_at DESC, obs_id LIMIT 50 OFFSET 20"))
def observation_page(t: Tables) -> DataFrame:
    return in_window(t.obs()).select("obs_id", epoch("acquired_at")).orderBy(F.desc("acquired_at"), "obs_id").offset(20).limit(50)


REGIONS = [("west", 69.4, 21.9, 69.8, 23.0), ("middle", 69.8, 21.9, 70.2, 23.0), ("east", 70.2, 21.9, 70.6, 23.0), ("empty", 10.0, 10.0, 11.0, 11.0)]


@register(sql("obs", "SELECT region, count(obs_id) AS n, CAST(epoch(max(acquired_at)) AS DOUBLE) AS last_at, CAST(greatest(CAST(min(acquired_at) AS DATE), CAST(max(acquired_at) AS DATE) - 30) AS VARCHAR) AS default_start FROM (VALUES " + ", ".join(map(str, REGIONS)) + ") v(region, w, s, e, n0) LEFT JOIN obs ON lon BETWEEN w AND e AND lat BETWEEN s AND n0 GROUP BY region"))
def catalog_by_region(t: Tables) -> DataFrame:
    regions = t.spark.createDataFrame(REGIONS, "region string, west double, south double, east double, north double")
    inside = geo.in_box(F.col("lon"), F.col("lat"), *(F.col(c) for c in ("west", "south", "east", "north")))
    found = t.obs().join(F.broadcast(regions), inside).groupBy("region").agg(F.count("*").alias("n"), F.max("acquired_at").alias("last"), F.min("acquired_at").alias("first"))
    start = F.greatest(F.to_date("first"), F.date_sub(F.to_date("last"), 30)).cast("string")
    return regions.select("region").join(found, "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"), F.unix_timestamp("last").cast("double").alias("last_at"), start.alias("default_start"))


@register(sql("runs receipts", "SELECT obs_id, run_id, row_number, first_run FROM (SELECT obs_id, run_id, row_number, min(run_id) OVER (PARTITION BY obs_id) AS first_run, row_number() OVER (PARTITION BY obs_id ORDER BY start_date DESC, run_id DESC, row_number DESC) AS k FROM receipts JOIN runs USING (run_id) WHERE status <> 'FAILED') WHERE k = 1"))
def latest_receipt(t: Tables) -> DataFrame:
    rows = t.receipts().join(t.runs().filter("status != 'FAILED'").select("run_id", "start_date"), "run_id")
    own = Window.partitionBy("obs_id")
    rows = rows.withColumns({"first_run": F.min("run_id").over(own), "k": F.row_number().over(own.orderBy(F.desc("start_date"), F.desc("run_id"), F.desc("row_number")))})
    return rows.filter("k = 1").select("obs_id", "run_id", "row_number", "first_run")


@register(sql("obs runs receipts", "SELECT obs_id, CAST(min(start_date) AS VARCHAR) AS first_available FROM obs LEFT JOIN (SELECT obs_id, start_date FROM receipts JOIN runs USING (run_id) WHERE mode = 'LIVE') USING (obs_id) GROUP BY obs_id"))
def first_available(t: Tables) -> DataFrame:
    live = t.receipts().join(t.runs().filter("mode = 'LIVE'").select("run_id", "start_date"), "run_id").groupBy("obs_id").agg(F.min("start_date").cast("string").alias("first_available"))
    return t.obs().select("obs_id").join(live, "obs_id", "left")


COVERED = ", covered AS (SELECT DISTINCT place, CAST(unnest(range(start_date, end_date + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM runs WHERE status = 'SUCCEEDED')"


def covered(t: Tables) -> DataFrame:
    return history.coverage_days(t.runs().filter("status = 'SUCCEEDED'"), "place")


@register(sql("runs", COVERED + " SELECT place, CAST(day AS VARCHAR) AS day FROM covered"))
def coverage_days(t: Tables) -> DataFrame:
    return covered(t).select("place", F.col("day").cast("string").alias("day"))


DAYS = f", days AS (SELECT place, CAST(d AS DATE) AS day FROM (SELECT DISTINCT place FROM obs), range(DATE '{FIRST}', DATE '{LAST}' + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d))"


@register(sql("obs runs", COVERED + DAYS + ", c AS (SELECT place, CAST(acquired_at AS DATE) AS day, count(*) AS n, max(frp_mw) AS m FROM obs GROUP BY ALL) SELECT place, CAST(day AS VARCHAR) AS day, (place, day) IN (SELECT (place, day) FROM covered) AS retrieved, CASE WHEN n IS NOT NULL THEN n WHEN (place, day) IN (SELECT (place, day) FROM covered) THEN 0 END::DOUBLE AS detections, round(m, 6) AS max_frp FROM days LEFT JOIN c USING (place, day)"))
def daily_timeline(t: Tables) -> DataFrame:
    o = t.obs()
    series = history.daily_series(o, o.select("place").distinct(), covered(t), FIRST, LAST)
    return series.withColumns({"day": F.col("day").cast("string"), "detections": F.col("detections").cast("double"), "max_frp": F.round("max_frp", 6)})


@register(sql("obs", "SELECT place, CAST(epoch(acquired_at) AS BIGINT) AS acquired_at, satellite, daynight, count(*) AS n, round(max(frp_mw), 6) AS max_frp FROM obs GROUP BY ALL"))
def overpass_timeline(t: Tables) -> DataFrame:
    return t.obs().groupBy("place", "acquired_at", "satellite", "daynight").agg(F.count("*").alias("n"), F.round(F.max("frp_mw"), 6).alias("max_frp")).withColumn("acquired_at", F.unix_timestamp("acquired_at"))


GAPS = COVERED + DAYS + ", gap AS (SELECT place, day FROM days WHERE (place, day) NOT IN (SELECT (place, day) FROM covered))"


def gap_days(t: Tables) -> DataFrame:
    days = t.obs().select("place").distinct().select("place", F.explode(F.sequence(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))).alias("day"))
    return days.join(covered(t), ["place", "day"], "left_anti")


@register(sql("obs runs", GAPS + " SELECT place, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS n_days FROM (SELECT place, day, day - CAST(row_number() OVER (PARTITION BY place ORDER BY day) AS INTEGER) AS g FROM gap) GROUP BY place, g"))
def unretrieved_islands(t: Tables) -> DataFrame:
    return history.islands(gap_days(t), "place").withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@register(sql("obs runs", GAPS + " SELECT place, count(*) AS missing_days, CAST(min(day) AS VARCHAR) AS first_missing FROM gap GROUP BY place"))
def archive_gaps(t: Tables) -> DataFrame:
    return gap_days(t).groupBy("place").agg(F.count("*").alias("missing_days"), F.min("day").cast("string").alias("first_missing"))


SCALED = (3, 7, 14, 28)


def subjects(t: Tables) -> DataFrame:
    return t.obs().select("place").distinct().withColumn("start", F.lit(AS_OF).cast("timestamp"))


def window_sql() -> str:
    start = f"TIMESTAMP '{AS_OF}'"
    seen = ", ".join(f"count(*) FILTER (w{d}) AS detections_{d}, count(DISTINCT (acquired_at, satellite)) FILTER (w{d}) AS overpasses_{d}, count(DISTINCT CAST(acquired_at AS DATE)) FILTER (w{d}) AS active_days_{d}" for d in SCALED)
    flags = ", ".join(f"acquired_at >= {start} - INTERVAL {d} DAY AS w{d}" for d in SCALED)
    cover = ", ".join(f"count(*) FILTER (day >= DATE '{AS_OF}' - {d}) AS covered_{d}" for d in SCALED)
    out = ", ".join(f"coalesce(detections_{d}, 0) AS detections_{d}, coalesce(overpasses_{d}, 0) AS overpasses_{d}, coalesce(active_days_{d}, 0) AS active_days_{d}, coalesce(covered_{d}, 0) AS covered_{d}, round(coalesce(covered_{d}, 0) / {d}, 4) AS coverage_{d}" for d in SCALED)
    return f"""{COVERED}, f AS (SELECT *, {flags} FROM obs WHERE acquired_at < {start}), s AS (SELECT place, {seen} FROM f GROUP BY place),
 k AS (SELECT place, {cover} FROM covered WHERE day < DATE '{AS_OF}' AND day >= DATE '{AS_OF}' - {max(SCALED)} GROUP BY place), feat AS (SELECT place, {out} FROM (SELECT DISTINCT place FROM obs) LEFT JOIN s USING (place) LEFT JOIN k USING (place))"""


def places_features(t: Tables) -> DataFrame:
    return history.window_features(t.obs(), subjects(t), covered(t), SCALED).drop("start", "last_at")


@register(sql("obs runs", window_sql() + " SELECT * FROM feat"))
def window_features(t: Tables) -> DataFrame:
    return places_features(t)


@register(sql("obs runs", ", days AS (SELECT DISTINCT place, CAST(unnest(range(start_date, end_date + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM runs WHERE status = 'SUCCEEDED' AND product = 'SP') SELECT obs_id, product FROM obs o WHERE product = 'SP' OR NOT (EXISTS (SELECT 1 FROM days d WHERE d.place = o.place AND d.day = CAST(o.acquired_at AS DATE)) OR EXISTS (SELECT 1 FROM obs s WHERE s.product = 'SP' AND s.place = o.place AND s.acquired_at = o.acquired_at))"))
def sp_supersedes_nrt(t: Tables) -> DataFrame:
    days = history.coverage_days(t.runs().filter("status = 'SUCCEEDED' AND product = 'SP'"), "place")
    return history.reconcile_streams(t.obs(), days).select("obs_id", "product")


@register(sql("obs runs receipts", f"SELECT obs_id FROM obs JOIN (SELECT obs_id, min(start_date) AS a FROM receipts JOIN runs USING (run_id) WHERE mode = 'LIVE' GROUP BY obs_id) USING (obs_id) WHERE acquired_at <= TIMESTAMP '{AS_OF}' AND a <= DATE '{AS_OF}'"))
def eligible_operational(t: Tables) -> DataFrame:
    live = t.receipts().join(t.runs().filter("mode = 'LIVE'").select("run_id", "start_date"), "run_id").groupBy("obs_id").agg(F.min("start_date").cast("timestamp").alias("available_at"))
    return history.eligible(t.obs().join(live, "obs_id"), F.lit(AS_OF).cast("timestamp"), True).select("obs_id")


CURRENT = f", cur AS (SELECT place, satellite, daynight, max(frp) AS current_frp FROM o WHERE acquired_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND acquired_at <= TIMESTAMP '{AS_OF}' GROUP BY ALL), past AS (SELECT * FROM o WHERE acquired_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)"
Z = OVERPASS + CURRENT + ", m AS (SELECT place, satellite, daynight, count(*) AS n, median(ln(1 + frp)) AS m FROM past GROUP BY ALL), b AS (SELECT place, satellite, daynight, any_value(n) AS n, round(any_value(m), 5) AS median_log1p, round(median(abs(ln(1 + frp) - m)), 5) AS mad_log1p FROM past JOIN m USING (place, satellite, daynight) GROUP BY place, satellite, daynight), z AS (SELECT place, satellite, daynight, n, round(greatest(-50.0, least(50.0, (ln(1 + current_frp) - median_log1p) / greatest(1.4826 * mad_log1p, 0.1))), 3) AS z FROM cur LEFT JOIN b USING (place, satellite, daynight))"


def z_scores(t: Tables) -> DataFrame:
    o = history.overpass_max(t.obs(), "place")
    as_of = F.lit(AS_OF).cast("timestamp")
    start = as_of - F.make_dt_interval(F.lit(1))
    keys = ["place", "satellite", "daynight"]
    current = o.filter((F.col("acquired_at") > start) & (F.col("acquired_at") <= as_of)).groupBy(*keys).agg(F.max("frp").alias("current_frp"))
    base = history.robust_stats(o.filter(F.col("acquired_at") < start), *keys)
    return current.join(base, keys, "left").select(*keys, "n", history.robust_z(F.col("current_frp"), F.col("median_log1p"), F.col("mad_log1p")).alias("z"))


@register(sql("obs", Z + " SELECT * FROM z"))
def robust_z(t: Tables) -> DataFrame:
    return z_scores(t)


BEHAVIOUR = window_sql() + Z + f""", best AS (SELECT place, max(n) AS matched, arg_max(z, abs(z)) FILTER (n >= 5) AS z, count(*) AS has FROM z GROUP BY place),
 rule AS (SELECT place, CASE WHEN has IS NULL THEN 'B0_NO_CURRENT_FRP' WHEN coverage_28 < 0.8 THEN 'B1_LOW_COVERAGE' WHEN active_days_28 = 0 THEN 'B2_NO_EARLIER_DETECTION' WHEN coalesce(matched, 0) < 5 THEN 'B3_UNMATCHED_HISTORY' ELSE 'B4_ROBUST_Z' END AS rule, z, active_days_28, coverage_28 FROM feat LEFT JOIN best USING (place)),
 behaviour AS (SELECT *, CASE WHEN rule IN ('B0_NO_CURRENT_FRP', 'B1_LOW_COVERAGE', 'B3_UNMATCHED_HISTORY') THEN 'INSUFFICIENT_HISTORY' WHEN rule = 'B2_NO_EARLIER_DETECTION' THEN 'NEW_OR_TRANSIENT' WHEN abs(z) >= 3.5 THEN 'ABNORMAL_RELATIVE_TO_BASELINE' ELSE 'RECURRENT_WITHIN_BASELINE' END AS label FROM rule)"""


def behaviour(t: Tables) -> DataFrame:
    best = z_scores(t).groupBy("place").agg(F.max("n").alias("matched"), F.max_by("z", F.when(F.col("n") >= history.MIN_MATCHED, F.abs("z"))).alias("z"), F.count("*").alias("has"))
    joined = places_features(t).join(best, "place", "left")
    rule = rules.behaviour_rule(F.col("has").isNotNull(), F.col("coverage_28"), F.col("active_days_28"), F.col("matched"))
    out = joined.withColumn("rule", rule).select("place", "rule", "z", "active_days_28", "coverage_28")
    return out.withColumn("label", rules.behaviour_label(F.col("rule"), F.col("z")))


@register(sql("obs runs", BEHAVIOUR + " SELECT place, rule, label FROM behaviour"))
def behaviour_rule(t: Tables) -> DataFrame:
    return behaviour(t).select("place", "rule", "label")


SOURCE = f""", near AS (SELECT p.place, f.facility_type FROM places p JOIN facilities f ON {distance_sql('p', 'f')} <= 750),
 ctx AS (SELECT place, count(*) AS mapped, count(*) FILTER (facility_type <> 'POWER') AS thermal FROM near GROUP BY place),
 src AS (SELECT b.*, CASE WHEN place % 13 = 0 THEN 'CONTEXT_UNAVAILABLE_AS_OF' WHEN coalesce(mapped, 0) > 0 AND thermal = 0 THEN 'NON_THERMAL_POWER_CONTEXT' WHEN thermal > 0 AND (place % 10 / 10.0 >= 0.25 AND place % 11 <> 0 OR active_days_28 >= 5) THEN 'S1_INDUSTRIAL' WHEN thermal > 0 THEN 'WEAK_INDUSTRIAL_SUPPORT' WHEN place % 11 = 0 THEN 'LAND_COVER_UNAVAILABLE' WHEN place % 7 / 7.0 >= 0.5 AND active_days_28 < 5 AND coverage_28 < 0.8 THEN 'INSUFFICIENT_RECURRENCE_COVERAGE' WHEN place % 7 / 7.0 >= 0.5 AND active_days_28 < 5 THEN 'S2_AGRICULTURAL_BURN' WHEN place % 5 / 5.0 >= 0.5 AND place % 7 / 7.0 < 0.5 THEN 'S3_VEGETATION_FIRE' ELSE 'CONFLICTING_OR_MIXED_EVIDENCE' END AS source_rule FROM behaviour b LEFT JOIN ctx USING (place)),
 source AS (SELECT *, CASE source_rule WHEN 'S1_INDUSTRIAL' THEN 'INDUSTRIAL' WHEN 'S2_AGRICULTURAL_BURN' THEN 'AGRICULTURAL_BURN' WHEN 'S3_VEGETATION_FIRE' THEN 'VEGETATION_FIRE' ELSE 'UNKNOWN' END AS source FROM src)"""


def sources(t: Tables) -> DataFrame:
    near = spatial.near(t.places(), t.facilities(), 750.0)
    context = near.groupBy("place").agg(F.count("*").alias("mapped"), F.count_if(F.col("facility_type") != "POWER").alias("thermal"))
    p = F.col("place")
    known = p % 11 != 0
    b = behaviour(t).join(context, "place", "left").fillna(0, ["mapped", "thermal"])
    rule = rules.source_rule(p % 13 != 0, F.col("mapped"), F.col("thermal"), F.when(known, p % 10 / 10.0), F.when(known, p % 7 / 7.0), F.when(known, p % 5 / 5.0), F.col("active_days_28"), F.col("coverage_28"))
    return b.withColumn("source_rule", rule).withColumn("source", rules.source_label(F.col("source_rule")))


@register(sql("obs runs facilities places", BEHAVIOUR + SOURCE + " SELECT place, source_rule, source FROM source"))
def source_rule(t: Tables) -> DataFrame:
    return sources(t).select("place", "source_rule", "source")


@register(sql("obs runs facilities places", BEHAVIOUR + SOURCE + " SELECT place, CASE WHEN source = 'INDUSTRIAL' AND label = 'ABNORMAL_RELATIVE_TO_BASELINE' AND z > 0 THEN 'P1_HIGH' WHEN source = 'INDUSTRIAL' AND label = 'NEW_OR_TRANSIENT' THEN 'P2_HIGH' WHEN source = 'UNKNOWN' AND (label = 'NEW_OR_TRANSIENT' OR label = 'ABNORMAL_RELATIVE_TO_BASELINE' AND z > 0) THEN 'P3_REVIEW' WHEN label = 'INSUFFICIENT_HISTORY' AND source IN ('INDUSTRIAL', 'UNKNOWN') THEN 'P4_MEDIUM' WHEN source = 'UNKNOWN' THEN 'P5_MEDIUM' WHEN source = 'INDUSTRIAL' THEN 'P6_LOW' ELSE 'P7_LOW' END AS priority FROM source"))
def priority_rule(t: Tables) -> DataFrame:
    s = sources(t)
    way = rules.direction(F.col("label"), F.col("z"))
    return s.select("place", rules.priority_rule(F.col("source"), F.col("label"), way).alias("priority"))


@register(sql("obs", f"SELECT a.obs_id AS a, b.obs_id AS b, round({distance_sql('a', 'b')}, 3) AS distance_m FROM obs a JOIN obs b ON a.obs_id < b.obs_id AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.02 WHERE {distance_sql('a', 'b')} <= 1500"))
def pair_distances(t: Tables) -> DataFrame:
    return spatial.self_pairs(t.obs(), 1500.0, "obs_id").withColumn("distance_m", F.round("distance_m", 3))


@register()
def all_pair_distances(t: Tables) -> DataFrame:
    """pair_distances under its former name, held against brute force."""
    return spatial.self_pairs(t.obs(), 1500.0, "obs_id").withColumn("distance_m", F.round("distance_m", 3))


@register(sql("obs places", f"SELECT p.place, count(*) AS n, round(max(frp_mw), 6) AS max_frp FROM places p JOIN obs o ON abs(p.lat - o.lat) < 0.02 AND abs(p.lon - o.lon) < 0.02 WHERE {distance_sql('p', 'o')} <= 750 GROUP BY p.place"))
def radius_history(t: Tables) -> DataFrame:
    found = spatial.near(t.obs().select("obs_id", "lon", "lat", "frp_mw"), t.places(), 750.0)  # places are filed under nine cells, not observations
    return found.groupBy("place").agg(F.count("*").alias("n"), F.round(F.max("frp_mw"), 6).alias("max_frp"))


@register(sql("obs places plants", f"SELECT place, plant_id, round(d, 3) AS distance_m, rank FROM (SELECT place, plant_id, d, row_number() OVER (PARTITION BY place ORDER BY round(d, 3), plant_id) AS rank FROM (SELECT p.place, r.plant_id, {distance_sql('p', 'r')} AS d FROM places p JOIN plants r ON abs(p.lat - r.lat) < 0.1 AND abs(p.lon - r.lon) < 0.1) WHERE d <= 5000) WHERE rank <= 5"))
def nearest_registry(t: Tables) -> DataFrame:
    found = spatial.nearest_k(t.places(), t.plants(), 5000.0, 5, "place", "plant_id")
    return found.select("place", "plant_id", F.round("distance_m", 3).alias("distance_m"), "rank")


CANDIDATES = f", cand AS (SELECT place, fac_id, facility_type, d, row_number() OVER (PARTITION BY place ORDER BY round(d, 3), fac_id) AS rank FROM (SELECT p.place, f.fac_id, f.facility_type, {distance_sql('p', 'f')} AS d FROM places p JOIN facilities f ON abs(p.lat - f.lat) < 0.05 AND abs(p.lon - f.lon) < 0.05) WHERE d <= 2000)"


@register(sql("obs places facilities", CANDIDATES + " SELECT place, fac_id, round(d, 3) AS distance_m, CASE WHEN d <= 475 THEN 'INSIDE_SUPPORT' ELSE 'NEARBY' END AS relation, rank FROM cand WHERE rank <= 50"))
def facility_candidates(t: Tables) -> DataFrame:
    found = spatial.nearest_k(t.places(), t.facilities(), 2000.0, 50, "place", "fac_id")
    return found.select("place", "fac_id", F.round("distance_m", 3).alias("distance_m"), F.when(F.col("distance_m") <= 475, "INSIDE_SUPPORT").otherwise("NEARBY").alias("relation"), "rank")


@register(sql("obs places facilities", CANDIDATES + " SELECT place, CASE WHEN place % 9 = 0 THEN 'CONTEXT_NOT_COVERED' WHEN n > 1 THEN 'MULTIPLE_CANDIDATES' WHEN n = 1 THEN 'SINGLE_CANDIDATE' WHEN a > 0 THEN 'NEARBY_ONLY' ELSE 'NO_MAPPED_FEATURE' END AS status FROM places LEFT JOIN (SELECT place, count(*) FILTER (d <= 475) AS n, count(*) AS a FROM cand GROUP BY place) USING (place)"))
def association_status(t: Tables) -> DataFrame:
    found = spatial.near(t.places(), t.facilities(), 2000.0).groupBy("place").agg(F.count_if(F.col("distance_m") <= 475).alias("inside"), F.count("*").alias("near"))
    status = rules.first_match((F.col("place") % 9 == 0, "CONTEXT_NOT_COVERED"), (F.col("inside") > 1, "MULTIPLE_CANDIDATES"), (F.col("inside") == 1, "SINGLE_CANDIDATE"), (F.col("near") > 0, "NEARBY_ONLY"), otherwise="NO_MAPPED_FEATURE")
    return t.places().select("place").join(found, "place", "left").select("place", status.alias("status"))


def tagged(t: Tables) -> DataFrame:
    """Parts as mapped features: their type's words as tags."""
    k = F.col("p_partkey")
    pick = {"industrial": ["", "refinery", "Steel ", "yes", "lng", "chemical", "brickworks"], "power": ["", "plant", "generator"], "plant:source": ["", "solar", "solar; Wind", "coal;solar"], "man_made": ["", "works", "kiln"], "product": ["", "oil", "steel"]}
    pairs = []
    for i, (key, values) in enumerate(pick.items()):
        pairs += [F.lit(key), F.element_at(F.array(*map(F.lit, values)), (F.floor(k / (i + 1)) % len(values) + 1).cast("int"))]
    return t.read("part").select(k.alias("id"), F.map_filter(F.create_map(*pairs), lambda _, v: v != "").alias("tags"))


TAGS = """WITH p AS (SELECT p_partkey AS id, (['','refinery','Steel ','yes','lng','chemical','brickworks'])[CAST(p_partkey % 7 AS INTEGER) + 1] AS industrial0, (['','plant','generator'])[CAST(floor(p_partkey / 2) % 3 AS INTEGER) + 1] AS power, (['','solar','solar; Wind','coal;solar'])[CAST(floor(p_partkey / 3) % 4 AS INTEGER) + 1] AS src, (['','works','kiln'])[CAST(floor(p_partkey / 4) % 3 AS INTEGER) + 1] AS made, (['','oil','steel'])[CAST(floor(p_partkey / 5) % 3 AS INTEGER) + 1] AS product FROM part), q AS (SELECT *, lower(trim(industrial0)) AS industrial FROM p)"""


@register(TAGS + " SELECT id, CASE WHEN industrial = 'lng' THEN 'LNG' WHEN industrial = 'refinery' OR made = 'works' AND product = 'oil' THEN 'REFINERY' WHEN industrial = 'chemical' THEN 'PETROCHEMICAL' WHEN industrial = 'steel' OR product = 'steel' THEN 'STEEL' WHEN power <> '' THEN 'POWER' WHEN industrial NOT IN ('', 'yes') OR made = 'kiln' THEN 'OTHER' ELSE 'UNKNOWN' END AS facility_type, CASE WHEN made <> '' THEN 'man_made=' || made WHEN power <> '' THEN 'power=' || power WHEN industrial0 <> '' THEN 'industrial=' || industrial0 ELSE 'unknown' END AS primary_tag FROM q")
def facility_type(t: Tables) -> DataFrame:
    return tagged(t).select("id", mapped.facility_type(F.col("tags")).alias("facility_type"), mapped.primary_tag(F.col("tags")).alias("primary_tag"))


@register(TAGS + " SELECT id, NOT (power <> '' AND src IN ('solar', 'solar; Wind')) AS thermal FROM q")
def power_context(t: Tables) -> DataFrame:
    return tagged(t).select("id", mapped.thermal_candidate(F.col("tags")).alias("thermal"))


@register("SELECT event_id AS id, round(500 * sqrt(s * s + k * k) + 100, 6) AS radius_m, basis FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.375 ELSE 0.3 + event_id % 9 * 0.05 END AS s, CASE WHEN event_id % 4 = 0 THEN 0.375 ELSE 0.4 + event_id % 5 * 0.05 END AS k, CASE WHEN event_id % 4 = 0 THEN 'NOMINAL' ELSE 'SCAN_TRACK' END AS basis FROM events)")
def support_radius(t: Tables) -> DataFrame:
    e = F.col("event_id")
    scan, track = F.when(e % 4 != 0, 0.3 + e % 9 * 0.05), 0.4 + e % 5 * 0.05
    return t.read("events").select(e.alias("id"), F.round(geo.support_radius_m(scan, track), 6).alias("radius_m"), geo.support_basis(scan, track).alias("basis"))


@register("SELECT event_id AS id, CASE WHEN y >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(y) AS VARCHAR), 2, '0') || CASE WHEN x >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(x) AS VARCHAR), 3, '0') AS tile FROM (SELECT event_id, CAST(floor((event_id % 160 - 80) / 3) * 3 AS INTEGER) AS y, CAST(floor((event_id % 350 - 175) / 3) * 3 AS INTEGER) AS x FROM events)")
def tile_id(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.read("events").select(e.alias("id"), geo.tile_id((e % 350 - 175).cast("double"), (e % 160 - 80).cast("double")).alias("tile"))


SESSION = ", g AS (SELECT *, CASE WHEN acquired_at - lag(acquired_at) OVER w > INTERVAL 24 HOUR OR lag(acquired_at) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY place ORDER BY acquired_at, obs_id)), ses AS (SELECT *, sum(new) OVER (PARTITION BY place ORDER BY acquired_at, obs_id) AS session_no FROM g)"


@register(sql("obs", SESSION + " SELECT place, CAST(session_no AS BIGINT) AS session_no, CAST(epoch(min(acquired_at)) AS BIGINT) AS started_at, CAST(epoch(max(acquired_at)) AS BIGINT) AS ended_at, count(*) AS n_observations, count(DISTINCT (acquired_at, satellite)) AS n_overpasses, round(max(frp_mw), 6) AS max_frp_mw FROM ses GROUP BY place, session_no"))
def sessions(t: Tables) -> DataFrame:
    out = episodes.rollup(episodes.sessions(t.obs(), "place"), "place", "session_no")
    return out.withColumns({"started_at": F.unix_timestamp("started_at"), "ended_at": F.unix_timestamp("ended_at"), "max_frp_mw": F.round("max_frp_mw", 6)})


def grouped(t: Tables) -> DataFrame:
    return episodes.assemble(t.obs().select(F.col("obs_id").alias("id"), "acquired_at", "lon", "lat"))


def assembled(t: Tables) -> DataFrame:
    o = t.obs().withColumnRenamed("obs_id", "id")
    return o.join(grouped(t).hint("merge"), "id")  # a file of few bytes a row, but not as a hash table


# a place's points all link, so an episode is a greedy cut of its sorted points at gaps of a day or spans of a week
EPISODES = """, s AS (SELECT place, obs_id, acquired_at, frp_mw, satellite, row_number() OVER (PARTITION BY place ORDER BY acquired_at, obs_id) AS k FROM obs),
 r AS (SELECT place, obs_id, acquired_at, k, acquired_at AS first, 1 AS no FROM s WHERE k = 1 UNION ALL SELECT s.place, s.obs_id, s.acquired_at, s.k, CASE WHEN s.acquired_at - r.acquired_at > INTERVAL 24 HOUR OR s.acquired_at - r.first > INTERVAL 168 HOUR THEN s.acquired_at ELSE r.first END, r.no + CASE WHEN s.acquired_at - r.acquired_at > INTERVAL 24 HOUR OR s.acquired_at - r.first > INTERVAL 168 HOUR THEN 1 ELSE 0 END FROM r JOIN s ON s.place = r.place AND s.k = r.k + 1)"""


@register(sql("obs", EPISODES.replace(", s AS", ", s AS", 1) + " SELECT r.place, CAST(epoch(min(r.acquired_at)) AS BIGINT) AS started_at, CAST(epoch(max(r.acquired_at)) AS BIGINT) AS ended_at, count(*) AS n_observations, count(DISTINCT r.acquired_at) AS n_overpasses, round(max(s.frp_mw), 6) AS max_frp_mw FROM r JOIN s USING (place, k) GROUP BY r.place, r.no").replace("WITH ", "WITH RECURSIVE ", 1))
def event_rollup(t: Tables) -> DataFrame:
    out = episodes.rollup(assembled(t), "place", "event_id").drop("event_id")
    return out.withColumns({"started_at": F.unix_timestamp("started_at"), "ended_at": F.unix_timestamp("ended_at"), "max_frp_mw": F.round("max_frp_mw", 6)})


@register(sql("obs", EPISODES + " SELECT place, count(DISTINCT no) AS n_events, count(*) AS n_observations, CAST(epoch(min(acquired_at)) AS BIGINT) AS first_seen, CAST(epoch(max(acquired_at)) AS BIGINT) AS last_seen FROM r GROUP BY place").replace("WITH ", "WITH RECURSIVE ", 1))
def site_rollup(t: Tables) -> DataFrame:
    a = assembled(t)
    return a.groupBy("site_id").agg(F.min("place").alias("place"), F.count_distinct("event_id").alias("n_events"), F.count("*").alias("n_observations"), F.unix_timestamp(F.min("acquired_at")).alias("first_seen"), F.unix_timestamp(F.max("acquired_at")).alias("last_seen")).drop("site_id")


@register()
def event_builder_full(t: Tables) -> DataFrame:
    return grouped(t).select("id", "event_id", "site_id", "event_ambiguous", "merges", "site_ambiguous")


@register(sql("obs", "SELECT obs_id FROM obs WHERE obs_id % 4 = 0 AND acquired_at < (SELECT max(acquired_at) FROM obs WHERE obs_id % 4 <> 0)"))
def late_arrivals(t: Tables) -> DataFrame:
    return episodes.late_arrivals(t.obs(), t.obs().filter("obs_id % 4 != 0")).select("obs_id")


LINEAGE = """WITH n AS (SELECT event_id AS obs_id, user_id * 3 + event_id % 3 AS new_id FROM events WHERE event_id % 10 <> 0), o AS (SELECT event_id AS obs_id, user_id * 3 + event_id % 9 // 3 AS old_id FROM events WHERE event_id % 4 <> 1 OR user_id % 2 = 0),
 l AS (SELECT new_id, old_id, count(*) AS shared FROM n JOIN o USING (obs_id) GROUP BY ALL), c AS (SELECT l.*, count(*) OVER (PARTITION BY new_id) AS s, count(*) OVER (PARTITION BY old_id) AS t, (SELECT count(*) FROM n WHERE n.new_id = l.new_id) AS nn, (SELECT count(*) FROM o WHERE o.old_id = l.old_id) AS no FROM l)
 SELECT new_id, old_id, CASE WHEN s > 1 AND t > 1 THEN 'CHANGED' WHEN s > 1 THEN 'MERGED' WHEN t > 1 THEN 'SPLIT' WHEN shared = nn AND shared = no THEN 'SAME' WHEN shared = no THEN 'GREW' WHEN shared = nn THEN 'SHRANK' ELSE 'CHANGED' END AS relation, shared FROM c"""


@register(LINEAGE)
def lineage(t: Tables) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = t.read("events")
    new = rows.filter(e % 10 != 0).select((u * 3 + e % 3).alias("event_id"), e.alias("obs_id"))
    old = rows.filter((e % 4 != 1) | (u % 2 == 0)).select((u * 3 + F.floor(e % 9 / 3)).alias("event_id"), e.alias("obs_id"))
    return episodes.lineage(new, old)


@register(sql("obs places", f", e AS (SELECT a.place AS a, b.place AS b FROM places a JOIN places b ON a.place <> b.place AND abs(a.lat - b.lat) < 0.03 AND abs(a.lon - b.lon) < 0.03 AND {distance_sql('a', 'b')} <= 2060), w(node, root) AS (SELECT place, place FROM places UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node) SELECT node AS place, min(root) AS root FROM w GROUP BY node").replace("WITH ", "WITH RECURSIVE ", 1))
def site_groups(t: Tables) -> DataFrame:
    places = t.places()
    pairs = spatial.self_pairs(places, 2060.0, "place")
    return comp.components(places.select(F.col("place").alias("node")), pairs).select(F.col("node").alias("place"), "root")


HASH_GROUP = "sha256('split-v1' || chr(31) || split_group)"
SPLITS = f""", g AS (SELECT region_id, split_group, count(*) AS n, {HASH_GROUP} AS h FROM cases GROUP BY ALL), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY region_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY region_id) AS share, row_number() OVER (PARTITION BY region_id ORDER BY h DESC) AS back, count(*) OVER (PARTITION BY region_id) AS groups FROM g),
 a AS (SELECT *, CASE WHEN share < 0.6 THEN 'TRAIN' WHEN share < 0.8 THEN 'VALIDATION' ELSE 'TEST' END AS s0 FROM k), b AS (SELECT *, CASE WHEN groups >= 3 AND back = 1 AND NOT bool_or(s0 = 'TEST') OVER (PARTITION BY region_id) THEN 'TEST' ELSE s0 END AS s1 FROM a),
 split AS (SELECT region_id, split_group, CASE WHEN groups >= 3 AND back = 2 AND NOT bool_or(s1 = 'VALIDATION') OVER (PARTITION BY region_id) THEN 'VALIDATION' ELSE s1 END AS split FROM b)"""


@register(sql("cases", SPLITS + " SELECT * FROM split"))
def split_assignment(t: Tables) -> DataFrame:
    return labels.assign_splits(t.cases())


ORDERED = SPLITS + f""", c AS (SELECT id, region_id, split_group, split, sha256('split-v1' || chr(31) || 'rank' || chr(31) || id) AS hc, {HASH_GROUP} AS hg FROM cases JOIN split USING (region_id, split_group)),
 c1 AS (SELECT *, row_number() OVER (PARTITION BY split, region_id, split_group ORDER BY hc) AS r FROM c), c2 AS (SELECT *, row_number() OVER (PARTITION BY split, region_id ORDER BY r, hg) AS i FROM c1), c3 AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY i, region_id) - 1 AS j FROM c2),
 c4 AS (SELECT id, split, CASE split WHEN 'VALIDATION' THEN j ELSE j // 2 END AS cy, CASE split WHEN 'TEST' THEN j % 2 * 3 WHEN 'TRAIN' THEN 1 + j % 2 * 3 ELSE 2 END AS turn FROM c3), placed AS (SELECT id, split, row_number() OVER (ORDER BY cy, turn) AS place FROM c4)"""


def placed(t: Tables) -> DataFrame:
    cases = t.cases()
    return labels.review_order(cases.join(labels.assign_splits(cases), ["region_id", "split_group"]))


@register(sql("cases", ORDERED + " SELECT * FROM placed"))
def review_order(t: Tables) -> DataFrame:
    return placed(t)


@register(sql("cases reviews", ORDERED + " SELECT id, place FROM placed WHERE id NOT IN (SELECT id FROM reviews WHERE role = 'REVIEWER') ORDER BY place LIMIT 100"))
def review_queue(t: Tables) -> DataFrame:
    return placed(t).join(t.reviews().filter("role = 'REVIEWER'"), "id", "left_anti").select("id", "place").orderBy("place").limit(100)


@register(sql("obs facilities places cases", SPLITS + f", f AS (SELECT f.fac_id, count(DISTINCT s.split) AS n_splits, string_agg(DISTINCT s.split, ',' ORDER BY s.split) AS splits FROM places p JOIN facilities f ON abs(p.lat - f.lat) < 0.1 AND abs(p.lon - f.lon) < 0.1 AND {distance_sql('p', 'f')} <= 5000 JOIN split s ON s.split_group = 'g' || p.place GROUP BY f.fac_id) SELECT * FROM f WHERE n_splits > 1"))
def grouping_audit(t: Tables) -> DataFrame:
    split = labels.assign_splits(t.cases()).select("split_group", "split")
    near = spatial.near(t.places(), t.facilities(), 5000.0).withColumn("split_group", F.concat(F.lit("g"), F.col("place").cast("string")))
    crossing = near.join(split, "split_group").groupBy("fac_id").agg(F.count_distinct("split").alias("n_splits"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))
    return crossing.filter("n_splits > 1")


RESOLVED = """, per AS (SELECT id, count(*) FILTER (role = 'REVIEWER') AS n, max(seq) FILTER (role = 'REVIEWER') AS last, count(DISTINCT source_label) FILTER (role = 'REVIEWER') AS labels, arg_min(source_label, seq) FILTER (role = 'REVIEWER') AS l1, bool_or(qualifies) FILTER (role = 'REVIEWER') AS good, bool_and(certainty IN ('HIGH', 'MEDIUM') AND inside) FILTER (role = 'REVIEWER') AS sure, arg_min(qualifies, seq) FILTER (role = 'REVIEWER') AS q1 FROM reviews GROUP BY id),
 adj AS (SELECT r.id, arg_max(r.source_label, r.seq) AS al, arg_max(r.qualifies, r.seq) AS aq FROM reviews r JOIN per USING (id) WHERE r.role = 'ADJUDICATOR' AND n >= 2 AND r.seq > last GROUP BY r.id),
 x AS (SELECT c.*, coalesce(n, 0) AS n, labels, l1, good, sure, q1, al, aq FROM cases c LEFT JOIN per USING (id) LEFT JOIN adj USING (id)),
 b AS (SELECT *, CASE WHEN al = 'UNRESOLVED' THEN 'ADJUDICATED_UNRESOLVED' WHEN al IS NOT NULL THEN 'ADJUDICATED' WHEN n >= 2 AND labels > 1 THEN 'DISAGREEMENT_PENDING_ADJUDICATION' WHEN n >= 2 AND l1 = 'UNRESOLVED' THEN 'REVIEWERS_UNSURE' WHEN n >= 2 THEN 'TWO_REVIEWERS_AGREE' WHEN n = 1 AND l1 = 'UNRESOLVED' THEN 'REVIEWER_UNSURE' WHEN n = 1 AND review_slots >= 2 THEN 'ONE_OF_TWO_REVIEWS' WHEN n = 1 THEN 'ONE_REVIEWER' WHEN silver IS NOT NULL THEN 'REGISTRY_CORROBORATED' WHEN weak <> 'UNKNOWN' THEN 'RULES' ELSE 'UNLABELLED' END AS basis FROM x),
 resolved AS (SELECT id, CASE WHEN basis IN ('ADJUDICATED_UNRESOLVED', 'DISAGREEMENT_PENDING_ADJUDICATION', 'REVIEWERS_UNSURE', 'REVIEWER_UNSURE') THEN 'UNRESOLVED' WHEN basis = 'ADJUDICATED' THEN al WHEN n >= 1 THEN l1 WHEN basis = 'REGISTRY_CORROBORATED' THEN silver WHEN basis = 'RULES' THEN weak END AS label,
  CASE WHEN basis IN ('ADJUDICATED_UNRESOLVED', 'DISAGREEMENT_PENDING_ADJUDICATION', 'REVIEWERS_UNSURE', 'REVIEWER_UNSURE') THEN 'UNRESOLVED' WHEN basis = 'ADJUDICATED' THEN CASE WHEN aq THEN 'GOLD' ELSE 'SILVER' END WHEN basis = 'TWO_REVIEWERS_AGREE' THEN CASE WHEN good AND sure THEN 'GOLD' ELSE 'SILVER' END WHEN basis = 'ONE_OF_TWO_REVIEWS' OR basis = 'REGISTRY_CORROBORATED' THEN 'SILVER' WHEN basis = 'ONE_REVIEWER' THEN CASE WHEN q1 THEN 'GOLD' ELSE 'SILVER' END WHEN basis = 'RULES' THEN 'WEAK' END AS tier, basis FROM b)"""


@register(sql("cases reviews", RESOLVED + " SELECT *, coalesce(tier = 'GOLD' AND basis IN ('TWO_REVIEWERS_AGREE', 'ADJUDICATED'), false) AS test_eligible FROM resolved"))
def resolve_label(t: Tables) -> DataFrame:
    out = labels.resolve_labels(t.cases(), t.reviews())
    return out.withColumn("test_eligible", labels.test_eligible(F.col("tier"), F.col("basis")))


@register(sql("cases reviews", SPLITS + RESOLVED.replace(" b AS", " bb AS").replace("FROM b)", "FROM bb)") + " SELECT split, count(*) FILTER (tier = 'GOLD') AS gold, count(*) FILTER (tier = 'SILVER') AS silver, count(*) FILTER (tier = 'WEAK') AS weak, count(*) FILTER (tier = 'UNRESOLVED') AS unresolved, count(*) FILTER (basis LIKE '%PENDING%') AS pending FROM resolved JOIN cases USING (id) JOIN split USING (region_id, split_group) GROUP BY split"))
def label_summary(t: Tables) -> DataFrame:
    cases = t.cases()
    rows = labels.resolve_labels(cases, t.reviews()).join(cases.select("id", "region_id", "split_group"), "id").join(labels.assign_splits(cases), ["region_id", "split_group"])
    tiers = [F.count_if(F.col("tier") == x).alias(x.lower()) for x in ("GOLD", "SILVER", "WEAK", "UNRESOLVED")]
    return rows.groupBy("split").agg(*tiers, F.count_if(F.col("basis").contains("PENDING")).alias("pending"))


@register(sql("reviews", ", p AS (SELECT a.source_label AS a, b.source_label AS b FROM reviews a JOIN reviews b USING (id) WHERE a.seq = 1 AND b.seq = 2), c AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po FROM p), e AS (SELECT sum(x * y) AS xy FROM (SELECT a AS k, count(*) AS x FROM p GROUP BY a) JOIN (SELECT b AS k, count(*) AS y FROM p GROUP BY b) USING (k)) SELECT n, round(CASE WHEN xy / (n * n) < 1 THEN (po - xy / (n * n)) / (1 - xy / (n * n)) END, 6) AS kappa FROM c, e"))
def cohen_kappa(t: Tables) -> DataFrame:
    r = t.reviews().select("id", "seq", "source_label")
    return labels.cohen_kappa(r.filter("seq = 1").select("id", F.col("source_label").alias("a")).join(r.filter("seq = 2").select("id", F.col("source_label").alias("b")), "id").select("a", "b"))


@register(sql("cases", ", h AS (SELECT region_id, sha256(id || '|' || region_id || '|' || split_group || '|' || coalesce(silver, '')) AS h FROM cases), d AS (SELECT region_id, count(*) AS n, substr(h, 1, 4) AS block, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY region_id, substr(h, 1, 4)) SELECT region_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY block)) AS digest FROM d GROUP BY region_id"))
def case_set_fingerprint(t: Tables) -> DataFrame:
    return labels.fingerprint(t.cases().fillna("", ["silver"]), ["region_id"], "id", "region_id", "split_group", "silver")


FEATURES = "count(*) AS n, count(DISTINCT (acquired_at, satellite)) AS overpasses, count(DISTINCT CAST(acquired_at AS DATE)) AS active_days, round((epoch(max(acquired_at)) - epoch(min(acquired_at))) / 3600, 6) AS duration_h, round(max(frp_mw), 6) AS max_frp, round(median(frp_mw), 6) AS median_frp, round(avg(CAST(daynight = 'N' AS DOUBLE)), 6) AS night_fraction, round(avg(CAST(confidence = 'h' AS DOUBLE)), 6) AS high_fraction, round(avg(CAST(confidence = 'l' AS DOUBLE)), 6) AS low_fraction, round(median(i4 - i5), 6) AS median_i4_i5"


@register(sql("obs", SESSION + f" SELECT place, CAST(session_no AS BIGINT) AS session_no, {FEATURES} FROM ses GROUP BY place, session_no"))
def episode_features(t: Tables) -> DataFrame:
    return features.episode_features(episodes.sessions(t.obs(), "place"), "place", "session_no")


@register(sql("obs", f"SELECT place, count(*) FILTER (acquired_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) AS recent, round(least(epoch(TIMESTAMP '{AS_OF}') / 86400 - epoch(max(acquired_at)) / 86400, 90.0), 6) AS days_since_last FROM obs WHERE acquired_at < TIMESTAMP '{AS_OF}' GROUP BY place"))
def history_features(t: Tables) -> DataFrame:
    start = F.lit(AS_OF).cast("timestamp")
    o = t.obs().filter(F.col("acquired_at") < start)
    since = (F.unix_timestamp(start) - F.unix_timestamp(F.max("acquired_at"))) / 86400
    return o.groupBy("place").agg(F.count_if(F.col("acquired_at") >= start - F.make_dt_interval(F.lit(14))).alias("recent"), F.round(F.least(since, F.lit(90.0)), 6).alias("days_since_last"))


@register(sql("obs places facilities", CANDIDATES.replace("<= 2000", "<= 5000").replace("< 0.05", "< 0.1") + " SELECT place, CASE WHEN place % 9 = 0 THEN 0 ELSE 1 END AS osm_covered, CASE WHEN place % 9 <> 0 THEN coalesce(n, 0) END::DOUBLE AS n_near, CASE WHEN place % 9 <> 0 THEN coalesce(p, 0) END::DOUBLE AS n_power, CASE WHEN place % 9 <> 0 THEN round(coalesce(d, 5000), 3) END AS nearest_m FROM places LEFT JOIN (SELECT place, count(*) AS n, count(*) FILTER (facility_type = 'POWER') AS p, min(d) AS d FROM cand GROUP BY place) USING (place)"))
def osm_features(t: Tables) -> DataFrame:
    found = spatial.near(t.places(), t.facilities(), 5000.0).groupBy("place").agg(F.count("*").alias("n"), F.count_if(F.col("facility_type") == "POWER").alias("p"), F.min("distance_m").alias("d"))
    known = F.col("place") % 9 != 0
    zero = F.lit(0)
    return t.places().select("place").join(found, "place", "left").select("place", known.cast("int").alias("osm_covered"), F.when(known, F.coalesce("n", zero)).cast("double").alias("n_near"), F.when(known, F.coalesce("p", zero)).cast("double").alias("n_power"), F.when(known, F.round(F.coalesce("d", F.lit(5000.0)), 3)).alias("nearest_m"))


@register("WITH p AS (SELECT l_suppkey AS id, (['tree','shrub','grass','crop','built'])[CAST(l_partkey % 6 AS INTEGER) + 1] AS class FROM lineitem), c AS (SELECT id, class, count(*) AS n FROM p WHERE class IS NOT NULL GROUP BY ALL) SELECT id, class, round(n / sum(n) OVER (PARTITION BY id), 6) AS fraction, row_number() OVER (PARTITION BY id ORDER BY n DESC, class) AS rank FROM c")
def landcover_fractions(t: Tables) -> DataFrame:
    codes = F.element_at(F.array(*map(F.lit, (10, 20, 30, 40, 50, 7))), (F.col("l_partkey") % 6 + 1).cast("int"))
    return landcover.fractions(t.read("lineitem").select(F.col("l_suppkey").alias("id"), codes.alias("code")))


@register(sql("predictions", ", c AS (SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM predictions) SELECT tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c"))
def confusion_metrics(t: Tables) -> DataFrame:
    return features.confusion(t.predictions())


@register(sql("predictions", "SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM predictions GROUP BY 1"))
def reliability_bins(t: Tables) -> DataFrame:
    return features.reliability(t.predictions())


THRESHOLDS = [0.5 + 0.025 * k for k in range(20)]


@register(sql("predictions", ", r AS (SELECT greatest(p, 1 - p) AS sure, CAST(CAST(p >= 0.5 AS INTEGER) <> y AS DOUBLE) AS wrong FROM predictions) SELECT threshold, count(*) FILTER (sure >= threshold) AS decided, round(count(*) FILTER (sure >= threshold) / count(*), 6) AS coverage, round(avg(wrong) FILTER (sure >= threshold), 6) AS risk FROM r, (SELECT unnest([" + ", ".join(f"{x!r}::DOUBLE" for x in THRESHOLDS) + "]) AS threshold) GROUP BY threshold"))
def abstention_curve(t: Tables) -> DataFrame:
    return features.abstention_curve(t.predictions(), THRESHOLDS)


@register(sql("predictions", "SELECT grp, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier FROM predictions GROUP BY grp"))
def brier(t: Tables) -> DataFrame:
    return features.brier(t.predictions(), "grp")


@register(sql("predictions", """, s AS (SELECT grp, count(*) AS n, count(*) FILTER (pred = y) AS hit FROM predictions GROUP BY grp), d AS (SELECT s.*, r.k, ('0x' || substr(md5('11|' || grp || '|' || r.k), 1, 13))::BIGINT / pow(2, 52) AS u FROM s, range(1000) r(k)),
 w AS (SELECT k, n, hit, """ + " + ".join(f"CAST(u >= {x!r} AS INTEGER)" for x in features.POISSON) + """ AS w FROM d), a AS (SELECT k, sum(w * hit) / sum(w * n) AS acc FROM w GROUP BY k HAVING sum(w * n) > 0) SELECT count(*) AS replicates, round(quantile_cont(acc, 0.025), 9) AS low, round(quantile_cont(acc, 0.975), 9) AS high FROM a"""))
def bootstrap_ci(t: Tables) -> DataFrame:
    return features.bootstrap_interval(t.predictions(), "grp")


@register(sql("cases", SPLITS + " SELECT region_id, count(*) FILTER (split = 'TRAIN') AS train, count(*) FILTER (split = 'VALIDATION') AS validation, count(*) FILTER (split = 'TEST') AS test FROM cases JOIN split USING (region_id, split_group) GROUP BY region_id"))
def held_out_counts(t: Tables) -> DataFrame:
    cases = t.cases()
    joined = cases.join(labels.assign_splits(cases), ["region_id", "split_group"])
    return joined.groupBy("region_id").agg(*[F.count_if(F.col("split") == s).alias(s.lower()) for s in ("TRAIN", "VALIDATION", "TEST")])


@register("WITH i AS (SELECT l_partkey AS id, l_linenumber % 2 AS payload, l_orderkey * 10 + l_linenumber AS row_number FROM lineitem), k AS (SELECT p_partkey AS id, 1 AS payload FROM part WHERE p_partkey % 3 = 0), r AS (SELECT i.*, k.payload AS known, row_number() OVER (PARTITION BY id ORDER BY row_number) AS n, first_value(i.payload) OVER (PARTITION BY id ORDER BY row_number) AS first FROM i LEFT JOIN k USING (id)) SELECT id, row_number, CASE WHEN payload <> coalesce(known, first) THEN 'SOURCE_REVISION_CONFLICT' WHEN n = 1 AND known IS NULL THEN 'INSERTED' ELSE 'DUPLICATE' END AS outcome FROM r")
def ingest_dedupe(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 2).alias("payload"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"))
    known = t.read("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit(1).alias("payload"))
    return detections.ingest(known, rows)


def validated(t: Tables) -> DataFrame:
    return detections.validate(raw_rows(t), "N20", "2024-01-10", 5, (69.5, 22.0, 70.5, 23.0))


@register(RAW + " SELECT coalesce(reason, 'VALID') AS reason, count(*) AS n FROM v GROUP BY 1")
def quarantine_reasons(t: Tables) -> DataFrame:
    return validated(t).groupBy(F.coalesce("reason", F.lit("VALID")).alias("reason")).count().withColumnRenamed("count", "n")


@register(RAW + """ SELECT id, sha256('{"acquired_at":"' || strftime(ts, '%Y-%m-%d') || 'T' || substr(lpad(tm, 4, '0'), 1, 2) || ':' || substr(lpad(tm, 4, '0'), 3, 2) || ':00+00:00","latitude":"' || CASE la WHEN '22.30' THEN '22.3' WHEN '22.310' THEN '22.31' ELSE la END || '","longitude":"' || CASE lo WHEN '70.9' THEN lo ELSE '69.8' END || '","namespace":"nasa","product":"VIIRS_NOAA20_NRT","satellite":"' || sat || '","sensor":"VIIRS","version":"firms-identity-v1"}') AS identity FROM v WHERE reason IS NULL""")
def identity_hash(t: Tables) -> DataFrame:
    return validated(t).filter("reason IS NULL").select("id", detections.identity("nasa", "VIIRS_NOAA20_NRT").alias("identity"))


@register(r"SELECT event_id AS id, CASE WHEN cell IS NULL THEN '' WHEN regexp_matches(cell, '^[ \x{3000}]*[=+\-@\t\r\n\x{FF1D}\x{FF0B}\x{FF0D}\x{FF20}]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=' || event_type WHEN 1 THEN '  +' || event_type WHEN 2 THEN event_type || '=1' END AS cell FROM events)")
def export_csv_cells(t: Tables) -> DataFrame:
    k, kind = F.col("event_id") % 4, F.col("event_type")
    cell = F.when(k == 0, F.concat(F.lit("="), kind)).when(k == 1, F.concat(F.lit("  +"), kind)).when(k == 2, F.concat(kind, F.lit("=1")))
    return t.read("events").select(F.col("event_id").alias("id"), exports.csv_cell(cell).alias("cell"))


@register("WITH m AS (SELECT 'f' || p_partkey AS path, sha256(p_name) AS sha FROM part WHERE p_partkey % 5 <> 0), f AS (SELECT 'f' || p_partkey AS path, sha256(CASE WHEN p_partkey % 7 = 0 THEN p_name || 'x' ELSE p_name END) AS sha FROM part WHERE p_partkey % 3 <> 0) SELECT * FROM (SELECT path, CASE WHEN f.sha IS NULL THEN 'MISSING' WHEN m.sha IS NULL THEN 'NOT_IN_MANIFEST' WHEN f.sha <> m.sha THEN 'HASH_MISMATCH' END AS problem FROM m FULL JOIN f USING (path)) WHERE problem IS NOT NULL")
def package_verify(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    path = F.concat(F.lit("f"), k.cast("string")).alias("path")
    part = t.read("part")
    manifest = part.filter(k % 5 != 0).select(path, F.sha2(name, 256).alias("sha256"))
    return exports.verify(manifest, part.filter(k % 3 != 0).select(path, F.sha2(F.when(k % 7 == 0, F.concat(name, F.lit("x"))).otherwise(name), 256).alias("sha256")))


@register("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'DATED_IMAGERY' WHEN 1 THEN 'OFFICIAL_OR_COMPANY' ELSE 'NEWS_REPORT' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN o.day BETWEEN DATE '2023-06-01' - 365 AND DATE '2023-06-10' + 30 WHEN 1 THEN true ELSE false END AS independent FROM (SELECT o_orderkey, DATE '2022-01-01' + CAST(o_orderkey % 900 AS INTEGER) AS day FROM orders) o")
def evidence_independence(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "DATED_IMAGERY").when(k % 3 == 1, "OFFICIAL_OR_COMPANY").otherwise("NEWS_REPORT")
    day = F.date_add(F.lit("2022-01-01").cast("date"), (k % 900).cast("int"))
    return t.read("orders").select(k.alias("id"), kind.alias("kind"), labels.independent(kind, day, F.lit("2023-06-01"), F.lit("2023-06-10")).alias("independent"))


HOSTS = ["https://Firms.example.org/a", "http://overpass.test/api", "https://maps.example.com/maps/x", "https://maps.example.com/about", "https://tiles.basemap.test/1", "https://news.test/overpass/9", "not a url"]


@register("WITH u AS (SELECT event_id AS id, ([" + ", ".join(f"'{x}'" for x in HOSTS) + """])[event_id % 7 + 1] AS url FROM events), p AS (SELECT id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://[^/]+(/[^?]*)', 1)) AS path FROM u)
 SELECT id, CASE WHEN host = 'firms.example.org' OR host LIKE '%.firms.example.org' OR contains(host, 'overpass') OR contains(path, '/overpass') THEN 'PROJECT_INPUT' WHEN contains(host, 'basemap') OR contains(host, 'maps.example.com') AND starts_with(path, '/maps') THEN 'UNDATED_BASEMAP' END AS forced FROM p""")
def forced_kind(t: Tables) -> DataFrame:
    url = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("event_id") % 7 + 1).cast("int"))
    return t.read("events").select(F.col("event_id").alias("id"), labels.forced_kind(url, ["firms.example.org"], ["basemap"], ["maps.example.com"]).alias("forced"))


EDGES = ", sq AS (SELECT *, unnest([0.005::DOUBLE, 0.001::DOUBLE]) AS r FROM facilities), ed AS (SELECT fac_id, facility_type, lon AS fx, lat AS fy, lon + a * r AS ax, lat + b * r AS ay, lon + c * r AS bx, lat + d * r AS \"by\" FROM sq, (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) v(a, b, c, d))"


def edges_sql() -> str:
    """The distance to the nearest edge on the plane around the place, and whether a ray to the east crosses an odd number of edges."""
    up, across = scale_sql("p.lat")
    return f"""{EDGES}, m AS (SELECT place, fac_id, (ay > p.lat) <> ("by" > p.lat) AND p.lon < (bx - ax) * (p.lat - ay) / nullif("by" - ay, 0) + ax AS hit, (ax - p.lon) * {across} AS ax, (ay - p.lat) * {up} AS ay, (bx - p.lon) * {across} AS bx, ("by" - p.lat) * {up} AS "by" FROM places p JOIN ed ON abs(p.lat - fy) < 0.05 AND abs(p.lon - fx) < 0.05),
 n AS (SELECT *, bx - ax AS dx, "by" - ay AS dy FROM m), o AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM n),
 q AS (SELECT place, fac_id, count(*) FILTER (hit) % 2 = 1 AS inside, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS edge FROM o GROUP BY ALL)
 SELECT place, fac_id, round(CASE WHEN inside THEN 0.0 ELSE edge END, 3) AS distance_m, inside FROM q WHERE inside OR edge <= 2000"""


@register(sql("obs places facilities", edges_sql()))
def polygon_candidates(t: Tables) -> DataFrame:
    """Places near square areas around facilities, each with a square hole."""
    x, y = F.col("lon"), F.col("lat")

    def ring(r: float) -> Column:
        return F.array(*[F.struct((x + a * r).alias("lon"), (y + b * r).alias("lat")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])

    areas = t.facilities().select("fac_id", F.array(ring(0.005), ring(0.001)).alias("rings"), (x - 0.005).alias("west"), (y - 0.005).alias("south"), (x + 0.005).alias("east"), (y + 0.005).alias("north"))
    lon, lat, rings = F.col("lon"), F.col("lat"), F.col("rings")
    found = spatial.areas_near(t.places(), areas, 2000.0, geo.ring_distance_m(lon, lat, rings), geo.in_rings(lon, lat, rings))
    return found.select("place", "fac_id", F.round("distance_m", 3).alias("distance_m"), "inside")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


from cindertrace.plans import assessing, casework, intake, reviewing, storing  # noqa: E402, F401  (they register their queries)
