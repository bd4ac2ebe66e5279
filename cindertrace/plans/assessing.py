"""Queries that assess every episode's representative: history, context, rules, and what an export needs of them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindertrace.functions import geo, polygons
from cindertrace.operators import assessment, cases, context, episodes, hulls, landcover
from cindertrace.operators.components import checkpointed, shared_folder
from cindertrace.plans.adapter import Tables, covers_sql, distance_sql, scale_sql, sql
from cindertrace.registry import register

TABLES = "obs archive passes facilities areas snapshots pixels"
SESSIONS = """, g AS (SELECT *, CASE WHEN acquired_at - lag(acquired_at) OVER w > INTERVAL 24 HOUR OR lag(acquired_at) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM archive WINDOW w AS (PARTITION BY place ORDER BY acquired_at, obs_id)),
 ses AS (SELECT *, CAST(sum(new) OVER (PARTITION BY place ORDER BY acquired_at, obs_id) AS BIGINT) AS session_no FROM g)"""
SUBJECTS = SESSIONS + """, ep AS (SELECT place, session_no, min(acquired_at) AS started_at, max(acquired_at) AS ended_at, count(*) AS n FROM ses GROUP BY ALL),
 rep AS (SELECT place, session_no, obs_id AS sid, lon, lat, scan, track FROM ses QUALIFY row_number() OVER (PARTITION BY place, session_no ORDER BY frp_mw DESC NULLS LAST, acquired_at, obs_id) = 1),
 sub AS (SELECT sid, place, session_no, lon, lat, ended_at AS as_of, started_at, n, 500 * sqrt(coalesce(scan, 0.375) * coalesce(scan, 0.375) + coalesce(track, 0.375) * coalesce(track, 0.375)) + 100 AS radius_m FROM rep JOIN ep USING (place, session_no))"""


def members(t: Tables) -> DataFrame:
    return episodes.sessions(t.archive(), "place")


def subjects(t: Tables) -> DataFrame:
    """One row for each episode: its strongest observation, judged as of the episode's end."""
    return cases.representatives(members(t), "place", "session_no").select(
        F.col("obs_id").alias("sid"), "place", "session_no", "lon", "lat", F.col("ended_at").alias("as_of"), "started_at", F.col("n_observations").alias("n"), geo.support_radius_m(F.col("scan"), F.col("track")).alias("radius_m")
    )


@register(sql("obs archive", SUBJECTS + " SELECT sid, place, session_no, CAST(epoch(as_of) AS BIGINT) AS as_of, n, round(radius_m, 6) AS radius_m FROM sub"))
def episode_representatives(t: Tables) -> DataFrame:
    return subjects(t).select("sid", "place", "session_no", F.unix_timestamp("as_of").alias("as_of"), "n", F.round("radius_m", 6).alias("radius_m"))


def history_sql(operational: bool) -> str:
    known = " AND h.available_at <= s.as_of" if operational else ""
    got = " AND p.received_at <= s.as_of" if operational else ""
    return f""", cov AS (SELECT DISTINCT s.sid, s.as_of, p.product, CAST(d.d AS DATE) AS day FROM sub s JOIN passes p ON p.mode = 'HISTORICAL_REPLAY' AND p.status = 'SUCCEEDED' AND p.rejected_rows = 0{got} AND {covers_sql('p', 's', '750')}, range(p.start_date, p.end_date + INTERVAL 1 DAY, INTERVAL 1 DAY) d(d)),
 h0 AS (SELECT s.sid, s.as_of, h.obs_id, h.acquired_at, h.frp_mw, h.satellite, h.daynight, h.product FROM sub s JOIN archive h ON abs(s.lat - h.lat) < 0.01 AND abs(s.lon - h.lon) < 0.01 AND {distance_sql('s', 'h')} <= 750 AND h.acquired_at <= s.as_of AND h.acquired_at > s.as_of - INTERVAL 182 DAY{known}),
 sp AS (SELECT DISTINCT sid, day FROM cov WHERE product = 'SP'), spt AS (SELECT DISTINCT sid, acquired_at FROM h0 WHERE product = 'SP'),
 h AS (SELECT h0.*, h0.product = 'SP' OR (sp.day IS NULL AND spt.acquired_at IS NULL) AS kept FROM h0 LEFT JOIN sp ON sp.sid = h0.sid AND sp.day = CAST(h0.acquired_at AS DATE) LEFT JOIN spt ON spt.sid = h0.sid AND spt.acquired_at = h0.acquired_at)"""


@register(sql("obs archive passes", SUBJECTS + history_sql(False) + " SELECT sid, obs_id, kept FROM h"))
def subject_history(t: Tables) -> DataFrame:
    s = subjects(t)
    return assessment.as_of_history(s, t.archive(), assessment.covered_days(s, t.passes(), "HISTORICAL_REPLAY")).select("sid", "obs_id", "kept")


LEFT_OUT = f""", w0 AS (SELECT s.sid, h.acquired_at, h.product FROM sub s JOIN archive h ON abs(s.lat - h.lat) < 0.01 AND abs(s.lon - h.lon) < 0.01 AND {distance_sql('s', 'h')} <= 750 AND h.acquired_at <= s.as_of AND h.acquired_at > s.as_of - INTERVAL 182 DAY AND coalesce(h.available_at > s.as_of, true)),
 w1 AS (SELECT w0.sid FROM w0 LEFT JOIN sp ON sp.sid = w0.sid AND sp.day = CAST(w0.acquired_at AS DATE) LEFT JOIN spt ON spt.sid = w0.sid AND spt.acquired_at = w0.acquired_at WHERE w0.product = 'SP' OR (sp.day IS NULL AND spt.acquired_at IS NULL))"""


@register(sql("obs archive passes", SUBJECTS + history_sql(True) + LEFT_OUT + " SELECT sub.sid, count(w1.sid) AS excluded_unknown_availability FROM sub LEFT JOIN w1 ON w1.sid = sub.sid GROUP BY sub.sid"))
def unavailable_history(t: Tables) -> DataFrame:
    """How many detections an operational assessment leaves out since they were not known to be available by then."""
    s = checkpointed(subjects(t))
    return assessment.withheld(s, t.archive(), assessment.covered_days(s, t.passes(), "HISTORICAL_REPLAY", True))


WINDOWS = (7, 30, 90, 180)


def features_sql() -> str:
    inside = {d: f"acquired_at < st AND acquired_at >= st - INTERVAL {d} DAY" for d in WINDOWS}
    seen = ", ".join(f"count(*) FILTER ({w}) AS detections_{d}, count(DISTINCT (acquired_at, satellite)) FILTER ({w}) AS overpasses_{d}, count(DISTINCT CAST(acquired_at AS DATE)) FILTER ({w}) AS active_days_{d}, round((epoch(any_value(st)) - epoch(max(acquired_at) FILTER ({w}))) / 86400, 2) AS days_since_{d}" for d, w in inside.items())
    covered = ", ".join(f"count(DISTINCT day) FILTER (day < CAST(as_of - INTERVAL 24 HOUR AS DATE) AND day >= CAST(as_of - INTERVAL 24 HOUR AS DATE) - {d}) AS covered_{d}" for d in WINDOWS)
    zeros = ", ".join(f"coalesce({c}_{d}, 0) AS {c}_{d}" for c in ("detections", "overpasses", "active_days", "covered") for d in WINDOWS)
    shares = ", ".join(f"round(coalesce(covered_{d}, 0) / {d}, 3) AS coverage_{d}, days_since_{d}" for d in WINDOWS)
    return f""", l AS (SELECT *, as_of - INTERVAL 24 HOUR AS st FROM h WHERE kept), f1 AS (SELECT sid, count(*) FILTER (acquired_at > st) AS current_detections, {seen} FROM l GROUP BY sid),
 f2 AS (SELECT sid, count(*) FILTER (NOT kept) AS superseded FROM h GROUP BY sid), f3 AS (SELECT sid, {covered} FROM cov GROUP BY sid),
 po AS (SELECT sid, st, acquired_at, satellite, daynight, greatest(max(frp_mw), 0.0) AS frp FROM l WHERE frp_mw IS NOT NULL GROUP BY ALL),
 cg AS (SELECT sid, satellite, daynight, round(max(frp), 3) AS current_frp FROM po WHERE acquired_at > st GROUP BY ALL), bs AS (SELECT * FROM po WHERE acquired_at < st AND acquired_at >= st - INTERVAL 90 DAY),
 bm AS (SELECT sid, satellite, daynight, count(*) AS n, median(ln(1 + frp)) AS m FROM bs GROUP BY ALL), bd AS (SELECT sid, satellite, daynight, any_value(n) AS n, round(any_value(m), 5) AS med, round(median(abs(ln(1 + frp) - m)), 5) AS mad FROM bs JOIN bm USING (sid, satellite, daynight) GROUP BY sid, satellite, daynight),
 gz AS (SELECT sid, satellite || '/' || daynight AS grp, n, mad, (ln(1 + current_frp) - med) / greatest(1.4826 * mad, 0.1) AS raw, round(greatest(-50.0, least(50.0, (ln(1 + current_frp) - med) / greatest(1.4826 * mad, 0.1))), 3) AS z FROM cg LEFT JOIN bd USING (sid, satellite, daynight)),
 f4 AS (SELECT sid, count(*) AS cur, max(n) AS matched FROM gz GROUP BY sid), f5 AS (SELECT sid, grp, z, mad = 0 AS mad_zero, 1.4826 * mad < 0.1 AS floored, abs(raw) > 50 AS capped FROM gz WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(z) DESC, grp) = 1),
 feat AS (SELECT sub.*, {zeros}, {shares}, coalesce(superseded, 0) AS superseded, coalesce(current_detections, 0) AS current_detections, cur, matched, z, mad_zero, floored, capped, grp FROM sub LEFT JOIN f1 USING (sid) LEFT JOIN f2 USING (sid) LEFT JOIN f3 USING (sid) LEFT JOIN f4 USING (sid) LEFT JOIN f5 USING (sid))"""


def history_of(t: Tables, s: DataFrame, operational: bool = False) -> DataFrame:
    archive = t.archive()
    days = checkpointed(assessment.covered_days(s, t.passes(), "HISTORICAL_REPLAY", operational))
    return assessment.features(s, checkpointed(assessment.as_of_history(s, archive, days, operational)), days)


SHOWN = [f"{c}_{d}" for d in WINDOWS for c in ("detections", "overpasses", "active_days", "covered", "coverage", "days_since")] + ["superseded", "current_detections", "matched", "z", "mad_zero", "floored", "capped", "group"]


@register(sql("obs archive passes", SUBJECTS + history_sql(False) + features_sql() + " SELECT sid, " + ", ".join('grp AS "group"' if c == "group" else c for c in SHOWN) + " FROM feat"))
def subject_features(t: Tables) -> DataFrame:
    return history_of(t, checkpointed(subjects(t))).select("sid", *SHOWN)


def edges_sql() -> str:
    """The share of each candidate's support circle that its square takes."""
    up, across = scale_sql("lat")
    sector = lambda ax, ay, bx, by: f"radius_m * radius_m / 2 * atan2(({ax}) * ({by}) - ({ay}) * ({bx}), ({ax}) * ({bx}) + ({ay}) * ({by}))"
    return f""", sq AS (SELECT sid, fac_id, radius_m, (west - lon) * {across} AS x0, (east - lon) * {across} AS x1, (south - lat) * {up} AS y0, (north - lat) * {up} AS y1 FROM c0 WHERE distance_m <= radius_m),
 e AS (SELECT sid, fac_id, radius_m, unnest([x0, x1, x1, x0]) AS ax, unnest([y0, y0, y1, y1]) AS ay, unnest([x1, x1, x0, x0]) AS bx, unnest([y0, y1, y1, y0]) AS "by" FROM sq),
 e1 AS (SELECT *, bx - ax AS dx, "by" - ay AS dy FROM e), e2 AS (SELECT *, dx * dx + dy * dy AS sz, ax * dx + ay * dy AS al FROM e1), e3 AS (SELECT *, al * al - sz * (ax * ax + ay * ay - radius_m * radius_m) AS rt FROM e2),
 e4 AS (SELECT *, greatest((-al - sqrt(greatest(rt, 0))) / sz, 0.0) AS t, least((-al + sqrt(greatest(rt, 0))) / sz, 1.0) AS u FROM e3),
 ov AS (SELECT sid, fac_id, round(greatest(0.0, least(1.0, abs(sum(CASE WHEN rt <= 0 OR t >= u THEN {sector('ax', 'ay', 'bx', '"by"')} ELSE {sector('ax', 'ay', 'ax + t * dx', 'ay + t * dy')} + ((ax + t * dx) * (ay + u * dy) - (ay + t * dy) * (ax + u * dx)) / 2 + {sector('ax + u * dx', 'ay + u * dy', 'bx', '"by"')} END)) / (pi() * any_value(radius_m) * any_value(radius_m)))), 4) AS overlap FROM e4 GROUP BY sid, fac_id)"""


def context_sql(operational: bool) -> str:
    got = " AND p.received_at <= s.as_of" if operational else ""
    up, across = scale_sql("s.lat")
    distance = f"sqrt(pow(greatest(a.west - s.lon, s.lon - a.east, 0.0) * {across}, 2) + pow(greatest(a.south - s.lat, s.lat - a.north, 0.0) * {up}, 2))"
    return f""", snap AS (SELECT s.sid, p.snapshot_id, p.base_at FROM sub s JOIN snapshots p ON {covers_sql('p', 's', 'greatest(s.radius_m, 2000.0)')}{got} QUALIFY row_number() OVER (PARTITION BY s.sid ORDER BY p.base_at DESC, p.snapshot_id) = 1),
 c0 AS (SELECT s.sid, s.lon, s.lat, s.radius_m, a.*, {distance} AS distance_m FROM sub s JOIN snap USING (sid) JOIN areas a ON abs((a.north + a.south) / 2 - s.lat) < 0.05 AND abs((a.east + a.west) / 2 - s.lon) < 0.05 AND (a.fac_id + snap.snapshot_id) % 3 <> 0 WHERE {distance} <= 2000)"""


CANDIDATES = edges_sql() + """, cand AS (SELECT c0.*, CASE WHEN distance_m <= radius_m THEN 'INSIDE_SUPPORT' ELSE 'NEARBY' END AS relation, overlap, row_number() OVER (PARTITION BY sid ORDER BY round(distance_m, 3), fac_id) AS rank, count(*) OVER (PARTITION BY sid) > 50 AS truncated FROM c0 LEFT JOIN ov USING (sid, fac_id) QUALIFY rank <= 50)"""


def snapshot_of(t: Tables, s: DataFrame, operational: bool = False) -> DataFrame:
    return context.newest_snapshot(s.select("sid", "lon", "lat", "as_of", "radius_m"), t.snapshots(), "sid", F.greatest(F.col("radius_m"), F.lit(context.CONTEXT_M)), F.col("as_of") if operational else None)


def candidates_of(t: Tables, s: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Of the snapshot that holds for a subject; a snapshot lacks every third facility."""
    own = s.select("sid", "lon", "lat", "radius_m").join(snapshot.select("sid", "snapshot_id").hint("merge"), "sid")
    ids = t.snapshots().select("snapshot_id")
    stock = t.areas().crossJoin(F.broadcast(ids)).filter((F.col("fac_id") + F.col("snapshot_id")) % 3 != 0)  # the snapshots are some dozens
    return context.candidates(own, stock, "sid")


@register(sql(TABLES, SUBJECTS + context_sql(False) + CANDIDATES + " SELECT sid, fac_id, round(distance_m, 1) AS distance_m, round(distance_m, 3) = 0 AS inside, relation, overlap, rank, truncated FROM cand"))
def area_candidates(t: Tables) -> DataFrame:
    s = checkpointed(subjects(t))
    return candidates_of(t, s, snapshot_of(t, s)).select("sid", "fac_id", F.round("distance_m", 1).alias("distance_m"), "inside", "relation", "overlap", "rank", "truncated")


SUMMARY = """, ctx AS (SELECT sid, count(*) FILTER (relation = 'INSIDE_SUPPORT') AS mapped, count(*) FILTER (relation = 'INSIDE_SUPPORT' AND thermal_candidate) AS thermal, count(*) FILTER (relation <> 'INSIDE_SUPPORT' AND thermal_candidate) AS near_thermal, count(*) AS found,
  bool_or(facility_type = 'MINE') FILTER (relation = 'INSIDE_SUPPORT' AND thermal_candidate) AS mine, coalesce(bool_or(primary_tag = 'man_made=flare') FILTER (relation = 'INSIDE_SUPPORT' AND thermal_candidate), false) AS flare, bool_or(truncated) AS truncated FROM cand GROUP BY sid)"""
STATUS = "CASE WHEN snapshot_id IS NULL THEN 'CONTEXT_NOT_COVERED' WHEN mapped > 1 THEN 'MULTIPLE_MAPPED_FEATURES' WHEN mapped = 1 THEN 'SINGLE_MAPPED_FEATURE' WHEN found > 0 THEN 'NEARBY_ONLY' ELSE 'NO_MAPPED_FEATURE_NEARBY' END"


def context_of(t: Tables, s: DataFrame, operational: bool = False) -> DataFrame:
    """snapshot, timing, status and summary of every subject."""
    snapshot = checkpointed(snapshot_of(t, s, operational))
    out = s.select("sid", "as_of").join(snapshot.hint("merge"), "sid", "left").join(context.summary(candidates_of(t, s, snapshot), "sid").hint("merge"), "sid", "left")
    return out.withColumns({"timing": context.timing(F.col("base_at"), F.col("as_of")), "status": context.association(F.col("mapped"), F.col("found"), F.col("snapshot_id").isNotNull())}).drop("as_of")


@register(sql(TABLES, SUBJECTS + context_sql(True) + CANDIDATES + SUMMARY + f" SELECT sid, snapshot_id::DOUBLE AS snapshot_id, CASE WHEN base_at > as_of THEN 'RETROSPECTIVE' WHEN base_at IS NOT NULL THEN 'PRIOR_STATE' END AS timing, {STATUS} AS status, coalesce(mapped, 0) AS mapped, coalesce(thermal, 0) AS thermal, coalesce(near_thermal, 0) AS near_thermal, coalesce(truncated, false) AS truncated FROM sub LEFT JOIN snap USING (sid) LEFT JOIN ctx USING (sid)"))
def observation_context(t: Tables) -> DataFrame:
    """What was known of the map by then; documents() has the whole of it."""
    s = checkpointed(subjects(t))
    zero = ["mapped", "thermal", "near_thermal"]
    return context_of(t, s, True).fillna(0, zero).select("sid", F.col("snapshot_id").cast("double").alias("snapshot_id"), "timing", "status", *zero, F.coalesce("truncated", F.lit(False)).alias("truncated"))


LAND = """, px AS (SELECT id - 1 AS place, code, count(*) AS n FROM pixels GROUP BY ALL), land AS (SELECT place, sum(n) FILTER (code = 50) / sum(n) FILTER (code <> 7) AS built, sum(n) FILTER (code = 40) / sum(n) FILTER (code <> 7) AS crop, sum(n) FILTER (code IN (10, 20, 30)) / sum(n) FILTER (code <> 7) AS vegetation, sum(n) FILTER (code <> 7) / sum(n) AS valid FROM px GROUP BY place HAVING sum(n) FILTER (code <> 7) / sum(n) >= 0.5)"""


def land_of(t: Tables) -> DataFrame:
    shares = landcover.pixel_summary(t.pixels(), "id").filter("status = 'OK'")
    of = lambda *names: landcover.share(F.col("fractions"), *names)
    return shares.select((F.col("id") - 1).alias("place"), of("built").alias("built"), of("crop").alias("crop"), of("tree", "shrub", "grass").alias("vegetation"))


def assess_sql(operational: bool) -> str:
    return SUBJECTS + history_sql(operational) + features_sql() + context_sql(operational) + CANDIDATES + SUMMARY + LAND + f""", a0 AS (SELECT feat.*, snapshot_id, coalesce(mapped, 0) AS mapped, coalesce(thermal, 0) AS thermal, coalesce(mine, false) AS mine, coalesce(flare, false) AS flare, {STATUS} AS status, round(coalesce(built, CASE WHEN crop IS NOT NULL THEN 0 END), 9) AS built, round(crop, 9) AS crop, round(vegetation, 9) AS vegetation FROM feat LEFT JOIN snap USING (sid) LEFT JOIN ctx USING (sid) LEFT JOIN (SELECT place, coalesce(built, 0) AS built, coalesce(crop, 0) AS crop, coalesce(vegetation, 0) AS vegetation FROM land) USING (place)),
 a1 AS (SELECT *, CASE WHEN coalesce(cur, 0) = 0 THEN 'B0_NO_CURRENT_FRP' WHEN coverage_90 < 0.8 THEN 'B1_LOW_COVERAGE' WHEN active_days_90 = 0 THEN 'B2_NO_EARLIER_DETECTION' WHEN coalesce(matched, 0) < 5 THEN 'B3_UNMATCHED_HISTORY' ELSE 'B4_ROBUST_Z' END AS behaviour_rule,
  CASE WHEN snapshot_id IS NULL THEN 'CONTEXT_UNAVAILABLE_AS_OF' WHEN mapped > 0 AND thermal = 0 THEN 'NON_THERMAL_POWER_CONTEXT' WHEN thermal > 0 AND (coalesce(built, 0) >= 0.25 OR active_days_90 >= 5) THEN 'S1_INDUSTRIAL' WHEN thermal > 0 THEN 'WEAK_INDUSTRIAL_SUPPORT' WHEN crop IS NULL THEN 'LAND_COVER_UNAVAILABLE' WHEN crop >= 0.5 AND active_days_90 < 5 AND coverage_90 < 0.8 THEN 'INSUFFICIENT_RECURRENCE_COVERAGE' WHEN crop >= 0.5 AND active_days_90 < 5 THEN 'S2_AGRICULTURAL_BURN' WHEN vegetation >= 0.5 AND crop < 0.5 THEN 'S3_VEGETATION_FIRE' ELSE 'CONFLICTING_OR_MIXED_EVIDENCE' END AS source_rule FROM a0),
 a2 AS (SELECT *, CASE WHEN behaviour_rule IN ('B0_NO_CURRENT_FRP', 'B1_LOW_COVERAGE', 'B3_UNMATCHED_HISTORY') THEN 'INSUFFICIENT_HISTORY' WHEN behaviour_rule = 'B2_NO_EARLIER_DETECTION' THEN 'NEW_OR_TRANSIENT' WHEN abs(z) >= 3.5 THEN 'ABNORMAL_RELATIVE_TO_BASELINE' ELSE 'RECURRENT_WITHIN_BASELINE' END AS behaviour,
  CASE source_rule WHEN 'S1_INDUSTRIAL' THEN 'INDUSTRIAL' WHEN 'S2_AGRICULTURAL_BURN' THEN 'AGRICULTURAL_BURN' WHEN 'S3_VEGETATION_FIRE' THEN 'VEGETATION_FIRE' ELSE 'UNKNOWN' END AS source, CASE WHEN source_rule = 'S1_INDUSTRIAL' THEN CASE WHEN mine THEN 'MINING_HEAT' WHEN flare THEN 'GAS_FLARE' WHEN active_days_90 >= 5 THEN 'OTHER_PERSISTENT_HEAT' ELSE 'UNRESOLVED' END END AS subtype FROM a1),
 a3 AS (SELECT *, CASE WHEN behaviour = 'ABNORMAL_RELATIVE_TO_BASELINE' THEN CASE WHEN z > 0 THEN 'HIGHER' ELSE 'LOWER' END END AS direction FROM a2),
 assessed AS (SELECT *, CASE WHEN source = 'INDUSTRIAL' AND direction = 'HIGHER' THEN 'P1_HIGH' WHEN source = 'INDUSTRIAL' AND behaviour = 'NEW_OR_TRANSIENT' THEN 'P2_HIGH' WHEN source = 'UNKNOWN' AND (behaviour = 'NEW_OR_TRANSIENT' OR direction = 'HIGHER') THEN 'P3_REVIEW' WHEN behaviour = 'INSUFFICIENT_HISTORY' AND source IN ('INDUSTRIAL', 'UNKNOWN') THEN 'P4_MEDIUM' WHEN source = 'UNKNOWN' THEN 'P5_MEDIUM' WHEN source = 'INDUSTRIAL' THEN 'P6_LOW' ELSE 'P7_LOW' END AS priority, concat_ws(',', CASE WHEN snapshot_id IS NULL THEN 'FACILITY_CONTEXT' END, CASE WHEN crop IS NULL THEN 'LAND_COVER' END) AS missing FROM a3)"""


#: Where the assessments of a session's data sets are: what several queries start from is computed once.
WRITTEN: dict[tuple, str] = {}


def judged(t: Tables, s: DataFrame, operational: bool = False) -> DataFrame:
    """The assessments of subjects, each as of its time."""
    found = history_of(t, s, operational).join(context_of(t, s, operational).hint("merge"), "sid").join(land_of(t), "place", "left")
    return assessment.assess(found)


def assessed(t: Tables, operational: bool = False) -> DataFrame:
    """All subjects' assessments. They are written once for each data set and session, and read again."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, operational)
    if key not in WRITTEN:
        path = f"{shared_folder(t.spark)}/assessed-{uuid4().hex}"
        judged(t, checkpointed(subjects(t)), operational).write.parquet(path)
        WRITTEN[key] = path
    return t.spark.read.parquet(WRITTEN[key])


OUT = ["behaviour_rule", "behaviour", "direction", "source_rule", "source", "subtype", "priority", "status", "missing"]
DIGEST = ["sid", "active_days_90", "detections_180", "covered_90", "superseded", "mapped", "thermal", "status"]
DIGEST_SQL = "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in DIGEST) + "))"


def shown(a: DataFrame) -> DataFrame:
    return a.fillna(0, ["mapped", "thermal"]).select("sid", *OUT, "z", "coverage_90", "active_days_90", "superseded", assessment.snapshot_digest(*DIGEST).alias("digest"))


SHOWN_SQL = f" SELECT sid, {', '.join(OUT)}, z, coverage_90, active_days_90, superseded, {DIGEST_SQL} AS digest FROM assessed"


@register(sql(TABLES, assess_sql(False) + SHOWN_SQL))
def assessment_all(t: Tables) -> DataFrame:
    return shown(assessed(t))


@register(sql(TABLES, assess_sql(True) + SHOWN_SQL))
def assessment_operational(t: Tables) -> DataFrame:
    """Only what was on record by then: detections, retrievals and snapshots."""
    return shown(assessed(t, True))


@register(sql(TABLES, assess_sql(False) + " SELECT sid, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in assessment.RULE_COLUMNS) + " FROM assessed"))
def rule_export(t: Tables) -> DataFrame:
    return assessment.rule_columns(assessed(t))


@register(sql("facilities areas", "SELECT fac_id, facility_type, primary_tag, CAST(n > 300 AS BOOLEAN) AS truncated FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY fac_id) AS k FROM areas WHERE west <= 70.2 AND east >= 69.6 AND south <= 22.3 AND north >= 22.0) WHERE k <= 300"))
def facility_layer(t: Tables) -> DataFrame:
    """One window's mapped features, and whether the cap cut them."""
    return context.feature_layer(t.areas(), (69.6, 22.0, 70.2, 22.3), 300).select("fac_id", "facility_type", "primary_tag", "truncated")


def documents(t: Tables) -> DataFrame:
    """sid, document (JSON): the evidence of each subject: its point, candidates, history and rule outputs."""
    a = assessed(t)
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    history_ = F.struct(*[F.col(c) for c in SHOWN if c != "group"])
    return a.select("sid", F.to_json(F.struct(F.col("sid").alias("observation_id"), point.alias("geometry"), F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("as_of"), "candidates", "timing", history_.alias("history"), F.struct(*OUT).alias("rules"))).alias("document"))


@register(sql("obs", ", d AS (SELECT DISTINCT place, lon, lat FROM obs) SELECT a.place, round(max(" + distance_sql("a", "b") + "), 3) AS diameter_m, count(DISTINCT (a.lon, a.lat)) AS spots FROM d a JOIN d b USING (place) GROUP BY a.place"))
def place_diameter(t: Tables) -> DataFrame:
    """The greatest distance within every place, over its distinct coordinates."""
    spots = t.obs().select("place", "lon", "lat").distinct()
    far = hulls.hulls(spots, "place").select("place", F.round(hulls.diameter_m(F.col("hull")), 3).alias("diameter_m"))
    return far.join(spots.groupBy("place").agg(F.count("*").alias("spots")), "place")


@register()
def place_hull(t: Tables) -> DataFrame:
    """The hull of every place's distinct coordinates and its centre; held against brute force."""
    return hulls.hulls(t.obs(), "place").select("place", "hull", geo.hull_centroid(F.col("hull")).alias("centre"))


@register()
def evidence_documents(t: Tables) -> DataFrame:
    """The evidence of every subject as JSON, from the columns that assessment_all has SQL for."""
    return documents(t)


def ring(*corners: tuple[float, float]) -> list[tuple[float, float]]:
    return [*corners, corners[0]]


def square(x: float, y: float, r: float) -> list[tuple[float, float]]:
    return ring((x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r))


#: Areas as they may be drawn (offsets in degrees): two outers, a hole with an island, a bow tie, outers that cross.
DRAWN = [
    [square(-0.004, 0.0, 0.002), square(0.004, 0.0, 0.002)], [square(0.0, 0.0, 0.006), square(0.0, 0.0, 0.004), square(0.0, 0.0, 0.002)],
    [ring((-0.005, -0.005), (0.005, 0.005), (0.005, -0.005), (-0.005, 0.005))], [square(0.0, 0.0, 0.004), square(0.003, 0.003, 0.004)],
]
DRAWN_EDGES = ", ".join(f"({k}, {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for k, rings in enumerate(DRAWN) for r in rings for a, b in zip(r, r[1:], strict=False))
GRID = 0.00093


@register(sql("facilities", f""", g AS (SELECT fac_id, fac_id % 4 AS kind, {GRID} * i + 0.00011 AS px, {GRID} * j + 0.00017 AS py FROM facilities, range(-7, 8) a(i), range(-7, 8) b(j)), e AS (SELECT * FROM (VALUES {DRAWN_EDGES}) v(kind, ax, ay, bx, "by")),
 c AS (SELECT fac_id, px, py, count(*) FILTER ((ay > py) <> ("by" > py) AND px < (bx - ax) * (py - ay) / nullif("by" - ay, 0) + ax) % 2 AS odd FROM g JOIN e USING (kind) GROUP BY ALL) SELECT fac_id, CAST(sum(odd) AS BIGINT) AS inside FROM c GROUP BY fac_id"""))
def built_areas(t: Tables) -> DataFrame:
    """How many points of a grid lie in the valid polygons that the drawn rings make."""
    k = F.col("fac_id") % 4
    shape = F.lit(None)
    for n, rings in enumerate(DRAWN):
        own = F.array(*[F.array(*[F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in r]) for r in rings])
        shape = F.when(k == n, own).otherwise(shape)
    dealt = t.facilities().repartition(4 * t.spark.sparkContext.defaultParallelism, "fac_id")  # a small file is one task's, but each row of it is 225 points
    areas = dealt.select("fac_id", "lon", "lat", polygons.built(shape).alias("rings"))
    steps = F.sequence(F.lit(-7), F.lit(7))
    grid = areas.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    inside = geo.in_rings(F.col("lon") + GRID * F.col("i") + 0.00011, F.col("lat") + GRID * F.col("j") + 0.00017, F.col("rings"))
    return grid.groupBy("fac_id").agg(F.count_if(inside).alias("inside"))
