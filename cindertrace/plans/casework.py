"""Queries over cases: model inputs, groups and splits, reviews and evidence, and how a model would be judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindertrace.operators import assessment, cases, features, landcover
from cindertrace.operators.components import checkpointed
from cindertrace.operators.spatial import near
from cindertrace.plans import assessing as a
from cindertrace.plans.adapter import Tables, distance_sql, sql
from cindertrace.registry import register

EPISODE_SQL = """, m1 AS (SELECT place, session_no, count(*) AS obs_count, count(DISTINCT (acquired_at, satellite)) AS overpass_count, round((epoch(max(acquired_at)) - epoch(min(acquired_at))) / 3600, 6) AS duration_h, round(median(i4), 6) AS bt_i4_median, round(median(i5), 6) AS bt_i5_median, round(median(i4 - i5), 6) AS bt_diff_median,
  round(avg(CAST(daynight = 'N' AS DOUBLE)), 6) AS night_fraction, round(avg(CAST(confidence = 'h' AS DOUBLE)), 6) AS high_conf_fraction, round(avg(CAST(confidence = 'l' AS DOUBLE)), 6) AS low_conf_fraction, round(median(scan), 6) AS scan_median, round(median(track), 6) AS track_median FROM ses GROUP BY ALL),
 m2 AS (SELECT place, session_no, round(max(f), 6) AS frp_max, round(median(f), 6) AS frp_overpass_median FROM (SELECT place, session_no, acquired_at, satellite, greatest(max(frp_mw), 0.0) AS f FROM ses WHERE frp_mw IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 m3 AS (SELECT place, session_no, nasa_type FROM (SELECT place, session_no, nasa_type, count(*) AS n FROM ses WHERE nasa_type IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY place, session_no ORDER BY n DESC, nasa_type) = 1),
 epi AS (SELECT * FROM m1 LEFT JOIN m2 USING (place, session_no) LEFT JOIN m3 USING (place, session_no))"""


@register(sql("obs archive", a.SESSIONS + EPISODE_SQL + f" SELECT place, session_no, {', '.join(features.EPISODE)}, nasa_type FROM epi"))
def episode_inputs(t: Tables) -> DataFrame:
    return features.episode_inputs(a.members(t), "place", "session_no").select("place", "session_no", *features.EPISODE, "nasa_type")


PRIOR_SQL = """, p0 AS (SELECT h.*, sub.started_at AS st FROM h JOIN sub USING (sid) WHERE kept AND h.acquired_at < sub.started_at),
 p1 AS (SELECT sid, """ + ", ".join(f"count(DISTINCT CAST(acquired_at AS DATE)) FILTER (acquired_at >= st - INTERVAL {d} DAY) AS active_days_{d}" for d in (30, 90, 180)) + """, count(DISTINCT (acquired_at, satellite)) FILTER (acquired_at >= st - INTERVAL 90 DAY) AS overpasses_90, round(avg(CAST(daynight = 'N' AS DOUBLE)) FILTER (acquired_at >= st - INTERVAL 90 DAY), 6) AS history_night_fraction_90, round(least((epoch(any_value(st)) - epoch(max(acquired_at))) / 86400, 90.0), 6) AS days_since_last FROM p0 GROUP BY sid),
 p2 AS (SELECT sid, round(median(f), 6) AS history_frp_median_90 FROM (SELECT sid, acquired_at, satellite, daynight, greatest(max(frp_mw), 0.0) AS f FROM p0 WHERE frp_mw IS NOT NULL AND acquired_at >= st - INTERVAL 90 DAY GROUP BY ALL) GROUP BY sid),
 p3 AS (SELECT cov.sid, """ + ", ".join(f"round(count(DISTINCT day) FILTER (day < CAST(started_at AS DATE) AND day >= CAST(started_at AS DATE) - {d}) / {d}, 4) AS coverage_{d}" for d in (90, 180)) + """ FROM cov JOIN sub USING (sid) GROUP BY cov.sid),
 prior AS (SELECT sid, coalesce(active_days_30, 0) AS active_days_30, coalesce(active_days_90, 0) AS active_days_90, coalesce(active_days_180, 0) AS active_days_180, coalesce(overpasses_90, 0) AS overpasses_90, coalesce(days_since_last, 90.0) AS days_since_last, history_frp_median_90, history_night_fraction_90, coalesce(coverage_90, 0.0) AS coverage_90, coalesce(coverage_180, 0.0) AS coverage_180 FROM sub LEFT JOIN p1 USING (sid) LEFT JOIN p2 USING (sid) LEFT JOIN p3 USING (sid))"""


def prior(t: Tables, s: DataFrame) -> DataFrame:
    days = checkpointed(assessment.covered_days(s, t.passes(), "HISTORICAL_REPLAY"))
    rows = assessment.as_of_history(s, t.archive(), days).filter("kept").select("sid", "acquired_at", "satellite", "daynight", "frp_mw")
    return features.prior_inputs(s, checkpointed(rows), days)


@register(sql("obs archive passes", a.SUBJECTS + a.history_sql(False) + PRIOR_SQL + f" SELECT sid, {', '.join(features.HISTORY + features.HISTORY_STORED)} FROM prior"))
def history_inputs(t: Tables) -> DataFrame:
    return prior(t, checkpointed(a.subjects(t))).select("sid", *features.HISTORY, *features.HISTORY_STORED)


HOT = "thermal_candidate AND relation = 'INSIDE_SUPPORT'"
OSM_SQL = f""", o1 AS (SELECT sid, count(*) FILTER ({HOT}) AS n_industrial_in_support, min(round(distance_m, 1)) FILTER (thermal_candidate) AS nearest_industrial_m, count(*) FILTER (thermal_candidate) AS n_industrial_2km, """ + ", ".join(f"max(CAST({HOT} AND {test} AS INTEGER)) AS {name}" for name, test in (("has_power", "facility_type = 'POWER'"), ("has_refinery", "facility_type = 'REFINERY'"), ("has_mine", "facility_type = 'MINE'"), ("has_petrochem_steel_lng", "facility_type IN ('PETROCHEMICAL', 'STEEL', 'LNG')"), ("has_flare_tag", "primary_tag = 'man_made=flare'"), ("has_chimney_tag", "primary_tag = 'man_made=chimney'"), ("has_kiln_tag", "primary_tag = 'man_made=kiln'"))) + """, max(CAST(NOT thermal_candidate AND relation = 'INSIDE_SUPPORT' AS INTEGER)) AS has_nonthermal_power FROM cand GROUP BY sid),
 osm AS (SELECT sub.sid, CAST(snapshot_id IS NOT NULL AS INTEGER) AS osm_covered, CASE WHEN snapshot_id IS NOT NULL THEN least(coalesce(nearest_industrial_m, 5000.0), 5000.0) END AS nearest_industrial_m, """ + ", ".join(f"CASE WHEN snapshot_id IS NOT NULL THEN coalesce({c}, 0)::DOUBLE END AS {c}" for c in features.OSM[1:] if c != "nearest_industrial_m") + " FROM sub LEFT JOIN snap USING (sid) LEFT JOIN o1 USING (sid))"


def osm(t: Tables, s: DataFrame) -> DataFrame:
    snapshot = checkpointed(a.snapshot_of(t, s))
    return features.osm_inputs(s, a.candidates_of(t, s, snapshot), snapshot)


@register(sql(a.TABLES, a.SUBJECTS + a.context_sql(False) + a.CANDIDATES + OSM_SQL + f" SELECT sid, {', '.join(features.OSM)} FROM osm"))
def mapped_inputs(t: Tables) -> DataFrame:
    return osm(t, checkpointed(a.subjects(t))).select("sid", *features.OSM)


def shares_sql(name: str, where: str, classes: dict[str, str]) -> str:
    of = ", ".join(f"round(coalesce(sum(n) FILTER (code IN ({codes})), 0) / sum(n) FILTER (code <> 7), 6) AS {c}" for c, codes in classes.items())
    return f", {name} AS (SELECT id - 1 AS place, {of}, round(coalesce(sum(n) FILTER (code <> 7), 0) / sum(n), 6) AS valid FROM (SELECT id, code, count(*) AS n FROM pixels WHERE {where} GROUP BY ALL) GROUP BY id)"


CODES = {"built": "50", "crop": "40", "tree": "10", "shrub": "20", "grass": "30", "bare": "60", "water": "80", "wetland": "90, 95"}
LAND_SQL = shares_sql("l1", "close", {f"lc_{k}": v for k, v in CODES.items()}) + shares_sql("l2", "true", {f"lc_{k}_1km": CODES[k] for k in ("built", "crop", "tree")}) + ", lc AS (SELECT l1.*, l1.valid AS lc_valid, lc_built_1km, lc_crop_1km, lc_tree_1km FROM l1 JOIN l2 USING (place))"


def land(t: Tables) -> DataFrame:
    support = landcover.pixel_summary(t.pixels().filter("close"), "id").select("id", "valid_fraction", F.col("fractions").alias("near"))
    both = support.join(landcover.pixel_summary(t.pixels(), "id").select("id", "fractions"), "id")
    return both.select((F.col("id") - 1).alias("place"), *[c.alias(n) for n, c in features.landcover_inputs(F.col("near"), F.col("valid_fraction"), F.col("fractions")).items()])


@register(sql("pixels", LAND_SQL + f" SELECT place, {', '.join(features.LANDCOVER)} FROM lc"))
def landcover_inputs(t: Tables) -> DataFrame:
    return land(t).select("place", *features.LANDCOVER)


INPUTS_SQL = a.SUBJECTS + a.history_sql(False) + PRIOR_SQL + a.context_sql(False) + a.CANDIDATES + OSM_SQL + EPISODE_SQL + LAND_SQL + f", inputs AS (SELECT sub.sid, sub.place, nasa_type, coverage_90 >= 0.8 AS history_complete, {', '.join(features.FEATURES)} FROM sub JOIN epi USING (place, session_no) JOIN prior USING (sid) JOIN osm USING (sid) LEFT JOIN lc USING (place))"


def inputs(t: Tables) -> DataFrame:
    """All inputs of every case, and what is stored beside them."""
    s = checkpointed(a.subjects(t))
    own = features.episode_inputs(a.members(t), "place", "session_no")
    out = s.select("sid", "place", "session_no").join(own.hint("merge"), ["place", "session_no"]).join(prior(t, s).hint("merge"), "sid").join(osm(t, s).hint("merge"), "sid").join(land(t), "place", "left")
    return out.withColumn("history_complete", F.col("coverage_90") >= 0.8)


@register(sql(a.TABLES, INPUTS_SQL + f" SELECT sid, nasa_type, history_complete, {', '.join(features.FEATURES)} FROM inputs"))
def case_inputs(t: Tables) -> DataFrame:
    return inputs(t).select("sid", "nasa_type", "history_complete", *features.FEATURES)


@register(sql("obs archive", a.SESSIONS + EPISODE_SQL + ", x AS (SELECT place * 1000 + session_no AS id, obs_count, overpass_count FROM epi) SELECT id, CASE WHEN id % 3 = 0 THEN 'NEW' WHEN id % 3 = 1 OR obs_count % 2 = 0 THEN 'UNCHANGED' ELSE 'DIFFERENT' END AS outcome FROM x"))
def feature_freeze(t: Tables) -> DataFrame:
    """Rows against what an earlier run stored: a third of them is new, and some odd counts were one more then."""
    rows = features.episode_inputs(a.members(t), "place", "session_no").select((F.col("place") * 1000 + F.col("session_no")).alias("id"), "obs_count", "overpass_count")
    k = F.col("id") % 3
    earlier = rows.withColumn("obs_count", F.when((k == 2) & (F.col("obs_count") % 2 == 1), F.col("obs_count") + 1).otherwise(F.col("obs_count")))
    stored = features.frozen(rows.limit(0).select("id", F.lit("").alias("sha256")), earlier.filter(k != 0), "id")
    return features.frozen(stored, rows, "id").select("id", "outcome")


@register(sql("obs archive plants", a.SUBJECTS + f" SELECT DISTINCT sid, 'INDUSTRIAL' AS silver FROM sub s JOIN plants r ON abs(s.lat - r.lat) < 0.05 AND abs(s.lon - r.lon) < 0.05 AND r.fuel IN ('AUTOMOBILE', 'MACHINERY') AND {distance_sql('s', 'r')} <= 1500"))
def silver_labels(t: Tables) -> DataFrame:
    """Cases near a registered thermal plant."""
    plants = t.plants().filter(F.col("fuel").isin("AUTOMOBILE", "MACHINERY"))
    return near(a.subjects(t).select("sid", "lon", "lat"), plants.select("plant_id", "lon", "lat"), cases.REGISTRY_M).select("sid", F.lit("INDUSTRIAL").alias("silver")).distinct()


GROUPS = f""", sl AS (SELECT 'area' AS kind, f.fac_id AS k, p.site FROM sites p JOIN site_areas f ON abs(p.lat - f.lat) < 0.05 AND abs(p.lon - f.lon) < 0.05 AND {distance_sql('p', 'f')} <= 500 UNION ALL SELECT 'plant', r.fac_id, p.site FROM sites p JOIN site_plants r ON abs(p.lat - r.lat) < 0.05 AND abs(p.lon - r.lon) < 0.05 AND {distance_sql('p', 'r')} <= 1500),
 ed AS (SELECT a.site AS a, b.site AS b FROM sites a JOIN sites b ON a.site <> b.site AND abs(a.lat - b.lat) < 0.03 AND abs(a.lon - b.lon) < 0.03 AND {distance_sql('a', 'b')} <= 2000 UNION SELECT x.site, y.site FROM sl x JOIN sl y USING (kind, k) WHERE x.site <> y.site),
 w(node, root) AS (SELECT site, site FROM sites UNION SELECT ed.b, w.root FROM w JOIN ed ON ed.a = w.node), grp AS (SELECT node AS site, min(root) AS split_group FROM w GROUP BY node)"""


def groups(t: Tables) -> DataFrame:
    return cases.site_groups(t.sites(), t.site_areas(), t.site_plants())


@register(sql("sites site_areas site_plants", GROUPS + " SELECT site, split_group FROM grp").replace("WITH ", "WITH RECURSIVE ", 1))
def facility_aware_groups(t: Tables) -> DataFrame:
    return groups(t)


CUTOFF = "2024-01-20"
SPLIT_SQL = """, cs AS (SELECT sid AS id, region_id, CAST(split_group AS VARCHAR) AS split_group, place, as_of FROM sub JOIN grp ON grp.site = place JOIN sites ON sites.site = place), g1 AS (SELECT region_id, split_group, count(*) AS n, sha256('split-v1' || chr(31) || split_group) AS hh FROM cs GROUP BY ALL),
 g2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY region_id ORDER BY hh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY region_id) AS share, row_number() OVER (PARTITION BY region_id ORDER BY hh DESC) AS back, count(*) OVER (PARTITION BY region_id) AS k FROM g1), g3 AS (SELECT *, CASE WHEN share < 0.6 THEN 'TRAIN' WHEN share < 0.8 THEN 'VALIDATION' ELSE 'TEST' END AS s0 FROM g2),
 g4 AS (SELECT *, CASE WHEN k >= 3 AND back = 1 AND NOT bool_or(s0 = 'TEST') OVER (PARTITION BY region_id) THEN 'TEST' ELSE s0 END AS s1 FROM g3), g5 AS (SELECT region_id, split_group, CASE WHEN k >= 3 AND back = 2 AND NOT bool_or(s1 = 'VALIDATION') OVER (PARTITION BY region_id) THEN 'VALIDATION' ELSE s1 END AS split FROM g4),
 cset AS (SELECT id, region_id, split_group, split, CASE WHEN as_of < TIMESTAMP '""" + CUTOFF + """' THEN 'BEFORE' ELSE 'AFTER' END AS forward_period, CASE WHEN split = 'TEST' THEN 2 ELSE 1 END AS review_slots FROM cs JOIN g5 USING (region_id, split_group))"""


def case_rows(t: Tables, subjects: DataFrame | None = None) -> DataFrame:
    """Cases of subjects. They are read twice (for the splits too), so they are written first."""
    s = subjects if subjects is not None else checkpointed(a.subjects(t).select("sid", "place", "as_of"))
    s = s.select(F.col("sid").alias("id"), F.col("place").alias("site"), "as_of").join(t.sites().select("site", "region_id").hint("merge"), "site")
    own = groups(t).withColumn("split_group", F.col("split_group").cast("string"))
    return cases.build(s, own, CUTOFF).select("id", "region_id", "split_group", "split", "forward_period", "review_slots")


CASE_TABLES = "obs archive sites site_areas site_plants"


@register(sql(CASE_TABLES, a.SUBJECTS + GROUPS + SPLIT_SQL + " SELECT * FROM cset").replace("WITH ", "WITH RECURSIVE ", 1))
def case_set(t: Tables) -> DataFrame:
    return case_rows(t)


TRAINING = a.SUBJECTS + GROUPS + SPLIT_SQL + ", tr AS (SELECT c.*, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END AS target, CASE id % 4 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'SILVER' WHEN 2 THEN 'WEAK' ELSE 'GOLD' END AS tier, id % 4 = 0 AS test_eligible, id % 7 <> 0 AS history_complete FROM cset c)"
USABLE = " history_complete AND target IS NOT NULL AND CASE WHEN split = 'TEST' THEN test_eligible ELSE tier IN ('GOLD', 'SILVER') END"


def training_rows(t: Tables) -> DataFrame:
    k = F.col("id")
    label = F.when(k % 5 == 1, "VEGETATION_FIRE").when(k % 5 == 2, "OTHER").when(k % 5 > 2, "INDUSTRIAL").otherwise("UNRESOLVED")
    tier = F.when(k % 4 == 1, "SILVER").when(k % 4 == 2, "WEAK").otherwise("GOLD")
    return case_rows(t).withColumns({"target": features.binary_target(label), "tier": tier, "test_eligible": k % 4 == 0, "history_complete": k % 7 != 0})


def recursive(tables: str, rest: str) -> str:
    return sql(tables, rest).replace("WITH ", "WITH RECURSIVE ", 1)


@register(recursive(CASE_TABLES, TRAINING + f" SELECT split, count(*) FILTER (target = 1) AS positive, count(*) FILTER (target = 0) AS negative FROM tr WHERE{USABLE} GROUP BY split"))
def training_support(t: Tables) -> DataFrame:
    return features.support(cases.usable(training_rows(t)))


LEAST = "least(count(*) FILTER (split = '{0}' AND target = 1), count(*) FILTER (split = '{0}' AND target = 0)) AS {1}"


@register(recursive(CASE_TABLES, TRAINING + f", k AS (SELECT {', '.join(LEAST.format(s, s.lower()) for s in ('TRAIN', 'VALIDATION', 'TEST'))} FROM tr WHERE{USABLE}) SELECT *, CASE WHEN NOT (train >= 20 AND validation >= 5 AND test >= 10) THEN 'INSUFFICIENT_LABELS' WHEN test >= 30 THEN 'PROMOTED' ELSE 'EVALUATED_NOT_PROMOTED' END AS status FROM k"))
def model_gate(t: Tables) -> DataFrame:
    """With a gain whose interval lies above zero."""
    return features.gate(cases.usable(training_rows(t)), gain_low=0.01)


@register(recursive(CASE_TABLES, TRAINING + f", k AS (SELECT region_id, {', '.join(LEAST.format(s, s.lower()) for s in ('TRAIN', 'VALIDATION', 'TEST'))} FROM tr WHERE{USABLE} GROUP BY region_id) SELECT k.*, gain, CASE WHEN NOT (train >= 20 AND validation >= 5 AND test >= 10) THEN 'INSUFFICIENT_LABELS' WHEN test >= 30 AND gain > 0 THEN 'PROMOTED' ELSE 'EVALUATED_NOT_PROMOTED' END AS status FROM k, (VALUES (0.01::DOUBLE), (-0.02::DOUBLE)) v(gain)"))
def model_gates(t: Tables) -> DataFrame:
    """Of each region by itself, once with a gain whose interval lies above zero and once without."""
    rows = cases.usable(training_rows(t))
    return features.gate(rows, gain_low=0.01, by="region_id").withColumn("gain", F.lit(0.01)).unionByName(features.gate(rows, gain_low=-0.02, by="region_id").withColumn("gain", F.lit(-0.02)))


@register(recursive(CASE_TABLES, TRAINING + f", u AS (SELECT * FROM tr WHERE{USABLE}), y AS (SELECT region_id, count(*) FILTER (split = 'TRAIN' AND target = 1) AS p, count(*) FILTER (split = 'TRAIN' AND target = 0) AS n, count(*) FILTER (split = 'TEST') AS test_cases FROM u GROUP BY region_id) SELECT region_id, test_cases, CASE WHEN least((SELECT sum(p) FROM y) - p, (SELECT sum(n) FROM y) - n) < 20 THEN 'INSUFFICIENT_TRAINING_LABELS' ELSE 'SCORED' END AS status FROM y WHERE test_cases > 0"))
def held_out_regions(t: Tables) -> DataFrame:
    return features.held_out_regions(cases.usable(training_rows(t)))


def model_rows(t: Tables) -> DataFrame:
    """Usable cases with their target and all inputs."""
    own = checkpointed(inputs(t).withColumnRenamed("sid", "id").select("id", *features.FEATURES))
    return cases.usable(training_rows(t)).select("id", "region_id", "split", "split_group", "target").join(own, "id")


@register()
def gbt_scores(t: Tables) -> DataFrame:
    """300 trees over all inputs; their seeds are Spark's, so SQL has no counterpart."""
    return features.boosted_scores(model_rows(t), features.FEATURES, "target", "id")


@register(recursive(CASE_TABLES, TRAINING + f", u AS (SELECT * FROM tr WHERE{USABLE}), y AS (SELECT region_id, count(*) FILTER (split = 'TRAIN' AND target = 1) AS p, count(*) FILTER (split = 'TRAIN' AND target = 0) AS n FROM u GROUP BY region_id), ok AS (SELECT region_id FROM y WHERE least((SELECT sum(p) FROM y) - p, (SELECT sum(n) FROM y) - n) >= 20) SELECT region_id, target AS y, count(*) AS cases, count(*) AS scored FROM u JOIN ok USING (region_id) WHERE split = 'TEST' GROUP BY ALL"))
def held_out_pooled(t: Tables) -> DataFrame:
    """What the fits of all held-out regions have scored, by region and class."""
    scored = features.held_out_scores(model_rows(t), features.FEATURES)
    return scored.groupBy("region_id", "y").agg(F.count("*").alias("cases"), F.count_if(F.col("p").between(0, 1)).alias("scored"))


@register(recursive(CASE_TABLES, TRAINING + ", b AS (SELECT * FROM tr WHERE forward_period = 'BEFORE' AND target IS NOT NULL AND tier IN ('GOLD', 'SILVER')), f AS (SELECT * FROM tr WHERE forward_period = 'AFTER' AND target IS NOT NULL AND test_eligible AND split_group IN (SELECT split_group FROM b)) SELECT (SELECT count(*) FROM b) AS train_cases, (SELECT count(*) FROM f) AS test_cases, CASE WHEN (SELECT least(count(*) FILTER (target = 1), count(*) FILTER (target = 0)) FROM b) < 20 OR (SELECT least(count(*) FILTER (target = 1), count(*) FILTER (target = 0)) FROM f) < 10 THEN 'INSUFFICIENT_LABELS' ELSE 'EVALUATED' END AS status"))
def known_site_future(t: Tables) -> DataFrame:
    rows = training_rows(t).withColumn("fit_for_test", F.col("test_eligible"))
    return features.known_site_future(rows.filter((F.col("forward_period") == "AFTER") | F.col("tier").isin("GOLD", "SILVER")))


WEAK = ", q AS (SELECT y, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'INDUSTRIAL' ELSE 'VEGETATION_FIRE' END AS weak FROM predictions)"


@register(sql("predictions", WEAK + ", c AS (SELECT count(*) FILTER (y = 0 AND weak <> 'INDUSTRIAL') AS tn, count(*) FILTER (y = 0 AND weak = 'INDUSTRIAL') AS fp, count(*) FILTER (y = 1 AND weak <> 'INDUSTRIAL') AS fn, count(*) FILTER (y = 1 AND weak = 'INDUSTRIAL') AS tp, round(avg(CAST(weak IS NOT NULL AS DOUBLE)), 4) AS coverage FROM q) SELECT tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, coverage FROM c"))
def rule_baseline(t: Tables) -> DataFrame:
    k = F.col("id") % 3
    return features.rule_baseline(t.predictions().select("y", F.when(k == 1, "INDUSTRIAL").when(k == 2, "VEGETATION_FIRE").alias("weak")))


THRESHOLDS = [0.5 + 0.025 * k for k in range(20)]
SURE = ", r AS (SELECT greatest(p, 1 - p) AS sure, CAST(CAST(p >= 0.5 AS INTEGER) <> CAST(p > 0.45 + 0.1 * y AS INTEGER) AS DOUBLE) AS wrong FROM predictions)"


@register(sql("predictions", SURE + ", v AS (SELECT threshold, round(count(*) FILTER (sure >= threshold) / count(*), 6) AS coverage, round(avg(wrong) FILTER (sure >= threshold), 6) AS risk FROM r, (SELECT unnest([" + ", ".join(f"{x!r}::DOUBLE" for x in THRESHOLDS) + "]) AS threshold) GROUP BY threshold) SELECT coalesce(min(threshold) FILTER (risk <= 0.1 AND coverage >= 0.5), 0.5) AS threshold, count(*) FILTER (risk <= 0.1 AND coverage >= 0.5) > 0 AS target_met FROM v"))
def abstention_choice(t: Tables) -> DataFrame:
    rows = t.predictions().withColumn("y", (F.col("p") > 0.45 + 0.1 * F.col("y")).cast("int"))
    return features.choose_abstention(features.abstention_curve(rows, THRESHOLDS))


@register(sql("predictions", ", s AS (SELECT p, count(*) AS n, sum(y) AS hits FROM predictions GROUP BY p), c AS (SELECT hits, sum(n) OVER (ORDER BY p DESC) AS seen, sum(hits) OVER (ORDER BY p DESC) AS found FROM s) SELECT round(sum(hits * found / seen) / sum(hits), 6) AS pr_auc FROM c"))
def average_precision(t: Tables) -> DataFrame:
    return features.average_precision(t.predictions())


@register(sql("predictions", "SELECT grp, count(*) AS cases, CAST(sum(CAST(y <> pred AS INTEGER)) AS BIGINT) AS errors, round(avg(CAST(y <> pred AS DOUBLE)), 6) AS rate FROM predictions GROUP BY grp"))
def errors_by_region(t: Tables) -> DataFrame:
    return features.error_rates(t.predictions(), "grp")


TOP = ", w AS (SELECT id, max(p) AS p, arg_max(y, p * 1000 + y) AS y FROM predictions GROUP BY id)"


@register(sql("predictions", TOP + " SELECT id, y, round(p, 6) AS p FROM w WHERE y <> CAST(p >= 0.5 AS INTEGER) ORDER BY round(abs(p - 0.5), 9) DESC, id LIMIT 15"))
def worst_errors(t: Tables) -> DataFrame:
    rows = t.predictions().groupBy("id").agg(F.max_by("y", F.col("p") * 1000 + F.col("y")).alias("y"), F.max("p").alias("p"))
    return features.worst_errors(rows.withColumn("pred", (F.col("p") >= 0.5).cast("int"))).select("id", "y", F.round("p", 6).alias("p"))


@register(sql("obs archive", a.SESSIONS + EPISODE_SQL + ", x AS (SELECT nasa_type, CASE WHEN (place * 1000 + session_no) % 4 = 0 THEN NULL ELSE (place + session_no) % 2 END AS target FROM epi) SELECT nasa_type, count(*) AS cases, round(avg(target), 4) AS rate FROM x WHERE nasa_type IS NOT NULL AND target IS NOT NULL GROUP BY nasa_type"))
def rate_by_source_type(t: Tables) -> DataFrame:
    rows = features.episode_inputs(a.members(t), "place", "session_no")
    k = F.col("place") * 1000 + F.col("session_no")
    return features.positive_rate(rows.withColumn("target", F.when(k % 4 != 0, (F.col("place") + F.col("session_no")) % 2)), "nasa_type")


@register(sql("reviews", ", v AS (SELECT o_orderkey AS id, 'Rev' || o_custkey % 3 AS reviewer FROM orders WHERE o_orderkey % 4 = 0) SELECT id, seq FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.id = r.id AND lower(v.reviewer) = 'rev' || r.seq % 3)"))
def current_reviews(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    voided = t.read("orders").filter(k % 4 == 0).select(k.alias("id"), F.concat(F.lit("Rev"), (F.col("o_custkey") % 3).cast("string")).alias("reviewer"))
    own = t.reviews().withColumn("reviewer", F.concat(F.lit("REV"), (F.col("seq") % 3).cast("string")))
    return cases.current_reviews(own, voided).select("id", "seq")


@register(sql("reviews", "SELECT id, seq, coalesce(CASE WHEN seq % 3 <> 0 THEN 'evidence-v' || (1 + seq % 2) END = 'evidence-v2' AND qualifies AND inside AND certainty IN ('HIGH', 'MEDIUM'), false) AS ok FROM reviews"))
def evidence_qualifies(t: Tables) -> DataFrame:
    policy = F.when(F.col("seq") % 3 != 0, F.concat(F.lit("evidence-v"), (1 + F.col("seq") % 2).cast("string")))
    place = F.when(F.col("inside"), "INSIDE_PIXEL_AREA").otherwise("NEARBY")
    return t.reviews().select("id", "seq", cases.qualifies(policy, F.col("qualifies"), place, F.col("certainty")).alias("ok"))


LINKS = ["https://firms.example.org/a", "https://browser.example.gov/?t=2023-06-05-T00&l=x", "https://browser.example.gov/?l=x", "https://state.example.gov/plant", "https://news.test/1", "ftp://x.test/1", "https://tiles.basemap.test/1"]
KIND = ["DATED_IMAGERY", "OFFICIAL_OR_COMPANY", "NEWS_REPORT", "PROJECT_INPUT", "RUMOUR"]
EVIDENCE = "WITH e0 AS (SELECT o_orderkey AS id, ([" + ", ".join(f"'{x}'" for x in LINKS) + "])[o_orderkey % 7 + 1] AS url, ([" + ", ".join(f"'{x}'" for x in KIND) + """])[o_custkey % 5 + 1] AS kind, CASE WHEN o_custkey % 4 <> 0 THEN DATE '2023-06-05' + CAST(CASE WHEN o_custkey % 4 = 1 THEN 0 ELSE o_custkey % 900 - 450 END AS INTEGER) END AS day FROM orders),
 e1 AS (SELECT *, CASE WHEN url LIKE '%firms%' THEN 'PROJECT_INPUT' WHEN url LIKE '%basemap%' THEN 'UNDATED_BASEMAP' END AS forced, CASE WHEN url LIKE '%t=2023%' THEN DATE '2023-06-05' END AS enc, url LIKE '%browser%' AS browsed FROM e0),
 e2 AS (SELECT *, CASE WHEN url LIKE 'ftp%' THEN 'NOT_A_LINK' WHEN kind = 'RUMOUR' THEN 'UNKNOWN_KIND' WHEN forced IS NOT NULL AND kind <> forced THEN 'ONLY_AS_FORCED' WHEN kind = 'DATED_IMAGERY' AND day IS NULL THEN 'NO_IMAGERY_DATE' WHEN kind = 'DATED_IMAGERY' AND browsed AND enc IS NULL THEN 'NO_DATE_IN_LINK' WHEN kind = 'DATED_IMAGERY' AND browsed AND enc <> day THEN 'DATES_DIFFER' END AS problem,
  CASE WHEN kind = 'DATED_IMAGERY' THEN day BETWEEN DATE '2023-06-01' - 365 AND DATE '2023-06-10' + 30 ELSE kind = 'OFFICIAL_OR_COMPANY' END AS ok FROM e1)
 SELECT id, problem, CASE WHEN problem IS NULL THEN ok END AS independent, CASE WHEN problem IS NULL THEN CASE WHEN kind = 'DATED_IMAGERY' AND ok THEN 'NEAR_THE_EPISODE' WHEN kind = 'DATED_IMAGERY' THEN 'TOO_FAR_IN_TIME' WHEN ok THEN 'OFFICIAL' WHEN kind = 'PROJECT_INPUT' THEN 'SAME_DATA' ELSE 'NOT_SUFFICIENT_ALONE' END END AS reason,
  CASE WHEN problem IS NULL THEN CASE WHEN forced IS NOT NULL THEN 'HOST_RULE' WHEN kind = 'DATED_IMAGERY' AND enc IS NOT NULL THEN 'DATE_IN_LINK' WHEN kind = 'OFFICIAL_OR_COMPANY' AND url LIKE '%.gov/%' THEN 'OFFICIAL_DOMAIN' ELSE 'REVIEWER_ATTESTED' END END AS verification FROM e2"""


@register(EVIDENCE)
def evidence_assessment(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    shift = F.when(c % 4 == 1, 0).otherwise(c % 900 - 450)
    items = t.read("orders").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, LINKS)), (k % 7 + 1).cast("int")).alias("url"), F.element_at(F.array(*map(F.lit, KIND)), (c % 5 + 1).cast("int")).alias("kind"),
        F.when(c % 4 != 0, F.date_add(F.lit("2023-06-05").cast("date"), shift.cast("int"))).alias("observed_on"), F.lit("2023-06-01").cast("timestamp").alias("started_at"), F.lit("2023-06-10").cast("timestamp").alias("as_of"),
    )
    found = cases.evidence(items, ["firms.example.org"], ["basemap"], ["maps.example.com"], [".gov"], "browser.example.gov")
    return found.select("id", "problem", "independent", "reason", "verification")


@register("""WITH s AS (SELECT n_nationkey AS id, 'set-' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'set-' || (n_nationkey // 2) END AS old, n_nationkey * 7 % 25 AS made FROM nation), n AS (SELECT old AS name, arg_max(id, made) AS superseded_by FROM s WHERE old IS NOT NULL GROUP BY old) SELECT id, s.name, old AS replaces, superseded_by::DOUBLE AS superseded_by FROM s LEFT JOIN n USING (name)""")
def superseded_sets(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    old = F.when(k % 3 == 0, F.concat(F.lit("set-"), F.floor(k / 2).cast("string")))
    sets = t.read("nation").select(k.alias("id"), F.concat(F.lit("set-"), k.cast("string")).alias("name"), F.to_json(F.struct(old.alias("supersedes"))).alias("policy"), (k * 7 % 25).alias("created_at"))
    return cases.superseding(sets).withColumn("superseded_by", F.col("superseded_by").cast("double"))


@register(sql("reviews", ", c AS (SELECT o_orderkey AS id, o_orderkey * 37 % 100003 AS place, o_orderkey % 3 <> 0 AS history_complete, o_orderkey % 2 + 1 AS slots FROM orders), d AS (SELECT id FROM reviews WHERE seq % 3 = 1 UNION SELECT o_orderkey FROM orders WHERE o_custkey % 6 = 1), n AS (SELECT id, count(DISTINCT seq % 3) AS n FROM reviews WHERE role = 'REVIEWER' GROUP BY id) SELECT id, place, history_complete FROM c LEFT JOIN n USING (id) WHERE id NOT IN (SELECT id FROM d) AND coalesce(n, 0) < slots ORDER BY history_complete DESC, place LIMIT 50"))
def reviewer_queue(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.read("orders")
    queue = rows.select(k.alias("id"), (k * 37 % 100003).alias("place"), (k % 3 != 0).alias("history_complete"), (k % 2 + 1).alias("review_slots"))
    own = t.reviews().withColumn("reviewer", F.concat(F.lit("rev"), (F.col("seq") % 3).cast("string")))
    seen = rows.select(k.alias("id"), F.when(F.col("o_custkey") % 6 == 1, "REV1").otherwise("REV2").alias("reviewer"))
    return cases.reviewer_queue(queue, own, seen, "Rev1")
