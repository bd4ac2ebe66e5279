"""Queries over what reviewers see and do, over exports of windows with rule outputs, and over saved models."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindertrace.catalog import RESOLVED
from cindertrace.functions import geo
from cindertrace.operators import assessment, reviewing
from cindertrace.operators.components import checkpointed, shared_folder
from cindertrace.plans import assessing as a
from cindertrace.plans import casework as k
from cindertrace.plans.adapter import Tables, distance_sql, sql
from cindertrace.registry import register
from cindertrace.sources import exports, models
from cindertrace.sources.requests import MOST_WITH_RULES

#: Cases at their sites, once in the splits of their groups and once as if nobody had grouped them.
AUDITED = """, au AS (SELECT 'GROUPED' AS made, c.id, p.lon, p.lat, c.split, c.split_group FROM cset c JOIN sub ON sid = c.id JOIN sites p ON site = place
  UNION ALL SELECT 'UNGROUPED', sid, p.lon, p.lat, CASE sid % 3 WHEN 0 THEN 'TRAIN' WHEN 1 THEN 'VALIDATION' ELSE 'TEST' END, CAST(sid % 5 AS VARCHAR) FROM sub JOIN sites p ON site = place),""" + f"""
 nr AS (SELECT made, 'area' AS kind, fac_id, split, split_group FROM au c JOIN site_areas f ON abs(c.lat - f.lat) < 0.05 AND abs(c.lon - f.lon) < 0.05 AND {distance_sql('c', 'f')} <= 500 UNION ALL SELECT made, 'plant', fac_id, split, split_group FROM au c JOIN site_plants f ON abs(c.lat - f.lat) < 0.05 AND abs(c.lon - f.lon) < 0.05 AND {distance_sql('c', 'f')} <= 1500),
 cr AS (SELECT made, kind, fac_id, count(*) AS cases, count(DISTINCT split_group) AS groups, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM nr GROUP BY ALL HAVING count(DISTINCT split) > 1)"""


def audits(t: Tables) -> list[tuple[str, DataFrame]]:
    rows = k.case_rows(t)
    spots = a.subjects(t).select(F.col("sid").alias("id"), F.col("place").alias("site")).join(t.sites().select("site", "lon", "lat"), "site")
    grouped = rows.select("id", "split", "split_group").join(spots, "id")
    third = F.col("id") % 3
    loose = spots.withColumns({"split": F.when(third == 0, "TRAIN").when(third == 1, "VALIDATION").otherwise("TEST"), "split_group": (F.col("id") % 5).cast("string")})
    return [(made, reviewing.grouping_audit(c, t.site_areas(), t.site_plants())) for made, c in (("GROUPED", grouped), ("UNGROUPED", loose))]


@register(k.recursive(k.CASE_TABLES, a.SUBJECTS + k.GROUPS + k.SPLIT_SQL + AUDITED + " SELECT * FROM cr"))
def crossing_facilities(t: Tables) -> DataFrame:
    """Areas and plants whose nearby cases are in several splits: none where cases are grouped, some where they are not."""
    one, two = (found.select(F.lit(made).alias("made"), "kind", "fac_id", "cases", "groups", F.array_join("splits", ",").alias("splits")) for made, found in audits(t))
    return one.unionByName(two)


@register(k.recursive(k.CASE_TABLES, a.SUBJECTS + k.GROUPS + k.SPLIT_SQL + AUDITED + " SELECT m.made, count(fac_id) AS facilities, CAST(coalesce(sum(cases), 0) AS BIGINT) AS cases, count(fac_id) = 0 AS safe FROM (SELECT DISTINCT made FROM au) m LEFT JOIN cr USING (made) GROUP BY m.made"))
def audit_verdicts(t: Tables) -> DataFrame:
    one, two = (reviewing.audit_verdict(found).withColumn("made", F.lit(made)) for made, found in audits(t))
    return one.unionByName(two)


#: The case set with labels of other sources, and how its review is ordered.
CASES = a.SUBJECTS + k.GROUPS + k.SPLIT_SQL + ", cases AS (SELECT id, split, review_slots, CASE WHEN id % 5 = 0 THEN 'INDUSTRIAL' END AS silver, CASE WHEN id % 7 = 0 THEN 'UNKNOWN' WHEN id % 7 < 4 THEN 'AGRICULTURAL_BURN' END AS weak, id * 37 % 100003 AS rank, id % 7 <> 0 AS history_complete FROM cset)"
REVIEW_TABLES = k.CASE_TABLES + " reviews"


def case_table(t: Tables, subjects: DataFrame | None = None) -> DataFrame:
    i = F.col("id")
    more = {"silver": F.when(i % 5 == 0, "INDUSTRIAL"), "weak": F.when(i % 7 == 0, "UNKNOWN").when(i % 7 < 4, "AGRICULTURAL_BURN"), "place": i * 37 % 100003, "history_complete": i % 7 != 0}
    return k.case_rows(t, subjects).select("id", "split", "review_slots").withColumns(more)


@register(k.recursive(REVIEW_TABLES, CASES + RESOLVED + ", rn AS (SELECT id, count(*) AS reviews FROM reviews GROUP BY id) SELECT r.*, split, coalesce(tier = 'GOLD' AND basis IN ('TWO_REVIEWERS_AGREE', 'ADJUDICATED'), false) AS test_eligible, coalesce(reviews, 0) AS reviews FROM resolved r JOIN cases USING (id) LEFT JOIN rn USING (id)"))
def case_labels(t: Tables) -> DataFrame:
    """What every case of the set is labelled, by whom, and whether it may test."""
    return reviewing.case_labels(case_table(t), t.reviews())


#: A reviewer who may adjudicate, with reviews of their own, and cases of which they have seen earlier reviews.
REVIEWER = "Rev0"
JUDGED = RESOLVED + """, rv AS (SELECT id, count(*) FILTER (role = 'REVIEWER') AS reviews, bool_or(seq % 3 = 0) AS mine FROM reviews GROUP BY id), sn AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_custkey % 6 = 1),
 jd AS (SELECT c.id, c.rank, c.history_complete, c.review_slots, coalesce(reviews, 0) AS reviews, coalesce(mine, false) AS mine, sn.id IS NOT NULL AS seen, basis = 'DISAGREEMENT_PENDING_ADJUDICATION' AS pending FROM cases c JOIN b USING (id) LEFT JOIN rv USING (id) LEFT JOIN sn ON sn.id = c.id),
 rl AS (SELECT *, CASE WHEN pending AND NOT mine THEN 'ADJUDICATOR' WHEN NOT (mine OR seen OR pending) AND reviews < review_slots THEN 'REVIEWER' END AS role FROM jd)"""


def judged(t: Tables, cases: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """roles() of cases. Cases and numbered reviews are read several times, so they are written first."""
    cases = checkpointed(case_table(t)) if cases is None else cases
    own = (checkpointed(t.reviews()) if reviews is None else reviews).withColumn("reviewer", F.concat(F.lit("REV"), (F.col("seq") % 3).cast("string")))
    seen = t.read("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 6 == 1, "rev0").otherwise("rev2").alias("reviewer"))
    return reviewing.roles(cases, own, seen, REVIEWER, True)


@register(k.recursive(REVIEW_TABLES, CASES + JUDGED + " SELECT id, coalesce(role, '') AS role, reviews, mine, seen, pending FROM rl"))
def reviewer_roles(t: Tables) -> DataFrame:
    """What one reviewer may do with every case."""
    return judged(t).select("id", F.coalesce("role", F.lit("")).alias("role"), "reviews", "mine", "seen", "pending")


@register(k.recursive(REVIEW_TABLES, CASES + JUDGED + " SELECT id, role, rank AS place, history_complete, reviews, review_slots AS needs FROM rl WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY role ORDER BY history_complete DESC, rank, id) <= 20"))
def reviewer_desk(t: Tables) -> DataFrame:
    """The first cases that a reviewer may settle, and those they may review."""
    return reviewing.desk(judged(t))


@register(k.recursive(REVIEW_TABLES, CASES + JUDGED + " SELECT count(*) FILTER (mine) AS your_reviews, count(*) FILTER (role = 'REVIEWER') AS remaining_reviews, count(*) FILTER (role = 'ADJUDICATOR') AS remaining_adjudications FROM rl"))
def reviewer_desk_counts(t: Tables) -> DataFrame:
    return reviewing.desk_counts(judged(t), True)


def case_members(t: Tables, s: DataFrame) -> DataFrame:
    return a.members(t).join(s.select(F.col("sid").alias("id"), "place", "session_no").hint("merge"), ["place", "session_no"]).select("id", "obs_id", "acquired_at", "lon", "lat", "frp_mw", "daynight", "confidence", "product")


SHOWN = ["obs_id", "acquired_at", "lon", "lat", "frp_mw", "daynight", "confidence", "product"]


@register(sql("obs archive", a.SUBJECTS + ", mb AS (SELECT sid AS id, obs_id, row_number() OVER (PARTITION BY sid ORDER BY acquired_at, obs_id) AS pos FROM ses JOIN (SELECT sid, place, session_no FROM sub) USING (place, session_no)) SELECT id, (pos - 1) // 10 + 1 AS page, count(*) AS n, string_agg(obs_id, ',' ORDER BY pos) AS members FROM mb GROUP BY ALL"))
def case_member_pages(t: Tables) -> DataFrame:
    """The observations of every case in pages of ten."""
    pages = reviewing.member_pages(case_members(t, a.subjects(t)), SHOWN, 10)
    return pages.select("id", "page", "n", F.array_join(F.transform("members", lambda x: x["obs_id"].cast("string")), ",").alias("members"))


PLANTS = f", pl AS (SELECT s.sid, r.plant_id, {distance_sql('s', 'r')} AS d FROM sub s JOIN plants r ON abs(s.lat - r.lat) < 0.06 AND abs(s.lon - r.lon) < 0.07 AND {distance_sql('s', 'r')} <= 5000), pn AS (SELECT sid, count(*) AS plants, arg_min(plant_id, struct_pack(d := round(d, 1), i := plant_id)) AS nearest FROM pl GROUP BY sid)"
BLIND = """, er AS (SELECT id, string_agg(seq || ':' || role || ':' || source_label, ',' ORDER BY seq) AS earlier FROM reviews GROUP BY id), cn AS (SELECT sid, string_agg(fac_id, ',' ORDER BY rank) AS candidates FROM cand GROUP BY sid)
 SELECT rl.id, coalesce(rl.role, '') AS role, sub.n AS members, coalesce(plants, 0) AS plants, nearest::DOUBLE AS nearest_plant, coalesce(candidates, '') AS candidates, round(radius_m, 1) AS support_radius_m, CASE WHEN rl.role = 'ADJUDICATOR' THEN earlier END AS earlier FROM rl JOIN sub ON sub.sid = rl.id LEFT JOIN pn ON pn.sid = rl.id LEFT JOIN cn ON cn.sid = rl.id LEFT JOIN er ON er.id = rl.id"""


@register(k.recursive(a.TABLES + " sites site_areas site_plants reviews plants", CASES + JUDGED + a.context_sql(False) + a.CANDIDATES + PLANTS + BLIND))
def blind_cases(t: Tables) -> DataFrame:
    """What a reviewer is shown of every case; earlier reviews only where they settle a disagreement."""
    s = checkpointed(a.subjects(t))
    own = s.select(F.col("sid").alias("id"), "lon", "lat", "radius_m", "started_at", "as_of")
    reviews = checkpointed(t.reviews())
    mine = checkpointed(judged(t, checkpointed(case_table(t, s).join(own.hint("merge"), "id")), reviews))
    found = a.candidates_of(t, s, a.snapshot_of(t, s)).select(F.col("sid").alias("id"), "fac_id", "rank", F.round("distance_m", 1).alias("distance_m"))
    plants = t.plants().select(F.col("plant_id").alias("fac_id"), "lon", "lat")
    land = s.select(F.col("sid").alias("id"), "place").join(a.land_of(t), "place").drop("place")
    shown = reviewing.blind_cases(mine, reviewing.member_pages(case_members(t, s), SHOWN), found, plants, land, reviews)
    texts = F.transform("earlier", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["role"], x["source_label"]))
    facilities = F.coalesce(F.array_join(F.transform("candidates", lambda x: x["fac_id"].cast("string")), ","), F.lit(""))
    return shown.select("id", F.coalesce("role", F.lit("")).alias("role"), "members", "plants", F.col("nearest_plant.fac_id").cast("double").alias("nearest_plant"), facilities.alias("candidates"), "support_radius_m", F.array_join(texts, ",").alias("earlier"))


@register(sql("obs archive", a.SUBJECTS + ", l AS (SELECT sid AS id, 'https://browser.example.gov/?v=' || printf('%.4f,%.4f,%.4f,%.4f', lon - 0.08, lat - 0.08, lon + 0.08, lat + 0.08) || '&t=' || strftime(as_of, '%Y-%m-%d') || '&l=TrueColor' AS u1, 'https://maps.example.com/@' || printf('%.5f,%.5f', lat, lon) AS u2 FROM sub) SELECT id, 'IMAGERY' AS label, u1 AS url FROM l UNION ALL SELECT id, 'BASEMAP', u2 FROM l"))
def case_links(t: Tables) -> DataFrame:
    """Where a reviewer may look at imagery of a case's place and day."""
    links = reviewing.imagery_links(F.col("lon"), F.col("lat"), F.col("as_of"), "https://browser.example.gov/", "TrueColor", "https://maps.example.com/@")
    return a.subjects(t).select(F.col("sid").alias("id"), F.explode(links).alias("x")).select("id", "x.label", "x.url")


#: Windows that are asked for: most hold one place for some days, every tenth half a degree for a month.
REQUESTS = """, rq AS (SELECT s_suppkey AS request_id, 69.499::DOUBLE + 0.02::DOUBLE * (s_suppkey % 50) AS west, 21.999::DOUBLE + 0.02::DOUBLE * (s_suppkey // 50) AS south, CASE WHEN s_suppkey % 10 = 9 THEN 0.5::DOUBLE ELSE 0.0065::DOUBLE END AS wide, DATE '2024-01-01' + CAST(s_suppkey % 25 AS INTEGER) AS start_date, CASE WHEN s_suppkey % 10 = 9 THEN 31 ELSE 1 + s_suppkey % 5 END AS days FROM supplier),
 mt AS (SELECT request_id, obs_id FROM rq JOIN obs ON lon BETWEEN west AND west + wide AND lat BETWEEN south AND south + wide AND acquired_at >= start_date AND acquired_at < start_date + CAST(days AS INTEGER)),
 cw AS (SELECT request_id, count(obs_id) AS matches, count(obs_id) > 100 AS refused FROM rq LEFT JOIN mt USING (request_id) GROUP BY request_id)"""


def requests(t: Tables) -> DataFrame:
    n = F.col("s_suppkey")
    west, south, start = 69.499 + 0.02 * (n % 50), 21.999 + 0.02 * F.floor(n / 50), F.date_add(F.lit("2024-01-01").cast("date"), (n % 25).cast("int"))
    wide, days = F.when(n % 10 == 9, 0.5).otherwise(0.0065), F.when(n % 10 == 9, 31).otherwise(1 + n % 5)
    return t.read("supplier").select(n.alias("request_id"), west.alias("west"), south.alias("south"), (west + wide).alias("east"), (south + wide).alias("north"), start.alias("start_date"), F.date_add(start, days.cast("int")).alias("end_date"))


@register(sql("obs", REQUESTS + " SELECT * FROM cw"))
def window_requests(t: Tables) -> DataFrame:
    """How many observations each window holds, and whether it is refused with rule outputs."""
    return exports.windows(requests(t), t.obs(), MOST_WITH_RULES)


#: Observations of the windows that were not refused, each judged as of its own time.
EXPORTED = a.SUBJECTS.replace(" sub AS (", " sub0 AS (") + REQUESTS + ", wr AS (SELECT mt.* FROM mt JOIN cw USING (request_id) WHERE NOT refused), sub AS (SELECT obs_id AS sid, place, lon, lat, acquired_at AS as_of, 500 * sqrt(coalesce(scan, 0.375) * coalesce(scan, 0.375) + coalesce(track, 0.375) * coalesce(track, 0.375)) + 100 AS radius_m FROM archive WHERE obs_id IN (SELECT obs_id FROM wr))"


@register(sql(a.TABLES, a.assess_sql(False).replace(a.SUBJECTS, EXPORTED, 1) + " SELECT request_id, sid AS obs_id, CAST(epoch(as_of) AS BIGINT) AS acquired_at, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in assessment.RULE_COLUMNS) + " FROM assessed JOIN wr ON wr.obs_id = sid"))
def window_exports(t: Tables) -> DataFrame:
    """The observations of every window that was not refused, with what the rules say of each as of its own time."""
    archive, asked = t.archive(), requests(t)
    rows = checkpointed(exports.window_rows(asked, exports.windows(asked, archive, MOST_WITH_RULES), archive))
    s = rows.select(F.col("obs_id").alias("sid"), "place", "lon", "lat", F.col("acquired_at").alias("as_of"), geo.support_radius_m(F.col("scan"), F.col("track")).alias("radius_m")).distinct()
    told = assessment.rule_columns(a.judged(t, checkpointed(s)))
    return rows.select("request_id", F.col("obs_id").alias("sid"), F.unix_timestamp("acquired_at").alias("acquired_at")).join(told, "sid").withColumnRenamed("sid", "obs_id")


@register(sql("predictions", "SELECT id, y, round(p, 6) AS p, count(*) AS n FROM predictions GROUP BY ALL"))
def saved_predictions(t: Tables) -> DataFrame:
    """A model's predictions, read back from its files once these have been checked against its manifest."""
    folder = f"{shared_folder(t.spark)}/models-{uuid4().hex}"
    report = {"model_id": "first-model", "case_set": "set-one", "algorithm": "gbt", "status": "EVALUATED_NOT_PROMOTED", "label_policy": "gold-or-silver", "labels_sha256": "0" * 64}
    models.save(t.spark, folder, report, "2024-02-01T00:00:00Z", predictions=t.predictions().select("id", "y", F.round("p", 6).alias("p")))
    wrong = models.changed(t.spark, folder, "first-model")
    if not wrong.isEmpty():
        raise ValueError(f"MODEL_CHANGED: {wrong.first()['path']}")
    return models.predictions(t.spark, folder, "first-model", "id long, y int, p double").groupBy("id", "y", "p").agg(F.count("*").alias("n"))
