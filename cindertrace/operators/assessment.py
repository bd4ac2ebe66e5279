"""Assessments of many subjects in one plan: history as of a time, context, and the ordered rules.

Subjects: sid, lon, lat, as_of, radius_m. Detections: obs_id, lon, lat, acquired_at, frp_mw, satellite,
daynight, product, available_at. Retrievals: start_date, end_date, received_at, product, rejected_rows,
status, mode, and their box. Everything joins on cells or keys; nothing is looked up by subject.

Joins by sid have merge hints: stored subjects, days and snapshots are small as files, but not as a hash table
in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.operators import coverage, history, rules
from cindertrace.operators.groups import dealt
from cindertrace.operators.spatial import near

# The history's radius and look-back, and the products that are one sensor's record.
SITE_M, LOOK_BACK_DAYS, FAMILY = 750.0, 182, ("NRT", "SP")


def group_key(satellite: Column, daynight: Column) -> Column:
    return F.concat_ws("/", satellite, daynight)


def product_family(product: Column) -> Column:
    """One name for near-real-time and archived files of a sensor; any other product stands alone."""
    return F.when(product.isin(*FAMILY), "N20").otherwise(product)


def covered_days(subjects: DataFrame, passes: DataFrame, mode: str, operational: bool = False) -> DataFrame:
    """sid, product, block, bits: days that a complete retrieval covers around each subject (coverage.covered)."""
    return coverage.covered(subjects, passes, mode, SITE_M, LOOK_BACK_DAYS, operational)


def as_of_history(subjects: DataFrame, detections: DataFrame, days: DataFrame, operational: bool = False) -> DataFrame:
    """Detections around each subject up to its as_of, with `kept`: false where the archive supersedes them.

    days: as covered_days() gives them. Operationally only detections that were available by as_of count.
    """
    rows = _looked_back(subjects, detections)
    return _reconciled(rows.filter("available_at <= as_of") if operational else rows, days).drop("available_at")


def withheld(subjects: DataFrame, detections: DataFrame, days: DataFrame) -> DataFrame:
    """sid, excluded_unknown_availability: detections up to as_of, not superseded, that an operational assessment leaves out.

    They were available only later, or nobody knows when. days: operational covered_days(). What is left out supersedes nothing.
    """
    known = F.coalesce(F.col("available_at") <= F.col("as_of"), F.lit(False))
    rows = _reconciled(_looked_back(subjects, detections), days, known)
    counts = rows.filter(F.col("kept") & ~known).groupBy("sid").agg(F.count("*").alias("excluded_unknown_availability"))
    return subjects.select("sid").join(counts.hint("merge"), "sid", "left").fillna(0, ["excluded_unknown_availability"])


def _looked_back(subjects: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections around each subject in the LOOK_BACK_DAYS up to its as_of.

    The join is on a cell and a slab of LOOK_BACK_DAYS, of which a subject's look-back touches two, so a
    place's earlier years meet nobody.
    """

    def slab(at: Column) -> Column:
        return F.floor(F.unix_seconds(at) / (86400 * LOOK_BACK_DAYS))

    as_of = F.col("as_of")
    slabs = F.array(slab(as_of) - 1, slab(as_of))
    asked = subjects.select("sid", "lon", "lat", "as_of", F.explode(slabs).alias("slab"))
    own = detections.select("obs_id", "lon", "lat", "acquired_at", "frp_mw", "satellite", "daynight", "product", "available_at", slab(F.col("acquired_at")).alias("slab"))
    rows = near(own, asked, SITE_M, on=["slab"])
    rows = rows.filter((F.col("acquired_at") <= F.col("as_of")) & (F.col("acquired_at") > F.col("as_of") - F.make_dt_interval(F.lit(LOOK_BACK_DAYS))))
    return rows.select("sid", "as_of", "obs_id", "acquired_at", "frp_mw", "satellite", "daynight", "product", "available_at", F.to_date("acquired_at").alias("day"))


def _reconciled(rows: DataFrame, days: DataFrame, known: Column | None = None) -> DataFrame:
    """Adds `kept`: archived rows, and others on days and at times that the archive (as far as it is known) does not have."""
    archived = F.col("product") == "SP"
    archive = F.max((archived if known is None else archived & known).cast("int")).over(Window.partitionBy("sid", "acquired_at")) == 1
    day = F.col("day")
    rows = rows.withColumns({"archive": archive, "block": coverage.block_of(day)}).join(days.filter("product = 'SP'").select("sid", "block", "bits").hint("merge"), ["sid", "block"], "left")
    sp_day = F.coalesce(F.getbit("bits", coverage.bit_of(day)) == 1, F.lit(False))
    return rows.withColumn("kept", archived | ~(sp_day | F.col("archive"))).drop("archive", "block", "bits")


def features(subjects: DataFrame, rows: DataFrame, days: DataFrame, windows: tuple[int, ...] = history.WINDOWS) -> DataFrame:
    """One row for each subject: windows before the last 24 hours, counts, and the strongest current group.

    rows as as_of_history() gives them. best: n (matched overpasses), z and direction data of the sensor
    group that departs most from its baseline; current: how many groups have FRP now.
    """
    start = F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(history.EPISODE_HOURS))
    live = rows.filter("kept").withColumn("start", start)
    now = F.col("acquired_at") > F.col("start")
    inside = {d: (F.col("acquired_at") < F.col("start")) & (F.col("acquired_at") >= F.col("start") - F.make_dt_interval(F.lit(d))) for d in windows}
    latest = [F.max(F.when(w, F.col("acquired_at"))).alias(f"latest_{d}") for d, w in inside.items()]
    daily = history.trailing_counts(dealt(live, "sid"), ["sid", "start"], inside, F.sum(F.when(now, F.col("n")).otherwise(0)).alias("current_detections"), F.max("acquired_at").alias("latest"), *latest)
    since = [F.round((F.max("start").cast("double") - F.max(f"latest_{d}").cast("double")) / 86400, 2).alias(f"days_since_{d}") for d in windows]
    seen = daily.groupBy("sid").agg(F.sum("current_detections").alias("current_detections"), F.max("latest").alias("latest"), *history.summed(windows), *since)
    dropped = rows.groupBy("sid").agg(F.count_if(~F.col("kept")).alias("superseded"))
    began = F.to_date(start)
    block, bits = F.col("block"), F.col("bits")
    covered = subjects.select("sid", "as_of").join(coverage.any_product(days).hint("merge"), "sid").groupBy("sid").agg(*[F.sum(coverage.days_in(bits, block, F.date_sub(began, d), began)).alias(f"covered_{d}") for d in windows])
    passes = live.filter("frp_mw IS NOT NULL").groupBy("sid", "start", "acquired_at", "satellite", "daynight").agg(F.greatest(F.max("frp_mw"), F.lit(0.0)).alias("frp"))
    by = ["sid", "satellite", "daynight"]
    current = passes.filter(now).groupBy(*by).agg(F.round(F.max("frp"), 3).alias("current_frp"))
    base = passes.filter((F.col("acquired_at") < F.col("start")) & (F.col("acquired_at") >= F.col("start") - F.make_dt_interval(F.lit(history.BASELINE_DAYS))))
    stats = history.robust_stats(base, *by)
    groups = current.join(stats, by, "left").withColumns({"z": history.robust_z(F.col("current_frp"), F.col("median_log1p"), F.col("mad_log1p")), "group": group_key(F.col("satellite"), F.col("daynight"))})
    scale = 1.4826 * F.col("mad_log1p")
    flags = F.struct("z", (F.col("mad_log1p") == 0).alias("mad_zero"), (scale < history.MIN_LOG_SCALE).alias("floored"), (F.abs((F.ln(1 + F.col("current_frp")) - F.col("median_log1p")) / F.greatest(scale, F.lit(history.MIN_LOG_SCALE))) > history.Z_CAP).alias("capped"), "group")
    # of equally strong groups the first by name
    strongest = F.min_by(flags, F.when(F.col("n") >= history.MIN_MATCHED, F.struct(-F.abs("z"), "group")))
    best = groups.groupBy("sid").agg(F.count("*").alias("current"), F.max("n").alias("matched"), strongest.alias("best"))
    out = subjects
    for part in (seen, dropped, covered, best):
        out = out.join(part.hint("merge"), "sid", "left")
    zero = [f"{c}_{d}" for c in ("detections", "overpasses", "active_days", "covered") for d in windows]
    out = out.fillna(0, [*zero, "superseded", "current_detections"])
    return out.withColumns({f"coverage_{d}": F.round(F.col(f"covered_{d}") / d, 3) for d in windows}).select("*", "best.z", "best.mad_zero", "best.floored", "best.capped", "best.group").drop("best")


def assess(found: DataFrame) -> DataFrame:
    """Adds behaviour, source and priority to features() joined with context.summary(), snapshot_id and land-cover shares.

    built, crop, vegetation are null without land cover.
    """
    cover, active = F.col("coverage_90"), F.col("active_days_90")
    out = found.withColumn("behaviour_rule", rules.behaviour_rule(F.coalesce("current", F.lit(0)) > 0, cover, active, F.col("matched")))
    out = out.withColumn("behaviour", rules.behaviour_label(F.col("behaviour_rule"), F.col("z")))
    out = out.withColumn("direction", rules.direction(F.col("behaviour"), F.col("z")))
    mapped, thermal = (F.coalesce(c, F.lit(0)) for c in ("mapped", "thermal"))
    rule = rules.source_rule(F.col("snapshot_id").isNotNull(), mapped, thermal, F.col("built"), F.col("crop"), F.col("vegetation"), active, cover)
    out = out.withColumn("source_rule", rule).withColumn("source", rules.source_label(F.col("source_rule")))
    subtype = rules.source_subtype(F.col("source_rule"), F.col("types"), F.coalesce("flare", F.lit(False)), active)
    out = out.withColumns({"subtype": subtype, "priority": rules.priority_rule(F.col("source"), F.col("behaviour"), F.col("direction"))})
    missing = F.array_compact(F.array(F.when(F.col("snapshot_id").isNull(), "FACILITY_CONTEXT"), F.when(F.col("crop").isNull(), "LAND_COVER")))
    return out.withColumn("missing", F.array_join(missing, ","))


def snapshot_digest(*columns: str) -> Column:
    """SHA-256 of what an assessment rests on, in the order given."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


# The columns that an export of rule outputs has.
RULE_COLUMNS = ["behaviour", "behaviour_rule", "direction", "source", "source_rule", "subtype", "priority"]


def rule_columns(assessed: DataFrame) -> DataFrame:
    return assessed.select("sid", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in RULE_COLUMNS])
