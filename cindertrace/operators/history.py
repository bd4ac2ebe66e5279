"""As-of history of places: eligibility, streams, coverage, trailing windows, robust baselines.

Detections: place, obs_id, acquired_at, frp_mw, satellite, daynight, product, available_at.
Runs: place, start_date, end_date, received_at. All subjects are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrace.operators.groups import dealt

# The assessment's thresholds.
EPISODE_HOURS, WINDOWS, BASELINE_DAYS = 24, (7, 30, 90, 180), 90
MIN_COVERAGE, MIN_MATCHED, Z_LIMIT, MIN_LOG_SCALE, Z_CAP, RECURRENT_DAYS = 0.8, 5, 3.5, 0.1, 50.0, 5


def eligible(detections: DataFrame, as_of: Column, operational: bool) -> DataFrame:
    """Detections up to as_of; operationally also known to be available by then."""
    ok = F.col("acquired_at") <= as_of
    return detections.filter(ok & (F.col("available_at") <= as_of) if operational else ok)


def overpass_max(detections: DataFrame, *keys: str) -> DataFrame:
    """The greatest FRP of each overpass (never less than 0); rows without FRP don't count."""
    by = [*keys, "acquired_at", "satellite", "daynight"]
    return detections.filter("frp_mw IS NOT NULL").groupBy(*by).agg(F.greatest(F.max("frp_mw"), F.lit(0.0)).alias("frp"))


def robust_stats(overpasses: DataFrame, *keys: str) -> DataFrame:
    """n, median, p10, p90 (nearest rank), and median and MAD of ln(1 + frp)."""
    level = F.ln(1 + F.col("frp"))
    mid = overpasses.groupBy(*keys).agg(F.count("*").alias("n"), F.median("frp").alias("median_frp"), F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY frp)").alias("p10"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY frp)").alias("p90"), F.median(level).alias("m"))
    away = overpasses.join(mid.select(*keys, "m"), list(keys)).groupBy(*keys).agg(F.median(F.abs(level - F.col("m"))).alias("mad"))
    rounded = {"median_frp": F.round("median_frp", 3), "p10": F.round("p10", 3), "p90": F.round("p90", 3), "median_log1p": F.round("m", 5), "mad_log1p": F.round("mad", 5)}
    return mid.join(away, list(keys)).withColumns(rounded).drop("m", "mad")


def robust_z(current: Column, median_log1p: Column, mad_log1p: Column) -> Column:
    """How far ln(1 + current) is from the baseline, in units of its spread."""
    z = (F.ln(1 + current) - median_log1p) / F.greatest(1.4826 * mad_log1p, F.lit(MIN_LOG_SCALE))
    return F.round(F.greatest(F.lit(-Z_CAP), F.least(F.lit(Z_CAP), z)), 3)


def coverage_days(runs: DataFrame, *keys: str) -> DataFrame:
    """One row for each day that a qualifying run covers."""
    return runs.select(*keys, F.explode(F.sequence("start_date", "end_date")).alias("day")).distinct()


def reconcile_streams(detections: DataFrame, archive_days: DataFrame) -> DataFrame:
    """Drops near-real-time rows that the archive supersedes: on days it covers, or at times it has."""
    day = F.to_date("acquired_at")
    late = detections.filter("product = 'SP'")
    quick = detections.filter("product != 'SP'").withColumn("day", day)
    left = quick.join(archive_days.select("place", "day").distinct(), ["place", "day"], "left_anti").drop("day")
    left = left.join(late.select("place", "acquired_at").distinct(), ["place", "acquired_at"], "left_anti")
    return late.unionByName(left.select(*late.columns))


def trailing_counts(rows: DataFrame, keys: list[str], windows: dict[int, Column], *day_measures: Column) -> DataFrame:
    """keys, day, detections_d, overpasses_d, active_days_d of each window d: adds up to counts by keys.

    rows: keys, day, acquired_at, satellite, on tasks by (some of) their keys. windows: which rows are inside, told from
    keys and acquired_at. Equal overpasses fall together first and days after them, so no row is multiplied for each distinct
    count. day_measures: aggregates over overpasses.
    """
    passes = rows.groupBy(*keys, "day", "acquired_at", "satellite").agg(F.count("*").alias("n"))
    measures = []
    for d, inside in windows.items():
        measures += [F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(f"detections_{d}"), F.count_if(inside).alias(f"overpasses_{d}"), F.max(F.when(inside, 1).otherwise(0)).cast("long").alias(f"active_days_{d}")]
    return passes.groupBy(*keys, "day").agg(*measures, *day_measures)


def summed(windows: Iterable[int]) -> list[Column]:
    """Aggregates of trailing_counts() over days."""
    return [F.sum(f"{c}_{d}").alias(f"{c}_{d}") for d in windows for c in ("detections", "overpasses", "active_days")]


def window_features(detections: DataFrame, subjects: DataFrame, covered: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Trailing windows [start - d days, start) of each subject(place, start): one pass, no join for each window."""
    longest = max(windows)
    first, last = F.col("start") - F.make_dt_interval(F.lit(longest)), F.col("start")
    rows = dealt(detections.select("place", "acquired_at", "satellite", F.to_date("acquired_at").alias("day")), "place").join(subjects.select("place", "start").hint("merge"), "place").filter((F.col("acquired_at") >= first) & (F.col("acquired_at") < last))
    inside = {d: F.col("acquired_at") >= F.col("start") - F.make_dt_interval(F.lit(d)) for d in windows}
    cover = [F.count_if(F.col("day") >= F.date_sub(F.to_date("start"), d)).alias(f"covered_{d}") for d in windows]
    seen = trailing_counts(rows, ["place", "start"], inside, F.max("acquired_at").alias("last_at")).groupBy("place", "start").agg(*summed(windows), F.max("last_at").alias("last_at"))
    days = covered.join(subjects.select("place", "start"), "place").filter((F.col("day") < F.to_date("start")) & (F.col("day") >= F.date_sub(F.to_date("start"), longest)))
    days = days.groupBy("place", "start").agg(*cover)
    out = subjects.join(seen, ["place", "start"], "left").join(days, ["place", "start"], "left")
    zero = [c for c in out.columns if c.rsplit("_", 1)[0] in ("detections", "overpasses", "active_days", "covered")]
    out = out.fillna(0, zero)
    return out.withColumns({f"coverage_{d}": F.round(F.col(f"covered_{d}") / d, 4) for d in windows})


def daily_series(detections: DataFrame, places: DataFrame, covered: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of every place: how many detections, or null where nothing was retrieved and none is known."""
    days = places.select("place", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = detections.groupBy("place", F.to_date("acquired_at").alias("day")).agg(F.count("*").alias("n"), F.max("frp_mw").alias("max_frp"))
    known = covered.select("place", "day", F.lit(True).alias("retrieved"))
    joined = days.join(counts, ["place", "day"], "left").join(known, ["place", "day"], "left")
    retrieved = F.coalesce("retrieved", F.lit(False))
    return joined.select("place", "day", retrieved.alias("retrieved"), F.when(F.col("n").isNotNull(), F.col("n")).when(retrieved, 0).alias("detections"), "max_frp")


def islands(days: DataFrame, *keys: str) -> DataFrame:
    """Runs of consecutive days(…, day): first_day, last_day, n_days."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    return days.withColumn("g", F.date_sub("day", place)).groupBy(*keys, "g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("g")
