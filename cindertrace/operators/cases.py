"""Cases: one for each episode, with its group, split and place in time; reviews, evidence, and what may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.operators.components import components
from cindertrace.operators.labels import assign_splits, forced_kind, link_host
from cindertrace.operators.spatial import near, self_pairs

# The day that parts cases into earlier and later ones, distances that tie sites, and evidence.
FORWARD_CUTOFF, SITES_M, AREA_M, REGISTRY_M = "2026-08-15", 2000.0, 500.0, 1500.0
POLICY, WINDOW_DAYS = "evidence-v2", (365, 30)
KINDS = ("DATED_IMAGERY", "OFFICIAL_OR_COMPANY", "NEWS_REPORT", "UNDATED_BASEMAP", "PROJECT_INPUT", "OTHER")


def representatives(members: DataFrame, *keys: str) -> DataFrame:
    """The strongest observation of each episode (no FRP last, then the earliest, then the least id), with its span and size."""
    strength = F.struct(F.col("frp_mw").isNull(), -F.col("frp_mw"), "acquired_at", "obs_id")
    best = F.min_by(F.struct("obs_id", "lon", "lat", "scan", "track"), strength)
    found = members.groupBy(*keys).agg(best.alias("b"), F.min("acquired_at").alias("started_at"), F.max("acquired_at").alias("ended_at"), F.count("*").alias("n_observations"))
    return found.select(*keys, "b.*", "started_at", "ended_at", "n_observations")


def site_groups(sites: DataFrame, facilities: DataFrame, registry: DataFrame) -> DataFrame:
    """site, split_group: sites within SITES_M of each other, or of one mapped area or registered plant, are one group.

    sites: site, lon, lat. facilities and registry: fac_id, lon, lat. A facility links its sites in a chain,
    so a facility with many sites gives no pairs of all of them.
    """
    own = sites.select("site", "lon", "lat")
    links = self_pairs(own, SITES_M, "site").select("a", "b")
    for kind, others, reach in (("area", facilities, AREA_M), ("plant", registry, REGISTRY_M)):
        of = near(own, others.select("fac_id", "lon", "lat"), reach).select(F.lit(kind).alias("kind"), "fac_id", "site")
        chain = F.lag("site").over(Window.partitionBy("kind", "fac_id").orderBy("site"))
        links = links.unionByName(of.withColumn("a", chain).filter("a IS NOT NULL").select("a", F.col("site").alias("b")))
    return components(sites.select(F.col("site").alias("node")), links).select(F.col("node").alias("site"), F.col("root").alias("split_group"))


def build(episodes: DataFrame, groups: DataFrame, cutoff: str = FORWARD_CUTOFF) -> DataFrame:
    """One case for each of episodes(id, site, region_id, started_at, as_of, ...): its split_group, split, forward_period, review_slots."""
    c = episodes.join(groups.hint("merge"), "site")
    c = c.join(assign_splits(c.select("region_id", "split_group")).hint("merge"), ["region_id", "split_group"])
    period = F.when(F.col("as_of") < F.lit(cutoff).cast("timestamp"), "BEFORE").otherwise("AFTER")
    return c.withColumns({"forward_period": period, "review_slots": F.when(F.col("split") == "TEST", 2).otherwise(1)})


def superseding(sets: DataFrame) -> DataFrame:
    """id, name, replaces, superseded_by for sets(id, name, policy JSON, created_at): the newest set that names this one."""
    named = sets.select(F.col("id").alias("newer"), F.get_json_object("policy", "$.supersedes").alias("name"), "created_at")
    newest = named.filter("name IS NOT NULL").groupBy("name").agg(F.max_by("newer", F.struct("created_at", "newer")).alias("superseded_by"))
    return sets.select("id", "name", F.get_json_object("policy", "$.supersedes").alias("replaces")).join(newest, "name", "left").select("id", "name", "replaces", "superseded_by")


def current_reviews(reviews: DataFrame, voided: DataFrame) -> DataFrame:
    """Reviews of reviewers that were not voided, by the name in any case."""
    gone = voided.select(F.lower("reviewer").alias("_r"), "id").distinct()
    return reviews.join(gone, (F.lower("reviewer") == F.col("_r")) & (reviews["id"] == gone["id"]), "left_anti")


def qualifies(policy: Column, independent: Column, location: Column, certainty: Column) -> Column:
    """Does a review's evidence let its label count as certain? Unknown forms never do."""
    return F.coalesce((policy == POLICY) & independent & (location == "INSIDE_PIXEL_AREA") & certainty.isin("HIGH", "MEDIUM"), F.lit(False))


def encoded_date(url: Column, host: str) -> Column:
    """The day in the query of an imagery browser's link (t=YYYY-MM-DD...)."""
    day = F.substring(F.try_parse_url(url, F.lit("QUERY"), F.lit("t")), 1, 10)
    return F.when((link_host(url) == host) & day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))


def evidence(items: DataFrame, input_hosts: list[str], basemap_hosts: list[str], map_hosts: list[str], official: list[str], browser: str) -> DataFrame:
    """items(url, kind, observed_on, started_at, as_of) with problem (null: in order), independent, reason and verification."""
    url, kind = F.col("url"), F.col("kind")
    forced, day = forced_kind(url, input_hosts, basemap_hosts, map_hosts), encoded_date(url, browser)
    out = items.withColumns({"forced": forced, "in_link": day})
    imagery = kind == "DATED_IMAGERY"
    browsed = link_host(url) == browser
    problem = (
        F.when(~F.coalesce(url.rlike(r"^https?://\S+$"), F.lit(False)), "NOT_A_LINK").when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "UNKNOWN_KIND")
        .when(F.col("forced").isNotNull() & (kind != F.col("forced")), "ONLY_AS_FORCED").when(imagery & F.col("observed_on").isNull(), "NO_IMAGERY_DATE")
        .when(imagery & browsed & F.col("in_link").isNull(), "NO_DATE_IN_LINK").when(imagery & browsed & (F.col("in_link") != F.col("observed_on")), "DATES_DIFFER")
    )
    near_ = F.col("observed_on").between(F.date_sub(F.to_date("started_at"), WINDOW_DAYS[0]), F.date_add(F.to_date("as_of"), WINDOW_DAYS[1]))
    ok = F.when(imagery, F.coalesce(near_, F.lit(False))).otherwise(kind == "OFFICIAL_OR_COMPANY")
    reason = F.when(imagery & ok, "NEAR_THE_EPISODE").when(imagery, "TOO_FAR_IN_TIME").when(ok, "OFFICIAL").when(kind == "PROJECT_INPUT", "SAME_DATA").otherwise("NOT_SUFFICIENT_ALONE")
    suffix = F.lit(False)
    for s in official:
        suffix = suffix | link_host(url).endswith(s)
    checked = F.when(F.col("forced").isNotNull(), "HOST_RULE").when(imagery & F.col("in_link").isNotNull(), "DATE_IN_LINK").when((kind == "OFFICIAL_OR_COMPANY") & suffix, "OFFICIAL_DOMAIN").otherwise("REVIEWER_ATTESTED")
    out = out.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return out.withColumns({"independent": F.when(good, ok), "reason": F.when(good, reason), "verification": F.when(good, checked)}).drop("in_link")


def reviewer_queue(cases: DataFrame, reviews: DataFrame, seen: DataFrame, reviewer: str, most: int = 50) -> DataFrame:
    """What a reviewer may look at next: complete histories first, then by place; nothing they did or saw, nothing that is full.

    cases: id, place, history_complete, review_slots. seen: id, reviewer.
    """
    own = F.lower("reviewer") == reviewer.lower()
    done = reviews.filter(own).select("id").unionByName(seen.filter(own).select("id")).distinct()
    counts = reviews.filter("role = 'REVIEWER'").groupBy("id").agg(F.count_distinct(F.lower("reviewer")).alias("n"))
    left = cases.join(done, "id", "left_anti").join(counts, "id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("review_slots"))
    return left.select("id", "place", "history_complete").orderBy(F.desc("history_complete"), "place").limit(most)


def usable(rows: DataFrame, weak: bool = False) -> DataFrame:
    """Rows that may train or test: complete history, a target, and a tier good enough for the split.

    rows: split, target, tier, test_eligible, history_complete.
    """
    tiers = ["GOLD", "SILVER", *(["WEAK"] if weak else [])]
    fit = F.col("tier").isin(tiers)
    ok = fit if weak else F.when(F.col("split") == "TEST", F.col("test_eligible")).otherwise(fit)
    return rows.filter(F.col("history_complete") & F.col("target").isNotNull() & F.coalesce(ok, F.lit(False)))
