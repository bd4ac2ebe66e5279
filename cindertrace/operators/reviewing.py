"""A reviewer's desk: what they may review blind, what they may settle, and what they are shown of a case.

A case is reviewed blind by as many reviewers as it has slots. Where they disagree, someone who has not
reviewed it and may adjudicate settles it; whoever has seen earlier reviews for that can never review the
case blind. Names are compared in any case. All cases are judged in one plan for a reviewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.operators import labels
from cindertrace.operators.cases import AREA_M, REGISTRY_M
from cindertrace.operators.ranks import numbered
from cindertrace.operators.spatial import near

#: How many cases of each role a desk shows, and how many members of a case one page has.
SHOWN, PAGE = 20, 500
# Fixed value: the radius of registered plants that a reviewer is shown.
SHOWN_REGISTRY_M = 5000.0


def grouping_audit(cases: DataFrame, areas: DataFrame, registry: DataFrame) -> DataFrame:
    """kind, fac_id, cases, groups, splits of mapped areas and registered plants whose nearby cases fall into more than one split.

    cases: id, lon, lat, split, split_group. areas and registry: fac_id, lon, lat. No row means that the
    groups keep splits apart. A facility's cases are added up within tasks; it has three splits at most.
    """
    own = cases.select("id", "lon", "lat", "split", "split_group")
    found = None
    for kind, others, reach in (("area", areas, AREA_M), ("plant", registry, REGISTRY_M)):
        of = near(own, others.select("fac_id", "lon", "lat"), reach).select(F.lit(kind).alias("kind"), "fac_id", "split", "split_group")
        found = of if found is None else found.unionByName(of)
    groups = found.groupBy("kind", "fac_id", "split", "split_group").agg(F.count("*").alias("n"))
    out = groups.groupBy("kind", "fac_id").agg(F.sum("n").alias("cases"), F.count_distinct("split_group").alias("groups"), F.array_sort(F.collect_set("split")).alias("splits"))
    return out.filter(F.size("splits") > 1)


def audit_verdict(audit: DataFrame) -> DataFrame:
    """One row: facilities, cases near them (a case counts for each), and whether groups may be claimed to be unseen."""
    return audit.agg(F.count("*").alias("facilities"), F.coalesce(F.sum("cases"), F.lit(0)).alias("cases")).withColumn("safe", F.col("facilities") == 0)


def case_labels(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """id, split, label, tier, basis, test_eligible, reviews of every case of a set.

    cases: id, split, review_slots, silver, weak. reviews: those that count (cases.current_reviews), as
    labels.resolve_labels takes them.
    """
    counts = reviews.groupBy("id").agg(F.count("*").alias("reviews"))
    out = labels.resolve_labels(cases, reviews).join(cases.select("id", "split"), "id").join(counts, "id", "left").fillna(0, ["reviews"])
    return out.select("id", "split", "label", "tier", "basis", labels.test_eligible(F.col("tier"), F.col("basis")).alias("test_eligible"), "reviews")


def roles(cases: DataFrame, reviews: DataFrame, seen: DataFrame, reviewer: str, may_adjudicate: bool) -> DataFrame:
    """cases with reviews (blind ones), mine, pending, seen, and role: ADJUDICATOR, REVIEWER, or null.

    cases: id, review_slots, ... reviews: as above, with reviewer. seen: id, reviewer, of those who were
    shown earlier reviews. Null tells the reviewer nothing: it is the same for a case that is full, one that
    waits for an adjudicator, and their own.
    """
    blank = F.lit(None).cast("string")
    states = labels.resolve_labels(cases.select("id", "review_slots", blank.alias("silver"), blank.alias("weak")), reviews)
    pending = states.select("id", (F.col("basis") == "DISAGREEMENT_PENDING_ADJUDICATION").alias("pending"))
    own = F.lower("reviewer") == reviewer.lower()
    counts = reviews.groupBy("id").agg(F.count_if(F.col("role") == "REVIEWER").alias("reviews"), F.coalesce(F.bool_or(own), F.lit(False)).alias("mine"))
    shown = seen.filter(own).select("id", F.lit(True).alias("seen")).distinct()
    out = cases.join(pending, "id").join(counts, "id", "left").join(shown, "id", "left").fillna(0, ["reviews"]).fillna(False, ["mine", "seen"])
    settles = F.col("pending") & F.lit(may_adjudicate) & ~F.col("mine")
    reviewing = ~(F.col("mine") | F.col("seen") | F.col("pending")) & (F.col("reviews") < F.col("review_slots"))
    return out.withColumn("role", F.when(settles, "ADJUDICATOR").when(reviewing, "REVIEWER"))


def desk(judged: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first cases of each role: those with a complete history first, then by place, at most `most` of a role.

    judged: roles() of cases with place (without ties) and history_complete. Both lists come from one pass: a
    task passes on `most` rows of each role.
    """
    order = Window.partitionBy("role").orderBy(F.desc("history_complete"), "place", "id")
    first = judged.filter(F.col("role").isin("ADJUDICATOR", "REVIEWER")).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
    return first.select("id", "role", "place", "history_complete", "reviews", F.col("review_slots").alias("needs"))


def desk_counts(judged: DataFrame, may_adjudicate: bool) -> DataFrame:
    """One row: your_reviews, remaining_reviews, remaining_adjudications (null for those who may not adjudicate)."""
    waiting = F.count_if(F.col("role") == "ADJUDICATOR") if may_adjudicate else F.lit(None).cast("long")
    return judged.agg(F.count_if("mine").alias("your_reviews"), F.count_if(F.col("role") == "REVIEWER").alias("remaining_reviews"), waiting.alias("remaining_adjudications"))


def newly_seen(judged: DataFrame, reviewer: str) -> DataFrame:
    """id, reviewer to be added to `seen` when an adjudicator is shown these cases."""
    return judged.filter("role = 'ADJUDICATOR' AND NOT seen").select("id", F.lit(reviewer).alias("reviewer"))


def member_pages(members: DataFrame, shown: list[str], size: int = PAGE) -> DataFrame:
    """id, page (from 1), n, members: a case's observations in the order of time, in pages of bounded size.

    members: id, acquired_at, obs_id, and the columns to show. A case of any size fills pages, not one array.
    """
    rows = numbered(members, ["id"], ["acquired_at", "obs_id"], "_n")
    page = (F.floor((F.col("_n") - 1) / size) + 1).cast("long")
    pages = rows.groupBy("id", page.alias("page")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_n", *shown))).alias("m"))
    return pages.select("id", "page", "n", F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias("members"))


def blind_cases(judged: DataFrame, pages: DataFrame, candidates: DataFrame, registry: DataFrame, land: DataFrame, reviews: DataFrame) -> DataFrame:
    """What a reviewer is shown of each case, without rules, labels of other sources, or anything that a model says.

    judged: roles() of cases with lon, lat, radius_m, started_at, as_of. pages: member_pages(), whose sizes are
    given here and which are read beside this. candidates: id, fac_id, rank, distance_m (some dozens at most).
    registry: fac_id, lon, lat. land: id and its columns. Earlier reviews, without names, are shown to adjudicators only.
    """
    sizes = pages.groupBy("id").agg(F.sum("n").alias("members"), F.count("*").alias("pages"))
    mapped = candidates.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "fac_id", "distance_m"))).alias("candidates"))
    close = near(judged.select("id", "lon", "lat"), registry.select("fac_id", "lon", "lat"), SHOWN_REGISTRY_M)
    plants = close.groupBy("id").agg(F.count("*").alias("plants"), F.min(F.struct(F.round("distance_m", 1).alias("distance_m"), "fac_id")).alias("nearest_plant"))
    settled = judged.filter("role = 'ADJUDICATOR'").select("id")
    earlier = reviews.join(settled, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "source_label", "certainty"))).alias("earlier"))
    out = judged.select("id", "role", "review_slots", "as_of", "started_at", "lon", "lat", F.round("radius_m", 1).alias("support_radius_m"))
    for part in (sizes, mapped, plants, land, earlier):
        out = out.join(part.hint("merge"), "id", "left")
    return out.fillna(0, ["members", "pages", "plants"])


def imagery_links(lon: Column, lat: Column, day: Column, browser: str, layers: str, basemap: str, reach: float = 0.08) -> Column:
    """Links to imagery of a day in a box around a point, and to a basemap at it: an array of (label, url)."""
    box = F.format_string("%.4f,%.4f,%.4f,%.4f", lon - reach, lat - reach, lon + reach, lat + reach)
    dated = F.concat(F.lit(f"{browser}?v="), box, F.lit("&t="), F.date_format(day, "yyyy-MM-dd"), F.lit(f"&l={layers}"))
    plain = F.concat(F.lit(basemap), F.format_string("%.5f,%.5f", lat, lon))
    return F.array(F.struct(F.lit("IMAGERY").alias("label"), dated.alias("url")), F.struct(F.lit("BASEMAP").alias("label"), plain.alias("url")))
