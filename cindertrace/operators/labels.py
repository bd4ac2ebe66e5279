"""Case sets: group-disjoint splits, review order, label resolution, agreement, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.operators.episodes import stable_hash
from cindertrace.operators.ranks import numbered

# The seed, the shares of the splits, and the hosts of evidence links.
SEED, TRAIN, VALIDATION = "split-v1", 0.6, 0.2


def assign_splits(cases: DataFrame) -> DataFrame:
    """region_id, split_group, split for cases(region_id, split_group): whole groups, in the order of a hash.

    A group's share is that of the cases before it. A region of three groups or more has every split.
    """
    groups = cases.groupBy("region_id", "split_group").agg(F.count("*").alias("n")).withColumn("h", stable_hash(SEED, F.col("split_group")))
    region, order = Window.partitionBy("region_id"), Window.partitionBy("region_id").orderBy("h")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("n").over(region)
    first = F.when(F.col("share") < TRAIN, "TRAIN").when(F.col("share") < TRAIN + VALIDATION, "VALIDATION").otherwise("TEST")
    back = Window.partitionBy("region_id").orderBy(F.desc("h"))
    g = groups.withColumns({"share": before, "from_last": F.row_number().over(back), "groups": F.count("*").over(region)}).withColumn("split", first)
    lacks = F.max((F.col("split") == "TEST").cast("int")).over(region) == 0
    g = g.withColumn("split", F.when((F.col("groups") >= 3) & lacks & (F.col("from_last") == 1), "TEST").otherwise(F.col("split")))
    lacks = F.max((F.col("split") == "VALIDATION").cast("int")).over(region) == 0
    g = g.withColumn("split", F.when((F.col("groups") >= 3) & lacks & (F.col("from_last") == 2), "VALIDATION").otherwise(F.col("split")))
    return g.select("region_id", "split_group", "split")


def review_order(cases: DataFrame) -> DataFrame:
    """id, split, place: splits take turns (TEST, TRAIN, VALIDATION, TEST, TRAIN), then regions, then groups.

    cases: id, region_id, split_group, split. Exhausted lanes are skipped, so ranks give the order.
    Within regions and groups rows are numbered over range partitions. Above them no rows are ordered: a
    case's place follows from its number in its region, the regions' sizes (a catalogue of some dozens)
    and the splits' sizes.
    """
    c = cases.withColumns({"hc": stable_hash(SEED, "rank", F.col("id")), "hg": stable_hash(SEED, F.col("split_group"))})
    c = numbered(c.select("id", "split", "region_id", "split_group", "hc", "hg"), ["split", "region_id", "split_group"], ["hc"], "r")
    c = numbered(c, ["split", "region_id"], ["r", "hg"], "in_region")
    sizes = c.groupBy("split", "region_id").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("split").agg(F.collect_list(F.struct("region_id", "n")).alias("regions"), F.sum("n").alias("size"))
    lanes = sizes.agg(F.map_from_entries(F.collect_list(F.struct("split", "size"))).alias("lanes"))
    c = c.join(F.broadcast(sizes.select("split", "regions").crossJoin(lanes)), "split")  # a row for each of three splits
    i, region = F.col("in_region"), F.col("region_id")
    ahead = F.aggregate("regions", F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], i - 1) + F.when((x["region_id"] < region) & (x["n"] >= i), 1).otherwise(0))
    c = c.withColumn("j", ahead)
    j, slot = F.col("j"), F.col("split")
    cycle = F.when(slot == "VALIDATION", j).otherwise(F.floor(j / 2))
    turn = F.when(slot == "TEST", F.when(j % 2 == 0, 0).otherwise(3)).when(slot == "TRAIN", F.when(j % 2 == 0, 1).otherwise(4)).otherwise(2)
    c = c.withColumns({"cycle": cycle, "turn": turn})

    def before(split: str, *turns: int) -> Column:
        """How many cases of a split come in earlier cycles, or earlier turns of this one."""
        steps = F.col("cycle") * len(turns)
        for k in turns:
            steps = steps + (F.col("turn") > k).cast("int")
        return F.least(F.coalesce(F.try_element_at("lanes", F.lit(split)), F.lit(0)), steps)

    return c.select("id", "split", (before("TEST", 0, 3) + before("TRAIN", 1, 4) + before("VALIDATION", 2) + 1).alias("place"))


def resolve_labels(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """id, label, tier, basis for cases(id, review_slots, silver, weak) and reviews.

    reviews: id, seq (saved order), role, source_label, certainty, inside, qualifies (independent
    evidence of the source at the place).
    """
    reviewer = F.col("role") == "REVIEWER"
    per = reviews.groupBy("id").agg(
        F.count_if(reviewer).alias("n"),
        F.max(F.when(reviewer, F.col("seq"))).alias("last"),
        F.count_distinct(F.when(reviewer, F.col("source_label"))).alias("labels"),
        F.min_by("source_label", F.when(reviewer, F.col("seq"))).alias("first_label"),
        F.bool_or(reviewer & F.col("qualifies")).alias("any_good"),
        F.bool_and(F.when(reviewer, F.col("certainty").isin("HIGH", "MEDIUM") & F.col("inside"))).alias("all_sure"),
        F.min_by("qualifies", F.when(reviewer, F.col("seq"))).alias("first_good"),
    )
    settled = reviews.filter("role = 'ADJUDICATOR'").join(per.filter("n >= 2").select("id", "last"), "id").filter("seq > last")
    settled = settled.groupBy("id").agg(F.max_by(F.struct("source_label", "qualifies"), "seq").alias("a"))
    c = cases.join(per, "id", "left").join(settled, "id", "left")
    n, a = F.coalesce("n", F.lit(0)), F.col("a")
    gold = F.when(F.col("any_good") & F.col("all_sure"), "GOLD").otherwise("SILVER")
    unsure = F.lit("UNRESOLVED")
    steps = [
        (a.isNotNull() & (a["source_label"] == "UNRESOLVED"), unsure, unsure, "ADJUDICATED_UNRESOLVED"),
        (a.isNotNull(), a["source_label"], F.when(a["qualifies"], "GOLD").otherwise("SILVER"), "ADJUDICATED"),
        ((n >= 2) & (F.col("labels") > 1), unsure, unsure, "DISAGREEMENT_PENDING_ADJUDICATION"),
        ((n >= 2) & (F.col("first_label") == "UNRESOLVED"), unsure, unsure, "REVIEWERS_UNSURE"),
        (n >= 2, F.col("first_label"), gold, "TWO_REVIEWERS_AGREE"),
        ((n == 1) & (F.col("first_label") == "UNRESOLVED"), unsure, unsure, "REVIEWER_UNSURE"),
        ((n == 1) & (F.col("review_slots") >= 2), F.col("first_label"), F.lit("SILVER"), "ONE_OF_TWO_REVIEWS"),
        (n == 1, F.col("first_label"), F.when(F.col("first_good"), "GOLD").otherwise("SILVER"), "ONE_REVIEWER"),
        (F.col("silver").isNotNull(), F.col("silver"), F.lit("SILVER"), "REGISTRY_CORROBORATED"),
        (F.col("weak").isNotNull() & (F.col("weak") != "UNKNOWN"), F.col("weak"), F.lit("WEAK"), "RULES"),
    ]
    result = None
    for condition, label, tier, basis in steps:
        value = F.struct(label.alias("label"), tier.alias("tier"), F.lit(basis).alias("basis"))
        result = F.when(condition, value) if result is None else result.when(condition, value)
    none = F.lit(None).cast("string")
    result = result.otherwise(F.struct(none.alias("label"), none.alias("tier"), F.lit("UNLABELLED").alias("basis")))
    return c.withColumn("x", result).select("id", "x.label", "x.tier", "x.basis")


def test_eligible(tier: Column, basis: Column) -> Column:
    return F.coalesce((tier == "GOLD") & basis.isin("TWO_REVIEWERS_AGREE", "ADJUDICATED"), F.lit(False))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """n, kappa for pairs(a, b) of labels; null without pairs or where chance explains all."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreed"))
    one = pairs.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("x"))
    two = pairs.groupBy(F.col("b").alias("k")).agg(F.count("*").alias("y"))
    chance = one.join(two, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    both = n.crossJoin(F.broadcast(chance))  # one row by one row
    p = F.col("xy") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(F.when((F.col("n") > 0) & (p < 1), (F.col("agreed") - p) / (1 - p)), 6).alias("kappa"))


def fingerprint(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """keys, n, digest: one digest of all rows of a key, whatever their order.

    Rows are hashed; hashes that begin alike (a 65536th) are digested in their order, and those digests
    in theirs, so no text grows with a key beyond the hashes of one such block.
    """
    h = rows.select(*keys, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("h"))
    blocks = h.groupBy(*keys, F.substring("h", 1, 4).alias("block")).agg(F.count("*").alias("n"), F.expr("sha2(listagg(h, '') WITHIN GROUP (ORDER BY h), 256)").alias("d"))
    return blocks.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("sha2(listagg(d, '') WITHIN GROUP (ORDER BY block), 256)").alias("digest"))


def link_host(url: Column) -> Column:
    return F.rtrim(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), F.lit("."))


def forced_kind(url: Column, input_hosts: list[str], basemap_hosts: list[str], map_hosts: list[str]) -> Column:
    """What a link can only be, by its host and path: the project's own input, or an undated basemap."""
    host, path = link_host(url), F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))

    def any_of(conditions: list[Column]) -> Column:
        out = F.lit(False)
        for c in conditions:
            out = out | c
        return out

    own = any_of([(host == h) | host.endswith("." + h) for h in input_hosts]) | host.contains("overpass") | path.contains("/overpass")
    base = any_of([host.contains(h) for h in basemap_hosts]) | (any_of([host.contains(h) for h in map_hosts]) & path.startswith("/maps"))
    return F.when(own, "PROJECT_INPUT").when(base, "UNDATED_BASEMAP")


def independent(kind: Column, observed_on: Column, started_at: Column, as_of: Column, before: int = 365, after: int = 30) -> Column:
    """Official sources, and imagery dated near the episode."""
    near = observed_on.between(F.date_sub(F.to_date(started_at), before), F.date_add(F.to_date(as_of), after))
    return F.when(kind == "DATED_IMAGERY", F.coalesce(near, F.lit(False))).otherwise(kind == "OFFICIAL_OR_COMPANY")
