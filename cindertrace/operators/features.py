"""Episode features, and the evaluation of classifiers over prediction rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrace.operators import coverage
from cindertrace.operators.components import checkpointed
from cindertrace.operators.groups import dealt
from cindertrace.operators.ranks import running


def episode_features(members: DataFrame, *keys: str) -> DataFrame:
    """members: acquired_at, satellite, daynight, frp_mw, confidence, i4, i5."""
    night = (F.col("daynight") == "N").cast("double")
    return members.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_distinct(F.struct("acquired_at", "satellite")).alias("overpasses"),
        F.count_distinct(F.to_date("acquired_at")).alias("active_days"),
        F.round((F.max("acquired_at").cast("long") - F.min("acquired_at").cast("long")) / 3600, 6).alias("duration_h"),
        F.round(F.max("frp_mw"), 6).alias("max_frp"),
        F.round(F.median("frp_mw"), 6).alias("median_frp"),
        F.round(F.avg(night), 6).alias("night_fraction"),
        F.round(F.avg((F.col("confidence") == "h").cast("double")), 6).alias("high_fraction"),
        F.round(F.avg((F.col("confidence") == "l").cast("double")), 6).alias("low_fraction"),
        F.round(F.median(F.col("i4") - F.col("i5")), 6).alias("median_i4_i5"),
    )


def confusion(predictions: DataFrame, y: str = "y", predicted: str = "pred") -> DataFrame:
    """One row: the four counts, precision, recall, F1 of class 1, macro-F1 and accuracy (0 where undefined)."""
    c = predictions.groupBy().agg(*[F.count_if((F.col(y) == a) & (F.col(predicted) == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1, f0 = over(2 * tp, 2 * tp + fp + fn), over(2 * tn, 2 * tn + fp + fn)
    return c.select("tn", "fp", "fn", "tp", F.round(over(tp, tp + fp), 6).alias("precision"), F.round(over(tp, tp + fn), 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round((f1 + f0) / 2, 6).alias("macro_f1"), F.round(over(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"))


def reliability(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate for predictions(y, p); the last bin is closed."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"))


def abstention_curve(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each confidence threshold: how many are decided, their share, and the error among them.

    Rows are counted once, by how many thresholds they reach; the counts are then added up from above.
    """
    sure = F.greatest(F.col("p"), 1 - F.col("p"))
    wrong = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("long")
    steps = sorted(thresholds)
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x <= sure)).alias("reached")
    counts = predictions.groupBy(reached).agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong"))
    packed = counts.agg(F.collect_list(F.struct("reached", "n", "wrong")).alias("c"))  # a row for each threshold, and one

    def total(field: str, least: Column) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.when(x["reached"] >= least, x[field]).otherwise(0))

    rows = packed.select("c", F.posexplode(F.array(*map(F.lit, steps))).alias("k", "threshold"))
    rows = rows.select("threshold", total("n", F.col("k") + 1).alias("decided"), total("wrong", F.col("k") + 1).alias("wrong"), total("n", F.lit(0)).alias("all"))
    return rows.select("threshold", "decided", F.round(F.col("decided") / F.col("all"), 6).alias("coverage"), F.round(F.when(F.col("decided") > 0, F.col("wrong") / F.col("decided")), 6).alias("risk"))


# The risk that decided cases may have, and the share that must be decided.
TARGET_RISK, LEAST_COVERAGE = 0.10, 0.5


def choose_abstention(curve: DataFrame) -> DataFrame:
    """threshold, target_met: the least threshold within the target risk that decides enough, else 0.5."""
    good = (F.col("risk") <= TARGET_RISK) & (F.col("coverage") >= LEAST_COVERAGE)
    return curve.agg(F.min(F.when(good, F.col("threshold"))).alias("t")).select(F.coalesce("t", F.lit(0.5)).alias("threshold"), F.col("t").isNotNull().alias("target_met"))


def brier(predictions: DataFrame, *keys: str) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))), 6).alias("brier"))


#: From which uniform numbers on a Poisson variable of mean one is at least 1, 2, and so on.
POISSON = [round(sum(exp(-1) / factorial(k) for k in range(j)), 12) for j in range(1, 9)]


def draw_weight(group: Column, replicate: Column, seed: int) -> Column:
    """How often a group is drawn in a replicate: a Poisson number told from a hash, so the same in every run and engine."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), group.cast("string"), replicate.cast("string"))), 1, 13), 16, 10).cast("double") / 2.0**52
    weight = F.lit(0)
    for x in POISSON:
        weight = weight + (u >= x).cast("int")
    return weight


def bootstrap_interval(predictions: DataFrame, group: str, replicates: int = 1000, seed: int = 11) -> DataFrame:
    """The 95 % interval of accuracy when whole groups are drawn anew.

    Only sums by group are resampled. Each replicate weighs each group by a Poisson number, which adds
    up within tasks, instead of drawing from a list of all groups.
    """
    sums = predictions.groupBy(group).agg(F.count("*").alias("n"), F.sum(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("right"))
    rows = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumn("w", draw_weight(F.col(group), F.col("replicate"), seed))
    drawn = rows.groupBy("replicate").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("right")).alias("right")).filter("n > 0").select((F.col("right") / F.col("n")).alias("accuracy"))
    return drawn.agg(F.count("*").alias("replicates"), F.round(F.expr("percentile(accuracy, 0.025)"), 9).alias("low"), F.round(F.expr("percentile(accuracy, 0.975)"), 9).alias("high"))


#: Rows that one task of a fit holds.
FIT_ROWS = 50_000


class Trees:
    """Gradient-boosted trees with class weights. Missing inputs get a column that says so, and a value beyond all others."""

    def __init__(self, inputs: list[str], rounds: int = 300):
        self.inputs, self.rounds = inputs, rounds

    def prepared(self, rows: DataFrame) -> DataFrame:
        """rows with the column `features`."""
        from pyspark.ml.feature import VectorAssembler

        told = {f"{c}_missing": F.col(c).isNull().cast("double") for c in self.inputs}
        numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(-999.0)) for c in self.inputs}
        return VectorAssembler(inputCols=[*self.inputs, *told], outputCol="features").transform(rows.withColumns(told).withColumns(numbers)).drop(*told)

    def fit(self, train: DataFrame, target: str) -> Trees:
        """On prepared rows, whose number decides in how many parts they are held while trees are built."""
        from pyspark.ml.classification import GBTClassifier

        n, share = train.agg(F.count("*"), F.avg(F.col(target).cast("double"))).first()
        share = min(max(share or 0.0, 1 / max(n, 1)), 1 - 1 / max(n, 2))
        weight = F.when(F.col(target) == 1, (1 - share) / share).otherwise(1.0)
        own = train.select("features", F.col(target).cast("double").alias("label"), weight.alias("weight")).coalesce(max(1, -(-n // FIT_ROWS))).persist()
        trees = GBTClassifier(maxIter=self.rounds, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=2, seed=7, weightCol="weight")
        self.model = trees.fit(own)
        own.unpersist()
        return self

    def scored(self, rows: DataFrame) -> DataFrame:
        """Prepared rows with p."""
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def calibrated(rows: DataFrame, validation: DataFrame, target: str) -> DataFrame:
    """rows(p) with p calibrated by a logistic fit on validation(p, target); as it is where a class has fewer than 5 rows there."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    if min(validation.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()) < 5:
        return rows
    inside = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.ln(inside / (1 - inside))
    own = VectorAssembler(inputCols=["logit"], outputCol="x").transform(validation.select(logit.alias("logit"), F.col(target).cast("double").alias("label")))
    fit = LogisticRegression(featuresCol="x", labelCol="label").fit(own)
    return rows.withColumn("p", 1 / (1 + F.exp(-(float(fit.coefficients[0]) * logit + float(fit.intercept)))))


def boosted_scores(rows: DataFrame, inputs: list[str], target: str, key: str, rounds: int = 300) -> DataFrame:
    """key, y, p, split of rows(key, split, target, inputs): trees fitted on the split TRAIN, calibrated on VALIDATION."""
    trees = Trees(inputs, rounds)
    data = checkpointed(trees.prepared(rows.filter(F.col(target).isNotNull())))
    scored = trees.fit(data.filter("split = 'TRAIN'"), target).scored(data)
    return calibrated(scored, scored.filter("split = 'VALIDATION'"), target).select(key, F.col(target).cast("int").alias("y"), "p", "split")


def held_out_scores(rows: DataFrame, inputs: list[str], key: str = "id", rounds: int = 300) -> DataFrame:
    """key, region_id, y, p of TEST rows, each scored by trees fitted on the TRAIN rows of all other regions (not calibrated).

    rows: key, region_id, split, target, inputs; only regions that held_out_regions() tells to be SCORED
    take part. The fits are independent, so some run at a time.
    """
    trees = Trees(inputs, rounds)
    data = checkpointed(trees.prepared(rows))
    regions = sorted(r["region_id"] for r in held_out_regions(data).filter("status = 'SCORED'").collect())  # a catalogue of some dozens

    def one(region: str) -> DataFrame:
        held = F.col("region_id") == region
        own = Trees(inputs, rounds).fit(data.filter((F.col("split") == "TRAIN") & ~held), "target")
        return own.scored(data.filter((F.col("split") == "TEST") & held)).select(key, "region_id", F.col("target").cast("int").alias("y"), "p")

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, regions))
    out = data.filter("false").select(key, "region_id", F.col("target").cast("int").alias("y"), F.lit(0.0).alias("p"))
    for part in parts:
        out = out.unionByName(part)
    return out


# The inputs of a model, by where they come from, and what is stored beside them.
EPISODE = ["obs_count", "overpass_count", "duration_h", "frp_max", "frp_overpass_median", "bt_i4_median", "bt_i5_median", "bt_diff_median", "night_fraction", "high_conf_fraction", "low_conf_fraction", "scan_median", "track_median"]
HISTORY = ["active_days_30", "active_days_90", "overpasses_90", "days_since_last", "history_frp_median_90", "history_night_fraction_90"]
HISTORY_STORED = ["active_days_180", "coverage_90", "coverage_180"]
OSM = ["osm_covered", "n_industrial_in_support", "nearest_industrial_m", "n_industrial_2km", "has_power", "has_refinery", "has_mine", "has_petrochem_steel_lng", "has_flare_tag", "has_chimney_tag", "has_kiln_tag", "has_nonthermal_power"]
LANDCOVER = ["lc_valid", "lc_built", "lc_crop", "lc_tree", "lc_shrub", "lc_grass", "lc_bare", "lc_water", "lc_wetland", "lc_built_1km", "lc_crop_1km", "lc_tree_1km"]
FEATURES = EPISODE + HISTORY + OSM + LANDCOVER
FEATURE_SETS = {"thermal_history": EPISODE + HISTORY, "full": FEATURES, "full_minus_history": EPISODE + OSM + LANDCOVER, "full_minus_osm": EPISODE + HISTORY + LANDCOVER, "full_minus_landcover": EPISODE + HISTORY + OSM}
DISTANCE_CAP_M, DAYS_CAP = 5000.0, 90.0
NOT_INDUSTRIAL = ("VEGETATION_FIRE", "AGRICULTURAL_BURN", "OTHER")
LEAST_TRAIN, LEAST_VALIDATION, LEAST_TEST, LEAST_PROMOTE = 20, 5, 10, 30


def episode_inputs(members: DataFrame, *keys: str) -> DataFrame:
    """The EPISODE inputs of members(acquired_at, satellite, daynight, frp_mw, confidence, i4, i5, scan, track)."""

    def part(condition: Column) -> Column:
        return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 6)

    own = members.groupBy(*keys).agg(
        F.count("*").alias("obs_count"), F.count_distinct(F.struct("acquired_at", "satellite")).alias("overpass_count"), F.round((F.max("acquired_at").cast("double") - F.min("acquired_at").cast("double")) / 3600, 6).alias("duration_h"),
        F.round(F.median("i4"), 6).alias("bt_i4_median"), F.round(F.median("i5"), 6).alias("bt_i5_median"), F.round(F.median(F.col("i4") - F.col("i5")), 6).alias("bt_diff_median"),
        part(F.col("daynight") == "N").alias("night_fraction"), part(F.col("confidence") == "h").alias("high_conf_fraction"), part(F.col("confidence") == "l").alias("low_conf_fraction"),
        F.round(F.median("scan"), 6).alias("scan_median"), F.round(F.median("track"), 6).alias("track_median"), F.mode("nasa_type", True).alias("nasa_type"),
    )
    passes = members.filter("frp_mw IS NOT NULL").groupBy(*keys, "acquired_at", "satellite").agg(F.greatest(F.max("frp_mw"), F.lit(0.0)).alias("frp"))
    strength = passes.groupBy(*keys).agg(F.round(F.max("frp"), 6).alias("frp_max"), F.round(F.median("frp"), 6).alias("frp_overpass_median"))
    return own.join(strength, list(keys), "left")


def prior_inputs(subjects: DataFrame, rows: DataFrame, days: DataFrame) -> DataFrame:
    """sid, the HISTORY inputs and what is stored beside them: strictly before each subject's started_at.

    rows: sid, acquired_at, satellite, daynight, frp_mw, in files. days: as assessment.covered_days() gives them.
    """
    own = subjects.select("sid", "started_at")
    before = dealt(rows, "sid").join(own.hint("merge"), "sid").filter(F.col("acquired_at") < F.col("started_at"))

    def within(d: int) -> Column:
        return F.col("acquired_at") >= F.col("started_at") - F.make_dt_interval(F.lit(d))

    night = (F.col("daynight") == "N").cast("long")
    # equal overpasses fall together, then days: no row is multiplied for each distinct count
    overpasses = before.groupBy("sid", "started_at", "acquired_at", "satellite").agg(F.count("daynight").alias("n"), F.sum(night).alias("night"))
    daily = overpasses.groupBy("sid", "started_at", F.to_date("acquired_at").alias("day")).agg(
        *[F.max(F.when(within(d), 1).otherwise(0)).cast("long").alias(f"active_days_{d}") for d in (30, 90, 180)], F.count_if(within(90)).alias("overpasses_90"),
        F.sum(F.when(within(90), F.col("n"))).alias("n"), F.sum(F.when(within(90), F.col("night"))).alias("night"), F.max("acquired_at").alias("latest"),
    )
    seen = daily.groupBy("sid").agg(
        *[F.sum(c).alias(c) for c in ("active_days_30", "active_days_90", "active_days_180", "overpasses_90")], F.round(F.try_divide(F.sum("night").cast("double"), F.sum("n")), 6).alias("history_night_fraction_90"),
        F.round(F.least((F.max("started_at").cast("double") - F.max("latest").cast("double")) / 86400, F.lit(DAYS_CAP)), 6).alias("days_since_last"),
    )
    passes = before.filter(within(90) & F.col("frp_mw").isNotNull()).groupBy("sid", "acquired_at", "satellite", "daynight").agg(F.greatest(F.max("frp_mw"), F.lit(0.0)).alias("frp"))
    strength = passes.groupBy("sid").agg(F.round(F.median("frp"), 6).alias("history_frp_median_90"))
    start = F.to_date("started_at")
    covered = own.join(coverage.any_product(days).hint("merge"), "sid").groupBy("sid").agg(*[F.round(F.sum(coverage.days_in(F.col("bits"), F.col("block"), F.date_sub(start, d), start)) / d, 4).alias(f"coverage_{d}") for d in (90, 180)])
    out = subjects.select("sid")
    for part in (seen, strength, covered):
        out = out.join(part.hint("merge"), "sid", "left")
    zero = ["active_days_30", "active_days_90", "active_days_180", "overpasses_90"]
    return out.fillna(0, zero).fillna(0.0, ["coverage_90", "coverage_180"]).fillna(DAYS_CAP, ["days_since_last"])


def osm_inputs(subjects: DataFrame, candidates: DataFrame, covered: DataFrame) -> DataFrame:
    """sid and the OSM inputs: null, not zero, for subjects that are not in covered(sid).

    candidates: sid, facility_type, primary_tag, thermal_candidate, relation, distance_m.
    """
    hot, inside = F.col("thermal_candidate"), F.col("relation") == "INSIDE_SUPPORT"
    near = hot & inside

    def has(condition: Column) -> Column:
        return F.max((near & condition).cast("int"))

    kind, tag = F.col("facility_type"), F.col("primary_tag")
    found = candidates.groupBy("sid").agg(
        F.count_if(near).alias("n_industrial_in_support"), F.min(F.when(hot, F.round("distance_m", 1))).alias("nearest_industrial_m"), F.count_if(hot).alias("n_industrial_2km"), has(kind == "POWER").alias("has_power"),
        has(kind == "REFINERY").alias("has_refinery"), has(kind == "MINE").alias("has_mine"), has(kind.isin("PETROCHEMICAL", "STEEL", "LNG")).alias("has_petrochem_steel_lng"), has(tag == "man_made=flare").alias("has_flare_tag"),
        has(tag == "man_made=chimney").alias("has_chimney_tag"), has(tag == "man_made=kiln").alias("has_kiln_tag"), F.max((~hot & inside).cast("int")).alias("has_nonthermal_power"),
    )
    out = subjects.select("sid").join(covered.select("sid", F.lit(1).alias("osm_covered")).distinct().hint("merge"), "sid", "left").join(found.hint("merge"), "sid", "left")
    known = F.col("osm_covered") == 1
    filled = {c: F.when(known, F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in OSM[1:] if c != "nearest_industrial_m"}
    filled["nearest_industrial_m"] = F.when(known, F.least(F.coalesce("nearest_industrial_m", F.lit(DISTANCE_CAP_M)), F.lit(DISTANCE_CAP_M)))
    return out.withColumns(filled).fillna(0, ["osm_covered"])


def landcover_inputs(support: Column, valid: Column, context: Column) -> dict[str, Column]:
    """The LANDCOVER inputs from two maps of class shares, all null where there are none."""
    from cindertrace.operators.landcover import share

    of = {"built": ("built",), "crop": ("crop",), "tree": ("tree",), "shrub": ("shrub",), "grass": ("grass",), "bare": ("bare",), "water": ("water",), "wetland": ("wetland", "mangrove")}
    out = {"lc_valid": F.when(support.isNotNull(), valid)} | {f"lc_{k}": F.round(share(support, *names), 6) for k, names in of.items()}
    return out | {f"lc_{k}_1km": F.round(share(context, *of[k]), 6) for k in ("built", "crop", "tree")}


def frozen(stored: DataFrame, computed: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """key, sha256, outcome (NEW, UNCHANGED, DIFFERENT) of computed rows against stored(key, sha256) of the same version.

    strict: refuses any difference, since a version never changes its meaning.
    """
    columns = sorted(c for c in computed.columns if c != key)
    sha = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    both = computed.select(key, sha.alias("sha256")).join(stored.select(key, F.col("sha256").alias("old")), key, "left")
    out = both.select(key, "sha256", F.when(F.col("old").isNull(), "NEW").when(F.col("old") == F.col("sha256"), "UNCHANGED").otherwise("DIFFERENT").alias("outcome"))
    if strict and not out.filter("outcome = 'DIFFERENT'").isEmpty():
        raise ValueError("FEATURES_DIFFER_FROM_STORED_VERSION")
    return out


def binary_target(label: Column) -> Column:
    return F.when(label == "INDUSTRIAL", 1).when(label.isin(*NOT_INDUSTRIAL), 0)


def rule_baseline(rows: DataFrame) -> DataFrame:
    """confusion() of the rules' own labels where they have one, and the share that they cover: rows(y, weak)."""
    covered = rows.filter("weak IS NOT NULL").select("y", (F.col("weak") == "INDUSTRIAL").cast("int").alias("pred"))
    share = rows.agg(F.round(F.avg(F.col("weak").isNotNull().cast("double")), 4).alias("coverage"))
    return confusion(covered).crossJoin(F.broadcast(share))  # one row by one row


def support(rows: DataFrame) -> DataFrame:
    """split, positive, negative for rows(split, target)."""
    return rows.groupBy("split").agg(F.count_if(F.col("target") == 1).alias("positive"), F.count_if(F.col("target") == 0).alias("negative"))


def gate(rows: DataFrame, weak: bool = False, gain_low: float | None = None, by: str | None = None) -> DataFrame:
    """One row (or one of each `by`): cases of the rarer class by split, and status, for rows(split, target) that are usable.

    gain_low: the lower end of the interval of the gain over the best baseline, once it is known.
    """

    def least(split: str) -> Column:
        own = F.col("split") == split
        return F.least(F.count_if(own & (F.col("target") == 1)), F.count_if(own & (F.col("target") == 0)))

    counts = rows.groupBy(*[by] * bool(by)).agg(least("TRAIN").alias("train"), least("VALIDATION").alias("validation"), least("TEST").alias("test"))
    enough = (F.col("train") >= LEAST_TRAIN) & (F.col("validation") >= LEAST_VALIDATION) & (F.col("test") >= LEAST_TEST)
    promoted = (F.col("test") >= LEAST_PROMOTE) & F.lit(gain_low is not None and gain_low > 0)
    status = F.lit("DRY_RUN_NOT_EVIDENCE") if weak else F.when(~enough, "INSUFFICIENT_LABELS").when(promoted, "PROMOTED").otherwise("EVALUATED_NOT_PROMOTED")
    return counts.withColumn("status", status)


def held_out_regions(rows: DataFrame) -> DataFrame:
    """region_id, test_cases, status: can a model of all other regions' TRAIN rows be judged on this one's TEST rows?"""
    train, test = F.col("split") == "TRAIN", F.col("split") == "TEST"
    by = rows.groupBy("region_id").agg(F.count_if(train & (F.col("target") == 1)).alias("p"), F.count_if(train & (F.col("target") == 0)).alias("n"), F.count_if(test).alias("test_cases"))
    every = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    out = by.crossJoin(F.broadcast(every)).filter("test_cases > 0")  # one row
    least = F.least(F.col("all_p") - F.col("p"), F.col("all_n") - F.col("n"))
    return out.select("region_id", "test_cases", F.when(least < LEAST_TRAIN, "INSUFFICIENT_TRAINING_LABELS").otherwise("SCORED").alias("status"))


def known_site_future(rows: DataFrame) -> DataFrame:
    """One row: train_cases before the cutoff, test_cases after it at groups seen before, and status: rows(forward_period, split_group, target, fit_for_test)."""
    before = rows.filter("forward_period = 'BEFORE' AND target IS NOT NULL")
    after = rows.filter("forward_period = 'AFTER' AND target IS NOT NULL AND fit_for_test").join(before.select("split_group").distinct(), "split_group", "left_semi")
    a = before.agg(F.count("*").alias("train_cases"), F.least(F.count_if(F.col("target") == 1), F.count_if(F.col("target") == 0)).alias("a"))
    b = after.agg(F.count("*").alias("test_cases"), F.least(F.count_if(F.col("target") == 1), F.count_if(F.col("target") == 0)).alias("b"))
    out = a.crossJoin(F.broadcast(b))  # one row by one row
    return out.select("train_cases", "test_cases", F.when((F.col("a") < LEAST_TRAIN) | (F.col("b") < LEAST_TEST), "INSUFFICIENT_LABELS").otherwise("EVALUATED").alias("status"))


def average_precision(predictions: DataFrame) -> DataFrame:
    """The area under precision against recall for predictions(y, p), a step for each distinct score."""
    steps = predictions.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).withColumn("from_top", -F.col("p"))
    run = running(steps, "from_top", {"n": "at", "hits": "found"})
    return run.agg(F.round(F.sum(F.col("hits") * F.col("found") / F.col("at")) / F.sum("hits"), 6).alias("pr_auc"))


def error_rates(predictions: DataFrame, key: str) -> DataFrame:
    """key, cases, errors, rate of predictions(y, pred)."""
    wrong = (F.col("y") != F.col("pred")).cast("long")
    return predictions.groupBy(key).agg(F.count("*").alias("cases"), F.sum(wrong).alias("errors"), F.round(F.avg(wrong), 6).alias("rate"))


def worst_errors(predictions: DataFrame, most: int = 15) -> DataFrame:
    """The errors of predictions(id, y, p, pred) that were made with most confidence, ties by id."""
    return predictions.filter("y != pred").orderBy(F.desc(F.round(F.abs(F.col("p") - 0.5), 9)), "id").limit(most)


def positive_rate(rows: DataFrame, kind: str) -> DataFrame:
    """kind, cases, rate of target among rows with that kind (nulls are left out)."""
    return rows.filter(F.col(kind).isNotNull() & F.col("target").isNotNull()).groupBy(kind).agg(F.count("*").alias("cases"), F.round(F.avg("target"), 4).alias("rate"))
